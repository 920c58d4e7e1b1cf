"""Chat formatting: minimum-cost repair of roles over the automaton of legal turns, then rendering.

Legal: at most one system turn, first; then user and assistant in turn, user first.  For each turn in order a dynamic
program over the automaton's four states takes the cheapest of: keep it, relabel it (2; an unknown or missing role 1),
merge it into the turn before (1, and the relabelling if the roles differ), each after inserting at most one empty
turn (3).  Ties take the earlier of keep, merge, relabel, insert.  The repaired turns are rendered as
``<|role|>\\ntext<|end|>\\n``; a ``<|`` in a text becomes ``< |``, so that no text can open a turn.

Turns are ordered by turn (null first), then role, then a hash of the text and the text.  They are dealt by ranges of
that order, so that one conversation of a third of all rows is no single task's work: a task goes through its range in
order, and renders what begins and ends in it.  A conversation that crosses ranges, or has more than ``SEGMENT`` turns, is
a chain of segments: each gives the least cost from every state to every other, these small matrices are composed along
the conversation, and each segment is then rendered from its own entry to its own exit.

Result: one row for a conversation of up to ``SEGMENT`` turns; a longer one has several parts, numbered from 0, whose
texts follow each other.  Defined results: null texts are empty; rows repeated are turns of their own; ties as above; rows
of a null conv_id are one conversation; an empty table gives an empty result; other columns are not looked at.  Memory
grows with a segment's texts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table, tidy

SEGMENT = 4096

ROLES = ("system", "user", "assistant")
RELABEL, UNKNOWN, MERGE, INSERT = 2, 1, 1, 3
#: state -> roles that may follow; a state is the role of the last turn, None at the start.
FOLLOWS = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def _relabel(role: str, to: str) -> int:
    return 0 if role == to else RELABEL if role in ROLES else UNKNOWN


def repair(roles: list[str], entry: str | None = None, exit_: str | None = None) -> tuple[int, list[tuple[str, str]]]:
    """The least cost, and for every given turn its (action, role); ("insert", role) stands before the turn it helps.

    From the state ``entry``, and to the state ``exit_`` if one is given.
    """
    best = _reached(roles, entry)
    cost, chain = best[exit_] if exit_ else min(best.values(), key=lambda x: x[0])
    steps = []
    while chain is not None:
        step, chain = chain
        steps.append(step)
    return cost, steps[::-1]


def _reached(roles: list[str], entry: str | None) -> dict:
    """state -> (least cost, chain of steps) after the given turns."""
    best = {entry: (0, None)}
    for role in roles:
        following: dict = {}

        def offer(state, cost, rank, chain, following=following):
            if state not in following or (cost, rank) < following[state][:2]:
                following[state] = (cost, rank, chain)

        for order, (state, (cost, chain)) in enumerate(best.items()):
            for to in FOLLOWS[state]:
                extra = _relabel(role, to)
                offer(to, cost + extra, (2 if extra else 0, order), (("relabel" if extra else "keep", to), chain))
                for second in FOLLOWS[to]:
                    extra = _relabel(role, second)
                    offer(second, cost + INSERT + extra, (3, order), (("relabel" if extra else "keep", second), (("insert", to), chain)))
            if state is not None:
                offer(state, cost + MERGE + _relabel(role, state), (1, order), (("merge", state), chain))
        best = {s: following[s][::2] for s in ROLES if s in following}
    return best


def render(steps: list[tuple[str, str]], texts: list[str], begun: bool = False, ends: bool = True) -> tuple[list[str], str]:
    """The repaired roles and the rendered conversation.  ``begun``: a turn before this part is still open; ``ends``:
    whether the last one is closed."""
    roles, out = [], []
    rest = iter(texts)
    open_ = begun
    for action, role in steps:
        if action == "merge":
            out.append("\n" + next(rest).replace("<|", "< |"))
            continue
        out.append("<|end|>\n" * open_ + f"<|{role}|>\n" + ("" if action == "insert" else next(rest).replace("<|", "< |")))
        roles.append(role)
        open_ = True
    return roles, "".join(out) + "<|end|>\n" * (ends and open_)


def matrix(roles: list[str]) -> list[int]:
    """Least costs from None and each role to each role; -1 where there is no way."""
    out = []
    for entry in (None, *ROLES):
        reached = _reached(roles, entry)
        out += [reached[s][0] if s in reached else -1 for s in ROLES]
    return out


def chain(matrices: list[list[int]]) -> list[tuple[str | None, str]]:
    """(entry, exit) of each segment on the cheapest way through all; ties take the earlier role."""
    best, back = {None: 0}, []
    for m in matrices:
        now, come = {}, {}
        for entry, cost in best.items():
            row = m[3 * (0 if entry is None else 1 + ROLES.index(entry)) :]
            for k, to in enumerate(ROLES):
                if row[k] >= 0 and (to not in now or cost + row[k] < now[to]):
                    now[to], come[to] = cost + row[k], entry
        best = {s: now[s] for s in ROLES if s in now}
        back.append(come)
    at, out = min(best, key=best.get), []
    for come in reversed(back):
        out.append((come[at], at))
        at = come[at]
    return out[::-1]


_PARTS = "n_turns long, cost long, roles string, rendered string"


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, cost, roles, rendered for rows (conv_id, turn, role, text)."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    rows = turns.select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    keys = ("conv_id", "turn", "role", "h")
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "text").select("conv_id", "role", "text")
    size = SEGMENT

    def segments(batches):
        """Whole conversations rendered, and segments of those that may go on in another range."""
        pid, seq, first = TaskContext.get().partitionId(), 0, True
        now, roles, texts, chained, any_ = None, [], [], False, False
        made: list[tuple] = []

        def close(edge):
            nonlocal seq, chained
            if edge or chained:
                made.append((now, pid, seq, len(roles), None, None, None, list(roles), list(texts), matrix(roles)))
                seq += 1
            else:
                cost, steps = repair(roles)
                repaired, text = render(steps, texts)
                made.append((now, None, None, len(roles), cost, ",".join(repaired), text, None, None, None))
            roles.clear(), texts.clear()

        for b in batches:
            for c, r, t in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                if any_ and c != now:
                    if roles:
                        close(first)
                    first, chained = False, False
                elif len(roles) >= size:
                    chained = True
                    close(True)
                now, any_ = c, True
                roles.append(r), texts.append(t)
            if made:
                yield _segment_batch(made, b.schema.field("conv_id").type)
                made.clear()
        if roles:
            close(True)
            yield _segment_batch(made, pa_kind)

    pa_kind = _arrow_type(turns.schema["conv_id"].dataType)
    schema = f"conv_id {kind}, pid int, seq int, {_PARTS}, turn_roles array<string>, texts array<string>, costs array<int>"
    found = checkpoint(dealt.mapInArrow(tidy(segments), schema))
    whole = found.where("pid is null").select("conv_id", F.lit(0).alias("part"), "n_turns", "cost", "roles", "rendered")
    pending = found.where("pid is not null")

    def ways(t: pa.Table) -> pa.Table:
        """Entry and exit of each segment of a conversation, which has one row here for every ``SEGMENT`` turns."""
        order = sorted(range(len(t)), key=lambda i: (t["pid"][i].as_py(), t["seq"][i].as_py()))
        t = t.take(order)
        way = chain(t["costs"].to_pylist())
        starts, at = [], 0
        for n in t["n_turns"].to_pylist():
            starts.append(at // size)
            at += n
        last = len(way) - 1
        columns = [t["pid"], t["seq"], pa.array([x for x, _ in way], pa.string()), pa.array([x for _, x in way], pa.string()), pa.array(starts, pa.int32()), pa.array([i == last for i in range(len(way))])]
        return pa.table(columns, names=["pid", "seq", "entry", "leave", "part", "ends"])

    ways_ = pending.select("conv_id", "pid", "seq", "n_turns", "costs").groupBy("conv_id").applyInArrow(ways, "pid int, seq int, entry string, leave string, part int, ends boolean")

    def rendered(batches):
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("turn_roles", "texts", "entry", "leave", "ends")]
            costs, roles, texts = [], [], []
            for r, t, entry, leave, ends in zip(*columns, strict=True):
                cost, steps = repair(r, entry, leave)
                repaired, text = render(steps, t, entry is not None, ends)
                costs.append(cost), roles.append(",".join(repaired)), texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("conv_id", "part", "pid", "seq", "n_turns")), pa.array(costs, pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string())],
                ["conv_id", "part", "pid", "seq", "n_turns", "cost", "roles", "rendered"],
            )

    parts = pending.select("conv_id", "pid", "seq", "n_turns", "turn_roles", "texts").join(ways_, ["pid", "seq"]).mapInArrow(tidy(rendered), f"conv_id {kind}, part int, pid int, seq int, {_PARTS}")
    ordered = F.sort_array(F.collect_list(F.struct("pid", "seq", "roles", "rendered")))
    joined = parts.groupBy("conv_id", "part").agg(F.sum("n_turns").alias("n_turns"), F.sum("cost").alias("cost"), ordered.alias("x")).select(
        "conv_id", "part", "n_turns", "cost", F.array_join(F.filter("x.roles", lambda r: r != ""), ",").alias("roles"), F.array_join("x.rendered", "").alias("rendered")
    )
    return whole.unionByName(joined)


def _arrow_type(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _segment_batch(made: list[tuple], conv_type) -> pa.RecordBatch:
    texts = pa.list_(pa.string())
    kinds = (conv_type, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), texts, texts, pa.list_(pa.int32()))
    names = ("conv_id", "pid", "seq", "n_turns", "cost", "roles", "rendered", "turn_roles", "texts", "costs")
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], k) for i, k in enumerate(kinds)], names=list(names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
