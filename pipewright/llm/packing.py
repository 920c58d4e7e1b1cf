"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

Packing only depends on how many pieces there are of each length, and lengths end at the capacity, so the instance is
a histogram of at most ``capacity`` numbers however large the corpus.  On it, sets of pieces that dominate every other
set with the same longest piece are fixed for good, each as often as the counts allow: a piece that fits with nothing;
a pair that fills a sequence; the largest partner where no two others are larger together; that partner and the largest
third piece where no pair has a larger second.  What is left is packed best-fit decreasing, whole classes of equal
sequences at a time.  ``lower_bound`` tells how many sequences any packing needs.  The plan says, for each length, which ranks go to which
sequences at which offset.  Ranks are counted within partitions and shifted by the counts of those before, so that a
length which a third of all pieces have is no single task's work.

Defined results: null as empty (one piece of the end token); rows repeated, and rows of a null id, are separate
documents; pieces of one length are ranked by task, doc_id, piece and checksum, so that ties only decide which of them
goes where; an empty table has no pieces; other columns are not looked at.  A very long text is cut into many pieces,
and takes memory in proportion to its length.
"""

from __future__ import annotations

import json
import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import ChunkCache, ascii_kinds, gather
from .common import checkpoint, table, text_view, tidy

CAPACITY, END_ID = 4096, 1
#: Chunks that the tokeniser gets in one call; bounds its results, which are far larger than their ids.
ENCODED_AT_ONCE = 4096


def pack_histogram(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) for counts[length]; every piece is placed once."""
    left = np.array(counts, np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    reduce_by_dominance(left, capacity, plan)
    best_fit(left, capacity, plan)
    return plan


def reduce_by_dominance(left: np.ndarray, capacity: int, plan: list) -> None:
    """Fix dominating sets, taking them out of ``left``, until none is found."""
    changed = True
    while changed:
        changed = False
        for long in range(capacity, 0, -1):
            n = int(left[long])
            if not n:
                continue
            rest = capacity - long
            if rest and (m := n // 2 if rest == long else min(n, int(left[rest]))):  # a filled sequence dominates
                left[long] -= m
                left[rest] -= m
                plan.append(((long, rest), m))
                changed = True
                n = int(left[long])
                if not n:
                    continue
            left[long] -= 1
            small = np.flatnonzero(left)
            left[long] += 1
            if not len(small) or small[0] > rest:  # fits with nothing
                m = n if rest < long else 1
                left[long] -= m
                plan.append(((long,), m))
                changed = True
                continue
            second = small[0] if left[small[0]] - (small[0] == long) > 1 else (small[1] if len(small) > 1 else capacity + 1)
            if small[0] + second > rest:  # at most one more piece: the largest that fits dominates
                partner = int(small[np.searchsorted(small, rest, "right") - 1])
                m = n // 2 if partner == long else min(n, int(left[partner]))
                if m:
                    left[long] -= m
                    left[partner] -= m
                    plan.append(((long, partner), m))
                    changed = True
                continue
            if third := _dominating(left, long, rest):
                m = _times(left, (long, *third))
                for x in (long, *third):
                    left[x] -= m
                plan.append(((long, *third), m))
                changed = True


def _times(left: np.ndarray, lengths: tuple[int, ...]) -> int:
    """How often a set can be taken."""
    return min(int(left[x]) // lengths.count(x) for x in set(lengths))


def _dominating(left: np.ndarray, long: int, rest: int) -> tuple[int, ...]:
    """The one or two pieces that, beside ``long``, dominate all others that fit in ``rest``; () where none surely do.

    A set dominates another if the other's pieces can be dealt to its own, each getting no more than its length.  Only
    where no three pieces fit: then the others are single pieces and pairs.
    """
    left = left.copy()
    left[long] -= 1
    small = np.flatnonzero(left[: rest + 1])
    least, need = 0, 3
    for x in small[:3]:
        n = min(int(left[x]), need)
        least, need = least + n * int(x), need - n
    if not need and least <= rest:
        return ()
    top = int(small[-1])
    # the largest partner of each piece (itself only if there are two)
    spot = np.searchsorted(small, rest - small, "right") - 1
    same = (spot >= 0) & (small[np.maximum(spot, 0)] == small) & (left[small] < 2)
    spot = np.where(same, spot - 1, spot)
    pair = spot >= 0
    other = small[np.maximum(spot, 0)]
    if not pair.any() or int((small + other)[pair].max()) <= top:
        return (top,)  # no two others are larger together
    if not pair[-1]:
        return ()
    second = int(other[-1])
    if int(np.minimum(small, other)[pair].max()) <= second:
        return top, second
    return ()


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The least number of sequences that counts[length] pieces can need: for each threshold, the pieces that leave no
    room for it, those above half that go alone, and the room that the others still lack (Martello and Toth's L2)."""
    n = np.array(counts[: capacity + 1], np.int64)
    size = np.arange(len(n))
    many, total = np.cumsum(n), np.cumsum(n * size)
    best = -(-int(total[-1]) // capacity)
    for t in range(capacity // 2 + 1):
        alone = int(many[-1] - many[capacity - t])  # longer than what t leaves
        half = int(many[capacity - t] - many[capacity // 2])
        between = int(total[capacity - t] - total[capacity // 2])
        small = int(total[capacity // 2] - (total[t - 1] if t else 0))
        best = max(best, alone + half + max(0, -(-(small - (half * capacity - between)) // capacity)))
    return best


def best_fit(left: np.ndarray, capacity: int, plan: list) -> None:
    """Best-fit decreasing: each piece, longest first, into the open sequence with the least room that holds it."""
    room: dict[int, list[list]] = {}  # room -> [lengths, how many]
    open_rooms = np.zeros(capacity + 1, bool)

    def put(space, lengths, m):
        room.setdefault(space, []).append([lengths, m])
        open_rooms[space] = True

    for long in range(capacity, 0, -1):
        n = int(left[long])
        while n:
            fits = int(np.argmax(open_rooms[long:])) + long if open_rooms[long:].any() else None
            if fits is None:
                each = capacity // long
                if n // each:
                    put(capacity - each * long, (long,) * each, n // each)
                if n % each:
                    put(capacity - n % each * long, (long,) * (n % each), 1)
                n = 0
                continue
            lengths, m = room[fits].pop()
            if not room[fits]:
                open_rooms[fits] = False
            each = min(fits // long, -(-n // m))
            used = min(m, n // each)
            put(fits - each * long, (*lengths, *(long,) * each), used)
            n -= used * each
            if m > used:
                room.setdefault(fits, []).append([lengths, m - used])
                open_rooms[fits] = True
        left[long] = 0
    for groups in room.values():
        plan += [(tuple(lengths), m) for lengths, m in groups]


def slots(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length << 44 | first rank), and the first sequence and the offset for ranks from there on."""
    taken: dict[int, int] = {}
    keys, sequences, offsets, base = [], [], [], 0
    for lengths, m in plan:
        offset = 0
        for long in lengths:
            rank = taken.get(long, 0)
            taken[long] = rank + m
            keys.append(long << 44 | rank), sequences.append(base), offsets.append(offset)
            offset += long
        base += m
    order = np.argsort(np.array(keys, np.int64))
    return tuple(np.array(x, np.int64)[order] for x in (keys, sequences, offsets))


#: The pattern of a tokeniser that parts letters, single digits and marks, contractions aside.
_BY_KIND = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORKER: dict[str, tuple] = {}


def parts_by_kind(settings: dict) -> bool:
    """Whether a tokeniser keeps letters, digits and marks apart, and digits from each other: its pattern says so."""
    return any(p.get("pattern") == {"Regex": _BY_KIND} for p in (settings.get("pre_tokenizer") or {}).get("pretokenizers", ()))


def worker_coder(path: str) -> tuple:
    """This worker's cache of chunks, encoder of whole texts and added tokens, made once."""
    if path not in _WORKER:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def encode(chunks):
            plain = [c.strip(b" \t\n\r\v\f").lower() for c in chunks]  # the tokeniser drops white space and lower-cases
            unique = list(dict.fromkeys(plain))
            number = {c: k for k, c in enumerate(unique)}
            pools, sizes = [], []
            for k in range(0, len(unique), ENCODED_AT_ONCE):
                ids = [e.ids for e in tokenizer.encode_batch_fast([c.decode() for c in unique[k : k + ENCODED_AT_ONCE]], add_special_tokens=False)]
                sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
                pools.append(np.fromiter(chain.from_iterable(ids), np.int32, int(sizes[-1].sum())))
            sizes = np.concatenate(sizes)
            which = np.fromiter((number[c] for c in plain), np.int64, len(plain))
            return gather(np.concatenate(pools), (np.cumsum(sizes) - sizes)[which], sizes[which]), sizes[which]

        settings = json.loads(tokenizer.to_str())
        cache = ChunkCache(encode, 400_000, kinds=ascii_kinds() if parts_by_kind(settings) else None)
        _WORKER[path] = cache, lambda text: tokenizer.encode(text, add_special_tokens=False).ids, [t["content"] for t in settings.get("added_tokens") or ()]
    return _WORKER[path]


def ids_of(path: str, column: pa.Array):
    """Per slice of rows: (first row, row after the last, all ids, ids of each row).  A text with an added token in it,
    which the tokeniser finds before all else, is encoded as a whole; all others go through the cache of chunks."""
    cache, whole, added = worker_coder(path)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    marked = np.zeros(len(column), bool)
    for token in added:
        marked |= pc.fill_null(pc.match_substring(column, token, ignore_case=True), False).to_numpy(zero_copy_only=False)
    i = 0
    while i < len(column):
        if marked[i]:
            ids = np.array(whole(column[i].as_py()), np.int32)
            yield i, i + 1, ids, np.array([len(ids)], np.int64)
            i += 1
        else:
            j = i + int(np.argmax(np.append(marked[i:], True)))
            for a, b, ids, n in cache.encode(*text_view(column.slice(i, j - i))):
                yield i + a, i + b, ids, n
            i = j


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and part (the task that made the row) of every document."""

    def run(batches):
        part = TaskContext.get().partitionId()
        for b in batches:
            for i, j, ids, n in ids_of(tokenizer_path, b.column("text")):
                row, number, start, length, crc = [], [], [], [], []
                at = np.concatenate([[0], np.cumsum(n)])
                tail = np.array([end_id], "<u4")
                for k in range(j - i):
                    all_ids = np.concatenate([ids[at[k] : at[k + 1]].astype("<u4"), tail])
                    for p, s in enumerate(range(0, len(all_ids), capacity)):
                        cut = all_ids[s : s + capacity]
                        row.append(i + k), number.append(p), start.append(s), length.append(len(cut)), crc.append(zlib.crc32(cut.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([part] * len(row), pa.int32())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int")


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The columns of op5 for documents (doc_id, text)."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    made = checkpoint(pieces(docs, tokenizer_path, capacity, end_id))
    counts = np.zeros(capacity + 1, np.int64)
    for r in made.groupBy("length").count().collect():  # a row for each length, ``capacity`` at most
        counts[r["length"]] = r["count"]
    keys, sequences, offsets = slots(pack_histogram(counts, capacity))
    shared = docs.sparkSession.sparkContext.broadcast((keys, sequences, offsets))  # bounded by the capacity, not the corpus
    by_length = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_length.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    own = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = made.withColumn("rn", F.row_number().over(own)).join(base, ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rn") - 1).alias("rank"))

    def place(batches):
        keys, sequences, offsets = shared.value
        for b in batches:
            key = b.column("length").to_numpy() << 44 | b.column("rank").to_numpy()
            spot = np.searchsorted(keys, key, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(sequences[spot] + key - keys[spot]), pa.array(offsets[spot])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
