"""Programs over tables: one planner over both tiers.

A table is the array of its rows.  A plan is read from left to right with the value at hand being either that array
(``Array``) or the stream of its rows (``Stream``, after ``.[]`` and inside ``map``).  On the array, ``sort_by``,
``group_by(k) | map({..})``, ``unique_by``, slices, ``reduce``, ``INDEX``, ``JOIN``, ``IN`` and so on become their
relational counterparts; on the stream, filters, constructors and the like become Columns.  A row-wise step without such
a form is run, with all that follows it in its stream, by the dynamic tier: its outputs are JSON text in ``value``, or
typed rows where the caller gives their ``schema``.  A step on the array without a form raises ``NotLowered``.

Order: the rows of a file have none; ``sort_by`` gives a table one, which filters and row-wise steps keep while its keys
are columns.  What needs an order (``.[n:]``, ``last``, ``reverse``, ``foreach``) asks for one, and where only ties
depend on it (``unique_by``, ``min_by``), an unsorted table is taken in the order of its rows' values.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipewright.functions.columns import NotLowered, Scope, compile_column, compile_many, probe_of, truth
from pipewright.lang.parser import parse
from pipewright.lang.printer import split_directives
from pipewright.operators.dynamic import apply_rows

HERE = ("identity",)
ROWS = ("iterate", HERE)


@dataclass(frozen=True)
class Plan:
    """A DataFrame; whether its rows are one array; the columns (and directions) it is sorted by, if it is."""

    df: DataFrame
    array: bool = True
    order: tuple = ()

    def stream(self, df: DataFrame | None = None) -> Plan:
        return replace(self, df=self.df if df is None else df, array=False)


@dataclass(frozen=True)
class Context:
    tables: dict
    variables: dict
    defs: tuple = ()
    indices: dict = None
    schema: str | None = None
    fallback: bool = True
    modules: dict = None
    head: str = ""


def lower(
    df: DataFrame | SparkSession, program: str, tables: dict[str, DataFrame] | None = None, variables: dict | None = None, schema: str | None = None, fallback: bool = True,
    modules: dict[str, str] | None = None,
) -> DataFrame:
    """The table that a program makes of a table; of a session instead: of null.

    ``schema``: the fields of the rows that dynamic steps give, where further steps need them as columns.
    ``fallback``: whether row-wise steps may run in the dynamic tier.
    """
    given = {k: v for k, v in (variables or {}).items()}
    head, body = split_directives(program)
    context = Context(tables or {}, given, (), {}, schema, fallback, modules, head)
    tree = parse(body)
    if isinstance(df, SparkSession):
        return _of_null(df, tree, context)
    return _steps(Plan(df), steps_of(tree), context).df


def steps_of(tree) -> list:
    return [*steps_of(tree[1]), *steps_of(tree[2])] if tree[0] == "pipe" else [tree]


def joined(steps: list):
    tree = steps[-1]
    for s in reversed(steps[:-1]):
        tree = ("pipe", s, tree)
    return tree


def scope_of(df: DataFrame, variables: dict | None = None) -> Scope:
    """A row's fields; a table of the one column ``value`` holds plain values, which are the input themselves."""
    alone = F.col("value") if df.columns == ["value"] else None
    given = {k: v if isinstance(v, Column) else F.lit(v) for k, v in (variables or {}).items() if isinstance(v, (Column, str, int, float, bool, type(None)))}
    return Scope(fields={c: F.col(f"`{c}`") for c in df.columns}, value=alone, vars=given, probe=probe_of(df))


def _steps(p: Plan, steps: list, x: Context) -> Plan:
    i = 0
    while i < len(steps):
        if steps[i][0] == "def":
            _, name, params, body, rest = steps[i]
            steps, i, x = [*steps_of(rest), *steps[i + 1 :]], 0, replace(x, defs=(*x.defs, (name, params, body)))
            continue
        if steps[i][0] == "call" and (found := _inlined(steps[i], x.defs)) is not None:
            steps = [*steps[:i], *steps_of(found), *steps[i + 1 :]]
            continue
        if p.array:
            p, used, x = _array_step(p, steps, i, x)
            i += used
            continue
        try:
            p, used = _stream_step(p, steps, i, x)
        except (NotLowered, PySparkException, KeyError, IndexError, TypeError, AttributeError) as e:
            if not x.fallback:
                raise e if isinstance(e, NotLowered) else NotLowered(str(e)) from None
            return _dynamic(p, steps[i:], x)
        i += used
    return p


def _inlined(t, defs):
    """The body of a defined function with its filter parameters in place, or None: built in, or calling itself."""
    for k in range(len(defs) - 1, -1, -1):
        name, params, body = defs[k]
        if (name, len(params)) == (t[1], len(t[2])):
            if any(p.startswith("$") for p in params) or _calls(body, name, len(params)):
                return None
            return _replaced(body, {p: a for p, a in zip(params, t[2], strict=True)})
    return None


def _calls(t, name, n) -> bool:
    return isinstance(t, tuple) and ((t[:2] == ("call", name) and len(t[2]) == n) or any(_calls(y, name, n) for y in t))


def _replaced(t, given):
    if not isinstance(t, tuple):
        return t
    if t[:1] == ("call",) and not t[2] and t[1] in given:
        return given[t[1]]
    return tuple(_replaced(y, given) for y in t)


def _dynamic(p: Plan, steps: list, x: Context) -> Plan:
    """The rest of a stream in the dynamic tier."""
    if any(isinstance(v, Column) for v in x.variables.values()):
        raise NotLowered("a variable of the row before a step of the dynamic tier")
    tree = joined(steps)
    for name, params, body in reversed(x.defs):
        tree = ("def", name, params, body, tree)
    df = p.df.select(F.col("value").alias("value")) if p.df.columns == ["value"] else p.df
    out = apply_rows(df, ("headed", x.head, tree) if x.head.strip() else tree, variables=x.variables, modules=x.modules).select(F.col("output").alias("value"))
    if x.schema:
        out = out.select(F.from_json("value", x.schema).alias("r")).select("r.*")
    return Plan(out, False)


# the array --------------------------------------------------------------------------------------------------------


def _array_step(p: Plan, steps: list, i: int, x: Context) -> tuple[Plan, int, Context]:
    t, df, s = steps[i], p.df, scope_of(p.df, x.variables)
    kind = t[0]
    if t == HERE:
        return p, 1, x
    if t == ROWS:
        return p.stream(), 1, x
    if kind == "array" and t[1] is not None:
        inner = _steps(p, steps_of(t[1]), x)
        if inner.array:
            raise NotLowered("an array of the whole table")
        return replace(inner, array=True), 1, x
    if kind == "slice" and t[1] == HERE:
        return _cut(p, _number(t[2], 0), _number(t[3], None)), 1, x
    if kind == "index" and t[1] == HERE:
        return _nth(p, _number(t[2], None)), 1, x
    if kind == "binary" and t[1] in "+-" and t[3][0] == "var" and t[3][1] in x.tables:
        other = x.tables[t[3][1]]
        if t[2] != HERE:
            raise NotLowered("a table made from another")
        if t[1] == "+":
            return Plan(df.unionByName(other)), 1, x
        on = [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in df.columns]
        return replace(p, df=df.alias("l").join(other.alias("r"), on, "left_anti")), 1, x
    if kind == "reduce" and t[1] == ROWS and len(t[2]) == 1 and t[2][0][0] == "var":
        return Plan(_reduce(df, t[2][0][1], t[3], t[4], s), False), 1, x
    if kind == "foreach" and t[1] == ROWS and len(t[2]) == 1 and t[2][0][0] == "var":
        return _foreach(p, t, x), 1, x
    if kind == "bind" and len(t[2]) == 1 and t[2][0][0] == "var":
        name, source = t[2][0][1], t[1]
        if source[0] == "call" and source[1] == "INDEX":
            found = replace(x, indices={**x.indices, name: source})
        else:
            found = replace(x, variables={**x.variables, name: _single_value(p, source, x)})
        return _steps(p, steps_of(t[3]), found), 1, x
    if kind == "call":
        out, used = _array_call(p, t, steps, i, x, s)
        return out, used, x
    if kind == "try" and t[2] is None:
        return _steps(p, steps_of(t[1]), x), 1, x
    raise NotLowered(f"{kind} of a whole table")


def _single_value(p: Plan, source, x: Context):
    """A value of the whole table, as a scalar subquery of the plan: nothing is collected."""
    made = _steps(p, steps_of(source), x)
    if made.array or made.df.columns != ["value"]:
        raise NotLowered("a variable that is no single value")
    return made.df.select(F.col("value")).scalar()


def _number(t, otherwise):
    if t is None:
        return otherwise
    if t[0] == "literal" and type(t[1]) is int:
        return t[1]
    if t[0] == "neg" and t[1][0] == "literal":
        return -t[1][1]
    raise NotLowered("a position that is no whole number")


def _keys(args):
    flat = lambda t: [*flat(t[1]), *flat(t[2])] if t[0] == "comma" else [t]
    out = []
    for a in args:
        out += flat(a[1] if a[0] == "array" and a[1] is not None else a)
    return out


def _order(args, s) -> list[Column]:
    """sort_by keys: a negated key sorts the other way; nulls come first, as null is the least value."""
    return [compile_column(k[1], s).desc_nulls_last() if k[0] == "neg" else compile_column(k, s).asc_nulls_first() for k in _keys(args)]


def _directions(args, s):
    """(column, descending) of sort keys."""
    return tuple((compile_column(k[1] if k[0] == "neg" else k, s), k[0] == "neg") for k in _keys(args))


def _sort_columns(order, flip=False) -> list[Column]:
    return [c.desc_nulls_last() if down != flip else c.asc_nulls_first() for c, down in order]


def _backed(p: Plan) -> tuple:
    """The plan's order, or that of all its columns."""
    return p.order or tuple((F.col(f"`{c}`"), False) for c in p.df.columns)


def _limit(p: Plan, n: int) -> Plan:
    """The first rows, kept in order."""
    return replace(p, df=p.df.limit(n))


def _cut(p: Plan, low: int, high: int | None) -> Plan:
    """Rows [low, high), as a slice does; negative ends count from the last row."""
    if low >= 0 and (high is None or high >= 0):
        if high is not None and low == 0:
            return _limit(p, high)
        if high is not None:
            return replace(p, df=p.df.limit(high).offset(low)) if high > low else _limit(p, 0)
        made = ranked(p).where(F.col("_rank") >= low)
        return replace(p, df=(made.orderBy("_rank") if p.order else made).drop("_rank"))
    if not p.order:
        raise NotLowered("the end of an unsorted table: sort it first")
    if low < 0 and high is None:
        last = p.df.orderBy(*_sort_columns(p.order, flip=True)).limit(-low)
        return replace(p, df=last.orderBy(*_sort_columns(p.order)))
    counted = ranked(p).crossJoin(F.broadcast(p.df.agg(F.count("*").alias("_n"))))  # one row
    at = lambda k: F.lit(k) if k >= 0 else F.col("_n") + k
    test = F.col("_rank") >= at(low)
    return replace(p, df=counted.where(test if high is None else test & (F.col("_rank") < at(high))).orderBy("_rank").drop("_rank", "_n"))


def _nth(p: Plan, k: int) -> Plan:
    if k >= 0:
        return p.stream(p.df.limit(k + 1).offset(k))
    if not p.order:
        raise NotLowered("the last row of an unsorted table: sort it first")
    return p.stream(p.df.orderBy(*_sort_columns(p.order, flip=True)).limit(-k).offset(-k - 1))


def ranked(p: Plan) -> DataFrame:
    """The rows with ``_rank``, their place from 0.  Ranges are sorted by themselves; only their sizes come together."""
    return _by_range(p, F.count(F.lit(1)), lambda w: F.row_number().over(w) - 1, "_rank").drop("_at")


def _by_range(p: Plan, whole: Column, within, name: str) -> DataFrame:
    """A running value: ``whole`` of each earlier range added to ``within(window)`` of a row's own range.  The rows come
    in no order; of a sorted table, ``_at`` is their place in it.

    Sizes and rows are two readings of the table, so a row's range must be the same in both: of a sorted table it is
    found from its keys alone.
    """
    if p.order:
        keys = _sort_columns(p.order)
        dealt = p.df.withColumn("_pid", _range_of(p))
    else:
        keys = [F.col("_mid")]
        dealt = p.df.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    sizes = dealt.groupBy("_pid").agg(whole.alias("_w"))
    before = sizes.select("_pid", F.coalesce(F.sum("_w").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    window = Window.partitionBy("_pid").orderBy(*keys)
    own = dealt.withColumn("_own", within(window)).withColumn("_at", F.struct("_pid", F.row_number().over(window).alias("n")))
    made = own.join(F.broadcast(before), "_pid").withColumn(name, F.col("_b") + F.col("_own"))  # one row for each range
    return made.drop("_pid", "_b", "_own", "_mid")


#: Rows looked at for each bound between ranges.
SAMPLED = 20


def _range_of(p: Plan) -> Column:
    """The number of a row's range in the table's order.  The bounds are constants of the plan: keys of a bounded sample,
    which only decides how even the ranges are.  Keys after one that is no plain value are left out of them."""
    order = []
    for c, down in p.order:
        kind = probe_of(p.df)(c)
        name = kind.typeName() if kind is not None else ""
        if name == "timestamp":  # no zone's clock in between
            c = F.unix_micros(c)
        elif name not in ("long", "integer", "short", "byte", "double", "float", "decimal", "string", "boolean", "date"):
            break
        order.append((c, down))
    if not order:
        return F.lit(0)
    ranges = int(p.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = [(F.col(f"_k{i}"), down) for i, (_, down) in enumerate(order)]
    sample = p.df.select(*(c.alias(f"_k{i}") for i, (c, _) in enumerate(order)), F.rand(0).alias("_r")).orderBy("_r").limit(SAMPLED * ranges).drop("_r")
    found = [tuple(r) for r in sample.orderBy(*_sort_columns(named)).collect()][SAMPLED::SAMPLED]
    bounds = [b for i, b in enumerate(found) if not i or b != found[i - 1]]

    def after(bound) -> Column:
        """Whether a row comes after a bound: null is the least value."""
        test = F.lit(False)
        for (c, down), v in reversed([*zip(order, bound, strict=True)]):
            past = (F.lit(False) if v is None else c.isNull() | (c < F.lit(v))) if down else (c.isNotNull() if v is None else c > F.lit(v))
            test = F.coalesce(past, F.lit(False)) | (c.eqNullSafe(F.lit(v)) & test)
        return test

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(after(bounds[mid]), search(mid + 1, high)).otherwise(search(low, mid))

    return search(0, len(bounds))


def _unique_by(p: Plan, keys: list[Column]) -> Plan:
    """The first row of each key, found by a partial aggregation, not a window."""
    whole = F.struct(*(F.col(f"`{c}`") for c in p.df.columns))
    first = F.min(whole) if not p.order else F.min_by(whole, _rank_key(p.order))
    made = p.df.groupBy(*(k.alias(f"_k{i}") for i, k in enumerate(keys))).agg(first.alias("_r")).select("_r.*")
    return Plan(made)


def _rank_key(order) -> Column:
    """An order as one comparable column; descending keys must be numbers."""
    return F.struct(*((-c if down else c) for c, down in order))


def _array_call(p: Plan, t, steps, i, x: Context, s) -> tuple[Plan, int]:
    _, name, args = t
    n, df = len(args), p.df
    if name == "map" and n == 1:
        return replace(_steps(p.stream(), steps_of(args[0]), x), array=True), 1
    if name in ("sort", "sort_by"):
        order = _directions(args, s) if n else tuple((F.col(f"`{c}`"), False) for c in df.columns)
        return replace(p, df=df.orderBy(*_sort_columns(order)), order=order), 1
    if name == "reverse" and n == 0:
        if not p.order:
            raise NotLowered("reverse of an unordered table: sort it first")
        return replace(p, df=df.orderBy(*_sort_columns(p.order, flip=True)), order=tuple((c, not down) for c, down in p.order)), 1
    if name in ("limit", "skip", "first", "last", "nth", "isempty") and n and (name, n) != ("nth", 1):
        k = _number(args[0], None) if n == 2 else None
        inner = args[-1]
        past = _number(inner[2][0], None) if name == "limit" and inner[:2] == ("call", "skip") and len(inner[2]) == 2 and k >= 0 else -1
        source = _steps(p, steps_of(inner[2][1] if past >= 0 else inner), x)
        if source.array:
            raise NotLowered(f"{name} of one array")
        rows = replace(source, array=True)
        if name == "isempty":
            return Plan(source.df.limit(1).agg((F.count("*") == 0).alias("value")), False), 1
        if past >= 0:  # limit(k; skip(n; f)) is the slice [n, n + k)
            return replace(_cut(rows, past, past + k), array=False), 1
        made = {
            "limit": lambda: _limit(rows, k), "skip": lambda: _cut(rows, k, None), "first": lambda: _limit(rows, 1), "last": lambda: _nth(rows, -1), "nth": lambda: _nth(rows, k),
        }[name]()
        return replace(made, array=False), 1
    if name in ("first", "last"):
        return _nth(p, 0 if name == "first" else -1), 1
    if name == "nth":
        return _nth(p, _number(args[0], None)), 1
    if name == "unique":
        return Plan(df.distinct()), 1
    if name == "unique_by":
        return _unique_by(p, [compile_column(k, s) for k in _keys(args)]), 1
    if name in ("min_by", "max_by"):
        keys = [compile_column(k, s) for k in _keys(args)]
        order = [k.desc_nulls_last() if name == "max_by" else k.asc_nulls_first() for k in keys]
        return p.stream(df.orderBy(*order, *_sort_columns(_backed(p), flip=name == "max_by" and bool(p.order))).limit(1)), 1
    if name == "group_by":
        if i + 1 < len(steps) and steps[i + 1][:2] == ("call", "map"):
            return Plan(_group(p, args, steps[i + 1][2][0], s)), 2
        return Plan(_group(p, args, HERE, s)), 1
    if name in ("length", "add", "min", "max", "any", "all"):
        return Plan(_whole(name, p, args, s, x), False), 1
    if name == "JOIN" and n in (3, 4) and args[1] == ROWS:
        return Plan(_lookup_rows(df, args, s, x), False), 1
    if name in ("join_left", "join_inner", "join_semi", "join_anti") and n == 3:
        # join_x($table; key of this; key of that)
        other = x.tables[args[0][1]]
        left, right = compile_column(args[1], s), compile_column(args[2], scope_of(other))
        how = {"join_left": "left", "join_inner": "inner", "join_semi": "left_semi", "join_anti": "left_anti"}[name]
        return Plan(df.join(other, left.eqNullSafe(right) if how in ("left_semi", "left_anti") else left == right, how)), 1
    if name == "running" and n == 4:
        # running(name; group key; order key; value): foreach's running total within a group
        w = Window.partitionBy(compile_column(args[1], s)).orderBy(*_order([args[2]], s)).rowsBetween(Window.unboundedPreceding, 0)
        return Plan(df.withColumn(args[0][1], F.sum(compile_column(args[3], s)).over(w))), 1
    if name == "top_per" and n == 3:
        w = Window.partitionBy(compile_column(args[1], s)).orderBy(*_order([args[2]], s))
        return Plan(df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= args[0][1]).drop("_rank")), 1
    raise NotLowered(f"{name}/{n} of a whole table")


def _whole(name, p: Plan, args, s, x: Context) -> DataFrame:
    df = p.df
    if name == "length":
        return df.agg(F.count("*").alias("value"))
    if name in ("any", "all"):
        if len(args) == 2:
            made = _steps(p, steps_of(args[0]), x)
            df, s = made.df, scope_of(made.df, x.variables)
        test = F.coalesce(truth(args[-1] if args else HERE, s), F.lit(False))
        return df.agg(F.coalesce((F.bool_or if name == "any" else F.bool_and)(test), F.lit(name == "all")).alias("value"))
    if args:  # add(.[] | f)
        df = _steps(p, steps_of(args[0]), x).df
    if df.columns != ["value"]:
        if name == "add":
            raise NotLowered("add of objects: add one field")
        rows = F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns)))  # objects compare by their sorted keys
        return df.agg((F.min if name == "min" else F.max)(rows).alias("r")).select(*(F.col(f"r.`{c}`") for c in df.columns))
    value = F.col("value")
    kind = scope_of(df).type_of(value)
    if name == "add" and kind != "number":
        raise NotLowered(f"add of {kind} over a table")
    if name == "min":  # null is the least value
        return df.agg(F.when(F.count(F.when(value.isNull(), 1)) == 0, F.min(value)).alias("value"))
    return df.agg((F.sum if name == "add" else F.max)(value).alias("value"))


# groups -----------------------------------------------------------------------------------------------------------


def _group(p: Plan, keys_, body, s) -> DataFrame:
    """group_by(k) | map(body).  Groups are not sorted: a table has no order until it is."""
    keys = _keys(keys_)
    columns = [compile_column(k, s) for k in keys]
    entries = [(_name(k), v) for k, v in body[1]] if body[0] == "object" else [("value", body)]
    out = [(name, _aggregate(v, p, s, keys)) for name, v in entries]
    many = [a for _, a in out if isinstance(a, _Distinct)]
    if many and len(out) > 1 and len({id(a) for a in many}) == 1 and all(isinstance(a, (int, _Distinct, Column)) for _, a in out):
        return _distinct_group(p.df, columns, out)
    plain = [(n, F.count_distinct(a.value) if isinstance(a, _Distinct) else a) for n, a in out]
    made = p.df.groupBy(*(c.alias(f"_k{i}") for i, c in enumerate(columns))).agg(*(a.alias(n) for n, a in plain if not isinstance(a, int)), F.count(F.lit(1)).alias("_n"))
    return made.select(*(F.col(f"_k{a}").alias(n) if isinstance(a, int) else F.col(f"`{n}`") for n, a in plain))


class _Distinct:
    """The number of different values of a column."""

    def __init__(self, value: Column):
        self.value = value


def _distinct_group(df, columns, out) -> DataFrame:
    """The other aggregates beside one distinct count: the count by a grouping of its own, so that no row is doubled."""
    keys = [c.alias(f"_k{i}") for i, c in enumerate(columns)]
    names = [f"_k{i}" for i in range(len(columns))]
    value = next(a.value for _, a in out if isinstance(a, _Distinct))
    pairs = df.select(*keys, value.alias("_v")).groupBy(*names, "_v").agg(F.lit(1).alias("_one"))
    counts = pairs.where("_v is not null").groupBy(*names).agg(F.count("*").alias("_d"))
    nulls = [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names]
    rest = df.groupBy(*keys).agg(*(a.alias(n) for n, a in out if isinstance(a, Column)), F.count(F.lit(1)).alias("_n"))
    both = rest.alias("a").join(counts.alias("b"), nulls, "left")
    return both.select(*((F.col(f"a._k{a}") if isinstance(a, int) else F.coalesce("b._d", F.lit(0)) if isinstance(a, _Distinct) else F.col(f"a.`{n}`")).alias(n) for n, a in out))


def _name(k) -> str:
    if k[0] != "literal":
        raise NotLowered("a computed key")
    return k[1]


def _aggregate(t, p: Plan, s, keys):
    """An expression over a group's array as an aggregate, or the number of the key that it is."""
    first = ("index", HERE, ("literal", 0))
    for i, k in enumerate(keys):
        if t == _under(k, first):
            return i
    if t == ("call", "length", ()):
        return F.count(F.lit(1))
    if t == HERE:
        return F.sort_array(F.collect_list(compile_column(HERE, s)))
    if t[0] == "binary":
        parts = [_aggregate(y, p, s, keys) for y in t[2:4]]
        if not all(isinstance(y, Column) for y in parts):
            raise NotLowered("a group expression")
        return {"+": lambda a, b: F.coalesce(a + b, a, b), "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b}[t[1]](*parts)
    if t[0] == "literal":
        return F.lit(t[1])
    if t[0] == "pipe":
        return _aggregate_chain(steps_of(t), s)
    if t[0] == "field" and t[1][0] == "call" and t[1][1] in ("min_by", "max_by"):
        field = compile_column(("field", HERE, t[2]), s)
        key = compile_column(t[1][2][0], s)
        if p.order:
            key = F.struct(key, _rank_key(p.order))
        return (F.min_by if t[1][1] == "min_by" else F.max_by)(field, key)
    raise NotLowered("a group expression")


def _aggregate_chain(parts, s):
    """map(..) | add and the like, within a group."""
    head, tail = parts[0], parts[1:]
    if head[:2] != ("call", "map"):
        raise NotLowered("a group expression")
    value, where = None, None
    for step in steps_of(head[2][0]):
        if step[:2] == ("call", "select") and value is None:
            test = F.coalesce(truth(step[2][0], s), F.lit(False))
            where = test if where is None else where & test
        elif value is None:
            value = compile_column(step, s)
        else:
            raise NotLowered("a group expression")
    kept = lambda c: c if where is None else F.when(where, c)
    name = tail[0][1] if tail and tail[0][0] == "call" else None
    if value is None and not (name == "length" and len(tail) == 1):
        raise NotLowered("a group expression")
    rows = F.count(kept(F.lit(1)))
    if tail == [("binary", "/", ("call", "add", ()), ("call", "length", ()))]:
        return F.sum(kept(value)) / rows  # null is no addend but an element
    if len(tail) == 2 and name == "unique" and tail[1] == ("call", "length", ()) and where is None:
        return _Distinct(value)
    if len(tail) != 1:
        raise NotLowered("a group expression")
    if name == "length":
        return rows
    if name == "min":  # null is the least value
        return F.when(F.count(kept(F.when(value.isNull(), 1))) == 0, F.min(kept(value)))
    if name in ("any", "all"):
        return F.coalesce((F.bool_or if name == "any" else F.bool_and)(kept(F.coalesce(value, F.lit(False)))), F.lit(name == "all"))
    if name in ("add", "max", "sort", "unique"):
        return {"add": F.sum, "max": F.max, "sort": lambda v: F.sort_array(F.collect_list(v)), "unique": lambda v: F.sort_array(F.collect_set(v))}[name](kept(value))
    raise NotLowered("a group expression")


def _under(k, base):
    """The key expression with ``base`` in place of the input."""
    if k == HERE:
        return base
    return tuple(_under(y, base) if isinstance(y, tuple) and y and isinstance(y[0], str) else y for y in k)


# folds ------------------------------------------------------------------------------------------------------------


def _addend(t, s) -> Column | None:
    """What one step of a fold adds to its state, for updates that only add; None where the state is not just added to."""
    if t == HERE:
        return F.lit(0)
    if t[0] == "binary" and t[1] in "+-" and not _reads_state(t[3]):
        left = _addend(t[2], s)
        right = compile_column(t[3], s)
        return None if left is None else left + F.coalesce(right, F.lit(0)) if t[1] == "+" else left - right
    if t[0] == "binary" and t[1] == "+" and not _reads_state(t[2]):
        right = _addend(t[3], s)
        return None if right is None else right + F.coalesce(compile_column(t[2], s), F.lit(0))
    if t[0] == "if" and not _reads_state(t[1]):
        yes, no = _addend(t[2], s), _addend(t[3], s)
        return None if yes is None or no is None else F.when(truth(t[1], s), yes).otherwise(no)
    if t[0] == "bind" and len(t[2]) == 1 and t[2][0][0] == "var" and not _reads_state(t[1]):
        return _addend(t[3], replace(s, vars={**s.vars, t[2][0][1]: compile_column(t[1], s)}))
    return None


def _reads_state(t) -> bool:
    """Whether an expression may read its input."""
    kind = t[0]
    if kind in ("literal", "var"):
        return False
    if kind == "pipe":
        return _reads_state(t[1])
    if kind in ("binary", "compare", "logic"):
        return _reads_state(t[2]) or _reads_state(t[3])
    if kind in ("field", "index", "alt"):
        return _reads_state(t[1]) or _reads_state(t[2])
    if kind == "if":
        return any(_reads_state(y) for y in t[1:4])
    if kind == "neg":
        return _reads_state(t[1])
    return True


def _reduce(df: DataFrame, var: str, start, update, s: Scope) -> DataFrame:
    """reduce .[] as $r (start; update) where the update adds to the state, or keeps the greatest or least."""
    row = s.value if s.value is not None else F.struct(*(c.alias(n) for n, c in s.fields.items()))
    inner = replace(s, fields=None, value=None, vars={**s.vars, var: row})
    addend = _addend(update, inner)
    if start[0] not in ("literal", "neg"):
        raise NotLowered("a fold that does not start with a constant")
    first = -start[1][1] if start[0] == "neg" else start[1]
    if addend is not None:
        total = F.sum(addend)
        return df.agg((F.coalesce(total, F.lit(0)) + F.lit(first) if first is not None else total).alias("value"))
    if update[0] == "if" and update[1][0] == "compare" and update[3] == HERE and not _reads_state(update[2]):
        _, op, a, b = update[1]
        if (a, b) in ((update[2], HERE), (HERE, update[2])) and op in "<>":
            greatest = (op == ">") == (b == HERE)
            value = compile_column(update[2], inner)
            best = (F.max if greatest else F.min)(value)
            return df.agg((best if first is None else (F.greatest if greatest else F.least)(best, F.lit(first))).alias("value"))
    raise NotLowered("this fold is neither a sum nor an extreme")


def _foreach(p: Plan, t, x: Context) -> Plan:
    """foreach .[] as $r (start; . + f($r); extract) over a sorted table: running sums, range by range."""
    if not p.order or t[3][0] != "literal":
        raise NotLowered("foreach over an unsorted table: sort it first")
    s = scope_of(p.df, x.variables)
    row = F.struct(*(F.col(f"`{c}`") for c in p.df.columns)) if s.value is None else s.value
    inner = replace(s, fields=None, value=None, vars={**s.vars, t[2][0][1]: row})
    addend = _addend(t[4], inner)
    if addend is None:
        raise NotLowered("this fold is no sum")
    made = _by_range(p, F.sum(addend), lambda w: F.sum(addend).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_state").orderBy("_at")
    state = F.col("_state") + F.lit(t[3][1])
    out = compile_column(t[5], replace(inner, value=state)) if len(t) > 5 else state
    return Plan(made.select(out.alias("value")) if len(t) <= 5 or t[5][0] != "object" else made.select(*(compile_column(v, replace(inner, value=state)).alias(_name(k)) for k, v in t[5][1])), False)


def _of_null(spark: SparkSession, tree, x: Context) -> DataFrame:
    """A program on null: a range of numbers is a table of them, and folds over one are aggregates."""
    steps = steps_of(tree)
    head = steps[0]
    if head[:2] == ("call", "range") and len(head[2]) in (1, 2):
        ends = [_number(a, None) for a in head[2]]
        return _steps(Plan(spark.range(*ends).select(F.col("id").alias("value")), False), steps[1:], x).df
    if head[0] == "array" and head[1] is not None and steps_of(head[1])[0][:2] == ("call", "range"):
        return _steps(Plan(_of_null(spark, head[1], x)), steps[1:], x).df
    if head[0] == "reduce" and head[1][:2] == ("call", "range") and len(head[1][2]) in (1, 2):
        numbers = _of_null(spark, head[1], x)
        return _steps(Plan(_reduce(numbers, head[2][0][1], head[3], head[4], scope_of(numbers, x.variables)), False), steps[1:], x).df
    return _steps(Plan(spark.range(1).select(F.lit(None).cast("string").alias("value")), False), steps, x).df


# the stream -------------------------------------------------------------------------------------------------------


def _stream_step(p: Plan, steps: list, i: int, x: Context) -> tuple[Plan, int]:
    t, df, s = steps[i], p.df, scope_of(p.df, x.variables)
    kind = t[0]
    if t == HERE:
        return p, 1
    if kind == "object":
        if any(_lookup_in(v, x) for _, v in t[1]):
            return Plan(_looked_up(df, t, s, x), False), 1
        return _projected(p, df.select(*(compile_column(v, s).alias(_name(k)) for k, v in t[1])), t), 1
    if kind == "call" and t[1] == "select" and len(t[2]) == 1:
        return replace(p, df=_selected(df, t[2][0], s, x)), 1
    if kind == "call" and t[1] in ("nulls", "values") and not t[2]:
        here = compile_column(HERE, s)
        return replace(p, df=df.where(here.isNull() if t[1] == "nulls" else here.isNotNull())), 1
    if kind == "call" and t[1] in ("del", "pick") and len(t[2]) == 1:
        names = [_field(k) for k in _keys(t[2])]
        return replace(p, df=df.drop(*names) if t[1] == "del" else df.select(*names)), 1
    if kind == "assign":
        return replace(p, df=_assign(df, t, s)), 1
    if kind == "bind" and len(t[2]) == 1 and t[2][0][0] == "var":
        if p.df.columns == ["value"]:
            raise NotLowered("a variable of plain values")
        inner = replace(x, variables={**x.variables, t[2][0][1]: compile_column(t[1], s)}, fallback=False)
        return _steps(p, steps_of(t[3]), inner), 1
    if kind in ("iterate", "comma") or (kind == "call" and t[1] in ("range", "scan", "limit", "splits", "empty")):
        return Plan(df.select(F.explode(compile_many(t, s)).alias("value")), False), 1
    if kind == "try" and t[2] is None and t[1] == ROWS:
        raise NotLowered("an optional step")
    return Plan(df.select(compile_column(t, s).alias("value")), False, ()), 1


def _projected(p: Plan, df: DataFrame, t) -> Plan:
    """A projection keeps the order only if every sort key is still there under its own name."""
    kept = {_name(k) for k, v in t[1] if v == ("field", HERE, k)}
    return Plan(df, p.array, p.order if p.order and {str(c._jc.toString()) for c, _ in p.order} <= kept else ())


def _field(t) -> str:
    if t[0] == "field" and t[1] == HERE and t[2][0] == "literal":
        return t[2][1]
    raise NotLowered("not a plain field")


def _assign(df, t, s) -> DataFrame:
    _, op, left, right = t
    name = _field(left)
    old = s.fields.get(name)
    field = ("field", HERE, ("literal", name))
    if op == "|=":
        if old is None:
            raise NotLowered("an update of a new field")
        return df.withColumn(name, compile_column(right, s.at(old)))
    if op == "=":
        return df.withColumn(name, compile_column(right, s))
    if old is None:
        raise NotLowered("an update of a new field")
    tree = ("alt", field, right) if op == "//=" else ("binary", op[0], field, right)
    return df.withColumn(name, compile_column(tree, s))


# lookups ----------------------------------------------------------------------------------------------------------


def _table_stream(t, x: Context) -> DataFrame | None:
    """The one column that ``$table[] | f`` or ``$table[].f`` gives, as ``_in``; None for other filters."""
    steps = []
    node = t
    while node[0] in ("field", "pipe"):
        if node[0] == "pipe":
            steps = [*steps_of(node[2]), *steps]
            node = node[1]
        else:
            steps = [("field", HERE, node[2]), *steps]
            node = node[1]
    if node[0] == "iterate" and node[1][0] == "var" and node[1][1] in x.tables:
        made = _steps(Plan(x.tables[node[1][1]], False), steps, replace(x, fallback=False)).df if steps else x.tables[node[1][1]]
        return made.select(F.col(f"`{made.columns[0]}`").alias("_in")) if len(made.columns) == 1 else None
    return None


def _selected(df, test, s, x: Context) -> DataFrame:
    """select(test); ``key | IN($table[] | f)`` is a semi-join, and with ``| not`` an anti-join."""
    parts = steps_of(test)
    negated = parts[-1] == ("call", "not", ())
    core = parts[:-1] if negated else parts
    if core and core[-1][:2] == ("call", "IN") and len(core[-1][2]) == 1:
        known = _table_stream(core[-1][2][0], x)
        if known is not None:
            key = compile_column(joined(core[:-1]), s) if core[:-1] else compile_column(HERE, s)
            known = known.distinct()
            return df.join(known, key.eqNullSafe(known["_in"]), "left_anti" if negated else "left_semi")
    return df.where(truth(test, s))


def _indexed(t, x: Context) -> tuple[DataFrame, Column]:
    """The rows of INDEX($table[]; key) with the text of their key, one row for each: of equal keys the greatest."""
    stream, key = t[2] if len(t[2]) == 2 else (None, None)
    if stream is None or stream[0] != "iterate" or stream[1][0] != "var" or stream[1][1] not in x.tables:
        raise NotLowered("an index of something else than a table")
    other = x.tables[stream[1][1]]
    s = scope_of(other)
    text = compile_column(("pipe", key, ("call", "tostring", ())), s)
    return other.groupBy(text.alias("_key")).agg(F.max(F.struct(*(F.col(f"`{c}`") for c in other.columns))).alias("_row"))


def _lookup_rows(df, args, s, x: Context) -> DataFrame:
    """JOIN($index; .[]; key; f): each row with what the index has under its key (null: nothing)."""
    index = args[0] if args[0][0] == "call" else x.indices[args[0][1]]
    made = _indexed(index, x)
    key = compile_column(args[2], s)
    rows = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    both = df.select(key.alias("_k"), rows.alias("_left")).join(made, F.col("_k") == F.col("_key"), "left")
    pair = Scope(vars=s.vars, probe=probe_of(both), pair=(F.col("_left"), F.col("_row")))
    body = args[3] if len(args) == 4 else None
    if body is None:
        return both.select(F.col("_left").alias("row"), F.col("_row").alias("match"))
    if body[0] == "object":
        return both.select(*(compile_column(v, pair).alias(_name(k)) for k, v in body[1]))
    return both.select(compile_column(body, pair).alias("value"))


def _lookup_in(t, x: Context):
    """``$index[key]`` within an expression: (variable, key), or None."""
    if not isinstance(t, tuple):
        return None
    if t[:1] == ("index",) and t[1][:1] == ("var",) and t[1][1] in (x.indices or {}):
        return t[1][1], t[2]
    return next((found for y in t if (found := _lookup_in(y, x))), None)


def _looked_up(df, t, s, x: Context) -> DataFrame:
    """{.., name: $index[key].field}: one left join for each lookup."""
    entries, n, looked = list(t[1]), 0, {}
    while found := next((f for _, v in entries if (f := _lookup_in(v, x))), None):
        name, key = found
        made = _indexed(x.indices[name], x).select(F.col("_key").alias(f"_key{n}"), F.col("_row").alias(f"_row{n}"))
        df = df.join(made, compile_column(key, s) == F.col(f"_key{n}"), "left")
        looked[f"*{n}"] = F.col(f"_row{n}")
        entries = [(k, _swapped(v, ("index", ("var", name), key), ("var", f"*{n}"))) for k, v in entries]
        n += 1
    s = replace(s, probe=probe_of(df), vars={**s.vars, **looked})
    return df.select(*(compile_column(v, s).alias(_name(k)) for k, v in entries))


def _swapped(t, old, new):
    if t == old:
        return new
    return tuple(_swapped(y, old, new) if isinstance(y, tuple) else y for y in t) if isinstance(t, tuple) else t
