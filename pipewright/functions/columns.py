"""Filter expressions lowered to Columns: the static tier, all inside Catalyst.

``compile_column(tree, scope)`` gives the one value an expression has for a row; ``compile_many`` gives an array column
for expressions with any number of outputs.  What has no lowering raises ``NotLowered`` and is left to the dynamic tier.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


class NotLowered(Exception):
    """The expression needs the dynamic tier."""


@dataclass(frozen=True)
class Scope:
    """Where names lead: the input value (a row's fields or a column) and the variables."""

    fields: dict[str, Column] | None = None
    value: Column | None = None
    vars: dict[str, Column] = field(default_factory=dict)
    #: the type of a column as Spark's analyser finds it; None where it cannot (lambda variables)
    probe: Callable[[Column], object] | None = None
    #: the two columns of a pair [row, what it is joined with]
    pair: tuple[Column, Column] | None = None
    value_is_lambda: bool = False

    def at(self, value: Column) -> Scope:
        return replace(self, fields=None, value=value, pair=None)

    def inside(self, item: Column, source: Column | None = None) -> Scope:
        """The scope of a function over the elements of ``source``."""
        whole = self.probe(source) if self.probe and source is not None else None
        kind = whole.elementType if whole is not None and whole.typeName() == "array" else None
        return replace(self, fields=None, value=item, pair=None, value_is_lambda=True, probe=lambda c: kind if c is item else None)

    def type_of(self, c: Column) -> str:
        """string, array, map, struct, number, boolean or "" where it is not known."""
        found = self.probe(c) if self.probe else None
        name = found.typeName() if found is not None else ""
        return "number" if name in ("long", "integer", "short", "byte", "double", "float", "decimal") else name


def probe_of(df) -> Callable[[Column], object]:
    from pyspark.errors import PySparkException

    def probe(c: Column):
        try:
            return df.select(c).schema[0].dataType
        except PySparkException:
            return None

    return probe


_ARITH: dict[str, Callable] = {
    "+": lambda a, b: F.coalesce(a + b, a, b),  # null is its identity
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: a / b,
    # the remainder of whole parts; its sign is the dividend's
    "%": lambda a, b: a.cast("long") % b.cast("long"),
}


def _test(op: str, t, s: Scope) -> Column:
    """A comparison for a filter: null is the least value, and what is not true may be null.  Plain where it can be, so
    that it reaches the scan."""
    a, b = compile_column(t[2], s), compile_column(t[3], s)
    if op in ("==", "!="):
        return a.eqNullSafe(b) if op == "==" else ~a.eqNullSafe(b)
    if op in (">", ">="):
        a, b, left, right = b, a, t[3], t[2]
    else:
        left, right = t[2], t[3]
    sure = [x[0] == "literal" and x[1] is not None for x in (left, right)]
    strict = op in ("<", ">")
    plain = a < b if strict else a <= b
    if sure[0]:  # a value is never below null
        return plain
    return plain | (a.isNull() if sure[1] or not strict else a.isNull() & b.isNotNull())


def truth(t, s: Scope) -> Column:
    """Whether a filter's output is true (neither null nor false), for a filter of rows: null stands for no."""
    if t[0] == "compare":
        return _test(t[1], t, s)
    if t[0] == "logic":
        a, b = truth(t[2], s), truth(t[3], s)
        return a & b if t[1] == "and" else a | b
    if t[0] == "literal":
        return F.lit(t[1] is not None and t[1] is not False)
    c = compile_column(t, s)
    if t[0] == "call" and t[1] in BOOLEAN:
        return c
    if t[0] == "pipe" and t[2][0] == "call" and t[2][1] in BOOLEAN:
        return c
    return _truthy(c)


def _truthy(c: Column) -> Column:
    """Of a column of any type: only a boolean can be false.  The type test is a constant of the plan."""
    return F.when(F.typeof(c) == F.lit("boolean"), F.coalesce(c.cast("string") == F.lit("true"), F.lit(False))).otherwise(c.isNotNull())


#: calls whose output is a boolean
BOOLEAN = {"not", "test", "startswith", "endswith", "contains", "has", "any", "all", "isnan", "isinfinite", "isnormal"}


def _text_op(name):
    return lambda c: getattr(F, name)(c)


def _format(name: str, c: Column) -> Column:
    if name == "@text":
        return c.cast("string")
    if name == "@html":
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c
    if name == "@uri":
        return F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    if name == "@urid":
        return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    if name == "@sh":
        return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    if name == "@base64":
        return F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"[\r\n]", "")
    if name == "@base64d":
        return F.decode(F.unbase64(c), "UTF-8")
    if name == "@hex":
        return F.lower(F.hex(F.encode(c, "UTF-8")))
    if name == "@json":
        return F.to_json(c)
    raise NotLowered(name)


def _log(f: Callable[[Column], Column], pole: float = 0.0) -> Callable[[Column], Column]:
    """A logarithm as the language has it, where Spark's is null: -infinity at the pole, NaN below."""
    return lambda c: F.when(c == pole, F.lit(float("-inf"))).when(c < pole, F.lit(float("nan"))).otherwise(f(c))


#: name -> column function of the input alone
UNARY: dict[str, Callable[[Column], Column]] = {
    "length": None, "not": lambda c: ~_truthy(c), "floor": F.floor, "ceil": F.ceil, "sqrt": F.sqrt, "abs": F.abs, "fabs": F.abs,
    "round": F.round, "exp": F.exp, "exp2": lambda c: F.pow(F.lit(2.0), c), "exp10": lambda c: F.pow(F.lit(10.0), c), "log": _log(F.log), "log2": _log(F.log2), "log10": _log(F.log10),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh,
    "cbrt": F.cbrt, "trunc": lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)), "rint": F.rint, "log1p": _log(F.log1p, -1.0), "expm1": F.expm1,
    "ascii_downcase": lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
    "ascii_upcase": lambda c: F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "utf8bytelength": F.octet_length, "tostring": lambda c: c.cast("string"), "tonumber": lambda c: c.cast("double"),
    "trim": lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), "ltrim": lambda c: F.regexp_replace(c, r"(?U)^\s+", ""), "rtrim": lambda c: F.regexp_replace(c, r"(?U)\s+$", ""),
    "sort": F.sort_array, "min": lambda c: F.when(~F.exists(c, lambda x: x.isNull()), F.array_min(c)), "max": F.array_max, "unique": lambda c: F.sort_array(F.array_distinct(c)), "reverse": F.reverse, "flatten": F.flatten,
    "keys": lambda c: F.sort_array(F.map_keys(c)), "to_entries": F.map_entries, "from_entries": F.map_from_entries, "tojson": F.to_json,
    "md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512),
    "mktime": F.unix_timestamp, "fromdate": lambda c: F.unix_timestamp(F.to_timestamp(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
    "todate": lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    "isnan": F.isnan, "null": lambda c: F.lit(None), "true": lambda c: F.lit(True), "false": lambda c: F.lit(False), "infinite": lambda c: F.lit(float("inf")), "nan": lambda c: F.lit(float("nan")),
    "first": lambda c: F.get(c, F.lit(0)), "last": lambda c: F.try_element_at(c, F.lit(-1)), "explode": lambda c: F.transform(F.split(c, ""), lambda x: F.ascii(x)),
    "add": None, "any": lambda c: F.exists(c, _truthy), "all": lambda c: F.forall(c, _truthy),
}

#: strftime letters as Java patterns
_DATE = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "y": "yy", "Z": "'UTC'"}


def java_pattern(fmt: str) -> str:
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%":
            if fmt[i + 1] not in _DATE:
                raise NotLowered(fmt)
            out += _DATE[fmt[i + 1]]
            i += 2
        else:
            out += f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]
            i += 1
    return out


def _literal_text(tree) -> str:
    if tree[0] == "literal" and isinstance(tree[1], str):
        return tree[1]
    raise NotLowered("an argument that is no literal string")


def compile_column(t, s: Scope) -> Column:
    kind = t[0]
    if kind == "identity":
        if s.pair is not None:
            return F.array(*s.pair)
        if s.value is None:
            return F.struct(*(c.alias(n) for n, c in s.fields.items()))
        return s.value
    if kind == "literal":
        return F.lit(t[1])
    if kind == "field":
        if t[2][0] != "literal":
            raise NotLowered("a computed field name")
        if t[1] == ("identity",) and s.fields is not None:
            if t[2][1] not in s.fields:
                raise NotLowered(f"no field {t[2][1]}")
            return s.fields[t[2][1]]
        base = compile_column(t[1], s)
        if s.type_of(base) == "variant":
            return F.variant_get(base, '$["' + t[2][1].replace('"', '\\"') + '"]', "variant")
        return base.getField(t[2][1])
    if kind == "index" and s.pair is not None and t[1] == ("identity",):
        return s.pair[t[2][1]] if t[2] in (("literal", 0), ("literal", 1)) else F.lit(None)
    if kind == "index":
        base, key = compile_column(t[1], s), t[2]
        if key[0] == "literal" and isinstance(key[1], str):
            return base.getField(key[1])
        if key[0] == "neg":
            return F.try_element_at(base, -compile_column(key[1], s))
        return F.get(base, compile_column(key, s))
    if kind == "slice":
        return _slice(t, s)
    if kind == "neg":
        return -compile_column(t[1], s)
    if kind == "binary":
        a, b = compile_column(t[2], s), compile_column(t[3], s)
        if t[1] == "+" and (any(_stringy(x) for x in (t[2], t[3])) or s.type_of(a) in ("string", "array")):
            return F.coalesce(F.concat(a, b), a, b)
        return _ARITH[t[1]](a, b)
    if kind == "compare":
        return F.coalesce(_test(t[1], t, s), F.lit(False))
    if kind == "logic":
        return F.coalesce(truth(t, s), F.lit(False))
    if kind == "alt":
        left = compile_column(t[1], s)
        return F.when(_truthy(left), left).otherwise(compile_column(t[2], s))
    if kind == "if":
        return F.when(truth(t[1], s), compile_column(t[2], s)).otherwise(compile_column(t[3], s))
    if kind == "pipe":
        return compile_column(t[2], s.at(compile_column(t[1], s)))
    if kind == "object":
        return F.struct(*(compile_column(v, s).alias(_literal_text(k)) for k, v in t[1]))
    if kind == "array":
        return F.array() if t[1] is None else compile_many(t[1], s)
    if kind == "string":
        parts = [F.lit(p) if isinstance(p, str) else _text(compile_column(p, s), s) for p in t[2]]
        if t[1] is not None:
            parts = [p if isinstance(q, str) else _format(t[1], p) for p, q in zip(parts, t[2], strict=True)]
        return F.concat(*parts)
    if kind == "format":
        return _format(t[1], compile_column(("identity",), s))
    if kind == "var":
        if t[1] not in s.vars:
            raise NotLowered(t[1])
        return s.vars[t[1]]
    if kind == "bind" and len(t[2]) == 1 and t[2][0][0] == "var":
        return compile_column(t[3], replace(s, vars={**s.vars, t[2][0][1]: compile_column(t[1], s)}))
    if kind == "reduce" and t[2][0][0] == "var":
        name = t[2][0][1]
        return F.aggregate(compile_many(t[1], s), compile_column(t[3], s), lambda a, x: compile_column(t[4], replace(s.inside(a), vars={**s.vars, name: x})))
    if kind == "call":
        return _call(t, s)
    raise NotLowered(kind)


def _stringy(t) -> bool:
    return (t[0] == "literal" and isinstance(t[1], str)) or t[0] in ("string", "format") or (t[0] == "binary" and t[1] == "+" and any(map(_stringy, t[2:4])))


def _slice(t, s):
    """From the floor of the start to the ceiling of the end; negative ones count from the end; both are clamped."""
    base = compile_column(t[1], s)
    text = _texty(t[1]) or s.type_of(base) == "string"
    size = F.char_length(base) if text else F.size(base)

    def bound(x, otherwise, whole):
        if x is None:
            return otherwise
        c = whole(compile_column(x, s)).cast("int")
        return F.least(F.greatest(F.when(c < 0, c + size).otherwise(c), F.lit(0)), size)

    low, high = bound(t[2], F.lit(0), F.floor), bound(t[3], size, F.ceil)
    count = F.greatest(high - low, F.lit(0))
    return F.substring(base, low + 1, count) if text else F.slice(base, low + 1, count)


def _texty(t) -> bool:
    """Whether a slice's base is known to be text: it was made by a text function."""
    return _stringy(t) or (t[0] == "call" and t[1] in ("tostring", "ascii_downcase", "ascii_upcase", "trim", "ltrim", "rtrim")) or (t[0] == "pipe" and _texty(t[2]))


def _call(t, s: Scope) -> Column:
    _, name, args = t
    here = lambda: compile_column(("identity",), s)
    arg = lambda i: compile_column(args[i], s)
    n = len(args)
    if n == 0 and name in ("keys", "to_entries", "from_entries") and (s.value is None or s.type_of(here()) not in ("map", "array", "")):
        raise NotLowered(f"{name} of a record")
    if n == 0 and name in UNARY and name not in ("length", "add", "tostring", "tojson"):
        return UNARY[name](here())
    if name in ("tostring", "tojson") and n == 0:
        return (_text if name == "tostring" else _json)(here(), s)
    if name in ("length", "add") and n == 0:
        return (_length if name == "length" else _added)(here(), s)
    if name in ("string_length", "array_length") and n == 0:
        return F.char_length(here()) if name[0] == "s" else F.size(here())
    if name == "map" and n == 1:
        return compile_many(("pipe", ("iterate", ("identity",)), args[0]), s)
    if name in ("test", "startswith", "endswith", "contains", "split", "join", "ltrimstr", "rtrimstr", "has", "index", "strftime", "strptime", "sub", "gsub", "pow", "splits", "flatten", "nth", "capture", "scan"):
        if name == "test":
            flags = _literal_text(args[1]) if n > 1 else ""
            return F.rlike(here(), F.lit(_java_regex(_literal_text(args[0]), flags)))
        if name == "startswith":
            return F.startswith(here(), arg(0))
        if name == "endswith":
            return F.endswith(here(), arg(0))
        if name == "contains":
            if s.type_of(here()) not in ("string", ""):
                raise NotLowered("contains of a container")
            return F.contains(here(), arg(0))
        if name == "split":
            sep = _literal_text(args[0])
            return F.split(here(), sep if n > 1 else _quoted(sep))
        if name == "join":
            return F.array_join(F.transform(here(), lambda x: x.cast("string")), _literal_text(args[0]), "")
        if name == "ltrimstr":
            return F.when(F.startswith(here(), arg(0)), F.substring(here(), F.length(arg(0)) + 1, F.length(here()))).otherwise(here())
        if name == "rtrimstr":
            return F.when(F.endswith(here(), arg(0)), F.substring(here(), F.lit(1), F.length(here()) - F.length(arg(0)))).otherwise(here())
        if name == "has" and s.value is None and s.fields is not None and args[0][0] == "literal":
            return F.lit(args[0][1] in s.fields)
        if name == "has":
            if s.type_of(here()) not in ("map", "array", ""):
                raise NotLowered("has of another kind")
            return F.map_contains_key(here(), arg(0)) if args[0][0] == "literal" and isinstance(args[0][1], str) else F.size(here()) > arg(0)
        if name == "index":
            return F.nullif(F.instr(here(), _literal_text(args[0])) - 1, F.lit(-1))
        if name == "strftime":
            return F.date_format(F.timestamp_seconds(here()) if not _is_time(s) else here(), java_pattern(_literal_text(args[0])))
        if name == "strptime":
            return F.to_timestamp(here(), java_pattern(_literal_text(args[0])))
        if name in ("sub", "gsub"):
            pattern, new = _java_regex(_literal_text(args[0]), ""), _literal_text(args[1]).replace("\\", "\\\\").replace("$", "\\$")
            return F.regexp_replace(here(), pattern if name == "gsub" else f"(?s)^(.*?)(?:{pattern})", new if name == "gsub" else "$1" + new)
        if name == "pow":
            return F.pow(arg(0), arg(1))
        if name == "flatten":
            return F.flatten(here())
        if name == "scan":
            return F.regexp_extract_all(here(), F.lit(_java_regex(_literal_text(args[0]), "")), F.lit(0))
        if name == "nth":
            return F.get(here(), arg(0))
    if name == "any" and n == 1:
        return F.exists(here(), lambda x: F.coalesce(truth(args[0], s.inside(x, here())), F.lit(False)))
    if name == "all" and n == 1:
        return F.forall(here(), lambda x: F.coalesce(truth(args[0], s.inside(x, here())), F.lit(False)))
    if name == "fromjson" and n == 0:
        return F.parse_json(here())
    if name == "fromjson_path" and n == 1:
        return F.get_json_object(here(), _literal_text(args[0]))
    if name in ("first", "last") and n == 1:
        many = compile_many(args[0], s)
        return F.get(many, F.lit(0)) if name == "first" else F.try_element_at(many, F.lit(-1))
    if name in ("range",):
        raise NotLowered("range has many outputs")
    raise NotLowered(f"{name}/{n}")


def _json(c: Column, s: Scope) -> Column:
    """JSON text of a column; doubles, whose text Spark forms otherwise, are left to the dynamic tier."""
    found = s.probe(c) if s.probe else None
    if found is None or any(x in found.simpleString() for x in ("double", "float", "decimal", "timestamp", "date")):
        raise NotLowered("the text of a number")
    if found.typeName() == "variant":
        return F.coalesce(F.to_json(c), F.lit("null"))
    if found.typeName() in ("long", "integer", "short", "byte", "boolean"):
        return F.coalesce(c.cast("string"), F.lit("null"))
    return F.regexp_extract(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}), r"(?s)^\{\"v\":(.*)\}$", 1)


def _text(c: Column, s: Scope) -> Column:
    return c if s.type_of(c) == "string" else _json(c, s)


def _length(c: Column, s: Scope) -> Column:
    kind = s.type_of(c)
    if kind == "string":
        return F.coalesce(F.char_length(c), F.lit(0))
    if kind in ("array", "map"):
        return F.when(c.isNull(), F.lit(0)).otherwise(F.size(c))
    if kind == "number":
        return F.coalesce(F.abs(c), F.lit(0))
    if kind == "struct":
        return F.when(c.isNull(), F.lit(0)).otherwise(F.lit(len(s.probe(c).fields)))
    raise NotLowered("length of an unknown kind: use string_length or array_length")


def _added(c: Column, s: Scope) -> Column:
    """The sum of an array, null of an empty one; strings and arrays are joined."""
    found = s.probe(c) if s.probe else None
    element = found.elementType.typeName() if found is not None and found.typeName() == "array" else "double"
    if element == "string":
        return F.when(F.size(c) > 0, F.array_join(c, ""))
    if element == "array":
        return F.when(F.size(c) > 0, F.flatten(c))
    if element not in ("long", "integer", "short", "byte", "double", "float", "decimal"):
        raise NotLowered(f"add of {element}")
    whole = element in ("long", "integer", "short", "byte")
    zero = F.lit(0).cast("long") if whole else F.lit(0.0)
    some = F.exists(c, lambda x: x.isNotNull())
    return F.when(some, F.aggregate(c, zero, lambda a, x: a + F.coalesce(x.cast("long" if whole else "double"), zero)))


def _is_time(s: Scope) -> bool:
    return bool(s.vars.get("__time__") is not None)


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|/" else c for c in text)


def _java_regex(pattern: str, flags: str) -> str:
    bad = set(flags) - set("gixsnlp")
    if bad:
        raise NotLowered(f"flags {flags}")
    on = "".join(c for c in flags if c in "ixs") + "U"
    return f"(?{on}){pattern}"


def compile_many(t, s: Scope) -> Column:
    """An array column of all outputs."""
    kind = t[0]
    if kind == "comma":
        both = compile_many(t[1], s), compile_many(t[2], s)
        if s.probe and not s.value_is_lambda:
            kinds = [x.elementType.simpleString() if (x := s.probe(c)) is not None else "" for c in both]
            if kinds[0] != kinds[1] and "void" not in kinds and any(kinds):
                raise NotLowered("an array of several types")
        return F.concat(*both)
    if kind == "iterate":
        return compile_column(t[1], s)
    if kind == "pipe":
        left, right = t[1], t[2]
        if right[0] == "call" and right[1] == "select" and len(right[2]) == 1:
            many = compile_many(left, s)
            return F.filter(many, lambda x: F.coalesce(truth(right[2][0], s.inside(x, many)), F.lit(False)))
        if _single(left):
            return compile_many(right, s.at(compile_column(left, s)))
        if _single(right):
            many = compile_many(left, s)
            return F.transform(many, lambda x: compile_column(right, s.inside(x, many)))
        many = compile_many(left, s)
        return F.flatten(F.transform(many, lambda x: compile_many(right, s.inside(x, many))))
    if kind == "call" and t[1] == "range":
        low, high = (F.lit(0), compile_column(t[2][0], s)) if len(t[2]) == 1 else (compile_column(t[2][0], s), compile_column(t[2][1], s))
        return F.when(high > low, F.sequence(low.cast("long"), high.cast("long") - 1, F.lit(1).cast("long"))).otherwise(F.array().cast("array<long>"))
    if kind == "call" and t[1] == "select":
        here = compile_column(("identity",), s)
        return F.filter(F.array(here), lambda x: F.coalesce(truth(t[2][0], replace(s, value=s.value) if s.value is None else s.inside(x)), F.lit(False)))
    if kind == "call" and t[1] == "empty":
        return F.array()
    if kind == "call" and t[1] == "limit":
        return F.slice(compile_many(t[2][1], s), 1, compile_column(t[2][0], s))
    if kind == "foreach" and t[2][0][0] == "var":
        name = t[2][0][1]
        first = compile_column(t[3], s)

        def step(acc, x):
            new = compile_column(t[4], replace(s.inside(acc.getField("state")), vars={**s.vars, name: x}))
            return F.struct(new.alias("state"), F.array_append(acc.getField("out"), new).alias("out"))

        return F.aggregate(compile_many(t[1], s), F.struct(first.alias("state"), F.slice(F.array(first), 1, 0).alias("out")), step, lambda acc: acc.getField("out"))
    return F.array(compile_column(t, s))


def _single(t) -> bool:
    """Whether an expression surely has exactly one output."""
    kind = t[0]
    if kind in ("identity", "literal", "var", "format", "array", "reduce"):
        return True
    if kind in ("field", "neg"):
        return _single(t[1])
    if kind in ("index", "pipe"):
        return _single(t[1]) and _single(t[2])
    if kind in ("binary", "compare", "logic"):
        return _single(t[2]) and _single(t[3])
    if kind == "if":
        return all(map(_single, t[1:4]))
    if kind == "alt":
        return _single(t[1]) and _single(t[2])
    if kind == "object":
        return all(_single(v) for _, v in t[1])
    if kind == "string":
        return all(isinstance(p, str) or _single(p) for p in t[2])
    return kind == "call" and t[1] not in ("range", "select", "empty", "limit", "splits", "recurse", "paths", "match", "scan") and all(map(_single, t[2]))
