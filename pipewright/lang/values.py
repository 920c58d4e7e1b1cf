"""JSON-like values: order, text forms and arithmetic."""

from __future__ import annotations

import json
import math


class FilterError(Exception):
    """An error a program raises; ``value`` is what ``catch`` sees."""

    def __init__(self, value):
        super().__init__(value if isinstance(value, str) else dumps(value))
        self.value = value


class Halt(Exception):
    """The program stops: its exit status, and the value that goes to standard error (None: nothing)."""

    def __init__(self, status: int, value):
        super().__init__(f"halted with status {status}")
        self.status, self.value = status, value

    @property
    def message(self) -> str:
        return "" if self.value is None and not self.status else self.value if isinstance(self.value, str) else dumps(self.value) + "\n"


def kind(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(v)]


def truthy(v) -> bool:
    return v is not None and v is not False


_RANK = {"null": 0, "boolean": 1, "number": 3, "string": 4, "array": 5, "object": 6}


def order_key(v):
    """A key of the total order: null, false, true, numbers (NaN first), strings, arrays, objects (keys, then values)."""
    k = kind(v)
    if k == "null":
        return (0,)
    if k == "boolean":
        return (1 + v,)
    if k == "number":
        return (3, (0, 0)) if v != v else (3, (1, v))
    if k == "string":
        return (4, v)
    if k == "array":
        return (5, [order_key(x) for x in v])
    names = sorted(v)
    return (6, names, [order_key(v[n]) for n in names])


def number_text(x) -> str:
    if isinstance(x, int):
        return str(x)
    if x != x:
        return "null"
    if math.isinf(x):
        return "1.7976931348623157e+308" if x > 0 else "-1.7976931348623157e+308"
    if x == int(x) and abs(x) < 1e17:
        return str(int(x)) if x or math.copysign(1, x) > 0 else "-0"
    out = repr(x)
    if "e" in out:
        head, exp = out.split("e")
        out = f"{head}e{exp[0]}{exp[1:].zfill(2)}" if exp[0] in "+-" else f"{head}e+{exp.zfill(2)}"
    return out


def dumps(v, sort: bool = False) -> str:
    """Compact JSON text."""
    k = kind(v)
    if k == "number":
        return number_text(v)
    if k == "array":
        return "[" + ",".join(dumps(x, sort) for x in v) + "]"
    if k == "object":
        names = sorted(v) if sort else v
        return "{" + ",".join(f"{json.dumps(n, ensure_ascii=False)}:{dumps(v[n], sort)}" for n in names) + "}"
    return json.dumps(v, ensure_ascii=False)


def loads(text: str):
    try:
        return json.loads(text)
    except ValueError as e:
        raise FilterError(f"{e} (while parsing '{text}')") from None


def _both(a, b):
    return f"{kind(a)} ({_short(a)}) and {kind(b)} ({_short(b)})"


def _short(v):
    text = dumps(v)
    return text if len(text) <= 11 else text[:10] + "..."


def arithmetic(op: str, a, b):
    x, y = kind(a), kind(b)
    if op == "+":
        if a is None or b is None:
            return b if a is None else a
        if x == y and x in ("number", "string", "array"):
            return a + b
        if x == y == "object":
            return {**a, **b}
        raise FilterError(f"{_both(a, b)} cannot be added")
    if op == "-":
        if x == y == "number":
            return a - b
        if x == y == "array":
            gone = [order_key(v) for v in b]
            return [v for v in a if order_key(v) not in gone]
        raise FilterError(f"{_both(a, b)} cannot be subtracted")
    if op == "*":
        if x == y == "number":
            return a * b
        if {x, y} == {"string", "number"}:
            s, n = (a, b) if x == "string" else (b, a)
            return s * max(int(n), 1) if n > 0 else None
        if x == y == "object":
            return merge(a, b)
        raise FilterError(f"{_both(a, b)} cannot be multiplied")
    if op == "/":
        if x == y == "number":
            if b == 0:
                raise FilterError(f"{_both(a, b)} cannot be divided because the divisor is zero")
            out = a / b
            return int(out) if isinstance(a, int) and isinstance(b, int) and a % b == 0 else out
        if x == y == "string":
            return split(a, b)
        raise FilterError(f"{_both(a, b)} cannot be divided")
    if x == y == "number":
        if a != a or b != b:
            return math.nan
        n, m = _whole(a), _whole(b)
        if m == 0:
            raise FilterError(f"{_both(a, b)} cannot be divided because the divisor is zero")
        return int(math.fmod(n, abs(m))) if abs(n) < 2**53 else (abs(n) % abs(m)) * (1 if n >= 0 else -1)
    raise FilterError(f"{_both(a, b)} cannot be divided")


def _whole(x) -> int:
    return 2**63 - 1 if x == math.inf else -(2**63) if x == -math.inf else int(x)


def merge(a: dict, b: dict) -> dict:
    out = dict(a)
    for k, v in b.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def split(text: str, sep: str) -> list[str]:
    if not text:
        return []
    return list(text) if not sep else text.split(sep)
