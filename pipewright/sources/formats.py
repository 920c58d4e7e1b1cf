"""Document formats to JSON-like values and back; what Spark's own readers cannot express runs here, in Arrow batches.

``decode(data, fmt)`` yields the documents of a file, ``encode(value, fmt)`` gives one document's text (bytes for cbor).
Names are case-insensitive and only their letters and digits count.
"""

from __future__ import annotations

import ast
import csv
import io
import json
import math
import re
import shlex
import struct
import tomllib
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

from pipewright.lang.values import FilterError, dumps, kind

ALIASES = {"yml": "yaml", "py": "pylit", "jsonloose": "j", "jsonl": "ndjson", "jsonc": "j", "jsons": "j"}
FORMATS = ("json", "json5", "j", "pylit", "ndjson", "yaml", "toml", "xml", "csv", "csvh", "tsv", "tsvh", "env", "exportenv", "cbor", "raw", "jq")
#: What stands between the documents of one text.
SEPARATORS = {"yaml": "---\n", "toml": "+++\n"}
XML_DEPTH = 128


def canonical(name: str) -> str:
    name = re.sub(r"[^a-z0-9]", "", name.lower())
    name = ALIASES.get(name, name)
    if name not in FORMATS:
        raise ValueError(f"unknown format {name!r}")
    return name


def by_extension(path: str) -> str:
    """The format that a file's name says; JSON where it says none."""
    end = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    return canonical(end) if end in ALIASES or end in FORMATS else "json"


# JSON and its relatives -------------------------------------------------------------------------------------------

_WORDS = {"null": None, "true": True, "false": False}
_PYTHON = {"None": None, "True": True, "False": False}
_NUMBER = re.compile(r"[+-]?(?:0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")
_NON_FINITE = re.compile(r"([+-]?)(nan|infinity|inf)\b", re.I)
_GAP = re.compile(r"[\s\ufeff\x1e]*")
_LOOSE_GAP = re.compile(r"(?:[\s\ufeff\x1e]|//[^\n]*|/\*.*?\*/)*", re.S)
_NAME = re.compile(r"[^\W\d][\w$]*|\$[\w$]*")
_ABSENT = object()


class _Reader:
    """Concatenated documents of one dialect.  ``loose``: comments, trailing commas, quotes of both kinds, bare keys."""

    def __init__(self, text: str, words: dict, loose: bool):
        self.s, self.i, self.words, self.loose = text, 0, words, loose
        self.gap = _LOOSE_GAP if loose else _GAP

    def fail(self, what):
        raise FilterError(f"{what} at {self.i}")

    def skip(self) -> str:
        self.i = self.gap.match(self.s, self.i).end()
        return self.s[self.i : self.i + 1]

    def documents(self):
        while self.skip():
            x = self.value()
            if x is not _ABSENT:
                yield x

    def value(self):
        c = self.skip()
        if c == "[":
            return self.items("]", lambda: self.value())
        if c == "{":
            return dict(x for x in self.items("}", self.entry) if x[1] is not _ABSENT)
        if c == '"' or (c == "'" and self.loose):
            return self.string(c)
        m = _NON_FINITE.match(self.s, self.i)
        if m:
            self.i = m.end()
            return math.nan if m[2].lower() == "nan" else -math.inf if m[1] == "-" else math.inf
        m = _NUMBER.match(self.s, self.i)
        if m:
            if not self.loose and (m[0][0] in "+." or "x" in m[0].lower()):
                self.fail("not a JSON number")
            self.i, t = m.end(), m[0]
            return int(t, 16) if "x" in t.lower() else int(t) if re.fullmatch(r"[+-]?\d+", t) else float(t)
        m = _NAME.match(self.s, self.i)
        if m and m[0] in self.words:
            self.i = m.end()
            return self.words[m[0]]
        if m and self.loose and m[0] == "undefined":
            self.i = m.end()
            return _ABSENT
        self.fail(f"unexpected {c!r}" if c else "unexpected end")

    def items(self, end, item):
        self.i += 1
        out = []
        while self.skip() != end:
            x = item()
            if x is not _ABSENT:
                out.append(x)
            c = self.skip()
            if c == ",":
                self.i += 1
                if self.skip() == end and not self.loose:
                    self.fail("a comma before the end")
            elif c != end:
                self.fail(f"expected ',' or {end!r}")
        self.i += 1
        return out

    def entry(self):
        c = self.skip()
        if c == '"' or (c == "'" and self.loose):
            key = self.string(c)
        else:
            m = self.loose and (_NAME.match(self.s, self.i) or _NUMBER.match(self.s, self.i))
            if not m:
                self.fail("expected a key")
            key, self.i = m[0], m.end()
        if self.skip() != ":":
            self.fail("expected ':'")
        self.i += 1
        return key, self.value()

    def string(self, quote):
        j = self.i + 1
        while j < len(self.s) and self.s[j] != quote:
            j += 2 if self.s[j] == "\\" else 1
        if j >= len(self.s):
            self.fail("a string does not end")
        body, self.i = self.s[self.i + 1 : j], j + 1
        if self.loose:
            body = re.sub(r"\\\r?\n", "", body)
            body = re.sub(r"\\x([0-9a-fA-F]{2})", r"\\u00\1", body)
            body = re.sub(r"\\([^\"\\/bfnrtu])", r"\1", body)
            body = re.sub(r'(?<!\\)((?:\\\\)*)"', r'\1\\"', body) if quote == "'" else body
        try:
            return json.loads(f'"{body}"', strict=False)
        except ValueError as e:
            self.fail(str(e))


# other formats ----------------------------------------------------------------------------------------------------

_CORE = (  # the YAML 1.2 core schema; fixed values
    ("tag:yaml.org,2002:null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("tag:yaml.org,2002:bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
    ("tag:yaml.org,2002:int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", list("-+0123456789")),
    ("tag:yaml.org,2002:float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", list("-+0123456789.")),
    ("tag:yaml.org,2002:merge", r"^(?:<<)$", ["<"]),
)


def _yaml():
    """Loader and dumper of the core schema."""
    import yaml  # only YAML needs it

    class Loader(yaml.SafeLoader):
        yaml_implicit_resolvers = {}

    class Dumper(yaml.SafeDumper):
        def ignore_aliases(self, data):
            return True

    for tag, pattern, first in _CORE:
        Loader.add_implicit_resolver(tag, re.compile(pattern), first)
        Dumper.add_implicit_resolver(tag, re.compile(pattern), first)

    def whole(loader, node):
        t = loader.construct_scalar(node)
        return int(t[2:], 8) if t.startswith("0o") else int(t, 16) if t.startswith("0x") else int(t)

    Loader.add_constructor("tag:yaml.org,2002:int", whole)
    return yaml, Loader, Dumper


def _from_yaml(text):
    yaml, loader, _ = _yaml()
    try:
        yield from map(_plain, yaml.load_all(text, Loader=loader))
    except yaml.YAMLError as e:
        raise FilterError(f"YAML: {e}") from None


def _plain(v):
    """Parsed values with string keys, and dates as text."""
    if isinstance(v, dict):
        return {k if isinstance(k, str) else dumps(_plain(k)): _plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    if isinstance(v, bytes):
        return list(v)
    return v if v is None or isinstance(v, (str, int, float)) else v.isoformat() if hasattr(v, "isoformat") else str(v)


def _from_table(text, separator, header):
    """One document: rows of cells, to the first blank line.  With a header, objects: cells beyond it are ``_column``."""
    csv.field_size_limit(2**31 - 1)
    rows, names = [], None
    for row in csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline=""), delimiter=separator):
        if not row:
            break
        if header and names is None:
            names = row
        else:
            rows.append({names[k] if k < len(names) else f"_{k}": x for k, x in enumerate(row)} if header else row)
    yield rows


def _from_xml(text):
    """Elements as {name, attributes, children}, text as {text}; a DOCTYPE is refused."""
    top, stack, run = [], [], []

    def flush():
        if run and stack:
            stack[-1]["children"].append({"text": "".join(run)})
        run.clear()

    def begin(name, attributes):
        flush()
        stack.append({"name": name, "attributes": dict(attributes), "children": []})

    def finish(name):
        flush()
        done = stack.pop()
        (stack[-1]["children"] if stack else top).append(done)

    def refuse(*_):
        raise FilterError("XML: a DOCTYPE is not accepted")

    p = expat.ParserCreate("utf-8")
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler, p.StartDoctypeDeclHandler = begin, finish, run.append, refuse
    try:
        p.Parse(text.encode(), True)
    except expat.ExpatError as e:
        raise FilterError(f"XML: {e}") from None
    yield from top


_ENV_LINE = re.compile(r"""\s*(?:export\s+)?([^\s=#]+)\s*=[^\S\n]*(?:"((?:\\.|[^"\\])*)"?|'((?:\\.|[^'\\])*)'?|((?:\\.|[^#\\\n])*))""", re.S)


def _from_env(text):
    out = {}
    i = 0
    while i < len(text):
        m = _ENV_LINE.match(text, i)
        if m and not text[i : m.start(1)].lstrip().startswith("#"):
            body = next((x for x in (m[2], m[3]) if x is not None), None)
            out[m[1]] = re.sub(r"(?s)\\(.)", r"\1", (m[4] or "").rstrip() if body is None else body)
            i = m.end()
        i = text.find("\n", i) + 1 or len(text)
    yield out


def _from_cbor(data):
    at = 0

    def take(n):
        nonlocal at
        if at + n > len(data):
            raise FilterError("CBOR: unexpected end")
        at += n
        return data[at - n : at]

    def item():
        first = take(1)[0]
        major, info = first >> 5, first & 31
        if major == 7 and info in (20, 21, 22, 23):
            return {20: False, 21: True}.get(info)
        if major == 7 and info in (25, 26, 27):
            return struct.unpack({25: ">e", 26: ">f", 27: ">d"}[info], take({25: 2, 26: 4, 27: 8}[info]))[0]
        if major in (6, 7) or info > 27:
            raise FilterError("CBOR: tags, simple values and indefinite lengths are not accepted")
        n = info if info < 24 else int.from_bytes(take(1 << (info - 24)), "big")
        if major < 2:
            return -1 - n if major else n
        if major == 2:
            return list(take(n))
        if major == 3:
            return take(n).decode()
        if major == 4:
            return [item() for _ in range(n)]
        out = {}
        for _ in range(n):
            key = item()
            if not isinstance(key, str):
                raise FilterError("CBOR: keys must be strings")
            out[key] = item()
        return out

    yield item()
    if at < len(data):
        raise FilterError("CBOR: more than one item")


def _to_cbor(v):
    def head(major, n):
        for info, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
            if n < 24:
                return bytes([major << 5 | n])
            if n < 1 << 8 * size:
                return bytes([major << 5 | info]) + n.to_bytes(size, "big")
        raise FilterError("CBOR: a number beyond 64 bits")

    k = kind(v)
    if k == "null" or k == "boolean":
        return bytes([0xF6 if v is None else 0xF4 + v])
    if k == "number" and (isinstance(v, int) or (v == v and abs(v) < 2**53 and v == int(v))):
        return head(0, int(v)) if v >= 0 else head(1, -1 - int(v))
    if k == "number":
        return b"\xfb" + struct.pack(">d", v)
    if k == "string":
        return head(3, len(v.encode())) + v.encode()
    if k == "array":
        return head(4, len(v)) + b"".join(map(_to_cbor, v))
    return head(5, len(v)) + b"".join(_to_cbor(x) + _to_cbor(y) for x, y in v.items())


def decode(data: bytes | str, fmt: str):
    """The documents of a file."""
    fmt = canonical(fmt)
    if fmt == "cbor":
        yield from _from_cbor(data)
        return
    text = data.decode() if isinstance(data, (bytes, bytearray, memoryview)) else data
    if fmt in ("json", "ndjson"):
        yield from _Reader(text, _WORDS, False).documents()
    elif fmt in ("json5", "j"):
        yield from _Reader(text, _WORDS, True).documents()
    elif fmt == "pylit":
        try:
            yield _plain(ast.literal_eval(text.strip()))
        except (ValueError, SyntaxError):
            yield from _Reader(text, _PYTHON, True).documents()
    elif fmt == "yaml":
        yield from _from_yaml(text)
    elif fmt == "toml":
        try:
            yield _plain(tomllib.loads(text))
        except tomllib.TOMLDecodeError as e:
            raise FilterError(f"TOML: {e}") from None
    elif fmt == "xml":
        yield from _from_xml(text)
    elif fmt in ("env", "exportenv"):
        yield from _from_env(text)
    elif fmt == "jq":
        from pipewright.lang.parser import SyntaxProblem, parse
        from pipewright.lang.printer import to_json

        try:
            yield to_json(parse(text))
        except SyntaxProblem as e:
            raise FilterError(f"program: {e}") from None
    elif fmt == "raw":
        yield from text.removesuffix("\n").split("\n") if text else ()
    else:
        yield from _from_table(text, "," if fmt[0] == "c" else "\t", fmt.endswith("h"))


# writers ----------------------------------------------------------------------------------------------------------


#: Terminal styles of null, false, true, numbers, strings, arrays, objects and keys; fixed values.
COLOURS = ("0;90", "0;39", "0;39", "0;39", "0;32", "1;39", "1;39", "1;34")


def coloured(v, indent: int | str | None = 2, sort: bool = False, ascii: bool = False, styles: tuple[str, ...] = COLOURS) -> str:  # noqa: A002
    """``pretty`` for terminals: each scalar, key and bracket in its style."""
    step = " " * indent if isinstance(indent, int) else indent
    paint = lambda k, t: f"\x1b[{styles[k]}m{t}\x1b[0m"
    plain = lambda x: json.dumps(x) if isinstance(x, str) and ascii else dumps(x)

    def write(x, pad):
        if not isinstance(x, (list, dict)):
            return paint({"null": 0, "number": 3, "string": 4}.get(kind(x), 2 if x else 1), plain(x))
        k, (a, b) = (5, "[]") if isinstance(x, list) else (6, "{}")
        if not x:
            return paint(k, a + b)
        inner = "" if step is None else pad + step
        gap = "" if step is None else " "
        names = sorted(x) if sort and k == 6 else x
        parts = [write(y, inner) for y in x] if k == 5 else [paint(7, plain(n)) + paint(6, ":") + gap + write(x[n], inner) for n in names]
        line, last = ("", "") if step is None else (f"\n{inner}", f"\n{pad}")
        return paint(k, a) + line + (paint(k, ",") + line).join(parts) + last + paint(k, b)

    return write(v, "")


def pretty(v, indent: int | str | None = 2, sort: bool = False, ascii: bool = False, words: dict | None = None) -> str:  # noqa: A002
    """JSON text; ``indent`` None is compact.  ``words`` replaces null, true, false and the non-finite numbers."""
    step = " " * indent if isinstance(indent, int) else indent

    def scalar(x):
        key = "nan" if x != x else "inf" if x == math.inf else "-inf" if x == -math.inf else dumps(x)
        if words and not isinstance(x, str) and key in words:
            return words[key]
        return json.dumps(x) if isinstance(x, str) and ascii else dumps(x)

    def write(x, pad):
        if not isinstance(x, (list, dict)) or not x:
            return scalar(x)
        inner = "" if step is None else pad + step
        gap = ":" if step is None else ": "
        parts = [write(y, inner) for y in x] if isinstance(x, list) else [scalar(k) + gap + write(x[k], inner) for k in (sorted(x) if sort else x)]
        a, b = "[]" if isinstance(x, list) else "{}"
        return a + ",".join(parts) + b if step is None else f"{a}\n{inner}" + f",\n{inner}".join(parts) + f"\n{pad}{b}"

    return write(v, "")


_PYTHON_WORDS = {"null": "None", "true": "True", "false": "False", "nan": "nan", "inf": "inf", "-inf": "-inf"}
_JSON5_WORDS = {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}


def _toml_key(k):
    return k if re.fullmatch(r"[A-Za-z0-9_-]+", k) else json.dumps(k, ensure_ascii=False)


def _toml_inline(v):
    if isinstance(v, list):
        return "[" + ", ".join(map(_toml_inline, v)) + "]"
    if isinstance(v, dict):
        return "{" + ", ".join(f"{_toml_key(k)} = {_toml_inline(x)}" for k, x in v.items() if x is not None) + "}"
    if v is None:
        return '"<null>"'
    if isinstance(v, float) and not math.isfinite(v):
        return "nan" if v != v else "inf" if v > 0 else "-inf"
    return repr(v) if isinstance(v, float) else dumps(v)


def _to_toml(v, path=()):
    v = v if isinstance(v, dict) else {"_": v}
    tables = {k: x for k, x in v.items() if isinstance(x, dict) or (isinstance(x, list) and x and all(isinstance(y, dict) for y in x))}
    out = [f"{_toml_key(k)} = {_toml_inline(x)}\n" for k, x in v.items() if k not in tables and x is not None]
    for k, x in tables.items():
        here = (*path, _toml_key(k))
        for y in x if isinstance(x, list) else [x]:
            out.append((f"[[{'.'.join(here)}]]\n" if isinstance(x, list) else f"[{'.'.join(here)}]\n") + _to_toml(y, here))
    return "".join(out)


def _to_table(v, separator, header):
    """Objects: rows of key and value; lists of objects: the union of their keys; lists of lists: padded; else JSON."""

    def cell(x):
        t = "" if x is None else x if isinstance(x, str) else dumps(x)
        return '"' + t.replace('"', '""') + '"' if not t or re.search(f'["\r\n{separator}]', t) else t

    rows, names = None, None
    if isinstance(v, dict):
        names, rows = ["key", "value"], [[k, x] for k, x in v.items()]
    elif isinstance(v, list) and v and all(isinstance(x, dict) for x in v):
        names = list(dict.fromkeys(k for x in v for k in x))
        rows = [[x.get(k) for k in names] for x in v]
    elif isinstance(v, list) and v and all(isinstance(x, list) for x in v):
        rows = [x + [None] * (max(map(len, v)) - len(x)) for x in v]
    else:
        rows = [[x] for x in (v if isinstance(v, list) else [v])]
    return "".join(separator.join(map(cell, r)) + "\n" for r in ([names] if header and names else []) + rows)


def _to_xml(v, depth=0):
    if depth > XML_DEPTH:
        raise FilterError("XML: too deep")
    if isinstance(v, dict) and set(v) == {"text"} and isinstance(v["text"], str):
        return escape(v["text"])
    if not isinstance(v, dict) or not isinstance(v.get("name"), str) or not re.fullmatch(r"[^\W\d][\w.:-]*", v["name"]):
        raise FilterError("XML: an element needs name, attributes and children")
    attributes, inside = v.get("attributes") or {}, v.get("children") or []
    if not isinstance(attributes, dict) or not isinstance(inside, list) or not all(isinstance(x, str) for x in attributes.values()):
        raise FilterError("XML: attributes must be an object of strings, children an array")
    head = v["name"] + "".join(f" {k}={quoteattr(x)}" for k, x in attributes.items())
    return f"<{head}>" + "".join(_to_xml(x, depth + 1) for x in inside) + f"</{v['name']}>" if inside else f"<{head}/>"


def _to_env(v, prefix):
    pairs = v.items() if isinstance(v, dict) else ((f"_{k}", x) for k, x in enumerate(v)) if isinstance(v, list) else [("_", v)]
    return "".join(f"{prefix}{k}={shlex.quote('' if x is None else x if isinstance(x, str) else dumps(x))}\n" for k, x in pairs)


def encode(v, fmt: str, indent: int | str | None = None, sort: bool = False, ascii: bool = False):  # noqa: A002
    """One document's text; a line end after it only where the format is made of lines."""
    fmt = canonical(fmt)
    if fmt == "cbor":
        return _to_cbor(v)
    if fmt in ("json", "ndjson"):
        return pretty(v, indent, sort, ascii)
    if fmt in ("json5", "j", "pylit"):
        return pretty(v, indent, sort, ascii, _PYTHON_WORDS if fmt == "pylit" else _JSON5_WORDS)
    if fmt == "yaml":
        yaml, _, dumper = _yaml()
        return yaml.dump(v, Dumper=dumper, sort_keys=sort, allow_unicode=not ascii).removesuffix("...\n")
    if fmt == "toml":
        return _to_toml(v)
    if fmt == "xml":
        return _to_xml(v)
    if fmt in ("env", "exportenv"):
        return _to_env(v, "export " if fmt == "exportenv" else "")
    if fmt == "raw":
        return v if isinstance(v, str) else dumps(v)
    if fmt == "jq":
        from pipewright.lang import printer

        return printer.text(printer.from_json(v)) + "\n"
    return _to_table(v, "," if fmt[0] == "c" else "\t", fmt.endswith("h"))
