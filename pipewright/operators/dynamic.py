"""Row-wise programs in the dynamic tier: JSON text in, JSON text out, in Arrow batches.

Each row is one input; its outputs become rows in order (``pos``).  Errors of a program end the query, or with
``errors="skip"`` that row, or with ``errors="keep"`` give a row whose ``error`` says what went wrong.  ``halt`` ends
the outputs of its row (``halt_error`` with a value: as an error).  ``env`` is the driver's environment, and is shipped
only to programs that name it.
"""

from __future__ import annotations

import json
import os
import sys
import threading

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewright.lang.interp import Env, run
from pipewright.lang.modules import load
from pipewright.lang.values import FilterError, Halt, dumps

#: Python frames and bytes of stack for a program whose own recursion is deeper than Python's usual limit.
DEEP_FRAMES, DEEP_STACK = 1_000_000, 512 << 20


def outputs(tree, value, env) -> tuple[list, str | None]:
    """All outputs of a program as JSON text, and what ended them if anything did."""
    made: list[str] = []
    try:
        for x in run(tree, value, env):
            made.append(dumps(x))
    except Halt as e:
        return made, e.message or None
    except (FilterError, ValueError) as e:
        return made, str(e)
    return made, None


def deep(f, *args):
    """``f(*args)`` on a thread whose stack bears deep recursion."""
    out, before = [], (sys.getrecursionlimit(), threading.stack_size(DEEP_STACK))

    def work():
        try:
            out.append(f(*args))
        except (RecursionError, MemoryError):
            out.append(([], "recursion is too deep"))

    sys.setrecursionlimit(DEEP_FRAMES)
    try:
        t = threading.Thread(target=work)
        t.start()
        t.join()
    finally:
        sys.setrecursionlimit(before[0])
        threading.stack_size(before[1])
    return out[0]


def apply_json(
    df: DataFrame, program: str | tuple, column: str = "value", keep: tuple[str, ...] = (), variables: dict | None = None, errors: str = "raise", modules: dict[str, str] | None = None,
    file: str | None = None, line: str | None = None,
) -> DataFrame:
    """``keep`` columns, pos, output (JSON text) and error of the program on the JSON text in ``column``; null is null.

    ``modules``: texts of the modules that the program imports, by name.  ``file`` and ``line``: columns with what
    ``input_filename`` and ``input_line_number`` give.
    """
    load(program, modules, variables)  # syntax errors show on the driver
    named = program if isinstance(program, str) else repr(program)
    outside = dict(os.environ) if "env" in named or "ENV" in named else {}
    places = {k: c for k, c in (("file", file), ("line", line)) if c}

    def work(batches):
        tree, top = load(program, modules, variables)
        for b in batches:
            source, pos, out, bad = [], [], [], []
            where = {k: b.column(c).to_pylist() for k, c in places.items()}
            for i, text in enumerate(b.column(column).to_pylist()):
                env = Env(top.vars, top.funcs, {"env": outside, "modules": modules, **{k: x[i] for k, x in where.items()}})
                try:
                    value = None if text is None else json.loads(text)
                except ValueError as e:
                    made, problem = [], str(e)
                else:
                    try:
                        made, problem = outputs(tree, value, env)
                    except RecursionError:
                        made, problem = deep(outputs, tree, value, env)
                if problem is not None and errors == "raise":
                    raise FilterError(problem)
                source += [i] * len(made)
                pos += range(len(made))
                out += made
                bad += [None] * len(made)
                if problem is not None and errors == "keep":
                    source.append(i), pos.append(-1), out.append(None), bad.append(problem)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(pa.array(source, pa.int64())) for c in keep), pa.array(pos, pa.int32()), pa.array(out, pa.string()), pa.array(bad, pa.string())],
                [*keep, "pos", "output", "error"],
            )

    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep) + "pos int, output string, error string"
    return df.select(*dict.fromkeys((*keep, column, *places.values()))).mapInArrow(work, schema)


def fields_read(t) -> set[str] | None:
    """The fields of its input that a filter reads; None where it may read the whole."""
    kind = t[0]
    if kind in ("literal", "var", "break"):
        return set()
    if kind == "field" and t[1] == ("identity",) and t[2][0] == "literal":
        return {t[2][1]}
    if kind in ("field", "index", "slice", "iterate", "neg", "array", "binary", "compare", "logic", "comma", "alt", "if"):
        return _all_read(x for x in t[1:] if isinstance(x, tuple))
    if kind == "object":
        return _all_read(x for entry in t[1] for x in entry)
    if kind == "string":
        return _all_read(x for x in t[2] if not isinstance(x, str))
    if kind == "pipe":
        if t[1][0] == "call" and t[1][1] == "select" and len(t[1][2]) == 1:
            return _all_read((t[1][2][0], t[2]))
        return fields_read(t[2]) if t[1] == ("identity",) else fields_read(t[1])
    if kind == "try":
        return fields_read(t[1])
    if kind == "label":
        return fields_read(t[2])
    if kind == "bind" and all(p[0] == "var" for p in t[2]):
        return _all_read((t[1], t[3]))
    if kind in ("reduce", "foreach") and all(p[0] == "var" for p in t[2]):
        return _all_read((t[1], t[3]))
    if kind == "def":
        return fields_read(t[4])
    return None


def _all_read(trees) -> set[str] | None:
    found = [fields_read(x) for x in trees]
    return None if None in found else set().union(*found)


def row_text(df: DataFrame, program: str | tuple, modules: dict[str, str] | None = None):
    """Each row as a JSON object with the columns that the program reads, all of them where that is not known."""
    if df.columns == ["value"]:  # plain values, not objects
        return F.regexp_extract(F.to_json(F.struct("value"), {"ignoreNullFields": "false"}), r'(?s)^\{"value":(.*)\}$', 1)
    read = fields_read(load(program, modules)[0])
    columns = df.columns if read is None else [c for c in df.columns if c in read]
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns)), {"ignoreNullFields": "false"}) if columns else F.lit("{}")


def apply_rows(df: DataFrame, program: str | tuple, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """The same on whole rows, as JSON objects."""
    whole = row_text(df, program, options.get("modules")).alias("_json")
    return apply_json(df.select(*keep, whole), program, "_json", keep, **options)
