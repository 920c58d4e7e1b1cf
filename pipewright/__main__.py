"""Command line: ``python -m pipewright [options] program [file ...]``.

Files become a DataFrame of documents, the program runs on the executors, and the outputs come back in order through an
iterator that holds a partition at a time; ``--output`` writes them as a distributed text table instead.  Programs that
share one cursor over all documents (``-n`` with ``inputs``, ``-s``) run in one task, on the driver.

Exit status: 0; 1 with ``-e`` and a last output of false or null; 2 bad options; 3 a program that does not parse; 4 an
input that does not parse, or ``-e`` and no output; 5 an error that a program raised.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewright.lang import builtins
from pipewright.lang.interp import Env, run
from pipewright.lang.modules import find, load
from pipewright.lang.parser import SyntaxProblem, parse
from pipewright.lang.printer import format_program, to_json
from pipewright.lang.values import FilterError, Halt, dumps
from pipewright.operators.dynamic import apply_json
from pipewright.session import Engine
from pipewright.sources import files
from pipewright.sources.formats import COLOURS, SEPARATORS, by_extension, canonical, coloured, decode, encode


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pipewright", allow_abbrev=False)
    add = p.add_argument
    add("-F", "--from", dest="source", help="format of the inputs; by the file's ending, else JSON")
    add("-T", "--to", dest="target", default="json", help="format of the outputs")
    for short, long, words in (
        ("-n", "--null-input", "run once on null"), ("-R", "--raw-input", "each line is a string"), ("-s", "--slurp", "all documents as one array"),
        ("-c", "--compact-output", "no white space"), ("-r", "--raw-output", "strings without quotes"), ("-j", "--join-output", "as -r, without line ends"),
        ("-a", "--ascii-output", "escapes for all but ASCII"), ("-S", "--sort-keys", "keys in order"), ("-e", "--exit-status", "status by the last output"),
        ("-q", "--quiet", "no outputs"), ("-i", "--in-place", "replace each file by its outputs"), ("--tab", "--tabs", "indent by tabs"),
        ("--stream", "--events", "inputs as path events"), ("--stream-errors", "--events-and-errors", "as --stream, and a broken document as its message in an array"),
        ("-C", "--color-output", "colours"), ("-M", "--monochrome-output", "no colours"), ("--unbuffered", "--flush", "write each output at once"), ("--doc", "--functions", "the functions, as JSON"),
        ("--repl", "--interactive", "read programs from standard input, line by line"), ("--seq", "--record-separators", "a record separator before each output"),
        ("--raw-output0", "--nul-output", "as -r, NUL after each output"), ("--fmt", "--format-program", "lay programs out"), ("--tree", "--dump-tree", "show the program's tree"),
    ):
        add(short, long, action="store_true", help=words)
    add("--indent", type=int, default=2)
    add("-f", "--from-file", help="read the program from a file")
    add("-L", "--library-path", action="append", default=[])
    for name in ("--arg", "--argjson", "--slurpfile", "--rawfile"):
        add(name, nargs=2, action="append", default=[])
    add("--args", action="store_true", help="the rest are strings, not files")
    add("--jsonargs", action="store_true", help="the rest are JSON texts, not files")
    add("--output", help="folder to write the outputs to, as a distributed text table")
    add("rest", nargs="*")
    return p


def bindings(o, words: list[str]) -> dict:
    """The program's variables: named ones and ARGS."""
    named = dict(o.arg)
    named |= {k: json.loads(v) for k, v in o.argjson}
    named |= {k: list(decode(Path(v).read_bytes(), "json")) for k, v in o.slurpfile}
    named |= {k: Path(v).read_text() for k, v in o.rawfile}
    positional = words if o.args else [json.loads(w) for w in words] if o.jsonargs else []
    return named | {"ARGS": {"positional": positional, "named": named}}


class Writer:
    """Outputs as text, one after the other; remembers the last one for the exit status."""

    def __init__(self, o, stream):
        self.o, self.stream, self.count, self.last = o, stream, 0, None
        self.target = canonical(o.target)
        given = [x for x in os.environ.get("JQ_COLORS", "").split(":") if x]
        self.styles = (*given[: len(COLOURS)], *COLOURS[len(given) :])

    def put(self, value) -> None:
        o, self.last = self.o, value
        self.count += 1
        if o.quiet:
            return
        raw = isinstance(value, str) and (o.raw_output or o.join_output or o.raw_output0)
        indent = None if o.compact_output else "\t" if o.tab else o.indent or None
        paint = o.color_output and not o.monochrome_output and self.target == "json"
        out = value if raw else (coloured(value, indent, o.sort_keys, o.ascii_output, self.styles) if paint else encode(value, self.target, indent, o.sort_keys, o.ascii_output))
        if isinstance(out, bytes):
            self.stream.buffer.write(out)
            return
        if self.target in SEPARATORS and self.count > 1:
            self.stream.write(SEPARATORS[self.target])
        end = "\0" if o.raw_output0 else "" if o.join_output or out.endswith("\n") and not raw else "\n"
        self.stream.write(("\x1e" if o.seq else "") + out + end)
        if o.unbuffered:
            self.stream.flush()


def documents(spark: SparkSession, o, names: list[str]) -> DataFrame:
    """file, doc, value and error of all inputs; standard input is spooled to the driver's own file first."""
    fmt = "raw" if o.raw_input else o.source
    if not names:
        spool = tempfile.NamedTemporaryFile(delete=False)  # noqa: SIM115
        spool.write(sys.stdin.buffer.read())
        spool.close()
        names, fmt = [spool.name], fmt or "json"
    known = Path(names[0]).suffix if not fmt else None
    docs = files.read(spark, [os.path.abspath(n) if os.path.exists(n) else n for n in names], fmt or (None if known else "json"), errors="keep")
    local = F.regexp_replace("file", "^file:/+", "/")
    place = F.array_position(F.array(*(F.lit(os.path.abspath(n)) for n in names)), local)  # 0, and so by name, for others
    return docs.select(place.alias("place"), "file", F.col("pos").alias("doc"), "value", "error")


def _fail(words, status: int) -> int:
    print(f"pipewright: {words}", file=sys.stderr)
    return status


def one_cursor(o, docs, program, variables, modules, writer) -> int:
    """Run on the driver, with documents coming one by one."""
    status = [0]

    def values():
        for r in docs.orderBy("place", "file", "doc").toLocalIterator() if docs is not None else ():
            if r.error is not None:
                status[0] = _fail(r.error, 4)
                return
            yield json.loads(r.value)

    source = values()
    if o.slurp:
        items = list(source)
        whole = "".join(x + "\n" for x in items) if o.raw_input else items
        source = iter([whole])
    tree, env = load(program, modules, variables)
    try:
        for value in [None] if o.null_input else source:
            for x in run(tree, value, Env(env.vars, env.funcs, {"inputs": source, "env": os.environ, "modules": modules})):
                writer.put(x)
    except Halt as e:
        sys.stderr.write(e.message)
        return e.status
    except (FilterError, RecursionError) as e:
        return _fail(e, 5)
    return status[0]


def distributed(o, docs, program, variables, modules, writer) -> int:
    """Run on the executors; outputs in the order of the documents."""
    good = docs.where("error is null")
    if o.stream_errors:  # a broken document is its message
        good = docs.select("place", "file", "doc", F.coalesce("value", F.to_json(F.array("error"))).alias("value"), F.col("error").alias("_bad"))
        whole = apply_json(good.where("_bad is null"), "tostream", keep=("place", "file", "doc")).select("place", "file", F.struct("doc", "pos").alias("doc"), F.col("output").alias("value"))
        good = whole.unionByName(good.where("_bad is not null").select("place", "file", F.struct("doc", F.lit(-1).alias("pos")).alias("doc"), "value"))
        docs = docs.where("false")
    elif o.stream:
        good = apply_json(good.select("place", "file", "doc", "value"), "tostream", keep=("place", "file", "doc")).select("place", "file", F.struct("doc", "pos").alias("doc"), F.col("output").alias("value"))
    out, status = apply_json(good, program, keep=("place", "file", "doc"), variables=variables, errors="keep", modules=modules, file="file", line=None if o.stream or o.stream_errors else "doc"), 0
    if o.output:
        files.write(out.where("error is null").withColumnRenamed("output", "value"), o.output, o.target)
        for bad, code in ((out, 5), (docs, 4)):
            for r in bad.where("error is not null").agg(F.count("*").alias("n"), F.min("error").alias("error")).where("n > 0").collect():
                status = _fail(f"{r.n} times: {r.error}", code)
        return status
    for r in out.orderBy("place", "file", "doc", "pos").toLocalIterator():
        if r.error is not None:
            status = _fail(r.error, 5)
        else:
            status = 0 if r.pos == 0 else status
            writer.put(json.loads(r.output))
    for r in docs.where("error is not null").select("error").limit(1).collect():
        status = _fail(r.error, 4)
    return status


def execute(spark: SparkSession, o, program: str, names: list[str], variables: dict, stream) -> int:
    modules = find(o.library_path)
    try:
        tree, _ = load(program, modules, variables)
    except SyntaxProblem as e:
        return _fail(e, 3)
    writer = Writer(o, stream)
    docs = None if o.null_input and not names else documents(spark, o, names)
    words = dumps(to_json(tree))
    alone = o.null_input or o.slurp or '"input"' in words or '"inputs"' in words or '"halt' in words  # halt stops everything
    status = (one_cursor if alone else distributed)(o, docs, program, variables, modules, writer)
    if o.exit_status and not status:
        status = 4 if not writer.count else int(writer.last is None or writer.last is False)
    return status


def documentation() -> list[dict]:
    """Every function with its number of arguments, and what its rule says of itself."""
    known = {**builtins.VALUES, **builtins.PATHS}
    return [{"name": n, "arity": k, "about": (known[n, k].__doc__ or "").strip()} for n, k in sorted(known) if not n.startswith("_")]


def prompt(source, stream) -> int:
    """Lines of definitions (``def f: ..;``) and programs; each program runs on the last value.

    Commands: :help, :doc, :reset, :dump, :to FORMAT, :load FILE, :exit.
    """
    engine, value, target = Engine(None), None, "json"
    for line in source:
        words = line.strip()
        if not words:
            continue
        try:
            if words in (":exit", ":quit"):
                return 0
            if words == ":reset":
                engine.reset()
                value = None
            elif words == ":dump":
                stream.write(engine.dump())
            elif words == ":help":
                stream.write((prompt.__doc__ or "").strip() + "\n")
            elif words == ":doc":
                stream.write("\n".join(f"{d['name']}/{d['arity']}" for d in documentation()) + "\n")
            elif words.startswith(":to "):
                target = canonical(words[4:])
            elif words.startswith(":load "):
                path = Path(words[6:].strip())
                value = next(iter(decode(path.read_bytes(), by_extension(path.name))), None)
            elif words.startswith("def "):
                engine.define(words)
            else:
                for value in engine.evaluate(words, value):
                    text = encode(value, target, 2)
                    stream.write(text if isinstance(text, str) and text.endswith("\n") else f"{text}\n")
        except (SyntaxProblem, FilterError, Halt, OSError, ValueError, RecursionError) as e:
            stream.write(f"error: {e}\n")
    return 0


def in_place(spark, o, program, names, variables) -> int:
    """Each file's outputs take its place at once, and only if all went well."""
    worst = 0
    for name in names:
        with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(os.path.abspath(name)), delete=False) as new:
            status = execute(spark, o, program, [name], variables, new)
        if status:
            os.unlink(new.name)
        else:
            os.chmod(new.name, os.stat(name).st_mode & 0o7777)
            os.replace(new.name, name)
        worst = max(worst, status)
    return worst


def main(argv: list[str] | None = None, spark: SparkSession | None = None, stream=None) -> int:
    p = options()
    try:
        o = p.parse_intermixed_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    stream, rest = stream or sys.stdout, list(o.rest)
    try:
        if o.fmt:
            for text in [Path(o.from_file).read_text()] if o.from_file else rest or [sys.stdin.read()]:
                stream.write(format_program(text))
            return 0
        if o.doc:
            stream.write(encode(documentation(), "json", None if o.compact_output else o.indent) + "\n")
            return 0
        if o.repl:
            return prompt(sys.stdin, stream)
        if o.from_file:
            program = Path(o.from_file).read_text()
        elif rest:
            program = rest.pop(0)
        else:
            program = "."
        if o.tree:
            stream.write(dumps(to_json(parse(program))) + "\n")
            return 0
        variables = bindings(o, rest)
    except SyntaxProblem as e:
        return _fail(e, 3)
    except (OSError, ValueError, FilterError) as e:
        return _fail(e, 2)
    names = [] if o.args or o.jsonargs else rest
    if o.in_place and not names:
        return _fail("in-place needs files", 2)
    own = spark is None
    if own:
        spark = SparkSession.builder.appName("pipewright").config("spark.ui.showConsoleProgress", "false").config("spark.log.level", "ERROR").getOrCreate()
    try:
        return in_place(spark, o, program, names, variables) if o.in_place else execute(spark, o, program, names, variables, stream)
    finally:
        if own:
            spark.stop()


if __name__ == "__main__":
    sys.exit(main())
