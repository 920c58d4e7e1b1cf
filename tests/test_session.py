"""Sessions: runs with fuel, the prompt, colours and documentation."""

import io
import json

import pytest

from pipewright.__main__ import documentation, main, prompt
from pipewright.lang.interp import evaluate
from pipewright.lang.values import FilterError, Halt
from pipewright.operators.dynamic import apply_json, fields_read
from pipewright.lang.parser import parse
from pipewright.plans.lower import NotLowered, lower
from pipewright.session import Engine
from pipewright.sources.formats import coloured


def test_fuel_suspends_and_goes_on():
    run = Engine(None).start("def f: if . >= 100 then empty else ., (. + 1 | f) end; 0 | f")
    got, rounds = [], 0
    while run.state not in ("done", "failed"):
        got += run.go(300)
        rounds += 1
    assert got == list(range(100)) and rounds > 3 and run.error is None
    endless = Engine(None).start("def f: ., (. + 1 | f); 0 | f")
    assert endless.go(2000)[:2] == [0, 1] and endless.state == "suspended"
    endless.cancel()
    assert endless.state == "cancelled" and endless.go(10) == []
    failed = Engine(None).start('error("x")')
    failed.go(10_000)
    assert failed.state == "failed" and isinstance(failed.error, FilterError)


def test_prompt():
    out = io.StringIO()
    prompt(io.StringIO("def two: . * 2;\n21 | two\n. + 1\n:to yaml\n{a: .}\nerror(1)\n:dump\n:exit\nnever\n"), out)
    assert out.getvalue() == "42\n43\na: 43\nerror: 1\ndef two: . * 2;\n"


def test_colours_and_documentation():
    assert coloured({"a": [1, None]}, None) == '\x1b[1;39m{\x1b[0m\x1b[1;34m"a"\x1b[0m\x1b[1;39m:\x1b[0m\x1b[1;39m[\x1b[0m\x1b[0;39m1\x1b[0m\x1b[1;39m,\x1b[0m\x1b[0;90mnull\x1b[0m\x1b[1;39m]\x1b[0m\x1b[1;39m}\x1b[0m'
    assert {"name": "map", "arity": 1, "about": ""} in documentation()
    out = io.StringIO()
    assert main(["--doc", "-c"], stream=out) == 0 and len(json.loads(out.getvalue())) > 200


def test_stream_errors_and_status(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a":1} {"b"')
    out = io.StringIO()
    assert main(["-c", "--stream-errors", ".", str(tmp_path / "x.json")], spark, out) == 0
    lines = out.getvalue().splitlines()
    assert lines[:2] == ['[["a"],1]', '[["a"]]'] and len(lines) == 3 and json.loads(lines[2])[0]
    (tmp_path / "y.json").write_text("1 2")
    out = io.StringIO()
    assert main(["-c", '., (if . == 2 then "stop\\n" | halt_error(3) else empty end)', str(tmp_path / "y.json")], spark, out) == 3
    assert out.getvalue() == "1\n2\n"
    out = io.StringIO()
    assert main(["-c", "[input_filename[-6:], input_line_number]", str(tmp_path / "y.json")], spark, out) == 0 and out.getvalue().startswith('["y.json",0]')
    assert main(["--output", str(tmp_path / "o"), ".x", str(tmp_path / "y.json")], spark, io.StringIO()) == 5


def test_errors_are_the_languages():
    for program, value in (
        ("to_entries", [1]), ("ascii", "x"), ("transpose", None), ("from_entries", [1]), ("any", 1), ("bsearch(1)", 1), ("sha256", None), ("strptime(1)", "x"), ("@base32d", "1"), ("@hexd", "x"),
        ("implode", ["a"]), ("join(1)", ["a"]), ("flatten(-1)", []), ("ltrimstr(1)", "a"), ("limit(-1; 1)", None), ("test(1)", "a"), ("keys", None), ("tostring | error", 1), ("fromstream(1)", None),
        ("with_entries(1)", {"a": 1}), ("getpath([\"a\"])", 1), ("delpaths(1)", {}), ("splits(1)", "a"), ("abs", None), ("choice", []), ("randint(1; 1)", None), ("gmtime", "x"), ("mktime", ["x"]), ("modulemeta", "none"),
        ("map_values(1)", 3), ("combinations", 3), ("range(\"a\")", None), ("nth(-1; 1)", None), ("in(3)", "a"), ("has({})", []), ("capture(\"(\")", "a"), ("frexp", "x"), ("fma(1; 2; \"x\")", None),
    ):
        with pytest.raises(FilterError):
            evaluate(program, value)
    with pytest.raises(Halt):
        evaluate("try halt catch .")
    assert evaluate("[limit(3; repeat(1))]") == [[1, 1, 1]] and evaluate("[1,2] | input_line_number", None) == [0]


def test_deep_recursion_and_kept_errors(spark):
    df = spark.createDataFrame([("20000",), ('"x"',), ("{bad",)], "value string")
    got = sorted((r.output or "", bool(r.error)) for r in apply_json(df, "def down: if . <= 0 then . else . - 1 | down end; down", errors="keep").collect())
    assert got == [("", True), ("", True), ("0", False)]


def test_only_read_columns_are_made_json(spark):
    assert fields_read(parse("(.a + (.b | length)) as $x | {c, $x}")) == {"a", "b", "c"}
    assert fields_read(parse("[.a, .b.c] | to_entries")) == {"a", "b"}
    assert fields_read(parse("select(.a > 1) | .b")) == {"a", "b"}
    assert fields_read(parse(". | keys")) is None and fields_read(parse("select(.a)")) is None


def test_planner(spark):
    df = spark.createDataFrame([(1, None, False, None), (2, 5, True, "a"), (3, 7, None, "b"), (4, None, True, "a")], "id long, x long, f boolean, s string")
    names = spark.createDataFrame([(1, "one"), (3, "three"), (3, "drei")], "k long, name string")
    value = lambda p, **k: [r[0] if len(r) == 1 else tuple(r) for r in lower(df, p, {"t": names}, **k).collect()]
    assert value(".[] | (.f // true)") == [True] * 4
    assert value("map(select(.x < 6) | .id)") == [1, 2, 4] and value("map(.x + 1)") == [1, 6, 8, 1]
    assert value("map(if .id then 1 else 2 end)") == [1] * 4 and value("map(select(.s) | .id)") == [2, 3, 4]
    assert value("sort_by(.id) | .[1:-1] | map(.id)") == [2, 3] and value("sort_by(-.id) | unique_by(.s) | map(.id) | sort") == [1, 3, 4]
    assert value("map({id, x}) | min") == [(1, None)] and value("[.[] | .x] | min") == [None]
    assert value("sort_by(.id) | [foreach .[] as $r (0; . + $r.id)] | sort") == [1, 3, 6, 10]
    assert value("sort_by(.id) | map(select(.id | IN($t[].k)) | .id)") == [1, 3]
    assert value(".[] | keys | length") == ["4"] * 4 and value(".[] | {id, k: (keys | length)}", schema="id long, k int") == [(i, 4) for i in (1, 2, 3, 4)]
    for bad in (".[-1:]", "last", "map({id, x}) | add", "foreach .[] as $r (0; . + $r.id)", "reduce .[] as $r (0; . * $r.id)"):
        with pytest.raises(NotLowered):
            value(bad)
    assert lower(spark, "[range(5)] | map(. * 2) | add").first().value == 20
