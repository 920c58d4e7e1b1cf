"""The command line and the session."""

import io
import json

import pytest

from pipewright.__main__ import main
from pipewright.lang.parser import SyntaxProblem
from pipewright.lang.values import FilterError
from pipewright.session import Engine


@pytest.fixture
def call(spark):
    def run(*argv):
        out = io.StringIO()
        return main([str(x) for x in argv], spark, out), out.getvalue()

    return run


@pytest.fixture
def data(tmp_path):
    file = tmp_path / "d.json"
    file.write_text('{"b": 1, "a": "x"}\n{"b": 2, "a": null}\n')
    return file


def test_outputs(call, data):
    assert call("-c", ".b, .a", data) == (0, '1\n"x"\n2\nnull\n')
    assert call("-r", ".a // 0", data) == (0, "x\n0\n")
    assert call("-cS", ".", data) == (0, '{"a":"x","b":1}\n{"a":null,"b":2}\n')
    assert call("--tab", "{b}", data)[1].startswith('{\n\t"b": 1\n}')
    assert call("-j", ".b", data) == (0, "12")
    assert call("-T", "yaml", "{b}", data) == (0, "b: 1\n---\nb: 2\n")
    assert call("-q", ".", data) == (0, "")
    assert call("-c", "--stream", ".", data)[1].splitlines()[0] == '[["b"],1]'


def test_files_in_order(call, data, tmp_path):
    other = tmp_path / "a.json"
    other.write_text("9")
    assert call(".b? // .", data, other) == (0, "1\n2\n9\n")


def test_one_cursor(call, data):
    assert call("-s", "map(.b) | add", data) == (0, "3\n")
    assert call("-n", "[inputs.b] | length", data) == (0, "2\n")
    assert call("-n", "1 + 1") == (0, "2\n")
    assert call("-c", "[.b, input.b]", data) == (0, "[1,2]\n")


def test_raw_and_variables(call, tmp_path):
    lines = tmp_path / "l.txt"
    lines.write_text("p\nq\n")
    assert call("-R", ".", lines) == (0, '"p"\n"q"\n')
    assert call("-Rs", ".", lines) == (0, '"p\\nq\\n"\n')
    assert call("-nc", "--arg", "x", "1", "--argjson", "y", "2", "[$x, $y]") == (0, '["1",2]\n')
    assert call("-nc", "$ARGS.positional", "--args", "u", "v") == (0, '["u","v"]\n')
    assert call("-nc", "--rawfile", "t", lines, "$t") == (0, '"p\\nq\\n"\n')


def test_status(call, data, tmp_path):
    assert call(".[", data)[0] == 3
    assert call(".b.c", data)[0] == 5
    assert call("-e", ".a", data)[0] == 1
    assert call("-e", "empty", data)[0] == 4
    broken = tmp_path / "x.json"
    broken.write_text('1 {"a"')
    assert call(".", broken) == (4, "1\n")


def test_in_place_and_output(call, data, tmp_path):
    assert call("-ic", ".b", data)[0] == 0
    assert data.read_text() == "1\n2\n"
    assert call("-i", ".b", data)[0] == 5
    assert data.read_text() == "1\n2\n" and len(list(tmp_path.iterdir())) == 1
    assert call("--output", tmp_path / "out", ". + 1", data)[0] == 0
    assert sorted(x for p in (tmp_path / "out").glob("part-*") for x in p.read_text().split()) == ["2", "3"]


def test_programs(call):
    assert call("--fmt", "[.[]|.a]") == (0, "[.[] | .a]\n")
    assert json.loads(call("--tree", ".a")[1]) == ["field", ["identity"], ["literal", "a"]]


def test_session(spark):
    e = Engine(spark)
    e.define("def f: . + 1;")
    e.bind("n", 10)
    before = e.checkpoint()
    e.define("def g: f * $n;")
    assert e.evaluate("g, $n", 1) == [20, 10]
    docs = spark.createDataFrame([("1",), ("2",)], "value string")
    assert sorted(r.output for r in e.documents(docs, "g").collect()) == ["20", "30"]
    assert [r.output for r in e.rows(spark.range(1), ".id | f").collect()] == ["1"]
    with pytest.raises(SyntaxProblem):
        e.define("def h: ;")
    assert e.dump() == "def f: . + 1;\ndef g: f * $n;\n"
    e.rollback(before)
    with pytest.raises(FilterError):
        e.evaluate("g", 1)
    assert e.evaluate("f", 1) == [2]
