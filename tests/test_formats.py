"""Formats, files and streams."""

import json
import math

import pytest
from pyspark.sql import functions as F

from pipewright.lang.values import FilterError
from pipewright.sources import files
from pipewright.sources.formats import by_extension, decode, encode
from pipewright.streaming import filters

DOC = {"a": [1, 2.5, None, True], "b": {"c": "é \"q\"\n", "d": []}, "e": "no"}


@pytest.mark.parametrize("fmt", ["json", "json5", "pylit", "yaml", "cbor"])
def test_round_trip(fmt):
    assert list(decode(encode(DOC, fmt), fmt)) == [DOC]


@pytest.mark.parametrize(
    "fmt, text, want",
    [
        ("json", '\ufeff1 [2]{"a":null}"x"', [1, [2], {"a": None}, "x"]),
        ("json5", "{a: 'it\"s', /* c */ b: [+1, .5, 0x1F,], c: undefined} // end", [{"a": 'it"s', "b": [1, 0.5, 31]}]),
        ("py", "{'a': (None, True), 'b': 1}", [{"a": [None, True], "b": 1}]),
        ("yml", "a: &x {k: 0o17}\nb: *x\n---\n- yes\n- 0x1F\n- ~", [{"a": {"k": 15}, "b": {"k": 15}}, ["yes", 31, None]]),
        ("toml", 'a.b = 1\n[[t]]\nd = 2020-01-02', [{"a": {"b": 1}, "t": [{"d": "2020-01-02"}]}]),
        ("csv", 'a,"b,""c"""\r\n1,\n\nx', [[["a", 'b,"c"'], ["1", ""]]]),
        ("csvh", "a,b\n1\n1,2,3\n", [[{"a": "1"}, {"a": "1", "b": "2", "_2": "3"}]]),
        ("tsv", "a\tb\n", [[["a", "b"]]]),
        ("xml", "<a x='1'>t<b/>&lt;</a>", [{"name": "a", "attributes": {"x": "1"}, "children": [{"text": "t"}, {"name": "b", "attributes": {}, "children": []}, {"text": "<"}]}]),
        ("env", "# c\nA=1 # x\nexport B=\"a \\\"b\\\"\"\n\nC='#'\n", [{"A": "1", "B": 'a "b"', "C": "#"}]),
        ("raw", "a\r\n\nb\n", ["a\r", "", "b"]),
    ],
)
def test_decode(fmt, text, want):
    assert list(decode(text, fmt)) == want


@pytest.mark.parametrize("fmt, text", [("json", "[1,]"), ("json", "{a:1}"), ("xml", "<!DOCTYPE a><a/>"), ("toml", "a ="), ("cbor", b"\x01\x02"), ("json", '"x')])
def test_broken(fmt, text):
    with pytest.raises(FilterError):
        list(decode(text, fmt))


def test_encode():
    assert math.isnan(next(decode("nAn", "json")))
    assert encode({"a": 1, "n": None, "t": {"x": [1, None]}, "l": [{"y": 1.0}]}, "toml") == 'a = 1\n[t]\nx = [1, "<null>"]\n[[l]]\ny = 1.0\n'
    assert encode([{"a": 1}, {"b": ""}], "csvh") == 'a,b\n1,""\n"",""\n'
    assert encode({"k": [1]}, "csv") == 'k,[1]\n'
    assert encode({"A": "x y", "B": None}, "exportenv") == "export A='x y'\nexport B=''\n"
    xml = {"name": "a", "attributes": {"k": "<"}, "children": [{"text": "&"}]}
    assert list(decode(encode(xml, "xml"), "xml")) == [xml]
    assert encode([True, math.inf], "pylit", indent=2) == "[\n  True,\n  inf\n]"
    assert (by_extension("a/b.yml"), by_extension("x.tsv"), by_extension("x")) == ("yaml", "tsv", "json")


def test_files(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a":1}\n[2,\n3]')
    (tmp_path / "bad.json").write_text('1 {"a"')
    got = sorted((r.file.rsplit("/", 1)[1], r.pos, r.value, bool(r.error)) for r in files.read(spark, str(tmp_path), "json", errors="keep").collect())
    assert got == [("bad.json", 0, "1", False), ("bad.json", 1, None, True), ("x.json", 0, '{"a":1}', False), ("x.json", 1, "[2,3]", False)]
    assert files.read(spark, str(tmp_path / "x.json"), slurp=True).first().value == '[{"a":1},[2,3]]'
    (tmp_path / "l.txt").write_text('q"\\\n\nb')
    assert [json.loads(r.value) for r in files.read(spark, str(tmp_path / "l.txt"), "raw").orderBy("pos").collect()] == ['q"\\', "", "b"]
    df = spark.createDataFrame([('{"a": [1, "x"]}',), ("null",)], "value string")
    for fmt in ("ndjson", "yaml"):
        files.write(df.coalesce(1), str(tmp_path / fmt), fmt)
        back = [json.loads(r.value) for r in files.read(spark, str(tmp_path / fmt), fmt).orderBy("pos").collect()]
        assert back == [{"a": [1, "x"]}, None]
    assert files.null_input(spark).first().value is None


def _drain(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"k":"x","v":1}\n{"k":"y","v":5}\n{"k":"x","v":2}\n')
    rows = spark.readStream.text(str(tmp_path / "in")).withColumn("k", F.get_json_object("value", "$.k"))
    assert sorted(r.output for r in _drain(filters.apply_stream(rows, ".v + 1"), "plain").collect()) == ["2", "3", "6"]
    assert _drain(filters.events(rows), "events").count() == 9
    fold = _drain(filters.running(rows, "k", ".[0] + .[1].v", 0), "fold")
    assert sorted((r.k, r.output) for r in fold.collect()) == [("x", "1"), ("x", "3"), ("y", "5")]
