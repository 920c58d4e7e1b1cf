"""Driver queries for sources, sinks, streams and sessions, each with SQL that must give the same rows.

A source query makes a text of each row of ``nation`` and decodes it; a sink query encodes a document of each row.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewright.operators.dynamic import apply_json
from pipewright.plans.lower import lower
from pipewright.session import Engine
from pipewright.sources import files
from pipewright.streaming import filters

_KEY = "n_nationkey"


def scratch(spark: SparkSession) -> str:
    """A folder of its own in the one that a cluster shares; on a single machine a temporary one will do."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="pipewright-")
    return f"{shared}/{uuid.uuid4().hex}"


def _rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _outputs(*texts: str) -> str:
    """SQL of n_nationkey, pos and output for the given outputs of each row."""
    return " union all ".join(f"select {_KEY}, {i}::bigint as pos, {t} as output from nation" for i, t in enumerate(texts))


#: name -> (format, Spark SQL of the text, SQL of the documents)
SOURCES: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "source_json": ("json", "concat('{\"k\": ', n_nationkey, '}\n[ null, true ] \"', n_name, '\"')", ("'{\"k\":' || n_nationkey || '}'", "'[null,true]'", "'\"' || n_name || '\"'")),
    "source_json5": ("json5", "concat('{k: +', n_nationkey, ', /* c */ \\'s\\': [0x1F, .5,], u: undefined} // end')", ("'{\"k\":' || n_nationkey || ',\"s\":[31,0.5]}'",)),
    "source_loose_json": ("j", "concat('{k: ', n_nationkey, ', n: \\'', n_name, '\\',}')", ("'{\"k\":' || n_nationkey || ',\"n\":\"' || n_name || '\"}'",)),
    "source_python": ("pylit", "concat('{\\'k\\': (None, True, ', n_nationkey, ')}')", ("'{\"k\":[null,true,' || n_nationkey || ']}'",)),
    "source_yaml": ("yaml", "concat('a: &x {k: ', n_nationkey, '}\nb: *x\n---\n- 0o17\n- ', n_name, '\n')", ("'{\"a\":{\"k\":' || n_nationkey || '},\"b\":{\"k\":' || n_nationkey || '}}'", "'[15,\"' || n_name || '\"]'")),
    "source_toml": ("toml", "concat('a.k = ', n_nationkey, '\n[[t]]\nd = 2020-01-02\n')", ("'{\"a\":{\"k\":' || n_nationkey || '},\"t\":[{\"d\":\"2020-01-02\"}]}'",)),
    "source_csv": ("csv", "concat(n_nationkey, ',\"a,\"\"b\"\"\"\n', n_name, '\n')", ("'[[\"' || n_nationkey || '\",\"a,\\\"b\\\"\"],[\"' || n_name || '\"]]'",)),
    "source_csv_header": ("csvh", "concat('k,n\n', n_nationkey, ',', n_name, ',x\n')", ("'[{\"k\":\"' || n_nationkey || '\",\"n\":\"' || n_name || '\",\"_2\":\"x\"}]'",)),
    "source_tsv": ("tsv", "concat(n_nationkey, '\t', n_name, '\n')", ("'[[\"' || n_nationkey || '\",\"' || n_name || '\"]]'",)),
    "source_tsv_header": ("tsvh", "concat('k\tn\n', n_nationkey, '\n')", ("'[{\"k\":\"' || n_nationkey || '\"}]'",)),
    "source_xml": ("xml", "concat('<a k=\"', n_nationkey, '\">', n_name, '<b/></a>')", ("'{\"name\":\"a\",\"attributes\":{\"k\":\"' || n_nationkey || '\"},\"children\":[{\"text\":\"' || n_name || '\"},{\"name\":\"b\",\"attributes\":{},\"children\":[]}]}'",)),
    "source_env": ("env", "concat('# c\nK=', n_nationkey, ' # x\nexport N=\"', n_name, '\"\n')", ("'{\"K\":\"' || n_nationkey || '\",\"N\":\"' || n_name || '\"}'",)),
    "source_program_tree": ("jq", "concat('.n', n_nationkey, ' | length')", ("'[\"pipe\",[\"field\",[\"identity\"],[\"literal\",\"n' || n_nationkey || '\"]],[\"call\",\"length\",[]]]'",)),
    "source_lines": ("raw", "concat(n_name, '\n\n', n_nationkey, '\n')", ("'\"' || n_name || '\"'", "'\"\"'", "'\"' || n_nationkey || '\"'")),
    "source_cbor": ("cbor", "concat(unhex('A1616B'), if(n_nationkey < 24, unhex(lpad(hex(n_nationkey), 2, '0')), concat(unhex('18'), unhex(hex(n_nationkey)))))", ("'{\"k\":' || n_nationkey || '}'",)),
}

_DOCUMENT = "named_struct('k', n_nationkey, 'n', n_name, 'l', array(n_regionkey, null))"
#: name -> (format, Spark SQL of the document, options, SQL of the text)
SINKS: dict[str, tuple[str, str, dict, str]] = {
    "sink_json": ("json", _DOCUMENT, {"indent": 2}, "'{\n  \"k\": ' || n_nationkey || ',\n  \"n\": \"' || n_name || '\",\n  \"l\": [\n    ' || n_regionkey || ',\n    null\n  ]\n}'"),
    "sink_json_sorted": ("json", "named_struct('n', n_name, 'k', 'é')", {"sort": True, "ascii": True}, "'{\"k\":\"\\u00e9\",\"n\":\"' || n_name || '\"}'"),
    "sink_json5": ("json5", _DOCUMENT, {}, "'{\"k\":' || n_nationkey || ',\"n\":\"' || n_name || '\",\"l\":[' || n_regionkey || ',null]}'"),
    "sink_python": ("pylit", "named_struct('k', n_nationkey, 't', true, 'z', cast(null as int))", {}, "'{\"k\":' || n_nationkey || ',\"t\":True,\"z\":None}'"),
    "sink_yaml": ("yaml", "named_struct('k', n_nationkey, 'l', array(n_regionkey, 7))", {}, "'k: ' || n_nationkey || '\nl:\n- ' || n_regionkey || '\n- 7\n'"),
    "sink_toml": ("toml", "named_struct('k', n_nationkey, 'z', cast(null as int), 't', named_struct('n', n_name))", {}, "'k = ' || n_nationkey || '\n[t]\nn = \"' || n_name || '\"\n'"),
    "sink_csv": ("csv", "array(n_name, 'a,b', '')", {}, "n_name || '\n\"a,b\"\n\"\"\n'"),
    "sink_csv_header": ("csvh", "array(named_struct('k', n_nationkey, 'n', n_name))", {}, "'k,n\n' || n_nationkey || ',' || n_name || '\n'"),
    "sink_tsv": ("tsv", "array(array(n_nationkey, n_regionkey), array(1))", {}, "n_nationkey || chr(9) || n_regionkey || '\n1' || chr(9) || '\"\"\n'"),
    "sink_xml": ("xml", "named_struct('name', 'a', 'attributes', named_struct('k', string(n_nationkey)), 'children', array(named_struct('text', concat('<', n_name))))", {}, "'<a k=\"' || n_nationkey || '\">&lt;' || n_name || '</a>'"),
    "sink_env": ("env", "named_struct('K', n_nationkey, 'N', concat(n_name, ' x'))", {}, "'K=' || n_nationkey || '\nN=''' || n_name || ' x''\n'"),
    "sink_export": ("exportenv", "array(n_nationkey)", {}, "'export _0=' || n_nationkey || '\n'"),
    "sink_raw": ("raw", "concat(n_name, '\"')", {}, "n_name || '\"'"),
}


def _source(fmt: str, text: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = _rows(spark, sf_dir, "nation").select(_KEY, F.expr(text).alias("value"))
        return files.decoded(texts, fmt, keep=(_KEY,)).select(_KEY, "pos", F.col("value").alias("output"))

    return query


def _documents(spark, sf_dir, document) -> DataFrame:
    whole = F.to_json(F.struct(F.expr(document).alias("v")), {"ignoreNullFields": "false"})
    return _rows(spark, sf_dir, "nation").select(_KEY, F.regexp_extract(whole, r'(?s)^\{"v":(.*)\}$', 1).alias("value"))


def _sink(fmt: str, document: str, options: dict):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return files.encoded(_documents(spark, sf_dir, document), fmt, keep=(_KEY,), **options)

    return query


def sink_cbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = files.encoded(_documents(spark, sf_dir, "named_struct('k', n_nationkey, 'n', n_name)"), "cbor", keep=(_KEY,))
    return made.select(_KEY, F.lower(F.hex("data")).alias("data"))


def sink_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formatter: a program's tree as a document, and its text again."""
    texts = _rows(spark, sf_dir, "nation").select(_KEY, F.expr("concat('map( .a+', n_nationkey, ')|length')").alias("value"))
    return files.encoded(files.decoded(texts, "jq", keep=(_KEY,)), "jq", keep=(_KEY,))


def _files(fmt: str, read: str | None = None, slurp: bool = False):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Documents written as files, and read again from all of them."""
        folder = scratch(spark)
        files.write(_documents(spark, sf_dir, "named_struct('k', n_nationkey, 'n', n_name)").repartition(3), folder, fmt)
        back = files.read(spark, folder, read or fmt, slurp=slurp)
        return back.select(F.col("value").alias("output")) if not slurp else apply_json(back, ".[] | .k").select("output")

    return query


def source_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark's reader on JSON lines: typed columns, with pushdown of columns."""
    folder = scratch(spark)
    files.write(_documents(spark, sf_dir, "named_struct('k', n_nationkey, 'n', n_name)"), folder, "ndjson")
    return files.table(spark, folder, "ndjson", "k long, n string").where("k > 3")


def source_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_json(files.null_input(spark), "., [range(3)]").select("pos", "output")


def source_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named and positional arguments, and a data module."""
    given = {"who": "x", "list": [1, {"a": 2}], "ARGS": {"positional": ["p"], "named": {"who": "x"}}}
    program = 'import "data" as $d; [.n_nationkey, $who, $list[1].a, $ARGS.positional[0], $ARGS.named.who, $d::d[1].v] | tojson'
    return lower(_rows(spark, sf_dir, "nation"), f".[] | {program}" if not program.startswith("import") else program.replace("; [", "; .[] | ["), variables=given, modules={"data": '1 {"v": 7}'})


def source_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "named_struct('k', n_nationkey, 'l', array(n_regionkey))")
    return filters.events(docs, keep=(_KEY,)).select(_KEY, F.col("pos").cast("long").alias("pos"), "output")


def session_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions and variables that build up, with a rollback, over a table."""
    engine = Engine(spark)
    engine.define("def scaled($n): . * $n;")
    engine.bind("base", 10)
    before = engine.checkpoint()
    engine.define("def scaled($n): 0;")
    engine.rollback(before)
    return engine.run(_rows(spark, sf_dir, "nation"), ".[] | {n_nationkey, v: (.n_regionkey | scaled(3) + $base)}", schema="n_nationkey long, v long")


def number_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold over eight million numbers, on null."""
    return lower(spark, "reduce range(1; 8000001) as $i (0; ($i * 3 + 7) as $x | if $x % 5 == 0 then . + ($x / 5 | floor) elif $x % 3 == 0 then . - $x else . + ($x % 97) end)")


def _drained(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives of what is there now."""
    folder = scratch(spark)
    name = f"s{uuid.uuid4().hex}"
    if mode == "append":
        run = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{folder}/out")
    run = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _rows(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")


def stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program on each document of a stream."""
    return _drained(spark, filters.apply_stream(_stream(spark, sf_dir), ".k + 1", "props", keep=("event_id",))).select("event_id", "output")


def stream_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``foreach`` with kept state: the greatest count that each user reaches."""
    made = _drained(spark, filters.running(_stream(spark, sf_dir).where("user_id is not null"), "user_id", ".[0] + 1", 0, "props"))
    return made.groupBy("user_id").agg(F.max(F.col("output").cast("long")).alias("n"), F.count("*").alias("steps"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of event time, with late rows left out only after a day."""
    made = _drained(spark, filters.windowed(_stream(spark, sf_dir), "ts", "1 hour", "1 day", ("event_type",), n=F.count("*")), "complete")
    return made.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


OTHERS = {
    "sink_cbor": (sink_cbor, "select n_nationkey, 'a2616b' || case when n_nationkey < 24 then lpad(lower(to_hex(n_nationkey)), 2, '0') else '18' || lower(to_hex(n_nationkey)) end || '616e' || lower(to_hex(96 + length(n_name))) || lower(hex(encode(n_name))) as data from nation"),
    "sink_program": (sink_program, "select n_nationkey, 'map(.a + ' || n_nationkey || ') | length' || chr(10) as data from nation"),
    "files_lines": (_files("ndjson"), "select '{\"k\":' || n_nationkey || ',\"n\":\"' || n_name || '\"}' as output from nation"),
    "files_yaml": (_files("yaml"), "select '{\"k\":' || n_nationkey || ',\"n\":\"' || n_name || '\"}' as output from nation"),
    "files_json_documents": (_files("ndjson", "json"), "select '{\"k\":' || n_nationkey || ',\"n\":\"' || n_name || '\"}' as output from nation"),
    "files_slurped": (_files("ndjson", "json", True), "select n_nationkey::varchar as output from nation"),
    "source_typed": (source_typed, "select n_nationkey::bigint as k, n_name as n from nation where n_nationkey > 3"),
    "source_null": (source_null, "select 0 as pos, 'null' as output union all select 1, '[0,1,2]'"),
    "source_bindings": (source_bindings, "select '\"[' || n_nationkey || ',\\\"x\\\",2,\\\"p\\\",\\\"x\\\",7]\"' as value from nation"),
    "source_events": (source_events, _outputs("'[[\"k\"],' || n_nationkey || ']'", "'[[\"l\",0],' || n_regionkey || ']'", "'[[\"l\",0]]'", "'[[\"l\"]]'")),
    "session_program": (session_program, "select n_nationkey::bigint as n_nationkey, (n_regionkey * 3 + 10)::bigint as v from nation"),
    "number_fold": (number_fold, "select sum(case when x % 5 = 0 then x // 5 when x % 3 = 0 then -x else x % 97 end)::bigint as value from (select i * 3 + 7 as x from range(1, 8000001) t(i))"),
    "stream_rows": (stream_rows, "select event_id, (json_extract_string(props, '$.k')::bigint + 1)::varchar as output from events"),
    "stream_folds": (stream_folds, "select user_id, count(*) as n, count(*) as steps from events where user_id is not null group by 1"),
    "stream_windows": (stream_windows, "select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n from events group by 1, 2"),
}


def queries():
    made = {n: _source(f, t) for n, (f, t, _) in SOURCES.items()} | {n: _sink(f, d, o) for n, (f, d, o, _) in SINKS.items()}
    return made | {n: q for n, (q, _) in OTHERS.items()}


def oracle_sql():
    made = {n: _outputs(*docs) for n, (_, _, docs) in SOURCES.items()} | {n: f"select {_KEY}, {s} as data from nation" for n, (_, _, _, s) in SINKS.items()}
    return made | {n: s for n, (_, s) in OTHERS.items()}
