"""Files of documents as DataFrames of JSON text, and back.

Formats of lines (ndjson, raw) are split among tasks; the others are decoded a file a task, as their grammars need, so a
file must fit a worker.  ``table`` is the way for large typed data: Spark's own readers, with their pushdown.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewright.lang.values import FilterError, dumps, loads

from .formats import SEPARATORS, by_extension, canonical, decode, encode

#: Spark's options for relaxed JSON.
_RELAXED = {"allowComments": "true", "allowUnquotedFieldNames": "true", "allowSingleQuotes": "true", "allowNumericLeadingZeros": "true", "allowNonNumericNumbers": "true"}


def read(spark: SparkSession, paths: str | list[str], fmt: str | None = None, slurp: bool = False, errors: str = "raise") -> DataFrame:
    """file, pos (order within a file), value (JSON text) and error of every document.

    ``slurp``: one array for each file.  ``errors="keep"``: a broken document ends its file with a row that says why.
    """
    paths = [paths] if isinstance(paths, str) else paths
    fmt = canonical(fmt) if fmt else by_extension(paths[0])
    if fmt in ("ndjson", "raw") and not slurp:
        lines = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"), F.col("value"))
        if fmt == "ndjson":
            return lines.where(F.trim("value") != "").withColumn("error", F.lit(None).cast("string"))
        quoted = F.regexp_extract(F.to_json(F.struct(F.col("value").alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
        return lines.select("file", "pos", quoted.alias("value"), F.lit(None).cast("string").alias("error"))

    def work(batches):
        for b in batches:
            for file, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                values, bad = [], None
                try:
                    for x in decode(data.as_py(), fmt):
                        values.append(dumps(x))
                except (FilterError, ValueError, RecursionError) as e:
                    if errors == "raise":
                        raise
                    bad = str(e)
                if slurp and bad is None:
                    values = ["[" + ",".join(values) + "]"]
                n = len(values) + (bad is not None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(values + [None] * (n - len(values)), pa.string()), pa.array([None] * len(values) + [bad] * (n - len(values)), pa.string())],
                    ["file", "pos", "value", "error"],
                )

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(work, "file string, pos long, value string, error string")


def table(spark: SparkSession, paths: str | list[str], fmt: str, schema=None) -> DataFrame:
    """Typed rows by Spark's readers: JSON documents of a line, or tables with or without a header."""
    fmt, reader = canonical(fmt), spark.read if schema is None else spark.read.schema(schema)
    if fmt in ("json", "ndjson"):
        return reader.json(paths)
    if fmt in ("json5", "j"):
        return reader.options(**_RELAXED).json(paths)
    if fmt in ("csv", "csvh", "tsv", "tsvh"):
        return reader.options(sep="," if fmt[0] == "c" else "\t", header=str(fmt.endswith("h")).lower(), multiLine="true", escape='"').csv(paths)
    raise ValueError(f"{fmt} has no typed reader; use read()")


def decoded(df: DataFrame, fmt: str, column: str = "value", keep: tuple[str, ...] = (), errors: str = "raise") -> DataFrame:
    """``keep`` columns, pos, value (JSON text) and error of the documents in each row's text (or bytes) in a format."""
    fmt = canonical(fmt)

    def work(batches):
        for b in batches:
            source, pos, values, bad = [], [], [], []
            for i, data in enumerate(b.column(column).to_pylist()):
                k = 0
                try:
                    for x in decode(data, fmt) if data is not None else ():
                        source.append(i), pos.append(k), values.append(dumps(x)), bad.append(None)
                        k += 1
                except (FilterError, ValueError, RecursionError) as e:
                    if errors == "raise":
                        raise
                    source.append(i), pos.append(k), values.append(None), bad.append(str(e))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(pa.array(source, pa.int64())) for c in keep), pa.array(pos, pa.int64()), pa.array(values, pa.string()), pa.array(bad, pa.string())],
                [*keep, "pos", "value", "error"],
            )

    kept = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return df.select(*dict.fromkeys((*keep, column))).mapInArrow(work, kept + "pos long, value string, error string")


def null_input(spark: SparkSession) -> DataFrame:
    """One row of null: a program's input when there is none."""
    return spark.range(1).select(F.lit(None).cast("string").alias("value"))


def encoded(df: DataFrame, fmt: str, column: str = "value", keep: tuple[str, ...] = (), **options) -> DataFrame:
    """``keep`` columns and ``data``: each document of JSON text in the format (binary for cbor, else text)."""
    fmt = canonical(fmt)
    out = pa.binary() if fmt == "cbor" else pa.string()

    def work(batches):
        for b in batches:
            made = [encode(None if x is None else loads(x), fmt, **options) for x in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(made, out)], [*keep, "data"])

    kept = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return df.select(*dict.fromkeys((*keep, column))).mapInArrow(work, kept + f"data {'binary' if fmt == 'cbor' else 'string'}")


def write(df: DataFrame, path: str, fmt: str = "ndjson", column: str = "value", mode: str = "errorifexists", ends: str = "\n", **options) -> None:
    """Documents as text files; ``ends`` closes each one (a line end, or NUL for raw texts) and is not empty.

    CBOR holds one item a file, which Spark's writers cannot make: take ``encoded``.
    """
    fmt = canonical(fmt)
    if fmt == "cbor" or not ends:
        raise ValueError("cbor has no text sink; use encoded()" if ends else "ends must not be empty")
    data = encoded(df, fmt, column, **options)
    if fmt in SEPARATORS:
        data = data.select(F.concat(F.lit(SEPARATORS[fmt]), F.regexp_replace("data", r"\n$", "")).alias("data"))
    elif fmt not in ("json", "ndjson", "json5", "j", "pylit", "xml", "raw"):
        data = data.select(F.regexp_replace("data", r"\n$", "").alias("data"))
    data.write.mode(mode).option("lineSep", ends).text(path)
