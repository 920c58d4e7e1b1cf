"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

Each normalised text (A-Z lower-cased, null as empty) is cut where its own content says so: a chunk runs for at least
``CHUNK_MIN`` code points to the next sentence mark or line end, or for ``CHUNK_MAX`` at most.  A chunk gets an
identifier that is verified by itself, 128 bits of the SHA-256 of its bytes, so that equal chunks anywhere have one and
different ones two.  A recipe is the ordered list of a text's identifiers; texts are equal when their recipes are and,
as a check, the SHA-256 of the whole texts.  No text is shuffled, only recipes, which are a tenth of their texts or less.
Groups of more than ``HOT`` rows (and so at most a bounded number) are joined back by broadcast, so that one
text that a third of all rows have is no single task's work.

Defined results: null equals empty; ids that are null never win against others; rows repeated with id and text are
separate rows of which one stays; an empty table gives an empty result; other columns are kept whatever their names.  A
text of any length is chunked as a whole, one row at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, fresh, join_back, table

CHUNK_MIN, CHUNK_MAX = 192, 2048
_CHUNKS = rf"(?s).{{{CHUNK_MIN},{CHUNK_MAX - 1}}}?[.!?\n]|.{{1,{CHUNK_MAX}}}"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text):
    """A-Z lower-cased and nothing else; null as empty.  Where lower() does just that, it is used as the faster one."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 and recipe: the identifiers of each text's chunks, in order."""
    chunks = docs.select("doc_id", normalised(F.col("text")).alias("_t")).select(
        "doc_id", F.sha2("_t", 256).alias("text_sha256"), F.regexp_extract_all("_t", F.lit(_CHUNKS), F.lit(0)).alias("_c")
    )
    identifier = lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 32))
    return chunks.select("doc_id", "text_sha256", F.transform("_c", identifier).alias("recipe"))


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    made = checkpoint(recipes(docs))
    digest = (F.xxhash64("recipe").alias("a"), F.xxhash64(F.lit(7), "recipe").alias("b"))  # what a recipe is joined by
    rows = made.groupBy("recipe", "text_sha256", "doc_id").agg(F.count("*").alias("copies")).select(*digest, "text_sha256", "doc_id", "copies")
    groups = made.groupBy("recipe", "text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).select(*digest, "text_sha256", "keep_id", "group_size")
    joined = join_back(rows, groups, ["a", "b", "text_sha256"], "group_size", made.count())
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_n") == 1)
    return joined.select("doc_id", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_n")).select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of equal texts the one with the largest doc_id."""
    own, key, other = (fresh(docs, x) for x in ("_sha", "_id", "_sha2"))
    stay = duplicate_groups(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(other))
    marked = docs.withColumn(own, F.sha2(normalised(F.col("text")), 256))
    out = marked.join(stay, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(other)), "left_semi")
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    return (out if repeated.isEmpty() else out.dropDuplicates(["doc_id", own])).drop(own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
from t window w as (partition by t)
"""
