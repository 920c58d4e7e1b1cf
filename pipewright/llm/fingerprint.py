"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text is the list of its words (runs without white space).  A window of K = 4 words, each of them an inner substring
of s = 1 word, is a closed syncmer when its smallest word hash is at an edge; whether it is depends on the window
alone, so that edits elsewhere move no anchor.  The fingerprint is the 64 smallest distinct anchor hashes of 31 bits,
as hex; a text without a closed syncmer, as any of fewer than K words, has one anchor, the hash of all its words.

Two texts are compared by positional matching of all their anchors: the k-th occurrence of an anchor in one matches the
k-th in the other, and of the matches, in the order of the first text, those count that lie in the second text behind the
match before them (the first one counts).  The likeness is the Dice coefficient of what counts; two empty texts have 1.

``next`` is the next document in descending doc_id order (null ids last, equal ids by a hash of the text; after the
last comes the first).  Rows repeated with id and text count as one document there and get equal results.  The order
is found on ids alone, by ranges; a text is moved once, and as much of it as its predecessor's edit takes once more.
Null texts are empty; an empty table gives an empty result; other columns are not looked at; a text of any length is
fingerprinted as a whole, in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table

K, SIZE = 4, 64


def _let(value, body):
    """``body(value)`` with the value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hashes(text):
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _anchor(h, i):
    a, b, c, d = (F.get(h, i + j) for j in range(K))
    return F.when(F.least(a, d) <= F.least(b, c), F.shiftrightunsigned(F.xxhash64(a, b, c, d), 33).cast("int"))


def syncmers(text):
    """array<struct<position int, hash int>>: every closed syncmer of a text and the index of its first word."""
    return _let(
        _hashes(text),
        lambda h: F.filter(
            F.when(F.size(h) >= K, F.transform(F.sequence(F.lit(0), F.size(h) - K), lambda i: F.struct(i.alias("position"), _anchor(h, i).alias("hash")))).otherwise(
                F.array().cast("array<struct<position:int,hash:int>>")
            ),
            lambda s: s["hash"].isNotNull(),
        ),
    )


_LOW = (1 << 32) - 1


def anchors(text):
    """The hashes of all anchors of a text, in its order: the index of one is its place among them."""
    none = F.array().cast("array<int>")
    found = lambda h: F.when(F.size(h) >= K, F.array_compact(F.transform(F.sequence(F.lit(0), F.size(h) - K), lambda i: _anchor(h, i)))).otherwise(none)
    whole = lambda h: F.when(F.size(h) > 0, F.array(F.shiftrightunsigned(F.xxhash64(h), 33).cast("int"))).otherwise(none)
    return _let(_hashes(text), lambda h: _let(found(h), lambda a: F.when(F.size(a) > 0, a).otherwise(whole(h))))


def sketch(hashes):
    """The smallest distinct hashes of ``anchors``, ascending: the printed digest."""
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, SIZE)


def numbered(hashes):
    """The distinct numbers of ``anchors``, ascending: the k-th occurrence of a hash is hash * 2**32 + k, k from 0; and
    their places, as struct<n, p>."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.shiftleft(h.cast("long"), 32) + i))
    hash_ = lambda a, i: F.shiftright(F.get(a, i), 32)
    starts = lambda a: F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (hash_(a, i) != hash_(a, i - 1)))
    run = lambda a, at: F.flatten(
        F.transform(at, lambda i, j: F.transform(F.sequence(F.lit(0), F.coalesce(F.get(at, j + 1), F.size(a)) - i - 1), lambda k: F.shiftleft(hash_(a, i), 32) + k))
    )
    none = F.array().cast("array<long>")
    return _let(
        placed,
        lambda a: F.struct(
            F.when(F.size(a) > 0, _let(starts(a), lambda at: run(a, at))).otherwise(none).alias("n"), F.transform(a, lambda x: x.bitwiseAND(F.lit(_LOW)).cast("int")).alias("p")
        ),
    )


def as_text(numbers):
    return F.array_join(F.transform(numbers, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def matches(a, b):
    """array<long>: position in the first text * 2**32 + position in the second, ascending, of all anchors that match."""
    # both lists of distinct numbers, sorted together, with where they came from: equal neighbours match
    tagged = lambda x, k: F.transform(x["n"], lambda n, i: F.struct(n.alias("n"), F.lit(k).alias("k"), F.get(x["p"], i).alias("p")))
    pairs = lambda s: F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: F.get(s, i)["n"] == F.get(s, i - 1)["n"]),
        lambda i: F.shiftleft(F.get(s, i - 1)["p"].cast("long"), 32) + F.get(s, i)["p"],
    )
    return F.sort_array(_let(F.sort_array(F.concat(tagged(a, 0), tagged(b, 1))), pairs))


def likeness(a, b):
    """0 to 1: the Dice coefficient of the anchors that match in order, from two columns of ``numbered``."""
    total = F.size(a["n"]) + F.size(b["n"])
    second = lambda x: x.bitwiseAND(F.lit(_LOW))
    inline = lambda m: F.size(F.filter(m, lambda x, i: (i == 0) | (second(x) > second(F.get(m, i - 1)))))
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * _let(matches(a, b), inline) / F.greatest(total, F.lit(1)))


def following(keys: DataFrame) -> DataFrame:
    """For distinct (nul, kid, xh, n): the key of the next one in the order, cyclic, as pre_* of the row that needs it.

    Returns nul, kid, xh (a document) and p_nul, p_kid, p_xh, need (the document before it and how many code points
    of this one its edit takes).  No task sees more than one range of the keys, or one row for each range.
    """
    order = [F.col("nul"), F.col("kid").desc(), F.col("xh")]
    dealt = checkpoint(keys.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()))
    w = Window.partitionBy("pid").orderBy(*order)
    key = F.struct("nul", "kid", "xh")
    led = dealt.select("*", F.lead(key).over(w).alias("nx"), F.row_number().over(w).alias("rn"))
    firsts = led.where("rn = 1").select("pid", key.alias("f"))
    one = Window.orderBy("pid")
    wrap = F.first("f").over(one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    starts = firsts.select("pid", F.coalesce(F.lead("f").over(one), wrap).alias("after"))
    return led.join(starts, "pid").select(F.coalesce("nx", "after").alias("x"), "nul", "kid", "xh", "n").select(
        "x.nul", "x.kid", "x.xh", F.col("nul").alias("p_nul"), F.col("kid").alias("p_kid"), F.col("xh").alias("p_xh"), F.floor(F.col("n") / 2).cast("int").alias("need")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of op7 for documents (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    nul = F.col("doc_id").isNull()
    keyed = docs.select(nul.alias("nul"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("kid"), F.xxhash64(text).alias("xh"), text.alias("text"))
    keys = checkpoint(keyed.groupBy("nul", "kid", "xh").agg(F.max(F.char_length("text")).alias("n"), F.count("*").alias("copies")))
    unique = keys.where("copies > 1").isEmpty()
    # texts are moved as they are: anchors hardly compress, and are found again where they are needed
    before = keyed.join(following(keys.drop("copies")), ["nul", "kid", "xh"]).select(
        F.col("p_nul").alias("nul"), F.col("p_kid").alias("kid"), F.col("p_xh").alias("xh"), F.expr("left(text, need)").alias("head"), anchors(F.col("text")).alias("next_fp")
    )
    if not unique:
        before = before.dropDuplicates(["nul", "kid", "xh"])
    n = F.char_length("text")
    both = keyed.join(before, ["nul", "kid", "xh"]).withColumn("edited", F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) as int))"), "head"))
    done = both.select(
        F.when(~F.col("nul"), F.col("kid")).alias("doc_id"), n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), anchors(F.col("text")).alias("fp"), "next_fp", anchors(F.col("edited")).alias("ed_fp")
    )
    full = done.select(
        "doc_id", "n_chars", "edited_sha256", as_text(sketch(F.col("fp"))).alias("fingerprint"), as_text(sketch(F.col("ed_fp"))).alias("edited_fingerprint"),
        numbered(F.col("fp")).alias("a"), numbered(F.col("ed_fp")).alias("b"), numbered(F.col("next_fp")).alias("c"),
    )
    return full.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
