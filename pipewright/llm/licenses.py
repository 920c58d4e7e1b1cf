"""Licence scans with DataFrame functions only: sparse TF-IDF cosine to templates, then inheritance along paths.

Every line of a text is a candidate when it shares a content word with a template; all others have cosine 0.  Equal
candidates are scored once, under a key of 128 bits of their hash.  Document frequencies are counted over all lines
that have a content word.  A line's licence is
the template of the highest cosine, if that is ``THRESHOLD`` or more; a file's licence is that of its best line (ties:
the smaller name).  A file's whole term vector is scored against the full texts in ``licence_texts`` too, with document
frequencies over all files; at ``FILE_THRESHOLD`` or more it is a licence file of the best text's licence and score.  So
is, with its best line's, a file whose words are at least half in licence lines.  A licence file gives its licence to
its directory (the best score, then the smaller name).  A file without a licence takes that of its nearest ancestor
directory that has one, by an equi-join on all ancestors of its path.

Defined results: null and empty texts have no licence of their own; a null path has no ancestors; rows repeated are
scored alike and all returned; an empty table gives an empty result; other columns are not looked at.  A text of any
length is read as a whole, its lines as rows.  Scores are rounded to 6 digits.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, stored, table
from .fingerprint import _let

THRESHOLD, FILE_THRESHOLD = 0.55, 0.8
#: Shares into which the files of one line are dealt: a line that a third of all files have is no single task's work.
SALTS = 64

#: Notices by which public licences ask to be named; fixed values.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "Released to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Proprietary", "Copyright All rights reserved"),
)
#: name#number of each notice, and its words.
_NOTICES = [(f"{name}#{k:02d}", body) for k, (name, body) in enumerate(TEMPLATES)]
STOP_WORDS = ("a", "all", "and", "are", "at", "by", "form", "in", "is", "of", "or", "terms", "the", "this", "to", "under", "use", "with")


def _terms(text):
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def _key(line: str):
    """128 bits of the line's SHA-256: shuffles carry it in place of the line."""
    return F.substring(F.unhex(F.sha2(F.col(line), 256)), 1, 16)


def template_terms(spark: SparkSession) -> DataFrame:
    """template, term, tf of TEMPLATES: a table of fixed size."""
    rows = spark.createDataFrame(_NOTICES, "template string, body string")
    return rows.select("template", F.explode(_terms(F.col("body"))).alias("term")).groupBy("template", "term").agg(F.count("*").alias("tf"))


def full_terms(spark: SparkSession) -> DataFrame:
    """template, term, tf of the licences' full texts: a table of fixed size."""
    texts = [(p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
    rows = spark.createDataFrame(texts, "template string, body string")
    return rows.select("template", F.explode(_terms(F.col("body"))).alias("term")).groupBy("template", "term").agg(F.count("*").alias("tf"))


def _counts(terms):
    """array<struct<term, tf>> of an array of terms."""
    runs = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    count = lambda s, at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("tf")))
    return F.when(F.size(terms) > 0, _let(F.sort_array(terms), lambda s: _let(runs(s), lambda at: count(s, at))))


def _heaviest(rows, share: float) -> set[str]:
    """Of (template, term, v): for each template the heaviest terms until they are more than ``share`` of its square."""
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r["template"], []).append((r["v"] ** 2, r["term"]))
    out = set()
    for terms in by.values():
        left = share * sum(v for v, _ in terms) * (1 + 1e-9)
        for v, term in sorted(terms, reverse=True):
            if left < 0:
                break
            out.add(term)
            left -= v
    return out


def licence_files(files: DataFrame, threshold: float = FILE_THRESHOLD) -> DataFrame:
    """file_id, path, w (s: minus the cosine, template) of the files whose whole text is near to a licence's full text."""
    spark = files.sparkSession
    texts = files.select("file_id", "path", F.coalesce("text", F.lit("")).alias("text"))
    words = texts.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    frequency = stored(words.groupBy("term").agg(F.count("*").alias("df")))
    n = files.count()
    idf = F.log((F.lit(1.0) + n) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0
    full = stored(full_terms(spark).join(frequency, "term", "left").select("template", "term", idf.alias("idf"), (F.col("tf") * idf).alias("v")))
    sizes = full.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
    # a text without any of a template's heaviest terms, which are more than 1 - threshold**2 of its square, is not near it
    heavy = sorted(_heaviest(full.select("template", "term", "v").collect(), 1 - threshold**2))  # of the fixed table
    some = F.arrays_overlap(_terms(F.col("text")), F.array(*map(F.lit, heavy)))
    # no cosine is above the share of known terms in a vector's length, and no idf of the others is below 1
    known = full.select("term", "idf").distinct()
    # the key is taken before the rows are spread: else it is computed again for every term
    parts = texts.where(some).select("file_id", "path", _key("text").alias("key"), _counts(_terms(F.col("text"))).alias("terms")).select("file_id", "path", "key", F.inline("terms")).join(F.broadcast(known), "term", "left")
    square = F.col("tf") * F.col("tf")
    bound = parts.groupBy("file_id", "path", "key").agg(F.coalesce(F.sum(square * F.col("idf") * F.col("idf")), F.lit(0.0)).alias("a"), F.sum(F.when(F.col("idf").isNull(), square).otherwise(0)).alias("b"))
    salt = F.pmod(F.xxhash64("file_id"), F.lit(SALTS)).alias("salt")
    near = stored(bound.where(F.col("a") * (1 + 1e-9) >= threshold**2 * (F.col("a") + F.col("b"))).select("file_id", "path", "key", salt))
    salted = near.select("key", "salt").distinct()
    keys = salted.select("key").distinct()
    if keys.count() <= 100_000:  # 16 bytes each; more are joined by a shuffle of the texts
        keys = F.broadcast(keys)
    once = texts.select("text", _key("text").alias("key")).join(keys, "key", "left_semi").groupBy("key").agg(F.any_value("text").alias("text"))
    terms = stored(once.select("key", _counts(_terms(F.col("text"))).alias("terms")).select("key", F.inline("terms")))
    norms = terms.join(frequency, "term").groupBy("key").agg(F.sqrt(F.sum((F.col("tf") * idf) ** 2)).alias("norm"))
    dots = terms.join(F.broadcast(full), "term").groupBy("key", "template").agg(F.sum(F.col("tf") * F.col("idf") * F.col("v")).alias("dot"))
    scored = dots.join(norms, "key").join(F.broadcast(sizes), "template").select("key", "template", F.round(F.col("dot") / (F.col("norm") * F.col("size")), 6).alias("score"))
    best = scored.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "template")).alias("w")).where(-F.col("w.s") >= threshold)
    return near.join(salted.join(best, "key"), ["key", "salt"]).select("file_id", "path", "w")


def line_frequencies(files: DataFrame) -> tuple[DataFrame, int]:
    """term, df over all lines of ``text`` that have a content word, and the number of those lines."""
    lines = files.select(F.explode(F.split("text", r"\n")).alias("line")).select(F.array_distinct(_terms(F.col("line"))).alias("terms")).where(F.size("terms") > 0)
    # each task sums up its terms before they are dealt out; the null term counts the lines
    counts = stored(lines.select(F.explode(F.concat("terms", F.array(F.lit(None).cast("string")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    n = counts.where("term is null").select("df").first()
    return counts.where("term is not null"), n.df if n else 0


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``files`` (file_id, path, text) as file_id, path, license, score, origin.

    origin: "header", "file" (a licence file), "inherited", or null without a licence.
    """
    spark = files.sparkSession
    vocabulary = sorted({w for _, body in TEMPLATES for w in "".join(c if c.isalnum() else " " for c in body.lower()).split()} - set(STOP_WORDS))
    known = F.array(*map(F.lit, vocabulary))
    rows = files.select("file_id", "path", F.transform(F.split(F.coalesce("text", F.lit("")), r"\n"), _terms).alias("lines"))
    words = F.aggregate("lines", F.lit(0), lambda n, x: n + F.size(x))
    lines = rows.select("file_id", "path", words.alias("words"), F.explode_outer(F.filter("lines", lambda x: F.arrays_overlap(x, known))).alias("terms"))
    salt = F.pmod(F.xxhash64("file_id"), F.lit(SALTS)).alias("salt")
    found = stored(lines.withColumn("line", F.array_join("terms", " ")).select("file_id", "path", "words", F.size("terms").alias("size"), "line", _key("line").alias("key"), salt))
    parts = found.where("line is not null").groupBy("key", "salt").agg(F.count("*").alias("n"), F.any_value("line").alias("line"))
    segments = parts.groupBy("key").agg(F.sum("n").alias("n"), F.any_value("line").alias("line"))
    terms = stored(segments.select("key", "n", F.explode(F.split("line", " ")).alias("term")).groupBy("key", "n", "term").agg(F.count("*").alias("tf")))
    frequency, n = line_frequencies(files)
    idf = lambda df: F.log((F.lit(1.0) + n) / (1.0 + F.coalesce(df, F.lit(0)))) + 1.0
    norms = terms.join(frequency, "term").groupBy("key").agg(F.sqrt(F.sum((F.col("tf") * idf(F.col("df"))) ** 2)).alias("norm"))
    template = template_terms(spark).join(frequency, "term", "left").select("template", "term", idf(F.col("df")).alias("idf"), (F.col("tf") * idf(F.col("df"))).alias("v"))
    sizes = template.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
    dots = terms.join(F.broadcast(template), "term").groupBy("key", "template").agg(F.sum(F.col("tf") * F.col("idf") * F.col("v")).alias("dot"))  # the templates' fixed table
    scored = dots.join(norms, "key").join(F.broadcast(sizes), "template").select("key", "template", F.round(F.col("dot") / (F.col("norm") * F.col("size")), 6).alias("score"))
    best = scored.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "template")).alias("b")).where(-F.col("b.s") >= threshold)
    spread = found.where("line is not null").select("key", "salt").distinct().join(best, "key")
    judged = found.select("file_id", "path", "words", "size", "key", "salt").join(spread, ["key", "salt"], "left").drop("key", "salt")
    licensed = F.col("b").isNotNull() & (2 * F.col("licensed") >= F.col("words"))
    own = checkpoint(
        judged.unionByName(licence_files(files), allowMissingColumns=True).groupBy("file_id", "path").agg(
            F.min("b").alias("b"), F.min("w").alias("w"), F.first("words", ignorenulls=True).alias("words"), F.sum(F.when(F.col("b").isNotNull(), F.col("size")).otherwise(0)).alias("licensed")
        ).select("file_id", "path", F.coalesce("w.template", F.substring_index("b.template", "#", 1)).alias("license"), F.coalesce(-F.col("w.s"), -F.col("b.s")).alias("score"), (F.col("w").isNotNull() | licensed).alias("is_file"))
    )
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    given = own.where("is_file and path like '%/%'").groupBy(parent.alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("g"))
    parts = F.split(F.col("path"), "/")
    ancestors = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("dir"))))
    bare = own.where("license is null").select("file_id", "path", F.explode(ancestors).alias("a")).select("file_id", "path", "a.depth", "a.dir")
    taken = bare.join(given, "dir").groupBy("file_id", "path").agg(F.max_by("g", "depth").alias("g"))
    key = lambda df: df.withColumnsRenamed({"file_id": "_f", "path": "_p"})
    on = F.col("file_id").eqNullSafe(F.col("_f")) & F.col("path").eqNullSafe(F.col("_p"))
    origin = F.when(F.col("is_file"), "file").when(F.col("license").isNotNull(), "header").when(F.col("g").isNotNull(), "inherited")
    out = own.join(key(taken), on, "left").select(
        "file_id", "path", F.coalesce("license", "g.license").alias("license"), F.coalesce("score", -F.col("g.s")).alias("score"), origin.alias("origin")
    )
    repeated = files.groupBy("file_id", "path").agg(F.count("*").alias("copies")).where("copies > 1")
    if repeated.isEmpty():
        return out
    each = F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)).cast("int"))).alias("_n")
    return out.join(key(repeated), on, "left").select("file_id", "path", "license", "score", "origin", each).drop("_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 over ``documents``, as files source/lang/doc_id."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    return scan(files).select(F.col("file_id").alias("doc_id"), "license", "score", "origin")


def _sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in _NOTICES)
    stop = ", ".join(map(quote, STOP_WORDS))
    words = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' and w not in ({stop}))"
    return f"""
with raw(template, body) as (values {templates}),
tt as (select template, term, count(*) as tf from (select template, unnest({words('body')}) as term from raw) group by all),
docs as (select doc_id, concat_ws('/', source, lang, doc_id::varchar) as path, coalesce(text, '') as text from documents),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from docs),
found as (select doc_id, array_to_string(t, ' ') as line, len(t) as n from (select doc_id, {words('line')} as t from lines)
          where list_has_any(t, (select list(distinct term) from tt))),
seg as (select line, count(*) as n from found group by line),
terms as (select line, n, term, count(*) as tf from (select line, n, unnest(string_split(line, ' ')) as term from seg) group by all),
every as (select list_distinct({words('line')}) as t from lines),
df as (select term, count(*) as df from (select unnest(t) as term from every) group by term),
total as (select count(*) as n from every where len(t) > 0),
w as (select line, t.term, tf * (ln((1.0 + total.n) / (1.0 + df)) + 1.0) as w from terms t join df using (term), total),
v as (select template, tt.term, tf * (ln((1.0 + total.n) / (1.0 + coalesce(df, 0))) + 1.0) as v from tt left join df using (term), total),
scored as (select line, template, round(dot / (norm * size), 6) as score
  from (select line, template, sum(w * v) as dot from w join v using (term) group by all)
  join (select line, sqrt(sum(w * w)) as norm from w group by line) using (line)
  join (select template, sqrt(sum(v * v)) as size from v group by template) using (template)),
best as (select line, template, score from scored where score >= {THRESHOLD}
  qualify row_number() over (partition by line order by score desc, template) = 1),
hit as (select doc_id, template, score, n from found join best using (line)),
own as (select doc_id, path, h.license, h.score, h.license is not null and 2 * licensed >= len({words('text')}) as is_file
  from docs left join (select doc_id, sum(n) as licensed,
    split_part((list(template order by score desc, template))[1], '#', 1) as license, max(score) as score from hit group by doc_id) h using (doc_id)),
dirs as (select regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, (list(license order by score desc, license))[1] as license, max(score) as score
  from own where is_file group by 1),
up as (select doc_id, string_split(path, '/') as parts from own where license is null),
chain as (select doc_id, unnest(range(1, len(parts))) as depth, parts from up),
taken as (select doc_id, d.license, d.score from chain join dirs d on d.dir = array_to_string(parts[1:depth], '/')
  qualify row_number() over (partition by doc_id order by depth desc) = 1)
select own.doc_id, coalesce(own.license, taken.license) as license, coalesce(own.score, taken.score) as score,
  case when is_file then 'file' when own.license is not null then 'header' when taken.license is not null then 'inherited' end as origin
from own left join taken using (doc_id)
"""


ORACLE = _sql()
