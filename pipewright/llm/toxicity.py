"""Toxicity: a linear classifier whose score changes little when identity terms are swapped.

Features are the distinct words of a text and their prefixes of 4 and 5 bytes, hashed to 2**20 columns, so that
inflected forms share evidence.  Training takes a bounded sample of labelled rows (``max_per_class``), keeps the
columns that separate the classes best, and fits a logistic regression with three penalties: L2, an L1 step that
zeroes weak columns, and the counterfactual term ``fairness * mean((z(x) - z(swap(x)))**2)``, in which ``swap``
replaces every identity term of a labelled text by another one of its group.  Where no labelled text has such a term the
penalty is nothing, and the model a plain logistic regression.  At most ``max_columns`` columns are fitted, those whose
shares in the classes differ by more than 1.5 standard errors.  Scoring is one pass over the corpus without a
shuffle; the model is a fixed-size table.

Defined results: a null or empty text has no feature and gets the score of the intercept; a null id is never held
out and is not learnt from; repeated rows are scored alike; with no labelled rows of both classes every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NON_ALNUM, held_out, slices, span_hasher, table, text_view, tidy, words

BITS = 20

#: Identity terms that take each other's place, by group and language; fixed values, lower case.
IDENTITY_GROUPS = (
    ("woman", "man"), ("women", "men"), ("gay", "lesbian", "straight", "trans"), ("black", "white", "asian", "latino"),
    ("muslim", "jewish", "christian", "hindu", "buddhist", "atheist"), ("immigrant", "refugee"), ("disabled", "blind", "deaf"), ("old", "young"),
    ("frau", "mann"), ("schwarz", "weiß"), ("muslimisch", "jüdisch", "christlich"), ("femme", "homme"), ("noir", "blanc"),
    ("musulman", "juif", "chrétien"), ("mujer", "hombre"), ("negro", "blanco"), ("musulmán", "judío", "cristiano"),
)


def _lower(column: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.utf8_lower(column)


def _features(raw, at):
    """(rows, columns, word starts, word ends) of all words and prefixes of a slice; columns repeat in a row."""
    starts, ends, rows = words(raw, at, NON_ALNUM)
    hashes = span_hasher(raw)
    parts, owners = [], []
    for kind, stop in ((1, ends), (2, np.minimum(starts + 4, ends)), (3, np.minimum(starts + 5, ends))):
        parts.append(((hashes(starts, stop) + np.uint64(kind * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(rows)
    return owners, parts, starts, ends


def _distinct(rows, columns):
    key = np.unique(rows.astype(np.int64) << BITS | columns)
    return key >> BITS, key & ((1 << BITS) - 1)


def columns_of(text: str) -> np.ndarray:
    """The distinct feature columns of one text."""
    raw, at = text_view(_lower(pa.array([text or ""])))
    owners, parts, _, _ = _features(raw, at)
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def swapped(text: str, groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS) -> str:
    """The text in lower case, with each identity term replaced by the next one of its group.  Words end where letters
    and digits do, so that marks beside a term do not hide it."""
    following = {a: b for g in groups for a, b in zip(g, g[1:] + g[:1], strict=True)}
    out, word = [], []
    for c in (text or "").lower() + "\0":
        if c.isalnum():
            word.append(c)
        else:
            if word:
                w = "".join(word)
                out.append(following.get(w, w))
                word = []
            out.append(c)
    return "".join(out)[:-1]


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray  # float32, 2**BITS
    intercept: float
    constant: float | None = None

    def score_batch(self, column: pa.Array) -> np.ndarray:
        """Scores of an Arrow string column, 0 to 1."""
        raw, at = text_view(_lower(column))
        z = np.full(len(at) - 1, self.intercept)
        if self.constant is not None:
            return np.full(len(at) - 1, self.constant)
        for i, j in slices(at):
            part = raw[at[i] : at[j]]
            owners, parts, _, _ = _features(part, at[i : j + 1] - at[i])
            kept = [(r[m], c[m]) for r, c in zip(owners, parts, strict=True) if (m := self.weights[c] != 0).any()]
            if kept:
                rows, cols = _distinct(np.concatenate([r for r, _ in kept]), np.concatenate([c for _, c in kept]))
                z[i:j] += np.bincount(rows, self.weights[cols], j - i)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def lowest(labelled: DataFrame, n: int, seed: int) -> DataFrame:
    """The rows of the ``n`` ids of the lowest hash.  Ids alone are ranked; texts stay where they are."""
    ids = labelled.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)
    return labelled.join(F.broadcast(ids), "doc_id", "left_semi")  # n ids at most


def _sample(labelled: DataFrame, max_per_class: int, seed: int):
    """A bounded sample of each class, lowest hash first: (columns, label, columns of the swapped text or None)."""
    parts = [lowest(labelled.where(F.col("label") == c), max_per_class, seed) for c in (0, 1)]
    def extract(batches):
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                text = text or ""
                mine = columns_of(text)
                other = swapped(text)
                out.append((mine.astype(np.int32).tobytes(), columns_of(other).astype(np.int32).tobytes() if other != text.lower() else None))
            yield pa.RecordBatch.from_arrays(
                [b.column("label"), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())],
                ["label", "cols", "swap"],
            )

    rows = []
    for p in parts:
        rows += p.select("text", F.col("label").cast("int")).mapInArrow(tidy(extract), "label int, cols binary, swap binary").collect()
    return rows


def fit(
    labelled: DataFrame,
    max_per_class: int = 3000,
    max_columns: int = 20_000,
    l2: float = 1e-3,
    l1: float = 2e-4,
    fairness: float = 1.0,
    steps: int = 150,
    seed: int = 17,
) -> ToxicityModel:
    """Fit on rows (doc_id, text, label 0/1) of which at most ``max_per_class`` of each class are taken."""
    rows = _sample(labelled, max_per_class, seed)
    y = np.array([r.label for r in rows], float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.zeros(1 << BITS, np.float32), 0.0, float(y[0]) if len(y) else 0.0)
    cols = [np.frombuffer(r.cols, np.int32) for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(c) for c in cols])
    flat = np.concatenate(cols)
    npos, nneg = y.sum(), len(y) - y.sum()
    pos = np.bincount(flat[y[owner] == 1], minlength=1 << BITS)
    neg = np.bincount(flat[y[owner] == 0], minlength=1 << BITS)
    p, q = pos / npos, neg / nneg
    spread = np.sqrt((p * (1 - p) + 1 / npos) / npos + (q * (1 - q) + 1 / nneg) / nneg)
    strength = np.where(pos + neg >= min(3, npos), np.abs(p - q) / spread, 0)
    chosen = np.argsort(-strength, kind="stable")[:max_columns]
    chosen = chosen[strength[chosen] > 1.5]
    where = np.full(1 << BITS, -1)
    where[chosen] = np.arange(len(chosen))
    keep = where[flat] >= 0
    owner, flat = owner[keep], where[flat[keep]]
    # counterfactual differences x - swap(x), one sparse row for each sampled text with an identity term
    d_row, d_col, d_val, pairs = [], [], [], 0
    for r, mine in zip(rows, cols, strict=True):
        if r.swap is not None:
            other = np.frombuffer(r.swap, np.int32)
            for c, v in ((np.setdiff1d(mine, other), 1.0), (np.setdiff1d(other, mine), -1.0)):
                c = where[c][where[c] >= 0]
                d_row.append(np.full(len(c), pairs)), d_col.append(c), d_val.append(np.full(len(c), v))
            pairs += 1
    d_row, d_col, d_val = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((d_row, int), (d_col, int), (d_val, float)))
    w, b = np.zeros(len(chosen)), float(np.log(npos / nneg))
    weight = np.where(y == 1, 0.5 / npos, 0.5 / nneg)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = b + np.bincount(owner, w[flat], len(y))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        gw = np.bincount(flat, g[owner], len(w)) + l2 * w
        if pairs:
            dz = np.bincount(d_row, d_val * w[d_col], pairs)
            gw += 2 * fairness / pairs * np.bincount(d_col, d_val * dz[d_row], len(w))
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 * (1 - t / (steps + 1)) + 0.005
        step = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w = w - step * m / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b -= rate / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6) * mb / (1 - 0.9**t)
    full = np.zeros(1 << BITS, np.float32)
    full[chosen] = np.where(np.abs(w) < 1e-3, 0, w)
    return ToxicityModel(full, float(b))


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``keep`` columns and ``name`` (double): the toxicity of each whole ``text``.  Other columns never matter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB whatever the corpus
    fields = [docs.schema[c] for c in keep]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(shared.value.score_batch(b.column("text")))], [*keep, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{name}` double"
    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(tidy(run), schema)


def training_rows(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """Labelled documents outside the held-out fold: doc_id, text, label."""
    labels = table(spark, sf_dir, "labels").where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id").where(~held_out())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: doc_id, held_out, score, predicted for every document."""
    model = fit(training_rows(spark, sf_dir, "toxic"))
    scored = score(table(spark, sf_dir, "documents"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
