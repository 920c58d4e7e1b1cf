"""Quality: a generalised additive model with pairwise interactions, fitted by cyclic boosting of shallow trees.

Every whole text gives a fixed vector of surface statistics.  Each feature is cut into at most ``bins`` quantile
bins; boosting goes round the features, each step fitting a tree of two splits on that feature alone and adding its
leaves to the feature's lookup table.  The pairs with the largest remaining gain get two-dimensional tables the
same way.  A score is the logistic of the intercept plus table entries, looked up for whole batches at once.  The
fit takes a bounded sample of labelled rows (``max_rows``); scoring is one pass without a shuffle.

Defined results: null and empty texts have the zero vector and get its score; repeated rows are scored alike; a null
id is never held out nor learnt from; with labels of one class only the score is that class, with none it is 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, held_out, slices, span_hasher, table, text_view, words
from .toxicity import lowest, training_rows

FEATURES = (
    "log_bytes", "upper", "digits", "spaces", "marks", "stops", "symbols", "pipes", "high", "word_bytes", "long_words",
    "marked_words", "capital_words", "upper_words", "distinct_words", "top_byte", "line_bytes", "distinct_lines",
    "sentence_words", "entropy",
)


def _lut(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[[ord(c) for c in chars]] = 1
    return out


_UPPER = _lut("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CLASSES = {
    "upper": _UPPER, "digits": _lut("0123456789"), "spaces": _lut(" \t\r\n"), "marks": _lut("!?"), "stops": _lut(".,;:"),
    "symbols": _lut("#$%&*@^~<>=+_{}[]\\/"), "pipes": _lut("|"), "high": (np.arange(256) >= 128).astype(float),
}
_LETTER = np.array([chr(b).isalpha() or b >= 128 if b < 128 else True for b in range(256)])
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text of an Arrow column."""
    raw, at = text_view(column)
    out = np.zeros((len(at) - 1, len(FEATURES)))
    for i, j in slices(at):
        out[i:j] = _slice_features(raw[at[i] : at[j]], at[i : j + 1] - at[i])
    return out


def _slice_features(raw, at):
    n = len(at) - 1
    out = np.zeros((n, len(FEATURES)))
    size = np.diff(at)
    some = size > 0
    if not some.any():
        return out
    row = np.repeat(np.arange(n), size)
    counts = np.bincount(row * 256 + raw, minlength=n * 256).reshape(n, 256).astype(float)
    length = np.maximum(size, 1)[:, None]
    share = counts / length
    col = {f: k for k, f in enumerate(FEATURES)}
    out[:, col["log_bytes"]] = np.log1p(size)
    for f, lut in _CLASSES.items():
        out[:, col[f]] = share @ lut
    out[:, col["top_byte"]] = share.max(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        out[:, col["entropy"]] = -np.where(share > 0, share * np.log2(np.where(share > 0, share, 1)), 0).sum(1)
    starts, ends, owner = words(raw, at, SPACES)
    n_words = np.maximum(np.bincount(owner, minlength=n), 1)
    per = lambda x: np.bincount(owner, x, n) / n_words
    long = ends - starts
    first, last = raw[starts], raw[np.maximum(ends - 1, 0)]
    out[:, col["word_bytes"]] = per(long)
    out[:, col["long_words"]] = per(long > 14)
    out[:, col["marked_words"]] = per(~_LETTER[last])
    out[:, col["capital_words"]] = per(_UPPER[first])
    uppers = np.concatenate([[0], np.cumsum(_UPPER[raw])])
    out[:, col["upper_words"]] = per((uppers[ends] - uppers[starts] >= 2) & (long >= 2))
    hashes = span_hasher(raw)
    for name, (s, e, o) in (("distinct_words", (starts, ends, owner)), ("distinct_lines", words(raw, at, _NEWLINE))):
        h = (hashes(s, e) >> np.uint64(24)).astype(np.int64)
        key = np.unique(o << 40 | h)
        total = np.bincount(o, minlength=n)
        out[:, col[name]] = np.bincount(key >> 40, minlength=n) / np.maximum(total, 1)
        if name == "distinct_lines":
            out[:, col["line_bytes"]] = np.log1p(size / np.maximum(total, 1))
    sentences = np.bincount(owner, np.isin(last, np.frombuffer(b".!?", np.uint8)), n)
    out[:, col["sentence_words"]] = np.log1p(n_words / np.maximum(sentences, 1))
    out[~some] = 0
    return out


@dataclass(frozen=True)
class AdditiveModel:
    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        binned = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)]
        z = np.full(len(x), self.intercept)
        for b, t in zip(binned, self.tables, strict=True):
            z += t[b]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[binned[i], binned[j]]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _best_split(g, h, l2):
    """Where to cut a histogram in two, and the gain."""
    if len(g) < 2:
        return 0, 0.0
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    tg, th = g.sum(), h.sum()
    gain = a * a / (b + l2) + (tg - a) ** 2 / (th - b + l2) - tg * tg / (th + l2)
    k = int(np.argmax(gain))
    return k + 1, float(gain[k])


def _tree(g, h, l2):
    """Leaf values for each bin of a tree with up to two splits; and its gain."""
    value = lambda s: np.clip(g[s].sum() / (h[s].sum() + l2), -4, 4)
    k, gain = _best_split(g, h, l2)
    leaves = [slice(0, len(g))] if gain <= 0 else [slice(0, k), slice(k, len(g))]
    if gain > 0:
        more = [_best_split(g[s], h[s], l2) for s in leaves]
        w = int(more[1][1] > more[0][1])
        if more[w][1] > 0:
            s = leaves.pop(w)
            leaves += [slice(s.start, s.start + more[w][0]), slice(s.start + more[w][0], s.stop)]
            gain += more[w][1]
    out = np.zeros(len(g))
    for s in leaves:
        out[s] = value(s)
    return out, gain


def _pair_tree(g, h, l2):
    """A tree on two features: one cut of the first, then one cut of the second in each half (or the other way)."""
    best = (0.0, np.zeros_like(g))
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        k, gain = _best_split(a.sum(1), b.sum(1), l2)
        if gain <= 0:
            continue
        out = np.zeros_like(a)
        for s in (slice(0, k), slice(k, len(a))):
            ga, hb = a[s].sum(0), b[s].sum(0)
            c, more = _best_split(ga, hb, l2)
            cuts = (slice(0, c), slice(c, len(ga))) if more > 0 else (slice(0, len(ga)),)
            gain += max(more, 0)
            for u in cuts:
                out[s, u] = np.clip(ga[u].sum() / (hb[u].sum() + l2), -4, 4)
        if gain > best[0]:
            best = (gain, out.T.copy() if flip else out)
    return best[1], best[0]


def fit_arrays(x: np.ndarray, y: np.ndarray, bins: int = 24, rounds: int = 120, n_pairs: int = 6, rate: float = 0.15, l2: float = 2.0) -> AdditiveModel:
    k = x.shape[1]
    if not len(y) or y.min() == y.max():
        return AdditiveModel(0, [], [], [], [], float(y[0]) if len(y) else 1.0)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(k)]
    binned = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
    sizes = [len(c) + 1 for c in cuts]
    tables = [np.zeros(s) for s in sizes]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    intercept, z = 0.0, np.zeros(len(y))
    state = lambda: (lambda p: (weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)))(1 / (1 + np.exp(-z)))
    for _ in range(rounds):
        for f in range(k):
            g, h = state()
            leaf, gain = _tree(np.bincount(binned[f], g, sizes[f]), np.bincount(binned[f], h, sizes[f]), l2)
            if gain > 1e-9:
                tables[f] += rate * leaf
                z += rate * leaf[binned[f]]
    hist = lambda i, j, v: np.bincount(binned[i] * sizes[j] + binned[j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
    g, h = state()
    ranked = sorted(((_pair_tree(hist(i, j, g), hist(i, j, h), l2)[1], i, j) for i in range(k) for j in range(i)), key=lambda t: (-t[0], t[1:]))
    pairs = [(i, j) for gain, i, j in ranked[:n_pairs] if gain > 1e-6]
    pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in pairs]
    for _ in range(rounds // 4):
        for t, (i, j) in enumerate(pairs):
            g, h = state()
            leaf, gain = _pair_tree(hist(i, j, g), hist(i, j, h), l2)
            if gain > 1e-9:
                pair_tables[t] += rate * leaf
                z += rate * leaf[binned[i], binned[j]]
    return AdditiveModel(intercept, cuts, tables, pairs, pair_tables)


def with_features(docs: DataFrame, keep: tuple[str, ...], model=None, name: str = "score") -> DataFrame:
    """``keep`` columns and either the feature array or, given a model, its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model) if model is not None else None  # tables of fixed size

    def run(batches):
        for b in batches:
            x = features(b.column("text"))
            last = pa.array(shared.value.score(x)) if shared is not None else pa.array(list(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), last], [*keep, name])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(run, f"{schema}, `{name}` " + ("double" if shared is not None else "array<double>"))


def fit(labelled: DataFrame, max_rows: int = 12_000, seed: int = 29) -> AdditiveModel:
    """Fit on rows (doc_id, text, label); at most ``max_rows`` of each class, lowest hash first."""
    rows = []
    for c in (0, 1):
        part = lowest(labelled.where(F.col("label") == c), max_rows, seed)
        rows += with_features(part.select("label", "text"), ("label",), name="x").collect()
    return fit_arrays(np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([r.label for r in rows], float))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: doc_id, held_out, score, predicted for every document."""
    model = fit(training_rows(spark, sf_dir, "quality"))
    scored = with_features(table(spark, sf_dir, "documents"), ("doc_id",), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
