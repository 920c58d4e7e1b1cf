"""Near-duplicates: DartMinHash signatures, banded joining, exact checks, connected groups.

A text is the weighted set of its shingles of five lower-cased words (fewer words: one shingle of all; none: no
shingle and no partner); weights are 1, or counts.  Every element owns a region of its weight's width, into which
hashed darts fall at exponential times; each dart aims at one of ``K`` coordinates and each coordinate keeps its
earliest.  About K ln K darts are thrown for a text, whatever its size.  Texts whose signatures agree on a band of
``ROWS`` coordinates meet: at similarity 0.8 a pair misses all ``K / ROWS`` bands with probability 3e-6.

Texts with the same shingles are one class, joined by its smallest id.  In a band's bucket the classes are compared
with one leader, pair by pair on exact similarities, and joined to groups; buckets that still hold several groups
get another leader once.  What then still meets across groups forms crowds, which are dealt into tiles; every pair of
tiles is one bounded task that compares all their texts and returns no more links than join groups.  So no link is
lost, no pairs are emitted, and a bucket of similar texts mostly costs one comparison a text.

Defined results: rows of the same id are one document; a null id has a null class and takes no part; ties go to the
smallest id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import gather
from .common import SPACES, checkpoint, discard, join_back, mix, records_per_batch, slices, span_hasher, stored, table, text_view, tidy, trim, words

WORDS, SIMILARITY, K, ROWS, ROUNDS, TILE, SHARE = 5, 0.8, 96, 4, 2, 512, 512
#: Edges of a graph that one task makes stars of.
EDGES = 1 << 17
_MULTIPLIERS = mix(np.arange(1, 33, dtype=np.uint64)) | np.uint64(1)


def shingles(raw: np.ndarray, at: np.ndarray, size: int = WORDS, counts: bool = False):
    """(rows, hashes, weights) of the distinct word shingles of each row, sorted by row and hash."""
    starts, ends, rows = words(raw, at, SPACES)
    n = len(at) - 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    h = span_hasher(raw)(starts, ends)
    first = np.searchsorted(rows, np.arange(n))
    each = np.diff(np.append(first, len(rows)))
    made = np.maximum(each - size + 1, (each > 0).astype(np.int64))
    begin = gather(np.arange(len(h)), first, made)
    owner = np.repeat(np.arange(n), made)
    used = np.minimum(each, size)[owner]
    value = used.astype(np.uint64)
    for k in range(size):
        spot = np.minimum(begin + k, len(h) - 1)
        value = value + np.where(k < used, h[spot] * _MULTIPLIERS[k], np.uint64(0))
    value = mix(value)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1]))
    where = np.flatnonzero(new)
    weights = np.diff(np.append(where, len(value))).astype(float) if counts else np.ones(len(where))
    return owner[where], value[where], weights


def dart_minhash(rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """The (n, k) signatures of weighted sets; zeros for sets without weight.

    An element's region [0, weight) is met by cells [0, 1), [1, 2), [2, 4), ... that have dart sequences of their own;
    darts of a cell beyond the weight are void.  Sequences depend on element and cell alone.
    """
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(rows, weights, n)
    todo = np.flatnonzero(total > 0)
    reach = np.zeros(n)
    reach[todo] = (np.log(k) + 3) / total[todo]
    cells = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 1))).astype(int), 0) + 1
    source = np.repeat(np.arange(len(rows)), cells)
    cell = np.arange(len(source)) - np.repeat(np.cumsum(cells) - cells, cells)
    low = np.where(cell > 0, 2.0 ** (cell - 1), 0.0)
    width = np.where(cell > 0, low, 1.0)
    seeds = mix(elements[source] + cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    source_row, room = rows[source], weights[source] - low
    while len(todo):
        wanted = np.zeros(n, bool)
        wanted[todo] = True
        some = wanted[source_row]
        state, row, rate, span, left = seeds[some], source_row[some], k * width[some], width[some], room[some]
        time = np.zeros(len(state))
        times, keys, names = [], [], []
        while len(state):
            state = mix(state + np.uint64(0xA0761D6478BD642F))
            time = time - np.log(((state >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
            alive = time < reach[row]
            state, time, row, rate, span, left = (x[alive] for x in (state, time, row, rate, span, left))
            aim = mix(state ^ np.uint64(0xE7037ED1A0B428DB))
            valid = ((aim >> np.uint64(32)).astype(float) * 2.0**-32 * span < left) if (left < span).any() else slice(None)
            times.append(time[valid]), names.append(state[valid])
            keys.append(row[valid] * k + ((aim[valid] & np.uint64(0xFFFFFFFF)) % np.uint64(k)).astype(np.int64))
        times, keys, names = np.concatenate(times), np.concatenate(keys), np.concatenate(names)
        late_first = np.argsort(-times, kind="stable")
        flat = np.zeros(n * k, np.uint64)
        flat[keys[late_first]] = names[late_first]
        flat = flat.reshape(n, k)
        out[todo] = flat[todo]
        todo = todo[(flat[todo] == 0).any(1)]
        reach[todo] *= 2
    return out


def bands(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, k = signatures.shape
    out = np.repeat(mix(np.arange(1, k // rows + 1, dtype=np.uint64))[None], n, 0)
    for r in range(rows):
        out = mix(out + signatures[:, r :: rows][:, : k // rows] * _MULTIPLIERS[r])
    return out


def _slices(column, counts=False, size=WORDS):
    """Per slice of rows: (first row, row after the last, rows, shingles, weights)."""
    raw, at = text_view(pc.utf8_lower(column))
    for i, j in slices(at, 1 << 20):
        yield (i, j, *shingles(raw[at[i] : at[j]], at[i : j + 1] - at[i], size, counts))


def signatures(docs: DataFrame, counts: bool = False) -> DataFrame:
    """doc_id, a, b (128 bits of the weighted set; null without words) and bands of every document with an id."""

    def run(batches):
        for batch in batches:
            for i, j, rows, h, w in _slices(batch.column("text"), counts):
                n = j - i
                none = np.bincount(rows, minlength=n) == 0
                a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                np.add.at(a, rows, mix(h + w.astype(np.uint64)))
                np.add.at(b, rows, mix(h ^ np.uint64(0x8EBC6AF09C88C6E3)) * w.astype(np.uint64))
                made = bands(dart_minhash(rows, h, w, n)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * made.shape[1]), pa.array(made.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, n), pa.array(a.view(np.int64), mask=none), pa.array(b.view(np.int64), mask=none), lists], ["doc_id", "a", "b", "bands"]
                )

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, a long, b long, bands array<long>")


def _sets(docs: DataFrame, ids: DataFrame, counts: bool) -> DataFrame:
    """id and its shingle set, for the documents in ``ids`` (id)."""

    def run(batches):
        for batch in batches:
            for i, j, rows, h, w in _slices(batch.column("text"), counts):
                at = np.searchsorted(rows, np.arange(j - i + 1))
                body = [h[at[r] : at[r + 1]].tobytes() + (w[at[r] : at[r + 1]].astype(np.uint32).tobytes() if counts else b"") for r in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(body, pa.binary())], ["id", "body"])

    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    return named.join(ids, "id", "left_semi").mapInArrow(tidy(run), "id long, body binary").groupBy("id").agg(F.max("body").alias("body"))


def similarity(a: bytes, b: bytes, counts: bool = False) -> float:
    """(Weighted) Jaccard similarity of two bodies."""
    unit = 12 if counts else 8
    n, m = len(a) // unit, len(b) // unit
    x, y = np.frombuffer(a, np.uint64, n), np.frombuffer(b, np.uint64, m)
    if not counts:
        if min(n, m) < 1e-9 * max(n, m, 1):
            return 0.0
        both = np.concatenate([x, y])
        both.sort()
        shared = int((both[1:] == both[:-1]).sum())
        return shared / (n + m - shared) if n + m else 0.0
    u, v = np.frombuffer(a, np.uint32, n, 8 * n), np.frombuffer(b, np.uint32, m, 8 * m)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    least = int(np.minimum(u[i], v[j]).sum())
    whole = int(u.sum()) + int(v.sum()) - least
    return least / whole if whole else 0.0


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float, counts: bool) -> DataFrame:
    """The pairs (x, y) of a leader and a member that are similar enough.

    A leader may have very many members: they are dealt into shares of ``SHARE``, each with a copy of its set.
    """
    pairs = checkpoint(pairs, tidy_up=False)
    sizes = pairs.groupBy("x").agg(F.count("*").alias("n"))
    share = F.pmod(F.xxhash64("y"), F.ceil(F.col("n") / SHARE)).cast("int").alias("share")
    dealt = join_back(pairs, sizes, ["x"], "n", pairs.count()).select("x", "y", share)
    shares = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / SHARE).cast("int") - 1)).alias("share")
    leaders = sizes.join(sets.select(F.col("id").alias("x"), F.col("body").alias("p")), "x").select("x", "p", shares)

    def run(batches):
        for b in batches:
            ok = []
            for p, q in zip(b.column("p"), b.column("q"), strict=True):
                p, q = p.as_py(), q.as_py()
                small, large = sorted((len(p), len(q)))
                ok.append((counts or small >= threshold * large - 1e-6) and similarity(p, q, counts) >= threshold)
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y")], ["x", "y"]).filter(pa.array(ok, pa.bool_()))

    one = dealt.join(sets.select(F.col("id").alias("y"), F.col("body").alias("q")), "y")
    return one.join(leaders, ["x", "share"]).select("x", "y", "p", "q").mapInArrow(tidy(run), "x long, y long")


def stars(edges: DataFrame, total: int) -> DataFrame:
    """Edges (u, v) to the least node v of each component, by shares of at most some ``EDGES`` edges, each by itself: of
    one share these are the components."""

    def run(batches):
        pairs = [np.stack([b.column("u").to_numpy(), b.column("v").to_numpy()]) for b in batches]
        if not pairs:
            return
        nodes, spots = np.unique(np.concatenate(pairs, 1), return_inverse=True)
        x, y = spots.reshape(2, -1)
        low = np.arange(len(nodes))  # in the order of the ids
        while ((p := low[x]) != (q := low[y])).any():
            np.minimum.at(low, np.maximum(p, q), np.minimum(p, q))
            while (low[low] != low).any():
                low = low[low]
        tied = low != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[low[tied]])], ["u", "v"])

    return edges.coalesce(-(-total // EDGES) or 1).mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """id and label (the smallest id of its component) for the nodes of undirected edges (x, y), x <> y.

    Shares of the edges are first made stars, each by itself; while there are too many for one share, alternating
    large-star and small-star steps follow, each of which groups by a node on the map side first and joins the minima back.
    """

    def least(e):
        return e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")

    def whole(e):
        return e.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())

    e = stored(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v"))
    seen, total, done = None, e.count(), e
    while True:
        one = total <= EDGES
        if one or seen is None:
            before, e = done, stored(stars(e, total))
            done = e
            discard(before)
            if one:
                return whole(e)
            total = e.count()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        e = join_back(both, least(both), ["u"], "n", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = least(small)
        e = join_back(small, low, ["u"], "n", total).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, e = done, stored(e)
        done = e
        discard(before)
        state = e.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        total = state[0]
        if state == seen:
            return whole(e)
        seen = state


def _crowd_links(now: DataFrame, mixed: DataFrame, sets: DataFrame, threshold: float, counts: bool) -> DataFrame:
    """Links (x, y) between different labels among the members of mixed buckets, from all pairs of tiles of a crowd."""
    star = join_back(now, mixed.select("key", "lead", "n"), ["key"], "n", now.count()).select(F.col("lead.id").alias("x"), F.col("id").alias("y")).where("x <> y")
    crowds = components(star)
    tiles = crowds.groupBy("label").agg(F.count("*").alias("members"))
    n = F.ceil(F.col("members") / TILE).cast("int")
    mine = join_back(crowds, tiles, ["label"], "members", crowds.count()).select("id", F.col("label").alias("crowd"), n.alias("n"), F.pmod(F.xxhash64("id"), n).cast("int").alias("own"))
    own = mine.join(now.select("id", "label").distinct(), "id").join(sets, "id")
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("crowd", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "label", "body")

    def compare(t: pa.Table) -> pa.Table:
        trim()
        ids, labels = t["id"].to_numpy(), t["label"].to_pylist()
        unit = 12 if counts else 8
        bodies = t["body"].to_pylist()
        n = np.array([len(b) // unit for b in bodies], np.int64)
        flat = np.concatenate([np.frombuffer(b, np.uint64, m) for b, m in zip(bodies, n, strict=True)])
        weight = np.concatenate([np.frombuffer(b, np.uint32, m, 8 * m) for b, m in zip(bodies, n, strict=True)]).astype(np.int64) if counts else np.ones(len(flat), np.int64)
        terms, flat = np.unique(flat, return_inverse=True)
        at = np.cumsum(n) - n
        whole = np.add.reduceat(weight, at)
        mark = np.zeros(len(terms), np.int64)
        parent = {x: x for x in labels}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        links = []
        for k in range(len(ids) - 1):
            s = slice(at[k], at[k] + n[k])
            mark[flat[s]] = weight[s]
            rest = slice(at[k + 1], None)
            shared = np.add.reduceat(np.minimum(mark[flat[rest]], weight[rest]), at[k + 1 :] - at[k + 1])
            mark[flat[s]] = 0
            for other in np.flatnonzero(shared >= threshold * (whole[k] + whole[k + 1 :] - shared) - 1e-9) + k + 1:
                a, b = root(labels[k]), root(labels[other])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    links.append((min(ids[k], ids[other]), max(ids[k], ids[other])))
        return pa.table({"x": pa.array([x for x, _ in links], pa.int64()), "y": pa.array([y for _, y in links], pa.int64())})

    return dealt.groupBy("crowd", "i", "j").applyInArrow(compare, "x long, y long")


def near_groups(docs: DataFrame, threshold: float = SIMILARITY, counts: bool = False, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, class_id (the smallest id of its group of near-duplicates) and same_id (of its class of equal shingles)."""
    made = checkpoint(signatures(docs, counts))
    classes = made.where("a is not null").groupBy("a", "b").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.count("*").alias("n"))
    met = classes.select("id", F.explode("bands").alias("key"))
    crowded = met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = checkpoint(join_back(met, crowded, ["key"], "n", made.count() * (K // ROWS)).select("key", "id"))
    sets = checkpoint(_sets(docs, members.select("id").distinct(), counts))
    labels = links = None
    for r in range(rounds + 1):
        now = members.withColumn("label", F.col("id")) if labels is None else members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        mixed = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min_by(F.struct("id", "label"), F.col("id") if r == 0 else F.xxhash64("id", F.lit(r))).alias("lead"), F.count("*").alias("n"))
        mixed = mixed.where("low <> high")
        if r == rounds:
            found = checkpoint(_crowd_links(now, mixed, sets, threshold, counts))
        else:
            pairs = join_back(now, mixed.select("key", "lead", "n"), ["key"], "n", now.count()).where("label <> lead.label")
            pairs = pairs.select(F.col("lead.id").alias("x"), F.col("id").alias("y")).distinct()
            with records_per_batch(docs.sparkSession, 256):  # two sets a row
                found = checkpoint(_verified(pairs, sets, threshold, counts))
        if found.isEmpty():
            continue
        links = found if links is None else links.unionByName(found)
        labels = components(links)
    named = made.where("a is not null").select("doc_id", "a", "b")
    bare = made.where("a is null").select("doc_id", F.col("doc_id").alias("same_id"))
    bare = bare.withColumn("class_id", F.col("same_id")).select("doc_id", "class_id", "same_id")
    known = classes.select("a", "b", "id", "n")
    known = known.withColumn("label", F.col("id")) if labels is None else known.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    same = join_back(named, known, ["a", "b"], "n", named.count())
    grouped = same.select("doc_id", F.col("label").alias("class_id"), F.col("id").alias("same_id")).unionByName(bare)
    unnamed = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("same_id"))
    return grouped.unionByName(unnamed)


def near_dedup(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` of which each group's smallest id is left, all columns; null ids stay."""
    gone = near_groups(docs.select("doc_id", "text"), threshold).where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
