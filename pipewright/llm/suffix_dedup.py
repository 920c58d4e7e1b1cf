"""Removal of byte strings that an earlier document also has: a suffix array built bucket by bucket.

A string of ``length`` bytes starts at a suffix; two documents share one when their suffixes agree on ``length``
bytes.  Suffixes are dealt into buckets by the smallest hashed ``SEED``-gram of their first ``length`` bytes, so that
equal ones meet and neighbouring ones mostly travel as one run of bytes.  Three rounds over blocks of documents:

1. Every block sends each bucket the grams that rule some suffix in it.  A bucket answers which of them occur in two
   documents; all other suffixes are unique and need no sorting.
2. Blocks send the runs of bytes under those grams, equal runs of a block once with the smallest id.  A bucket sorts
   its suffixes one gram after the other: sample positions of a difference cover modulo 3 are ranked first, the others
   are ordered by a byte and the rank behind it and merged with at most two bytes and a rank, so that long ties cost
   no more than short ones.  Groups of suffixes equal on ``length`` bytes get the smallest id.
3. Blocks take off what starts in a document with a smaller id.

Blocks hold ``block_bytes`` and buckets the like (beyond 1 GB times the cube root of the GB, as every block writes to
every bucket); answers repeat a gram once for each block, whatever its copies.
All steps work on all bytes.  Runs meet by their bytes; a block finds the answer to a run under a 64-bit hash.

Defined results: null as empty; matches never cross documents; a null id counts as larger than all others; rows with
the same id never take from each other.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import gather
from .common import checkpoint, fresh, gram_hashes, mix, slices, span_hasher, table, text_view, tidy, trim

LENGTH, SEED = 50, 20
#: Bytes of text that one step looks for runs in; its arrays stay in a core's cache.
RUN_BYTES = 1 << 18
NO_ID = np.iinfo(np.int64).max


def _zip(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else x.tobytes())


def _unzip(x, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def runs(raw: np.ndarray, at: np.ndarray, length: int, seed: int):
    """Maximal runs of suffix starts ruled by the same gram position: (gram hash, first start, last start, row)."""
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    n, width = len(raw), length - seed + 1
    if n < length:
        return none
    hashes = gram_hashes(raw, seed)
    best = hashes & np.uint64(0xFFFFFFFF00000000)
    best |= np.arange(len(hashes), dtype=np.uint64)
    covered = 1
    while covered < width:
        step = min(covered, width - covered)
        best = np.minimum(best[: len(best) - step], best[step:])
        covered += step
    place = best.astype(np.uint32)  # the low half
    edges = np.zeros(len(place) + 1, np.int8)
    some = np.diff(at) >= length
    edges[at[:-1][some]] += 1
    edges[at[1:][some] - length + 1] -= 1
    valid = np.cumsum(edges[:-1], dtype=np.int8).view(bool)
    new = np.ones(len(place) + 1, bool)
    new[1:-1] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(valid & new[:-1])
    if not len(first):
        return none
    last = np.flatnonzero(valid & new[1:])
    # smallest hashes are mostly small: hashed again, they fill all buckets alike
    return mix(hashes[place[first]] + np.uint64(0x9E3779B97F4A7C15)), first, last, np.searchsorted(at, first, "right") - 1


def suffix_groups(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix starts of the segments [start, end) of ``text``, sorted by ``length`` bytes or more; and where groups begin.

    Difference cover {1, 2} modulo 3.
    """
    n_keys = length // 8 + 1
    padded = np.concatenate([text, np.zeros(8 * n_keys + 8, np.uint8)])
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(">u8")[:, 0]
    windows = ends - starts - length + 1
    spread = lambda extra: gather(np.arange(len(padded)), starts, windows + extra)
    near = spread(2)  # the suffixes, and two more positions behind each segment's last
    sample = near[near % 3 != 0]
    order = np.lexsort([words[sample + 8 * k].astype(np.uint64) for k in reversed(range(n_keys))])
    sample = sample[order]
    fresh = np.zeros(len(sample), bool)
    for k in range(n_keys):
        w = words[sample + 8 * k]
        fresh[1:] |= w[1:] != w[:-1]
    rank = np.zeros(len(padded), np.int64)
    rank[sample] = np.cumsum(fresh) + 1
    wanted = np.zeros(len(padded), bool)
    wanted[spread(0)] = True
    sample = sample[wanted[sample]]
    byte = padded.astype(np.int64)
    one = lambda p: byte[p] << 40 | rank[p + 1]
    two = lambda p: byte[p] << 48 | byte[p + 1] << 40 | rank[p + 2]
    rest = np.flatnonzero(wanted[::3]) * 3
    rest = rest[np.argsort(one(rest), kind="stable")]
    before = np.searchsorted(one(sample[sample % 3 == 1]), one(rest)) + np.searchsorted(two(sample[sample % 3 == 2]), two(rest))
    keys = np.concatenate([2 * np.arange(len(sample)) + 1, 2 * before])
    ordered = np.concatenate([sample, rest])[np.argsort(keys, kind="stable")]
    new = np.ones(len(ordered), bool)
    new[1:] = False
    for k in [8 * k for k in range(length // 8)] + ([length - 8] if length >= 8 else []):
        w = words[ordered + k]
        new[1:] |= w[1:] != w[:-1]
    if length < 8:
        for k in range(length):
            new[1:] |= padded[ordered[1:] + k] != padded[ordered[:-1] + k]
    return ordered, np.flatnonzero(new)


def smallest_ids(grams: np.ndarray, keys: np.ndarray, lengths: np.ndarray, text: np.ndarray, ids: np.ndarray, length: int, block: int = 300_000) -> np.ndarray:
    """For each suffix of each segment (in order): the smallest id among segments that have its first ``length`` bytes.

    Only segments under the same gram can agree.  Segments of the same bytes (the same key, then compared) are one.
    Suffixes are sorted for so many grams at a time that they are about ``block``; a gram with one segment needs none.
    """
    starts = np.cumsum(lengths) - lengths
    order = np.lexsort((keys, grams))
    g, k = grams[order], keys[order]
    fresh = np.append(True, (g[1:] != g[:-1]) | (k[1:] != k[:-1])) if len(order) else np.zeros(0, bool)
    leader = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    repeat = np.flatnonzero(~fresh)
    for i in range(0, len(repeat), 100_000):
        x = repeat[i : i + 100_000]
        same = lengths[order[x]] == lengths[leader[x]]
        y = x[same]
        differ = gather(text, starts[order[y]], lengths[order[y]]) != gather(text, starts[leader[y]], lengths[leader[y]])
        fresh[x[~same]] = True
        if differ.any():  # two segments under one key: both are kept
            fresh[y[np.unique(np.repeat(np.arange(len(y)), lengths[order[y]])[differ])]] = True
    one = np.flatnonzero(fresh)
    which = np.zeros(len(order), np.int64)
    which[order] = np.cumsum(fresh) - 1
    least = np.minimum.reduceat(ids[order], one) if len(one) else ids[:0]
    distinct = order[one]
    result = _smallest_of_distinct(grams[distinct], lengths[distinct], starts[distinct], text, least, length, block)
    windows = lengths[distinct] - length + 1
    return gather(result, (np.cumsum(windows) - windows)[which], windows[which])


def _smallest_of_distinct(grams, lengths, starts, text, ids, length, block):
    """The same for distinct segments sorted by their grams."""
    windows = lengths - length + 1
    out = np.repeat(ids, windows)
    out_at = np.cumsum(windows) - windows
    bounds = np.append(np.flatnonzero(np.append(True, grams[1:] != grams[:-1])), len(grams)) if len(grams) else np.zeros(1, np.int64)
    size = np.diff(bounds)
    members = np.flatnonzero(np.repeat(size > 1, size))
    size = size[size > 1]
    ends, total = np.cumsum(size), np.concatenate([[0], np.cumsum(windows[members])])
    i = 0
    while i < len(members):
        j = int(np.searchsorted(total, total[i] + block, "right")) - 1
        j = int(ends[min(np.searchsorted(ends, max(j, i + 1)), len(ends) - 1)])  # to the end of a gram
        some = members[i:j]
        local = gather(text, starts[some], lengths[some])
        end = np.cumsum(lengths[some])
        begin = end - lengths[some]
        ordered, groups = suffix_groups(local, begin, end, length)
        owner = np.searchsorted(begin, ordered, "right") - 1
        smallest = np.minimum.reduceat(ids[some][owner], groups)
        out[out_at[some][owner] + ordered - begin[owner]] = np.repeat(smallest, np.diff(np.append(groups, len(ordered))))
        i = j
    return out


class _Block:
    """The documents of one block, from its packed rows."""

    def __init__(self, packed: pa.Table):
        self.parts = []
        for data, sizes, rest in zip(*(packed[c] for c in ("data", "sizes", "rest")), strict=True):
            raw = _unzip(data.as_py(), np.uint8)
            at = np.concatenate([[0], np.cumsum(_unzip(sizes.as_py(), np.int64))])
            with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rest.as_py())) as f:
                self.parts.append((raw, at, f.read_all()))

    def slices(self):
        """(bytes, offsets, ids, other columns) of some rows at a time."""
        for raw, at, rest in self.parts:
            ids = rest["doc_id"].combine_chunks().cast(pa.int64()).fill_null(NO_ID).to_numpy() if len(rest) else np.zeros(0, np.int64)
            for i, j in slices(at, RUN_BYTES):
                yield raw[at[i] : at[j]], at[i : j + 1] - at[i], ids[i:j], rest.slice(i, j - i)


def _bucket_bounds(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` buckets of equal ranges of the hash begins, and the end."""
    edges = (np.arange(1, n, dtype=object) * (1 << 64) // n).astype(np.uint64) if n > 1 else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]]).astype(np.int64)


def _pack(docs: DataFrame, n_blocks: int) -> DataFrame:
    others = [c for c in docs.columns if c != "text"]
    dealt = fresh(docs, "_block")
    marked = docs.withColumn(dealt, F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(n_blocks)).cast("int"))

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            block = t[dealt].to_numpy()
            order = np.argsort(block, kind="stable")
            t = t.take(pa.array(order))
            edges = np.append(np.flatnonzero(np.append(True, np.diff(block[order]) != 0)), len(order)) if len(order) else [0]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                some = t.slice(i, j - i).combine_chunks()
                raw, at = text_view(some["text"])
                sink = pa.BufferOutputStream()
                rest = some.select(others)
                with pa.ipc.new_stream(sink, rest.schema) as f:
                    f.write_table(rest)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], k) for x, k in ((int(block[order[i]]), pa.int32()), (_zip(raw), pa.binary()), (_zip(np.diff(at)), pa.binary()), (_zip(sink.getvalue().to_pybytes()), pa.binary()))],
                    ["block", "data", "sizes", "rest"],
                )

    return marked.mapInArrow(tidy(run), "block int, data binary, sizes binary, rest binary")


_ANSWER = "block int, bucket int, body binary"


def _table(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.table([pa.array(list(c), k) for c, (_, k) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


_INT, _BIN = pa.int32(), pa.binary()


def _block_runs(block: _Block, length: int, seed: int) -> list[tuple]:
    """(bytes, ids of the runs, and what ``runs`` finds) for each slice of a block."""
    out = []
    for raw, at, ids, _ in block.slices():
        h, first, last, row = runs(raw, at, length, seed)
        out.append((raw, ids[row], h, first.astype(np.int32), last.astype(np.int32)))
    return out


def _block_grams(found: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of a block, sorted, and whether two ids of it have them."""
    h, owner = (np.concatenate([x[k] for x in found] or [np.zeros(0, kind)]) for k, kind in ((2, np.uint64), (1, np.int64)))
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    first = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
    differs = np.zeros(len(h), np.int64)
    differs[1:] = ~first[1:] & (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return h[at], np.add.reduceat(differs, at) > 0 if len(at) else np.zeros(0, bool)


def removal(docs: DataFrame, finish, schema: str, length: int = LENGTH, seed: int = SEED, block_bytes: int = 4 << 20) -> DataFrame:
    """``finish(raw, offsets, covered, other columns) -> pa.Table`` for rows of ``docs``; covered: a flag for each byte."""
    total = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    size = block_bytes * max(1.0, (total / 1e9) ** (1 / 3))
    n = max(1, math.ceil(total / size))
    packed = _pack(docs, n)

    def ask(t: pa.Table) -> pa.Table:
        trim()
        block = t["block"][0].as_py()
        h, twice = _block_grams(_block_runs(_Block(t), length, seed))
        cut, rows = _bucket_bounds(h, n), []
        for k in range(n):
            if cut[k] < cut[k + 1]:
                part = h[cut[k] : cut[k + 1]]
                body = _deltas(part) + np.packbits(twice[cut[k] : cut[k + 1]]).tobytes()
                rows.append((k, block, len(part), body))
        return _table([("bucket", _INT), ("block", _INT), ("count", _INT), ("body", _BIN)], rows)

    def which(t: pa.Table) -> pa.Table:
        trim()
        asked = list(zip(*(t[c].to_pylist() for c in ("block", "count", "body")), strict=True))
        grams = [_undeltas(body, m) for _, m, body in asked]
        flags = [np.unpackbits(np.frombuffer(body[5 * m + 8 :], np.uint8), count=m).astype(bool) for _, m, body in asked]
        all_grams = np.concatenate(grams)
        order = np.argsort(all_grams, kind="stable")
        ranked = all_grams[order]
        at = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        shared = (np.diff(np.append(at, len(ranked))) > 1) | np.logical_or.reduceat(np.concatenate(flags)[order], at)
        answer = np.zeros(len(ranked), bool)
        answer[order] = np.repeat(shared, np.diff(np.append(at, len(ranked))))
        ends = np.cumsum([len(g) for g in grams])
        bucket = t["bucket"][0].as_py()
        return _table(
            [("block", _INT), ("bucket", _INT), ("body", _BIN)],
            [(b, bucket, _zip(np.packbits(answer[e - m : e]))) for (b, m, _), e in zip(asked, ends, strict=True)],
        )

    def send(t: pa.Table, answers: pa.Table) -> pa.Table:
        trim()
        if not len(t) or not len(answers):
            return _table([("bucket", _INT), ("block", _INT), ("grams", _BIN), ("keys", _BIN), ("sizes", _BIN), ("ids", _BIN), ("data", _BIN)], [])
        which_block, slices_ = t["block"][0].as_py(), _block_runs(_Block(t), length, seed)
        h, _ = _block_grams(slices_)
        cut, keep = _bucket_bounds(h, n), np.zeros(len(h), bool)
        for k, body in zip(answers["bucket"].to_pylist(), answers["body"].to_pylist(), strict=True):
            keep[cut[k] : cut[k + 1]] = np.unpackbits(_unzip(body, np.uint8), count=int(cut[k + 1] - cut[k]))
        h = h[keep]
        found = []
        for raw, owner, g, first, last in slices_:
            ok = _member(h, g)
            g, first, ends, owner = g[ok], first[ok], last[ok] + length, owner[ok]
            key = span_hasher(raw)(first, ends)
            order = np.lexsort((owner, key))
            one = np.append(True, key[order][1:] != key[order][:-1]) if len(order) else np.zeros(0, bool)
            pick = order[one]
            found.append((g[pick], key[pick], (ends - first)[pick], owner[pick], gather(raw, first[pick], (ends - first)[pick])))
        g, key, size, owner, data = (np.concatenate(x) for x in zip(*found, strict=True))
        begin = np.cumsum(size) - size
        order = np.lexsort((owner, key, g))
        one = np.append(True, key[order][1:] != key[order][:-1]) if len(order) else np.zeros(0, bool)
        pick = order[one]
        g, key, size, owner, begin = g[pick], key[pick], size[pick], owner[pick], begin[pick]
        cut, rows = _bucket_bounds(g, n), []
        for k in range(n):
            s = slice(cut[k], cut[k + 1])
            if cut[k] < cut[k + 1]:
                rows.append((k, which_block, _zip(g[s]), key[s].tobytes(), _zip(size[s].astype(np.int32)), _zip(owner[s]), _zip(gather(data, begin[s], size[s]))))
        return _table([("bucket", _INT), ("block", _INT), ("grams", _BIN), ("keys", _BIN), ("sizes", _BIN), ("ids", _BIN), ("data", _BIN)], rows)

    def sort(t: pa.Table) -> pa.Table:
        trim()
        grams = [_unzip(x, np.uint64) for x in t["grams"].to_pylist()]
        sizes = [_unzip(x, np.int32).astype(np.int64) for x in t["sizes"].to_pylist()]
        ids = [_unzip(x, np.int64) for x in t["ids"].to_pylist()]
        text = np.concatenate([_unzip(x, np.uint8) for x in t["data"].to_pylist()])
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in t["keys"].to_pylist()])
        least = smallest_ids(np.concatenate(grams), keys, np.concatenate(sizes), text, np.concatenate(ids), length)
        at = np.concatenate([[0], np.cumsum([int((s - length + 1).sum()) for s in sizes])])
        bucket, rows = t["bucket"][0].as_py(), []
        for k, (block, own) in enumerate(zip(t["block"].to_pylist(), t["keys"].to_pylist(), strict=True)):
            rows.append((block, bucket, own, _zip((sizes[k] - length + 1).astype(np.int32)), _zip(least[at[k] : at[k + 1]])))
        return _table([("block", _INT), ("bucket", _INT), ("keys", _BIN), ("windows", _BIN), ("least", _BIN)], rows)

    def cut_off(t: pa.Table, answers: pa.Table) -> pa.Table:
        trim()
        keys, counts, least = (
            np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) if c == "keys" else _unzip(x, kind) for x in answers[c].to_pylist())])
            for c, kind in (("keys", np.uint64), ("windows", np.int32), ("least", np.int64))
        )
        counts = counts.astype(np.int64)
        at_least = np.cumsum(counts) - counts
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        out = []
        for raw, at, ids, rest in _Block(t).slices() if len(t) else ():
            _, first, last, row = runs(raw, at, length, seed)
            key = span_hasher(raw)(first, last + length)
            ok = _member(keys, key)
            first, row, spot = first[ok], row[ok], order[np.searchsorted(keys, key[ok])]
            m = counts[spot]
            smaller = gather(least, at_least[spot], m) < np.repeat(ids[row], m)
            hit = (np.repeat(first - (np.cumsum(m) - m), m) + np.arange(len(smaller)))[smaller]
            marks = np.zeros(len(raw) + 1, np.int32)
            marks[hit] += 1  # a start is in one run only
            marks[hit + length] -= 1
            out.append(finish(raw, at, np.cumsum(marks[:-1]) > 0, rest))
        return pa.concat_tables(out) if out else finish(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool), None)

    asked = packed.groupBy("block").applyInArrow(ask, "bucket int, block int, count int, body binary")
    shared = checkpoint(asked.groupBy("bucket").applyInArrow(which, _ANSWER))
    sent = packed.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(
        send, "bucket int, block int, grams binary, keys binary, sizes binary, ids binary, data binary"
    )
    sorted_ = checkpoint(sent.groupBy("bucket").applyInArrow(sort, "block int, bucket int, keys binary, windows binary, least binary"))
    return packed.groupBy("block").cogroup(sorted_.groupBy("block")).applyInArrow(cut_off, schema)


def _member(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)] == x


def _deltas(part: np.ndarray) -> bytes:
    """Sorted hashes of a bucket as the first one and 5-byte values: the highest bits are the bucket's anyway."""
    value = part >> np.uint64(24)
    return value[:1].tobytes() + np.ascontiguousarray(value.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _undeltas(body: bytes, count: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :5] = np.frombuffer(body[8 : 8 + 5 * count], np.uint8).reshape(-1, 5)
    return out.view(np.uint64)[:, 0]


def digests(docs: DataFrame, length: int = LENGTH, block_bytes: int = 4 << 20) -> DataFrame:
    """The columns of op4 for documents (doc_id, text)."""

    def finish(raw, at, covered, rest):
        n = len(at) - 1
        spans = covered & ~np.append(False, covered[:-1])
        spans[at[:-1][np.diff(at) > 0]] = covered[at[:-1][np.diff(at) > 0]]
        count = lambda x: np.diff(np.append(0, np.cumsum(x))[at]) if n else np.zeros(0, np.int64)
        kept = [hashlib.sha256(raw[at[k] : at[k + 1]][~covered[at[k] : at[k + 1]]].tobytes()).hexdigest() for k in range(n)]
        ids = rest["doc_id"].combine_chunks() if rest is not None else pa.array([], pa.int64())
        return pa.table({"doc_id": ids.cast(pa.int64()), "n_bytes": np.diff(at), "n_removed": count(covered), "n_spans": count(spans), "kept_sha256": pa.array(kept, pa.string())})

    return removal(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length, block_bytes=block_bytes)


def dedup(docs: DataFrame, length: int = LENGTH, block_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``; characters that are cut in two go as a whole.

    Every row stays, and all columns; ``n_chars``, where there is one, follows the text.  A null text stays null.
    """
    order, names = docs.schema, docs.columns
    missing = fresh(docs, "_null")
    flagged = docs.withColumn(missing, F.col("text").isNull())

    def finish(raw, at, covered, rest):
        if rest is None:
            return pa.table({f.name: pa.array([], k) for f, k in zip(order, _kinds(order), strict=True)})
        null = rest[missing].to_pylist()
        text = [None if null[k] else raw[at[k] : at[k + 1]][~covered[at[k] : at[k + 1]]].tobytes().decode("utf-8", "ignore") for k in range(len(at) - 1)]
        columns = {c: rest[c] for c in names if c != "text"} | {"text": pa.array(text, pa.string())}
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([None if x is None else len(x) for x in text], pa.int64()).cast(rest.schema.field("n_chars").type)
        return pa.table([columns[c] for c in names], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in order)
    return removal(flagged, finish, schema, length, block_bytes=block_bytes)


def _kinds(schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).types


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
