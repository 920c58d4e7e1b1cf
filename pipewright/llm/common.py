"""Helpers shared by the operators: tables, checkpoints and byte-level views of Arrow text."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step handles at once; bounds a worker's temporary arrays.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``.

    A temporary one is set only where that is unset, on a single machine (tests); a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


def checkpoint(df: DataFrame, tidy_up: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    Shuffle files that only the cut lineage needed go once the driver collects its garbage, so that is done here, unless
    what was cut is small.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    out = df.checkpoint(eager=True)
    del df
    if tidy_up:
        drop_shuffles(spark)
    return out


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files go once nothing on the driver points to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a compressed table in the shared folder: for columns that repeat much, and in loops, as what
    the planner infers of a checkpoint's columns grows with each round."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark, schema = df.sparkSession, df.schema
    del df
    drop_shuffles(spark)
    out = spark.read.schema(schema).parquet(path)
    out.stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``stored`` that nothing will read again."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Groups of more rows than HOT, and than the HOT_KEYS-th part of all rows, are joined back by broadcast: at most
#: HOT_KEYS of them.
HOT, HOT_KEYS = 512, 100_000


def join_back(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` joined with one row of ``groups`` for each key (equal nulls too), without one task for a hot key.

    ``size``: the column of ``groups`` with a key's number of rows; ``total``: the number of all rows.  There are fewer
    than total / limit groups above the limit, so what is broadcast has HOT_KEYS rows at most.  Their rows pass the
    shuffle of the others dealt by their own contents.
    """
    limit = max(HOT, total // HOT_KEYS)
    if groups.where(F.col(size) > limit).isEmpty():
        other = groups.select(*(F.col(c).alias(f"_g{i}") if (i := keys.index(c) if c in keys else -1) >= 0 else F.col(c) for c in groups.columns))
        return rows.join(other, [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]).drop(*(f"_g{i}" for i in range(len(keys))))
    values = [c for c in groups.columns if c not in keys]
    named = lambda tag: [F.col(k).alias(f"_{tag}{i}") for i, k in enumerate(keys)] + [F.col(c).alias(f"_{tag}_{c}") for c in values]
    same = lambda tag: [F.col(k).eqNullSafe(F.col(f"_{tag}{i}")) for i, k in enumerate(keys)]
    hot = groups.where(F.col(size) > limit).select(*named("h"))
    cold = groups.where(F.col(size) <= limit).select(*named("c"), F.lit(0).alias("_none"))
    deal = F.when(F.col(f"_h_{size}").isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.lit(4096)) + 1).otherwise(0).cast("int")
    first = rows.join(F.broadcast(hot), same("h"), "left").withColumn("_deal", deal)
    both = first.join(cold, [*same("c"), F.col("_deal") == F.col("_none")], "left")
    found = both.where(F.col(f"_h_{size}").isNotNull() | F.col(f"_c_{size}").isNotNull())
    pick = [F.when(F.col(f"_h_{size}").isNotNull(), F.col(f"_h_{c}")).otherwise(F.col(f"_c_{c}")).alias(c) for c in values]
    return found.select(*(F.col(c) for c in rows.columns), *pick)


@contextlib.contextmanager
def records_per_batch(spark: SparkSession, n: int):
    """Arrow batches of at most ``n`` rows for what is run inside: for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def trim() -> None:
    """Give what this process has freed back to the system: a worker lives on after its task, beside those of the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps its pages
        ctypes.CDLL(None).malloc_trim(0)


def tidy(work):
    """``work`` over Arrow batches, with memory given back before the first and after each."""

    def run(batches):
        def source():
            trim()  # of what an earlier task left
            for b in batches:
                yield b
                trim()

        yield from work(source())

    return run


def held_out(doc_id: str = "doc_id"):
    """The fixed fold: crc32 of the id's text, modulo 5, is 0.  A null id is in no fold (false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def text_view(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array, without a copy where possible; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    _, offsets, data = column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(at: np.ndarray, most: int = SLICE_BYTES):
    """Consecutive row ranges (i, j) of at most ``most`` bytes each, or of one row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = int(np.searchsorted(at, at[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}
_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hasher(raw: np.ndarray):
    """A function (starts, ends) -> 64-bit hashes of those byte ranges of ``raw``; equal bytes, equal hashes."""
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[raw] * up[: len(raw)], out=sums[1:])

    def hashes(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    return hashes


def gram_hashes(raw: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all byte n-grams of ``raw``."""
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    codes = _BYTE_CODES[raw]
    codes *= up[: len(raw)]
    np.cumsum(codes, out=sums[1:])
    x = sums[n:] - sums[:-n]
    x *= down[: len(x)]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def words(raw: np.ndarray, at: np.ndarray, separator: np.ndarray):
    """(starts, ends, rows) of the maximal runs of non-separator bytes; no run crosses a row."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~separator[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(raw) + 1, bool)
    after[:-1] = inside
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def _separators(alnum_only: bool) -> np.ndarray:
    out = np.zeros(256, bool)
    for b in range(128):
        out[b] = not chr(b).isalnum() if alnum_only else chr(b).isspace()
    return out


#: ASCII white space splits words; or every ASCII byte that is no letter or digit does.
SPACES, NON_ALNUM = _separators(False), _separators(True)
