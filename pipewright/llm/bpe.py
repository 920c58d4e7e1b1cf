"""Byte-level BPE in DuckDB, inside each task: recursive contraction to encode, ordered aggregation to decode.

Encoding: the pattern cuts a chunk into pieces.  A piece that is a token is that token; all other distinct pieces
become token-position rows, which a recursive query joins with the merge table; each step contracts in every word the
leftmost pair of the lowest rank, until no pair is left.  Chunks are cached (see ``chunks``).  Texts with white space
beyond ASCII are cut by the pattern as a whole.  Decoding: token rows join the byte table and are put together in
position order.  DuckDB runs on one thread with a memory limit, in the worker; nothing is shuffled.

Defined results: null as empty; an empty text has no id and the hashes of nothing; ids out of the vocabulary raise; null
and repeated ids are documents of their own; other columns are not looked at; an empty table gives an empty result.  A
text takes memory in proportion to its length, and so does one unbroken word, which is first cut where no token can lie
across.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .chunks import ChunkCache
from .common import table, text_view

#: White space of the pattern that is not ASCII; fixed values.
_WIDE_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_ENCODE = """
with recursive s(step, w, p, t, np, nt, k) as (
  select 0, w, p, t, p + 1, nt, (m.rank::bigint << 32) | p
  from (select *, lead(t) over (partition by w order by p) as nt from symbols) x left join merges m on m.a = x.t and m.b = x.nt
  union all
  select step + 1, w, p, t, np, nt, case when touched then (m.rank::bigint << 32) | p else k end
  from (
    select s.step, s.w, s.p, s.k, s.p = b.p or s.np = b.p as touched, case when s.p = b.p then b.rank else s.t end as t,
      case when s.p = b.p then b.after_p else s.np end as np,
      case when s.p = b.p then b.after_t when s.np = b.p then b.rank else s.nt end as nt
    from s join (
      select x.w, x.k >> 32 as rank, (x.k & 4294967295)::int as p, x.np, y.np as after_p, y.nt as after_t
      from (select w, min(k) as k, arg_min(np, k) as np from s where k is not null group by w) x join s y on y.w = x.w and y.p = x.np
    ) b on s.w = b.w
    where s.p <> b.np and s.step < {steps}
  ) z left join merges m on m.a = case when z.touched then z.t end and m.b = z.nt
)
select w, t, step from s semi join (select w, max(step) as step from s group by w) using (w, step) order by w, p
"""

#: One long word, ``symbols`` in order: a step contracts all the occurrences of the lowest pair that the leftmost-first
#: rule would take one after the other: every second one of a run that overlaps, and only the first where the new token
#: could be part of a lower pair (``eager``).  STEPS steps at a time, so that the rows kept do not grow with the word.
_ENCODE_LONG = """
with recursive s(step, p, t) as (
  select 0, p, t from symbols
  union all
  select step + 1, row_number() over (order by p) - 1, t
  from (
    select z.step, z.p, case when z.taken then z.rank else z.t end as t
    from (
      select *, coalesce(lag(taken) over (order by p), false) as gone
      from (
        select *, rank = low and (case when first_only then p = min(case when rank = low then p end) over () else (row_number() over (partition by run, rank = low order by p)) % 2 = 1 end) as taken
        from (
          select *, p - row_number() over (partition by rank = low order by p) as run
          from (
            select x.*, m.rank, min(m.rank) over () as low, bool_or(e.rank is not null) over () as first_only
            from (select step, p, t, lead(t) over (order by p) as nt from s) x
            left join merges m on m.a = x.t and m.b = x.nt
            left join eager e on e.rank = m.rank
          )
        )
      )
    ) z where not z.gone and z.step < {steps} and z.low is not null
  ) y
)
select p, t, step from s where step = (select max(step) from s) order by p
"""
STEPS, LONG_WORD, ROWS_KEPT = 16, 512, 1_000_000

_DECODE = "select d, string_agg(piece, '') as s from (select d, piece from tokens join pieces using (id) order by p) group by d order by d"


class DuckBpe:
    """Encoder and decoder for a rank file; one for each worker."""

    def __init__(self, ranks_path: str, pattern: str, memory: str = "250MB"):
        import duckdb
        import regex

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": ""})  # spills to no folder of this machine
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        pairs = np.array(pairs, np.int32).reshape(-1, 3)
        self._load("merges", a=pairs[:, 0], b=pairs[:, 1], rank=pairs[:, 2])
        lower = np.concatenate([pairs[pairs[:, k] > pairs[:, 2], k] for k in (0, 1)])
        self._load("eager", rank=np.unique(lower))  # tokens that are part of a lower one
        tokens = sorted((r, t) for t, r in self.ranks.items())
        self._load("pieces", id=np.array([r for r, _ in tokens], np.int32), piece=[t.decode("latin-1") for _, t in tokens])
        self.bytes = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.bytes < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        self.cache = ChunkCache(self.encode_chunks)
        self.heads: set[bytes] = set()

    def _load(self, name: str, **columns) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"create or replace temp table {name} as select * from incoming")
        self.db.unregister("incoming")

    def parts(self, word: bytes) -> list[bytes]:
        """A long word cut where no token of the vocabulary that occurs in it lies across: its ids are theirs in order."""
        if not self.heads:
            self.heads = {t[:k] for t in self.ranks for k in range(2, len(t) + 1)}
        reach, cuts = 0, [0]
        for i in range(len(word)):
            if i and reach <= i:
                cuts.append(i)
            k = 2
            while word[i : i + k] in self.heads and i + k <= len(word):
                if i + k > reach and word[i : i + k] in self.ranks:
                    reach = i + k
                k += 1
        return [word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)], strict=True)]

    def encode_long(self, word: bytes) -> list[int]:
        """The ids of one word, in space that grows with its length alone.

        While that shortens it well, all occurrences of a pair are contracted in a step; then one pair in a step.
        """
        t, before = self.bytes[np.frombuffer(word, np.uint8)], 2 * len(word)
        while True:
            n = np.arange(len(t), dtype=np.int32)
            if together := len(t) < 0.95 * before:
                self._load("symbols", p=n, t=t)
                steps, sql = STEPS, _ENCODE_LONG
            else:
                self._load("symbols", w=np.zeros(len(t), np.int32), p=n, t=t)
                steps, sql = max(ROWS_KEPT // len(t), 4), _ENCODE
            done = self.db.sql(sql.format(steps=steps)).to_arrow_table()
            before = len(t) if together else before
            t = done["t"].to_numpy().astype(np.int32)
            if len(t) < 2 or done["step"][0].as_py() < steps:
                return t.tolist()

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the ids of each word, of distinct words that are no tokens themselves."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        size = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words), np.uint8)
        owner = np.repeat(np.arange(len(words), dtype=np.int32), size)
        place = (np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        self._load("symbols", w=owner, p=place, t=self.bytes[flat])
        done = self.db.sql(_ENCODE.format(steps=1 << 30)).to_arrow_table()
        return done["t"].to_numpy().astype(np.int32), np.bincount(done["w"].to_numpy(), minlength=len(words))

    def encode_pieces(self, pieces: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the ids of each list of pieces."""
        rare = list(dict.fromkeys(p for x in pieces for p in x if p not in self.ranks))
        got: dict[bytes, list[int]] = {}
        long = {w: self.parts(w) for w in rare if len(w) > LONG_WORD}
        inner = [p for x in long.values() for p in x]
        rare = list(dict.fromkeys(p for p in [*(w for w in rare if w not in long), *inner] if p not in self.ranks))
        for w in [w for w in rare if len(w) > LONG_WORD]:
            got[w] = self.encode_long(w)
        rare = [w for w in rare if len(w) <= LONG_WORD]
        for i in range(0, len(rare), 20_000):
            ids, counts = self.encode_words(rare[i : i + 20_000])
            at, ids = np.concatenate([[0], np.cumsum(counts)]).tolist(), ids.tolist()
            for k, w in enumerate(rare[i : i + 20_000]):
                got[w] = ids[at[k] : at[k + 1]]
        for w, x in long.items():
            if w not in got:
                got[w] = [i for p in x for i in ([self.ranks[p]] if p in self.ranks else got[p])]
        out, lengths = [], []
        for x in pieces:
            before = len(out)
            for p in x:
                r = self.ranks.get(p)
                if r is None:
                    out += got[p]
                else:
                    out.append(r)
            lengths.append(len(out) - before)
        return np.array(out, np.int32), np.array(lengths, np.int64)

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        find = self.pattern.findall
        return self.encode_pieces([[p.encode() for p in find(c.decode())] for c in chunks])

    def encode_column(self, column: pa.Array):
        """Per slice of rows: (first row, row after the last, all ids, ids of each row)."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        wide = pc.fill_null(pc.match_substring_regex(column, _WIDE_SPACE), False).to_numpy(zero_copy_only=False)
        if not wide.any():
            yield from self.cache.encode(*text_view(column))
            return
        i = 0
        while i < len(column):
            if wide[i]:
                yield i, i + 1, *self.encode_chunks([column[i].as_py().encode()])
                i += 1
            else:
                j = i + int(np.argmax(np.append(wide[i:], True)))
                for a, b, ids, n in self.cache.encode(*text_view(column.slice(i, j - i))):
                    yield i + a, i + b, ids, n
                i = j

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The bytes of each sequence."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.ranks)):
            raise ValueError("an id is not in the vocabulary")
        out = [b""] * len(lengths)
        owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self._load("tokens", d=owner, p=np.arange(len(ids), dtype=np.int32), id=ids.astype(np.int32))
        done = self.db.sql(_DECODE).to_arrow_table()
        for d, s in zip(done["d"].to_pylist(), done["s"].to_pylist(), strict=True):
            out[d] = s.encode("latin-1")
        return out


_WORKER: dict[tuple, DuckBpe] = {}


def worker_bpe(ranks_path: str, pattern: str) -> DuckBpe:
    """This worker's coder, built once."""
    if (ranks_path, pattern) not in _WORKER:
        _WORKER[ranks_path, pattern] = DuckBpe(ranks_path, pattern)
    return _WORKER[ranks_path, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of every whole text."""
    path, default = default_vocabulary() if ranks_path is None else (ranks_path, None)
    pattern = pattern or default

    def run(batches):
        bpe = worker_bpe(path, pattern)
        for b in batches:
            for i, j, ids, n in bpe.encode_column(b.column("text")):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(sequences: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and decoded (binary) of every row of (doc_id, ids); null ids as none."""
    path, default = default_vocabulary() if ranks_path is None else (ranks_path, None)
    pattern = pattern or default

    def run(batches):
        bpe = worker_bpe(path, pattern)
        for b in batches:
            column = b.column("ids")
            n = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(bpe.decode(column.flatten().to_numpy(), n), pa.binary())], ["doc_id", "decoded"])

    return sequences.select("doc_id", "ids").mapInArrow(run, f"doc_id {sequences.schema['doc_id'].dataType.simpleString()}, decoded binary")


def digests(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: each text encoded, and its ids decoded again."""
    path, default = default_vocabulary() if ranks_path is None else (ranks_path, None)
    pattern = pattern or default

    def run(batches):
        bpe = worker_bpe(path, pattern)
        for b in batches:
            for i, j, ids, n in bpe.encode_column(b.column("text")):
                at = np.concatenate([[0], np.cumsum(n)])
                raw = ids.astype("<u4").tobytes()
                encoded = [hashlib.sha256(raw[4 * at[k] : 4 * at[k + 1]]).hexdigest() for k in range(j - i)]
                decoded = [hashlib.sha256(x).hexdigest() for x in bpe.decode(ids, n)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), pa.array(n), pa.array(encoded), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
