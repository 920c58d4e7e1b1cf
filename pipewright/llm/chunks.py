"""Tokenising whole corpora through a cache of white-space chunks.

A text is cut before every run of ASCII white space, so that a chunk is such a run and what follows it.  Neither
tokeniser here ever joins characters across such a cut, so a text's ids are those of its chunks in order.  A worker
keeps the ids of the chunks it has met, up to ``most`` entries or ``most_bytes`` of text; then it goes on with those met
in more than one slice since the last time, or starts afresh where even these are over half of that.  Chunks
are looked up by 64-bit hashes, and every one found is compared with the chunk kept by its bytes: one whose hash is
another chunk's is encoded by itself.

A tokeniser that never joins letters, digits and marks may be cut between those too (``kinds``): far fewer chunks are
distinct where a word with a comma after it is no chunk of its own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .common import slices, span_hasher

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def ascii_kinds() -> np.ndarray:
    """1 for ASCII letters, 2 for digits, 3 for printable marks; 0 for all other bytes and for the apostrophe, beside
    which nothing is cut: contractions are tokens of their own."""
    out = np.zeros(256, np.uint8)
    for b in range(33, 127):
        out[b] = 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3
    out[ord("'")] = 0
    return out


#: Takes the bytes of distinct chunks; returns all their ids in order and each one's number of ids.
Encoder = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of pool[s : s + n] over all (s, n)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether a[x : x + n] equals b[y : y + n], for each (x, y, n): 8 bytes of each pair at a time, as long as some
    pair is so long; both arrays have 8 bytes to spare."""
    word = lambda raw: np.lib.stride_tricks.as_strided(raw.view(np.uint8)[:8].view(np.uint64), (len(raw) - 7,), (1,))
    u, v = word(a), word(b)
    out = np.ones(len(lengths), bool)
    left, x, y, some = lengths, a_at, b_at, None
    while len(left):
        shift = np.uint64(8) * np.maximum(8 - left, 0).astype(np.uint64)
        differ = ((u[x] ^ v[y]) << shift) != 0
        if differ.any():
            out[np.flatnonzero(differ) if some is None else some[differ]] = False
        more = np.flatnonzero((left > 8) & ~differ)
        some = more if some is None else some[more]
        left, x, y = left[more] - 8, x[more] + 8, y[more] + 8
    return out


class ChunkCache:
    def __init__(self, encoder: Encoder, most: int = 600_000, kinds: np.ndarray | None = None, most_bytes: int = 32 << 20):
        """``kinds``: a number for each byte; a text is also cut between two of different numbers, neither 0, and
        between two digits (number 2)."""
        self.encoder, self.most, self.kinds, self.most_bytes = encoder, most, kinds, most_bytes
        self._clear()

    def _clear(self):
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)
        #: the bytes of all chunks kept, with 8 to spare, and where each begins and how long it is
        self.text = np.zeros(8, np.uint8)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)

    def _thin(self) -> None:
        """Go on with the chunks met again since they were learnt or last kept."""
        kept = np.flatnonzero(self.again)
        size, lengths = self.size[kept], self.lengths[kept]
        if 2 * len(kept) > self.most or 2 * int(size.sum()) > self.most_bytes:
            self._clear()
            return
        self.text = np.concatenate([gather(self.text, self.at[kept], size), np.zeros(8, np.uint8)])
        self.pool = gather(self.pool, self.starts[kept], lengths)
        self.at, self.starts = np.cumsum(size) - size, np.cumsum(lengths) - lengths
        self.keys, self.size, self.lengths, self.again = self.keys[kept], size, lengths, np.zeros(len(kept), bool)

    def _learn(self, keys: np.ndarray, chunks: list[bytes]) -> None:
        ids, lengths = self.encoder(chunks)
        starts = len(self.pool) + np.cumsum(lengths) - lengths
        self.pool = np.concatenate([self.pool, ids.astype(np.int32)])
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        at = len(self.text) - 8 + np.cumsum(size) - size
        self.text = np.concatenate([self.text[:-8], np.frombuffer(b"".join(chunks), np.uint8), np.zeros(8, np.uint8)])
        columns = ((self.keys, keys), (self.starts, starts), (self.lengths, lengths), (self.at, at), (self.size, size), (self.again, np.zeros(len(keys), bool)))
        keys, *rest = (np.concatenate(x) for x in columns)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.starts, self.lengths, self.at, self.size, self.again = (x[order] for x in rest)

    def encode(self, raw: np.ndarray, at: np.ndarray):
        """Per slice of rows: (first row, row after the last, all ids, ids of each row)."""
        for i, j in slices(at):
            part, edges = raw[at[i] : at[j]], at[i : j + 1] - at[i]
            if not len(part):
                yield i, j, np.zeros(0, np.int32), np.zeros(j - i, np.int64)
                continue
            white = WHITE[part]
            cut = np.zeros(len(part) + 1, bool)
            cut[1:-1] = white[1:] & ~white[:-1]
            if self.kinds is not None:
                kind = self.kinds[part]
                left, right = kind[:-1], kind[1:]
                cut[1:-1] |= ((left != right) | (left == 2)) & (left > 0) & (right > 0)
            cut[edges] = True
            starts = np.flatnonzero(cut)
            starts, ends = starts[:-1], starts[1:]
            unique, first, inverse = np.unique(span_hasher(part)(starts, ends), return_index=True, return_inverse=True)
            spot = np.searchsorted(self.keys, unique)
            known = np.zeros(len(unique), bool)
            inside = spot < len(self.keys)
            known[inside] = self.keys[spot[inside]] == unique[inside]
            self.again[spot[known]] = True
            if not known.all():
                if len(self.keys) + len(unique) > self.most or len(self.text) + len(part) > self.most_bytes:
                    self._thin()
                    known = np.isin(unique, self.keys, assume_unique=True)
                text = part.tobytes()
                self._learn(unique[~known], [text[starts[k] : ends[k]] for k in first[~known]])
                spot = np.searchsorted(self.keys, unique)
            spot = spot[inverse]
            wide = np.concatenate([part, np.zeros(8, np.uint8)])
            right = self.size[spot] == ends - starts
            if right.all():
                right = same_bytes(wide, starts, self.text, self.at[spot], ends - starts)
            else:
                right[right] = same_bytes(wide, starts[right], self.text, self.at[spot][right], (ends - starts)[right])
            lengths, begins, pool = self.lengths[spot], self.starts[spot], self.pool
            if not right.all():  # another chunk has this hash
                k = np.flatnonzero(~right)
                text = part.tobytes()
                more, sizes = self.encoder([text[starts[x] : ends[x]] for x in k])
                begins[k], lengths[k] = len(pool) + np.cumsum(sizes) - sizes, sizes
                pool = np.concatenate([pool, more.astype(np.int32)])
            ids = gather(pool, begins, lengths)
            upto = np.concatenate([[0], np.cumsum(lengths)])
            yield i, j, ids, np.diff(upto[np.searchsorted(starts, edges)])
