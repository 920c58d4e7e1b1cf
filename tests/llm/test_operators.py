"""The operators against brute force on small fixtures, and their odd cases."""

import base64
import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pipewright.llm import bpe, chat, chunks, exact_dedup, fingerprint, licenses, minhash, packing, quality, suffix_dedup, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon é ß".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _block string"


def corpus():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(rng.choice([1, 3, 30, 80]))) for _ in range(40)]
    texts += [texts[5], texts[5].upper(), texts[7] + " tail", "x" + texts[9][: len(texts[9]) // 2] + "y" + texts[11], "", None, None, "   \n\t", "a" * 300, "a" * 180, "é" * 90, "  \n b　 c"]
    for base in texts[20:30]:
        w = base.split()
        if len(w) > 40:
            w[20] = "changed"
            texts.append(" ".join(w))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", 1, "clash") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows and ids with two texts."""
    return spark.createDataFrame([(None, "one two three", None, None, None, "c"), (1, "one two three", None, None, None, "c"), (1, "one two three", None, None, None, "c"), (2, None, None, None, None, "c"), (None, None, None, None, None, "c")], SCHEMA)


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute_groups(rows):
    sets, parent = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in sets}


def _thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w


#: A word and its complement that any polynomial hash modulo 2**64 confuses, alone and together.
COLLIDING = [_thue_morse(1024), _thue_morse(1024).translate(str.maketrans("ab", "ba")), _thue_morse(1024) + " " + _thue_morse(1024).translate(str.maketrans("ab", "ba"))]


def test_near_groups(docs, rows):
    got = {r.doc_id: r.class_id for r in minhash.near_groups(docs).collect()}
    assert got == brute_groups(rows)


def test_crowds_lose_no_link(spark):
    """Many texts in one chain of near-duplicates, none of which is near to the first leader."""
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(30):
        w = list(words)
        for k in range(i):
            w[k] = f"v{k}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.class_id for r in minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), rounds=0).collect()}
    assert got == brute_groups(rows)


def test_weighted_signatures_estimate_weighted_similarity():
    a, b = "x y z " * 30 + "a b c d e f g h", "x y z " * 30 + "i j k l m n o p"
    raw = [minhash.shingles(*minhash.text_view(pa.array([t])), counts=True) for t in (a, b)]
    sets = [dict(zip(h.tolist(), w.tolist(), strict=True)) for _, h, w in raw]
    keys = set(sets[0]) | set(sets[1])
    truth = sum(min(s.get(k, 0) for s in sets) for k in keys) / sum(max(s.get(k, 0) for s in sets) for k in keys)
    signs = [minhash.dart_minhash(r, h, w, 1, 2048)[0] for r, h, w in raw]
    assert abs((signs[0] == signs[1]).mean() - truth) < 0.05


def test_near_odd(odd, none):
    assert minhash.near_groups(none).count() == 0
    assert minhash.near_dedup(odd).count() == 5


def test_bpe(docs, rows):
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    extra = docs.sparkSession.createDataFrame([(900, "it's 12 we'll\r\n\t  x    y"), (901, "<|endoftext|>"), (902, "z" * 5000), (903, "z" * 100_000), *((904 + i, t) for i, t in enumerate(COLLIDING)), (908, "ab" * 3000 + "ba" * 2000 + "日本" * 400), (909, "word " * 20_000)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(extra)
    texts = {r.doc_id: r.text or "" for r in every.collect()}
    got = {r.doc_id: r for r in bpe.digests(every).collect()}
    for d, t in texts.items():
        ids = coder.encode_ordinary(t)
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()), repr(t)[:80]
        assert got[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(bpe.encode(every)).collect()} == texts


def test_bpe_odd(odd, none):
    got = bpe.digests(odd).collect()
    assert len(got) == 5 and sorted(r.n_tokens for r in got) == [0, 0, 3, 3, 3] and sum(r.doc_id is None for r in got) == 2
    assert bpe.digests(none).count() == 0 and bpe.encode(none).count() == 0


def test_chunks_under_one_hash_keep_apart():
    from pipewright.llm.chunks import ChunkCache
    from pipewright.llm.common import text_view

    cache = ChunkCache(lambda chunks: (np.array([c[0] * 1000 + len(c) for c in chunks], np.int32), np.ones(len(chunks), np.int64)))
    for texts in (COLLIDING[:1], COLLIDING[1:2], COLLIDING, ["a" * 7, "a" * 8, "a" * 9]):
        for _, _, ids, n in cache.encode(*text_view(pa.array(texts))):
            got = np.split(ids, np.cumsum(n)[:-1])
            assert [x.tolist()[0] for x in got] == [ord(t[0]) * 1000 + len(t.split()[0]) for t in texts]


def brute_removal(rows, n=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            first[b[i : i + n]] = min(first.get(b[i : i + n], d), d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < d:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("block_bytes", [400, 1 << 22])
def test_suffix_dedup(docs, rows, block_bytes):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(docs, block_bytes=block_bytes).collect()}
    assert got == brute_removal(rows)


def test_suffix_groups_sort_by_all_bytes():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 4000).astype(np.uint8)
    text[1000:1400] = text[2000:2400]
    starts, ends = np.array([0, 900, 1900]), np.array([800, 1500, 2600])
    order, groups = suffix_dedup.suffix_groups(text, starts, ends, 50)
    words = [text[i : i + 50].tobytes() for i in order]
    assert words == sorted(words)
    assert sorted(order) == [i for s, e in zip(starts, ends, strict=True) for i in range(s, e - 49)]
    assert [0, *(i for i in range(1, len(words)) if words[i] != words[i - 1])] == groups.tolist()


def test_suffix_stage_keeps_rows(docs, odd, none):
    out = suffix_dedup.dedup(docs)
    assert out.schema.simpleString() == docs.schema.simpleString() and out.count() == docs.count()
    assert {r.text for r in suffix_dedup.dedup(odd).collect()} == {None, "one two three"}
    assert suffix_dedup.dedup(none).count() == 0 and suffix_dedup.digests(none).count() == 0


def test_packing(docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [*rows, *((900 + i, t) for i, t in enumerate(COLLIDING)), (910, "hello <|endoftext|> x"), (911, "A<|EndOfText|>b it's 1,234"), (None, "no id"), (3, "again"), (3, "again"), (912, "word " * 20_000)]
    docs = docs.sparkSession.createDataFrame([(i, t, None, "s", 1, "clash") for i, t in rows], SCHEMA).repartition(3)
    got = packing.pack(docs, capacity=64).collect()
    repeated = [r for r in got if r.doc_id == 3]
    assert len([r for r in repeated if r.piece == 0]) == 3  # rows with one id are documents of their own
    placed = sorted((r.sequence_id, r.offset, r.length) for r in got)
    at = {}
    for s, o, n in placed:
        assert o == at.get(s, 0)
        at[s] = o + n
    assert max(at.values()) <= 64
    rows, got = [(d, t) for d, t in rows if d != 3], [r for r in got if r.doc_id != 3]
    pieces = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got}
    want = {}
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 64):
            want[d, k // 64] = (k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes()))
    assert pieces == want and len(got) == len(want)
    assert packing.pack(none).count() == 0


def test_packing_is_optimal_on_small_instances():
    rng = random.Random(1)

    def optimum(items, cap):
        best = len(items)

        def place(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= cap:
                    bins[k] += items[i]
                    place(i + 1, bins)
                    bins[k] -= items[i]
            place(i + 1, [*bins, items[i]])

        place(0, [])
        return best

    def reduced(counts):
        fixed = []
        packing.reduce_by_dominance(counts.copy(), 20, fixed)
        return fixed

    near = triples = 0
    for _ in range(150):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = np.bincount(items, minlength=21)
        plan = packing.pack_histogram(counts, 20)
        placed = sorted((x for lengths, m in plan for x in lengths * m), reverse=True)
        assert placed == items and all(sum(x) <= 20 for x, _ in plan)
        n, best = sum(m for _, m in plan), optimum(items, 20)
        assert packing.lower_bound(counts, 20) <= best <= n <= best + 1
        triples += any(len(x) == 3 for x, _ in reduced(counts))
        near += n == best
        fixed, left = [], counts.copy()
        packing.reduce_by_dominance(left, 20, fixed)
        rest = [x for x in range(20, 0, -1) for _ in range(left[x])]
        assert sum(m for _, m in fixed) + (optimum(rest, 20) if rest else 0) == best  # what is fixed costs nothing
    assert near >= 140 and triples > 0
    whole = np.bincount(np.random.default_rng(2).integers(1, 4097, 20_000), minlength=4097)
    used, bound = sum(m for _, m in packing.pack_histogram(whole, 4096)), packing.lower_bound(whole, 4096)
    assert bound <= used <= bound * 1.01


def test_exact_dedup(docs, rows, odd, none):
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(fold(t), []).append(d)
    want = {d: (max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.duplicate_groups(docs).collect()}
    assert got == want
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(docs).collect()) == sorted(map(max, groups.values()))
    kept = exact_dedup.duplicate_groups(odd).collect()
    assert len(kept) == 5 and sum(r.kept for r in kept) == 2
    assert exact_dedup.exact_dedup(odd).count() == 2 and exact_dedup.exact_dedup(none).count() == 0


def test_fingerprints(docs, rows, odd, none):
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    order = sorted(rows, reverse=True)
    for i, (d, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
        assert (got[d].fingerprint == got[d].edited_fingerprint) or t.split() != edited.split()
    assert got[5].fingerprint == got[40].fingerprint != got[7].fingerprint
    long = [r for r in got.values() if r.n_chars > 300]
    assert np.mean([r.near_edited for r in long]) > 0.3 > np.mean([r.near_next for r in long])
    assert fingerprint.fingerprints(odd).count() == 5 and fingerprint.fingerprints(none).count() == 0


def test_likeness_is_of_all_anchors(spark):
    """Long texts and repeated anchors, against the syncmers counted one by one."""
    from collections import Counter

    rng = random.Random(8)
    long = [f"w{rng.randrange(3000)}" for _ in range(3000)]
    near = [*long[:1500], "one", "two", "three", *long[1503:]]
    turned = [w for k in range(0, 3000, 20) for w in long[2980 - k : 3000 - k]]
    texts = [(4, " ".join(turned)), (3, " ".join(long)), (2, " ".join(near)), (1, "a b c d e f g " * 50), (0, "a b c d e f g " * 20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: r.s for r in docs.select("doc_id", fingerprint.syncmers(fingerprint.F.col("text")).alias("s")).collect()}

    def places(syncmers):
        seen, out = Counter(), {}
        for s in syncmers:
            out[s.hash, seen[s.hash]] = s.position
            seen[s.hash] += 1
        return out

    count = {d: places(s) for d, s in found.items()}

    def dice(a, b):
        both = sorted((a[k], b[k]) for k in a if k in b)
        return 2 * sum(i == 0 or both[i][1] > both[i - 1][1] for i in range(len(both))) / (len(a) + len(b))

    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    for a, b in ((4, 3), (3, 2), (2, 1), (1, 0), (0, 4)):
        assert abs(got[a].near_next - dice(count[a], count[b])) < 1e-12
    assert got[4].near_next < 0.8 and 0.9 < got[3].near_next < 1 and got[1].near_next < 0.7 and len(got[3].fingerprint) == 64 * 8


def test_short_texts_have_an_anchor(spark):
    """Of 4 and 5 words many have no closed syncmer; only empty texts have no fingerprint."""
    rng = random.Random(9)
    texts = [(i, " ".join(rng.sample(WORDS, 4 + i % 2))) for i in range(60)] + [(60, ""), (61, None), (62, "  ")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bare = {r.doc_id for r in docs.select("doc_id", fingerprint.syncmers(fingerprint.F.col("text")).alias("s")).collect() if not r.s}
    assert {i % 2 for i in bare if i < 60} == {0, 1}
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    assert {i for i, r in got.items() if not r.fingerprint} == {60, 61, 62}
    assert got[62].near_next == got[61].near_next == 1 and got[60].near_next == 0
    assert all(got[i].near_next == 0 for i in bare if 0 < i < 60)


def test_syncmers_are_closed(spark):
    text = " ".join(f"w{i % 17}" for i in range(60))
    df = spark.createDataFrame([(text,)], "text string").select(fingerprint.syncmers(fingerprint.F.col("text")).alias("s"), fingerprint.F.transform(fingerprint.F.split("text", " "), lambda w: fingerprint.F.xxhash64(w)).alias("h"))
    r = df.first()
    want = [i for i in range(57) if min(r.h[i : i + 4]) in (r.h[i], r.h[i + 3])]
    assert [s.position for s in r.s] == want


def test_licenses(spark, none):
    files = spark.createDataFrame(
        [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/code", "some code\nand more"), (3, "a/b/c/x", "Licensed under the Apache License, Version 2.0.\nint main one two three four five"), (4, "z/x", "nothing"), (5, None, None), (6, "a/b/COPYING", "Licensed under CC BY-NC 4.0."), (2, "a/b/code", "some code\nand more")],
        "file_id long, path string, text string",
    )
    got = sorted((r.file_id, r.license, r.origin) for r in licenses.scan(files).collect())
    assert got == [(1, "MIT", "file"), (2, "CC-BY-NC-4.0", "inherited"), (2, "CC-BY-NC-4.0", "inherited"), (3, "Apache-2.0", "header"), (4, None, None), (5, None, None), (6, "CC-BY-NC-4.0", "file")]
    assert licenses.scan(files.limit(0)).count() == 0


def test_license_frequencies_are_of_all_lines(spark):
    """Lines without a template's word count too: else the words of notices are taken for common ones."""
    notes = "\n".join("released mit license" if i % 2 else "licensed apache license version 2 0" for i in range(200))
    header = "# 2021 Example Corp. Licensed under the Apache License, Version 2.0"
    prose = "\n".join(f"example corp 2021 filler number {i}" for i in range(400))
    files = spark.createDataFrame([(1, "a/x", header), (2, "b/y", notes), (3, "c/z", prose)], "file_id long, path string, text string")
    df, n = licenses.line_frequencies(files)
    assert n == 601 and {r.term: r.df for r in df.where("term in ('mit', 'corp', 'filler')").collect()} == {"mit": 100, "corp": 401, "filler": 400}
    whole = {r.file_id: r for r in licenses.scan(files).collect()}
    assert whole[1].license == "Apache-2.0" and whole[1].score > 0.7


def test_whole_licence_files(spark):
    """A licence's full text, with a holder's line, is a licence file and gives its licence to the files beside and below."""
    folder = os.path.join(os.path.dirname(licenses.__file__), "licence_texts")
    names = sorted(n.removesuffix(".txt") for n in os.listdir(folder))
    assert {"MIT", "Apache-2.0", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(names)
    rows, want = [], {}
    for i, name in enumerate(names):
        with open(os.path.join(folder, f"{name}.txt")) as f:
            text = "Copyright (c) 2021 Example Corp.\n\n" + f.read()
        rows += [(3 * i, f"{name}/LICENSE", text), (3 * i, f"{name}/LICENSE", text), (3 * i + 1, f"{name}/src/x", "int main one two"), (3 * i + 2, f"other{i}/x", "some words, you may use the software freely")]
        want |= {3 * i: (name, "file"), 3 * i + 1: (name, "inherited"), 3 * i + 2: (None, None)}
    got = licenses.scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()
    assert len(got) == len(rows) and {r.file_id: (r.license, r.origin) for r in got} == want


def brute_cost(roles):
    """The least cost over all repairs, by trying every one."""

    def go(state, rest):
        if not rest:
            return 0
        r, out = rest[0], []
        if state is not None:
            out.append(chat.MERGE + chat._relabel(r, state) + go(state, rest[1:]))
        for to in chat.FOLLOWS[state]:
            out.append(chat._relabel(r, to) + go(to, rest[1:]))
            out += [chat.INSERT + chat._relabel(r, x) + go(x, rest[1:]) for x in chat.FOLLOWS[to]]
        return min(out)

    return go(None, list(roles))


def test_chat_repair():
    rng = random.Random(2)
    for _ in range(200):
        roles = [rng.choice(["system", "user", "assistant", "tool", ""]) for _ in range(rng.randint(1, 6))]
        cost, steps = chat.repair(roles)
        assert cost == brute_cost(roles)
        repaired, _ = chat.render(steps, ["t"] * len(roles))
        state = None
        for r in repaired:
            assert r in chat.FOLLOWS[state]
            state = r


def test_long_conversations_are_chains(spark, monkeypatch):
    """Segments, ranges and conversations that cross them give what one pass over each conversation gives."""
    monkeypatch.setattr(chat, "SEGMENT", 5)
    rng, rows = random.Random(6), []
    for c in [None, *range(12)]:
        rows += [(c, k, rng.choice(["system", "user", "assistant", "tool", None]), f"t{c}.{k}") for k in range(rng.choice([1, 2, 4, 23, 60]))]
    rows += [(50, None, "user", None), (50, None, "user", None)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")
    got = {}
    for r in sorted(chat.format_chats(turns.repartition(3)).collect(), key=lambda r: r.part):
        n, cost, roles, text = got.get(r.conv_id, (0, 0, [], ""))
        got[r.conv_id] = (n + r.n_turns, cost + r.cost, roles + (r.roles.split(",") if r.roles else []), text + r.rendered)
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))
        cost, _ = chat.repair([r[2] or "" for r in mine])
        n, total, roles, text = got[c]
        assert (n, total) == (len(mine), cost), c
        state = None
        for r in roles:
            assert r in chat.FOLLOWS[state]
            state = r
        assert text.count("<|end|>\n") == len(roles) == text.count("<|") - text.count("<|end|>")
        assert [x for x in text.replace("<", "\n<").split("\n") if x.startswith("t")] == [r[3] for r in mine if r[3]]


def test_chat_rendering(spark):
    turns = spark.createDataFrame([(1, 2, "Assistant", "b <|user|>"), (1, 1, "user", "a"), (2, 0, "assistant", None), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.cost, r.roles, r.rendered) for r in chat.format_chats(turns).collect()}
    assert got[1] == (0, "user,assistant", "<|user|>\na<|end|>\n<|assistant|>\nb < |user|><|end|>\n")
    assert got[2][0] == 2 and len(got) == 3 and chat.format_chats(turns.limit(0)).count() == 0


def test_toxicity(spark):
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in WORDS for b in "xyz"]
    rows = []
    for i in range(600):
        words = [rng.choice(vocabulary) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            words[rng.randrange(60)] = rng.choice(["nastyword", "nastywords", "vileness"])
        if rng.random() < (0.6 if bad else 0.1):
            words[rng.randrange(60)] = "muslim"
        rows.append((i, " ".join(words), int(bad)))
    data = spark.createDataFrame(rows, "doc_id long, text string, label int")
    fair, free = (toxicity.fit(data.where("doc_id < 450"), fairness=f) for f in (50.0, 0.0))
    scores = np.array([r.score for r in toxicity.score(data.where("doc_id >= 450"), fair).orderBy("doc_id").collect()])
    truth = np.array([r[2] for r in rows[450:]])
    assert ((scores >= 0.5) == truth).mean() > 0.95
    assert toxicity.swapped("All women, and (Men).") == "all men, and (women)." and toxicity.swapped("jüdisch!") == "christlich!" and toxicity.swapped("Plain") == "plain"
    assert toxicity.score(data.limit(0), fair).count() == 0
    twice = toxicity.score(data.limit(1).unionByName(data.limit(1)).withColumn("score", data.label), fair, ("doc_id", "score"), "_s").collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    gap = lambda m: abs(np.subtract(*m.score_batch(pa.array(["my muslim neighbour", "my christian neighbour"]))))
    assert gap(fair) < 0.5 * gap(free) + 1e-6
    odd = toxicity.score(spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string"), fair).collect()
    assert len({r.score for r in odd}) == 1


def test_quality():
    rng = random.Random(4)
    good = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 80))).capitalize() + "." for _ in range(200)]
    junk = [" ".join(rng.choice(WORDS).upper() + "!!" for _ in range(rng.randint(5, 80))) for _ in range(200)]
    x, y = quality.features(pa.array(good + junk)), np.array([1.0] * 200 + [0.0] * 200)
    train = np.arange(400) % 4 != 0
    model = quality.fit_arrays(x[train], y[train], rounds=20)
    assert ((model.score(x[~train]) >= 0.3) == y[~train]).mean() > 0.97
    assert quality.features(pa.array([None, "", "a"], pa.string())).shape == (3, len(quality.FEATURES))
    assert quality.fit_arrays(x[:5], y[:5]).score(x[:2]).tolist() == [1.0, 1.0]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_accuracy(spark):
    labels = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    for module, name in ((toxicity, "toxic"), (quality, "quality")):
        rows = [r for r in module.query(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
        assert np.mean([r.predicted == labels[r.doc_id][name] for r in rows]) > 0.9


def test_crowds_of_several_tiles(spark, monkeypatch):
    """Hot buckets, hot leaders and crowds of more than one tile lose no link either."""
    from pipewright.llm import common

    for module, name, n in ((common, "HOT", 4), (minhash, "TILE", 8), (minhash, "SHARE", 4)):
        monkeypatch.setattr(module, name, n)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(80)] = f"x{rng.randrange(900)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, rows[3][1]) for i in range(20)] + [(200 + i, " ".join(f"y{i}z{k}" for k in range(30))) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds in (0, 2):
        got = {r.doc_id: r.class_id for r in minhash.near_groups(docs, rounds=rounds).collect()}
        assert got == brute_groups(rows)


def test_exact_dedup_of_a_hot_text(spark, monkeypatch):
    from pipewright.llm import common

    monkeypatch.setattr(common, "HOT", 5)
    rows = [(i, "the same" if i % 3 else f"own {i}" + " x" * 3000) for i in range(60)] + [(None, "The Same")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (59, 41, i == 59) if i is None or i % 3 else (i, 1, True) for i, _ in rows}


@pytest.mark.parametrize("share", [1 << 17, 40])
def test_components_of_one_and_of_many_shares(spark, monkeypatch, share):
    monkeypatch.setattr(minhash, "EDGES", share)
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(60)] + [(int(a), int(b)) for a, b in rng.integers(100, 400, (150, 2)) if a != b] + [(500, k) for k in range(501, 560)] + [(7, 3), (3, 7)]
    low = {x: x for e in edges for x in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    frame = spark.createDataFrame(edges, "x long, y long").repartition(9)
    assert dict(minhash.components(frame).collect()) == low


def test_components_of_a_small_graph_take_few_jobs(spark):
    """Each job of many small tasks costs disk: shuffle files and the event log."""
    sc = spark.sparkContext
    sc.setJobGroup("components", "components")
    found = minhash.components(spark.range(1, 2000).selectExpr("id as x", "id - 1 as y"))
    assert found.where("label = 0").count() == 2000
    jobs = len(sc.statusTracker().getJobIdsForGroup("components"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 12


def test_a_full_cache_keeps_what_is_met_again():
    learnt = []

    def encoder(some):
        learnt.extend(some)
        return np.concatenate([np.frombuffer(c, np.uint8) for c in some]).astype(np.int32), np.fromiter(map(len, some), np.int64, len(some))

    cache = chunks.ChunkCache(encoder, most=60)
    for k in range(50):
        text = b"the same few words" + b"".join(b" once%d" % (20 * k + i) for i in range(20))
        for _, _, ids, n in cache.encode(np.frombuffer(text, np.uint8), np.array([0, len(text)])):
            assert ids.astype(np.uint8).tobytes() == text and n.tolist() == [len(text)]
    assert len(cache.keys) <= 60 and learnt.count(b" few") == 1
