"""The training-data operators against brute force, on small documents with every awkward case."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

from gleanframe.llm import bpe, common, cotrain, minhash, packing, rlz_dedup, simhash, suffix_dedup, token_counts, toxicity, wfst
from gleanframe.llm.exact_dedup import DigestIndex, exact_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, block int, n_tokens int, component_id string"
GAPS = "[\x20\x09-\x0d]+"


def documents():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)] + ["Über", "naïve", "日本語", "don't", "<|endoftext|>"]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage, long = text(90), text(4000)
    texts = [None, "", " \n\t", "one", "two words", "Two Words", text(30), text(300), long, long, long + " tail", passage, text(40) + " " + passage + "\n" + text(40), passage.replace(" ", "  ")]
    texts += ["a" * 1500, "ab" * 700, text(13), "x " * 500, "no break " + "y" * 3000, " ".join(passage.split()[3:]), "Latin ÀÉÎ     mix\x1cend"]
    near = text(400).split()
    for k in range(6):
        copy = list(near)
        copy[k * 7] = "changed"
        texts.append(" ".join(copy))
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts)]
    rows += [(500, passage), (500, passage), (None, passage), (None, text(50)), (7, text(20)), (10**12, "one")]
    rng.shuffle(rows)
    return [(i, t, "en", "s", None if t is None else len(t), "clash", 1, 2, "clash") for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(rows):
    return [(r[0], r[1] or "") for r in rows]


def ordered(values):
    return sorted(values, key=repr)


def test_exact_dedup(spark, docs, rows, none):
    index = DigestIndex(spark, common.scratch_path(spark, "index"), 4)
    got = ordered(tuple(r) for r in exact_dedup(docs, index).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    groups = {}
    for i, t in pairs(rows):
        groups.setdefault(t, []).append(i)
    want = []
    for i, t in pairs(rows):
        keep = max((x for x in groups[t] if x is not None), default=None)
        want.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert got == ordered(want)
    # new data meets the index that is there
    again = DigestIndex(spark, index.path, 4, index.name)
    later = exact_dedup(spark.createDataFrame([(2_000_000, "one"), (2_000_001, "never seen")], "doc_id long, text string"), again).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in later} == {(2_000_000, 10**12, 3, False), (2_000_001, 2_000_001, 1, True)}
    assert again.table().where("first").count() == len(groups) + 1
    # a text that was rare in the index is hot in a batch
    many = exact_dedup(spark.createDataFrame([(3_000_000 + k, "never seen") for k in range(2000)], "doc_id long, text string"), again)
    assert many.where("group_size = 2001 and keep_id = 2000001 and not kept").count() == 2000
    assert exact_dedup(none, DigestIndex(spark, common.scratch_path(spark, "index"), 4)).count() == 0


def test_hot_digests(spark):
    docs = spark.createDataFrame([(k, "same" if k % 3 else f"t{k}") for k in range(3000)], "doc_id long, text string")
    got = exact_dedup(docs, DigestIndex(spark, common.scratch_path(spark, "index"), 4))
    assert got.where("kept").count() == 1001 and got.where("group_size = 2000 and keep_id = 2999").count() == 2000


@pytest.mark.parametrize("file, lower", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_ids_are_the_librarys(file, lower):
    tok = bpe.BpeIds(public_tokenizers.path(file), lower)
    rng = random.Random(4)
    signs = "ab cdeé'sS tT\t\n\r\x0b\x85\xa0\x1c\x1f  .,<|endoftext|>ÀßİıǅŽ０１²½Ωσς日本́  12 34!?"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [r[1] or "" for r in documents()]
    for t in texts:
        assert list(array("I", tok.ids(t))) == tok.whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_counts(docs, rows, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = bpe.BpeIds(path, False).whole
    want = ordered((i, len(t.encode()), len(whole.encode(t, add_special_tokens=False).ids)) for i, t in pairs(rows))
    for chunk, overlap in ((65_536, 512), (50, 4), (200, 8)):
        got = token_counts.count_tokens(docs, path, chunk_chars=chunk, overlap_chars=overlap)
        assert ordered(tuple(r)[:3] for r in got.collect()) == want
    assert got.agg({"overlap": "max"}).first()[0] > 8  # widened where the tokens don't meet at once
    assert token_counts.count_tokens(none, path).count() == 0


def test_chunks_are_spliced_at_shared_tokens(monkeypatch):
    tok = bpe.BpeIds(public_tokenizers.path("byte_bpe_50k.json"), False)
    rng = random.Random(12)
    common_words = ["the", "ing", "Über", "x", "q", "日本語", "🙂", "'s", "12", "§", "é"]
    gapless = "".join(rng.choice(common_words) for _ in range(300_000))
    texts = [gapless[:1_000_000], "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000)), "ab" * 50_000, "y" * 100_003, " " * 5_000 + "x" + "\n " * 5_000 + "end", "日本語" * 20_000, "<|endoftext|>" * 3_000, "a<|endoftext|>'s " * 2_000]
    for text in texts:
        want = len(tok.whole.encode(text, add_special_tokens=False).ids)
        for chunk, overlap in ((65_536, 512), (9_973, 16)):
            n, chunks, _ = token_counts.spliced_count(tok, text, chunk, overlap)
            assert n == want, (text[:20], chunk, n, want)
        assert chunks > 1 or len(text) <= chunk
    signs = ["'", "s", "ll", " ", "  ", "\n", "1", "23", "!", "--", "a", "the", "é", "日", "🙂", "<|endoftext|>", "<|", "|>", "\x85"]
    for _ in range(3_000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 60)))
        assert token_counts.spliced_count(tok, text, rng.randint(1, 20), rng.randint(1, 8))[0] == len(tok.whole.encode(text, add_special_tokens=False).ids), repr(text)
    # where alignment always fails, the chunk grows to the end of the text
    monkeypatch.setattr(token_counts, "aligned", lambda *a: None)
    n, chunks, overlap = token_counts.spliced_count(tok, texts[0][:20_000], 500, 16)
    assert (n, chunks) == (len(tok.whole.encode(texts[0][:20_000], add_special_tokens=False).ids), 1) and overlap >= 19_500


@pytest.mark.parametrize("lot", [100_000, 4])
def test_packing(docs, rows, none, lot, monkeypatch):
    monkeypatch.setattr(packing, "LOT", lot)
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = bpe.BpeIds(path, True).whole
    got = packing.pack(docs, path, capacity=512).collect()
    want = []
    for i, t in pairs(rows):
        ids = [*whole.encode(t, add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 512)):
            part = ids[a : a + 512]
            want.append((i, k, a, len(part), zlib.crc32(array("I", part).tobytes())))
    assert ordered((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == ordered(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(w[3] for w in want)
    assert len(bins) <= -(-total // 512) + 2
    assert packing.pack(none, path).count() == 0


def test_bins_that_are_filled_alike_do_not_travel(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    # bins of one long text each, which nothing but the last short text fits into
    docs = spark.createDataFrame([(k, "a " * 300) for k in range(400)] + [(1000, "a " * 150)], "doc_id long, text string").repartition(12)
    got = packing.pack(docs, path, capacity=512).collect()
    assert len({r.sequence_id for r in got}) == 400
    assert packing.still_open([500, 301, 301, 151, 301, 151], 496) == [False, True, False, True, False, False]


def test_bins_filled_alike_are_open_to_pieces_of_other_partitions(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    # each partition's bins are all filled alike, and only those of other partitions hold what fits into them
    docs = spark.createDataFrame([(k, "a " * 300) for k in range(200)] + [(1000 + k, "a " * 200) for k in range(200)] + [(2000, "")] * 9, "doc_id long, text string").coalesce(4)
    got = packing.pack(docs, path, capacity=511).collect()
    assert sorted(Counter(r.length for r in got).items()) == [(1, 9), (201, 200), (301, 200)]
    assert len({r.sequence_id for r in got}) == 200
    assert len({(r.sequence_id, r.offset) for r in got}) == 409


def test_plan_is_best_fit():
    """Against best fit of one item after the other; as many rows for a million times the items."""
    rng = random.Random(2)
    for capacity, n, least in ((100, 500, 1), (64, 300, 20), (50, 200, 50), (97, 400, 30)):
        sizes = [rng.randint(least, capacity) for _ in range(n)]
        rooms = []
        for size in sorted(sizes, reverse=True):
            fits = [k for k, room in enumerate(rooms) if room >= size]
            k = min(fits, key=lambda k: rooms[k]) if fits else len(rooms)
            rooms[k : k + 1] = [(rooms[k] if fits else capacity) - size]
        bins, offsets, fills = packing.best_fit(sizes, capacity)
        assert sorted(capacity - f for f in fills) == sorted(rooms)
        placed = sorted(zip(bins, offsets, sizes))
        assert all(o == (p + s if b == c else 0) for (c, p, s), (b, o, _) in zip([(-1, 0, 0), *placed], placed))
        many = packing.plan({s: c * 10**6 for s, c in Counter(sizes).items()}, capacity)
        assert len(many) < 40 * capacity and many[:, 2].sum() == n * 10**6
    assert packing.best_fit([], 10) == ([], [], [])


def test_best_fit():
    rng = random.Random(1)
    sizes = [rng.randint(1, 100) for _ in range(500)]
    bins, offsets, fills = packing.best_fit(sizes, 100)
    assert max(fills) <= 100 and len(fills) <= sum(sizes) / 100 * 1.05 + 1
    assert sorted(zip(bins, offsets)) == sorted(set(zip(bins, offsets)))


def words_left(rows):
    """(id, words, words that go, rest) by the contract's rule, and the words themselves."""
    first = {}
    split = [(i, [w for w in re.split(GAPS, t) if w]) for i, t in pairs(rows)]
    for i, w in split:
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, float("inf")), float("inf") if i is None else i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < (float("inf") if i is None else i):
                gone.update(range(k, k + 13))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


# words are hashed in pieces, all anchors are hot, hashes collide
@pytest.mark.parametrize("piece, hot, hash_bits", [(1 << 20, 1024, 64), (64, 1024, 64), (1 << 20, 0, 64), (100, 3, 64), (1 << 20, 1024, 2), (50, 0, 1)])
def test_rlz_dedup(docs, rows, none, piece, hot, hash_bits, monkeypatch):
    monkeypatch.setattr(rlz_dedup, "HOT", hot)
    got = rlz_dedup.dedup_spans(docs, piece=piece, hash_bits=hash_bits).collect()
    assert ordered((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == ordered(words_left(rows))
    words = {}
    for i, t in pairs(rows):
        words.setdefault(i, []).append([w for w in re.split(GAPS, t) if w])
    copies = 0
    for r in got:
        for f in r.factors:
            assert f.stop - f.start >= 13 and f.source_id < (r.doc_id if r.doc_id is not None else 1 << 62)
            phrases = [w[f.source_start : f.source_start + f.stop - f.start] for w in words[f.source_id]]
            assert any(w[f.start : f.stop] in phrases for w in words[r.doc_id])
            copies = max(copies, f.stop - f.start)
        spans = [(s.start, s.stop) for s in r.spans]
        assert sum(b - a for a, b in spans) == r.n_removed and all(any(a <= f.start and f.stop <= b for a, b in spans) for f in r.factors)
    assert copies >= 4000 or hot < 4 or piece < 4000  # a whole copy is one factor
    assert rlz_dedup.dedup_spans(none).count() == 0


def repeated(rows, window):
    """By document, flags of the bytes in strings of `window` bytes that start elsewhere too."""
    data = [t.encode() for _, t in pairs(rows)]
    counts = {}
    for b in data:
        for k in range(len(b) - window + 1):
            counts[b[k : k + window]] = counts.get(b[k : k + window], 0) + 1
    out = []
    for b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if counts[b[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        out.append((b, gone))
    return out


@pytest.mark.parametrize("lot, hot, window, seek, anchor", [(1 << 20, 1024, 400, None, None), (256, 0, 60, 30, 12), (1 << 20, 0, 400, 200, 80), (1 << 20, 1024, 400, 200, None), (500, 0, 200, 200, 80), (300, 1024, 90, 12, 5), (1 << 20, 2, 90, 12, 5)])
def test_suffix_dedup(docs, rows, none, lot, hot, window, seek, anchor, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    want = []
    for (i, _), (b, gone), (_, short) in zip(pairs(rows), repeated(rows, window), repeated(rows, seek or window)):
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        want.append((i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g), sum(short)))
    got = suffix_dedup.dedup_spans(docs, window=window, seek=seek, anchor=anchor, piece=lot)
    assert ordered((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept), r.n_repeated if seek else sum(s.stop - s.start for s in r.spans)) for r in got.collect()) == ordered(want)
    assert suffix_dedup.dedup_spans(none, seek=200).count() == 0


def test_suffix_order_and_prefixes():
    rng = random.Random(3)
    for _ in range(300):
        t = bytes(rng.choice(b"abc\0\xff"[: rng.randint(1, 5)]) for _ in range(rng.randint(0, 80)))
        order = suffix_dedup.suffix_order(t, 100)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        own = np.array([rng.random() < 0.3 for _ in t], bool)
        some = suffix_dedup.suffix_order(t, 100, own)
        assert [i for i in some.tolist() if own[i]] == [i for i in order.tolist() if own[i]]
    t = b"abcabcabcx" * 3
    order = suffix_dedup.suffix_order(t, 100)
    common_ = suffix_dedup.common_prefixes(t, order, 9)
    for k in range(1, len(order)):
        a, b = t[order[k - 1] :], t[order[k] :]
        n = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
        assert common_[k] == min(n, 9)


def sim(text):
    w = [x for x in re.split(GAPS, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(values, limit):
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if bin(values[a] ^ values[b]).count("1") <= limit:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(x) for x in range(len(values))]


def test_simhash(docs, rows, none):
    prints = [sim(t) for _, t in pairs(rows)]
    least = {}
    roots = classes(prints, 4)
    for (i, _), r in zip(pairs(rows), roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = ordered((i, f, least.get(r)) for (i, _), f, r in zip(pairs(rows), prints, roots))
    got = simhash.near_duplicates(docs)
    assert ordered((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got.collect()) == want
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("families", [2, 5])
def test_families_of_fingerprints(spark, docs, rows, families):
    texts = [t for _, t in pairs(rows)]
    prints = [simhash.simhashes(simhash.shingle_hashes(t, 5), families).tolist() for t in texts]
    assert [p[0] for p in prints] == [simhash.simhash(t, 5) for t in texts]
    # linked in one family or another
    roots = [classes([p[k] for p in prints], 4) for k in range(families)]
    part = list(range(len(texts)))
    for _ in texts:
        for own in roots:
            least = {}
            for x, r in enumerate(own):
                least[r] = min(least.get(r, part[x]), part[x])
            part = [least[r] for r in own]
    least = {}
    for (i, _), r in zip(pairs(rows), part):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    got = simhash.near_duplicates(docs, shingle=5, families=families).collect()
    assert ordered((r.doc_id, r.component_id) for r in got) == ordered((i, least.get(r)) for (i, _), r in zip(pairs(rows), part))


def test_bits_are_counted_in_lots():
    rng = np.random.default_rng(3)
    for n in (1, 2, 254, 255, 256, 5000, 40_000):
        h = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
        assert int(simhash.simhashes(h)[0]) == sum(1 << b for b in range(64) if int((h >> np.uint64(b) & np.uint64(1)).sum()) * 2 > n)


def test_vantage_point_join_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_PAIRS", 64)
    monkeypatch.setattr(simhash, "CELL_ROWS", 50)
    rng = random.Random(8)
    values = set()
    for _ in range(150):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(rng.randint(0, 6)):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            values.add(x)
    values = sorted(values)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    parts = {r.node & (1 << 64) - 1: r.component for r in common.connected_components(simhash.links(df, 4)).collect()}
    roots = classes(values, 4)
    mine = [parts.get(v, v) for v in values]
    assert len(set(zip(mine, roots))) == len(set(roots)) == len(set(mine))
    for limit in (0, 1, 2, 3, 7, 14):
        found = [(r.u & (1 << 64) - 1, r.v & (1 << 64) - 1) for r in simhash.links(df, limit).collect()]
        assert all(bin(u ^ v).count("1") <= limit * len(values) for u, v in found)
        group = {v: v for v in values}
        for _ in values:
            before = dict(group)
            for u, v in found:
                group[u] = group[v] = min(group[u], group[v])
            if group == before:
                break
        roots = classes(values, limit)
        mine = [group[v] for v in values]
        assert len(set(zip(mine, roots))) == len(set(roots)) == len(set(mine)), limit


def test_parts_leave_no_pair_out():
    for limit in range(20):
        parts = simhash.parts_of(limit)
        assert sum(r + 1 for _, r in parts) > limit and sum(m for m, _ in parts) == (1 << 64) - 1 and all(a & b == 0 for k, (a, _) in enumerate(parts) for b, _ in parts[:k])


@pytest.mark.parametrize("few", [20_000, 0])
def test_components(spark, few, monkeypatch):
    monkeypatch.setattr(common, "FEW_EDGES", few)
    chain = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100, 102: 100}
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_minhash(spark, docs, rows, none):
    def shingles(t):
        w = [x for x in re.split(GAPS, t) if x]
        return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    with_ids = [(k, t) for k, (_, t) in enumerate(pairs(rows))]
    got = {r.doc_id: r for r in minhash.edited_fingerprints(spark.createDataFrame(with_ids, "doc_id long, text string")).collect()}
    order = sorted(with_ids, reverse=True)
    for k, (i, t) in enumerate(order):
        follower = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + follower[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((r.near_edited, edited), (r.near_next, follower)):
            a, b = shingles(t), shingles(other)
            exact = 1.0 if not a and not b else len(a & b) / len(a | b)
            assert abs(near - exact) < 0.2, (i, near, exact)
    by_text = {}
    for i, t in with_ids:
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert minhash.edited_fingerprints(docs).count() == len(rows) and minhash.edited_fingerprints(none).count() == 0
    lone = minhash.edited_fingerprints(spark.createDataFrame([(None, "a b c d e f")], "doc_id long, text string")).first()
    assert lone.near_next == 0.0


def spark_hash(*values):
    """Spark's xxhash64 of numbers as they are stored: each is hashed with the hash so far as the seed."""
    out = 42
    for v, size in values:
        out = xxhash.xxh64_intdigest(v.to_bytes(size, "little", signed=True), out)
    return out - (1 << 64) if out >> 63 else out


def one_permutation(text, k=5, bits=7):
    words = [w for w in re.split(GAPS, text) if w]
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    hashes = [h - (1 << 64) if h >> 63 else h for h in hashes]
    if not hashes:
        return "0" * (2 << bits)
    low, bins = 64 - bits, {}
    for a in range(max(1, len(hashes) - k + 1)):
        h = spark_hash(*[(w, 8) for w in hashes[a : a + k]])
        b, v = (h >> low) + (1 << bits - 1), h & (1 << low) - 1
        bins[b] = min(v, bins.get(b, v))
    out = []
    for i in range(1 << bits):
        tries = [(spark_hash((i, 4), (t, 4)) & (1 << 64) - 1) >> low for t in range(minhash.ATTEMPTS)]
        at = next((j for j in [i, *tries] if j in bins), None)
        if at is None:
            at = min(bins, key=lambda j: (spark_hash((i, 4), (j, 4), (-1, 4)), j))
        out.append(f"{bins[at] & 255:02x}")
    return "".join(out)


def test_bins_densification_and_packing(docs, rows):
    got = ordered(tuple(r) for r in minhash.fingerprints(docs).collect())
    assert got == ordered((i, one_permutation(t)) for i, t in pairs(rows))


def test_ranges_follow_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(minhash, "RANGE_BYTES", 100)
    docs = spark.createDataFrame([(k * 7, f"text {k} " * 9) for k in range(50)], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in minhash.with_next(docs, ["text"]).collect()}
    assert got == {k * 7: f"text {(k - 1) % 50} " * 9 for k in range(50)}


def test_sentencepiece(docs, rows, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, machines = sentencepiece.SentencePieceProcessor(model_file=path), wfst.Transducers(path)
    rng = random.Random(1)
    signs = "ab cdeé'sS tT\t\n  .,▁<0x0A>ÀßİıǅŽ０１²½Ωσς日本é 12 34!?🙂\x00thein"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + [t for _, t in pairs(rows)]
    for t in texts:
        ids = library.encode(t)
        assert list(array("I", machines.encode(t))) == ids and machines.decode(array("I", ids).tobytes()) == library.decode(ids), repr(t)
    for _ in range(1000):
        ids = [rng.choice([rng.randint(3, 258), rng.randint(3, 31_999), 29_871, 259]) for _ in range(rng.randint(0, 12))]
        assert machines.decode(array("I", ids).tobytes()) == library.decode(ids), ids
    got = wfst.encode(docs, path).collect()
    assert ordered((r.doc_id, list(array("I", bytes(r.ids)))) for r in got) == ordered((i, library.encode(t)) for i, t in pairs(rows))
    assert wfst.encode(none, path).count() == 0


def field(number, value):
    """A field of a protocol buffer message."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def small_model(rng, byte_fallback, normaliser):
    """A unigram model of made-up pieces, in the library's file format."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if byte_fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    texts = {"▁"} | set("abcdei") | {"".join(rng.choice("abcdei▁fé") for _ in range(rng.randint(2, 4))) for _ in range(60)}
    pieces += [(t, -rng.uniform(1, 9), 1) for t in sorted(texts) if "▁" not in t[1:]]
    out = b"".join(field(1, field(1, p) + field(2, x) + field(3, kind)) for p, x, kind in pieces)
    return out + field(2, field(3, 1) + field(35, int(byte_fallback))) + field(3, normaliser)


def test_weighted_models_and_character_maps(tmp_path):
    import sentencepiece

    rng = random.Random(9)
    signs = "abcdei  abcdeifﬁé　Ａ①㍿\t\n\u200b½ e\u0301▁日x"
    texts = ["", " ", "a", "  a  b  ", "aaaaaa"] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    maps = [sentencepiece.SentencePieceNormalizer(rule_name=r).serialized_normalizer_spec() for r in ("nmt_nfkc", "nmt_nfkc_cf")]
    plain = [field(1, "identity") + field(3, a) + field(4, b) + field(5, 1) for a in (0, 1) for b in (0, 1)]
    for k, normaliser in enumerate(maps + plain):
        for byte_fallback in (False, True):
            path = str(tmp_path / f"m{k}{byte_fallback}.model")
            with open(path, "wb") as f:
                f.write(small_model(rng, byte_fallback, normaliser))
            library, machines = sentencepiece.SentencePieceProcessor(model_file=path), wfst.Transducers(path)
            for t in texts:
                ids = library.encode(t)
                assert list(array("I", machines.encode(t))) == ids, (k, byte_fallback, t, library.encode(t, out_type=str), machines.normaliser.run(t))
                assert machines.decode(array("I", ids).tobytes()) == library.decode(ids), (k, byte_fallback, t)


@pytest.fixture(scope="module")
def toxic(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return docs, labels, toxicity.fit(docs, labels)


def test_toxicity_held_out(spark, toxic, docs, rows, none):
    all_docs, labels, model = toxic
    scored = toxicity.score(all_docs, model).join(labels, "doc_id").where(toxicity.held_out("doc_id")).toPandas()
    assert ((scored.score >= 0.7) == (scored.toxic == 1)).mean() > 0.93
    assert ((scored.score >= 0.7) & (scored.toxic == 0)).sum() <= 2
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score < 0.7 for r in got) and toxicity.score(none, model).count() == 0
    assert toxicity.drop_toxic(docs, model).count() == len(rows) and toxicity.drop_toxic(docs, model).columns == docs.columns
    assert not toxicity.fit(docs, labels.limit(0)).marks and not toxicity.fit(none, labels).marks


def test_disguises_are_restored(toxic):
    reader = toxicity.Reader(toxicity.CharModel(toxic[2].counts))
    for shown, meant in (("1d10t", "idiot"), ("i d i o t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("stuuuupid", "stupid"), ("l0ser", "loser"), ("p@thet1c", "pathetic"), ("the m o r o n.", "moron"), ("tr@$h", "trash")):
        assert meant in reader.words(shown), (shown, reader.words(shown))
    assert reader.words("A plain sentence, nothing more.") == {"a", "plain", "sentence", "nothing", "more"}


def decodings(token, model, split):
    """Every reading of a token with its whole cost."""
    found = [(0.0, (0, 0), "")]
    for arcs in toxicity.lattice(token, split):
        new = []
        for total, (a, b), text in found:
            for string, price in arcs:
                x, y, cost = a, b, total + price
                for c in string:
                    k = toxicity._class(c)
                    cost += model.cost[x][y][k]
                    x, y = y, k
                new.append((cost, (x, y), text + string))
        found = new
    return [(total + model.cost[a][b][0], text) for total, (a, b), text in found]


def test_the_likeliest_reading_is_found(toxic):
    model, rng = toxicity.CharModel(toxic[2].counts), random.Random(5)
    tokens = ["id**t", "idio*", "*diot", "m0r*n", "st*p1d", "a-b-c", "l0**r"] + ["".join(rng.choice("abeist01@$!*.-lloo") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    for token in tokens:
        if token.count("*") > 2:
            continue
        for split in (True, False):
            every = decodings(token, model, split)
            least = min(cost for cost, _ in every)
            assert toxicity.restore(token, model, split) in {text for cost, text in every if cost < least + 1e-9}, token
    for token, meant in (("id**t", "idiot"), ("idio*", "idiot"), ("*diot", "idiot")):
        assert meant in {text for _, text in decodings(token, model, False)}
    for token, meant in (("stup*d", "stupid"), ("st*pid", "stupid"), ("l*ser", "loser"), ("stupi*", "stupid")):
        assert toxicity.restore(token, model, False) == meant


def test_long_tokens_are_read(toxic):
    reader = toxicity.Reader(toxicity.CharModel(toxic[2].counts))
    assert {"pathetic", "worthless", "disgusting", "idiot"} <= reader.words("you_are_a_pathetic_worthless_disgusting_idiot")
    assert {"pathetic", "idiot"} <= reader.words("see/you/are/a/p@thet1c/and/worthless/and/disgusting/1d10t/page.html")
    assert "stupid" in reader.words("a_long_token_of_many_harmless_parts_s.t.u.p.i.d_and_more")
    assert {"今日は良い天気です", "散歩に行きました"} <= reader.words("今日は良い天気です。" * 5 + "散歩に行きました。")
    rng = random.Random(4)
    for _ in range(300):
        parts = [rng.choice("abc") * rng.randint(1, 20) for _ in range(rng.randint(1, 30))]
        token = rng.choice("-/_").join(parts)
        cut = toxicity.pieces(token)
        assert max(map(len, cut)) <= toxicity.LONGEST and all(any(p in x for x in cut) for p in parts)


def test_doubled_letters_and_wide_gaps_are_restored(spark, toxic):
    reader = toxicity.Reader(toxicity.CharModel(toxic[2].counts))
    for shown, meant in (("stuupid", "stupid"), ("mooron", "moron"), ("iddiot", "idiot"), ("what an i  d  i  o  t.", "idiot"), ("s\tt\tu\tp\ti\td", "stupid"), ("m\no\nr\no\nn", "moron"), ("l .  o .  s .  e .  r", "loser")):
        assert meant in reader.words(shown), (shown, reader.words(shown))
    counts = toxicity.char_counts(spark.createDataFrame([("The letter, a Letter",), ("stuupid " + "letter " * 5000,), (None,)], "text string"))
    assert {k: n for k, n in counts.items() if isinstance(k, str)} == {"letter": 5002}
    assert toxicity.Reader(toxicity.CharModel(counts)).words("letter") == {"letter"}
    assert all(0 < n for n in toxic[2].counts.values()) and sum(isinstance(k, str) for k in toxic[2].counts) < 4096


def test_quality_held_out(spark, docs, rows, none):
    all_docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = cotrain.fit(all_docs, labels)
    scored = cotrain.score(all_docs, model).join(labels, "doc_id").where(cotrain.held_out("doc_id")).toPandas()
    assert ((scored.score >= 0.5) == (scored.quality == 1)).mean() > 0.95
    assert cotrain.score(docs, model).count() == len(rows) and cotrain.score(none, model).count() == 0
    assert cotrain.fit(all_docs, labels.where("quality = 1")) > 0.9
    assert cotrain.score(docs, 0.9).first().score == 0.9
    odd = spark.createDataFrame([(1, "a text", float("nan")), (2, None, float("inf")), (3, "x" * 2_000_000, None)], "doc_id long, text string, n_chars double")
    assert all(0 <= r.score <= 1 for r in cotrain.score(odd, model).collect()) and cotrain.fit(odd, labels.limit(0)) == 0.5


def test_all_unlabelled_rows_take_part(spark):
    rng = random.Random(6)
    rows = []
    for k in range(24_000):
        good = rng.random() < 0.5
        rows.append((k, " ".join(rng.choice(["fine", "words", "here."] if good != (rng.random() < 0.1) else ["X$", "99", "!!"]) for _ in range(rng.randint(2, 9))), rng.choice("ab" if good else "bc"), int(good)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows[:400]], "doc_id long, quality int")
    got = cotrain.fit(docs, labels, ("lang",))
    own = [r[0] for r in labels.where(~cotrain.held_out("doc_id")).collect()]
    own.sort(key=lambda i: (zlib.crc32(str(i).encode()), i))
    ties = {r[0]: r[1] for r in docs.select("doc_id", cotrain.tie("doc_id")).collect()}
    x, m = cotrain._views([r[1] for r in rows], [[r[2] for r in rows]])
    x = x.astype(np.float32).astype(float)
    want = cotrain.cotrain(x[own], m[own], np.array([float(rows[i][3]) for i in own]), x[400:], m[400:], tie=np.array([ties[r[0]] for r in rows[400:]]))
    assert np.allclose(got.text.weights, want.text.weights, atol=1e-3) and np.allclose(got.meta.weights, want.meta.weights, atol=1e-3)
    assert np.allclose(got.text.mean, want.text.mean) and np.allclose(got.both.weights, want.both.weights, atol=1e-3)


def test_sums_over_the_pool_give_the_same_fit():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 900).astype(float)
    x, m = y[:, None] + rng.normal(0, 0.6, (900, 3)), y[:, None] + rng.normal(0, 0.6, (900, 2))
    text, meta = (cotrain.fit_logistic(v[:200], y[:200], np.ones(200)) for v in (x, m))
    pool, bounds = cotrain.ArrayPool(x[200:], m[200:]), ((0, 1.0), (10, 0.5))
    lessons = [((text, bounds), (meta, bounds))]
    told = cotrain._told(lessons, *pool.rows)
    for got, base, of in zip(cotrain._fit_views([x[:200], m[:200]], y[:200], pool, lessons, (text, meta)), (x, m), told):
        add = of >= 0
        assert 20 < add.sum() < 700
        want = cotrain.fit_logistic(np.concatenate((base[:200], base[200:][add])), np.concatenate((y[:200], of[add])), np.repeat((1.0, cotrain.PSEUDO_WEIGHT), (200, add.sum())))
        assert np.allclose(got.weights, want.weights, atol=1e-4) and np.allclose(got.scale, want.scale)


def test_views_teach_each_other():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 2000).astype(float)
    x, m = y[:, None] + rng.normal(0, 0.6, (2000, 3)), y[:, None] + rng.normal(0, 0.6, (2000, 2))
    model = cotrain.cotrain(x[:200], m[:200], y[:200], x[200:1500], m[200:1500])
    assert ((model.scores(x[1500:], m[1500:])[2] >= 0.5) == y[1500:]).mean() > 0.93


def test_texts_of_megabytes(spark):
    """One text twice, one with it inside, one of one endless word; every operator takes them whole."""
    import sentencepiece

    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(30_000)]
    long = " ".join(rng.choice(words) for _ in range(330_000))
    assert len(long) > 2_000_000
    texts = {1: long, 2: long, 3: "before it " + long[:1_500_000] + "\nbehind it", 4: "xy" * 600_000, 5: "short and fine"}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    n = {i: len(t.split()) for i, t in texts.items()}

    exact = {r.doc_id: r.keep_id for r in exact_dedup(docs, DigestIndex(spark, common.scratch_path(spark, "index"), 4)).collect()}
    assert exact == {1: 2, 2: 2, 3: 3, 4: 4, 5: 5}
    rlz = {r.doc_id: r for r in rlz_dedup.dedup_spans(docs).collect()}
    inside = len(long[:1_500_000].split())
    assert {i: r.n_words for i, r in rlz.items()} == n and [rlz[i].n_removed for i in (1, 2, 4, 5)] == [0, n[2], 0, 0]
    assert inside - 1 <= rlz[3].n_removed <= inside and len(rlz[2].factors) == 1 and rlz[3].factors[0].source_start == 0
    spans = {r.doc_id: r for r in suffix_dedup.dedup_spans(docs, seek=200).collect()}
    assert [spans[i].n_removed for i in (1, 2, 4, 5)] == [len(long), len(long), len(texts[4]), 0]
    assert 1_500_000 <= spans[3].n_removed < 1_500_010 and len(spans[3].spans) == 1
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = bpe.BpeIds(path, False).whole
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, path).collect()}
    assert all(r.n_tokens == len(whole.encode(texts[i], add_special_tokens=False).ids) for i, r in got.items()) and got[1].n_chunks > 20
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    whole = bpe.BpeIds(public_tokenizers.path("word_bpe_49k.json"), True).whole
    assert all(sum(r.length for r in packed if r.doc_id == i) == len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items())
    near = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert near[2].component_id == 1 and all(r.fp & (1 << 64) - 1 == sim(texts[i]) for i, r in near.items() if i != 1)
    prints = {r.doc_id: r for r in minhash.edited_fingerprints(docs).collect()}
    assert prints[1].fingerprint == prints[2].fingerprint == one_permutation(long) and prints[2].near_next == 1.0
    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    parts = docs.where("doc_id in (1, 5)")
    assert all(list(array("I", bytes(r.ids))) == library.encode(texts[r.doc_id]) for r in wfst.encode(parts, model).collect())
    labels = spark.createDataFrame([(i, 1, 0) for i in texts], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).where("score between 0 and 1").count() == 5
    assert cotrain.score(docs, cotrain.fit(docs, labels)).where("score between 0 and 1").count() == 5
