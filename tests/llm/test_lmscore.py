import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from storyspark.llm import blocks, lmscore

SCHEMA = "doc_id bigint, text string, score double, words string"


def frame(spark, data):
    return spark.createDataFrame([(i, t, 0.5, "x") for i, t in data], SCHEMA)


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def corpus(seed=1, n=160):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "é", "É"] + [f"w{i}" for i in range(120)]
    weights = [30, 10, 20, 3, 3] + [1] * 120
    phrases = [" ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 12))) for _ in range(40)]
    data = [(i, " ".join(rng.choices(phrases, k=rng.randint(0, 8)))) for i in range(n)]
    data += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "only unseen words zq zz"), (None, "the w1 never"), (1004, "the of " * 3000)]
    return data + data[:5]


def brute(data, priors):
    part = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 10
    train = [tokens(t) for i, t in data if part(i)]
    c = Counter(w for t in train for w in t)
    pairs = Counter((a, b) for t in train for a, b in zip([None, *t], t))
    triples = Counter(x for t in train for x in zip([None, *t], t, t[1:]))
    after = Counter(x[:2] for x in triples.elements())
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in data:
        own = tokens(t)
        p1 = [(c[w] + 0.1) / (n + 0.1 * (v + 1)) for w in own]
        score, before = 0.0, [(None, None), *((a, b) for a, b in zip([None, *own], own))]
        for k, (w, q) in enumerate(zip(own, p1)):
            a, b = before[k]
            if c[b]:
                q = pairs[b, w] / (c[b] + priors[0]) + priors[0] / (c[b] + priors[0]) * q
            if k and after[a, b]:
                q = triples[a, b, w] / (after[a, b] + priors[1]) + priors[1] / (after[a, b] + priors[1]) * q
            score += math.log10(q)
        out.append((i, part(i) == 0, len(own), sum(c[w] > 0 for w in own), n, sum(map(math.log10, p1)), score))
    return out


@pytest.mark.parametrize("size", [1500, 1 << 22])
def test_scores_match_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(lmscore, "build_blocks", lambda docs: blocks.build_blocks(docs, size))
    data = corpus()
    got = sorted(map(tuple, lmscore.score_texts(frame(spark, data).repartition(3), shard_tokens=500).collect()), key=lambda r: (r[0] or -1, r[1:]))
    want = sorted(brute(data, lmscore.PRIORS), key=lambda r: (r[0] or -1, r[1:]))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])
        assert a[6] == pytest.approx(b[6], abs=0.02 * a[2])  # quantised
    held = [a for a in got if a[1] and a[0] < 160]
    assert sum(a[6] for a in held) > sum(a[5] for a in held)


def test_empty_and_untrained(spark):
    assert lmscore.score_texts(frame(spark, [])).count() == 0
    lone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = lmscore.score_texts(frame(spark, [(lone, "a b")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_scores_do_not_depend_on_shards(spark):
    data = corpus(4)
    one, many = (sorted(map(tuple, lmscore.score_texts(frame(spark, data), shard_tokens=n).collect()), key=repr) for n in (300, 1 << 21))
    for a, b in zip(one, many):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_scores_come_from_the_trie(spark, monkeypatch):
    """Without what the trie knows nothing but the unigram is left."""
    data = corpus(5, 60)
    monkeypatch.setattr(lmscore, "_search_trie", lambda state, payloads: [lmscore.squeeze(bytes(len(lmscore.unsqueeze(p)))) for p in lmscore_replies(state, payloads)])
    lmscore_replies = _search
    for r in lmscore.score_texts(frame(spark, data)).collect():
        assert r.score <= r.base_score + 1e-9


_search = lmscore._search_trie


def test_shards_asked_by_very_many_are_answered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ASKED_BYTES", 3000)
    monkeypatch.setattr(blocks, "GROUP", 4)
    monkeypatch.setattr(lmscore, "build_blocks", lambda docs: blocks.build_blocks(docs, 600))
    data = corpus(6)
    got = sorted(map(tuple, lmscore.score_texts(frame(spark, data).repartition(3)).collect()), key=lambda r: (r[0] or -1, r[1:]))
    want = sorted(brute(data, lmscore.PRIORS), key=lambda r: (r[0] or -1, r[1:]))
    assert [a[:5] for a in got] == [b[:5] for b in want]
    assert all(a[6] == pytest.approx(b[6], abs=0.02 * b[2]) for a, b in zip(got, want))


def test_elias_fano_without_decoding():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1), (1, 1 << 50), (5, 3), (1000, 50), (70000, 1 << 40), (33000, 33000), (3000, 1 << 20)):
        values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        data = b"xx" + lmscore.EliasFano.encode(values) + b"yy"
        level = lmscore.EliasFano(data, 2)
        assert level.n == n and data[level.end :] == b"yy"
        at = rng.permutation(n)
        assert (level[at] == values[at]).all()
        asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, top + 2, 2000).astype(np.uint64), np.array([0, top, 2 * top], np.uint64)])
        place, equal = level.successor(asked)
        assert (place == np.searchsorted(values, asked)).all() and (equal == np.isin(asked, values)).all()


def test_trie_finds_what_it_holds_and_nothing_else():
    rng = np.random.default_rng(3)
    grams = np.unique(rng.integers([1, 1, 1], [60, 80, 100], (20000, 3)), axis=0).astype(np.uint64)
    pairs, degree = np.unique(grams[:, :2], axis=0, return_counts=True)
    pair_value, value = rng.random(len(pairs)) * 0.999 + 1e-3, rng.random(len(grams)) * 0.999 + 1e-3
    data = lmscore.Trie.encode(pairs[:, 0], pairs[:, 1], pair_value, degree, grams[:, 2], value)
    trie = lmscore.Trie(data)
    v = np.arange(70, dtype=np.uint64)
    which, w = np.repeat(np.arange(70), 90), np.tile(np.arange(90, dtype=np.uint64), 70)
    at = trie.find_pairs(v, which, w)
    index = {tuple(p): k for k, p in enumerate(pairs.tolist())}
    assert at.tolist() == [index.get((int(v[i]), int(j)), -1) for i, j in zip(which, w)]
    x = np.tile(np.arange(110, dtype=np.uint64), len(at))
    place = trie.find_triples(at, np.repeat(np.arange(len(at)), 110), x)
    index = {tuple(g): k for k, g in enumerate(grams.tolist())}
    assert place.tolist() == [index.get((int(v[i]), int(j), k), -1) for i, j in zip(which, w) for k in range(110)]
    for codes, true in ((trie.pair_codes, pair_value), (trie.triple_codes, value)):
        assert np.abs(np.log10(lmscore.CODES[codes]) - np.log10(true)).max() <= lmscore.STEP / 2 + 1e-9


def test_trie_is_compact_in_memory():
    """A shard of two million tokens: bytes for each n-gram, and no level decoded beside the map."""
    rng = np.random.default_rng(4)
    ids = np.minimum(rng.zipf(1.3, 400_000), 200_000).astype(np.uint64)
    grams = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0)
    pairs, degree = np.unique(grams[:, :2], axis=0, return_counts=True)
    half = lambda n: np.full(n, 0.5)
    data = lmscore.Trie.encode(pairs[:, 0], pairs[:, 1], half(len(pairs)), degree, grams[:, 2], half(len(grams)))
    assert len(data) < 6 * (len(grams) + len(pairs))
    trie = lmscore.Trie(data)
    for level in trie.levels:  # all but the counts of ones and zeros per line are views of the map
        assert not level.lows.flags.owndata and not level.high.flags.owndata and not level.ones.flags.owndata
        assert level.zeros.nbytes <= len(data) / 8


def test_numbers_and_ids_beyond_32_bits():
    big = np.array([0, 1, 1 << 33, (1 << 60) + 5], np.uint64)
    small = np.array([3, 2, 1], np.uint64)
    assert all((a == b).all() for a, b in zip(blocks.unpack(blocks.pack(big, small, big[:0])), (big, small, big[:0])))
    v, w, x = np.array([1 << 34, 1 << 35], np.uint64), np.array([7, 1 << 36], np.uint64), np.array([1 << 37, 5], np.uint64)
    trie = lmscore.Trie(lmscore.Trie.encode(v, w, np.ones(2), np.array([1, 1]), x, np.ones(2)))
    at = trie.find_pairs(v, np.array([0, 1, 1]), np.array([7, 1 << 36, 7], np.uint64))
    assert at.tolist() == [0, 1, -1] and trie.find_triples(at, np.array([0, 1, 2]), np.array([1 << 37, 5, 5], np.uint64)).tolist() == [0, 1, -1]


def test_fused_keys_keep_their_order_beyond_64_bits():
    rng = np.random.default_rng(5)
    for top in (1 << 20, 1 << 63):
        high, low = (rng.integers(0, top, 300, dtype=np.uint64)[rng.integers(0, 40, 300)] for _ in range(2))
        keys = lmscore._fused(high, low)
        assert np.array_equal(np.argsort(keys, kind="stable"), np.lexsort((low, high)))
        at, n, own = lmscore._distinct(keys, np.ones(300, np.uint64))
        want = sorted(Counter(zip(high.tolist(), low.tolist(), strict=True)).items())
        assert [((int(high[i]), int(low[i])), int(c)) for i, c in zip(at, n, strict=True)] == want
        assert np.array_equal(keys[at][own], keys)
    assert len(lmscore._fused(np.zeros(0, np.uint64), np.zeros(0, np.uint64))) == 0


def test_steps_up_and_down_come_back():
    counts = np.array([9, 9, 2, 1 << 40, 0, 1], np.uint64)
    assert np.array_equal(lmscore._unswung(lmscore._swings(counts)), counts)
