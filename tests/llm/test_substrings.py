import hashlib
import random

import numpy as np
import pytest

from storyspark.llm import blocks, substrings

SCHEMA = "doc_id bigint, text string, n_chars bigint, place int, spans string"


def frame(spark, data):
    return spark.createDataFrame([(i, t, len(t or ""), 1, "x") for i, t in data], SCHEMA)


def slow(data, k):
    """n_words, n_removed and kept words of each row."""
    smallest = {}
    for i, t in data:
        words = (t or "").encode().split()
        for a in range(len(words) - k + 1):
            gram = tuple(words[a : a + k])
            if i is not None and i < smallest.get(gram, i + 1):
                smallest[gram] = i
    out = []
    for i, t in data:
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for a in range(len(words) - k + 1):
            if i is not None and smallest[tuple(words[a : a + k])] < i:
                gone[a : a + k] = [True] * k
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "é", "The", "the"] + [f"w{i}" for i in range(60)]
    passages = [rng.choices(vocabulary, k=rng.randint(8, 40)) for _ in range(6)] + [["a"] * 40]
    data = [(50, None), (51, ""), (52, " \n\t"), (None, " ".join(passages[0])), (53, "x " * 4000), (54, "x " * 30)]
    for i in rng.sample(range(100, 400), 90):
        words = rng.choices(vocabulary, k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages)[rng.randint(0, 5) :]
        data.append((i, rng.choice([" ", "\n", "  ", " \t"]).join(words)))
    data += [(500 + j, data[20][1]) for j in range(20)] + [(500, data[20][1])]
    return data


@pytest.mark.parametrize("k", [3, 13])
def test_matches_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(substrings, "build_blocks", lambda docs: blocks.build_blocks(docs, 2000))
    monkeypatch.setattr(blocks, "ASKED_BYTES", 3000)
    monkeypatch.setattr(blocks, "GROUP", 4)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 1000)
    data = corpus()
    got = [tuple(r) for r in substrings.remove_repeats(frame(spark, data).repartition(3), k).collect()]
    assert sorted(got, key=lambda r: (r[0] or -1, r)) == sorted(slow(data, k), key=lambda r: (r[0] or -1, r))


def test_hash_collisions_are_found_and_undone(spark, monkeypatch):
    """With 12 bits of the first hash most matches of it are false; the second hash and the words tell them apart."""
    data = [(i, t) for i, t in corpus(5) if i is not None]
    true = substrings.rolled

    def weak(hashes, k, *multiplier):
        return true(hashes, k, *multiplier) & np.uint64(0xFFF) if k == 13 and not multiplier else true(hashes, k, *multiplier)

    monkeypatch.setattr(substrings, "rolled", weak)
    got = [tuple(r) for r in substrings.remove_repeats(frame(spark, data)).collect()]
    assert sorted(got) == sorted(slow(data, 13))


def test_words_decide_where_both_hashes_collide(spark, monkeypatch):
    """Verification leaves no false match standing."""
    data = [(i, t) for i, t in corpus(5) if i is not None]
    true = substrings.rolled
    monkeypatch.setattr(substrings, "rolled", lambda hashes, k, *m: true(hashes, k, *m) & np.uint64(0x3F) if k == 13 else true(hashes, k, *m))
    removed = {r[0]: r[2] for r in slow(data, 13)}
    assert all(r.n_removed <= removed[r.doc_id] for r in substrings.remove_repeats(frame(spark, data)).collect())


def slow_paths(edges):
    """Path (its first edge, or a ring's least) of every edge (doc, place, tail, head)."""
    into, out = {}, {}
    for e in edges:
        out.setdefault(e[2], []).append(e)
        into.setdefault(e[3], []).append(e)
    path = {}
    for e in edges:
        seen, at = [e], e
        while len(into.get(at[2], ())) == 1 and len(out[at[2]]) == 1 and into[at[2]][0] != e:
            at = into[at[2]][0]
            seen.append(at)
        ring = len(into.get(at[2], ())) == 1 and len(out[at[2]]) == 1
        path[e[:2]] = "ring" if ring else at[:2]
    return path


def test_paths_without_a_branch_are_compacted(spark):
    rng = random.Random(9)
    edges, node = [], 100
    for doc in range(12):  # chains within a document, with branches between some
        for place in range(rng.randint(2, 30)):
            edges.append((doc, place, node, node + 1))
            node += 1
        if doc % 3:
            node += 1  # the next document goes on where this one ended, but for each third
        if doc % 4 == 0:
            edges.append((doc, 900, node - 2, rng.randint(100, node)))
    edges += [(50, 0, 9000, 9001), (51, 7, 9001, 9002), (52, 3, 9002, 9003), (49, 1, 9003, 9004), (53, 0, 9004, 9005)]  # one path through five documents
    edges += [(60, 0, 9100, 9101), (61, 0, 9101, 9102), (62, 0, 9102, 9100)]  # a ring
    rows = [(d, p, 1, t, h) for d, p, t, h in edges]
    rows = substrings.compacted(spark.createDataFrame(rows, "doc_id bigint, place int, n int, tail bigint, head bigint")).collect()
    assert sum(r.n for r in rows) == len(edges) and len(rows) < len(edges) / 2
    want = slow_paths(edges)
    for r in rows:
        for place in range(r.place, r.place + r.n):
            assert want[r.doc_id, place] in ("ring", (r.path_doc, r.path_place))
    assert {(r.path_doc, r.path_place) for r in rows if 49 <= r.doc_id < 54} == {(50, 0)}
    assert {(r.path_doc, r.path_place) for r in rows if r.doc_id >= 60} == {(60, 0)}


def test_runs_are_cut_where_a_node_stands_twice(spark):
    runs = [(1, 5, [10, 11, 12, 13]), (2, 0, [20, 12, 21]), (3, 3, [7, 7, 8]), (4, 0, [30, 31])]
    got = substrings.cut_at_branches(spark.createDataFrame(runs, "doc_id bigint, place int, nodes array<bigint>")).collect()
    assert sorted(map(tuple, got)) == [(1, 5, 2, 10, 12), (1, 7, 1, 12, 13), (2, 0, 1, 20, 12), (2, 1, 1, 12, 21), (3, 3, 1, 7, 7), (3, 4, 1, 7, 8), (4, 0, 1, 30, 31)]


def test_repeats_are_fewer_paths_than_edges(spark, monkeypatch):
    seen = []
    true = substrings.compacted
    monkeypatch.setattr(substrings, "compacted", lambda cut: seen.append((cut.agg({"n": "sum"}).first()[0], true(cut))) or seen[-1][1])
    substrings.remove_repeats(frame(spark, [(i, t) for i, t in corpus(5) if i is not None])).collect()
    ((edges, paths),) = seen
    assert 0 < paths.count() < edges / 3


def test_empty_table(spark):
    assert substrings.remove_repeats(frame(spark, [])).count() == 0
    assert substrings.cut_repeats(frame(spark, [])).count() == 0


def test_cut_keeps_columns_and_untouched_texts(spark):
    data = corpus(7)
    docs = frame(spark, data)
    got = substrings.cut_repeats(docs)
    assert got.columns == docs.columns
    want = slow(data, 13)
    rows = got.collect()
    assert sorted((r.doc_id or -1 for r in rows)) == sorted(i or -1 for (i, n, gone, _) in want if gone < n or not n)
    texts = dict(data)
    digest = {(i, sha) for i, _, _, sha in want}
    for r in rows:
        assert (r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) in digest
        assert r.n_chars == len(r.text or "") and (r.place, r.spans) == (1, "x")
    lost = {i for i, _, gone, _ in want if gone}
    assert all(r.text == texts[r.doc_id] for r in rows if r.doc_id not in lost)


def test_words_of_a_block():
    texts = [b"", b" a  bb\n", b"\t", b"ccc A", b"x"]
    w = blocks.Words(texts, fold=True)
    assert [w.data[a:b] for a, b in zip(w.starts, w.ends)] == b" ".join(texts).split()
    assert w.doc.tolist() == [1, 1, 3, 3, 4] and w.counts.tolist() == [0, 2, 0, 2, 1]
    assert w.hashes[0] == w.hashes[3] and len(set(w.hashes.tolist())) == 4
    assert len(blocks.Words([b" ", b""]).hashes) == 0
