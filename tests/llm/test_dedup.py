import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from storyspark.llm import cuckoo, simhash
from storyspark.llm.common import connected_components

SCHEMA = "doc_id bigint, text string, fp string, digest int, node string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def slow_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, linked):
    name = {n: n for n in nodes}

    def root(n):
        while name[n] != n:
            n = name[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((root(a), root(b)))
                name[y] = x
    return {n: root(n) for n in nodes}


TEXTS = [None, "", "  \t\n", "One", "one", "one two", "A b c d e f g", "a b c d e f g", "a b c d e f h", "x " * 3000, "X " * 3000, "é É ẞ", "É É ẞ"]


def test_simhash_matches_brute_force(spark):
    rng = random.Random(1)
    rows = list(enumerate(TEXTS * 2))
    base = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(400)]
    for i in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(400)] = "zz"
        rows.append((100 + i, " ".join(words)))
    rows.append((100, rows[-1][1]))
    for limit in (1024, 4):
        got = simhash.near_duplicates(frame(spark, rows), bucket_limit=limit).collect()
        prints = {(r.doc_id, int(r.fingerprint, 16)) for r in got}
        assert prints == {(i, slow_fingerprint(t)) for i, t in rows} and len(got) == len(rows)
        known = sorted({p for _, p in prints})
        roots = slow_components(known, lambda a, b: (a ^ b).bit_count() <= 2)
        least = {}
        for i, p in prints:
            least[roots[p]] = min(i, least.get(roots[p], i))
        assert all(r.component_id == least[roots[int(r.fingerprint, 16)]] for r in got)


def test_pairs_lose_no_link(spark):
    rng = random.Random(2)
    fps = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    for bits in (1, 2, 3):
        want = slow_components(sorted(fps), lambda a, b: (a ^ b).bit_count() <= bits)
        for limit in (1024, 5):
            pairs = {(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.linked_pairs(df, bits, limit).collect()}
            assert all((a ^ b).bit_count() <= bits for a, b in pairs)
            assert slow_components(sorted(fps), lambda a, b: (a, b) in pairs or (b, a) in pairs) == want


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert simhash.near_duplicates(empty).count() == 0
    assert cuckoo.exact_duplicates(empty).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 299)]
    edges += [(rng.randint(400, 450), rng.randint(400, 450)) for _ in range(30)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    nodes = sorted({n for e in edges if e[0] != e[1] for n in e})
    want = slow_components(nodes, lambda a, b: (a, b) in edges or (b, a) in edges)
    assert got == {n: c for n, c in want.items() if n != c}


def test_cuckoo_shard_inserts_deletes_and_resizes():
    rng = random.Random(4)
    shard, live = cuckoo.CuckooShard(1), {}
    for step in range(4000):
        key = hashlib.sha256(str(rng.randint(0, 900)).encode()).digest()
        if rng.random() < 0.6:
            shard.insert(key, step)
            live[key] = live.get(key, 0) + 1
        else:
            assert shard.delete(key) == (key in live)
            if key in live:
                live[key] -= 1
                live = {k: n for k, n in live.items() if n}
    assert {e[0]: e[2] for e in shard.entries()} == live
    assert all(shard.find(k) for k in live) and shard.resizes and shard.live == len(live)


def test_exact_duplicates_match_brute_force(spark):
    rows = list(enumerate(TEXTS * 3)) + [(2, None)]
    got = {(r.doc_id, r.text_sha256): r for r in cuckoo.exact_duplicates(frame(spark, rows)).collect()}

    def norm(t):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")

    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    for i, t in rows:
        r = got[i, hashlib.sha256(norm(t).encode()).hexdigest()]
        ids = groups[norm(t)]
        assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), i == max(ids))
    kept = cuckoo.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "fp", "digest", "node"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({max(ids) for ids in groups.values()})


def test_index_forgets_removed_documents(spark):
    rows = cuckoo.digests(frame(spark, [(1, "a"), (2, "A"), (3, "b"), (4, "c"), (5, "c")]))
    index = cuckoo.build_index(rows, rows.where(F.col("doc_id").isin(1, 3)), shard_rows=2)
    assert sorted((r.keep_id, r.group_size) for r in index.collect()) == [(2, 1), (5, 2)]


def test_null_ids_of_near_duplicates(spark):
    """A row without a doc_id has a fingerprint, and the component of the rows that it is linked with."""
    text = "some words that are the same in both of these rows here"
    rows = simhash.near_duplicates(spark.createDataFrame([(None, text), (4, text), (9, text.upper()), (None, "quite another text of its own with other words")], "doc_id bigint, text string")).collect()
    assert len(rows) == 4 and {r["component_id"] for r in rows if r["doc_id"]} == {4}
    assert sorted(str(r["component_id"]) for r in rows if r["doc_id"] is None) == ["4", "None"]
    kept = simhash.keep_one(spark.createDataFrame([(None, text), (4, text), (9, text)], "doc_id bigint, text string"))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "None"]


def test_index_of_fingerprints_is_never_broadcast(spark, monkeypatch):
    plans = {}

    def kept(df, name, write=simhash.materialize):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(simhash, "materialize", kept)
    df = spark.createDataFrame([(x,) for x in (0, 1, 3, 1 << 40)], "fp bigint")
    assert simhash.linked_pairs(df).count() > 0
    assert "BroadcastHashJoin" not in plans["buckets"]  # by its file's size the index seems small enough for one
