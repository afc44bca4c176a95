"""The vector index against brute force, and the invariants of the tree of clusters."""

import numpy as np
import pytest

from storyspark.operators import vector_index, vectors


def frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "id bigint, vec array<float>")


def clustered(n, seed, spread=0.15, centres=25):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, 16))
    return (middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, 16))).astype(np.float32)


def brute(x, queries, k):
    u = vector_index.unit_rows(x.astype(np.float64))
    far = np.round(1 - u[queries] @ u.T, 6)
    return {q: [(int(i), round(float(far[j, i]), 5)) for i in np.lexsort((np.arange(len(x)), far[j]))[:k]] for j, q in enumerate(queries)}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query"], r["place"])):
        out.setdefault(r["query"], []).append((r["id"], round(r["distance"], 5)))
    return out


@pytest.mark.parametrize("chunk", [40, 1 << 14])
def test_index_and_exact_search(spark, chunk, monkeypatch):
    monkeypatch.setattr(vector_index, "CHUNK", chunk)
    x = clustered(900, 3)
    x[5] = 0  # a vector without a direction
    df = frame(spark, x)
    asked = df.where("id % 20 = 0").withColumnRenamed("id", "query")
    queries = list(range(0, 900, 20))
    want = brute(x, queries, 10)
    assert found(vector_index.exact(asked, df, 10)) == want
    index = vector_index.build(df)
    assert index.rows.count() == 900
    probes = index.probes(0.95)
    got = found(index.search(asked, 10, probes))
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in queries])
    share = index.read_share(asked, probes).first()
    assert recall >= 0.95 and share["queries"] == 45 and share["share"] < 0.5
    assert all(dict(want[q]).get(i, d) == d for q in queries for i, d in got[q])
    assert found(index.search(asked, 10, len(index.centres))) == want


def test_small_indexes(spark):
    one = frame(spark, np.ones((1, 3)))
    index = vector_index.build(one)
    assert found(index.search(one.withColumnRenamed("id", "query"), 5, 3)) == {0: [(0, 0.0)]}
    assert index.search(one.limit(0).withColumnRenamed("id", "query"), 5, 1).count() == 0
    with pytest.raises(ValueError):
        vector_index.build(one.limit(0))


@pytest.mark.parametrize("kind", ["clustered", "equal", "few"])
def test_tree(spark, kind):
    x = {"clustered": clustered(300, 8), "equal": np.ones((70, 4)), "few": clustered(5, 1)}[kind]
    rows = vectors.cluster_tree(frame(spark, x), 6).collect()
    levels = {}
    for r in rows:
        levels.setdefault(r["level"], []).append(r)
    for level in range(len(levels)):
        own = levels[level]
        assert len({r["node"] for r in own}) == len(own)
        if level + 1 < len(levels):
            above = {r["node"]: r["n"] for r in levels[level + 1]}
            members = {}
            for r in own:
                members[r["parent"]] = members.get(r["parent"], 0) + 1
            assert members == above and max(members.values()) <= 6 and min(members.values()) >= 2
            assert 2 * len(above) <= len(own)
        else:
            assert len(own) <= 6 and all(r["parent"] is None for r in own)
    assert len(levels[0]) == len(x)


def test_near_vectors_stay_together(spark):
    x = np.concatenate([np.eye(3)[[0] * 8] + 0.01 * np.arange(8)[:, None], np.eye(3)[[1] * 8] + 0.01 * np.arange(8)[:, None]])
    rows = [r for r in vectors.cluster_tree(frame(spark, x), 8).collect() if r["level"] == 0]
    sides = {r["parent"]: {int(q["node"]) // 8 for q in rows if q["parent"] == r["parent"]} for r in rows}
    assert all(len(s) == 1 for s in sides.values())


def test_clusters_are_those_of_the_nearest_centre(spark):
    x = clustered(200, 5)
    found_, centres = vectors.kmeans(frame(spark, x), 6)
    u, c = (vector_index.unit_rows(np.asarray(m, np.float64)) for m in (x, centres))
    like = u @ c.T
    for r in found_.collect():
        assert like[r["id"], r["cluster"]] >= like[r["id"]].max() - 1e-6
    assert len(centres) == 6


def test_diverse_picks_against_a_plain_loop(spark):
    x, query = clustered(300, 6), [1.0, -0.5] * 8
    got = [r["id"] for r in vectors.diverse(frame(spark, x), query, 8, pool=60).orderBy("place").collect()]
    u = vector_index.unit_rows(x.astype(np.float64))
    near = np.round(u @ vector_index.unit_rows(np.array([query]))[0], 6)
    pool = sorted(range(300), key=lambda i: (-near[i], i))[:60]
    want = []
    while len(want) < 8:
        rest = [i for i in pool if i not in want]
        want.append(max(rest, key=lambda i: (round(0.5 * near[i] - 0.5 * max((u[i] @ u[j] for j in want), default=0.0), 9), -pool.index(i))))
    assert got == want


def test_least_keeps_ties_by_id_and_blocks_are_bounded():
    rng = np.random.default_rng(3)
    far, ids = np.round(rng.random((40, 300)), 1), rng.permutation(300)
    order = np.lexsort((np.broadcast_to(ids, far.shape), far), axis=1)[:, :7]
    places, values = vector_index.least(far, ids, 7)
    assert (places == order).all() and (values == np.take_along_axis(far, order, 1)).all()
    parts = vector_index.slices(10_000, vector_index.MOST_CELLS)
    assert sum(n for _, n in parts) == 10_000 and max(n for _, n in parts) * vector_index.MOST_CELLS <= vector_index.HELD
