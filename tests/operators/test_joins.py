"""Pairs of near rows against plain loops, and how often their rows are shuffled."""

import random
from collections import defaultdict

import storyspark.plans  # noqa: F401  registers the queries
from storyspark.operators import joins
from storyspark.plans.registry import QUERIES


def slow_least(rows, width):
    by, out = defaultdict(list), {}
    for *key, item, at in rows:
        if None not in (*key, item, at):
            by[tuple(key)].append((item, at))
    for key, own in by.items():
        for x, p in own:
            for y, q in own:
                if x < y and abs(p - q) < width:
                    out[*key, x, y] = min(out.get((*key, x, y), width), abs(p - q))
    return sorted((*k, d) for k, d in out.items())


def test_least_distances_against_loops(spark):
    rng = random.Random(3)
    names = ["a", "b", "é", "z", "A", "", "zz", "\U0001f600"]
    rows = [(rng.randrange(6), rng.choice("xy"), rng.choice(names), rng.randrange(-40, 200)) for _ in range(400)]
    rows += [(9, "x", rng.choice(names), rng.randrange(60)) for _ in range(300)]  # one key of many batches
    rows += [(None, "x", "a", 1), (1, None, "b", 1), (1, "x", None, 1), (1, "x", "a", None), (77, "x", "a", 5)]
    df = spark.createDataFrame(rows, "k int, l string, e string, at int")
    want = slow_least(rows, 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = joins.band_least(df, ["k", "l"], "e", "at", 7)
        assert got.columns == ["k", "l", "a", "b", "distance"] and dict(got.dtypes)["distance"] == "int"
        assert sorted(map(tuple, got.collect())) == want
        assert joins.band_least(df.where("k > 99"), ["k", "l"], "e", "at", 7).collect() == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pairs_are_compared_in_parts():
    rng = random.Random(8)
    rows = sorted((k, rng.randrange(30), rng.choice("abcdef")) for k in range(3) for _ in range(50))
    table = joins.pa.table({"k": [r[0] for r in rows], "a": [r[2] for r in rows], "distance": [r[1] for r in rows]})
    shape = joins.pa.schema([("k", "int64"), ("a", "string"), ("b", "string"), ("distance", "int32")])
    whole, joins.COMPARED = joins.COMPARED, 40
    try:
        parts = list(joins.least_of(table, 1, 5, shape))
    finally:
        joins.COMPARED = whole
    got = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    assert len(parts) > 5 and sorted(got) == slow_least([(k, e, at) for k, at, e in rows], 5)


def test_word_window_shuffles_its_rows_once(spark):
    from storyspark.plans.model import Model

    plan = joins.band_least(Model(spark, "/root/testdata/sf0.001").spans, ["note_id"], "entity_id", "from_pos", 30)
    assert QUERIES["join_word_window"](spark, "/root/testdata/sf0.001").exceptAll(plan).count() == 0
    text = QUERIES["join_word_window"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert text.count("Join") == 0 and text.count("Aggregate") == 0
