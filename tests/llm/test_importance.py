"""Importance resampling and its radix sort against plain Python."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest

from storyspark.llm import importance, radix
from storyspark.llm.common import materialize

FOLDER = "/root/testdata/sf0.001"


def plain(docs, target, percent=10, least=20, max_run=1):
    """The same by sorting in memory."""

    def features(text):
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        runs = [" ".join(words[i : i + k]) for k in range(1, max_run + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(x.encode()) % 10000 for x in runs]

    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for b in features(x)[1]:
                counts[b] += 1
    rows = []
    for doc_id, text in docs:
        n, own = features(text)
        each = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in own]
        weight = math.floor(sum(each) / len(each)) if own else 0
        h = int(hashlib.sha256(f"2024:{doc_id if doc_id is not None else ''}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    open_ = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(open_[: percent * len(open_) // 100], 1)}
    return sorted(((r[0], *r[2:], rank.get(id(r))) for r in rows), key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=repr)


def corpus(n=400, seed=7):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Änder", "日本", "don't", "X9"]
    return [(i * 3, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(n)]


@pytest.mark.parametrize(("percent", "least", "max_run"), [(10, 20, 1), (100, 0, 1), (37, 5, 3), (0, 20, 1)])
def test_like_sorting_in_memory(spark, percent, least, max_run):
    docs, target = corpus(), [f"w{i} w{i + 1} w{i}" for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    assert got(importance.resample(df, goal, percent, least, max_run=max_run)) == plain(docs, target, percent, least, max_run)


def test_odd_rows(spark):
    long = "Word " * 200_000 + "end"
    docs = [(1, None), (2, ""), (3, "..!"), (4, long), (5, "a b c"), (6, "A B C"), (7, "é É ß\u00a0x"), (8, "x" * 300_000), (-9, "tail " * 30)]
    df = spark.createDataFrame([(t, d, "other", d) for d, t in docs], "text string, doc_id bigint, bucket string, rank bigint")
    goal = spark.createDataFrame([(None,), ("",), ("word a",)], "text string")
    assert got(importance.resample(df, goal, 50, 1)) == plain(docs, ["", "word a"], 50, 1)


def test_repeated_rows_and_null_ids(spark):
    docs = [(5, "a b c d")] * 4 + [(None, "a b c d")] * 3 + [(6, "q r s t")]
    rows = got(importance.resample(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([("a",)], "text string"), 100, 1))
    assert sorted(r[4] for r in rows) == list(range(1, 9))
    assert {r[:4] for r in rows} == {r[:4] for r in plain(docs, ["a"], 100, 1)}


@pytest.mark.parametrize("docs", [[], [(1, "one two")]])
def test_empty_tables(spark, docs):
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert got(importance.resample(df, spark.createDataFrame([], "text string"), 100, 1)) == plain(docs, [], 100, 1)


def test_query_matches_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.sql(f"SELECT doc_id, n_features, weight, score, rank FROM ({importance.ORACLE_OP13})").fetchall()
    assert got(importance.op13_importance_resampling(spark, FOLDER)) == sorted(want, key=repr)


@pytest.mark.parametrize(("bits", "block_rows"), [(3, 16), (11, 64), (16, 5000)])
def test_radix_ranks(spark, bits, block_rows):
    rng = random.Random(bits)
    rows = [(rng.choice([None, -(2**63), 2**63 - 2, 0, 7, 7, 7]), rng.randrange(-50, 50), i) for i in range(900)]
    rows += [(7, 3, i) for i in range(900, 1500)]  # a key with a third of the rows
    df = materialize(spark.createDataFrame(rows, "a bigint, b bigint, id bigint").repartition(5), "rows")
    out = radix.ranked(df, ["a", "b", "id"], bits, block_rows).orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(1, len(rows) + 1))
    assert [(r["a"], r["b"], r["id"]) for r in out] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def test_radix_of_equal_keys_and_of_nothing(spark):
    df = spark.createDataFrame([(4, i) for i in range(50)], "a bigint, id bigint")
    assert sorted(r["rank"] for r in radix.ranked(df, ["a"], 4, 8).collect()) == list(range(1, 51))
    nulls = spark.createDataFrame([(None, 1), (None, 2)], "a bigint, id bigint")
    assert sorted(r["rank"] for r in radix.ranked(nulls, ["a"]).collect()) == [1, 2]
    assert radix.ranked(df.limit(0), ["a"]).collect() == []
