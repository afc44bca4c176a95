import math
import random

from storyspark.llm import packing, tokencounts

SCHEMA = "doc_id bigint, text string, n_tokens int, group string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], SCHEMA)


def test_sums_match_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "a", "a", "日本語"] + [" ".join(rng.choices(["the", "of", "xyzzy", "é"], k=rng.randint(0, 60))) for _ in range(200)] + ["the " * 5000]
    encode = packing.Encoder()
    sizes = [len(encode(t or "")) for t in texts]
    sums = tokencounts.with_suffix_sums(tokencounts.length_histogram(frame(spark, texts).repartition(3))).cache()
    got = {r.n_tokens: r for r in sums.collect()}
    assert set(got) == set(sizes)
    for k, r in got.items():
        longer = [s for s in sizes if s >= k]
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (sizes.count(k), len(longer), sum(longer))
        assert (r.docs_at_most, r.total_docs, r.total_tokens) == (sum(s <= k for s in sizes), len(sizes), sum(sizes))
        assert r.truncated_tokens == sum(min(s, k) for s in sizes)
    limits = [0, 1, 7, 50, 4096, 10**6]
    for r in tokencounts.under_limits(sums, limits).collect():
        assert (r.docs_cut, r.kept_tokens) == (sum(s > r.limit for s in sizes), sum(min(s, r.limit) for s in sizes))
    for r in tokencounts.quantiles(sums, [0.01, 0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == sorted(sizes)[math.ceil(r.share * len(sizes)) - 1]


def test_empty_table(spark):
    assert tokencounts.with_suffix_sums(tokencounts.length_histogram(frame(spark, []))).count() == 0
