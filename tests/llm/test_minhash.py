import hashlib
import random

import pytest
import xxhash

from storyspark.llm import minhash

SCHEMA = "doc_id bigint, text string, own string, block int"


def frame(spark, data):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in data], SCHEMA)


def texts(seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "é日"] + [f"w{i}" for i in range(300)]
    out = [None, "", " \n", "a", "ab cd", "one two three", "x " * 2000, "日本語 " * 50]
    return out + [" ".join(rng.choices(words, k=rng.randint(1, 400))) for _ in range(60)]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(values):
    """Spark's xxhash64 of longs, ints or strings in turn, each seeded by the last."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v
        seed = xxhash.xxh64_intdigest(data, seed)
    return signed(seed)


def slow_signature(text):
    """The same selection by plain loops: the two minimal numbered k-mers of every bin, in text order."""
    words = [w for w in (text or "").encode().split()]
    grams = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    seen, numbered = {}, []
    for place, gram in enumerate(grams):
        h = spark_hash([w.decode() for w in gram]) >> 24
        o = seen[h] = seen.get(h, -1) + 1
        numbered.append((spark_hash([h.to_bytes(8, "little", signed=True), o.to_bytes(4, "little", signed=True)]) >> 24, place))
    out = {}
    for b in range(-32, 32):
        own = sorted(x for x in numbered if x[0] >> 34 == b)[:2]
        if own:
            chosen = [h for h, _ in sorted(own, key=lambda x: x[1])]
            out[b + 32] = spark_hash([h.to_bytes(8, "little", signed=True) for h in chosen]) & 0xFFFFFFFF
    return "".join(f"{b:02x}{h:08x}" for b, h in out.items()), out


def slow_likeness(a, b):
    used = a.keys() | b.keys()
    return sum(a.get(k) == b.get(k) for k in used) / len(used) if used else 1.0


@pytest.mark.parametrize("step", [1, 977])
def test_rows_match_brute_force(spark, step):
    data = [(step * i - 500, t) for i, t in enumerate(texts())] + [(10**15, "the last one of all")]
    order = sorted(data, reverse=True)
    got = {r.doc_id: r for r in minhash.edited_fingerprints(frame(spark, data).repartition(3)).collect()}
    assert len(got) == len(data)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        (own, a), (changed, b), (_, c) = map(slow_signature, (t, edited, after))
        assert (r.fingerprint, r.edited_fingerprint) == (own, changed)
        assert r.near_edited == pytest.approx(slow_likeness(a, b)) and r.near_next == pytest.approx(slow_likeness(a, c))


def test_order_matters_and_edits_lower_likeness(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(600)]
    halves = words[300:] + words[:300]
    few, many = list(words), list(words)
    for edits, own in ((6, few), (120, many)):
        for _ in range(edits):
            own[rng.randrange(600)] = "edit"
    data = {0: words, 1: halves, 2: few, 3: many, 4: words}
    df = minhash.with_signature(frame(spark, [(i, " ".join(w)) for i, w in data.items()]), "text", "sig")
    base = df.where("doc_id = 0").selectExpr("sig as a")
    near = {r.doc_id: r.n for r in df.crossJoin(base).select("doc_id", minhash.likeness("sig", "a").alias("n")).collect()}
    assert near[4] == 1 and near[4] > near[2] > near[3] and near[1] < 0.75


def test_ties_nulls_and_few_rows(spark):
    assert minhash.edited_fingerprints(frame(spark, [])).count() == 0
    one = minhash.edited_fingerprints(frame(spark, [(7, "abc def")])).first()
    assert one.near_next == 1.0 and 0 <= one.near_edited <= 1
    rows = minhash.edited_fingerprints(frame(spark, [(1, "abcdef"), (1, "abcdef"), (None, None), (None, "xyz")])).collect()
    assert len(rows) == 4 and minhash.fingerprints(frame(spark, [(1, "a"), (1, "a")])).distinct().count() == 1
