import random

import corpus_pipeline
from storyspark.llm import packing, simhash
from tests.llm.test_dedup import slow_components
from tests.llm.test_jaccard import alike, slow_shingles
from tests.llm.test_substrings import slow as slow_substrings

WORDS = {
    "en": "the of and to in that is was he for it with as his on be at by had not are but from".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se".split(),
}


def documents():
    rng = random.Random(6)
    data = []
    for i in range(60):
        lang = rng.choice(list(WORDS))
        data.append((i, " ".join(f"{w}{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}" for w in rng.choices(WORDS[lang], k=rng.randint(20, 90))), lang))
    passage = data[0][1].split()[:16]
    data += [(100 + i, t.upper() if i % 2 else t, g) for i, (_, t, g) in enumerate(data[:10])]
    data += [(200 + i, t + " tail", g) for i, (_, t, g) in enumerate(data[10:20])]
    data += [(300 + i, " ".join([*t.split()[20:], "new", *passage, "end"]), g) for i, (_, t, g) in enumerate(data[30:34])]
    data += [(400, None, "en"), (401, "", None), (402, "12 34 ---", "en")]
    return data


def test_stages_match_brute_force(spark, tmp_path):
    data = documents()
    spark.createDataFrame([(i, t, g, "src", len(t or "")) for i, t, g in data], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    texts = {i: t for i, t, _ in data}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == columns
        got = spark.createDataFrame(got.collect(), docs.schema)
        if name == "language_id":
            texts = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
        elif name == "exact_dedup":
            last = {}
            for i, t in sorted(texts.items()):
                last[t.lower()] = i
            texts = {i: texts[i] for i in last.values()}
        elif name == "minhash_near_dedup":
            sets = {i: slow_shingles(t) for i, t in texts.items()}  # five words, a likeness of 0.8
            roots = slow_components(sorted(texts), lambda a, b: alike(sets[a], sets[b]))
            texts = {i: t for i, t in texts.items() if roots[i] == i}
        else:
            removed = {r[0]: (r[1], r[2]) for r in slow_substrings(list(texts.items()), 13)}
            assert {r.doc_id for r in got.collect()} == {i for i, (n, gone) in removed.items() if gone < n}
            for r in got.collect():
                n, gone = removed[r.doc_id]
                assert len(r.text.encode().split()) == n - gone and (gone or r.text == texts[r.doc_id])
            texts = {r.doc_id: r.text for r in got.collect()}
        assert {r.doc_id: r.text for r in got.collect()} == texts
        docs = got
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    encode = packing.Encoder()
    assert sum(r.length for r in packed) == sum(len(encode(t)) + 1 for t in texts.values())
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, packed))
    assert simhash.fingerprint(b"") == 0


def test_stages_take_empty_and_null_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, block int, extra string, ids string, kept boolean"
    nothing = spark.createDataFrame([], schema)
    odd = [(None, None, None, None, None, None, None, None, None), (1, None, None, None, None, 1, "x", "y", True), (2, "", "en", "s", 0, 1, "x", "y", True)]
    odd += [(3, "only words here", None, None, None, 1, None, None, None)] * 2 + [(4, "ONLY words here", "en", "s", 15, 1, "x", "y", False), (5, "w " * 30000, "en", "s", 60000, 1, "x", "y", False)]
    for rows in (nothing, spark.createDataFrame(odd, schema)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, rows, "")
            assert got.columns == rows.columns, name
            kept = got.collect()
            assert {r.doc_id for r in kept} <= {r[0] for r in odd}
            if name == "substring_dedup" and rows is not nothing:
                assert len(kept) == len(odd)
            if name == "exact_dedup" and rows is not nothing:
                assert sorted(r.doc_id or 0 for r in kept) == [0, 2, 4, 5]
        assert corpus_pipeline.STAGES[-1][1](spark, rows, "").count() == (0 if rows is nothing else len(odd) - 1 + packed_pieces(odd))


def packed_pieces(rows):
    """Pieces of the last row, which alone is cut."""
    return -(-(len(packing.Encoder()(rows[-1][1])) + 1) // 1024)
