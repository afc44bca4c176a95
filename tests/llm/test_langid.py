import random
import zlib

from storyspark.llm import langid

WORDS = {
    "en": "the of and to in that is was he for it with as his on be at by had not are but from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero".split(),
    "xx": "zzuq qqzu zuzu".split(),
}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, lang_pred string, score double"


def rows(seed=1, n=240):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randint(8, 60))), lang))
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, t, g, "s", 1, "q", 0.5) for i, t, g in data], SCHEMA)


def test_held_out_accuracy_and_edge_cases(spark):
    data = rows() + [(1000, None, "en"), (1001, "", None), (1002, "12 345 !?", "de"), (1003, "the of and " * 20000, None), (None, "der die und das", "de")]
    got = {r.doc_id: r for r in langid.identify(frame(spark, data)).collect()}
    assert len(got) == len(data)
    held = [(i, g) for i, _, g in rows() if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i, _ in held) and sum(r.held_out for r in got.values()) >= len(held)
    assert sum(got[i].lang_pred == g for i, g in held) / len(held) > 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "en" and got[None].lang_pred == "de" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())


def test_keep_known_keeps_columns_and_clean_rows(spark):
    data = rows() + [(1000, None, "en"), (1002, "12 345 !?", "de")]
    kept = langid.keep_known(frame(spark, data))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score"]
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, _ in rows()]


def test_nothing_to_learn_from(spark):
    assert langid.identify(frame(spark, [])).count() == 0
    got = langid.identify(frame(spark, [(1, "hello", None)])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
