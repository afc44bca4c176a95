"""Dictionary phrases of any length, grounding, resolution and discovery, against plain loops over small texts."""

import math
import random
import re

from pyspark.sql import functions as F

from storyspark.operators import discovery, grounding, resolver
from storyspark.operators import language as op

F_SCHEMA = "surface string, words int, id string"


def slow_scan(docs, forms):
    out = []
    for key, text in docs:
        words = (text or "").lower().split()
        for i in range(len(words)):
            out += [(key, i, n, s, e) for s, n, e in forms if words[i : i + n] == s.split()]
    return sorted(out)


def test_phrases_of_any_length(spark):
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "dd", "e"]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 80)))) for k in range(40)] + [(99, None), (98, "")]
    texts = {" ".join(rng.choices(vocabulary, k=k)) for k in (1, 1, 2, 3, 4, 5, 6, 7)} | {docs[0][1], " ".join(docs[1][1].split()[2:11])}
    forms = [(s, len(s.split()), f"e{i % 3}") for i, s in enumerate(sorted(t for t in texts if t))]
    df = spark.createDataFrame([(t, k) for k, t in docs], "text string, doc_id int")
    got = op.dictionary_scan(df, spark.createDataFrame(forms, F_SCHEMA), "text")
    assert sorted((r["doc_id"], r["place"], r["words"], r["surface"], r["id"]) for r in got.collect()) == slow_scan(docs, forms)
    assert any(n > op.HEAD_WORDS for _, _, n, _, _ in slow_scan(docs, forms))
    assert op.dictionary_scan(df, spark.createDataFrame([], F_SCHEMA), "text").count() == 0


def test_grounding_shows_its_issues(spark):
    far = "Ann " + "x" * 600 + " Bob and Bob. ann"
    notes = spark.createDataFrame([("n1", "ANN saw Bob, then Ann left."), ("n2", far), ("n3", None), ("n4", "Q.E.D. \\E Bob")], "id string, text string")
    rows = [("n1", "ann", "bob"), ("n1", "Cid", "bob"), ("n1", "ann", "Cid"), ("n2", "ann x", "bob"), ("n2", "ann", "bob"), ("n3", "ann", "bob"), ("n9", "ann", "bob"), ("n4", "q.e.d.", "\\e"), ("n1", "", "bob"), ("n1", None, "bob")]
    got = grounding.grounded(spark.createDataFrame(rows, "note_id string, subject string, object string"), notes).collect()
    by = {(r["note_id"], r["subject"], r["object"]): (r["subject_at"], r["object_at"], r["valid"], r["issues"]) for r in got}
    both = ["subject not found", "object not found"]
    assert len(got) == len(rows)
    assert by["n1", "ann", "bob"] == (0, 8, True, [])
    assert by["n1", "Cid", "bob"] == (None, 8, False, both[:1]) and by["n1", "ann", "Cid"] == (0, None, False, both[1:])
    assert by["n2", "ann x", "bob"] == (0, 605, False, ["too far apart"]) and by["n2", "ann", "bob"] == (618, 613, True, [])
    assert by["n3", "ann", "bob"] == by["n9", "ann", "bob"] == (None, None, False, both)
    assert by["n4", "q.e.d.", "\\e"] == (0, 7, True, [])
    assert by["n1", "", "bob"][3] == by["n1", None, "bob"][3] == both[:1]


def test_nearest_pairs_against_all_pairs(spark):
    rng = random.Random(9)
    rows = [([*sorted(rng.sample(range(60), rng.randrange(0, 9)))], [*sorted(rng.sample(range(60, 120) if k % 2 else range(60), rng.randrange(0, 9)))]) for k in range(60)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<int>, b array<int>")
    for r in df.select("i", grounding.nearest(df["a"], df["b"]).alias("x")).collect():
        a, b = rows[r["i"]]
        least = min((abs(x - y) for x in a for y in b), default=None)
        assert (None if r["x"] is None else abs(r["x"]["a"] - r["x"]["b"])) == least


PEOPLE = [("e1", "Ann of the Old Mill", "female"), ("e2", "Bob Miller", "male"), ("e3", "Old Bob", "male"), ("e4", "The Ring", "neutral"), ("e5", "ann", "female"), ("e6", "Cup of the Old King", "neutral")]
NICKNAMES = [("e1", "Annie of the mill"), ("e2", "the smith"), ("e2", "smith bob"), ("e4", "ann"), ("zz", "stranger")]


def slow_scores(text, pruned=False):
    """Scores of all entities, by the formula."""
    names = {e: set(label.lower().split()) for e, label, _ in PEOPLE}
    lengths = {e: len(label.split(" ")) for e, label, _ in PEOPLE}
    called = {e: [w for i, a in NICKNAMES if i == e for w in a.lower().split()] for e in names}
    n, mean = len(PEOPLE), sum(lengths.values()) / len(PEOPLE)
    held = sum(i in names for i, _ in NICKNAMES) / n
    out = {}
    for e in names:
        total = 0.0
        for w in set(text.lower().split()):
            df = sum(w in names[x] or w in called[x] for x in names)
            star = (10 / (0.5 + 0.5 * lengths[e] / mean) if w in names[e] else 0) + 5 * called[e].count(w) / (0.5 + 0.5 * 10 / held)
            total += 0.5 * math.log(1 + max(0, (n - df + 0.5) / (df + 0.5))) * 2.2 * star / (1.2 + star) if df else 0
        out[e] = round(total, 9)
    return out


def test_resolution_by_name_alias_words_and_pronoun(spark):
    said = ["ANN", "Annie of the mill", "she", "old bob", "he", "the smith", "mill ann", "miller", "of the", "nobody", "it", "cup", "It", "smith", None, "they"]
    mentions = spark.createDataFrame([("d", i, t) for i, t in enumerate(said)] + [("e", 1, "she")], "doc string, place int, text string")
    people = spark.createDataFrame(PEOPLE, "id string, label string, gender string")
    got = {(r["doc"], r["place"]): r for r in resolver.resolve(mentions, people, spark.createDataFrame(NICKNAMES, "entity_id string, alias string")).collect()}
    assert len(got) == len(said) + 1
    for i, text in enumerate(said):
        r = got["d", i]
        if r["how"] == "words" or (r["how"] is None and text and text.lower() not in ("they",)):
            scores = slow_scores(text)
            best = min(scores, key=lambda e: (-scores[e], e))
            assert (r["entity"], r["score"]) == ((best, scores[best]) if scores[best] > 1 else (None, None)), text
    assert [got["d", i]["entity"] for i in (0, 1, 2, 3, 4, 5)] == ["e5", "e1", "e1", "e3", "e3", "e2"]
    assert [got["d", i]["how"] for i in (0, 1, 2, 6)] == ["name", "alias", "pronoun", "words"]
    assert got["d", 12]["entity"] == got["d", 11]["entity"] == "e6" and got["d", 9]["entity"] is None and got["e", 1]["entity"] is None


def test_pruned_candidates_lose_nothing(spark):
    rng = random.Random(8)
    vocabulary = ["ann", "of", "the", "old", "mill", "bob", "miller", "ring", "king", "smith", "xyz"]
    asked = sorted({" ".join(rng.choices(vocabulary, k=rng.randrange(1, 6))) for _ in range(120)})
    people = spark.createDataFrame(PEOPLE, "id string, label string, gender string")
    postings = resolver.index(people, spark.createDataFrame(NICKNAMES, "entity_id string, alias string"))
    got = {r["asked"]: (r["id"], r["score"]) for r in resolver.likely(spark.createDataFrame([(a,) for a in asked], "asked string"), postings).collect()}
    for a in asked:
        scores = slow_scores(a)
        best = min(scores, key=lambda e: (-scores[e], e))
        assert got.get(a) == ((best, scores[best]) if scores[best] > 1 else None), a


STORY = ["Ann attacks Bo. Bo attacks Cy! Cy visits Dover. Dover attacks Ed.", "Then Bo helps Fay, Fay gives Gold Fay attacks Cy", "Nobody is Hal. They attack Ann", None, "", "One two"]


def test_a_chain_of_promotions(spark):
    docs = spark.createDataFrame(list(enumerate(STORY)), "id int, t string")
    edges = discovery.triples(docs, "t")
    assert {(r["source"], r["event"], r["target"]) for r in edges.collect()} >= {("ann", "BATTLE", "bo"), ("bo", "BATTLE", "cy"), ("cy", "TRAVEL", "dover"), ("bo", "RESCUE", "fay")}
    seeds = spark.createDataFrame([("ann", "CHARACTER")], "name string, kind string")
    got = {r["name"]: r for r in discovery.spread(discovery.candidates(docs, "t"), edges, seeds).collect()}
    assert [(got[n]["round"], got[n]["kind"]) for n in ("ann", "bo", "cy", "dover", "fay")] == [(0, "CHARACTER"), (1, "CHARACTER"), (2, "CHARACTER"), (3, "PLACE"), (2, "CHARACTER")]
    assert got["ed"]["kind"] is None and got["ed"]["round"] is None  # places attack nobody's kind
    assert "then" not in got and "they" not in got


def test_a_bump_promotes(spark):
    docs = spark.createDataFrame([(1, "Ann attacks bo. Bo attacks Cy")], "id int, t string")
    found = discovery.candidates(docs, "t")
    seeds = spark.createDataFrame([("bo", "CHARACTER")], "name string, kind string")
    got = {r["name"]: (r["n"], r["status"], r["round"]) for r in discovery.spread(found, discovery.triples(docs, "t"), seeds).collect()}
    assert got == {"ann": (1, "watching", None), "bo": (1, "promoted", 0), "cy": (2, "promoted", 1)}
    none = discovery.spread(found, discovery.triples(docs, "t"), seeds.limit(0)).collect()
    assert {r["round"] for r in none} == {None}


def test_an_anchor_within_a_run_stands_where_the_run_begins(spark):
    run = "ab " * 8  # of "ab ab ab ab ab " one occurrence fits in, at several places
    rows = [(1, "xy: " + run + "end", 7, 4), (2, "no " + run + "end", 3, 3), (3, "ab ab ab ab ab | ab ab ab ab ab ", 17, 17), (4, "gone", 0, None)]
    docs = spark.createDataFrame([(i, t, at) for i, t, at, _ in rows], "id int, t string, at int")
    got = docs.select("id", op.realigned(F.col("t"), F.lit("ab ab ab ab ab "), F.col("at"), F.lit("ab "), F.lit("ab "))).collect()
    assert {r[0]: r[1] for r in got} == {i: want for i, _, _, want in rows}


def test_dictionaries_small_and_large(spark, monkeypatch, tmp_path):
    docs = [(1, "the old red ship of Rome sails, the old red ship sinks"), (2, None), (3, " ,. "), (4, "old"), (5, "the old red ship of rome")]
    forms = [("the", 1, "a"), ("old red", 2, "b"), ("the old red ship of", 5, "c"), ("the old red ship of rome", 6, "d"), ("old red ship sinks", 4, "e"), ("rome sails", 2, "f")]
    spark.createDataFrame(forms, F_SCHEMA).write.parquet(f"{tmp_path}/forms")  # a file's size is known
    df, known = spark.createDataFrame(docs, "doc_id int, text string"), spark.read.parquet(f"{tmp_path}/forms")
    want = slow_scan([(k, (t or "").replace(",", " ").replace(".", " ")) for k, t in docs], forms)
    rows = lambda got: sorted((r["doc_id"], r["place"], r["words"], r["surface"], r["id"]) for r in got.collect())
    monkeypatch.setattr(op, "BROADCAST_BYTES", -1)
    assert rows(op.dictionary_scan(df, known, "text")) == want
    monkeypatch.undo()
    monkeypatch.setattr(op, "written", None)  # a broadcast dictionary needs no table in between, and words are made once
    got = op.dictionary_scan(df, known, "text")
    assert rows(got) == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("translate(lower(") == 1


def test_alike_entities_are_one_candidate(spark, monkeypatch):
    entities = spark.createDataFrame([(f"p{k:03}", f"{'red' if k % 2 else 'old'} bolt {k}") for k in range(200)], "id string, label string")
    aliases = spark.createDataFrame([("p007", "crimson pin"), ("p009", "crimson pin")], "entity_id string, alias string")
    postings = resolver.index(entities, aliases)
    asked = spark.createDataFrame([("the red bolt",), ("bolt 42 red",), ("crimson",), ("nobody",)], "asked string")
    value = {(r["id"], r["word"]): r["value"] for r in postings.collect()}
    want = {}
    for (text,) in asked.collect():
        scores = [(-round(sum(value.get((i, w), 0.0) for w in text.split()), 9), i) for i in sorted({i for i, _ in value})]
        if -min(scores)[0] > 0.5:
            want[text] = (min(scores)[1], -min(scores)[0])
    held = []
    monkeypatch.setattr(resolver, "written", lambda df, name, keep=resolver.written: held.append(df.count()) or keep(df, name))
    got = {r["asked"]: (r["id"], r["score"]) for r in resolver.likely(asked, postings, 0.5).collect()}
    assert got == want and set(want) >= {"bolt 42 red", "the red bolt"}
    assert held and held[0] <= 5  # red bolts, old bolts, 42, and those with the alias


def test_filters_on_names_make_no_name_again(spark):
    """A word's name and stem are made once, above all filters; a filter would make them again from the word, many times."""
    docs = spark.createDataFrame([(1, "Brakk's attacks Suna.' Then 's visits Tor"), (2, None), (3, "It helps"), (4, "")], "id int, t string")
    for made in (discovery.triples(docs, "t"), discovery.candidates(docs, "t")):
        plan = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert not [line for line in plan if "Filter" in line and "regexp_replace(" in line]
    got = {(r["source"], r["event"], r["target"], r["id"], r["place"]) for r in discovery.triples(docs, "t").collect()}
    assert got == {("'s", "TRAVEL", "tor", 1, 4), ("brakk", "BATTLE", "suna.'", 1, 0)}


def test_a_text_is_searched_once(spark):
    """Each relation's text is lowered and searched in one call, whatever the number of columns that follow from it."""
    rng = random.Random(4)
    rows = [(i, rng.choice(["Ab", "b", "aba", "", None]), rng.choice(["A", "ba", "c"]), rng.choice([None, "".join(rng.choices("aAbB Éé𝄞", k=rng.randrange(30)))])) for i in range(300)]
    found = grounding.located(spark.createDataFrame(rows, "id int, subject string, object string, t string"), text="t", reach=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan and plan.count("ArrowEvalPython") == 1 and plan.count("lower(t") == 1
    got = {r["id"]: (r["subject_at"], r["object_at"], r["valid"], r["issues"]) for r in found.collect()}
    for i, *names, t in rows:
        a, b = ([m.start() for m in re.finditer(re.escape(n.lower()), (t or "").lower())] if n else [] for n in names)
        pair = min(((abs(x - y), min(x, y), x, y) for x in a for y in b), default=None)
        issues = [f"{w} not found" for w, p in (("subject", a), ("object", b)) if not p] + (["too far apart"] if pair and pair[0] > 3 else [])
        assert got[i] == (pair[2] if pair else next(iter(a), None), pair[3] if pair else next(iter(b), None), not issues, issues)
