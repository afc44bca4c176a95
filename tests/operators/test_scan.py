"""The scanner's parts against the single operators, and the tree of spans against all pairs."""

import random

from storyspark.operators import language as op
from storyspark.operators import scan as sc

TEXTS = [
    None, "", "   ", "Word", "Ann met the old king. He gave the ring to Bob! Who knows?\n\nSecond block, no end",
    "[CHARACTER|Ann] saw [ITEM|Cup]. It was red. She took it to Bern. Ann said so. cup", "[[A. B! C]] (x) <<n>> #t @m a.b.c ...", "É é ß, o'clock-tower_x  to To Rome\n\n\n\nend.", "x " * 500 + ".",
]


def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_parts_equal_the_single_operators(spark):
    docs = frame(spark)
    whole = sc.scan(docs, "t")
    assert whole.count() == len(TEXTS)
    c = ("id", "kind", "place", "end", "head", "value")
    assert rows(sc.part(whole, "phrases"), *c) == rows(op.phrase_rows(docs, "t"), *c)
    c = ("id", "place", "end", "verb", "event", "relation", "subject", "object")
    assert rows(sc.part(whole, "events"), *c) == rows(op.event_rows(docs, "t"), *c)
    c = ("id", "kind", "place", "length", "value")
    assert rows(sc.part(whole, "marks"), *c) == rows(op.markup(docs, "t"), *c)
    for name in sc.PARTS:
        assert rows(sc.part(sc.scan(docs, "t", parts=[name]), name), "id", "place") == rows(sc.part(whole, name), "id", "place")


def test_references_candidates_and_recipients(spark):
    whole = sc.scan(frame(spark), "t")
    assert [(r["word"], r["entity"]) for r in sc.part(whole, "references").where("id = 5").orderBy("place").collect()] == [("It", "Cup"), ("She", "Ann"), ("it", "Cup"), ("Ann", "Ann")]
    assert [c["name"] for c in sc.parts_of("The old Hero saw a small cup and Bern")["candidates"]] == ["Hero", "Bern"]
    given = sc.parts_of("The king gave it to Ann. He was sent to the mill, then to Bern.")["events"]
    assert [(e["verb"], e["recipient"]) for e in given] == [("was", "Bern")]


def test_dictionary_leaves_out_what_is_marked(spark):
    docs = spark.createDataFrame([(1, "The old mill ; see [[old mill|here]] and the Old Mill again !")], "id int, t string")
    forms = spark.createDataFrame([("old mill", 2, "m1"), ("again", 1, "a1")], "surface string, words int, id string").withColumnRenamed("id", "entity")
    whole = sc.scan(docs, "t")
    assert rows(sc.occurrences(docs, "t", whole, forms), "place", "entity") == [(1, "m1"), (9, "m1"), (11, "a1")]


def slow_tree(text):
    """Parents by comparing every span with every one before it."""
    found = sc.nested_spans(text)
    for n, s in enumerate(found):
        holds = [m for m in range(n) if found[m]["place"] <= s["place"] and found[m]["end"] >= s["end"]]
        assert s["parent"] == (holds[-1] if holds else None), (text, s)
        assert s["depth"] == (0 if s["parent"] is None else found[s["parent"]]["depth"] + 1)
    return found


def test_tree_against_all_pairs():
    rng = random.Random(2)
    bits = ["the ", "old ", "king ", "Ann ", "saw ", ". ", "! ", "\n\n", "[[a ", "b. c]] ", "[A|x] ", "<<n>> ", "#t ", "who ", "to ", "of "]
    for text in [t or "" for t in TEXTS] + ["".join(rng.choices(bits, k=rng.randrange(1, 60))) for _ in range(150)]:
        found = slow_tree(text)
        assert sum(s["level"] == "token" for s in found) == len(op.TOKEN.findall(text))


def test_crossing_spans_are_siblings():
    found = sc.nested_spans("See [[a. b]] now.")
    mark = next(s for s in found if s["level"] == "mark")
    assert found[mark["parent"]]["level"] == "paragraph"  # the sentence ends inside the mark
    assert [s["kind"] for s in found if s["level"] == "sentence"] == ["sentence", "sentence"]


def test_rows_of_a_tree(spark):
    df = sc.nested(frame(spark), "t")
    assert {r["id"] for r in df.collect()} == {k for k, t in enumerate(TEXTS) if (t or "").strip() or t == "   "}
    assert df.where("level = 'token' AND parent IS NULL").count() == 0


def test_workers_hand_rows_on_in_parts(spark, monkeypatch):
    docs = frame(spark).unionByName(spark.createDataFrame([(99, "Ann saw the old mill. " * 40)], "id int, t string")).coalesce(1)
    want = {name: rows(sc.rows_of(docs, "t", name), "id", "place") for name in sc.PARTS}
    monkeypatch.setattr(op, "ROWS", 7)  # far fewer than a text has
    for name in sc.PARTS:
        few = sc.rows_of(docs, "t", name)
        assert rows(few, "id", "place") == want[name] == rows(sc.part(sc.scan(docs, "t", parts=[name]), name), "id", "place")
        assert "ArrowEvalPython" not in few._jdf.queryExecution().executedPlan().toString()  # a batch's rows at once
    assert "ArrowEvalPython" not in sc.scan(docs, "t")._jdf.queryExecution().executedPlan().toString()
    assert sc.rows_of(docs, "t", "phrases", ["place"]).columns == ["id", "place"]


def test_leaves_are_the_words_that_stand_directly_in_a_span(spark):
    whole = sc.nested(frame(spark), "t")
    leaves = whole.where("level = 'token' AND parent IS NOT NULL").groupBy("id", "parent").count()
    some = sc.nested(frame(spark), "t", levels=["paragraph", "sentence", "phrase", "mark"])
    assert rows(some.where("leaves > 0"), "id", "node", "leaves") == rows(leaves, "id", "parent", "count")
    assert some.count() == whole.where("level <> 'token'").count()


def test_relations_with_their_text_are_located_in_place(spark):
    from storyspark.operators import grounding

    rows = spark.createDataFrame([(1, "Ann", "Bob", "ann met bob"), (2, "Ann", "Cy", None)], "id int, subject string, object string, t string")
    found = grounding.located(rows, text="t")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert [(r.subject_at, r.object_at, r.valid) for r in found.orderBy("id").collect()] == [(0, 8, True), (None, None, False)]


def test_dictionary_is_scanned_once_for_short_and_long_forms(spark, monkeypatch):
    from storyspark.operators import language

    names = []
    monkeypatch.setattr(language, "written", lambda df, name, write=language.written: names.append(name) or write(df, name))
    docs = spark.createDataFrame([(1, "a b c d e f a"), (2, None), (3, "b")], "doc_id int, text string")
    forms = spark.createDataFrame([("a b c d e f", 6, "x"), ("a", 1, "y"), ("b c", 2, "z"), ("a b c d e g", 6, "v")], "surface string, words int, id string")
    rows = language.dictionary_scan(docs, forms, "text").select("doc_id", "place", "id").collect()
    assert sorted(map(tuple, rows)) == [(1, 0, "x"), (1, 0, "y"), (1, 1, "z"), (1, 6, "y")]
    assert names == ["found"]


def test_words_of_a_callers_list_are_not_remembered():
    from storyspark.operators import language

    assert [language.baseline("gorp"), language.baseline("gorp", {"gorp": "V"}), language.baseline("gorp")] == ["N", "V", "N"]
    assert language._known.cache_info().maxsize


def test_workers_hand_on_counts_and_asked_kinds_only(spark):
    text = "Ann must run to the quick run, of run. " * 50
    words, bounds = op.split(text)
    letters = op.tagged(words)
    assert [text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=False)] == words == op.TOKEN.findall(text)
    assert {r["tag"]: r["n"] for r in op.base_counts(text)} == {c: sum(op.baseline(w) == c for w in words) for c in {op.baseline(w) for w in words}}
    assert {r["tag"]: (r["n"], r["places"]) for r in op.tag_counts(text)} == {c: (letters.count(c), sum(a for a, x in zip(bounds[::2], letters, strict=False) if x == c)) for c in set(letters)}
    docs = frame(spark)
    every = [r for r in rows(op.phrase_rows(docs, "t"), "id", "place", "kind") if r[2] == "NP"]
    few = op.phrase_rows(docs, "t", kinds={"NP"}, fields=["place", "kind"])
    assert few.columns == ["id", "place", "kind"] and rows(few, "id", "place", "kind") == every


def test_remembered_words_are_bounded():
    op.tagged([f"w{i}" for i in range(70_000)] + ["x" * 1000])
    assert len(op.WORDS) <= 1 << 16 and "x" * 1000 not in op.WORDS
    assert op.tagged(["must", "of", "must", "king", "To", "king", "of", "run"], {"to": "N"}) == op.tagged(["must", "of", "must", "king"]) + "NV" + op.tagged(["of", "run"])


def test_a_tree_without_words_makes_no_rows_of_them():
    """Numbers, parents and leaves are those of the tree with words, by a plain search for each span."""
    rng = random.Random(21)
    bits = ["The ", "ring was sent. ", "\n\n", "\n", "#tag", "#a'b c", "@user_x's ", "[CHARACTER|Hero] ", "[[A b|c]] ", "<<N|x>>", "! ", "?", "It's-ok", "_", "é𝄞", " [A|b] -[KNOWS]-> [B|c]", "to Rome ", "he would run "]
    for _ in range(300):
        text = "".join(rng.choices(bits, k=rng.randrange(25)))
        every = sc.nested_spans(text)
        few = sc.nested_spans(text, words=False)
        assert few == [s for s in every if s["level"] != "token"] and [s["node"] for s in every] == list(range(len(every)))
        for s in every:
            holds = [p for p in every[: s["node"]] if p["end"] >= s["end"]]
            assert s["parent"] == (holds[-1]["node"] if holds else None) and s["depth"] == (holds[-1]["depth"] + 1 if holds else 0)
            assert s["leaves"] == sum(t["level"] == "token" and t["parent"] == s["node"] for t in every)
