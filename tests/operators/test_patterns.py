"""Span patterns against a plain choice of intervals, and decorations of small texts."""

import random

import pytest

from storyspark.operators import patterns as op


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, t string")


def slow_choice(found):
    kept = []
    for k, (a, b) in enumerate(found):
        if all(b <= found[j][0] or a >= found[j][1] for j in kept):
            kept.append(k)
    return kept


def test_choice_of_intervals():
    rng = random.Random(5)
    for _ in range(300):
        found = [(a := rng.randrange(40), a + rng.randrange(1, 9)) for _ in range(rng.randrange(30))]
        assert op.chosen(found) == slow_choice(found)


def spans(spark, text, book=None):
    rows = op.pattern_spans(frame(spark, text, None, "", "nothing here"), "t", book=book).orderBy("id", "from").collect()
    assert {r["id"] for r in rows} <= {0}
    return [(r["pattern"].split(":")[1], text[r["from"] : r["to"]], {c["name"]: c["value"] for c in r["captures"]}) for r in rows]


def test_triples_win_over_their_entities(spark):
    got = spans(spark, "[CHARACTER|Ann] ->KNOWS-> [PLACE:CITY| Bern ] and [ITEM|Cup|{size: 3}], [KING|Ed->LOVES->Flo], [A|x] (sees) [B|y], [A|p] <-ATE<- [B|q]")
    assert [(p, c) for p, _, c in got] == [
        ("triple", {"subjectKind": "CHARACTER", "subjectLabel": "Ann", "predicate": "KNOWS", "objectKind": "PLACE", "objectSubtype": "CITY", "objectLabel": "Bern"}),
        ("entity", {"entityKind": "ITEM", "label": "Cup", "attributes": "{size: 3}"}),
        ("inline-relationship", {"subjectKind": "KING", "subjectLabel": "Ed", "predicate": "LOVES", "objectLabel": "Flo"}),
        ("triple-paren", {"subjectKind": "A", "subjectLabel": "x", "predicate": "SEES", "objectKind": "B", "objectLabel": "y"}),
        ("triple-backward", {"objectKind": "A", "objectLabel": "p", "predicate": "ATE", "subjectKind": "B", "subjectLabel": "q"}),
    ]


def test_times_tags_and_links(spark):
    got = spans(spark, "Two days LATER @bob met #blue_sky: see [[Old Mill|the mill]] and <<Log>>. The following morning, tomorrow, soon.")
    assert [(p, v) for p, v, _ in got] == [
        ("temporal-relative", "Two days LATER"), ("mention", "@bob"), ("tag", "#blue_sky"), ("wikilink", "[[Old Mill|the mill]]"), ("backlink", "<<Log>>"),
        ("temporal-named", "The following morning"), ("temporal-simple", "tomorrow"), ("temporal-transition", "soon"),
    ]


def test_books_change_what_wins(spark):
    text = "three days later #x1"
    book = op.PatternBook()
    assert [p for p, _, _ in spans(spark, text, book)] == ["temporal-relative", "tag"]
    assert [p for p, _, _ in spans(spark, text, book.toggled("builtin:temporal-relative"))] == ["temporal-transition", "tag"]
    assert [p for p, _, _ in spans(spark, text, book.toggled("builtin:tag", False).toggled("builtin:tag"))] == ["temporal-relative", "tag"]
    raised = book.prioritised("builtin:temporal-transition", 99)
    assert [v for _, v, _ in spans(spark, text, raised)] == ["later", "#x1"]
    own = book.added(op.Pattern("own:days", "own", 61, r"(\w+) days", (("n", 1, "upper"),)))
    assert spans(spark, text, own)[0] == ("days", "three days", {"n": "THREE"})
    assert [p for p, _, _ in spans(spark, text, own.without("own:days"))] == ["temporal-relative", "tag"]
    assert [p.id for p in op.PatternBook().active()][:2] == ["builtin:inline-relationship", "builtin:triple"] and len(op.PatternBook().active()) == 13
    assert spans(spark, text, op.PatternBook(())) == []
    with pytest.raises(ValueError):
        book.added(op.Pattern("own:empty", "own", 1, "x*"))


def decorations(spark, text, order=None):
    rows = op.decorated(frame(spark, text), "t", order=order).orderBy("from").collect()
    return [(r["type"], text[r["from"] : r["to"]], r["source"], r["target"]) for r in rows]


def test_relationships_are_three_spans(spark):
    assert decorations(spark, "[A|x|note] (SAW) [B|y] .. [A|p]  <-HIT<-[B|q]") == [
        ("entity", "[A|x|note]", None, None), ("predicate", "(SAW)", "x", "y"), ("entity", "[B|y]", None, None),
        ("entity", "[A|p]", None, None), ("predicate", "<-HIT<-", "q", "p"), ("entity", "[B|q]", None, None),
    ]
    assert decorations(spark, "[[m]] (OWES) -> <<n>>; [A|x] <-> [[y]]; <<k>> <- [[l]] and [[z]]") == [
        ("relationship", "[[m]] (OWES) -> <<n>>", "m", "n"), ("relationship", "[A|x] <-> [[y]]", "x", "y"), ("relationship", "<<k>> <- [[l]]", "l", "k"), ("entity_ref", "[[z]]", None, "z"),
    ]


def test_marks_first_leaves_no_room_for_relationships(spark):
    assert [x[0] for x in decorations(spark, "[A|x] -> [[y]] <- <<z>>", op.MARKS_FIRST)] == ["entity", "entity_ref", "wikilink"]


def test_resolution_by_label(spark):
    known = spark.createDataFrame([("X ",), ("x",), ("other",)], "label string")
    rows = op.resolved(op.decorated(frame(spark, "[A|x] [[Y]] <<n>> [B|z]"), "t"), known).orderBy("from").collect()
    assert [r["resolved"] for r in rows] == [True, False, True, False]


def test_captures_are_trimmed_of_spaces_only(spark):
    got = spans(spark, "[[ \tmill\n |\u00a0x ]] and # ")
    assert [c for _, _, c in got] == [{"target": "\tmill\n", "displayText": "\u00a0x"}]
