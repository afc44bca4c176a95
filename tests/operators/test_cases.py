"""Small cases with known answers, edges included."""

import math

import pytest
from pyspark.sql import functions as F

from storyspark.functions import scalars
from storyspark.operators import graphs, history, joins, language, metrics, ranking, records, search, steiner, vectors
from storyspark.plans import guard
from storyspark.sources import stores
from storyspark.sources.shared import written
from storyspark.streaming import streams


def notes(spark, rows):
    return spark.createDataFrame(rows, "id string, content string")


def test_search_ranks_the_tightest_match_first(spark):
    docs = notes(
        spark,
        [
            ("doc1", "Mara Holt kept Thorn close. It was folded bronze, thin and keen."),
            ("doc2", "Tam Reed had Anvil, which was folded bronze. Mara watched."),
            ("doc3", "Thorn was small. " + "x " * 300 + "Folded bronze is rare. " + "y " * 300 + "Mara."),
        ],
    )
    got = search.search(docs, 'mara "folded bronze" thorn', 10, ["content"]).collect()
    assert got[0].id == "doc1" and {r.id for r in got} == {"doc1", "doc2", "doc3"}


def test_search_of_short_and_odd_patterns(spark):
    docs = notes(spark, [("doc1", "The C.E.O. arrived."), ("doc2", "Hello world."), ("doc3", None)])
    assert [r.id for r in search.search(docs, "ed", 5, ["content"]).collect()] == ["doc1"]
    assert [r.id for r in search.search(docs, '"C.E.O."', 5, ["content"]).collect()] == ["doc1"]
    assert search.search(docs, "", 5, ["content"]).count() == 0
    assert search.search(docs.limit(0), "ed", 5, ["content"]).count() == 0


def test_coverage_power_separates_full_from_partial_matches(spark):
    docs = notes(spark, [("doc1", "apple banana"), ("doc2", "apple")])

    def ratio(power):
        got = {r.id: r.score for r in search.search(docs, "apple banana", 5, ["content"], search.Settings(coverage_power=power)).collect()}
        return got["doc2"] / got["doc1"]

    assert ratio(0.0) > ratio(3.0)


def test_overlapping_occurrences_are_counted(spark):
    row = notes(spark, [("a", "aaaa")]).select(search.frequency(F.col("content"), "aa").alias("n"), search.segment_mask(F.col("content"), "aa").alias("m")).first()
    assert row.n == 3 and row.m == (1 << 0) | (1 << 8) | (1 << 16)
    assert [c.pattern for c in search.parse('a "b c" d"e')] == ["a", "b c", "d", "e"]


def test_ranking_prefers_the_weighted_field(spark):
    rows = [("hello", "doc1", "title", 5, 1, 1), ("hello", "doc2", "body", 95, 1, 1), ("other", "doc3", "body", 95, 1, 1)]
    postings = spark.createDataFrame(rows, "term string, id string, field string, field_len bigint, tf bigint, mask bigint")
    got = ranking.ranked(ranking.term_scores(postings, ["hello"], weights={"title": 10.0}), 1).orderBy(F.desc("score")).collect()
    assert [r.id for r in got] == ["doc1", "doc2"]
    assert spark.range(1).select(ranking.idf(F.lit(10.0), F.lit(0)).alias("v")).first().v == 0


def test_version_chain_update_and_restore(spark):
    rows = [("n", "first", 10), ("n", "second", 20), ("m", "only", 5)]
    base = history.versions(spark.createDataFrame(rows, "id string, title string, at bigint"), "id", "at").drop("at")
    now = {(r.id, r.version): r for r in base.collect()}
    assert now["n", 1].valid_to == 20 and not now["n", 1].is_current and now["n", 2].is_current
    later = history.revised(base, spark.createDataFrame([("n", 30, "third"), ("zz", 31, "absent")], "id string, at bigint, title string"))
    got = {(r.id, r.version): r for r in later.collect()}
    assert got["n", 3].title == "third" and got["n", 2].valid_to == 30 and len(got) == 4
    back = {(r.id, r.version): r for r in history.restored(later, "id", "n", 1, 40).collect()}
    assert back["n", 4].title == "first" and back["n", 4].is_current and not back["n", 3].is_current
    assert [r.title for r in joins.as_of(base, "id", F.lit(15)).where("id = 'n'").collect()] == ["first"]


def test_band_pairs_and_overlaps(spark):
    rows = spark.createDataFrame([("k", i, p) for i, p in enumerate([0, 1, 5, 6, 40])], "k string, x int, p int")
    got = {(r.a, r.b) for r in joins.band_pairs(rows, ["k"], "x", "p", 3).collect()}
    assert got == {(0, 1), (2, 3)}
    left = spark.createDataFrame([(1, 0, 5), (2, 10, 300), (3, 400, 401)], "id int, s int, e int").withColumn("k", F.lit(1))
    right = spark.createDataFrame([(250, 260), (5, 6)], "s int, e int").withColumn("k", F.lit(1))
    assert {r.id for r in joins.overlapping(left, right, ["k"], "s", "e", "left_semi").collect()} == {2}
    assert {r.id for r in joins.overlapping(left, right.limit(0), ["k"], "s", "e", "left_anti").collect()} == {1, 2, 3}


def test_graphs(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0), ("x", "y", 1.0), ("y", "x", 1.0)], "source_id string, target_id string, cost double")
    assert {r.node: r.component for r in graphs.components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert {r.node: r.distance for r in graphs.distances(edges, "a", 5).collect()} == {"a": 0.0, "b": 1.0, "c": 2.0}
    links = edges.select(F.col("source_id").alias("parent"), F.col("target_id").alias("child"))
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.depth for r in graphs.expand(seeds, links, 6).collect()} == {"a": 0, "b": 1, "c": 1}
    assert graphs.components(edges.limit(0)).count() == 0
    both = spark.createDataFrame([("s", "knows", "t", 0.5, "scanner", 1), ("s", "KNOWS", "t", 0.5, "llm", 2), ("s", "likes", "t", 0.2, "manual", 1)], "source_id string, rel_type string, target_id string, confidence double, origin string, note_id int")
    got = {r.rel_type: r for r in graphs.merged(both).collect()}
    assert got["KNOWS"].confidence == pytest.approx(0.75) and got["LIKES"].confidence == 1.0 and got["KNOWS"].notes == 2


def solved(spark, edges, prizes, root=None):
    e = spark.createDataFrame(edges, "source string, target string, cost double")
    p = spark.createDataFrame(list(prizes.items()), "id string, prize double")
    return {x for r in steiner.steiner(e, p, root).collect() for x in (r.source, r.target)}


def test_steiner_trees(spark):
    assert solved(spark, [], {"n0": 10.0}) == set()
    path = [("n0", "n1", 1.0), ("n1", "n2", 1.0)]
    assert solved(spark, path, {"n0": 10.0, "n1": 1.0, "n2": 10.0}) == {"n0", "n1", "n2"}
    star = [("center", f"l{i}", 1.0) for i in range(1, 5)]
    assert not solved(spark, star, {"center": 100.0} | {f"l{i}": 0.5 for i in range(1, 5)}, "center") & {f"l{i}" for i in range(1, 5)}
    two = [*path, ("n3", "n4", 10.0), ("n4", "n5", 10.0)]
    assert solved(spark, two, {"n0": 10.0, "n1": 10.0, "n2": 10.0, "n3": 0.1, "n4": 0.1, "n5": 0.1}) == {"n0", "n1", "n2"}


def test_phrases_events_and_markup(spark):
    got = [(p["kind"], p["head"]) for p in language.phrases("The old wizard attacked the dark tower with a sword.")]
    assert got == [("NP", "wizard"), ("VP", "attacked"), ("NP", "tower"), ("PP", "with")]
    assert language.tagged(["She", "can", "attack", "the", "attack"]) == "RMVDN"
    event = language.events_of("The knight will kill a dragon.")[0]
    assert (event["subject"], event["relation"], event["object"]) == ("knight", "KILLS", "dragon")
    assert language.events_of("") == [] and language.phrases("...") == []
    docs = notes(spark, [("a", "[[Page|label]] #tag/x @you &#38; [CHARACTER|Mara] -[KNOWS]-> [PLACE:Town]"), ("b", None)])
    assert [(r.kind, r.value) for r in language.markup(docs, "content").orderBy("place").collect()] == [
        ("wikilink", "[[Page|label]]"), ("tag", "#tag/x"), ("mention", "@you"), ("triple", "[CHARACTER|Mara] -[KNOWS]-> [PLACE:Town]"),
    ]


def test_names(spark):
    row = spark.createDataFrame([("Mara T. Holt", "CHARACTER"), ("The Red Sail Pirates", "FACTION"), ("Long Shore", "PLACE"), ("Tam", "CHARACTER")], "label string, kind string")
    got = {r.label: r.a for r in row.select("label", language.auto_aliases("label", F.col("kind")).alias("a")).collect()}
    assert got["Mara T. Holt"] == ["holt", "mara holt", "mara"] and got["The Red Sail Pirates"] == ["rsp", "red sail"]
    assert got["Long Shore"] == ["long"] and got["Tam"] == []
    assert spark.range(1).select(language.name_key(F.lit("“Mara’s,”")).alias("k")).first().k == "mara"


def test_flow(spark):
    rows = [("d", 0, ["e1", "e2"]), ("d", 1, ["e2", "e3"]), ("x", 0, ["a"]), ("x", 1, ["b"])]
    got = {r.d: r.flow for r in language.continuity(spark.createDataFrame(rows, "d string, i int, e array<string>"), "d", "i", "e").collect()}
    assert got["d"] == 100 and got["x"] == pytest.approx((100 + math.floor(0.7 * 50 + 30)) / 2)


def test_metrics_of_nothing_and_of_a_sentence(spark):
    got = {r.id: r for r in metrics.text_metrics(notes(spark, [("a", None), ("b", "One two. Three four five!\n\nSix")]), "content").collect()}
    assert (got["a"].words, got["a"].sentences, got["a"].reading_level, got["a"].flow) == (0, 0, "N/A", 0)
    assert (got["b"].words, got["b"].sentences, got["b"].paragraphs) == (6, 3, 2)


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0])], "id int, vec array<double>")
    got = [(r.id, r.distance) for r in vectors.nearest(df, [1.0, 0.0], 4).collect()]
    assert got[0] == (1, 0.0) and got[1:] == [(2, 1.0), (3, 1.0), (4, 1.0)]
    like = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.7, 0.7])], "id int, vec array<double>")
    assert [r.id for r in vectors.diverse(like, [1.0, 0.1], 2).orderBy("place").collect()] == [2, 3]
    assert vectors.diverse(like.limit(0), [1.0, 0.1], 2).count() == 0
    chunks = vectors.chunks(notes(spark, [("a", "x. " * 500), ("b", ""), ("c", None)]), "content").collect()
    assert {r.id for r in chunks} == {"a"} and max(len(r.chunk) for r in chunks) <= 1024
    assert "".join(r.chunk for r in sorted(chunks, key=lambda r: r.place)).count("x") == 500


def test_hashes(spark):
    row = spark.createDataFrame([("hello",)], "t string").select(scalars.djb2("t").alias("a"), scalars.hash31("t").alias("b")).first()
    assert (row.a, row.b) == ("f923099", 99162322)


def test_growth(spark):
    row = spark.range(1).select(*[scalars.scaled_stat(F.lit(100.0), F.lit(x)).alias(f"l{x}") for x in (1, 2, 20, 60, 100)]).first()
    assert row.l1 == 100 and 300 < row.l20 < 500 and 600 < row.l60 < 800 and 800 < row.l100 < 1000


def test_guard(spark):
    assert guard.check_read(spark, "SELECT 1 AS x LIMIT 1").valid and not guard.check_read(spark, "SELECT 1 AS x").valid
    with pytest.raises(PermissionError):
        guard.run_read(spark, "DROP TABLE x")
    with pytest.raises(PermissionError):
        guard.run_write(spark, "INSERT INTO notes VALUES (1)")
    rows, cut = guard.run_read(spark, "SELECT id FROM range(100) ORDER BY id LIMIT 50", caps=guard.Caps(rows=10, seconds=600))
    assert len(rows) == 10 and cut


def test_stores_round_trip(spark, tmp_path):
    docs = notes(spark, [("a", "x"), ("b", None), ("c", "x")])
    stores.export_json({"notes": docs}, f"{tmp_path}/d")
    assert sorted(map(tuple, stores.import_json(spark, f"{tmp_path}/d", {"notes": docs.schema})["notes"].collect())) == [("a", "x"), ("b", None), ("c", "x")]
    assert stores.blobs(docs.where("content IS NOT NULL"), "content").count() == 1
    log = spark.createDataFrame([("a", "new", 1, "put"), ("c", None, 2, "delete"), ("d", "add", 3, "put")], "id string, content string, seq bigint, op string")
    assert {r.id: r.content for r in stores.merged_log(docs, log, "id").collect()} == {"a": "new", "b": None, "d": "add"}
    assert written(docs.limit(0), "none").count() == 0


def test_records(spark):
    rows = spark.createDataFrame([(1, "k1", 1.0), (2, "k1", 1.0), (3, "k2", None)], "id int, k string, v double")
    assert {r.id for r in records.best_per_key(rows, ["k"], F.desc("v"), "id").collect()} == {1, 3}
    got = records.capped(rows, ["id"], 2, 1000, F.col("k")).collect()
    assert len(got) == 2 and all(r.truncated for r in got)
    assert records.capped(rows.limit(0), ["id"], 2, 1000, F.col("k")).count() == 0


def test_closed_sessions_of_a_stream_equal_the_batch(spark, tmp_path):
    events = spark.createDataFrame(
        [(i, f"2024-01-01 00:{m:02d}:00", u, "click", 1.0, "{}") for i, (u, m) in enumerate([(1, 0), (1, 10), (1, 59), (2, 5), (2, 6)])],
        "event_id bigint, ts string, user_id bigint, event_type string, value double, props string",
    ).withColumn("ts", F.to_timestamp_ntz("ts"))
    events.coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = streams.event_stream(spark, f"{tmp_path}/e", "part-*.parquet")
    got = {(r.user_id, r.events) for r in streams.run(streams.sessions(stream), "complete", "s").collect()}
    assert got == {(1, 2), (1, 1), (2, 2)}


def test_pairs_of_few_rows_are_those_of_bands_and_joins(spark):
    rows = [("a", "x", 1), ("a", "y", 1), ("a", "z", 2), ("a", "x", 3), ("a", "x", 1), ("a", None, 2), ("b", "y", 9), ("b", "w", None), (None, "x", 1), (None, "y", 1), ("c", "q", 5), ("c", "p", 6)]
    df = spark.createDataFrame(rows, "k string, x string, p int")
    few = joins.few_pairs(df, ["k"], "x", "p", 2)
    assert sorted(map(tuple, few.collect())) == sorted((r.k, r.a, r.b) for r in joins.band_pairs(df, ["k"], "x", "p", 2).collect())
    equal = joins.equal_pairs(df, ["k"], "x")
    assert sorted(map(tuple, equal.collect())) == [("a", "x", "y"), ("a", "x", "z"), ("a", "y", "z"), ("b", "w", "y"), ("c", "p", "q")]
    for made in (few, equal):  # the rows meet no copy of themselves
        assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
