"""Registered sources and sinks, query guard and exploration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking
from ..sources import stores as op
from ..sources.shared import new_place
from . import guard
from .registry import query


def place(m, name):
    return new_place(m.spark, name)


def dumped(m, *names):
    """Tables written as JSON and read back."""
    tables = {n: getattr(m, n) for n in names}
    op.export_json(tables, folder := place(m, "dump"))
    return op.import_json(m.spark, folder, {n: t.schema for n, t in tables.items()})


query("src_export", lambda m: dumped(m, "folders")["folders"].select("id", "name", "parent_id"), "SELECT id, name, parent_id FROM folders")
query("src_import", lambda m: dumped(m, "entities", "edges")["edges"].select("id", "weight", "confidence"), "SELECT id, weight, confidence FROM edges")
query("src_docstore", lambda m: m.notes.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")), "SELECT count(*) AS n, count(DISTINCT id) AS ids FROM notes")
query("src_docstore_upsert", lambda m: m.notes.select("id", "version").where("id <> 3").unionByName(m.spark.createDataFrame([(3, 9)], "id bigint, version int")), "SELECT id, version FROM notes WHERE id <> 3 UNION ALL SELECT 3, 9")


def scripted(m):
    m.entities.createOrReplaceTempView("script_entities")
    return op.run_script(m.spark, "SELECT id, label FROM script_entities WHERE kind = :kind AND mentions > :least", {"kind": "PROMO", "least": 30})


query("src_graphdb_run", scripted, "SELECT id, label FROM entities WHERE kind = 'PROMO' AND mentions > 30")
query("src_graphdb_export", lambda m: dumped(m, "aliases")["aliases"], "SELECT entity_id, alias FROM aliases")
query("src_graphdb_import", lambda m: dumped(m, "networks")["networks"], "SELECT * FROM networks")


def logged(m):
    """Every third order is deleted and every fifth re-priced by a log."""
    snapshot = m.orders.select(F.col("o_orderkey").alias("id"), "o_totalprice")
    log = snapshot.where("id % 3 = 0 OR id % 5 = 0").select("id", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "delete").otherwise("put").alias("op"))
    return snapshot, log


LOGGED = "SELECT o_orderkey AS id, round(CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END, 2) AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0"
query("src_snapshot_wal", lambda m: op.compact(*logged(m), "id", place(m, "compact")).withColumn("o_totalprice", F.round("o_totalprice", 2)), LOGGED)
query("src_wal_op", lambda m: op.merged_log(*logged(m), "id").withColumn("o_totalprice", F.round("o_totalprice", 2)), LOGGED)
query("src_blob_store", lambda m: op.blobs(m.notes, "content").select("blob_id", F.col("size").cast("bigint").alias("size")), "SELECT sha256(content) AS blob_id, any_value(strlen(content)) AS size FROM notes GROUP BY content")
query("src_object_graph", lambda m: op.object_graph(m.notes, "id", "content", ["title", "folder_id"])["properties"], "SELECT CAST(id AS VARCHAR) AS object_id, 'title' AS key, title AS value FROM notes UNION ALL SELECT CAST(id AS VARCHAR), 'folder_id', folder_id FROM notes")
query("src_hydrate_graph", lambda m: op.object_graph(m.notes, "id", "content", ["title"])["objects"].groupBy("blob_id").agg(F.count(F.lit(1)).alias("n")), "SELECT sha256(content) AS blob_id, count(*) AS n FROM notes GROUP BY content")
query("src_registry_json", lambda m: m.entities.select("id", F.to_json(F.struct("label", "kind")).alias("j")).select("id", F.get_json_object("j", "$.label").alias("label")), "SELECT id, label FROM entities")
query("src_rel_registry_json", lambda m: m.edges.select("id", F.to_json(F.struct("rel_type", "weight")).alias("j")).select("id", F.get_json_object("j", "$.weight").cast("bigint").alias("weight")), "SELECT id, weight FROM edges")
query("src_thread_export", lambda m: op.thread_json(m.messages).select("thread_id", F.json_array_length("json").alias("n"), F.get_json_object("json", "$[0].role").alias("first")), "SELECT thread_id, CAST(count(*) AS INT) AS n, arg_min(role, created_at) AS first FROM messages GROUP BY thread_id")


def answers(m):
    """Model answers in four states: fenced, bare array, broken, whole; made of entities."""
    item = F.concat(F.lit('{"label": " '), "label", F.lit('", "kind": "'), F.when(F.col("mentions") % 2 == 0, "character").otherwise("nonsense"), F.lit('", "confidence": 0.5}'))
    n = F.col("mentions") % 4
    whole = F.concat(F.lit('{"entities": ['), item, F.lit("]}"))
    raw = F.when(n == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(n == 1, F.concat(F.lit("["), item, F.lit("]"))).when(n == 2, F.concat(F.lit('{"entities": ['), item, F.lit(', {"label": "cut'))).otherwise(whole)
    return m.entities.select("id", raw.alias("raw"))


query("src_llm_json", lambda m: op.extracted(answers(m), "raw"), "SELECT id, label, 'CHARACTER' AS kind, CAST(0.5 AS DOUBLE) AS confidence FROM entities WHERE mentions % 2 = 0")
query("src_llm_filter", lambda m: op.extracted(m.entities.select("id", F.concat(F.lit('[{"label": "'), "label", F.lit('", "kind": "Item"}, {"label": " ", "kind": "item"}]')).alias("raw")), "raw"), "SELECT id, label, 'ITEM' AS kind, CAST(0.8 AS DOUBLE) AS confidence FROM entities")
query("src_slim_graph", lambda m: m.edges.select(F.col("source_id").alias("s"), F.col("target_id").alias("t"), F.col("rel_type").alias("r")), "SELECT source_id AS s, target_id AS t, rel_type AS r FROM edges")
query("src_force_graph", lambda m: op.force_graph(m.entities, m.edges)[0].select("id", F.round("size", 6).alias("size")), "SELECT id, round(greatest(1.0, ln(mentions + 1) * 3), 6) AS size FROM entities")


def frozen(m):
    rows = ranking.index(m.messages, {"body": ranking.tokens("content")}).select("term", "id", "tf")
    return op.frozen_postings(rows, place(m, "terms"))


POST = "SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(list_filter(string_split(regexp_replace(lower(content), '[^0-9a-z_]+', ' ', 'g'), ' '), lambda x: x <> '')) AS term FROM messages) GROUP BY ALL"
query("src_fst_index", lambda m: frozen(m).groupBy("term").agg(F.count(F.lit(1)).alias("n")), f"SELECT term, count(*) AS n FROM ({POST}) GROUP BY term")
query("src_fst_iter", lambda m: op.term_range(frozen(m), "tha", "thb"), f"SELECT * FROM ({POST}) WHERE term >= 'tha' AND term < 'thb'")
query("src_fst_automaton", lambda m: op.term_like(frozen(m), "th.+tion"), f"SELECT * FROM ({POST}) WHERE regexp_full_match(term, 'th.+tion')")
query("src_fst_fuzzy", lambda m: op.term_like(frozen(m), near=("thing", 1)).select("term").distinct(), f"SELECT DISTINCT term FROM ({POST}) WHERE levenshtein(term, 'thing') <= 1")
query("src_fst_merge", lambda m: op.merged_terms([m.messages.where(F.col("role") == r).select(F.col("thread_id").alias("term"), "created_at") .groupBy("term").agg(F.max("created_at").alias("value")) for r in ("user", "assistant")], "sum"),
    "SELECT term, CAST(sum(value) AS BIGINT) AS value FROM (SELECT thread_id AS term, max(created_at) AS value FROM messages WHERE role IN ('user', 'assistant') GROUP BY thread_id, role) GROUP BY term")

STATEMENTS = [
    "SELECT id FROM t LIMIT 5", "SELECT id FROM t", "INSERT INTO ws_node VALUES (1)", "INSERT INTO entities VALUES (1)", "DELETE FROM ws_edge WHERE id = 1",
    "DROP TABLE ws_node", "CREATE TABLE x (id INT)", "UPDATE notes SET a = 1", "SELECT 'DELETE FROM notes' AS x LIMIT 1", "not a statement",
]


def verdicts(m, check):
    rows = [(s, (v := check(m.spark, s)).valid, v.lane) for s in STATEMENTS]
    return m.spark.createDataFrame(rows, "statement string, valid boolean, lane string")


def expected(*valid):
    rows = ", ".join(f"('{s.replace(chr(39), chr(39) * 2)}', {str(v).lower()}, '{lane}')" for s, (v, lane) in zip(STATEMENTS, valid, strict=True))
    return f"SELECT * FROM (VALUES {rows}) v(statement, valid, lane)"


NO, YES = (False, "read"), (True, "read")
query("guard_ro", lambda m: verdicts(m, guard.check_read), expected(YES, NO, NO, NO, NO, NO, NO, NO, YES, NO))
BAD, OK = (False, "write"), (True, "write")
query("guard_ws", lambda m: verdicts(m, guard.check_write), expected(YES, YES, OK, BAD, OK, BAD, BAD, BAD, YES, BAD))
query("guard_auto", lambda m: verdicts(m, guard.check), expected(YES, NO, OK, BAD, OK, BAD, BAD, BAD, YES, NO))
query("guard_targets", lambda m: m.spark.createDataFrame([(s, ",".join(guard.targets(m.spark, s))) for s in STATEMENTS[:9]], "statement string, targets string").where("targets <> ''"), "SELECT * FROM (VALUES ('INSERT INTO ws_node VALUES (1)', 'ws_node'), ('INSERT INTO entities VALUES (1)', 'entities'), ('DELETE FROM ws_edge WHERE id = 1', 'ws_edge'), ('UPDATE notes SET a = 1', 'notes')) v(statement, targets)")


def read(m):
    m.entities.createOrReplaceTempView("guarded")
    rows, cut = guard.run_read(m.spark, "SELECT id, mentions FROM guarded ORDER BY id LIMIT 40", caps=guard.Caps(rows=25, seconds=600))
    return m.spark.createDataFrame([(r.id, r.mentions, cut) for r in rows], "id string, mentions int, cut boolean")


query("guard_run_ro", read, "SELECT id, mentions, true AS cut FROM entities ORDER BY id LIMIT 25")
query("loop_eval", lambda m: m.episodes.select("id", guard.judged(F.col("action") != "error", F.col("id") % 3, F.col("id") % 5, F.lit(3)).alias("v")).select("id", "v.complete", "v.recurse", "v.confidence"),
    "SELECT id, NOT (action = 'error' AND id % 5 < 3) AS complete, action = 'error' AND id % 5 < 3 AS recurse, CAST(CASE WHEN action <> 'error' AND id % 3 = 0 THEN 0.5 WHEN action <> 'error' THEN 0.8 WHEN id % 5 < 3 THEN 0.4 ELSE 0.3 END AS DOUBLE) AS confidence FROM episodes")
query("loop_plan", lambda m: m.spark.createDataFrame([(e, b, s) for e in (0, 2) for b in (0, 3) for s in guard.planned(e, b)], "entities int, blocks int, step string"),
    "SELECT * FROM (VALUES (2, 0, 'expand neighborhood'), (0, 3, 'extract claims'), (2, 3, 'expand neighborhood'), (2, 3, 'extract claims')) v(entities, blocks, step)")


def looped(m):
    found = guard.explore(lambda: (m.entities.where("kind = 'PROMO'").count(), m.blocks.where("note_id = 5").count()), lambda d: m.edges.where("source_id = 'p5'").count(), lambda d: m.blocks.where("note_id = 5").count())
    return m.spark.createDataFrame(found, "depth int, step string, n int")


query("loop_run", looped, "SELECT 0 AS depth, 'expand neighborhood' AS step, CAST(count(*) AS INT) AS n FROM edges WHERE source_id = 'p5' UNION ALL SELECT 0, 'extract claims', CAST(count(*) AS INT) FROM blocks WHERE note_id = 5")
