"""Registered temporal queries, mutations, windows and pagination."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import history as op
from ..operators import records
from ..operators.graphs import expand
from ..operators.joins import as_of, as_of_join
from .registry import query

V = ["id", "version", "title", "valid_from", "valid_to", "is_current"]
VS = ", ".join(V)
H = f"SELECT {VS} FROM note_versions"


def history(m):
    return m.note_versions.select(*V)


def df(m, rows, schema):
    return m.spark.createDataFrame(rows, schema)


query("win_latest_version", lambda m: as_of(history(m), "id", F.lit(500_000)), f"SELECT {VS} FROM note_versions n WHERE valid_from <= 500000 AND (valid_to IS NULL OR valid_to > 500000) AND version = (SELECT max(version) FROM note_versions o WHERE o.id = n.id AND valid_from <= 500000 AND (valid_to IS NULL OR valid_to > 500000))")
query(
    "win_version_chain",
    lambda m: op.versions(m.orders.select(F.col("o_custkey").alias("id"), "o_orderkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("at")), "id", "at", "o_orderkey").drop("at"),
    """SELECT o_custkey AS id, o_orderkey, CAST(row_number() OVER w AS INT) AS version, epoch_ms(o_orderdate) AS valid_from, lead(epoch_ms(o_orderdate)) OVER w AS valid_to, lead(o_orderdate) OVER w IS NULL AS is_current
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY epoch_ms(o_orderdate), o_orderkey)""",
)
query("win_versions", lambda m: history(m).where("id = 8").orderBy("version"), H + " WHERE id = 8")
query("win_ema", lambda m: m.episodes.groupBy("scope_id").agg(F.sort_array(F.collect_list(F.struct("ts", "id", "value"))).alias("e")).select("scope_id", F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s * 0.3 + x["value"] * 0.7), 4).alias("v")),
    "SELECT scope_id, round(list_reduce(list_prepend(0.0, list(value ORDER BY ts, id)), lambda s, x: s * 0.3 + x * 0.7), 4) AS v FROM episodes GROUP BY scope_id")
query("win_mention_recency", lambda m: m.episodes.select("id", F.last("target_id").over(Window.partitionBy("scope_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)).alias("previous")), "SELECT id, lag(target_id) OVER (PARTITION BY scope_id ORDER BY ts, id) AS previous FROM episodes")
query("win_numbering", lambda m: m.chapters.select("id", F.sum(F.lit(1)).over(Window.partitionBy("act").orderBy("rank_no")).alias("no")), "SELECT id, count(*) OVER (PARTITION BY act ORDER BY rank_no) AS no FROM chapters")
query("win_rebalance", lambda m: op.rebalanced(m.notes.select("id", "folder_id", "ord"), ["folder_id"], "ord", "id"), "SELECT id, folder_id, CAST(row_number() OVER (PARTITION BY folder_id ORDER BY ord, id) * 1000 AS INT) AS ord FROM notes")
query("win_gap_check", lambda m: op.crowded(m.notes.select("folder_id", F.col("created_at").alias("o")), ["folder_id"], "o", 3000), "SELECT folder_id, coalesce(min(g) < 3000, false) AS crowded FROM (SELECT folder_id, created_at - lag(created_at) OVER (PARTITION BY folder_id ORDER BY created_at) AS g FROM notes) GROUP BY folder_id")
query("win_midpoint", lambda m: op.midpoints(m.notes.select("id", "folder_id", "ord"), ["folder_id"], "ord", "id").select("id", "between"), "SELECT id, (ord + lead(ord) OVER (PARTITION BY folder_id ORDER BY ord, id)) / 2 AS between FROM notes")
query("srt_episode_topk", lambda m: records.listing(m.episodes, F.desc("ts"), F.desc("id"), limit=30, scope_id="u8").select("id", "ts", "action"), "SELECT id, ts, action FROM episodes WHERE scope_id = 'u8' ORDER BY ts DESC, id DESC LIMIT 30")
query("srt_paginate", lambda m: records.page(m.edges, F.desc("confidence"), "id", offset=40, limit=20).select("id", "confidence"), "SELECT id, confidence FROM edges ORDER BY confidence DESC, id LIMIT 20 OFFSET 40")
query(
    "srt_row_cap",
    lambda m: records.capped(m.notes.select("id", "title"), ["id"], 100, 1500, F.col("title")),
    """SELECT id, title, bool_or(NOT keep) OVER () AS truncated FROM (SELECT id, title, n <= 100 AND bytes <= 1500 AS keep FROM (SELECT id, title, row_number() OVER (ORDER BY id) AS n, sum(strlen(title)) OVER (ORDER BY id) AS bytes FROM notes ORDER BY id LIMIT 101)) QUALIFY keep""",
)

query("tmp_create", lambda m: op.created(history(m), df(m, [(5_000_000, "a new note", 77)], "id bigint, title string, created_at bigint")), H + " UNION ALL SELECT 5000000, 1, 'a new note', 77, NULL, true")
UPDATE = [(8, 90_000_000, "renamed"), (10, 90_000_001, "also")]
query(
    "tmp_update",
    lambda m: op.revised(history(m), df(m, UPDATE, "id bigint, at bigint, title string")).where("id IN (8, 10, 11)"),
    """SELECT id, version, title, valid_from, CASE WHEN is_current AND id = 8 THEN 90000000 WHEN is_current AND id = 10 THEN 90000001 ELSE valid_to END AS valid_to, is_current AND id = 11 AS is_current FROM note_versions WHERE id IN (8, 10, 11)
       UNION ALL SELECT id, version + 1, CASE id WHEN 8 THEN 'renamed' ELSE 'also' END, CASE id WHEN 8 THEN 90000000 ELSE 90000001 END, NULL, true FROM notes WHERE id IN (8, 10)""",
)
query("tmp_upsert", lambda m: op.upserted(m.entities.select("id", "label", "created_at"), df(m, [("p3", "renamed", 10**9), ("new", "added", 5)], "id string, label string, created_at bigint"), ["id"], "created_at"),
    "SELECT id, label, created_at FROM entities WHERE id <> 'p3' UNION ALL VALUES ('p3', 'renamed', 1000000000), ('new', 'added', 5)")
query("tmp_version", lambda m: history(m).where("id = 8 AND version = 2"), H + " WHERE id = 8 AND version = 2")
query(
    "tmp_restore",
    lambda m: op.restored(history(m), "id", 8, 1, 95_000_000).where("id = 8"),
    """SELECT id, version, title, valid_from, CASE WHEN is_current THEN 95000000 ELSE valid_to END AS valid_to, false AS is_current FROM note_versions WHERE id = 8
       UNION ALL SELECT id, (SELECT max(version) + 1 FROM note_versions WHERE id = 8), title, 95000000, NULL, true FROM note_versions WHERE id = 8 AND version = 1""",
)
query("tmp_delete", lambda m: op.deleted(history(m), df(m, [(8,), (9,)], "id bigint"), "id"), H + " WHERE id NOT IN (8, 9)")
query("tmp_soft_delete", lambda m: op.marked(m.hierarchy, (F.col("parent") == "n7") & F.col("invalid_at").isNull(), invalid_at=12345), "SELECT parent, child, created_at, group_id, CASE WHEN parent = 'n7' AND invalid_at IS NULL THEN 12345 ELSE invalid_at END AS invalid_at FROM hierarchy")
query("tmp_leave", lambda m: op.marked(m.members, F.col("entity_id") == "c20", left_at=777).select("network_id", "entity_id", "left_at"), "SELECT network_id, entity_id, CASE WHEN entity_id = 'c20' THEN 777 ELSE left_at END AS left_at FROM members")
query("tmp_role", lambda m: op.marked(m.members, F.col("entity_id").isin("c21", "c22"), role="chief").select("network_id", "entity_id", "role"), "SELECT network_id, entity_id, CASE WHEN entity_id IN ('c21', 'c22') THEN 'chief' ELSE role END AS role FROM members")
T = 1_704_700_000_000
query("tmp_existed", lambda m: op.existed(m.episodes, T, "signup", "error"), f"SELECT target_id, bool_or(ts <= {T} AND action = 'signup') AND NOT bool_or(ts <= {T} AND action = 'error') AS existed FROM episodes GROUP BY target_id")
query("tmp_state_at", lambda m: op.state_at(m.episodes, T), f"SELECT target_id, count(*) AS n, arg_max(action, (ts, id)) AS action, arg_max(payload, (ts, id)) AS payload FROM episodes WHERE ts <= {T} GROUP BY target_id")
query("tmp_timeline", lambda m: records.listing(m.episodes, F.desc("ts"), F.desc("id"), limit=20, target_id="p17").select("id", "ts", "action"), "SELECT id, ts, action FROM episodes WHERE target_id = 'p17' ORDER BY ts DESC, id DESC LIMIT 20")
EP = "id, scope_id, ts, action"
query("ep_log", lambda m: m.episodes.select(*EP.split(", ")).unionByName(df(m, [(10**9, "u1", 5, "click")], "id bigint, scope_id string, ts bigint, action string")), f"SELECT {EP} FROM episodes UNION ALL SELECT 1000000000, 'u1', 5, 'click'")
query("ep_local", lambda m: records.listing(m.episodes, F.desc("ts"), F.desc("id"), limit=50, scope_id="u46").select(*EP.split(", ")), f"SELECT {EP} FROM episodes WHERE scope_id = 'u46' ORDER BY ts DESC, id DESC LIMIT 50")


def scopes(m):
    """A customer's own scope and those of the folders above, each mapped to a user of the same number."""
    up = expand(df(m, [("c14",)], "node string"), m.hierarchy, 5, "child", "parent")
    return up.select(F.concat(F.lit("u"), F.substring("node", 2, 10)).alias("scope_id"))


query("ep_bubble", lambda m: m.episodes.join(scopes(m), "scope_id", "left_semi").orderBy(F.desc("ts"), F.desc("id")).limit(60).select(*EP.split(", ")),
    f"""WITH RECURSIVE walk(node, depth) AS (SELECT 'c14', 0 UNION ALL SELECT h.parent, depth + 1 FROM walk JOIN hierarchy h ON h.child = node WHERE depth < 5)
        SELECT {EP} FROM episodes WHERE scope_id IN (SELECT 'u' || substr(node, 2) FROM walk) ORDER BY ts DESC, id DESC LIMIT 60""")
query("ep_action", lambda m: m.episodes.where("scope_id = 'u8' AND action = 'error'").select(*EP.split(", ")), f"SELECT {EP} FROM episodes WHERE scope_id = 'u8' AND action = 'error'")
query("ep_target", lambda m: m.episodes.where("target_id = 'p44'").select(*EP.split(", ")), f"SELECT {EP} FROM episodes WHERE target_id = 'p44'")
query("ep_range", lambda m: m.episodes.where(F.col("ts").between(T, T + 3_600_000)).select(*EP.split(", ")), f"SELECT {EP} FROM episodes WHERE ts BETWEEN {T} AND {T + 3_600_000}")
query("ep_payload", lambda m: records.json_has(m.episodes, "payload", "$.k", "42").select("id", "payload"), "SELECT id, payload FROM episodes WHERE json_extract_string(payload, '$.k') = '42'")
query(
    "tmp_as_of_events",
    lambda m: as_of_join(m.episodes.select("id", F.col("note_id").alias("note"), (F.col("note_id") * 1000 + 150).alias("at")), m.note_versions.select(F.col("id").alias("note"), "version", "valid_from", "valid_to"), "note", "at").select("id", "version"),
    "SELECT e.id, v.version FROM episodes e LEFT JOIN note_versions v ON v.id = e.note_id AND valid_from <= e.note_id * 1000 + 150 AND (valid_to IS NULL OR valid_to > e.note_id * 1000 + 150)",
)

# mutations: the table after the change
CH = "id string, label string, created_at bigint"


def upsert(name, table, columns, keys, at, rows, schema, sql_rows, where):
    query(name, lambda m: op.upserted(getattr(m, table).select(*columns.split(", ")), df(m, rows, schema), keys, at), f"SELECT {columns} FROM {table} WHERE {where} UNION ALL VALUES {sql_rows}")


upsert("mut_entity", "entities", "id, label, created_at", ["id"], "created_at", [("p4", "x", 10**9)], CH, "('p4', 'x', 1000000000)", "id <> 'p4'")
upsert("mut_edge", "edges", "id, rel_type, created_at", ["id"], "created_at", [("p531|NF|p10", "XX", 10**15)], "id string, rel_type string, created_at bigint", "('p531|NF|p10', 'XX', 1000000000000000)", "id <> 'p531|NF|p10'")
upsert("mut_folder", "folders", "id, name, ord", ["id"], "ord", [("n3", "moved", 10**8)], "id string, name string, ord int", "('n3', 'moved', 100000000)", "id <> 'n3'")
upsert("mut_block", "blocks", "id, note_id, ord", ["id"], "ord", [(7, 1, 10**9)], "id bigint, note_id bigint, ord bigint", "(7, 1, 1000000000)", "id <> 7")
upsert("mut_raptor", "blocks", "id, label, ord", ["id"], "ord", [(9, 99, 10**9), (10**7, 1, 1)], "id bigint, label int, ord bigint", "(9, 99, 1000000000), (10000000, 1, 1)", "id <> 9")
KEY4 = ["thread_id", "narrative_id", "folder_id", "key"]
query(
    "mut_artifact",
    lambda m: records.best_per_key(m.artifacts, KEY4, F.desc("updated_at"), F.desc("created_at")).select(*KEY4, "payload"),
    "SELECT thread_id, narrative_id, folder_id, key, arg_max(payload, (updated_at, created_at)) AS payload FROM artifacts GROUP BY ALL",
)
query("mut_om", lambda m: records.best_per_key(m.om_generations, ["thread_id"], F.desc("generation"), F.desc("id")).select("thread_id", "id", "generation"), "SELECT thread_id, arg_max(id, (generation, id)) AS id, max(generation) AS generation FROM om_generations GROUP BY thread_id")
query("mut_memory", lambda m: m.memories.select("id", "memory_type").unionByName(df(m, [("m-new", "fact")], "id string, memory_type string")).join(m.memory_threads.select(F.col("memory_id").alias("id"), "thread_id").unionByName(df(m, [("m-new", "t1")], "id string, thread_id string")), "id"),
    "SELECT id, memory_type, thread_id FROM memories JOIN memory_threads ON memory_id = id UNION ALL SELECT 'm-new', 'fact', 't1'")
query("mut_message", lambda m: m.messages.select("thread_id", "created_at").unionByName(df(m, [("t3", 10**9)], "thread_id string, created_at bigint")).groupBy("thread_id").agg(F.max("created_at").alias("updated_at"), F.count(F.lit(1)).alias("n")),
    "SELECT thread_id, max(created_at) AS updated_at, count(*) AS n FROM (SELECT thread_id, created_at FROM messages UNION ALL SELECT 't3', 1000000000) GROUP BY thread_id")
query("mut_append_chunk", lambda m: m.messages.groupBy("thread_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("created_at", "content"))), lambda x: x["content"]), "").alias("content")),
    "SELECT thread_id, string_agg(content, '' ORDER BY created_at) AS content FROM messages GROUP BY thread_id")
query("mut_cascade_thread", lambda m: op.deleted(m.messages, df(m, [("t3",), ("t5",)], "thread_id string"), "thread_id").select("id").unionByName(op.deleted(m.memory_threads, df(m, [("t3",), ("t5",)], "thread_id string"), "thread_id").select(F.col("memory_id").alias("id"))),
    "SELECT id FROM messages WHERE thread_id NOT IN ('t3', 't5') UNION ALL SELECT memory_id FROM memory_threads WHERE thread_id NOT IN ('t3', 't5')")
query("mut_cascade_entity", lambda m: op.deleted(m.mentions, df(m, [("p5",)], "entity_id string"), "entity_id").select("entity_id").unionByName(op.deleted(m.aliases, df(m, [("p5",)], "entity_id string"), "entity_id").select("entity_id")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")),
    "SELECT entity_id, count(*) AS n FROM (SELECT entity_id FROM mentions UNION ALL SELECT entity_id FROM aliases) WHERE entity_id <> 'p5' GROUP BY entity_id")
query("mut_note_deleted", lambda m: op.deleted(m.mentions, df(m, [(7,), (8,)], "note_id bigint"), "note_id").groupBy("note_id").agg(F.sum("n").alias("n")), "SELECT note_id, CAST(sum(n) AS BIGINT) AS n FROM mentions WHERE note_id NOT IN (7, 8) GROUP BY note_id")
query("mut_rel_add", lambda m: m.provenance.select("rel_id", "confidence").unionByName(df(m, [("p531|NF|p10", 1.0), ("new", 0.4)], "rel_id string, confidence double")).groupBy("rel_id").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n")),
    "SELECT rel_id, max(confidence) AS confidence, count(*) AS n FROM (SELECT rel_id, confidence FROM provenance UNION ALL VALUES ('p531|NF|p10', 1.0), ('new', 0.4)) GROUP BY rel_id")


def aliases_after(m):
    asked = df(m, [("p1", "Brand#17 1"), ("p1", "Fresh"), ("p9", "fresh")], "entity_id string, alias string")
    new = records.best_per_key(asked.withColumn("a", F.lower("alias")), ["a"], "entity_id").join(m.aliases.select(F.lower("alias").alias("a")), "a", "left_anti")
    return m.aliases.unionByName(new.select("entity_id", "alias"))


query("mut_alias", aliases_after, "SELECT entity_id, alias FROM aliases UNION ALL SELECT * FROM (VALUES ('p1', 'Brand#17 1'), ('p1', 'Fresh')) v(e, a) WHERE lower(a) NOT IN (SELECT lower(alias) FROM aliases)")
query("mut_mentions", lambda m: op.upserted(m.mentions.withColumn("at", F.lit(0)), df(m, [("p5", 3, 42, 1), ("p5", 4, 0, 1)], "entity_id string, note_id bigint, n bigint, at int"), ["entity_id", "note_id"], "at").where("n > 0 AND entity_id = 'p5'").select("note_id", "n"),
    "SELECT note_id, n FROM mentions WHERE entity_id = 'p5' AND note_id NOT IN (3, 4) UNION ALL SELECT 3, 42")
query("mut_persist_scan", lambda m: m.sentence_mentions.where("note_id = 5").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).join(m.part.select(F.col("p_partkey").alias("entity_id"), "p_name"), "entity_id"),
    "SELECT entity_id, count(*) AS n, any_value(p_name) AS p_name FROM sentence_mentions JOIN part ON p_partkey = entity_id WHERE note_id = 5 GROUP BY entity_id")
query("mut_net_stats", lambda m: m.networks.select("id").join(m.members.where("left_at IS NULL").groupBy(F.col("network_id").alias("id")).agg(F.count(F.lit(1)).alias("members")), "id", "left").join(m.net_rels.groupBy(F.col("network_id").alias("id")).agg(F.count(F.lit(1)).alias("rels")), "id", "left").fillna(0),
    "SELECT n.id, coalesce(m, 0) AS members, coalesce(r, 0) AS rels FROM networks n LEFT JOIN (SELECT network_id, count(*) AS m FROM members WHERE left_at IS NULL GROUP BY 1) a ON a.network_id = n.id LEFT JOIN (SELECT network_id, count(*) AS r FROM net_rels GROUP BY 1) b ON b.network_id = n.id")
query("mut_ws_delete", lambda m: op.deleted(m.ws_nodes, df(m, [("u8",)], "ws_id string"), "ws_id").groupBy("ws_id").agg(F.count(F.lit(1)).alias("n")), "SELECT ws_id, count(*) AS n FROM ws_nodes WHERE ws_id <> 'u8' GROUP BY ws_id")
query("mut_ws_node", lambda m: m.ws_nodes.select("id", "kind").unionByName(df(m, [("w1", "claim")], "id string, kind string")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "SELECT kind, count(*) AS n FROM (SELECT kind FROM ws_nodes UNION ALL SELECT 'claim') GROUP BY kind")
query("mut_ws_update", lambda m: m.ws_nodes.where("ws_id = 'u8'").select("id", F.map_concat(F.from_json("json", "map<string,int>"), F.create_map(F.lit("seen"), F.lit(1))).alias("j")).select("id", F.col("j")["k"].alias("k"), F.col("j")["seen"].alias("seen")), "SELECT id, CAST(json_extract_string(json, '$.k') AS INT) AS k, 1 AS seen FROM ws_nodes WHERE ws_id = 'u8'")
query("mut_ws_link", lambda m: m.ws_edges.where("ws_id = 'u8'").select("source_id", "target_id", "kind").unionByName(df(m, [("e0", "e9", "next"), ("e0", "e5", "cites")], "source_id string, target_id string, kind string")).distinct(), "SELECT source_id, target_id, kind FROM ws_edges WHERE ws_id = 'u8' UNION VALUES ('e0', 'e9', 'next'), ('e0', 'e5', 'cites')")
for name, kind, rel in (("mut_ws_result", "result", "produced"), ("mut_ws_task", "task", "spawned")):
    query(
        name,
        lambda m, kind=kind, rel=rel: m.ws_nodes.where("ws_id = 'u8'").select("id", "kind").unionByName(df(m, [("x1", kind)], "id string, kind string")).join(df(m, [("e0", "x1", rel)], "source_id string, id string, rel string"), "id", "left").select("id", "kind", "rel"),
        f"SELECT id, kind, NULL AS rel FROM ws_nodes WHERE ws_id = 'u8' UNION ALL SELECT 'x1', '{kind}', '{rel}'",
    )
