"""Registered point and list queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as op
from .registry import query

NOTE = ("id", "version", "title", "folder_id", "narrative_id")
N = "id, version, title, folder_id, narrative_id"


def point(name, table, columns, where, **equal):
    query(name, lambda m: op.matching(getattr(m, table), **equal).select(*columns.split(", ")), f"SELECT {columns} FROM {table} WHERE {where}")


def listed(name, table, columns, where, order, limit=None, **equal):
    """Rows in order; with a limit the order ends in a unique column."""
    def build(m):
        keys = [F.desc(o.removesuffix(" desc")) if o.endswith(" desc") else F.asc(o) for o in order.split(", ")]
        return op.listing(getattr(m, table), *keys, limit=limit, **equal).select(*columns.split(", "))

    sql = f"SELECT {columns} FROM {table} WHERE {where}" + (f" ORDER BY {order} LIMIT {limit}" if limit else "")
    query(name, build, sql)


point("note_get", "notes", N + ", content", "id = 7", id=7)
listed("note_list", "notes", N + ", ord", "folder_id = 'src3'", "ord", folder_id="src3")
query("note_count", lambda m: m.notes.agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM notes")
query(
    "note_find_title",
    lambda m: op.title_match(m.notes.where("world_id = 'w1'"), "the ").select(*NOTE),
    f"""SELECT {N} FROM notes WHERE world_id = 'w1' AND contains(lower(title), 'the ')
        AND (lower(title) = 'the ' OR NOT EXISTS (SELECT 1 FROM notes WHERE world_id = 'w1' AND lower(title) = 'the '))""",
)
listed("note_list_world", "notes", N + ", created_at", "world_id = 'w2'", "created_at desc", world_id="w2")
listed("note_list_folder", "notes", N + ", created_at", "folder_id = 'src1'", "created_at desc", folder_id="src1")

E_ = "id, label, kind, subtype, mentions, narrative_id"
point("entity_get", "entities", E_, "id = 'p11'", id="p11")
query(
    "entity_by_label",
    lambda m: op.by_label(m.entities, "SMALL ring 0").select(*E_.split(", ")),
    f"SELECT {E_} FROM entities WHERE lower(label) = lower('SMALL ring 0')",
)
query(
    "entity_by_label_alias",
    lambda m: op.by_label_or_alias(m.entities, m.aliases, "brand#17 1").select(*E_.split(", ")),
    f"""SELECT {E_} FROM entities e WHERE lower(label) = 'brand#17 1' OR (NOT EXISTS (SELECT 1 FROM entities WHERE lower(label) = 'brand#17 1')
        AND EXISTS (SELECT 1 FROM aliases a WHERE a.entity_id = e.id AND lower(alias) = 'brand#17 1'))""",
)
query(
    "entity_exists",
    lambda m: m.aliases.select("entity_id", "alias").join(
        m.entities.select(F.lower("label").alias("known")).union(m.aliases.where("entity_id <> 'p3'").select(F.lower("alias"))).distinct(),
        F.lower("alias") == F.col("known"),
        "left_semi",
    ),
    """SELECT entity_id, alias FROM aliases WHERE lower(alias) IN (SELECT lower(label) FROM entities)
       OR lower(alias) IN (SELECT lower(alias) FROM aliases WHERE entity_id <> 'p3')""",
)
listed("entity_list", "entities", E_, "kind = 'PROMO'", "label", kind="PROMO")
query(
    "entity_list_filtered",
    lambda m: op.matching(m.entities, F.col("mentions") >= 20, kind="SMALL", narrative_id="nar2").select(*E_.split(", ")),
    f"SELECT {E_} FROM entities WHERE kind = 'SMALL' AND mentions >= 20 AND narrative_id = 'nar2'",
)
query(
    "entity_search",
    lambda m: op.scored_search(m.entities, m.aliases, "red w").select(*E_.split(", ")),
    f"SELECT {E_} FROM entities e WHERE contains(lower(label), 'red w') OR EXISTS (SELECT 1 FROM aliases a WHERE a.entity_id = e.id AND contains(lower(alias), 'red w'))",
)
query(
    "entity_search_scored",
    lambda m: op.scored_search(m.entities, m.aliases, "brand#1").orderBy(F.desc("score"), "id").select("id", "label", "score"),
    """SELECT id, label, CAST(CASE WHEN lower(label) = 'brand#1' THEN 1.0 WHEN same THEN 0.9 WHEN contains(lower(label), 'brand#1') THEN 0.7 ELSE 0.5 END AS DOUBLE) AS score
       FROM entities LEFT JOIN (SELECT entity_id, bool_or(lower(alias) = 'brand#1') AS same FROM aliases WHERE contains(lower(alias), 'brand#1') GROUP BY entity_id) a ON a.entity_id = id
       WHERE contains(lower(label), 'brand#1') OR same IS NOT NULL""",
)
listed("entity_by_narrative", "entities", E_, "narrative_id = 'nar3'", "mentions desc, id", limit=50, narrative_id="nar3")
query("entity_filter_narrative", lambda m: op.visible_in(m.entities, None).select(*E_.split(", ")), f"SELECT {E_} FROM entities WHERE narrative_id IS NULL")
query(
    "entity_can_reference",
    lambda m: m.edges.join(m.entities.select(F.col("id").alias("source_id"), F.col("narrative_id").alias("a")), "source_id")
    .join(m.entities.select(F.col("id").alias("target_id"), F.col("narrative_id").alias("b")), "target_id")
    .select("id", F.col("a").eqNullSafe(F.col("b")).alias("allowed")),
    """SELECT e.id, a.narrative_id IS NOT DISTINCT FROM b.narrative_id AS allowed FROM edges e
       JOIN entities a ON a.id = e.source_id JOIN entities b ON b.id = e.target_id""",
)

G = "id, source_id, target_id, rel_type, confidence, weight"
point("edge_get", "edges", G, "id = 'p531|NF|p10'", id="p531|NF|p10")
query(
    "edge_for_entity",
    lambda m: op.matching(m.edges, (F.col("source_id") == "p40") | (F.col("target_id") == "p40")).select(*G.split(", ")),
    f"SELECT {G} FROM edges WHERE source_id = 'p40' OR target_id = 'p40'",
)
point("edge_find", "edges", G, "source_id = 'p8' AND target_id = 'p100' AND rel_type = 'RF'", source_id="p8", target_id="p100", rel_type="RF")
point("edge_by_source", "edges", G, "source_id = 'p12'", source_id="p12")
point("edge_by_target", "edges", G, "target_id = 'p12'", target_id="p12")
point("edge_by_type", "edges", G, "rel_type = 'RF'", rel_type="RF")
query(
    "edge_query",
    lambda m: op.listing(
        op.matching(m.edges, F.col("confidence") >= 0.95, rel_type=["AF", "RF"]).join(
            m.provenance.where("origin = 'manual'").select(F.col("rel_id").alias("id")).distinct(), "id", "left_semi"
        ),
        F.desc("confidence"),
        "id",
        offset=5,
        limit=40,
    ).select(*G.split(", ")),
    f"""SELECT {G} FROM edges WHERE confidence >= 0.95 AND rel_type IN ('AF', 'RF') AND id IN (SELECT rel_id FROM provenance WHERE origin = 'manual')
        ORDER BY confidence DESC, id LIMIT 40 OFFSET 5""",
)
point("folder_get", "folders", "id, name, parent_id, world_id", "id = 'n7'", id="n7")
listed("folder_list", "folders", "id, name, parent_id, ord", "parent_id = 'r2'", "ord", parent_id="r2")
query(
    "folder_meta",
    lambda m: op.json_has(m.folders.where("world_id = 'w0'"), "meta", "$.segment").orderBy("id").limit(30).select("id", "name"),
    "SELECT id, name FROM folders WHERE world_id = 'w0' AND json_extract_string(meta, '$.segment') IS NOT NULL ORDER BY id LIMIT 30",
)
listed("thread_list", "threads", "id, world_id, narrative_id, updated_at", "world_id = 'w1'", "updated_at desc", world_id="w1")
listed("thread_messages", "messages", "id, role, content, created_at", "thread_id = 't3'", "created_at", thread_id="t3")
listed("memory_by_type", "memories", "id, content, created_at", "memory_type = 'fact'", "created_at desc", memory_type="fact")
query(
    "memory_om_get",
    lambda m: op.best_per_key(m.om_generations.where("thread_id = 't9'"), ["thread_id"], F.desc("generation"), F.desc("id")).select("thread_id", "id", "generation", "output_tokens"),
    "SELECT thread_id, id, generation, output_tokens FROM om_generations WHERE thread_id = 't9' ORDER BY generation DESC, id DESC LIMIT 1",
)
listed("memory_om_generations", "om_generations", "thread_id, id, generation, input_tokens", "thread_id = 't4'", "generation", thread_id="t4")
A = "key, thread_id, narrative_id, folder_id, kind, payload, created_at, updated_at"
point("artifact_get", "artifacts", A, "thread_id = 't4' AND narrative_id = 'nar4' AND folder_id = '5-LOW' AND key = 'k7'", thread_id="t4", narrative_id="nar4", folder_id="5-LOW", key="k7")
listed("artifact_list", "artifacts", A, "thread_id = 't6' AND narrative_id = 'nar1' AND folder_id = '2-HIGH'", "updated_at desc", thread_id="t6", narrative_id="nar1", folder_id="2-HIGH")
listed("block_by_note", "blocks", "id, note_id, ord, narrative_id", "note_id = 42", "ord", note_id=42)
listed("block_by_note_dl", "blocks", "id, ord, label", "note_id = 17 AND narrative_id = 'nar4'", "ord", note_id=17, narrative_id="nar4")
point("ws_get_node", "ws_nodes", "id, kind, json", "id = 'e77'", id="e77")
listed("ws_nodes_by_kind", "ws_nodes", "id, json, created_at", "ws_id = 'u8' AND kind = 'click'", "created_at", ws_id="u8", kind="click")
point("ws_edges_from", "ws_edges", "source_id, target_id, kind", "source_id = 'e50'", source_id="e50")
point("ws_edges_to", "ws_edges", "source_id, target_id, kind", "target_id = 'e128'", target_id="e128")
point("ws_get_view", "ws_nodes", "id, json", "ws_id = 'u42' AND id = 'e5'", ws_id="u42", id="e5")
listed("ws_metrics", "ws_nodes", "id, kind, created_at", "ws_id = 'u8'", "created_at desc", limit=100, ws_id="u8")
query(
    "ws_node_json",
    lambda m: op.json_has(m.ws_nodes.where("ws_id = 'u9'"), "json", "$.k", "72").select("id", "json"),
    "SELECT id, json FROM ws_nodes WHERE ws_id = 'u9' AND json_extract_string(json, '$.k') = '72'",
)
query(
    "vec_get",
    lambda m: m.blocks.where("id = 12").select("id", F.posexplode("vec").alias("i", "x")).select("id", "i", F.round(F.col("x").cast("double"), 5).alias("x")),
    "SELECT id, CAST(i - 1 AS INT) AS i, round(CAST(vec[i] AS DOUBLE), 5) AS x FROM (SELECT id, vec, unnest(range(1, len(vec) + 1)) AS i FROM blocks WHERE id = 12)",
)
query(
    "vec_has",
    lambda m: m.blocks.where("id = 99999999").agg((F.count(F.lit(1)) > 0).alias("found")),
    "SELECT count(*) > 0 AS found FROM blocks WHERE id = 99999999",
)
point("cluster_get", "clusters", "id, name, created_at", "id = 'cl3'", id="cl3")
listed("cluster_members", "cluster_members", "cluster_id, entity_id, vec_id, similarity", "cluster_id = 'cl4'", "similarity desc", cluster_id="cl4")
query(
    "cooc_get",
    lambda m: m.edges.where("source_id = 'p5' AND target_id = 'p40'").agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")),
    "SELECT CAST(coalesce(sum(weight), 0) AS BIGINT) AS weight FROM edges WHERE source_id = 'p5' AND target_id = 'p40'",
)
point("raptor_get", "blocks", "id, label, narrative_id", "id = 31", id=31)
point("raptor_level", "blocks", "id, note_id", "label = 2", label=2)
point("raptor_narrative", "blocks", "id, note_id", "narrative_id = 'nar5'", narrative_id="nar5")
point("net_by_id", "networks", "id, name, kind, root_folder", "id = 'net4'", id="net4")
point("net_by_folder", "networks", "id, name, kind", "root_folder = 'n9'", root_folder="n9")
point("net_by_kind", "networks", "id, name", "kind = 'kind2'", kind="kind2")
point("net_by_namespace", "networks", "id, name", "namespace = 'ns1'", namespace="ns1")
point("net_members", "members", "entity_id, role, joined_at", "network_id = 'net4' AND left_at IS NULL", network_id="net4", left_at=None)
point("net_of_entity", "members", "network_id, role", "entity_id = 'c20' AND left_at IS NULL", entity_id="c20", left_at=None)
point("net_roots", "members", "network_id, entity_id", "network_id = 'net5' AND role = 'root' AND left_at IS NULL", network_id="net5", role="root", left_at=None)
point("net_active", "members", "network_id, entity_id, role", "left_at IS NULL", left_at=None)
point("net_rels", "net_rels", "source_id, target_id, code, strength", "network_id = 'net3'", network_id="net3")
point("net_rels_source", "net_rels", "network_id, target_id, code", "source_id = 's4'", source_id="s4")
point("net_rels_target", "net_rels", "network_id, source_id, code", "target_id = 's4'", target_id="s4")
query(
    "net_between",
    lambda m: m.net_rels.where("(source_id = 's3' AND target_id = 's10') OR (source_id = 's10' AND target_id = 's3')").select("network_id", "source_id", "target_id", "code"),
    "SELECT network_id, source_id, target_id, code FROM net_rels WHERE (source_id = 's3' AND target_id = 's10') OR (source_id = 's10' AND target_id = 's3')",
)
point("net_by_code", "net_rels", "network_id, source_id, target_id", "code = 'code2'", code="code2")
point("net_by_net_code", "net_rels", "source_id, target_id", "network_id = 'net0' AND code = 'code3'", network_id="net0", code="code3")
H = "parent, child, group_id, created_at"
point("hier_children", "hierarchy", H, "parent = 'r1' AND invalid_at IS NULL", parent="r1", invalid_at=None)
point("hier_parent", "hierarchy", H, "child = 'c14' AND invalid_at IS NULL", child="c14", invalid_at=None)
point("hier_all", "hierarchy", H, "invalid_at IS NULL", invalid_at=None)
point("hier_by_group", "hierarchy", H, "group_id = 'narrative:w1' AND invalid_at IS NULL", group_id="narrative:w1", invalid_at=None)
point("meta_get", "metadata", "entity_id, key, value", "entity_id = 'p6'", entity_id="p6")
query(
    "meta_record",
    lambda m: op.as_record(m.metadata, "entity_id", "key", "value", ["brand", "size", "type"]),
    """SELECT entity_id, max(CASE WHEN key = 'brand' THEN trim(value, '"') END) AS brand, max(CASE WHEN key = 'size' THEN value END) AS size,
       max(CASE WHEN key = 'type' THEN trim(value, '"') END) AS type FROM metadata GROUP BY entity_id""",
)
listed("meta_cards", "metadata", "entity_id, key, value", "entity_id = 'p9'", "key", entity_id="p9")
listed("cal_events", "calendar", "id, y, m, d, name", "calendar_id = 'cal3'", "y, m, d, id", calendar_id="cal3")
query(
    "cal_periods",
    lambda m: m.calendar.where("calendar_id = 'cal2'").groupBy("y", "m").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).orderBy("y", "m"),
    "SELECT y, m, min(id) AS first_id, count(*) AS n FROM calendar WHERE calendar_id = 'cal2' GROUP BY y, m",
)
query(
    "cal_scope_filter",
    lambda m: m.calendar.where((F.col("y") == 2) & (F.col("m") == 5) & F.col("d").between(24, F.least(F.lit(30), F.lit(29)))).select("id", "y", "m", "d"),
    "SELECT id, y, m, d FROM calendar WHERE y = 2 AND m = 5 AND d BETWEEN 24 AND 29",
)
query("tag_list", lambda m: m.note_tags.select("tag").distinct().orderBy("tag"), "SELECT DISTINCT tag FROM note_tags")
point("prov_get", "provenance", "rel_id, origin, note_id, confidence", "rel_id = 'p531|NF|p10'", rel_id="p531|NF|p10")
query(
    "attr_get",
    lambda m: m.metadata.groupBy("entity_id")
    .agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("attributes"))
    .select("entity_id", F.col("attributes")["brand"].alias("brand"), F.map_contains_key("attributes", "type").alias("typed")),
    """SELECT entity_id, max(CASE WHEN key = 'brand' THEN value END) AS brand, bool_or(key = 'type') AS typed FROM metadata GROUP BY entity_id""",
)
