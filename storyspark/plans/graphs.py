"""Registered graph queries and bounded recursion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graphs as op
from .aggregates import UNIFIED, unified
from .registry import query

LIVE = "SELECT parent, child FROM hierarchy WHERE invalid_at IS NULL"


def live(m):
    return m.hierarchy.where("invalid_at IS NULL").select("parent", "child")


def seeds(m, *ids):
    return m.spark.createDataFrame([(i,) for i in ids], "node string")


def closed(start: str, up: str, here: str, depth: int) -> str:
    """Recursive SQL of everything reachable from start along here -> up, with the least depth."""
    return f"""WITH RECURSIVE live AS ({LIVE}), walk(node, depth) AS (SELECT '{start}', 0 UNION ALL SELECT l.{up}, w.depth + 1 FROM walk w JOIN live l ON l.{here} = w.node WHERE w.depth < {depth})
               SELECT node, min(depth) AS depth FROM walk GROUP BY node"""


query("rec_ancestors", lambda m: op.expand(seeds(m, "c14"), live(m), 5, "child", "parent"), closed("c14", "parent", "child", 5))
query("rec_descendants", lambda m: op.expand(seeds(m, "r1"), live(m), 5), closed("r1", "child", "parent", 5))
query(
    "rec_ancestor_names",
    lambda m: op.expand(seeds(m, "c21"), live(m), 20, "child", "parent").join(m.folders.select(F.col("id").alias("node"), "name"), "node"),
    closed("c21", "parent", "child", 20).replace("SELECT node, min(depth) AS depth FROM walk GROUP BY node", "SELECT node, name, min(depth) AS depth FROM walk JOIN folders ON id = node GROUP BY node, name"),
)
query("rec_scope_closure", lambda m: op.expand(seeds(m, "n3", "c9"), live(m), 5, "child", "parent").select("node").distinct(),
    f"""WITH RECURSIVE live AS ({LIVE}), walk(node, depth) AS (SELECT * FROM (VALUES ('n3', 0), ('c9', 0)) UNION ALL SELECT l.parent, w.depth + 1 FROM walk w JOIN live l ON l.child = w.node WHERE w.depth < 5)
        SELECT DISTINCT node FROM walk""")
query(
    "rec_folder_path",
    lambda m: op.paths(m.folders, 3),
    """WITH RECURSIVE walk(id, path) AS (SELECT id, '/' || name FROM folders WHERE parent_id IS NULL UNION ALL SELECT f.id, w.path || '/' || f.name FROM walk w JOIN folders f ON f.parent_id = w.id)
       SELECT id, path FROM walk""",
)
query(
    "rec_subtree_notes",
    lambda m: op.closure_pairs(m.hierarchy, 2).where("ancestor = 'r2'").select("node").join(m.members.select(F.col("entity_id").alias("node"), "network_id"), "node"),
    """SELECT entity_id AS node, network_id FROM members WHERE entity_id IN (SELECT a.child FROM hierarchy a JOIN hierarchy b ON a.parent = b.child WHERE b.parent = 'r2')""",
)
query(
    "rec_tree",
    lambda m: op.paths(m.folders, 3).join(m.folders.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("children")), "id", "left").select("id", "path", F.coalesce("children", F.lit(0)).alias("children")).orderBy("path"),
    """WITH RECURSIVE walk(id, path) AS (SELECT id, '/' || name FROM folders WHERE parent_id IS NULL UNION ALL SELECT f.id, w.path || '/' || f.name FROM walk w JOIN folders f ON f.parent_id = w.id)
       SELECT w.id, path, count(f.id) AS children FROM walk w LEFT JOIN folders f ON f.parent_id = w.id GROUP BY w.id, path""",
)
query(
    "rec_flatten_tree",
    lambda m: op.flattened(m.chapters, "act", "id").select("id", "act_no", "chapter", F.lit(1).alias("level")),
    "SELECT id, dense_rank() OVER (ORDER BY act) AS act_no, row_number() OVER (PARTITION BY act ORDER BY id) AS chapter, 1 AS level FROM chapters",
)


def around(m):
    links = op.ends(m.edges.where("confidence >= 0.99")).select(F.col("node").alias("parent"), F.col("other").alias("child"))
    return op.expand(seeds(m, "p10", "p40"), links, 2).orderBy("depth", "node").limit(50)


query(
    "rec_neighborhood",
    around,
    """WITH e AS (SELECT source_id AS a, target_id AS b FROM edges WHERE confidence >= 0.99 UNION SELECT target_id, source_id FROM edges WHERE confidence >= 0.99),
       s(node) AS (VALUES ('p10'), ('p40')) SELECT node, min(depth) AS depth FROM (SELECT node, 0 AS depth FROM s UNION ALL SELECT b, 1 FROM s JOIN e ON a = node
       UNION ALL SELECT y.b, 2 FROM s JOIN e x ON x.a = node JOIN e y ON y.a = x.b) GROUP BY node ORDER BY depth, node LIMIT 50""",
)
query(
    "rec_causal_chain",
    lambda m: op.expand(seeds(m, "e5"), m.ws_edges, 5, "source_id", "target_id"),
    """WITH RECURSIVE walk(node, depth) AS (SELECT 'e5', 0 UNION ALL SELECT target_id, depth + 1 FROM walk JOIN ws_edges ON source_id = node WHERE depth < 5)
       SELECT node, min(depth) AS depth FROM walk GROUP BY node""",
)
query("rec_inheritance", lambda m: m.chapters.where("act = 2 AND rank_no <= 120").select("id", "title"), "SELECT id, title FROM chapters WHERE act = 2 AND rank_no <= 120")
query(
    "rec_narrative_propagate",
    lambda m: m.folders.join(m.folders.select(F.col("id").alias("parent_id"), F.col("narrative_id").alias("above")), "parent_id").select("id", F.coalesce("narrative_id", "above").alias("narrative_id")),
    "SELECT f.id, coalesce(f.narrative_id, p.narrative_id) AS narrative_id FROM folders f JOIN folders p ON p.id = f.parent_id",
)
query(
    "rec_narrative_lookup",
    lambda m: op.nearest_set(m.folders, "narrative_id", 3),
    """SELECT f.id, coalesce(f.narrative_id, p.narrative_id, g.narrative_id) AS value FROM folders f LEFT JOIN folders p ON p.id = f.parent_id LEFT JOIN folders g ON g.id = p.parent_id""",
)

E = "id, source_id, target_id, rel_type"
query(
    "graph_add_quad",
    lambda m: m.edges.where("source_id = 'p4'").select("source_id", "rel_type", "target_id").unionByName(m.spark.createDataFrame([("p4", "met at", "p9")], "source_id string, rel_type string, target_id string").withColumn("rel_type", F.upper("rel_type"))).distinct(),
    "SELECT source_id, rel_type, target_id FROM edges WHERE source_id = 'p4' UNION SELECT 'p4', 'MET AT', 'p9'",
)
query("graph_outgoing", lambda m: m.edges.where("source_id = 'p21'").join(m.entities.select(F.col("id").alias("target_id"), "label"), "target_id").select("id", "target_id", "label"), "SELECT e.id, target_id, label FROM edges e JOIN entities n ON n.id = target_id WHERE source_id = 'p21'")
query("graph_incoming", lambda m: m.edges.where("target_id = 'p21'").join(m.entities.select(F.col("id").alias("source_id"), "label"), "source_id").select("id", "source_id", "label"), "SELECT e.id, source_id, label FROM edges e JOIN entities n ON n.id = source_id WHERE target_id = 'p21'")
query("graph_neighbors", lambda m: op.neighbors(m.edges, "p33"), "SELECT target_id AS other FROM edges WHERE source_id = 'p33' UNION SELECT source_id FROM edges WHERE target_id = 'p33'")
query(
    "graph_orphans",
    lambda m: op.orphans(m.entities, m.edges.where("confidence > 0.99")).select("id", "label"),
    "SELECT id, label FROM entities WHERE id NOT IN (SELECT source_id FROM edges WHERE confidence > 0.99 UNION SELECT target_id FROM edges WHERE confidence > 0.99)",
)
query("graph_all_edges", lambda m: m.edges.join(m.entities.select(F.col("id").alias("source_id")), "source_id").join(m.entities.select(F.col("id").alias("target_id")), "target_id").select(*E.split(", ")), f"SELECT {E} FROM edges WHERE source_id IN (SELECT id FROM entities) AND target_id IN (SELECT id FROM entities)")
query(
    "graph_wormholes",
    lambda m: m.hierarchy.select(F.coalesce("parent", F.lit("world:default")).alias("source"), "child").unionByName(m.folders.where("parent_id IS NULL").select(F.concat(F.lit("world:"), "world_id").alias("source"), F.col("id").alias("child"))),
    "SELECT parent AS source, child FROM hierarchy UNION ALL SELECT 'world:' || world_id, id FROM folders WHERE parent_id IS NULL",
)
query("graph_world_link", lambda m: m.folders.select("world_id", F.lit("WORLD_CONTAINS").alias("relation"), F.col("name").alias("entity")).dropDuplicates(), "SELECT DISTINCT world_id, 'WORLD_CONTAINS' AS relation, name AS entity FROM folders")
query("graph_unified", unified, UNIFIED)
query("graph_unified_group", lambda m: m.hierarchy.where("invalid_at IS NULL AND group_id = 'narrative:w0'").select("parent", "child").distinct(), "SELECT DISTINCT parent, child FROM hierarchy WHERE invalid_at IS NULL AND group_id = 'narrative:w0'")
query(
    "graph_unified_entity",
    lambda m: op.ends(unified(m), "source_id", "target_id", "type", "origin").where("node IN ('p10', 'n3', 's4')").distinct(),
    f"""WITH u AS ({UNIFIED}) SELECT source_id AS node, target_id AS other, 'out' AS direction, type, origin FROM u WHERE source_id IN ('p10', 'n3', 's4')
        UNION SELECT target_id, source_id, 'in', type, origin FROM u WHERE target_id IN ('p10', 'n3', 's4')""",
)
query("graph_unified_type", lambda m: unified(m).where("type IN ('contains', 'code1')"), f"SELECT * FROM ({UNIFIED}) WHERE type IN ('contains', 'code1')")
query("graph_net_connected", lambda m: op.ends(m.net_rels.where("network_id = 'net3'")), "SELECT source_id AS node, target_id AS other, 'out' AS direction FROM net_rels WHERE network_id = 'net3' UNION ALL SELECT target_id, source_id, 'in' FROM net_rels WHERE network_id = 'net3'")
query(
    "graph_cooc_of",
    lambda m: op.ends(m.edges, "source_id", "target_id", "weight").where("node = 'p10'").groupBy("other").agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "other").limit(25),
    """SELECT other, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT target_id AS other, weight FROM edges WHERE source_id = 'p10' UNION ALL SELECT source_id, weight FROM edges WHERE target_id = 'p10')
       GROUP BY other ORDER BY sum(weight) DESC, other LIMIT 25""",
)


def merged_sql(where: str, manual: str) -> str:
    return f"""SELECT source_id, upper(rel_type) AS rel_type, target_id, round({manual}CASE WHEN max(confidence) >= 1 THEN 1 ELSE 1 - exp(sum(CASE WHEN confidence < 1 THEN ln(1 - confidence) END)) END{' END' if manual else ''}, 6) AS confidence,
               count(DISTINCT origin) AS origins, count(DISTINCT note_id) AS notes, string_agg(DISTINCT origin, ',' ORDER BY origin) AS provenance FROM provenance {where} GROUP BY 1, 2, 3"""


def merged(m, *origins):
    rows = m.provenance.where(F.col("origin").isin(*origins)) if origins else m.provenance
    return op.merged(rows).withColumn("confidence", F.round("confidence", 6))


query("graph_merge_scanner", lambda m: merged(m, "scanner"), merged_sql("WHERE origin = 'scanner'", ""))
query("graph_merge_llm", lambda m: merged(m, "scanner", "llm"), merged_sql("WHERE origin IN ('scanner', 'llm')", ""))
query("graph_merge_manual", merged, merged_sql("", "CASE WHEN bool_or(origin = 'manual') THEN 1 ELSE "))
query("graph_to_cost", lambda m: m.edges.select("id", F.round(op.cost(), 6).alias("cost")), "SELECT id, round(greatest(0.01, 1 - confidence), 6) AS cost FROM edges")
query(
    "graph_entity_merge",
    lambda m: m.mentions.withColumn("entity_id", F.when(F.col("entity_id") == "p7", "p5").otherwise(F.col("entity_id"))).where("entity_id = 'p5'").groupBy("entity_id", "note_id").agg(F.sum("n").alias("n")),
    "SELECT 'p5' AS entity_id, note_id, CAST(sum(n) AS BIGINT) AS n FROM mentions WHERE entity_id IN ('p5', 'p7') GROUP BY note_id",
)
query(
    "graph_migrate",
    lambda m: m.edges.where("source_id = 'p6' OR target_id = 'p6'").select("id", *[F.when(F.col(c) == "p6", "p1").otherwise(F.col(c)).alias(c) for c in ("source_id", "target_id")]),
    "SELECT id, CASE WHEN source_id = 'p6' THEN 'p1' ELSE source_id END AS source_id, CASE WHEN target_id = 'p6' THEN 'p1' ELSE target_id END AS target_id FROM edges WHERE source_id = 'p6' OR target_id = 'p6'",
)
query(
    "graph_merge_rel",
    lambda m: m.provenance.where("source_id = 'p10'").withColumn("rel_id", F.when(F.col("rel_type") == "RF", F.lit("merged")).otherwise(F.col("rel_id"))).groupBy("rel_id").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n")),
    "SELECT CASE WHEN rel_type = 'RF' THEN 'merged' ELSE rel_id END AS rel_id, max(confidence) AS confidence, count(*) AS n FROM provenance WHERE source_id = 'p10' GROUP BY 1",
)
