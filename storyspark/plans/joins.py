"""Registered joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs
from ..operators import joins as op
from .registry import query

query(
    "join_thread_memories",
    lambda m: m.memories.join(m.memory_threads.where("thread_id IN ('t3', 't4')"), F.col("id") == F.col("memory_id")).orderBy(F.desc("created_at")).select("thread_id", "id", "content", "memory_type", "created_at"),
    "SELECT thread_id, id, content, memory_type, created_at FROM memories JOIN memory_threads ON memory_id = id WHERE thread_id IN ('t3', 't4')",
)
query(
    "join_note_tags",
    lambda m: m.notes.join(m.note_tags, F.col("id") == F.col("note_id")).select("id", "tag"),
    "SELECT id, tag FROM notes JOIN note_tags ON note_id = id",
)
query(
    "join_notes_in_world",
    lambda m: m.blocks.join(m.notes.where(F.lower("content").contains("tion") & (F.col("world_id") == "w1")).select(F.col("id").alias("note_id"), "title"), "note_id").select("id", "note_id", "title"),
    "SELECT b.id, b.note_id, n.title FROM blocks b JOIN notes n ON n.id = b.note_id WHERE n.world_id = 'w1' AND contains(lower(n.content), 'tion')",
)
query(
    "join_neighbors",
    lambda m: graphs.neighbors(m.edges, "p40").withColumnRenamed("other", "id").join(m.entities, "id").select("id", "label", "kind"),
    """SELECT DISTINCT n.id, n.label, n.kind FROM entities n JOIN edges e ON (e.source_id = 'p40' AND e.target_id = n.id) OR (e.target_id = 'p40' AND e.source_id = n.id)""",
)
query(
    "join_entities_in_notes",
    lambda m: m.mentions.where(F.col("note_id").isin(3, 5, 8)).groupBy("entity_id").agg(F.sum("n").alias("n")).join(m.entities.where("kind IN ('PROMO', 'LARGE')"), F.col("entity_id") == F.col("id")).orderBy(F.desc("n"), "id").limit(20).select("id", "label", "n"),
    """SELECT id, label, CAST(sum(n) AS BIGINT) AS n FROM mentions JOIN entities ON id = entity_id WHERE note_id IN (3, 5, 8) AND kind IN ('PROMO', 'LARGE')
       GROUP BY id, label ORDER BY sum(n) DESC, id LIMIT 20""",
)
query(
    "join_cluster_of",
    lambda m: m.cluster_members.where("entity_id = 'p17'").join(m.clusters, F.col("cluster_id") == F.col("id")).select("id", "name", "vec_id"),
    "SELECT c.id, c.name, vec_id FROM cluster_members JOIN clusters c ON c.id = cluster_id WHERE entity_id = 'p17'",
)
query(
    "join_raptor_children",
    lambda m: m.cluster_members.groupBy("cluster_id").agg(F.collect_set("vec_id").alias("children")).select("cluster_id", F.explode("children").alias("id")).join(m.blocks.select("id", "note_id"), "id"),
    "SELECT cluster_id, b.id, b.note_id FROM cluster_members JOIN blocks b ON b.id = vec_id",
)
query(
    "join_causal_named",
    lambda m: m.edges.where("confidence >= 0.99").join(m.entities.select(F.col("id").alias("source_id"), F.col("label").alias("cause")), "source_id").join(m.entities.select(F.col("id").alias("target_id"), F.col("label").alias("effect")), "target_id").select("id", "cause", "rel_type", "effect"),
    "SELECT e.id, a.label AS cause, rel_type, b.label AS effect FROM edges e JOIN entities a ON a.id = source_id JOIN entities b ON b.id = target_id WHERE e.confidence >= 0.99",
)
query(
    "join_sentence_window",
    lambda m: op.band_pairs(m.sentence_mentions.where("group_id = 'narrative:n1'"), ["group_id", "episode_id"], "entity_id", "sentence_index", 2).select("episode_id", "a", "b", "pos_a", "pos_b"),
    """SELECT x.episode_id, x.entity_id AS a, y.entity_id AS b, x.sentence_index AS pos_a, y.sentence_index AS pos_b FROM sentence_mentions x JOIN sentence_mentions y
       ON x.episode_id = y.episode_id AND x.group_id = y.group_id AND x.entity_id < y.entity_id AND abs(x.sentence_index - y.sentence_index) <= 1 WHERE x.group_id = 'narrative:n1'""",
)
query(
    "join_word_window",
    lambda m: op.band_least(m.spans, ["note_id"], "entity_id", "from_pos", 30),
    """SELECT x.note_id, x.entity_id AS a, y.entity_id AS b, min(abs(x.from_pos - y.from_pos)) AS distance FROM spans x JOIN spans y
       ON x.note_id = y.note_id AND x.entity_id < y.entity_id AND abs(x.from_pos - y.from_pos) <= 29 GROUP BY ALL""",
)
query(
    "join_paragraph",
    lambda m: op.equal_pairs(m.sentence_mentions, ["episode_id"], "entity_id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
    """SELECT x.entity_id AS a, y.entity_id AS b, count(DISTINCT x.episode_id) AS n FROM sentence_mentions x JOIN sentence_mentions y ON x.episode_id = y.episode_id AND x.entity_id < y.entity_id
       GROUP BY ALL HAVING count(DISTINCT x.episode_id) > 1""",
)
query(
    "join_as_of",
    lambda m: op.as_of(m.note_versions, "id", F.col("created_at") + 150).select("id", "version", "title", "valid_from", "valid_to"),
    "SELECT id, version, title, valid_from, valid_to FROM note_versions WHERE valid_from <= created_at + 150 AND (valid_to IS NULL OR valid_to > created_at + 150)",
)
query(
    "join_cross_world",
    lambda m: m.spans.where("origin = 'F'").alias("s").join(m.edges.where("confidence >= 0.97").select("source_id", "target_id", F.col("id").alias("link")), F.col("entity_id") == F.col("source_id")).where("from_pos BETWEEN 20 AND 120").join(m.entities.select(F.col("id").alias("target_id"), "label"), "target_id").select(F.col("s.id").alias("span"), "link", "label"),
    """SELECT s.id AS span, e.id AS link, n.label FROM spans s JOIN edges e ON e.source_id = s.entity_id JOIN entities n ON n.id = e.target_id
       WHERE s.origin = 'F' AND e.confidence >= 0.97 AND s.from_pos BETWEEN 20 AND 120""",
)
query(
    "join_span_overlap",
    lambda m: op.overlapping(m.spans.where("origin = 'O'"), m.spans.where("origin = 'F'"), ["note_id"], "from_pos", "to_pos", "left_anti").select("id", "note_id", "from_pos", "to_pos"),
    """SELECT id, note_id, from_pos, to_pos FROM spans s WHERE origin = 'O' AND NOT EXISTS (SELECT 1 FROM spans t WHERE t.origin = 'F' AND t.note_id = s.note_id
       AND s.from_pos < t.to_pos AND t.from_pos < s.to_pos)""",
)
query(
    "join_scope_map",
    lambda m: m.entities.where("narrative_id = 'nar1'").join(
        m.entities.where("narrative_id = 'nar2'").groupBy("kind", "subtype").agg(F.min("id").alias("there")), ["kind", "subtype"], "left"
    ).select("id", F.coalesce("there", F.concat(F.lit("new-"), "id")).alias("mapped"), F.col("there").isNull().alias("created")),
    """SELECT e.id, coalesce(there, 'new-' || e.id) AS mapped, there IS NULL AS created FROM entities e LEFT JOIN (SELECT kind, subtype, min(id) AS there FROM entities
       WHERE narrative_id = 'nar2' GROUP BY ALL) t ON t.kind = e.kind AND t.subtype = e.subtype WHERE e.narrative_id = 'nar1'""",
)
query(
    "join_validate_closest",
    lambda m: op.closest(m.spans.where("origin = 'F'"), m.spans.where("origin = 'O'"), ["note_id"], "from_pos", 500).select("note_id", "distance"),
    """SELECT x.note_id, min(abs(x.from_pos - y.from_pos)) AS distance FROM spans x JOIN spans y ON x.note_id = y.note_id WHERE x.origin = 'F' AND y.origin = 'O'
       AND abs(x.from_pos - y.from_pos) <= 500 GROUP BY x.note_id""",
)


def fuzzy_label(m):
    """Exact label first, else one that contains the other; the least id among equals."""
    asked = m.spark.createDataFrame([("small ring 0",), ("widget 1",), ("the blue bolt 2 of old",), ("nothing here",)], "asked string")
    tier = F.when(F.col("label") == F.col("asked"), 0).when(F.col("label").contains(F.col("asked")) | F.col("asked").contains(F.col("label")), 1)
    met = m.entities.join(F.broadcast(asked), tier.isNotNull()).withColumn("tier", tier)
    return met.groupBy("asked").agg(F.min(F.struct("tier", "id")).alias("m")).select("asked", "m.tier", "m.id")


query(
    "join_fuzzy_label",
    fuzzy_label,
    """SELECT asked, tier, id FROM (SELECT asked, CASE WHEN label = asked THEN 0 ELSE 1 END AS tier, id, row_number() OVER (PARTITION BY asked ORDER BY CASE WHEN label = asked THEN 0 ELSE 1 END, id) AS rn
       FROM entities JOIN (VALUES ('small ring 0'), ('widget 1'), ('the blue bolt 2 of old'), ('nothing here')) v(asked) ON contains(label, asked) OR contains(asked, label)) WHERE rn = 1""",
)
query(
    "join_backlinks",
    lambda m: m.mentions.where("note_id <> 7").join(m.mentions.where("note_id = 7").select("entity_id").distinct(), "entity_id", "left_semi").groupBy("note_id").agg(F.count_distinct("entity_id").alias("n")),
    "SELECT note_id, count(DISTINCT entity_id) AS n FROM mentions WHERE note_id <> 7 AND entity_id IN (SELECT entity_id FROM mentions WHERE note_id = 7) GROUP BY note_id",
)
query(
    "join_known_filter",
    lambda m: m.mentions.where("n >= 50").select(F.col("entity_id").alias("id")).distinct().join(m.entities.where("created_by = 'user'").select("id"), "id", "left_anti"),
    "SELECT DISTINCT entity_id AS id FROM mentions WHERE n >= 50 AND entity_id NOT IN (SELECT id FROM entities WHERE created_by = 'user')",
)
query(
    "join_scope_entities",
    lambda m: m.entities.where("narrative_id = 'nar3'").unionByName(m.entities.join(m.notes.where("folder_id = 'src2'").select(F.col("id").alias("first_note")), "first_note", "left_semi").select(*m.entities.columns)).dropDuplicates(["id"]).select("id", "label"),
    "SELECT id, label FROM entities WHERE narrative_id = 'nar3' OR first_note IN (SELECT id FROM notes WHERE folder_id = 'src2')",
)
query(
    "join_postings_and",
    lambda m: op.containing_all(m.note_tags, ["lang-en", "toxic"], "tag", "note_id"),
    "SELECT note_id FROM note_tags WHERE tag IN ('lang-en', 'toxic') GROUP BY note_id HAVING count(DISTINCT tag) = 2",
)
query(
    "join_viz_edges",
    lambda m: m.edges.join(m.entities.where("mentions >= 25").select(F.col("id").alias("source_id")), "source_id", "left_semi").join(m.entities.where("mentions >= 25").select(F.col("id").alias("target_id")), "target_id", "left_semi").select("id", "source_id", "target_id"),
    "SELECT id, source_id, target_id FROM edges WHERE source_id IN (SELECT id FROM entities WHERE mentions >= 25) AND target_id IN (SELECT id FROM entities WHERE mentions >= 25)",
)
