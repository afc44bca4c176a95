"""Registered aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as op
from ..operators import graphs
from ..operators import joins
from .registry import query

# Words that a density of keywords leaves out.
STOP_WORDS = "the of and to in that is was he for it with as his on be at by had not are but from a an or this".split()
STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

query("agg_counts", lambda m: op.counts(entities=m.entities, edges=m.edges, provenance=m.provenance), "SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM provenance) AS provenance")
query(
    "agg_detailed",
    lambda m: m.provenance.cube("rel_type", "origin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("confidence")),
    "SELECT rel_type, origin, count(*) AS n, round(avg(confidence), 4) AS confidence FROM provenance GROUP BY CUBE (rel_type, origin)",
)
query(
    "agg_max_conf",
    lambda m: m.provenance.groupBy("rel_id").agg(F.max("confidence").alias("confidence")),
    "SELECT rel_id, max(confidence) AS confidence FROM provenance GROUP BY rel_id",
)
query("agg_entity_count", lambda m: op.counts(n=m.entities), "SELECT count(*) AS n FROM entities")
query("agg_edge_count", lambda m: op.counts(n=m.edges), "SELECT count(*) AS n FROM edges")
query("agg_max_version", lambda m: m.note_versions.groupBy("id").agg(F.max("version").alias("version")), "SELECT id, max(version) AS version FROM note_versions GROUP BY id")
query(
    "agg_cluster_sizes",
    lambda m: m.clusters.join(m.cluster_members.groupBy(F.col("cluster_id").alias("id")).agg(F.count(F.lit(1)).alias("members")), "id", "left").select("id", "name", F.coalesce("members", F.lit(0)).alias("members")),
    "SELECT c.id, name, count(cluster_id) AS members FROM clusters c LEFT JOIN cluster_members ON cluster_id = c.id GROUP BY c.id, name",
)
query(
    "agg_crossdoc_stats",
    lambda m: op.counts(vectors=m.blocks, clusters=m.clusters, members=m.cluster_members, pairs=m.edges).crossJoin(m.edges.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"))),
    """SELECT (SELECT count(*) FROM blocks) AS vectors, (SELECT count(*) FROM clusters) AS clusters, (SELECT count(*) FROM cluster_members) AS members,
       (SELECT count(*) FROM edges) AS pairs, (SELECT CAST(coalesce(sum(weight), 0) AS BIGINT) FROM edges) AS weight""",
)
query("agg_memory_stats", lambda m: op.counts(episodes=m.episodes, blocks=m.blocks), "SELECT (SELECT count(*) FROM episodes) AS episodes, (SELECT count(*) FROM blocks) AS blocks")
query("agg_ws_stats", lambda m: op.counts(nodes=m.ws_nodes, edges=m.ws_edges, sessions=m.ws_nodes.select("ws_id").distinct()), "SELECT (SELECT count(*) FROM ws_nodes) AS nodes, (SELECT count(*) FROM ws_edges) AS edges, (SELECT count(DISTINCT ws_id) FROM ws_nodes) AS sessions")
UNIFIED = """SELECT source_id, target_id, rel_type AS type, 'entity' AS origin FROM edges UNION SELECT parent, child, 'contains', 'hierarchy' FROM hierarchy WHERE invalid_at IS NULL
             UNION SELECT source_id, target_id, code, 'network' FROM net_rels"""


def unified(m):
    return (
        m.edges.select("source_id", "target_id", F.col("rel_type").alias("type"), F.lit("entity").alias("origin"))
        .unionByName(m.hierarchy.where("invalid_at IS NULL").select(F.col("parent").alias("source_id"), F.col("child").alias("target_id"), F.lit("contains").alias("type"), F.lit("hierarchy").alias("origin")))
        .unionByName(m.net_rels.select("source_id", "target_id", F.col("code").alias("type"), F.lit("network").alias("origin")))
        .distinct()
    )


query("agg_edges_by_origin", lambda m: unified(m).groupBy("origin").agg(F.count(F.lit(1)).alias("n")), f"SELECT origin, count(*) AS n FROM ({UNIFIED}) GROUP BY origin")
query("agg_net_members", lambda m: m.members.where("left_at IS NULL").groupBy("network_id").agg(F.count(F.lit(1)).alias("n")), "SELECT network_id, count(*) AS n FROM members WHERE left_at IS NULL GROUP BY network_id")
query("agg_net_rels", lambda m: m.net_rels.groupBy("network_id").agg(F.count(F.lit(1)).alias("n")), "SELECT network_id, count(*) AS n FROM net_rels GROUP BY network_id")
query(
    "agg_graph_stats",
    lambda m: op.counts(nodes=m.entities, edges=m.edges).select(
        "nodes", "edges", F.round(2 * F.col("edges") / F.col("nodes"), 6).alias("degree"), F.round(2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 9).alias("density")
    ).crossJoin(m.edges.orderBy(F.desc("weight"), "id").limit(10).agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("top"))),
    """SELECT n AS nodes, e AS edges, round(2 * e / n, 6) AS degree, round(2 * e / (n * (n - 1)), 9) AS density, top FROM (SELECT (SELECT count(*) FROM entities) AS n, (SELECT count(*) FROM edges) AS e,
       (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM edges ORDER BY weight DESC, id LIMIT 10)) AS top)""",
)
query(
    "agg_codex_category",
    lambda m: m.entities.groupBy(F.coalesce("narrative_id", F.lit("uncategorized")).alias("category")).agg(F.count(F.lit(1)).alias("n")),
    "SELECT coalesce(narrative_id, 'uncategorized') AS category, count(*) AS n FROM entities GROUP BY 1",
)
query(
    "agg_rel_stats",
    lambda m: m.provenance.rollup("origin", "rel_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rel_id").alias("relations")),
    "SELECT origin, rel_type, count(*) AS n, count(DISTINCT rel_id) AS relations FROM provenance GROUP BY ROLLUP (origin, rel_type)",
)
query(
    "agg_entity_stats",
    lambda m: m.entities.agg(F.count(F.lit(1)).alias("entities"), F.sum("mentions").alias("mentions")).crossJoin(op.counts(aliases=m.aliases)),
    "SELECT count(*) AS entities, CAST(sum(mentions) AS BIGINT) AS mentions, (SELECT count(*) FROM aliases) AS aliases FROM entities",
)


def sentence_pairs(m):
    return joins.few_pairs(m.sentence_mentions, ["episode_id", "note_id"], "entity_id", "sentence_index", 2)


PAIRS = """SELECT x.episode_id, x.note_id, x.entity_id AS a, y.entity_id AS b FROM sentence_mentions x JOIN sentence_mentions y
           ON x.episode_id = y.episode_id AND x.note_id = y.note_id AND x.entity_id < y.entity_id AND abs(x.sentence_index - y.sentence_index) <= 1"""
WEIGHTS = f"SELECT a, b, count(*) AS weight, count(DISTINCT episode_id) AS episodes, count(DISTINCT note_id) AS notes FROM ({PAIRS}) GROUP BY a, b"
query("agg_pair_weights", lambda m: op.pair_weights(sentence_pairs(m)), WEIGHTS)
query(
    "agg_window_edges",
    lambda m: sentence_pairs(m).groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"), F.size(F.array_distinct(F.collect_list("note_id"))).cast("bigint").alias("notes")).where("weight > 1"),
    f"SELECT a, b, count(*) AS weight, count(DISTINCT note_id) AS notes FROM ({PAIRS}) GROUP BY a, b HAVING count(*) > 1",
)


def frequency(m):
    return m.sentence_mentions.groupBy(F.col("entity_id").alias("item")).agg(F.count_distinct("episode_id").alias("n"))


query(
    "agg_pmi",
    lambda m: op.pmi(op.pair_weights(sentence_pairs(m)), frequency(m)),
    f"""SELECT a, b, weight, round(ln(weight * total / (fa.n * fb.n)), 6) AS pmi FROM ({WEIGHTS}) w, (SELECT CAST(sum(weight) AS DOUBLE) AS total FROM ({WEIGHTS}))
        JOIN (SELECT entity_id, count(DISTINCT episode_id) AS n FROM sentence_mentions GROUP BY entity_id) fa ON fa.entity_id = a
        JOIN (SELECT entity_id, count(DISTINCT episode_id) AS n FROM sentence_mentions GROUP BY entity_id) fb ON fb.entity_id = b""",
)
for how, sql in (("sum", "CAST(sum(weight) AS BIGINT)"), ("max", "max(weight)"), ("average", "CAST(floor(avg(weight) + 0.5) AS BIGINT)")):
    query(
        "agg_scope_merge" + ("" if how == "sum" else f"_{how}"),
        lambda m, how=how: op.merged_weights(m.edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "weight", F.when(F.col("confidence") < 0.99, F.col("confidence")).alias("pmi")), how),
        f"""SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, {sql} AS weight, round(avg(CASE WHEN confidence < 0.99 THEN confidence END), 6) AS pmi FROM edges GROUP BY 1, 2""",
    )
query(
    "agg_cooc_upsert",
    lambda m: m.provenance.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("weight"), F.max("created_at").alias("last_seen")),
    "SELECT source_id, target_id, count(*) AS weight, max(created_at) AS last_seen FROM provenance GROUP BY source_id, target_id",
)
query(
    "agg_corpus_stats",
    lambda m: m.notes.agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.sum(F.length("content")) / F.count(F.lit(1)), 6).alias("avg_content"), F.round(F.sum(F.length("title")) / F.count(F.lit(1)), 6).alias("avg_title")),
    "SELECT count(*) AS n_docs, round(sum(length(content)) / count(*), 6) AS avg_content, round(sum(length(title)) / count(*), 6) AS avg_title FROM notes",
)
query(
    "agg_posting_stats",
    lambda m: m.note_tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("terms"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most")),
    "SELECT count(*) AS terms, round(avg(n), 6) AS mean, max(n) AS most FROM (SELECT tag, count(*) AS n FROM note_tags GROUP BY tag)",
)
query(
    "agg_gram_stats",
    lambda m: m.benchmark.select("item_id", F.length("text").alias("length"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("(?s)(?=(.{3}))"), 1)).alias("gram")).groupBy("gram", "item_id", "length").agg(F.count(F.lit(1)).alias("tf")).groupBy("gram").agg(F.max("tf").alias("max_tf"), F.min("length").cast("bigint").alias("min_length"), F.count(F.lit(1)).alias("df")),
    """SELECT gram, max(tf) AS max_tf, CAST(min(length) AS BIGINT) AS min_length, count(*) AS df FROM (SELECT item_id, length(text) AS length, substr(lower(text), i, 3) AS gram, count(*) AS tf
       FROM (SELECT item_id, text, unnest(range(1, length(text) - 1)) AS i FROM benchmark) GROUP BY ALL) GROUP BY gram""",
)
query(
    "agg_degree",
    lambda m: graphs.degree_centrality(m.entities, m.edges),
    """SELECT n.id, coalesce(d, 0) AS degree, round(coalesce(d, 0) / (2.0 * ((SELECT count(*) FROM entities) - 1)), 9) AS centrality FROM entities n
       LEFT JOIN (SELECT node, count(*) AS d FROM (SELECT source_id AS node FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY node) ON node = n.id""",
)
query(
    "agg_merge_stats",
    lambda m: m.provenance.select("rel_id", "origin").distinct().groupBy("rel_id").agg(F.collect_set("origin").alias("o")).select(F.explode("o").alias("origin"), (F.size("o") > 1).cast("int").alias("shared")).groupBy("origin").agg(F.count(F.lit(1)).alias("edges"), F.sum("shared").alias("shared")),
    """SELECT origin, count(*) AS edges, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS shared FROM (SELECT DISTINCT rel_id, origin FROM provenance)
       JOIN (SELECT rel_id, count(DISTINCT origin) AS n FROM provenance GROUP BY rel_id) USING (rel_id) GROUP BY origin""",
)
query(
    "agg_candidates",
    lambda m: op.candidate_status(m.documents.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), 0)).alias("token")).groupBy(F.lower("token").alias("token")).agg(F.count(F.lit(1)).alias("n")), 3),
    """SELECT token, count(*) AS n, CASE WHEN count(*) >= 3 THEN 'promoted' ELSE 'watching' END AS status FROM (SELECT lower(unnest(regexp_extract_all(text, '[A-Z][a-z]+'))) AS token FROM documents) GROUP BY token""",
)
query(
    "agg_keyword_density",
    lambda m: op.top_words(m.documents.where("lang = 'en'"), "text", STOP_WORDS, 100),
    f"""SELECT word, n, floor(n * 1000.0 / sum(n) OVER () + 0.5) / 10 AS percent FROM (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(trim(regexp_replace(lower(text), '[^0-9a-z_]+', ' ', 'g')), ' ')) AS word
        FROM documents WHERE lang = 'en') WHERE word <> '' AND word NOT IN ({STOPS}) GROUP BY word) ORDER BY n DESC, word LIMIT 100""",
)
query(
    "agg_entropy_term",
    lambda m: op.entropy_of(m.mentions.select(F.col("entity_id").alias("term"), F.col("n").alias("tf"))),
    "SELECT entity_id AS term, round(sum(-p * ln(p)), 6) AS entropy FROM (SELECT entity_id, 1 / (1 + exp(-least(n, 10))) AS p FROM mentions) GROUP BY entity_id",
)
query("agg_max_order", lambda m: op.next_order(m.notes.where("folder_id = 'src4'")), "SELECT coalesce(max(ord), 0) + 1000 AS next FROM notes WHERE folder_id = 'src4'")


def built(m):
    """Co-occurrence in sentences, its PMI, and what the edges know: one graph of pairs."""
    own = op.pmi(op.pair_weights(sentence_pairs(m)), frequency(m)).select(F.concat(F.lit("p"), "a").alias("a"), F.concat(F.lit("p"), "b").alias("b"), "weight", "pmi")
    known = m.edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "weight", F.lit(None).cast("double").alias("pmi"))
    return op.merged_weights(own.unionByName(known), "sum").where("weight >= 2")


query(
    "graph_build",
    built,
    f"""WITH w AS ({WEIGHTS}), f AS (SELECT entity_id, count(DISTINCT episode_id) AS n FROM sentence_mentions GROUP BY entity_id),
        own AS (SELECT 'p' || a AS a, 'p' || b AS b, weight, round(ln(weight * (SELECT CAST(sum(weight) AS DOUBLE) FROM w) / (fa.n * fb.n)), 6) AS pmi FROM w JOIN f fa ON fa.entity_id = a JOIN f fb ON fb.entity_id = b)
        SELECT least(a, b) AS a, greatest(a, b) AS b, CAST(sum(weight) AS BIGINT) AS weight, round(avg(pmi), 6) AS pmi FROM (SELECT * FROM own UNION ALL SELECT source_id, target_id, weight, NULL FROM edges) GROUP BY 1, 2 HAVING sum(weight) >= 2""",
)
