"""Registered vector queries. The query vector and the centres are fixed and small."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import vector_index
from ..operators import vectors as op
from .registry import query

#: A fixed query vector of 64 components, and ten fixed centres.
QUERY = [round(math.sin(i * 0.7 + 1), 3) for i in range(64)]
CENTERS = [[round(math.sin(c * 11 + i * 0.9), 3) for i in range(64)] for c in range(10)]


def arr(xs):
    return "[" + ", ".join(map(str, xs)) + "]::DOUBLE[]"


COS = f"list_cosine_similarity(CAST(vec AS DOUBLE[]), {arr(QUERY)})"
DIST = f"round(1 - {COS}, 6)"


def knn(name, k, before=None, after=None, where="true", having="true", cut=None):
    def build(m):
        rows = m.blocks if cut is None else m.blocks.withColumn("vec", op.truncated("vec", cut))
        return op.nearest(rows, QUERY[:cut], k, before=None if before is None else F.expr(before), after=None if after is None else F.expr(after)).select("id", "distance", "narrative_id")

    dist = DIST if cut is None else f"round(1 - list_cosine_similarity(CAST(vec[1:{cut}] AS DOUBLE[]), {arr(QUERY[:cut])}), 6)"
    query(name, build, f"SELECT * FROM (SELECT id, {dist} AS distance, narrative_id FROM blocks WHERE {where} ORDER BY distance, id LIMIT {k}) WHERE {having}")


query("vec_cosine", lambda m: m.blocks.select("id", F.round(op.cosine("vec", F.array(*map(F.lit, QUERY))), 6).alias("v")), f"SELECT id, round({COS}, 6) AS v FROM blocks")
query("vec_l2norm", lambda m: m.blocks.select("id", F.round(op.dot(op.unit("vec"), op.unit("vec")), 6).alias("v")), "SELECT id, round(list_dot_product(u, u), 6) AS v FROM (SELECT id, [x / sqrt(list_dot_product(w, w)) FOR x IN w] AS u FROM (SELECT id, CAST(vec AS DOUBLE[]) AS w FROM blocks))")
query("vec_distance", lambda m: m.blocks.select("id", F.round(1 - op.cosine("vec", F.array(*map(F.lit, QUERY))), 6).alias("v")), f"SELECT id, {DIST} AS v FROM blocks")
query(
    "vec_centroid",
    lambda m: op.centroid(m.blocks, ["label"], "vec").select("label", "i", F.round("x", 5).alias("x")),
    "SELECT label, CAST(i - 1 AS INT) AS i, round(avg(CAST(vec[i] AS DOUBLE)), 5) AS x FROM blocks, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i",
)
query("vec_kmeans", lambda m: op.kmeans(m.blocks, 10)[0].groupBy("cluster").agg(F.count(F.lit(1)).alias("n")))
query(
    "vec_soft_assign",
    lambda m: op.soft_assign(m.blocks, CENTERS, 0.1),
    "SELECT id, cluster, round(d, 6) AS distance FROM (SELECT *, min(d) OVER (PARTITION BY id) AS least FROM (SELECT id, cluster, 1 - list_cosine_similarity(CAST(vec AS DOUBLE[]), c) AS d FROM blocks, (VALUES "
    + ", ".join(f"({i}, {arr(c)})" for i, c in enumerate(CENTERS))
    + ") v(cluster, c))) WHERE d <= CASE WHEN least < 0.001 THEN 0.101 ELSE least * 1.1 END",
)
query("vec_raptor_build", lambda m: op.cluster_tree(m.blocks, 12).select("level", "node", "parent", "n"))


def asked(m):
    return m.blocks.where("id % 20 = 0").select(F.col("id").alias("query"), "vec")


query(
    "vec_knn_exact",
    lambda m: vector_index.exact(asked(m), m.blocks, 10).select("query", "id", "distance", "place"),
    """SELECT query, id, distance, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS place FROM (SELECT a.id AS query, b.id, round(1 - list_cosine_similarity(CAST(a.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[])), 6) AS distance
       FROM blocks a JOIN blocks b ON a.id % 20 = 0)) WHERE place <= 10""",
)


def indexed(m):
    """What the index finds for every twentieth row, how much of it is right, and what share of the rows it read."""
    index = vector_index.build(m.blocks)
    probes = index.probes(0.95)
    found, right = index.search(asked(m), 10, probes), vector_index.exact(asked(m), m.blocks, 10)
    hits = found.join(right.select("query", "id"), ["query", "id"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    recall = right.agg(F.count(F.lit(1)).alias("n")).crossJoin(hits).select((F.col("hits") / F.col("n")).alias("recall"))  # one row each
    return index.read_share(asked(m), probes).crossJoin(recall).select("queries", F.round("recall", 4).alias("recall"), F.round("share", 4).alias("share"))


query("vec_knn_index", indexed)
knn("vec_flat_search", 10)
knn("vec_knn", 20)
knn("vec_knn_768", 15, before="label < 5", where="label < 5")
knn("vec_knn_256", 12, cut=32)
knn("vec_knn_128", 12, cut=16)
knn("vec_blocks_local", 50, after="narrative_id = 'nar3'", having="narrative_id = 'nar3'")
knn("vec_blocks_bubble", 50, after="narrative_id IN ('nar3', 'nar1')", having="narrative_id IN ('nar3', 'nar1')")
knn("vec_blocks_global", 25)
knn("vec_collapsed", 30)
knn("vec_collapsed_scoped", 30, after="narrative_id = 'nar5'", having="narrative_id = 'nar5'")
knn("vec_leaves", 10, before="label = 0", where="label = 0")
knn("vec_leaves_scoped", 20, before="label < 4", after="narrative_id = 'nar2'", where="label < 4", having="narrative_id = 'nar2'")
query("vec_semantic", lambda m: op.nearest(m.blocks, QUERY, 10, before=F.col("narrative_id") == "nar4").select("id", F.round(1 - F.col("distance"), 6).alias("score")), f"SELECT id, round(1 - d, 6) AS score FROM (SELECT id, {DIST} AS d FROM blocks WHERE narrative_id = 'nar4' ORDER BY d, id LIMIT 10)")


def recalled(m):
    """Scope first; everything where the scope has nothing."""
    local = op.nearest(m.blocks, QUERY, 10, before=F.col("narrative_id") == "nowhere").select("id", "distance")
    wide = op.nearest(m.blocks, QUERY, 10).select("id", "distance")
    return local.unionByName(wide.join(F.broadcast(local.agg(F.count(F.lit(1)).alias("n"))), F.col("n") == 0, "left_semi"))


query("vec_recall", recalled, f"SELECT id, {DIST} AS distance FROM blocks ORDER BY distance, id LIMIT 10")
query("vec_truncate", lambda m: m.blocks.select("id", F.size(op.truncated("vec", 16)).alias("n"), F.round(F.element_at(op.truncated("vec", 16), -1).cast("double"), 5).alias("x")), "SELECT id, 16 AS n, round(CAST(vec[16] AS DOUBLE), 5) AS x FROM blocks")
query("vec_truncate_soft", lambda m: m.blocks.select("id", F.size(op.truncated("vec", 500, strict=False)).alias("n")), "SELECT id, CAST(len(vec) AS INT) AS n FROM blocks")
query("vec_validate", lambda m: m.blocks.select("id", (F.size("vec") == 64).alias("valid")), "SELECT id, len(vec) = 64 AS valid FROM blocks")
query(
    "vec_decode",
    lambda m: m.blocks.select("id", op.encoded("vec").alias("raw")).withColumn("v", op.decoded("raw")).select("id", F.size("v").alias("n"), F.round(F.element_at("v", 1).cast("double"), 6).alias("a"), F.round(op.dot("v", "v"), 4).alias("square")),
    "SELECT id, CAST(len(vec) AS INT) AS n, round(CAST(vec[1] AS DOUBLE), 6) AS a, round(list_dot_product(CAST(vec AS DOUBLE[]), CAST(vec AS DOUBLE[])), 4) AS square FROM blocks",
)
WINDOW = "substr(t, begun + 513, 512)"
CUT = rf"""CASE WHEN length(t) - begun <= 1024 THEN length(t) WHEN contains({WINDOW}, chr(10) || chr(10)) THEN begun + 512 + length(regexp_extract({WINDOW}, '(?s)^(.*)\n\n', 1)) + 2
       WHEN contains({WINDOW}, '. ') THEN begun + 512 + length(regexp_extract({WINDOW}, '(?s)^(.*)\. ', 1)) + 2 ELSE begun + 1024 END"""
query(
    "vec_chunk",
    lambda m: op.chunks(m.notes, "content").select("id", "place", F.length("chunk").alias("n")),
    rf"""WITH RECURSIVE f(id, t, begun, piece, i) AS (SELECT id, coalesce(content, ''), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), 0 FROM notes
         UNION ALL SELECT id, t, upto, regexp_replace(substr(t, begun + 1, upto - begun), '^\s+|\s+$', '', 'g'), i + 1 FROM (SELECT *, {CUT} AS upto FROM f WHERE begun < length(t)))
         SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS INT) AS place, CAST(length(piece) AS INT) AS n FROM f WHERE piece <> ''""",
)
query("vec_mention_evidence", lambda m: m.mentions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("notes"), F.sum("n").alias("frequency")).join(m.entities.select(F.col("id").alias("entity_id"), F.col("label").rlike("^[A-Z]").alias("capital")), "entity_id"),
    "SELECT entity_id, count(*) AS notes, CAST(sum(n) AS BIGINT) AS frequency, any_value(regexp_matches(label, '^[A-Z]')) AS capital FROM mentions JOIN entities ON id = entity_id GROUP BY entity_id")
query("vec_mmr", lambda m: op.diverse(m.blocks, QUERY, 10))
