"""Edge lists as graphs: ends, neighbours, degrees, merges, bounded recursion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def ends(edges: DataFrame, source: str = "source_id", target: str = "target_id", *keep: str) -> DataFrame:
    """Each edge seen from both its ends: node, other, direction."""
    out = edges.select(F.col(source).alias("node"), F.col(target).alias("other"), F.lit("out").alias("direction"), *keep)
    back = edges.select(F.col(target).alias("node"), F.col(source).alias("other"), F.lit("in").alias("direction"), *keep)
    return out.unionByName(back)


def neighbors(edges: DataFrame, node) -> DataFrame:
    return ends(edges).where(F.col("node") == node).select("other").distinct()


def orphans(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    return nodes.join(ends(edges).select(F.col("node").alias(key)).distinct(), key, "left_anti")


def degree_centrality(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """(in + out) / (2 (n - 1)) of every node, 0 for one without edges or a graph of one node."""
    degree = ends(edges).groupBy(F.col("node").alias(key)).agg(F.count(F.lit(1)).alias("degree"))
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    rows = nodes.select(key).join(degree, key, "left").crossJoin(F.broadcast(n))  # n is one row
    share = F.coalesce("degree", F.lit(0)) / (2.0 * (F.col("n") - 1))
    return rows.select(key, F.coalesce("degree", F.lit(0)).alias("degree"), F.when(F.col("n") > 1, F.round(share, 9)).otherwise(0.0).alias("centrality"))


def noisy_or(confidence: str) -> Column:
    """1 - prod(1 - c), as an aggregate."""
    c = F.col(confidence)
    rest = F.sum(F.log(F.when(c < 1, 1 - c)))
    return F.when(F.max(c) >= 1, 1.0).otherwise(1 - F.exp(rest))


def merged(edges: DataFrame, manual_origin: str = "manual") -> DataFrame:
    """Edges of one source, relation (whatever its case) and target as one: noisy-or confidence, 1 where
    any is manual; number of origins and notes."""
    rows = edges.withColumn("rel_type", F.upper("rel_type")).groupBy("source_id", "rel_type", "target_id")
    return rows.agg(
        F.when(F.max((F.col("origin") == manual_origin).cast("int")) == 1, 1.0).otherwise(noisy_or("confidence")).alias("confidence"),
        F.size(F.collect_set("origin")).cast("bigint").alias("origins"),  # a handful of origins; two distinct counts would triple the rows
        F.count_distinct("note_id").alias("notes"),
        F.array_join(F.sort_array(F.collect_set("origin")), ",").alias("provenance"),
    )


def cost(confidence: str = "confidence") -> Column:
    return F.greatest(F.lit(0.01), 1 - F.col(confidence))


def expand(seeds: DataFrame, links: DataFrame, depth: int, parent: str = "parent", child: str = "child") -> DataFrame:
    """node and depth: everything reachable from seeds (node) along parent -> child within depth steps,
    with the least depth. Each step joins the newest nodes only and is written when the plan grows long."""
    found = seeds.select("node", F.lit(0).alias("depth")).distinct()
    front = found
    links = links.select(F.col(parent).alias("node"), F.col(child).alias("_next")).distinct()
    for k in range(1, depth + 1):
        front = front.join(links, "node").select(F.col("_next").alias("node")).distinct().join(found.select("node"), "node", "left_anti").select("node", F.lit(k).alias("depth"))
        if k % 4 == 0:
            front = written(front, "front")
            if front.isEmpty():
                break
        found = found.unionByName(front)
        if k % 4 == 0:
            found = written(found, "found")
    return found


def closure_pairs(links: DataFrame, depth: int, parent: str = "parent", child: str = "child") -> DataFrame:
    """ancestor, node, depth of every pair within depth steps of a hierarchy (a forest)."""
    step = links.select(F.col(parent).alias("ancestor"), F.col(child).alias("node")).distinct()
    found = front = step.withColumn("depth", F.lit(1))
    for k in range(2, depth + 1):
        front = front.select("ancestor", F.col("node").alias("_mid")).join(step.select(F.col("ancestor").alias("_mid"), "node"), "_mid").select("ancestor", "node", F.lit(k).alias("depth"))
        found = found.unionByName(front)
    return found


def paths(nodes: DataFrame, depth: int, key: str = "id", parent: str = "parent_id", name: str = "name") -> DataFrame:
    """id and path /root/.../name of every node that reaches a root within depth steps."""
    base = nodes.select(F.col(key).alias("id"), F.col(parent).alias("up"), F.col(name).alias("name"))
    level = base.where("up IS NULL").select("id", F.concat(F.lit("/"), "name").alias("path"))
    found = level
    for _ in range(depth):
        level = base.join(level.select(F.col("id").alias("up"), F.col("path").alias("above")), "up").select("id", F.concat("above", F.lit("/"), "name").alias("path"))
        found = found.unionByName(level)
    return found


def nearest_set(nodes: DataFrame, value: str, depth: int, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """id and its own value, or the nearest ancestor's that has one."""
    rows = nodes.select(F.col(key).alias("id"), F.col(value).alias("value"), F.col(parent).alias("up"))
    base = rows.select(F.col("id").alias("up"), F.col("value").alias("_v"), F.col("up").alias("_up"))
    for _ in range(depth):
        rows = rows.join(base, "up", "left").select("id", F.coalesce("value", "_v").alias("value"), F.when(F.col("value").isNull(), F.col("_up")).alias("up"))
    return rows.select("id", "value")


def components(edges: DataFrame, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """node and component: the least node each node of an edge reaches.

    Rounds of joins that hang every node's neighbours below the least of them, then shorten the chains,
    until nothing changes; each round is a grouped minimum and a join, written once."""
    links = written(edges.where(F.col(source) != F.col(target)).select(F.greatest(source, target).alias("hi"), F.least(source, target).alias("lo")).distinct(), "links")
    before = None
    while (now := links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()) != before and now[0]:
        before = now
        both = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = written(both.where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct(), "large")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo")))
        links = written(small.where("hi <> lo").distinct(), "links")
    own = links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))
    return own.unionByName(own.select(F.col("component").alias("node"), "component").distinct())


def distances(edges: DataFrame, start, rounds: int, source: str = "source_id", target: str = "target_id", cost: str = "cost") -> DataFrame:
    """node and distance: the cheapest undirected path from start of at most `rounds` edges.

    Every round relaxes the edges of the nodes that the last one improved, by a join and a grouped minimum;
    it ends early when nothing improves."""
    both = edges.select(F.col(source).alias("node"), F.col(target).alias("_to"), cost).unionByName(edges.select(F.col(target).alias("node"), F.col(source).alias("_to"), cost))
    both = written(both.groupBy("node", "_to").agg(F.min(cost).alias("_cost")), "relaxed")
    known = front = edges.sparkSession.createDataFrame([(start, 0.0)], "node string, distance double")
    for _ in range(rounds):
        tried = front.join(both, "node").groupBy(F.col("_to").alias("node")).agg(F.min(F.col("distance") + F.col("_cost")).alias("new"))
        better = tried.join(known, "node", "left").where(F.col("distance").isNull() | (F.col("new") < F.col("distance") - 1e-12))
        front = written(better.select("node", F.col("new").alias("distance")), "front")
        if front.isEmpty():
            break
        known = written(known.join(front.select("node"), "node", "left_anti").unionByName(front), "known")
    return known


def flattened(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows with act_no, the place of their group among the groups, and chapter, their place within it. Groups are ranked
    among themselves, a row each, and joined back, so that no window holds all rows."""
    groups = rows.select(group).distinct().withColumn("act_no", F.row_number().over(Window.orderBy(group)))
    within = rows.withColumn("chapter", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    return within.join(groups, group)
