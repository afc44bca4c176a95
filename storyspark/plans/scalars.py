"""Registered scalar functions, calendars and Steiner trees."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalars as op
from ..operators import steiner
from ..operators.graphs import distances
from .registry import query

CAL = op.Calendar([(30, None), (28, (4, 1, 100)), (31, None), (30, None), (31, None), (30, None), (31, None), (30, None), (31, None), (30, None), (31, None), (32, None)], 6, [(-10, -1, "BE"), (0, 3, "AE"), (4, None, "NE")])
MONTHS = [d for d, _ in CAL.months]
FEB = "CASE WHEN y % 4 = 0 AND y % 100 <> 0 THEN 29 ELSE 28 END"
BEFORE = " + ".join(f"CASE WHEN m > {i} THEN {FEB if i == 1 else d} ELSE 0 END" for i, d in enumerate(MONTHS))
PLAIN = " + ".join(f"CASE WHEN m > {i} THEN {d} ELSE 0 END" for i, d in enumerate(MONTHS))
Y, M, D = (lambda: F.col("y")), (lambda: F.col("m")), (lambda: F.col("d"))

query("cal_days_in_year", lambda m: m.calendar.select("y").distinct().select("y", CAL.days_in_year(Y()).alias("n")), f"SELECT DISTINCT y, {sum(MONTHS) - 28} + {FEB} AS n FROM calendar")
query("cal_weekday", lambda m: m.calendar.select("id", CAL.weekday(Y(), M(), D()).alias("w")), f"SELECT id, CAST(({BEFORE} + d) % 6 AS INT) AS w FROM calendar")
query("cal_moon", lambda m: m.calendar.select("id", F.round(CAL.moon_phase(M(), D(), 28.5, 0.25), 6).alias("p")), f"SELECT id, round(fmod(({PLAIN} + d) / 28.5 + 0.25, 1), 6) AS p FROM calendar")
query("cal_format", lambda m: m.calendar.select("id", CAL.formatted(Y() - 4).alias("t")), "SELECT id, abs(y - 4) || CASE WHEN y - 4 BETWEEN -10 AND -1 THEN ' BE' WHEN y - 4 BETWEEN 0 AND 3 THEN ' AE' WHEN y - 4 >= 4 THEN ' NE' ELSE '' END AS t FROM calendar")
query("cal_turn", lambda m: m.calendar.select("y").distinct().select("y", CAL.turned(Y() - 2, 1).alias("up"), CAL.turned(Y() - 2, -1).alias("down")), "SELECT DISTINCT y, CASE WHEN y - 1 = 0 THEN 1 ELSE y - 1 END AS up, CASE WHEN y - 3 = 0 THEN -1 ELSE y - 3 END AS down FROM calendar")
query("math_scaled_stat", lambda m: m.entities.select("id", op.scaled_stat(F.col("price"), F.col("mentions")).alias("v")), "SELECT id, CAST(floor(CASE WHEN mentions <= 1 THEN price ELSE price * (1 + 0.5 * pow(mentions - 1, 0.6)) END + 0.5) AS BIGINT) AS v FROM entities")
query("math_noisy_or", lambda m: m.edges.select("id", F.round(op.noisy_or(F.col("confidence"), F.lit(0.3)), 6).alias("v")), "SELECT id, round(confidence + 0.3 - confidence * 0.3, 6) AS v FROM edges")
YEAR = f"{2 * math.pi} * sqrt(pow(price / 1000 * {op.UNIT}, 3) / ({op.GRAVITY * op.SUN} * (0.5 + mentions / 50))) / 86400"
mass, distance = (lambda: 0.5 + F.col("mentions") / 50), (lambda: F.col("price") / 1000)
query("orb_year", lambda m: m.entities.select("id", F.round(op.year_length(mass(), distance()), 4).alias("v")), f"SELECT id, round({YEAR}, 4) AS v FROM entities")
query("orb_zone", lambda m: m.entities.select("id", op.habitable_zone(mass()).alias("z")).select("id", F.round("z.least", 6).alias("a"), F.round("z.most", 6).alias("b")), "SELECT id, round(sqrt(pow(0.5 + mentions / 50, 3.5)) * 0.95, 6) AS a, round(sqrt(pow(0.5 + mentions / 50, 3.5)) * 1.37, 6) AS b FROM entities")
query("orb_week", lambda m: m.entities.select("id", op.week_length(F.col("mentions") * 15).alias("w")), "SELECT id, CASE WHEN mentions * 15 < 100 THEN 5 WHEN mentions * 15 < 400 THEN 7 WHEN mentions * 15 < 600 THEN 8 ELSE 10 END AS w FROM entities")
query("orb_calendar", lambda m: m.entities.select("id", op.orbital_calendar(mass(), distance(), F.lit(20.0)).alias("c")).select("id", "c.days", "c.week", "c.months"), f"SELECT id, days, CASE WHEN days < 100 THEN 5 WHEN days < 400 THEN 7 WHEN days < 600 THEN 8 ELSE 10 END AS week, CASE WHEN days <= 100 THEN 10 ELSE 12 END AS months FROM (SELECT id, CAST(floor({YEAR} * 24 / 20.0) AS BIGINT) AS days FROM entities)")
# labels are of the basic plane, where characters are code units
HASH = "list_reduce(list_prepend(CAST({1} AS BIGINT), [CAST(unicode(c) AS BIGINT) FOR c IN string_split(label, '')]), lambda h, c: (h * {0} + c) & 4294967295)"
query("str_djb2", lambda m: m.entities.select("label", op.djb2("label").alias("h")), f"SELECT label, format('{{:x}}', {HASH.format(33, 5381)}) AS h FROM entities")
query("str_hash31", lambda m: m.entities.select("label", op.hash31("label").alias("h")), f"SELECT label, CAST(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS INT) AS h FROM (SELECT label, {HASH.format(31, 0)} AS h FROM entities)")


def network(m):
    edges = m.edges.where("confidence >= 1.0 AND rel_type = 'AO'").select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.greatest(F.lit(0.01), 1 - F.col("confidence")).alias("cost"))
    prizes = m.entities.where("mentions >= 46").select("id", F.lit(0.5).alias("prize"))
    return edges, prizes


query("graph_pcst", lambda m: steiner.steiner(*network(m)))
query("graph_pcst_cost", lambda m: steiner.steiner(*network(m)).groupBy("component").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("cost"), 6).alias("cost")))
query("graph_ipcst", lambda m: steiner.steiner(*network(m), solver=lambda i: steiner.solve(i, beta=3.0, depth=4)).groupBy("component").agg(F.count(F.lit(1)).alias("edges")))
query("graph_gw", lambda m: steiner.steiner(*network(m), solver=steiner.grown_only, reduce=False))
query("graph_gw_prune", lambda m: steiner.steiner(*network(m), solver=steiner.grown_only, reduce=False).groupBy("source").agg(F.count(F.lit(1)).alias("n")))
query("graph_mst_steiner", lambda m: steiner.steiner(*network(m), solver=steiner.joined_only).groupBy("component").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("cost"), 6).alias("cost")))
COST = "round(greatest(0.01, 1.0 - confidence), 2)"
query(
    "graph_dijkstra",
    lambda m: distances(m.edges.where("weight > 1").withColumn("cost", F.round(F.greatest(F.lit(0.01), 1 - F.col("confidence")), 2)), "p10", 4).withColumn("distance", F.round("distance", 6)),
    f"""WITH RECURSIVE e AS (SELECT a, b, min(c) AS c FROM (SELECT source_id AS a, target_id AS b, {COST} AS c FROM edges WHERE weight > 1 UNION ALL SELECT target_id, source_id, {COST} FROM edges WHERE weight > 1) GROUP BY a, b),
        walk(node, d, n) AS (SELECT 'p10', CAST(0.0 AS DOUBLE), 0 UNION SELECT b, round(d + c, 6), n + 1 FROM walk JOIN e ON a = node WHERE n < 4) SELECT node, min(d) AS distance FROM walk GROUP BY node""",
)
