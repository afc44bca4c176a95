"""Ranking of term postings: BM25 with entropy, segment proximity, phrase and similarity boosts, and a mix
with vector similarity. Postings are long rows (term, id, field, tf, field_len, mask)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import SEGMENTS, saturate

WORDS = "[^0-9a-z_]+"


def tokens(text) -> Column:
    """Lower-case words of ASCII letters, digits and underscores."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), WORDS, " "), " "), lambda w: w != "")


def index(docs: DataFrame, fields: dict[str, Column], key: str = "id") -> DataFrame:
    """Postings of every field; mask bit floor(32 i / length) is set for a term at place i."""
    rows = None
    for name, words in fields.items():
        one = docs.select(key, F.lit(name).alias("field"), words.alias("_w"))
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.select(key, "field", F.size("_w").cast("bigint").alias("field_len"), F.posexplode("_w").alias("pos", "term"))
    bit = F.expr(f"shiftleft(1L, cast(pos * {SEGMENTS} div field_len as int))")
    return rows.groupBy("term", key, "field", "field_len").agg(F.count(F.lit(1)).alias("tf"), F.bit_or(bit).alias("mask"))


def idf(n, df) -> Column:
    return F.when(df == 0, 0.0).otherwise(F.log(1 + F.greatest(F.lit(0.0), (n - df + 0.5) / (df + 0.5))))


def normal_tf(tf: Column, length: Column, mean: Column, b: float, entropy=0.0, gamma=0.0) -> Column:
    below = 1 - b + b * length / mean + gamma * entropy
    return F.when((mean <= 0) | (tf == 0) | (below <= 0), 0.0).otherwise(tf / below)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def adaptive_segments(length: Column, per_segment: int = 50) -> Column:
    return F.least(F.lit(32), F.greatest(F.lit(8), F.ceil(length / per_segment)))


def adaptive_alpha(mean_length: Column) -> Column:
    return F.least(F.lit(1.5), F.greatest(F.lit(0.5), mean_length / 100))


def beta(n: Column) -> Column:
    return F.when(n <= 0, 1.0).otherwise(1 / F.log(1.0 + n))


def normalized(score: Column, query_length: int, n: Column) -> Column:
    return F.when(n <= 0, 0.0).otherwise(score / (query_length * (F.log(1 + (n - 0.5) / 1.5) + 1)))


def remapped(mask: Column, before: int, after: int) -> Column:
    """The mask's bits moved from `before` segments to `after`."""
    out = F.lit(0).cast("bigint")
    for i in range(before):
        to = i * after // before
        if to < 32:
            out = out.bitwiseOR(F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(1 << to)).otherwise(F.lit(0)).cast("bigint"))
    return mask if before == after else out


def term_scores(postings: DataFrame, terms: list[str], key: str = "id", k1: float = 1.2, b: float = 0.75, weights: dict | None = None, entropy: bool = False) -> DataFrame:
    """key, term, place (in the query), idf, score, mask of every posting of the query's terms.

    Field lengths average over all rows of the corpus, those without the field too. With entropy the mean
    normalised entropy of the terms widens the length norm by half of k1."""
    weights = weights or {}
    lengths = postings.select(key, "field", "field_len").distinct().groupBy("field").agg(F.sum("field_len").alias("sum"))
    n = postings.agg(F.count_distinct(key).cast("double").alias("n"))
    means = lengths.crossJoin(F.broadcast(n)).select("field", "n", (F.col("sum") / F.col("n")).alias("mean"))  # n is one row
    own = postings.where(F.col("term").isin(terms))
    df = own.groupBy("term").agg(F.count_distinct(key).cast("double").alias("df"))
    rows = own.join(F.broadcast(df), "term").join(F.broadcast(means), "field")  # one row per term, per field
    if entropy:
        rows = rows.crossJoin(F.broadcast(term_entropy(own, key).agg((F.sum("normalized") / len(terms)).alias("spread"))))
    weight = F.lit(1.0)
    for name, w in weights.items():
        weight = F.when(F.col("field") == name, w).otherwise(weight)
    star = F.sum(weight * normal_tf(F.col("tf"), F.col("field_len"), F.col("mean"), b, F.col("spread") if entropy else 0.0, k1 / 2 if entropy else 0.0))
    found = rows.groupBy(key, "term").agg(star.alias("star"), F.first(idf(F.col("n"), F.col("df"))).alias("idf"), F.bit_or("mask").alias("mask"), F.first("n").alias("n"))
    place = F.array_position(F.array(*map(F.lit, terms)), F.col("term"))
    return found.select(key, "term", place.alias("place"), "idf", (F.col("idf") * saturate(F.col("star"), k1)).alias("score"), "mask", "n")


def term_entropy(postings: DataFrame, key: str = "id") -> DataFrame:
    """term, entropy, normalized (by the greatest): sum of -p ln p over rows, p the logistic of the term's
    frequency in all fields capped at ten."""
    p = sigmoid(F.least(F.sum("tf"), F.lit(10)).cast("double"))
    each = postings.groupBy("term", key).agg(p.alias("p"))
    raw = each.groupBy("term").agg(F.sum(F.when((F.col("p") > 1e-6) & (F.col("p") < 0.999999), -F.col("p") * F.log("p")).otherwise(0.0)).alias("entropy"))
    top = raw.agg(F.greatest(F.max("entropy"), F.lit(1e-9)).alias("top"))
    return raw.crossJoin(F.broadcast(top)).select("term", "entropy", (F.col("entropy") / F.col("top")).alias("normalized"))  # one row


def ranked(scores: DataFrame, terms: int, key: str = "id", near: str = "idf", alpha: float = 0.5, decay: float = 0.1, scale: float = 5.0, lengths: DataFrame | None = None, phrase: float | None = None) -> DataFrame:
    """key, score, matched from term_scores, times the proximity named by near:

    global: overlap of all terms' segments; idf: the same, more for rare terms; pair: mean pairwise
    overlap; term: each term with those before it in the query; none. lengths (key, length, ratio to the
    mean) damps global and idf. phrase multiplies rows whose terms stand in adjacent segments in order."""
    bits = F.bit_count(F.expr("bit_and(mask)"))
    matched = F.count(F.lit(1))
    if near == "term":
        before = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        scores = scores.withColumn("_prior", F.collect_list("mask").over(before))
        shared = F.aggregate("_prior", F.lit(0), lambda s, x: s + F.bit_count(x.bitwiseAND(F.col("mask"))))
        boost = F.when(F.size("_prior") > 0, 1 + alpha * shared / F.size("_prior") / SEGMENTS).otherwise(1.0)
        scores = scores.withColumn("score", F.col("score") * boost)
    ordered = F.sort_array(F.collect_list(F.struct("place", "mask")))
    rows = scores.groupBy(key).agg(F.sum("score").alias("base"), matched.alias("matched"), bits.alias("bits"), F.avg("idf").alias("idf"), ordered.alias("own"))
    rows = rows.join(lengths, key) if lengths is not None else rows.withColumn("ratio", F.lit(1.0))
    overlap = F.col("bits") / F.least(F.col("matched"), F.lit(SEGMENTS)) * F.exp(-decay * F.col("ratio"))
    if near == "global":
        boost = 1 + alpha * overlap
    elif near == "idf":
        boost = 1 + alpha * overlap * (1 + F.col("idf") / scale)
    elif near == "pair":
        pairs = F.flatten(F.transform("own", lambda x: F.transform(F.filter("own", lambda y: y["place"] > x["place"]), lambda y: F.bit_count(x["mask"].bitwiseAND(y["mask"])))))
        boost = 1 + alpha * F.aggregate(pairs, F.lit(0), lambda s, x: s + x) / SEGMENTS / F.size(pairs)
    else:
        boost = F.lit(1.0)
    score = F.col("base") * F.when(F.col("matched") > 1, boost).otherwise(1.0)
    if phrase is not None:
        steps = F.transform(F.sequence(F.lit(1), F.lit(terms - 1)), lambda i: F.shiftleft(F.get("own", i - 1)["mask"], 1).bitwiseAND(F.get("own", i)["mask"]).bitwiseAND(F.lit((1 << SEGMENTS) - 1)) != 0)
        score = score * F.when((F.col("matched") == terms) & F.forall(steps, lambda x: x), phrase).otherwise(1.0)
    return rows.select(key, score.alias("score"), "matched")


def mixed(text: Column, cosine: Column, share: float) -> Column:
    return (1 - share) * F.coalesce(text, F.lit(0.0)) + share * 20 * F.greatest(F.lit(0.0), F.coalesce(cosine, F.lit(0.0)))


def overlay(frozen: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Postings of both layers; the fresh one wins where both have the keys."""
    return fresh.unionByName(frozen.join(fresh.select(*keys).distinct(), keys, "left_anti"))
