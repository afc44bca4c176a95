"""Aggregates over entities, edges, co-occurrence pairs and words. All combine partially before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    rows = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias(name))
        rows = one if rows is None else rows.crossJoin(one)  # one row each
    return rows


def js_round(x: Column) -> Column:
    """Half up, as JavaScript rounds."""
    return F.floor(x + 0.5)


def pair_weights(pairs: DataFrame) -> DataFrame:
    """a, b, weight, episodes and notes of co-occurring pairs (a, b, episode_id, note_id)."""
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"), F.count_distinct("episode_id").alias("episodes"), F.count_distinct("note_id").alias("notes"))


def pmi(weights: DataFrame, frequency: DataFrame) -> DataFrame:
    """ln(p(a,b) / (p(a) p(b))) of each pair; every share is of the total pair weight, and an item without
    a frequency (item, n) counts as one."""
    total = weights.agg(F.sum("weight").alias("total"))
    a, b = (frequency.select(F.col("item").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    rows = weights.join(a, "a", "left").join(b, "b", "left").crossJoin(F.broadcast(total))  # one row
    n = lambda x: F.coalesce(f"n_{x}", F.lit(1))
    return rows.select("a", "b", "weight", F.round(F.log(F.col("weight") * F.col("total") / (n("a") * n("b"))), 6).alias("pmi"))


def merged_weights(edges: DataFrame, how: str) -> DataFrame:
    """Edges (a, b, weight, pmi) of any direction as one per unordered pair: weight by sum, max or rounded
    average; mean PMI of those that have one."""
    weight = {"sum": F.sum("weight"), "max": F.max("weight"), "average": js_round(F.avg("weight"))}[how]
    rows = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight", "pmi")
    return rows.groupBy("a", "b").agg(weight.alias("weight"), F.round(F.avg("pmi"), 6).alias("pmi"))


def top_words(docs: DataFrame, text: str, stop_words: list[str], k: int) -> DataFrame:
    """The k most frequent words (lower-case ASCII word characters) outside stop_words, and their share of
    those words in per cent to one decimal. Ties in alphabetical order."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z_]+", " ")), " ")
    rows = docs.select(F.explode(words).alias("word")).where(F.length("word") > 0)
    counted = rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(~F.col("word").isin(stop_words))
    total = counted.agg(F.sum("n").alias("total"))
    first = counted.orderBy(F.desc("n"), "word").limit(k)
    return first.crossJoin(F.broadcast(total)).select("word", "n", (js_round(F.col("n") * 1000.0 / F.col("total")) / 10).alias("percent"))


def entropy_of(postings: DataFrame, term: str = "term", tf: str = "tf") -> DataFrame:
    """Per term the sum of -p ln p, p the logistic of its frequency capped at ten."""
    p = 1 / (1 + F.exp(-F.least(F.col(tf), F.lit(10))))
    return postings.groupBy(term).agg(F.round(F.sum(-p * F.log(p)), 6).alias("entropy"))


def next_order(df: DataFrame, column: str = "ord", step: int = 1000) -> DataFrame:
    return df.agg((F.coalesce(F.max(column), F.lit(0)) + step).alias("next"))


def candidate_status(counted: DataFrame, threshold: int = 2) -> DataFrame:
    return counted.withColumn("status", F.when(F.col("n") >= threshold, "promoted").otherwise("watching"))


def rank_in(partition: list[str], *order) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
