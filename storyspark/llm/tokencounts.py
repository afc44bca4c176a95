"""Token counts from the exact histogram of encoded lengths.

Documents are aggregated by their number of tokens; suffix sums over the lengths then answer, without
another look at the texts, totals, quantiles, and the tokens left under every context limit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .packing import Encoder

#: Lengths per group of the two-level suffix sums, as a power of two.
GROUP_BITS = 10


def length_histogram(docs: DataFrame, encoder: Callable[[], Callable[[str], list[int]]] = Encoder) -> DataFrame:
    """n_tokens and n_docs: how many rows of docs encode to that many tokens. Null text counts as empty,
    rows may repeat, other columns are ignored, an empty table gives no rows. Each task sends one row per
    distinct length."""

    def run(batches):
        encode, counts = encoder(), Counter()
        for b in batches:
            counts.update(len(encode(text.as_py() or "")) for text in b.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["n_tokens", "n"])

    lengths = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n_tokens bigint, n bigint")
    return lengths.groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with docs_at_least and tokens_at_least (rows this long or longer, and their tokens),
    docs_at_most, total_docs, total_tokens, and truncated_tokens: what is left of the corpus when n_tokens
    is the context limit. Sums run within groups of neighbouring lengths, and over the groups' totals."""
    rows = materialize(histogram, "lengths").withColumn("group", F.shiftright("n_tokens", GROUP_BITS)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    down = Window.partitionBy("group").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.orderBy(F.desc("group")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("group")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    groups = rows.groupBy("group").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    groups = groups.select(
        "group",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(whole).alias("total_docs"),
        F.sum("t").over(whole).alias("total_tokens"),
    )
    summed = rows.select("*", F.sum("n_docs").over(down).alias("d"), F.sum("tokens").over(down).alias("t")).join(groups, "group")
    summed = summed.withColumn("docs_at_least", F.col("d") + F.col("docs_above")).withColumn("tokens_at_least", F.col("t") + F.col("tokens_above"))
    return summed.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_at_most"),
        "total_docs",
        "total_tokens",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
    )


def under_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_cut (longer rows), kept_tokens (of the corpus cut at limit) for any limits, read off the
    suffix sums of the smallest length above each."""
    first = [F.min(F.when(F.col("n_tokens") > x, F.struct("n_tokens", "docs_at_least", "tokens_at_least"))).alias(f"l{i}") for i, x in enumerate(limits)]
    row = sums.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("whole"), *first)
    each = [
        F.struct(
            F.lit(x).cast("bigint").alias("limit"),
            F.coalesce(F.col(f"l{i}.docs_at_least"), F.lit(0)).alias("docs"),
            F.coalesce(F.col(f"l{i}.tokens_at_least"), F.lit(0)).alias("tokens"),
        )
        for i, x in enumerate(limits)
    ]
    found = row.select("whole", F.explode(F.array(*each)).alias("x"))
    return found.select("x.limit", F.col("x.docs").alias("docs_cut"), (F.col("whole") - F.col("x.tokens") + F.col("x.limit") * F.col("x.docs")).alias("kept_tokens"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share and n_tokens: the smallest length that at least that share of the rows does not exceed."""
    row = sums.agg(*[F.min(F.when(F.col("docs_at_most") >= F.ceil(F.lit(s) * F.col("total_docs")), F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, s in enumerate(shares)])).alias("x")).select("x.*")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_suffix_sums(length_histogram(table(spark, sf_dir, "documents")))
