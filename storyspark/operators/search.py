"""Exact substring search with BM25-like, coverage and proximity scores.

A query is parsed on the driver into a few clauses; each becomes a pair of columns (frequency, segment
mask) of one projection, so a search is a scan, a one-row aggregate for the statistics, and a bounded
top-k. All of it stays in generated code on the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENTS = 32
GRAM = 3


@dataclass(frozen=True)
class Clause:
    pattern: str
    phrase: bool = False


@dataclass(frozen=True)
class Settings:
    """Defaults of the search: saturation, length weight, coverage power and floor, proximity."""

    k1: float = 1.2
    b: float = 0.75
    coverage_power: float = 3.0
    coverage_floor: float = 0.1
    phrases_required: bool = True
    proximity: float = 0.5
    decay: float = 0.1
    constant_decay: bool = False
    weights: dict = field(default_factory=dict)


def parse(text: str) -> list[Clause]:
    """Words and "phrases", lower-cased; what follows a quote that is never closed is one word clause."""
    clauses = []
    for quoted, opened, word in re.findall(r'"([^"]*)"|"([^"]*)$|([^\s"]+)', text):
        body = quoted or opened or word
        if body:
            clauses.append(Clause(body.lower(), bool(quoted)))
    return clauses


def grams(pattern: str, q: int = GRAM) -> list[str]:
    return list(dict.fromkeys(pattern[i : i + q] for i in range(len(pattern) - q + 1)))


def gram_column(text: str, q: int = GRAM) -> Column:
    """Every q-gram of lower-cased text, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{q}}}))"), 1)


def frequency(text: Column, pattern: str) -> Column:
    """Occurrences of pattern in text, overlapping ones too."""
    return F.regexp_count(text, F.lit(f"(?=\\Q{pattern}\\E)"))


def segment_mask(text: Column, pattern: str, segments: int = SEGMENTS) -> Column:
    """Bit s is set where an occurrence begins in the s-th of equal segments of the text.

    The text is cut before every occurrence (also overlapping ones) and the pieces' lengths add up to the
    places, so the work is one pass over the text and a step per occurrence."""
    zero = F.lit(0).cast("bigint")
    # every piece but the first begins with an occurrence; the length and the first are taken once
    start = F.struct(zero.alias("at"), zero.alias("mask"), F.length(text).cast("bigint").alias("n"), F.startswith(text, F.lit(pattern)).alias("first"))

    def step(s, piece):
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.floor(s["at"] * segments / s["n"]).cast("int"))
        here = F.when((s["at"] > 0) | s["first"], bit).otherwise(zero)
        return F.struct((s["at"] + F.length(piece)).alias("at"), s["mask"].bitwiseOR(here).alias("mask"), s["n"].alias("n"), s["first"].alias("first"))

    return F.aggregate(F.split(text, f"(?=\\Q{pattern}\\E)"), start, step, lambda s: s["mask"])


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + F.greatest(F.lit(0.0), (n - df + 0.5) / (df + 0.5)))


def saturate(score: Column, k1: float) -> Column:
    return F.when(score <= 0, 0.0).otherwise((k1 + 1) * score / (k1 + score))


def length_normal(tf: Column, length: Column, mean: Column, b: float) -> Column:
    return tf / (1 - b + b * length / F.when(mean > 0, mean).otherwise(100.0))


def statistics(docs: DataFrame, fields: list[str], clauses: list[Clause]) -> DataFrame:
    """One row: rows, mean length of each field and of all, and the document frequency of each gram."""
    wanted = list(dict.fromkeys(g for c in clauses for g in grams(c.pattern)))
    has = lambda g: reduce(lambda x, y: x | y, [F.contains(F.col(f), F.lit(g)) for f in fields])
    length = lambda f: F.coalesce(F.length(f), F.lit(0))
    return docs.select(*[F.lower(f).alias(f) for f in fields]).agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        *[(F.sum(length(f)) / F.count(F.lit(1))).alias(f"_mean_{f}") for f in fields],
        *[F.sum(F.when(has(g), 1).otherwise(0)).cast("double").alias(f"_df{i}") for i, g in enumerate(wanted)],
    ).select("*", *[F.lit(0.0).alias("_none")])


def search(docs: DataFrame, query: str, k: int | None, fields: list[str], settings: Settings = Settings(), key: str = "id", scope: Column | None = None) -> DataFrame:
    """The k best rows (all with k None): key, score, coverage. Ties by key.

    Statistics are of all rows; scope, a condition, limits what is scored. A row without any clause is
    no result, nor, unless settings say otherwise, one that lacks a phrase. An empty query finds nothing."""
    clauses = parse(query)
    if not clauses:
        return docs.select(key, F.lit(0.0).alias("score"), F.lit(0.0).alias("coverage")).limit(0)
    wanted = list(dict.fromkeys(g for c in clauses for g in grams(c.pattern)))
    rows = docs if scope is None else docs.where(scope)
    rows = rows.select(key, *[F.lower(f).alias(f) for f in fields])
    # candidates first: contains() is cheap and drops most rows before frequencies and masks are counted
    meets = [reduce(lambda x, y: x | y, [F.contains(f, F.lit(c.pattern)) for f in fields]) for c in clauses]
    rows = rows.where(reduce(lambda x, y: x | y, meets))
    if settings.phrases_required:
        for c, met in zip(clauses, meets, strict=True):
            if c.phrase:
                rows = rows.where(met)
    rows = rows.crossJoin(F.broadcast(statistics(docs, fields, clauses)))  # one row
    for i, c in enumerate(clauses):
        star = [
            settings.weights.get(f, 1.0) * length_normal(F.coalesce(frequency(F.col(f), c.pattern), F.lit(0)), F.coalesce(F.length(f), F.lit(0)), F.col(f"_mean_{f}"), settings.b)
            for f in fields
        ]
        own = [idf(F.col("_n"), F.col(f"_df{wanted.index(g)}")) for g in grams(c.pattern)]
        best = F.greatest(*own) if len(own) > 1 else own[0] if own else F.lit(0.0)
        rows = rows.withColumn(f"_star{i}", reduce(lambda x, y: x + y, star)).withColumn(f"_idf{i}", F.when(best == 0, 1.0).otherwise(best))
        if len(clauses) > 1:
            masks = [F.coalesce(segment_mask(F.col(f), c.pattern), F.lit(0)) for f in fields]
            rows = rows.withColumn(f"_mask{i}", reduce(lambda x, y: x.bitwiseOR(y), masks))
    hit = [F.col(f"_star{i}") > 0 for i in range(len(clauses))]
    matched = reduce(lambda x, y: x + y, [h.cast("int") for h in hit])
    base = reduce(lambda x, y: x + y, [F.when(h, F.col(f"_idf{i}") * saturate(F.col(f"_star{i}"), settings.k1)).otherwise(0.0) for i, h in enumerate(hit)])
    coverage = matched / len(clauses)
    score = base * F.pow(settings.coverage_floor + coverage, settings.coverage_power)
    if len(clauses) > 1:
        all_bits = F.lit((1 << SEGMENTS) - 1)
        common = reduce(lambda x, y: x.bitwiseAND(y), [F.when(h, F.col(f"_mask{i}")).otherwise(all_bits) for i, h in enumerate(hit)])
        length = reduce(lambda x, y: x + y, [F.coalesce(F.length(f), F.lit(0)) for f in fields])
        mean = reduce(lambda x, y: x + y, [F.col(f"_mean_{f}") for f in fields])
        ratio = F.lit(1.0) if settings.constant_decay else F.when(mean > 0, length / mean).otherwise(1.0)
        near = 1 + settings.proximity * F.bit_count(common) / F.least(matched, F.lit(SEGMENTS)) * F.exp(-settings.decay * ratio)
        score = score * F.when(matched > 1, near).otherwise(1.0)
    found = rows.select(key, F.round(score, 6).alias("score"), F.round(coverage, 6).alias("coverage"))
    return found if k is None else found.orderBy(F.desc("score"), key).limit(k)


def postings(docs: DataFrame, text: str, key: str = "id", q: int = GRAM) -> DataFrame:
    """gram, key, tf, length, mask of every q-gram of every row."""
    n = F.length(text)
    rows = docs.select(key, n.cast("bigint").alias("length"), F.posexplode(gram_column(text, q)).alias("pos", "gram"))
    bit = F.expr(f"shiftleft(1L, cast(pos * {SEGMENTS} div length as int))")
    return rows.groupBy("gram", key, "length").agg(F.count(F.lit(1)).alias("tf"), F.bit_or(bit).alias("mask"))


def rarest_grams(posted: DataFrame, pattern: str, most: int, key: str = "id", limit: int | None = None) -> DataFrame:
    """gram and df of the pattern's `most` rarest grams; only the rarest, if even its df exceeds limit."""
    own = posted.where(F.col("gram").isin(grams(pattern))).groupBy("gram").agg(F.count_distinct(key).alias("df"))
    first = own.orderBy("df", "gram").limit(most)
    if limit is None:
        return first
    least = first.agg(F.min(F.struct("df", "gram")).alias("m")).select("m.df", "m.gram")
    return first.join(F.broadcast(least.select(F.col("gram").alias("_g"), F.col("df").alias("_d"))), (F.col("_d") <= limit) | (F.col("gram") == F.col("_g"))).select("gram", "df")
