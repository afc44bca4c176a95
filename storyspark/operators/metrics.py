"""Document metrics: words, sentences, syllables, readability, sentence-length flow. Columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentence-length ranges (name, greatest number of words) and reading levels (grade below, name).
RANGES = (("1", 1), ("2-6", 6), ("7-15", 15), ("16-25", 25), ("26-39", 39), ("40+", None))
LEVELS = ((1, "Kindergarten"), (6, "1st-5th Grade"), (9, "6th-8th Grade"), (13, "9th-12th Grade"), (17, "College Level"), (None, "Graduate Level"))


def words(text) -> Column:
    clean = F.regexp_replace(text, r"[^0-9A-Za-z_\s'-]", " ")
    return F.filter(F.split(clean, r"\s+"), lambda w: w != "")


def sentences(text) -> Column:
    return F.filter(F.transform(F.split(text, "[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def paragraphs(text) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def syllables(word) -> Column:
    w = F.lower(word)
    bare = F.regexp_replace(F.regexp_replace(w, "(?:[^laeiouy]es|ed|[^laeiouy]e)$", ""), "^y", "")
    return F.when(F.length(w) <= 3, 1).otherwise(F.greatest(F.regexp_count(bare, F.lit("[aeiouy]{1,2}")), F.lit(1)))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def sentence_lengths(text) -> Column:
    return F.transform(sentences(text), lambda s: F.size(words(s)))


def range_of(n: Column) -> Column:
    """Name of a sentence's length range; no words at all count as 2-6."""
    out = F.when(n == 1, RANGES[0][0])
    for name, most in RANGES[1:-1]:
        out = out.when(n <= most, name)
    return out.otherwise(RANGES[-1][0])


def runs(lengths: Column) -> Column:
    """struct(run, best, hits): the last run of similar lengths (3 words apart at most), the longest, and
    how many sentences stand third or later in one."""
    start = F.struct(F.lit(0).alias("at"), F.lit(1).alias("run"), F.lit(1).alias("best"), F.lit(0).alias("hits"), F.lit(0).alias("before"))

    def step(s, n):
        run = F.when(s["at"] == 0, 1).when(F.abs(n - s["before"]) <= 3, s["run"] + 1).otherwise(1)
        return F.struct((s["at"] + 1).alias("at"), run.alias("run"), F.greatest(s["best"], run).alias("best"), (s["hits"] + F.when(run >= 3, 1).otherwise(0)).alias("hits"), n.alias("before"))

    return F.aggregate(lengths, start, step)


def counts_by_range(lengths: Column) -> list[Column]:
    def within(name: str) -> Column:
        return F.size(F.filter(lengths, lambda n: range_of(n) == name))

    return [within(name) for name, _ in RANGES]


def variety(counts: list[Column], total: Column) -> Column:
    """Entropy of the ranges in use, as a share of its greatest value, in per cent."""
    used = sum((F.when(c > 0, 1).otherwise(0) for c in counts), F.lit(0))
    entropy = sum((F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(0.0) for c in counts), F.lit(0.0))
    return F.when((total == 0) | (used <= 1), 0).otherwise(half_up(F.round(entropy / F.log2(used) * 100, 9))).cast("int")


def reading_level(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    grade = 0.39 * n_words / n_sentences + 11.8 * n_syllables / n_words - 15.59
    out = F.when((n_words == 0) | (n_sentences == 0), "N/A")
    for below, name in LEVELS[:-1]:
        out = out.when(grade < below, name)
    return out.otherwise(LEVELS[-1][1])


def deviation(numbers: Column) -> Column:
    """Population standard deviation of an array; 0 for an empty one."""
    n = F.size(numbers)
    mean = F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x) / n
    return F.when(n == 0, 0.0).otherwise(F.sqrt(F.aggregate(numbers, F.lit(0.0), lambda s, x: s + F.pow(x - mean, F.lit(2.0))) / n))


def text_metrics(docs: DataFrame, text: str, key: str = "id") -> DataFrame:
    """One row per row of docs with all metrics of its text; null counts as empty."""
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    rows = rows.select(
        key,
        F.length("_t").alias("characters"),
        F.length(F.regexp_replace("_t", r"\s", "")).alias("characters_no_spaces"),
        words("_t").alias("_w"),
        sentence_lengths("_t").alias("_l"),
        F.size(paragraphs("_t")).alias("paragraphs"),
    )
    rows = rows.select(
        "*",
        F.size("_w").alias("words"),
        F.size("_l").alias("sentences"),
        F.aggregate("_w", F.lit(0), lambda s, w: s + syllables(w)).alias("syllables"),
        runs(F.col("_l")).alias("_r"),
        deviation(F.col("_l")).alias("_sd"),
        *[c.alias(f"_c{i}") for i, c in enumerate(counts_by_range(F.col("_l")))],
    )
    counts = [F.col(f"_c{i}") for i in range(len(RANGES))]
    rows = rows.withColumn("variety", variety(counts, F.col("sentences")))
    most = F.greatest(*counts)
    dominant = F.coalesce(*[F.when(c == most, name) for c, (name, _) in zip(counts, RANGES, strict=True)])
    flow = half_up(F.round(F.least(F.lit(100.0), F.col("_sd") / 8 * 100) * 0.6 + F.col("variety") * 0.4, 9))
    reading, speaking = F.ceil(F.col("words") * 60 / 225), F.ceil(F.col("words") * 60 / 150)
    return rows.select(
        key, "characters", "characters_no_spaces", "words", "sentences", "paragraphs", "syllables",
        reading_level(F.col("words"), F.col("sentences"), F.col("syllables")).alias("reading_level"),
        reading.cast("int").alias("reading_seconds"),
        speaking.cast("int").alias("speaking_seconds"),
        F.when(F.col("sentences") > 0, half_up(F.col("words") * 10 / F.col("sentences")) / 10).otherwise(0.0).alias("mean_sentence"),
        F.round("_sd", 6).alias("deviation"),
        F.when(F.col("sentences") > 0, flow).otherwise(0).cast("int").alias("flow"),
        F.col("_r.hits").alias("consecutive"), (F.col("_r.best") >= 5).alias("monotony"), "variety", dominant.alias("dominant"),
    )
