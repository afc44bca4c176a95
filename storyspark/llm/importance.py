"""Importance resampling of documents towards a target distribution, by hashed word features.

Both corpora become histograms over a fixed number of buckets; a bucket's gain is the log ratio of its smoothed
shares. The gains are one array, small whatever the corpus, so every document is scored where it lies: the mean
gain of its features plus Gumbel noise of its own. The highest scores are a sample without replacement that
follows the target; a distributed radix sort (radix.py) ranks them.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, materialize, table
from .radix import ranked

BUCKETS = 10_000
MAX_RUN = 1
SCALE = 1000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Features whose buckets a task remembers before it starts anew; no result depends on it.
KNOWN_FEATURES = 1 << 18
#: Letters and digits stay (A-Z lower-cased) and all bytes of other scripts; the rest parts words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


class Buckets(dict):
    """Bucket of each feature: its unsigned crc32 modulo their number."""

    def __init__(self, count: int):
        super().__init__()
        self.count = count

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN_FEATURES:
            self.clear()
        out = self[feature] = zlib.crc32(feature) % self.count
        return out

    def of(self, words: list[bytes], max_run: int) -> np.ndarray:
        """Buckets of all runs of 1 to max_run consecutive words."""
        runs = list(words)
        for k in range(2, max_run + 1):
            runs += [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
        return np.fromiter(map(self.__getitem__, runs), np.int64, len(runs))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def histogram(texts: DataFrame, buckets: int = BUCKETS, max_run: int = MAX_RUN) -> np.ndarray:
    """How many features of all whole texts (column text; null: none) fall into each bucket. A task sends one row
    a bucket at most, so the driver receives at most as many rows as there are buckets."""

    def run(batches):
        known, counts = Buckets(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column(0):
                np.add.at(counts, known.of(words_of(id_text([text.as_py()])[0]), max_run), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n bigint")
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * ln of the ratio of smoothed shares) of each bucket, target over source."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(scale * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED, scale: int = SCALE) -> int:
    """Gumbel noise of a document, the same in every run; a null doc_id has that of an empty name."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, max_run: int = MAX_RUN, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""

    def run(batches):
        known = Buckets(len(gain))
        for b in batches:
            made = []
            ids = b.column(0).to_pylist()
            for doc_id, text in zip(ids, b.column(1), strict=True):
                words = words_of(id_text([text.as_py()])[0])
                own = known.of(words, max_run)
                weight = int(gain[own].sum()) // len(own) if len(own) else 0
                made.append((len(words), len(own), weight, weight + noise(doc_id, seed, scale)))
            columns = zip(*made, strict=True) if made else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), pa.int64()) for c in columns)], ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, max_run: int = MAX_RUN, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; rank is null for what isn't drawn.

    Drawn are floor(percent of N / 100) of the N rows of at least least_words words, by descending score, ties to
    the smaller doc_id. Null and empty texts have no features, weight 0, and are never drawn unless least_words is
    0. Rows that repeat a doc_id each count and take ranks of their own, of equal score and doc_id in any order; a null doc_id goes before
    the others of its score. Empty tables, of docs or of targets, are fine; other columns are ignored.

    A score lies within some multiples of ln of the corpus's size, so its exact histogram is short (well under a
    million rows at any size); it names the score of the last drawn row. Only rows of that score or more are
    sorted, which is a tenth of them and not a sample: no other row could be drawn."""
    source, wanted = histogram(docs, buckets, max_run), histogram(target, buckets, max_run)
    rows = materialize(scored(docs, gains(source, wanted), max_run, seed=seed), "scored")
    open_ = F.col("n_words") >= least_words
    counts = sorted(((s, n) for s, n in rows.where(open_).groupBy("score").agg(F.count(F.lit(1))).collect()), reverse=True)
    draw = percent * sum(n for _, n in counts) // 100
    cut, reached = None, 0
    for score, n in counts:
        if reached >= draw:
            break
        cut, reached = score, reached + n
    columns = ["doc_id", "n_features", "weight", "score"]
    if cut is None:
        return rows.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    held = open_ & (F.col("score") >= cut)
    high = rows.where(held).select(*columns, (-F.col("score")).alias("_falling"))
    order = ranked(high, ["_falling", "doc_id"])
    drawn = order.select(*columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    return drawn.unionByName(rows.where(~held).select(*columns, F.lit(None).cast("bigint").alias("rank")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: crc32 goes over the hexadecimal digits of a word's bytes, the low one of each byte first, by a table of 16 that
#: follows from its polynomial.
ORACLE_OP13 = rf"""
WITH RECURSIVE steps AS (
    SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(16) t(i)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 4),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 4),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
words AS (SELECT r, unnest(ws) AS w FROM docs),
goal AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
known AS (SELECT DISTINCT w FROM (SELECT w FROM words UNION ALL SELECT w FROM goal)),
bucket AS (
    SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
        list_transform(range(2 * strlen(w)), lambda i: CAST(instr('0123456789ABCDEF', hex(w)[i + CASE WHEN i % 2 = 0 THEN 2 ELSE 0 END]) - 1 AS BIGINT))),
        lambda c, x: xor(c >> 4, t[(xor(c, x) & 15) + 1])), 4294967295) % 10000 AS b
    FROM known, crc),
s AS (SELECT b, count(*) AS n FROM words JOIN bucket USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM goal JOIN bucket USING (w) GROUP BY b),
gain AS (
    SELECT u.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM words) + 10000)
        / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM goal) + 10000)))) AS g
    FROM (SELECT DISTINCT b FROM bucket) u LEFT JOIN s ON s.b = u.b LEFT JOIN t ON t.b = u.b),
weights AS (
    SELECT r, floor(sum(g) / count(*)) AS weight FROM words JOIN bucket USING (w) JOIN gain USING (b) GROUP BY r),
scores AS (
    SELECT doc_id, len(ws) AS n, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substring(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM docs LEFT JOIN weights USING (r)),
ranks AS (
    SELECT *, CASE WHEN n >= 20 THEN row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) END AS rank FROM scores)
SELECT doc_id, n AS n_features, weight, score,
    CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM scores WHERE n >= 20) THEN rank END AS rank
FROM ranks"""
