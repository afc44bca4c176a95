"""Language identification by hierarchical discrimination: family first, then one-versus-one linear
support vector machines between the languages of that family.

A text becomes the square roots of its relative byte bigram and trigram frequencies, hashed to a fixed
number of places. The machines minimise the squared hinge loss by accelerated gradient descent on a
bounded sample of labelled rows, so the model's size doesn't follow the data; prediction reads every
whole text and nothing else.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

UNKNOWN = "und"
PAIR_BITS, TRIPLE_BITS = 11, 13
PLACES = (1 << PAIR_BITS) + (1 << TRIPLE_BITS)
#: Labelled rows learned from, per language at most: the documented bound of the training sample.
SAMPLE_ROWS = 600
STEP = 1 << 20
LETTER = re.compile("[A-Za-z]")

# ISO 639-1 codes by family. A language not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg mk sr hr sl bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tk",
    "celtic": "ga cy br gd",
    "semitic": "ar he mt am",
    "indo_aryan": "hi bn ur mr ne pa gu",
    "baltic": "lt lv",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def has_letter(text: str) -> bool:
    return bool(LETTER.search(text)) or any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Unit vector of the whole text."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(PLACES)
    for at in range(0, len(data), STEP):
        x = data[at : at + STEP + 2].astype(np.uint32)
        pair = (x[:-1] << np.uint32(8) | x[1:])[:STEP]
        triple = x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]
        counts[: 1 << PAIR_BITS] += np.bincount((pair * np.uint32(2654435761)) >> np.uint32(32 - PAIR_BITS), minlength=1 << PAIR_BITS)
        counts[1 << PAIR_BITS :] += np.bincount((triple * np.uint32(2654435761)) >> np.uint32(32 - TRIPLE_BITS), minlength=1 << TRIPLE_BITS)
    total = counts.sum()
    return np.sqrt(counts / total).astype(np.float32) if total else counts.astype(np.float32)


def train_svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 120) -> np.ndarray:
    """Weights (the last is the intercept) that minimise the mean squared hinge loss; y is +1 or -1.
    Both classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = np.zeros(x.shape[1] + 1)
    ahead, step = w.copy(), 1 / (ridge + 4)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead[:-1].astype(np.float32) + ahead[-1]))
        pull = (-2 * weight * y * slack).astype(np.float32)
        gradient = np.append(pull @ x, pull.sum()) + ridge * ahead
        nxt = ahead - step * gradient
        ahead = nxt + k / (k + 3) * (nxt - w)
        w = nxt
    return w.astype(np.float32)


class Duel:
    """One-versus-one machines between the names of one level."""

    def __init__(self, names: list[str], x: np.ndarray, labels: np.ndarray):
        self.names = names
        self.pairs = list(combinations(range(len(names)), 2))
        self.weights = np.zeros((len(self.pairs), x.shape[1] + 1), np.float32)
        for k, (a, b) in enumerate(self.pairs):
            own = np.isin(labels, [names[a], names[b]])
            self.weights[k] = train_svm(x[own], np.where(labels[own] == names[a], 1.0, -1.0))

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner and its confidence: most duels won, ties by the sum of their margins."""
        if not self.pairs:
            return np.zeros(len(x), int), np.ones(len(x))
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        votes, sums = np.zeros((len(x), len(self.names))), np.zeros((len(x), len(self.names)))
        weakest = np.full((len(x), len(self.names)), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            for c, m in ((a, margin[:, k]), (b, -margin[:, k])):
                votes[:, c] += m >= 0 if c == a else m > 0
                sums[:, c] += m
                weakest[:, c] = np.minimum(weakest[:, c], m)
        best = (votes + sums / (1e6 + np.abs(sums))).argmax(1)
        return best, 1 / (1 + np.exp(-np.clip(4 * weakest[np.arange(len(x)), best], -30, 30)))


class LanguageModel:
    """The family level and, for each family, the level of its languages."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        family = np.array([FAMILY.get(c, c) for c in langs.tolist()])
        names = sorted(set(family.tolist()))
        self.top = Duel(names, x, family)
        self.within = [Duel(sorted(set(langs[family == f].tolist())), x[family == f], langs[family == f]) for f in names]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, sure = self.top.decide(x)
        out = np.empty(len(x), object)
        for k, level in enumerate(self.within):
            own = np.flatnonzero(family == k)
            if len(own):
                best, more = level.decide(x[own])
                out[own] = np.array(level.names, object)[best]
                sure[own] *= more
        return out.tolist(), sure


def remainder(n: int):
    """crc32(doc_id as text) mod n; a null doc_id gives null."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel | None:
    """A model of the labelled rows outside the held-out quarter; None where there are none with a letter.

    Of each language at most sample_rows rows are learned from, those with the smallest hash of doc_id:
    a threshold from the language's count thins them where they lie, and only what passes is ranked."""
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(4) != 2))
    share = {r["lang"]: 1.5 * sample_rows / r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return None
    luck = F.shiftrightunsigned(F.xxhash64("doc_id"), 12) / float(1 << 52)
    limit = F.element_at(F.create_map(*[F.lit(v) for kv in share.items() for v in kv]), F.col("lang"))
    thin = known.withColumn("luck", luck).where(F.col("luck") <= limit)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("luck", "doc_id", F.length("text")))
    rows = thin.withColumn("rank", rank).where(F.col("rank") <= sample_rows).select("lang", "text")

    def run(batches):
        for b in batches:
            langs, packed = [], []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if has_letter(text.as_py()):
                    x = features(text.as_py())
                    at = np.flatnonzero(x)
                    langs.append(lang)
                    packed.append(at.astype("<u2").tobytes() + x[at].astype("<f2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(packed, pa.binary())], ["lang", "packed"])

    sample = sorted(tuple(r) for r in rows.mapInArrow(run, "lang string, packed binary").collect())
    if not sample:
        return None
    x = np.zeros((len(sample), PLACES), np.float32)
    for k, (_, packed) in enumerate(sample):
        n = len(packed) // 4
        x[k, np.frombuffer(packed[: 2 * n], "<u2")] = np.frombuffer(packed[2 * n :], "<f2")
    return LanguageModel(x, np.array([lang for lang, _ in sample]))


def with_language(docs: DataFrame, model: LanguageModel | None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language of its column text and a score from 0 to 1.

    UNKNOWN and 0 for null or empty text, text without any letter, and every text when model is None."""
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            langs, scores = [UNKNOWN] * len(b), np.zeros(len(b))
            texts = b.column(at)
            for first in range(0, len(b), 256):
                rows, xs = [], []
                for k in range(first, min(first + 256, len(b))):
                    text = texts[k].as_py()
                    if model is not None and text and has_letter(text):
                        rows.append(k)
                        xs.append(features(text))
                if rows:
                    names, sure = model.predict(np.stack(xs))
                    scores[rows] = sure
                    for k, name in zip(rows, names, strict=True):
                        langs[k] = name
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores)], [*b.schema.names, lang, score])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType(list(docs.schema.fields)).add(lang, StringType()).add(score, DoubleType())
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from docs itself; a null doc_id is not held out.

    Rows that repeat are predicted alike; an empty table, or one without labelled rows, gives UNKNOWN and 0 for every
    row it has; other columns are ignored; texts are read whole, in steps, however long."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = with_language(rows, train(docs, sample_rows))
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows whose text has a language; columns unchanged. Only texts without a letter are rejected."""
    rows = docs.withColumn("text", F.col("text").cast("string"))
    found = with_language(rows, train(docs, sample_rows), "_language", "_language_score")
    return found.where(F.col("_language") != UNKNOWN).select(*docs.columns)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
