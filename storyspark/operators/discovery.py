"""Discovery of names: capitalised words are counted, and what known names do to others says of what kind those are.

A name is promoted when it has been seen often enough, and active when it is promoted and its kind is known. Every
three words "active name, known verb, capitalised word" count once more for the third and tell its kind, which may make
it active in turn. The spread is a fixpoint in rounds: each round joins only the names that the one before made active
with the triples that begin with them (semi-naive), and writes the names' new state to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..sources.shared import written
from . import language as op

TOKENS = r"[\p{L}\p{Nd}'\-·._/#&]+"
THRESHOLD = 2
#: Words of closed classes, which begin sentences and name nothing.
STOP_WORDS = sorted({w for p, words in lx.PARTS_OF_SPEECH if p not in "JVN" for w in words} | set(lx.NAME_STOP_WORDS))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, "’", "'"), F.lit(TOKENS), F.lit(0))


def _capital(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}")


def _made(rows: DataFrame, *made: str) -> DataFrame:
    """rows, whose columns made are not made again by the filters on them: those stay above this step, where otherwise
    they would go down to every word, each with its own copies of a name's expressions."""
    return rows.select(*[c for c in rows.columns if c not in made], F.inline_outer(F.array(F.struct(*made))))


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """name, n, display (the form met most often, the first by its letters of equal ones) of every capitalised word."""
    # outer, or Spark's own filter on the words would make them again
    words = docs.select(F.explode_outer(_words(F.col(text))).alias("w"))
    forms = words.where(_capital(F.col("w"))).groupBy("w").agg(F.count(F.lit(1)).alias("n")).withColumn("name", op.name_key("w"))
    named = _made(forms, "name").where(F.col("name").isNotNull() & ~F.col("name").isin(STOP_WORDS))
    return named.groupBy("name").agg(F.sum("n").alias("n"), F.max_by("w", F.struct("n", "w")).alias("display"))


def triples(docs: DataFrame, text: str, key: str = "id", verbs: DataFrame | None = None) -> DataFrame:
    """source, event, target, key, place of every three consecutive words whose second is a known verb and whose third
    is capitalised. verbs: stem, event (the table of verbs by default), some hundreds of rows."""
    spark = docs.sparkSession
    # outer and without a filter on the words before, or Spark would make a text's words again for each word
    words = docs.select(key, _words(F.col(text)).alias("_w")).select(key, "_w", F.posexplode_outer("_w").alias("place", "a"))
    rows = words.select(key, "place", "a", F.get("_w", F.col("place") + 1).alias("v"), F.get("_w", F.col("place") + 2).alias("b")).where(_capital(F.col("b")))
    known = (verbs if verbs is not None else op.verb_table(spark)).select("stem", "event")
    stemmed = _made(rows.withColumn("stem", op.stem(F.regexp_replace("v", r"[._]+$", ""))), "stem")
    met = stemmed.join(F.broadcast(known), "stem")  # one row a verb
    named = met.select("event", key, "place", op.name_key("a").alias("source"), op.name_key("b").alias("target"))
    return _made(named, "source", "target").where("source IS NOT NULL AND target IS NOT NULL").select("source", "event", "target", key, "place")


def spread(found: DataFrame, edges: DataFrame, seeds: DataFrame, key: str = "id", threshold: int = THRESHOLD) -> DataFrame:
    """name, n, kind, status (promoted or watching) and round (in which the name became active; null if it didn't) of
    every name of found (name, n), edges (see triples) or seeds (name, kind), which are active from the start.

    Of several kinds told in one round the first by key and place counts, and a kind once known stays. Stop words
    are never counted. An empty table of edges or seeds is fine."""
    edges = written(edges.where(~F.col("target").isin(STOP_WORDS)), "triples")
    every = found.select("name", "n").unionByName(edges.select(F.col("target").alias("name"), F.lit(0).cast("bigint").alias("n")))
    known = seeds.groupBy("name").agg(F.min("kind").alias("kind"))
    state = every.groupBy("name").agg(F.sum("n").alias("n")).join(known, "name", "full").select("name", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "kind", F.when(F.col("kind").isNotNull(), 0).alias("round"))
    state = written(state, "names")
    done = 0
    while state.where(F.col("round") == done).limit(1).count():
        fresh = state.where(F.col("round") == done).select(F.col("name").alias("source"), F.col("kind").alias("_kind"))
        fired = edges.join(fresh, "source").withColumn("told", op.inferred_kind(F.col("_kind"), F.col("event")))
        told = F.min_by(F.when(F.col("told") != "OTHER", F.col("told")), F.when(F.col("told") != "OTHER", F.struct(key, "place", "source")))
        gained = fired.groupBy(F.col("target").alias("name")).agg(F.count(F.lit(1)).alias("more"), told.alias("told"))
        done += 1
        after = state.join(gained, "name", "left").select("name", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.coalesce("kind", "told").alias("kind"), "round")
        active = F.col("round").isNull() & F.col("kind").isNotNull() & (F.col("n") >= threshold)
        state = written(after.withColumn("round", F.when(active, done).otherwise(F.col("round"))), "names")
    status = F.when((F.col("n") >= threshold) | (F.col("round") == 0), "promoted").otherwise("watching")
    return state.select("name", "n", "kind", status.alias("status"), "round")
