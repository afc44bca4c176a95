"""Resolution of mentions to known entities, all mentions of a table at once.

A pronoun stands for the latest entity before it whose gender fits. Any other text is an entity's name, or one of its
aliases, or the entity with which it shares the most telling words: names weigh ten, aliases five, and a word counts by
its rarity among entities. Each distinct text is resolved once. An entity that shares only such common words with a
text as could never reach the least score isn't looked at: a text asks for candidates by its rarest words alone, just
so many that what the rest could add stays below it (prefix filtering). No result depends on that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from . import language as op
from .ranking import idf, normal_tf
from .search import saturate

# Weights of fields, saturation, length norm, the share that words have in a score, the least score.
NAME_WEIGHT, ALIAS_WEIGHT = 10.0, 5.0
K1, B = 1.2, 0.5
SHARE = 0.5
LEAST = 1.0
#: Words that a field of aliases counts as, however many it has.
ALIAS_WORDS = 10


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def index(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, word, value (idf times the saturated, weighted frequency, times SHARE) and most (a bound of value for any entity)
    of entities (id, label) and their aliases (entity_id, alias)."""
    names = entities.select("id", F.explode(F.array_distinct(words(F.col("label")))).alias("word"), F.size(F.split("label", " ")).alias("length"))
    other = aliases.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    held = other.groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("held"))
    # one row: how many entities there are, and the mean lengths of both fields
    size = entities.select("id", F.size(F.split("label", " ")).alias("length")).join(held, "id", "left")
    size = size.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("length").alias("name_mean"), F.coalesce(F.sum("held") / F.count(F.lit(1)), F.lit(0.0)).alias("alias_mean"))
    found = names.select("id", "word", "length", F.lit(0).alias("tf")).unionByName(other.select(F.col("entity_id").alias("id"), F.explode(words(F.col("alias"))).alias("word"), F.lit(None).cast("int").alias("length"), F.lit(1).alias("tf")))
    each = found.groupBy("id", "word").agg(F.max("length").alias("length"), F.sum("tf").alias("tf"))
    df = each.groupBy("word").agg(F.count(F.lit(1)).cast("double").alias("df"))
    rows = each.join(df, "word").crossJoin(F.broadcast(size))
    star = NAME_WEIGHT * F.when(F.col("length").isNull(), 0.0).otherwise(normal_tf(F.lit(1), F.col("length"), F.col("name_mean"), B))
    mean = F.when(F.col("alias_mean") == 0, 100.0).otherwise(F.col("alias_mean"))
    star = star + ALIAS_WEIGHT * normal_tf(F.col("tf"), F.lit(ALIAS_WORDS), mean, B)
    weight = SHARE * idf(F.col("n"), F.col("df"))
    return rows.select("id", "word", (weight * saturate(star, K1)).alias("value"), (weight * (K1 + 1)).alias("most"))


def _first(df: DataFrame, text: Column, key: str, name: str) -> DataFrame:
    return df.groupBy(F.lower(text).alias("asked")).agg(F.min(key).alias(name))


def likely(asked: DataFrame, postings: DataFrame, least: float = LEAST) -> DataFrame:
    """asked, id, score: for each text the entity of the highest score over least, ties to the smaller id."""
    each = asked.select("asked", F.explode(F.array_distinct(words(F.col("asked")))).alias("word"))
    heard = postings.join(each.select("word").distinct(), "word", "left_semi")
    known = heard.groupBy("word").agg(F.max("most").alias("most"))
    weighed = each.join(known, "word")
    rest = Window.partitionBy("asked").orderBy("most", "word").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    strong = weighed.withColumn("reach", F.sum("most").over(rest)).where(F.col("reach") > least)
    # entities that are alike in all words asked for have equal scores: the smallest id stands for them
    alike = heard.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("word", "value"))).alias("held")).groupBy("held").agg(F.min("id").alias("id"))
    own = written(alike.select("id", F.map_from_entries("held").alias("values")), "alike")
    pairs = strong.join(own.select("id", F.explode(F.map_keys("values")).alias("word")), "word").select("asked", "id").distinct()
    score = F.aggregate(F.array_distinct(words(F.col("asked"))), F.lit(0.0), lambda s, w: s + F.coalesce(F.try_element_at("values", w), F.lit(0.0)))
    scored = pairs.join(own, "id").select("asked", "id", F.round(score, 9).alias("score")).where(F.col("score") > least)
    return scored.groupBy("asked").agg(F.min(F.struct((-F.col("score")).alias("down"), "id")).alias("x")).select("asked", F.col("x.id").alias("id"), (-F.col("x.down")).alias("score"))


def resolve(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, doc: str = "doc", place: str = "place", text: str = "text", gender: str = "gender", least: float = LEAST, history: int = 10) -> DataFrame:
    """mentions and entity, how (name, alias, words or pronoun; both null where nothing fits) and score (of words alone).

    entities: id, label, gender (male, female, neutral, plural, unknown); aliases: entity_id, alias. Equal names go to
    the smallest id, a name before an alias. A pronoun's history is the last so many distinct entities that its
    document mentions by name before it; documents are bounded, mentions that repeat count each."""
    spoken = op.pronoun_gender(F.col(text))
    asked = mentions.where(spoken.isNull() & F.col(text).isNotNull()).select(F.lower(text).alias("asked")).distinct()
    exact = asked.join(_first(entities, F.col("label"), "id", "name"), "asked", "left").join(_first(aliases, F.col("alias"), "entity_id", "alias"), "asked", "left")
    open_ = exact.where("name IS NULL AND alias IS NULL").select("asked")
    found = exact.join(likely(open_, index(entities, aliases), least).withColumnRenamed("id", "close"), "asked", "left")
    how = F.when(F.col("name").isNotNull(), "name").when(F.col("alias").isNotNull(), "alias").when(F.col("close").isNotNull(), "words")
    found = found.select("asked", F.coalesce("name", "alias", "close").alias("_entity"), how.alias("_how"), F.when(how == "words", F.col("score")).alias("score"))
    named = mentions.withColumn("_asked", F.lower(text)).join(found, F.col("_asked") == F.col("asked"), "left").drop("_asked", "asked")
    met = named.where(F.col("_entity").isNotNull() | spoken.isNotNull()).join(entities.select(F.col("id").alias("_entity"), F.col(gender).alias("_gender")), "_entity", "left")
    said = op.references(met, doc, place, "_entity", "_gender", text, history).select(doc, F.col("place").alias(place), F.col("entity").alias("_said")).distinct()
    whole = named.join(said, [doc, place], "left")
    meant = spoken.isNotNull()
    return whole.withColumn("entity", F.when(meant, F.col("_said")).otherwise(F.col("_entity"))).withColumn("how", F.when(meant & F.col("_said").isNotNull(), "pronoun").otherwise(F.col("_how"))).drop("_entity", "_how", "_said")
