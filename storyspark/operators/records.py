"""Point lookups, lists and searches over keyed tables. Every filter reaches the scan; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matching(df: DataFrame, *conditions: Column, **equal) -> DataFrame:
    """Rows that satisfy every condition and equality; a value of None asks for null."""
    for name, value in equal.items():
        conditions += ((F.col(name).isNull() if value is None else F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value),)
    for c in conditions:
        df = df.where(c)
    return df


def listing(df: DataFrame, *order, limit: int | None = None, offset: int = 0, **equal) -> DataFrame:
    """matching rows in order; with a limit Spark keeps only the top rows of each partition."""
    df = matching(df, **equal)
    df = df.orderBy(*order) if order else df
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def best_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in order (recognised by Spark as a window group limit)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def by_label(entities: DataFrame, label: str) -> DataFrame:
    return entities.where(F.lower("label") == label.lower())


def by_label_or_alias(entities: DataFrame, aliases: DataFrame, label: str) -> DataFrame:
    """Entities with that label; those with that alias only where no label matches."""
    own = by_label(entities, label).select("*", F.lit(0).alias("tier"))
    named = aliases.where(F.lower("alias") == label.lower()).select(F.col("entity_id").alias("id")).distinct()
    other = entities.join(named, "id", "left_semi").select("*", F.lit(1).alias("tier"))
    found = own.unionByName(other)
    best = found.agg(F.min("tier").alias("tier"))
    return found.join(F.broadcast(best), "tier", "left_semi").drop("tier").distinct()


def title_match(notes: DataFrame, title: str) -> DataFrame:
    """Notes whose title equals title but for case; those that contain it only where none does."""
    exact, part = F.lower("title") == title.lower(), F.lower("title").contains(title.lower())
    found = notes.where(part).withColumn("tier", F.when(exact, 0).otherwise(1))
    best = found.agg(F.min("tier").alias("tier"))
    return found.join(F.broadcast(best), "tier", "left_semi")


def scored_search(entities: DataFrame, aliases: DataFrame, text: str) -> DataFrame:
    """Entities by how text meets them: 1.0 label, 0.9 an alias, 0.7 within the label, 0.5 within an alias."""
    text = text.lower()
    met = aliases.where(F.lower("alias").contains(text)).groupBy(F.col("entity_id").alias("id")).agg(F.max((F.lower("alias") == text).cast("int")).alias("same"))
    label = F.lower("label")
    score = F.when(label == text, 1.0).when(F.col("same") == 1, 0.9).when(label.contains(text), 0.7).when(F.col("same").isNotNull(), 0.5)
    return entities.join(met, "id", "left").withColumn("score", score).where("score IS NOT NULL").drop("same")


def visible_in(df: DataFrame, narrative: str | None) -> DataFrame:
    """Rows of a narrative; without one, the global rows alone."""
    return df.where(F.col("narrative_id").eqNullSafe(F.lit(narrative)))


def json_has(df: DataFrame, column: str, path: str, value: str | None = None) -> DataFrame:
    found = F.get_json_object(column, path)
    return df.where(found.isNotNull() if value is None else found == value)


def as_record(rows: DataFrame, key: str, name: str, value: str, fields: list[str]) -> DataFrame:
    """Name-value rows to one row per key with the given fields, JSON strings decoded."""
    plain = rows.withColumn("_v", F.regexp_replace(value, '^"|"$', ""))
    return plain.groupBy(key).pivot(name, fields).agg(F.first("_v"))


def page(df: DataFrame, *order, offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def capped(df: DataFrame, order: list, max_rows: int, max_bytes: int, text: Column) -> DataFrame:
    """The first rows within both caps, and whether anything was cut off.

    Only max_rows + 1 rows are ever looked at, so the window over them is small whatever df holds."""
    first = df.orderBy(*order).limit(max_rows + 1)
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = first.withColumn("_n", F.row_number().over(Window.orderBy(*order))).withColumn("_bytes", F.sum(F.octet_length(text)).over(upto))
    whole = Window.partitionBy()
    keep = (F.col("_n") <= max_rows) & (F.col("_bytes") <= max_bytes)
    return rows.withColumn("truncated", F.max((~keep).cast("int")).over(whole) == 1).where(keep).drop("_n", "_bytes")
