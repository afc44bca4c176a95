"""Versioned rows, event replay and mutations. A mutation is a DataFrame of the table after it: keep-latest
unions, anti-joins and closed intervals, to be written by a sink of one's choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import best_per_key


def versions(rows: DataFrame, key: str, at: str, *tie: str) -> DataFrame:
    """rows with version, valid_from, valid_to, is_current: an SCD-2 history in the order of `at`."""
    own = Window.partitionBy(key).orderBy(at, *tie)
    nxt = F.lead(at).over(own)
    return rows.select("*", F.row_number().over(own).alias("version"), F.col(at).alias("valid_from"), nxt.alias("valid_to"), nxt.isNull().alias("is_current"))


def revised(history: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """history after changes (key, at, and columns to set): the current version of each changed key is
    closed at that time, and the next version follows it with what the change sets; the rest is kept."""
    fields = [c for c in changes.columns if c not in (key, "at")]
    change = changes.select(key, F.col("at").alias("_at"), *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = history.join(change, key, "left")
    hit = F.col("_at").isNotNull() & F.col("is_current")
    old = joined.withColumn("valid_to", F.when(hit, F.col("_at")).otherwise(F.col("valid_to"))).withColumn("is_current", F.col("is_current") & ~hit)
    new = joined.where(hit).withColumn("version", F.col("version") + 1).withColumn("valid_from", F.col("_at")).withColumn("valid_to", F.lit(None).cast(history.schema["valid_to"].dataType))
    for c in fields:
        new = new.withColumn(c, F.col(f"_new_{c}"))
    return old.select(*history.columns).unionByName(new.select(*history.columns))


def created(history: DataFrame, rows: DataFrame, at: str = "created_at") -> DataFrame:
    """history with the first version of each new row."""
    first = rows.withColumn("version", F.lit(1)).withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lit(None).cast("bigint")).withColumn("is_current", F.lit(True))
    return history.unionByName(first.select(*history.columns))


def restored(history: DataFrame, key: str, value, version: int, at: int) -> DataFrame:
    """history with an old version of one key as its newest."""
    old = history.where((F.col(key) == value) & (F.col("version") == version))
    fields = [c for c in history.columns if c not in ("version", "valid_from", "valid_to", "is_current")]
    return revised(history, old.select(*fields, F.lit(at).cast("bigint").alias("at")), key)


def upserted(table: DataFrame, changes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """table with changes; of each key the row newest by `at`, changes winning ties."""
    both = table.withColumn("_fresh", F.lit(0)).unionByName(changes.withColumn("_fresh", F.lit(1)))
    return best_per_key(both, keys, F.desc(at), F.desc("_fresh")).drop("_fresh")


def deleted(table: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def marked(table: DataFrame, where: Column, **values) -> DataFrame:
    """table with columns set where a condition holds (a soft delete, a departure, a change of role)."""
    for name, value in values.items():
        table = table.withColumn(name, F.when(where, F.lit(value)).otherwise(F.col(name)))
    return table


def existed(events: DataFrame, at: int, birth: str, death: str, target: str = "target_id") -> DataFrame:
    """target and whether it was born at or before a time and not dead by then."""
    before = F.col("ts") <= at
    born = F.max(F.when(before & (F.col("action") == birth), 1).otherwise(0)) == 1
    dead = F.max(F.when(before & (F.col("action") == death), 1).otherwise(0)) == 1
    return events.groupBy(target).agg((born & ~dead).alias("existed"))


def state_at(events: DataFrame, at: int, target: str = "target_id") -> DataFrame:
    """Each target after replaying its events up to a time: how many, the last action and payload."""
    rows = events.where(F.col("ts") <= at)
    return rows.groupBy(target).agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("action", "payload"), F.struct("ts", "id")).alias("s")).select(target, "n", "s.action", "s.payload")


def replayed(log: DataFrame, key: str, seq: str, op: str) -> DataFrame:
    """Latest row of each key in a change log, but for those last deleted."""
    return best_per_key(log, [key], F.desc(seq)).where(F.col(op) != "delete")


def rebalanced(rows: DataFrame, keys: list[str], order: str, *tie: str, step: int = 1000) -> DataFrame:
    return rows.withColumn(order, F.row_number().over(Window.partitionBy(*keys).orderBy(order, *tie)) * step)


def crowded(rows: DataFrame, keys: list[str], order: str, least: int = 10) -> DataFrame:
    """keys and whether any two neighbours in order are closer than least."""
    gap = F.col(order) - F.lag(order).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_gap", gap).groupBy(*keys).agg(F.coalesce(F.min("_gap") < least, F.lit(False)).alias("crowded"))


def midpoints(rows: DataFrame, keys: list[str], order: str, *tie: str) -> DataFrame:
    """rows with the order that would stand half-way to the next one."""
    return rows.withColumn("between", (F.col(order) + F.lead(order).over(Window.partitionBy(*keys).orderBy(order, *tie))) / 2)
