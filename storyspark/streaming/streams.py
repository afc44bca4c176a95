"""Structured Streaming over event files: sessions, windows, counters, duplicates, per-key state.

Every stream is a lazy transformation of a streaming DataFrame; run() drives one to the end of what is
there, with its state and offsets in the folder that all executors share."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_place

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_batch: int = 1) -> DataFrame:
    """Events as their files appear in a folder."""
    stream = spark.readStream.schema(EVENT_SCHEMA.replace("ts timestamp", "ts timestamp_ntz")).option("maxFilesPerTrigger", files_per_batch)
    return stream.option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Drive the stream over all that is there, then read what it wrote. In complete mode each batch takes
    the place of the one before; in append and update modes rows add up."""
    spark = stream.sparkSession
    home = new_place(spark, name)

    def sink(batch: DataFrame, number: int) -> None:
        # a batch that is written again after a failure takes its own place
        part = "all" if mode == "complete" else f"batch={number}"
        batch.write.mode("overwrite").parquet(f"{home}/out/{part}")

    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{home}/out")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, events of each session closed by a pause of `gap`, or by the watermark."""
    rows = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("events"), F.max_by("event_type", "ts").alias("last")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "last")


def windowed(stream: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, event_type, events, value over tumbling (or, with slide, sliding) windows."""
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w") if slide else F.window("ts", size).alias("w"), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "value")


def first_seen(stream: DataFrame, *keys: str, late: str | None = None) -> DataFrame:
    """Rows whose keys were not seen before (within the watermark, if there is one)."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys)) if late else stream.dropDuplicates(list(keys))


def counted(stream: DataFrame, *keys: str) -> DataFrame:
    """Running number and sum of value by keys."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


def stateful(stream: DataFrame, key: str, step, schema: str, state: str) -> DataFrame:
    """step(rows of one key in order of ts, state or None) gives output rows and the next state."""

    def work(k, batches: Iterator[pd.DataFrame], held):
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out, new = step(k[0], rows, held.get if held.exists else None)
        held.update(new)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return stream.groupBy(key).applyInPandasWithState(work, schema, state, "append", "NoTimeout")


def changed_only(stream: DataFrame) -> DataFrame:
    """event_id, user_id, props of events whose content differs from the user's one before."""

    def step(user, rows, state):
        last, out = state[0] if state else None, []
        for e, p in zip(rows["event_id"], rows["props"], strict=True):
            if p != last:
                out.append((e, user, p))
            last = p
        return out, (last,)

    return stateful(stream, "user_id", step, "event_id bigint, user_id bigint, props string", "last string")


def over_threshold(stream: DataFrame, threshold: float) -> DataFrame:
    """user_id, event_id, total each time a user's value since the last time reaches a threshold."""

    def step(user, rows, state):
        total, out = state[0] if state else 0.0, []
        for e, v in zip(rows["event_id"], rows["value"], strict=True):
            total += v
            if total >= threshold:
                out.append((user, e, round(total, 4)))
                total = 0.0
        return out, (total,)

    return stateful(stream, "user_id", step, "user_id bigint, event_id bigint, total double", "total double")


def joined_text(stream: DataFrame) -> DataFrame:
    """user_id and the event types so far, in order, as one text."""
    rows = F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return stream.groupBy("user_id").agg(F.array_join(F.transform(rows, lambda x: x["event_type"]), " ").alias("content"))
