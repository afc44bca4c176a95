"""Tables in and out: JSON dumps, snapshots with a log, content-addressed blobs, object graphs, sorted term
files, and answers of language models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.records import best_per_key


def export_json(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def import_json(spark: SparkSession, folder: str, schemas: dict[str, StructType]) -> dict[str, DataFrame]:
    """The tables of export_json, by the schemas given; nothing is inferred."""
    return {name: spark.read.schema(s).json(f"{folder}/{name}") for name, s in schemas.items()}


def run_script(spark: SparkSession, sql: str, parameters: dict | None = None) -> DataFrame:
    """One query with named parameters."""
    return spark.sql(sql, args=parameters or {})


def merged_log(snapshot: DataFrame, log: DataFrame, key: str, seq: str = "seq", op: str = "op") -> DataFrame:
    """The snapshot after a log of its rows (seq, op and all columns): the newest entry of a key wins, and a
    delete leaves nothing."""
    base = snapshot.withColumn(seq, F.lit(-1).cast("bigint")).withColumn(op, F.lit("put"))
    rows = base.unionByName(log.select(*base.columns))
    return best_per_key(rows, [key], F.desc(seq)).where(F.col(op) != "delete").drop(seq, op)


def compact(snapshot: DataFrame, log: DataFrame, key: str, path: str) -> DataFrame:
    merged_log(snapshot, log, key).write.mode("overwrite").parquet(path)
    return snapshot.sparkSession.read.schema(snapshot.schema).parquet(path)


def blobs(df: DataFrame, content: str) -> DataFrame:
    """blob_id (SHA-256 of the content), content and size, each content once."""
    rows = df.select(F.sha2(F.col(content), 256).alias("blob_id"), F.col(content).alias("content"))
    return rows.groupBy("blob_id").agg(F.first("content").alias("content")).withColumn("size", F.octet_length("content"))


def object_graph(df: DataFrame, key: str, content: str, properties: list[str]) -> dict[str, DataFrame]:
    """Objects with the blob attached to each, and one row per property that has a value."""
    objects = df.select(F.col(key).cast("string").alias("object_id"), F.sha2(F.col(content), 256).alias("blob_id"))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("key"), F.col(p).cast("string").alias("value")) for p in properties]))
    props = df.select(F.col(key).cast("string").alias("object_id"), each.alias("p")).select("object_id", "p.*").where("value IS NOT NULL")
    return {"objects": objects, "properties": props, "blobs": blobs(df, content)}


def frozen_postings(postings: DataFrame, path: str, files: int = 8) -> DataFrame:
    """Postings in files ranged and sorted by term, so that a range or prefix of terms reads few of them."""
    postings.repartitionByRange(files, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)
    return postings.sparkSession.read.schema(postings.schema).parquet(path)


def term_range(postings: DataFrame, start: str, end: str) -> DataFrame:
    return postings.where((F.col("term") >= start) & (F.col("term") < end))


def term_like(postings: DataFrame, pattern: str | None = None, near: tuple[str, int] | None = None) -> DataFrame:
    """Terms that a regular expression accepts whole, or within an edit distance of a word."""
    return postings.where(F.col("term").rlike(f"^(?:{pattern})$") if pattern else F.levenshtein("term", F.lit(near[0])) <= near[1])


def merged_terms(parts: list[DataFrame], how: str) -> DataFrame:
    """term, value of several sorted files as one; min, max or sum where they meet."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("term").agg({"min": F.min, "max": F.max, "sum": F.sum}[how]("value").alias("value"))


def thread_json(messages: DataFrame) -> DataFrame:
    """thread_id and its messages in order as a JSON array."""
    rows = F.sort_array(F.collect_list(F.struct("created_at", "id", "role", "content")))
    return messages.groupBy("thread_id").agg(F.to_json(rows).alias("json"))


# Kinds that an extraction may name.
KINDS = "CHARACTER LOCATION ITEM FACTION ORGANIZATION EVENT CONCEPT SPECIES PLACE NPC".split()
ANSWER = "entities array<struct<label:string,kind:string,confidence:double>>"


def extracted(df: DataFrame, raw: str, key: str = "id") -> DataFrame:
    """key, label, kind, confidence of the entities in a model's JSON answer.

    A code fence is taken off. The answer may be an object with entities, or a bare array; from one that
    is broken, whole {...} objects are rescued. Labels are trimmed and kinds upper-cased; entries without a
    label or of an unknown kind go; a missing confidence is 0.8."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```[a-zA-Z]*\n", ""), r"\n```\s*$", ""))
    item = "struct<label:string,kind:string,confidence:double>"
    whole = F.from_json(bare, ANSWER)["entities"]
    plain = F.when(F.startswith(bare, F.lit("[")), F.from_json(bare, f"array<{item}>"))
    rescued = F.transform(F.regexp_extract_all(bare, F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda s: F.from_json(s, "label string, kind string, confidence double"))
    usable = lambda a: F.when(F.size(a) > 0, a)
    rows = df.select(key, F.explode(F.coalesce(usable(whole), usable(plain), rescued)).alias("e"))
    rows = rows.select(key, F.trim("e.label").alias("label"), F.upper("e.kind").alias("kind"), F.coalesce("e.confidence", F.lit(0.8)).alias("confidence"))
    return rows.where((F.col("label") != "") & F.col("kind").isin(KINDS))


def force_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with a size of at least 1 that grows with the logarithm of their mentions, and the edges
    between them."""
    sized = nodes.withColumn("size", F.greatest(F.lit(1.0), F.log(F.col("mentions") + 1.0) * 3))
    ids = nodes.select("id")
    links = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return sized, links


