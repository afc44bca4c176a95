"""What the operators of this subpackage share: the shared folder, written tables, words, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separator of words; bytes.split() splits on the same six bytes.
WHITE = r"[\x20\x09-\x0D]+"

PARTITION_BYTES = 128 << 20
#: Spark's own limit for buckets.
MOST_PARTITIONS = 100_000
#: Sizes above this mean that the optimiser knows none.
UNKNOWN_SIZE = 1 << 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Shuffle files go when the execution that wrote them ends: what is read again is in written tables.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one in local mode, as in
    tests; on a cluster the executors would not see it, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="storyspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written_at(df: DataFrame, path: str) -> DataFrame:
    """df, known to be the table at path, which goes when the driver's JVM ends if discard() is not called before."""
    place, files = _file_system(df.sparkSession, path)
    files.deleteOnExit(place)
    df._written = path
    return df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: this cuts the lineage, survives lost
    executors and keeps expensive steps from running twice."""
    spark = df.sparkSession
    spark.conf.set(TIDY, "true")
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return written_at(spark.read.schema(df.schema).parquet(path), path)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in tables:
        place, files = _file_system(df.sparkSession, df._written)
        files.delete(place, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized_partitions(df: DataFrame, times: float = 1.0) -> int:
    """As many partitions as the session deals out, and no fewer than one for each PARTITION_BYTES of df (times
    what it grows by), so that a partition's size is bounded whatever the setting; at most MOST_PARTITIONS."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) * times
    least = partitions(df.sparkSession)
    return least if size > UNKNOWN_SIZE else max(least, min(MOST_PARTITIONS, int(size // PARTITION_BYTES)))


def id_text(values: list) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes, null as empty."""
    return [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in values]


def without_dropped(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """docs but for the doc_ids that verdict (doc_id, kept) drops in every row."""
    gone = verdict.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept")
    gone = materialize(gone.select(F.col("doc_id").alias("_gone")), "dropped")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable in edges (u, v: bigint). Rows: node, component, for all but those smallest nodes.

    Alternates large-star and small-star rounds; each is a grouped minimum joined back, so a hub with
    a third of all edges meets partial aggregation and a join side that the optimiser can split, never
    a collected group. Each round is written to the shared folder. Self loops and repeats do no harm.
    """
    links = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    state = None
    while True:
        now = links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if now[0] == 0 or now == state:
            break
        state = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        before, links = links, materialize(small.where("u <> v").distinct(), "links")
        discard(before, large)
    return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
