"""SimHash near-duplicates found through deletion-variant signatures.

A 64-bit fingerprint is cut into bits // 2 + 1 segments: of two fingerprints at most `bits` apart, one
segment differs by one bit at most, so both hold the same segment once the differing bit is made a
wildcard. Every distinct fingerprint is indexed under each (segment, wildcard, rest), equal keys meet,
and the meeting fingerprints are verified by their Hamming distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, id_text, materialize, sized_partitions, table, without_dropped

SEED = 42
BLOCK = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the word shingles of lower-cased (A-Z) text, as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    spans = zip(starts, ends[width - 1 :], strict=False) if len(words) >= width else [(0, ends[-1])]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in spans], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of every row; null text counts as empty."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in id_text(b.column(1).to_pylist())], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def signed(x: int) -> int:
    """The 64-bit pattern x as Spark's signed long."""
    return x - (1 << 64) if x >> 63 else x


def segments(bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of each of the bits // 2 + 1 segments of 64 bits."""
    n = bits // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def variants(fps: DataFrame, bits: int) -> DataFrame:
    """fp, place (the wildcard's bit, which also names the segment) and rest (the segment without that bit)."""
    one = [
        F.struct(
            F.lit(lo + i).cast("smallint").alias("place"),
            F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit(signed(((1 << width) - 1) & ~(1 << i)))).alias("rest"),
        )
        for lo, width in segments(bits)
        for i in range(width)
    ]
    return fps.select("fp", F.explode(F.array(*one)).alias("x")).select("fp", "x.place", "x.rest")


def forest(members: list[int], bits: int) -> list[tuple[int, int]]:
    """Edges that join what is linked among the members of one index bucket: at most one fewer than them."""
    fps = np.array(members, dtype=np.int64).view(np.uint64)
    left = np.arange(len(fps))
    edges, queue = [], []
    while len(left):
        at = queue.pop() if queue else left[0]
        left = left[left != at]
        near = left[np.bitwise_count(fps[left] ^ fps[at]) <= bits]
        edges += [(members[at], members[j]) for j in near.tolist()]
        queue += near.tolist()
        left = np.setdiff1d(left, near, assume_unique=True)
    return edges


def _forests(buckets: DataFrame, bits: int) -> DataFrame:
    def run(batches):
        for b in batches:
            found = [e for m in b.column(0).to_pylist() for e in forest(m, bits)]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return buckets.select("members").mapInArrow(run, "a bigint, b bigint")


def hub_pairs(fps: DataFrame, bits: int) -> DataFrame:
    """Links through `bits` wildcards over all 64 places. Equal keys hold at most 2**bits distinct
    fingerprints, all of them linked, so a star per key is exact and the work is linear in the rows."""
    wild = fps.select("fp", F.lit(0).cast("bigint").alias("mask"), F.lit(-1).alias("last"))
    for k in range(bits):
        wild = wild.select(
            "fp", "mask", "last", F.explode(F.sequence(F.col("last") + 1, F.lit(64 - bits + k))).alias("p")
        ).select("fp", F.col("mask").bitwiseOR(F.expr("shiftleft(1L, p)")).alias("mask"), F.col("p").alias("last"))
    keyed = wild.select("fp", "mask", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("rest"))
    hubs = keyed.groupBy("mask", "rest").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    return hubs.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a <> b")


def linked_pairs(fps: DataFrame, bits: int = 2, bucket_limit: int = 1024) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints of column fp whose closure is that of all links.

    The index is counted by (place, rest), after partial counts, and joined with the buckets of two or
    more, a join whose large partitions the optimiser can split. A bucket of up to bucket_limit is
    searched at once in memory; the members of a larger one are linked through hub_pairs, which is exact
    at any size. No link between different fingerprints is lost. A bucket's rows are distinct
    fingerprints: copies, however many, are one row.
    """
    # a fingerprint's 64 rows take some 256 times its own bytes
    n = sized_partitions(fps, 256)
    index = variants(fps.repartition(n, "fp"), bits)
    size = index.groupBy("place", "rest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # 64 rows a fingerprint come from a few bytes in a file: by its estimate the optimiser would broadcast either side
    shared = materialize(index.hint("merge").join(size, ["place", "rest"]), "buckets")
    bounded = shared.where(F.col("n") <= bucket_limit).groupBy("place", "rest").agg(F.collect_list("fp").alias("members"))
    large = shared.where(F.col("n") > bucket_limit).select("fp").distinct()
    return _forests(bounded, bits).unionByName(hub_pairs(large, bits)).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = 2, bucket_limit: int = 1024) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row.

    Null, empty and blank texts have fingerprint zero and are linked like any other; repeated rows give
    repeated results; a null doc_id gets a component only through other rows; other columns are ignored;
    an empty table gives no rows. Equal fingerprints are one node, so copies never meet in pairs.
    """
    prints = materialize(fingerprints(docs, width), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    nodes = materialize(nodes, "nodes")
    pairs = linked_pairs(nodes.select("fp"), bits, bucket_limit)
    low, high = nodes.select(F.col("fp").alias("a"), F.col("node").alias("u")), nodes.select(F.col("fp").alias("b"), F.col("node").alias("v"))
    edges = pairs.join(low, "a").join(high, "b").select("u", "v")
    component = connected_components(edges)
    named = nodes.join(component, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, width: int = 3, bits: int = 2) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group of near-duplicates; columns unchanged.
    A doc_id of which any row stays keeps all its rows, and a row without a doc_id is never dropped."""
    found = near_duplicates(docs, width, bits)
    return without_dropped(docs, found.select("doc_id", (F.col("doc_id") == F.col("component_id")).alias("kept")))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
