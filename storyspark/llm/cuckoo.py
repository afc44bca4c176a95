"""Exact deduplication over a sharded cuckoo-filter index of live digests.

Every document becomes the SHA-256 of its text lower-cased in A-Z. The index is cut into shards by the
digest's first bytes. A shard holds a cuckoo filter (16-bit fingerprints, four to a bucket) and, apart
from it, the full keys bucketed by content. A miss in the filter proves a digest new; a hit is verified
against the keys of its content bucket. Removing a digest's last live document deletes its fingerprint;
when an insertion finds no free slot, the filter doubles and is filled again from the stored keys.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, materialize, table, without_dropped

SLOTS = 4
KICKS = 200
SHARD_ROWS = 1 << 16
COMBINE_ROWS = 1 << 17


class CuckooShard:
    """One shard: filter, stored keys, and for each live digest its largest doc_id and number of documents."""

    def __init__(self, buckets: int = 256):
        self.content: dict[int, list[list]] = {}
        self.live = 0
        self.resizes = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.table = [0] * (SLOTS * buckets)

    @staticmethod
    def _mark(digest: bytes) -> int:
        return int.from_bytes(digest[4:6], "little") or 1

    def _home(self, digest: bytes) -> int:
        return int.from_bytes(digest[6:14], "little") & self.mask

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def may_hold(self, digest: bytes) -> bool:
        mark, at = self._mark(digest), self._home(digest)
        for b in (at, self._other(at, mark)):
            if mark in self.table[SLOTS * b : SLOTS * b + SLOTS]:
                return True
        return False

    def _place(self, digest: bytes) -> bool:
        mark, at = self._mark(digest), self._home(digest)
        slots = self.table
        for b in (at, self._other(at, mark)):
            for s in range(SLOTS * b, SLOTS * b + SLOTS):
                if not slots[s]:
                    slots[s] = mark
                    return True
        b = at
        for kick in range(KICKS):
            s = SLOTS * b + kick % SLOTS
            mark, slots[s] = slots[s], mark
            b = self._other(b, mark)
            for s in range(SLOTS * b, SLOTS * b + SLOTS):
                if not slots[s]:
                    slots[s] = mark
                    return True
        return False

    def _bucket(self, digest: bytes) -> list[list]:
        return self.content.setdefault(int.from_bytes(digest[14:18], "little"), [])

    def find(self, digest: bytes) -> list | None:
        """The stored entry [digest, largest id, documents], looked for only after a hit in the filter."""
        if not self.may_hold(digest):
            return None
        return next((e for e in self._bucket(digest) if e[0] == digest), None)

    def insert(self, digest: bytes, doc_id: int | None, documents: int = 1) -> list:
        entry = self.find(digest)
        if entry is not None:
            entry[2] += documents
            if doc_id is not None and (entry[1] is None or doc_id > entry[1]):
                entry[1] = doc_id
            return entry
        entry = [digest, doc_id, documents]
        self._bucket(digest).append(entry)
        self.live += 1
        if not self._place(digest):
            self._resize()
        return entry

    def _resize(self) -> None:
        size = self.mask + 1
        while True:
            size *= 2
            self.resizes += 1
            self._clear(size)
            if all(self._place(e[0]) for e in self.entries()):
                return

    def delete(self, digest: bytes, documents: int = 1) -> bool:
        """Take documents from a live digest; the last one takes its key and fingerprint with it."""
        entry = self.find(digest)
        if entry is None:
            return False
        entry[2] -= documents
        if entry[2] <= 0:
            self._bucket(digest).remove(entry)
            self.live -= 1
            mark, at = self._mark(digest), self._home(digest)
            for b in (at, self._other(at, mark)):
                for s in range(SLOTS * b, SLOTS * b + SLOTS):
                    if self.table[s] == mark:
                        self.table[s] = 0
                        return True
        return True

    def entries(self):
        for bucket in self.content.values():
            yield from bucket


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and digest (SHA-256 of the text lower-cased in A-Z only; null counts as empty)."""

    def run(batches):
        for b in batches:
            sums = [hashlib.sha256(t.lower()).digest() for t in id_text(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums, pa.binary())], ["doc_id", "digest"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, digest binary")


def _combined(rows: DataFrame, shards: int) -> DataFrame:
    """One row per digest and task (per COMBINE_ROWS digests of it), so that a hot digest reaches its
    shard as a few rows: shard, digest, doc_id (the largest), documents."""

    def flush(seen: dict) -> pa.RecordBatch:
        keys = list(seen)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([int.from_bytes(k[:4], "big") % shards for k in keys], pa.int32()),
                pa.array(keys, pa.binary()),
                pa.array([seen[k][0] for k in keys], pa.int64()),
                pa.array([seen[k][1] for k in keys], pa.int64()),
            ],
            ["shard", "digest", "doc_id", "documents"],
        )

    def run(batches):
        seen: dict[bytes, list] = {}
        for b in batches:
            for i, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (e := seen.get(k)) is None:
                    seen[k] = [i, 1]
                else:
                    e[1] += 1
                    if i is not None and (e[0] is None or i > e[0]):
                        e[0] = i
            if len(seen) >= COMBINE_ROWS:
                yield flush(seen)
                seen = {}
        if seen:
            yield flush(seen)

    return rows.select("doc_id", "digest").mapInArrow(run, "shard int, digest binary, doc_id bigint, documents bigint")


def build_index(rows: DataFrame, removed: DataFrame | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The live digests after inserting rows and then deleting `removed` (both: doc_id, digest; removed must
    be rows inserted). Result: digest, keep_id (largest inserted doc_id), group_size (live documents).

    A shard's memory is bounded: the number of shards follows the number of rows, at shard_rows each."""
    shards = max(1, -(-rows.count() // shard_rows))
    ops = _combined(rows, shards)
    if removed is not None:
        ops = ops.unionByName(_combined(removed, shards).withColumn("documents", -F.col("documents")))

    def run(group: pa.Table) -> pa.Table:
        shard = CuckooShard()
        columns = [group.column(c).to_pylist() for c in ("digest", "doc_id", "documents")]
        for digest, doc_id, n in zip(*columns, strict=True):
            if n > 0:
                shard.insert(digest, doc_id, n)
        for digest, _, n in zip(*columns, strict=True):
            if n < 0:
                shard.delete(digest, -n)
        kept = list(shard.entries())
        return pa.table(
            {
                "digest": pa.array([e[0] for e in kept], pa.binary()),
                "keep_id": pa.array([e[1] for e in kept], pa.int64()),
                "group_size": pa.array([e[2] for e in kept], pa.int64()),
            }
        )

    return ops.groupBy("shard").applyInArrow(run, "digest binary, keep_id bigint, group_size bigint")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; the largest doc_id of equal texts stays.

    Null text counts as empty. Rows that repeat a doc_id and text count in group_size and are kept or
    dropped together; a null doc_id stays only if its text has no other. Other columns are ignored;
    an empty table gives no rows. Only groups of two and more are joined back to the rows.
    """
    rows = materialize(digests(docs), "digests")
    groups = build_index(rows).where("group_size > 1")
    return rows.join(groups, "digest", "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.coalesce(F.col("keep_id").eqNullSafe(F.col("doc_id")) | F.col("group_size").isNull(), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay of each group of equal texts; columns unchanged. A doc_id of which any
    row stays keeps all its rows, and a row without a doc_id is never dropped."""
    return without_dropped(docs, exact_duplicates(docs).select("doc_id", "kept"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE_OP7 = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
