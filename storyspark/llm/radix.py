"""Distributed LSD radix sort: every row's rank by a composite key, without a range-partitioned sort.

Rows lie in blocks of bounded size. A pass takes one digit of the key, the lowest first: each block counts its
digits, global prefix sums over (digit, block) say where the rows of that digit begin, and a stable counting
sort inside the block gives every row its destination, and with it its block of the next pass. After the last
digit the destinations are the ranks. A digit that a third of the rows share only makes its run of destinations
longer; blocks stay as large as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructType

from .common import discard, materialize, partitions

RADIX_BITS = 11
MOST_BLOCK_ROWS = 1 << 18
LEAST_BLOCK_ROWS = 1 << 10
BLOCK, AT, DIGIT, RANK = "_block", "_at", "_digit", "rank"


class Key:
    """Digits of a composite key of bigint columns; a null comes before all numbers of its column."""

    def __init__(self, columns: list[str], ranges: list[tuple], bits: int = RADIX_BITS):
        self.bits = bits
        self.digits: list[tuple[str, int, int, int]] = []  # column, least, added, shift; lowest digit first
        for name, (least, most, nulls) in reversed(list(zip(columns, ranges, strict=True))):
            if least is None:
                continue
            added = int(nulls > 0)
            for shift in range(0, (most - least + added).bit_length(), bits):
                self.digits.append((name, least, added, shift))

    def digit(self, batch: pa.RecordBatch | pa.Table, k: int) -> np.ndarray:
        name, least, added, shift = self.digits[k]
        column = batch.column(batch.schema.get_field_index(name))
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        # two's complement, so that differences of any two numbers are right without a sign
        value = column.fill_null(least).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) - np.uint64(least & 0xFFFFFFFFFFFFFFFF) + np.uint64(added)
        if column.null_count:
            value[column.is_null().to_numpy(zero_copy_only=False)] = 0
        return ((value >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)).astype(np.int32)


def counting_sort(digit: np.ndarray, first: dict[int, int]) -> np.ndarray:
    """Destination of each of a block's rows: first[d] is where the block's rows of digit d begin; the
    rows of one digit keep their order."""
    order = np.argsort(digit, kind="stable")
    kinds, starts, counts = np.unique(digit[order], return_index=True, return_counts=True)
    out = np.empty(len(digit), np.int64)
    begin = np.array([first[d] for d in kinds.tolist()], np.int64)
    out[order] = np.repeat(begin - starts, counts) + np.arange(len(digit))
    return out


def _dealt_first(rows: DataFrame, key: Key, size: int, schema: StructType) -> DataFrame:
    """rows in blocks of at most size, in whatever order they come."""

    def run(batches):
        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            place = np.arange(seen, seen + len(b))
            seen += len(b)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((part << 32) | place // size, pa.int64()), pa.array(place % size, pa.int32()), pa.array(key.digit(b, 0), pa.int32())], [*b.schema.names, BLOCK, AT, DIGIT])

    return rows.mapInArrow(run, schema)


def _offsets(dealt: DataFrame, bits: int) -> DataFrame:
    """_of, _kind, first: where a block's rows of a digit begin among all rows. The totals of the digits, at most
    2**bits rows, are the only thing that reaches the driver and is broadcast."""
    counts = dealt.groupBy(BLOCK, DIGIT).agg(F.count(F.lit(1)).alias("n"))
    totals = dict(sorted((r[0], r[1]) for r in counts.groupBy(DIGIT).agg(F.sum("n")).collect()))
    base, at = [], 0
    for d, n in totals.items():
        base.append((d, at))
        at += n
    bases = F.broadcast(dealt.sparkSession.createDataFrame(base, f"{DIGIT} int, base bigint"))
    before = Window.partitionBy(DIGIT).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return counts.join(bases, DIGIT).select(F.col(BLOCK).alias("_of"), F.col(DIGIT).alias("_kind"), (F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("first"))


def _placed(key: Key, following: int | None, size: int, own: list[str], kinds: pa.Schema):
    """Counting sort of one block; following is the next pass's digit, None after the last."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by(AT)
        first = dict(zip(right.column("_kind").to_pylist(), right.column("first").to_pylist(), strict=True))
        to = counting_sort(left.column(DIGIT).combine_chunks().to_numpy(), first)
        kept = [left.column(c) for c in own]
        if following is None:
            return pa.table([*kept, pa.array(to + 1)], [*own, RANK])
        return pa.table([*kept, pa.array(to // size), pa.array(to % size, pa.int32()), pa.array(key.digit(left, following))], kinds.names).cast(kinds)

    return run


def ranked(rows: DataFrame, keys: list[str], bits: int = RADIX_BITS, block_rows: int | None = None) -> DataFrame:
    """rows and rank (1, 2, 3... by the bigint columns keys, ascending, nulls first). Rows with equal keys take
    consecutive ranks in any order; an empty table gives no rows. rows is read several times, so it should be a
    written table. Each pass is written to the shared folder, so a lost executor costs one pass's tasks."""
    asked = [f(k) for k in keys for f in (F.min, F.max, lambda c: F.count(F.when(F.col(c).isNull(), 1)))]
    n, *found = rows.agg(F.count(F.lit(1)), *asked).first()
    if n == 0:
        return rows.withColumn(RANK, F.lit(None).cast("bigint"))
    key = Key(keys, [tuple(found[3 * i : 3 * i + 3]) for i in range(len(keys))], bits)
    if not key.digits:  # all keys are equal
        key.digits = [(keys[0], 0, 0, 63)]
    size = block_rows or max(LEAST_BLOCK_ROWS, min(MOST_BLOCK_ROWS, -(-n // (4 * partitions(rows.sparkSession)))))
    schema = StructType([*rows.schema.fields]).add(BLOCK, LongType()).add(AT, IntegerType()).add(DIGIT, IntegerType())
    kinds = to_arrow_schema(schema)
    dealt = materialize(_dealt_first(rows, key, size, schema), "radix")
    for k in range(len(key.digits)):
        last = k + 1 == len(key.digits)

        offsets = _offsets(dealt, bits)
        to_schema = StructType([*rows.schema.fields]).add(RANK, LongType()) if last else schema
        moved = dealt.groupBy(BLOCK).cogroup(offsets.groupBy("_of")).applyInArrow(_placed(key, None if last else k + 1, size, rows.columns, kinds), to_schema)
        before, dealt = dealt, materialize(moved, "radix")
        discard(before)
    return dealt
