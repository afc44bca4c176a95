"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Pieces have at most `capacity` lengths, so an instance of any size is a histogram of that many numbers:
the reduction and the best fit work on it with multiplicities, and documents take their places by rank
within their length. Only the histogram reaches the driver.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

CAPACITY = 1024
END = 2
#: Characters on which the pattern of the rank-based encoder agrees with the tokenizer file in every
#: version of Unicode; a text with any other goes to the tokenizer file itself.
OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ]|<\|")


class Encoder:
    """Ids of byte_bpe_50k.json without special tokens, by way of the same vocabulary as ranks."""

    def __init__(self):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    def __call__(self, text: str) -> list[int]:
        if OTHER.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def pieces(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Every document's pieces of at most capacity tokens, the end token included, of which only the first
    may be shorter where there are more than one: doc_id, piece, start, length, ids_crc32 (and ids), with the task (part) that cut it and its rank there among equal lengths."""

    def run(batches):
        encode, ranks, part = Encoder(), Counter(), TaskContext.get().partitionId()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END], dtype="<u4")
                head = len(ids) % capacity
                for k, at in enumerate([0] * (head > 0) + [*range(head, len(ids), capacity)]):
                    own = ids[at : at + capacity if at or not head else head]
                    rows.append((doc_id, k, at, len(own), zlib.crc32(own.tobytes()), part, ranks[len(own)], own.astype(np.int32) if keep_ids else None))
                    ranks[len(own)] += 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()))
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids")
            n = 7 + keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:n], kinds, strict=False)], names[:n])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"
    return rows.mapInArrow(run, schema + ", ids array<int>" * keep_ids)


def _fills(count: Counter, rest: list[int], room: int, most: int) -> bool:
    """Whether lengths of rest, as often as count has them, add up to more than most and at most room."""
    sums, wanted = 1, (1 << room + 1) - (1 << most + 1)
    for x in rest:
        n, step = min(count[x], room // x), 1
        while n:
            step = min(step, n)
            sums |= sums << x * step
            n, step = n - step, 2 * step
        sums &= (1 << room + 1) - 1
        if sums & wanted:
            return True
    return False


def dominating(count: Counter, w: int, capacity: int) -> tuple[int, ...] | None:
    """A set of w and up to two more lengths that dominates every other set that holds w: whatever else
    could stand beside w can be exchanged for it without needing more bins. None where there is none such.

    Alone, if nothing fits beside w. With the largest partner a, if nothing that fits adds up to more. With
    a and the largest b that fits beside both, if three never fit beside w and of any two that fit the
    smaller is no larger than b, or both have room in a's place."""
    room = capacity - w
    count[w] -= 1
    try:
        rest = sorted(x for x in count if count[x] > 0 and x <= room)
        if not rest:
            return (w,)
        a = rest[-1]
        if a == room or not _fills(count, rest, room, a):
            return (w, a)
        smallest = [x for x in rest[:3] for _ in range(min(3, count[x]))][:3]
        if len(smallest) == 3 and sum(smallest) <= room:
            return None

        def partner(x: int) -> int:
            """The largest length that fits beside w and x; 0 for none."""
            at = bisect_left(rest, room - x + 1) - 1
            if at >= 0 and rest[at] == x and count[x] < 2:
                at -= 1
            return rest[at] if at >= 0 else 0

        b = partner(a)
        if not b:
            return None
        for i in rest[bisect_left(rest, b + 1) :]:
            if (h := partner(i)) >= i and h + i > a:
                return None
        return (w, a, b)
    finally:
        count[w] += 1


def reduce_dominated(count: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets and take them out of count: passes over all lengths, the largest first, as long as
    a pass fixes any. A set that dominates does so for every copy of it, since what else could stand in its
    place only gets less. Result: (lengths of one bin, number of such bins)."""
    fixed = []
    while True:
        before = len(fixed)
        for w in sorted((w for w in count if count[w] > 0), reverse=True):
            while count[w] > 0 and (own := dominating(count, w, capacity)):
                times = min(count[x] // n for x, n in Counter(own).items())
                fixed.append((own, times))
                for x in own:
                    count[x] -= times
        if len(fixed) == before:
            return fixed


def best_fit(count: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: each length goes to the fullest bins that can take it."""
    by_gap: dict[int, list] = defaultdict(list)
    gaps: list[int] = []

    def put(lengths: tuple[int, ...], gap: int, times: int) -> None:
        if times:
            if not by_gap[gap]:
                insort(gaps, gap)
            by_gap[gap].append((lengths, times))

    for w in sorted((w for w in count if count[w] > 0), reverse=True):
        n = count[w]
        while n:
            at = bisect_left(gaps, w)
            if at < len(gaps):
                gap = gaps[at]
                lengths, times = by_gap[gap].pop()
                if not by_gap[gap]:
                    gaps.pop(at)
            else:
                gap, lengths, times = capacity, (), n
            each = min(gap // w, n)
            full = min(times, n // each)
            put(lengths + (w,) * each, gap - w * each, full)
            put(lengths, gap, times - full) if lengths else None
            n -= full * each
    return [x for bins in by_gap.values() for x in bins]


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    count = Counter(histogram)
    return reduce_dominated(count, capacity) + best_fit(count, capacity)


def pack(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece.

    Null text counts as empty and packs as its end token; rows that repeat pack once each; an empty table
    gives no rows; other columns are ignored. Sequences have no gaps."""
    cut = materialize(pieces(docs, capacity, keep_ids), "pieces")
    totals = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = {r["length"]: r["n"] for r in totals.groupBy("length").agg(F.sum("n").alias("n")).collect()}

    # per length: ranks from which a run of bins starts, the run's first sequence, the place in the bin
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: Counter = Counter()
    sequence = 0
    for lengths, times in plan_bins(histogram, capacity):
        offset = 0
        for w in lengths:
            runs[w].append((taken[w], sequence, offset))
            taken[w] += times
            offset += w
        sequence += times
    places = {w: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for w, r in runs.items()}

    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence_id, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for w in np.unique(length).tolist():
                starts, sequences, offsets = places[w]
                own = length == w
                at = np.searchsorted(starts, rank[own], side="right") - 1
                sequence_id[own] = sequences[at] + rank[own] - starts[at]
                offset[own] = offsets[at]
            kept = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(sequence_id), pa.array(offset)], [*kept, "sequence_id", "offset"])

    ids = ["ids"] if keep_ids else []
    ranked = cut.join(firsts, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", *ids, (F.col("rank") + F.col("first")).alias("rank")
    )
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return ranked.mapInArrow(run, schema + ", sequence_id bigint, offset bigint")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
