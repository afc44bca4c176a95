"""Joins beyond plain equality: bands, intervals, as-of, overlaps, closest pairs. Each is an equality join
on a bucket or key with a residual predicate, so none becomes a nested loop over both sides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType


def as_of(history: DataFrame, key: str, at, start: str = "valid_from", end: str = "valid_to", version: str = "version") -> DataFrame:
    """The greatest version of each key that holds at a time: start <= at < end (an open end holds on)."""
    held = history.where((F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at)))
    names = [c for c in history.columns if c != key]
    best = held.groupBy(key).agg(F.max_by(F.struct(*names), F.col(version)).alias("row"))
    return best.select(key, *[F.col(f"row.{c}").alias(c) for c in names])


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Each left row with the right row of its key that holds at its own time; an equality join on key."""
    meets = (left[key] == right[key]) & (right[start] <= left[at]) & (right[end].isNull() | (right[end] > left[at]))
    return left.join(right, meets, "left").drop(right[key])


def band_pairs(rows: DataFrame, keys: list[str], item: str, position: str, width: int) -> DataFrame:
    """Pairs (a, b, pos_a, pos_b), a < b, of items of one key at most width - 1 positions apart.

    Positions fall into buckets of width; a row meets its own and the next bucket only, so the work is
    linear in the rows that can be near each other, whatever the size of the key."""
    bucket = F.floor(F.col(position) / width)
    left = rows.select(*keys, F.col(item).alias("x"), F.col(position).alias("px"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_bucket"))
    right = rows.select(*keys, F.col(item).alias("y"), F.col(position).alias("py"), bucket.alias("_bucket"))
    near = (F.abs(F.col("px") - F.col("py")) <= width - 1) & (F.col("x") < F.col("y"))
    return left.join(right, [*keys, "_bucket"]).where(near).drop("_bucket").withColumnsRenamed({"x": "a", "y": "b", "px": "pos_a", "py": "pos_b"})


#: Pairs of rows that a worker compares at a time.
COMPARED = 1 << 19


def band_least(rows: DataFrame, keys: list[str], item: str, position: str, width: int) -> DataFrame:
    """keys, a, b and distance, the least of the pairs (a, b) of band_pairs; positions are whole numbers.

    The rows are shuffled once, by key, and sorted; a worker compares each with those near it, and no pair is shuffled
    or sorted by Spark. A worker holds the rows of one key and of one batch, and COMPARED pairs or those of one item of a key."""
    own = rows.select(*keys, F.col(item).alias("a"), F.col(position).alias("distance")).dropna()
    shape = StructType([*own.schema.fields[:-1], StructField("b", own.schema["a"].dataType), own.schema["distance"]])
    arrow, n = to_arrow_schema(shape), len(keys)

    def differs(b: pa.RecordBatch, i: int, c: pa.RecordBatch, j: int) -> bool:
        return any(b.column(k)[i] != c.column(k)[j] for k in range(n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last key so far
        for b in batches:
            if not b.num_rows:
                continue
            if held and not differs(held[0], 0, b, -1):
                held.append(b)
                continue
            cut = int(starts(b.columns[:n])[-1])
            yield from least_of(pa.Table.from_batches([*held, b.slice(0, cut)]), n, width, arrow)
            held = [b.slice(cut)]
        if held:
            yield from least_of(pa.Table.from_batches(held), n, width, arrow)

    return own.repartition(*keys).sortWithinPartitions(*keys, "distance").mapInArrow(run, shape)


def starts(columns: list) -> np.ndarray:
    """Where each run of equal values begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def least_of(rows: pa.Table, n: int, width: int, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The work of band_least on whole keys (the first n columns), in order of them and of position."""
    if rows.num_rows < 2:
        return
    rows = rows.combine_chunks()
    columns = [c.chunk(0) for c in rows.columns]
    first = starts(columns[:n])
    key = np.repeat(np.arange(len(first)), np.diff(np.append(first, rows.num_rows)))
    place = columns[n + 1].to_numpy().astype(np.int64)
    names = pc.unique(columns[n])
    names = names.take(pc.sort_indices(names))
    code = pc.index_in(columns[n], names).to_numpy().astype(np.int64)
    # keys lie further apart than width, so one search finds a row's neighbours within its key
    line = key * (place.max() - place.min() + width) + place
    low, high = np.searchsorted(line, line - (width - 1)), np.searchsorted(line, line + (width - 1), "right")
    order = np.lexsort((code, key))
    new = np.append(True, (np.diff(key[order]) != 0) | (np.diff(code[order]) != 0))
    group, count = np.cumsum(new) - 1, (high - low)[order]
    ends = np.cumsum(count)[np.append(np.flatnonzero(new)[1:], len(order)) - 1]
    bounds, begin, done = np.append(np.flatnonzero(new), len(order)), 0, 0
    while begin < len(ends):
        end = max(int(np.searchsorted(ends, done + COMPARED, "right")), begin + 1)
        at = slice(bounds[begin], bounds[end])
        own, many = order[at], count[at]
        i = np.repeat(own, many)
        j = np.arange(len(i)) + np.repeat(low[own] - (np.cumsum(many) - many), many)
        after = code[j] > code[i]
        g, i, j = np.repeat(group[at] - begin, many)[after], i[after], j[after]
        packed = np.sort((g * len(names) + code[j]) * width + np.abs(place[i] - place[j]))
        pair = packed // width
        packed = packed[np.append(True, np.diff(pair) != 0)] if len(packed) else packed
        pair = packed // width
        row = order[bounds[begin + pair // len(names)]]
        made = [*(c.take(pa.array(row)) for c in columns[: n + 1]), names.take(pa.array(pair % len(names))), pa.array(packed % width)]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, arrow, strict=True)], schema=arrow)
        begin, done = end, int(ends[end - 1])


def gathered(rows: DataFrame, keys: list[str], item: str, position: str) -> DataFrame:
    """keys and own, the rows of each key as an array in order of position and item. For keys that hold few rows each
    (the sentences of an episode): one shuffle of the rows, and their pairs are made in place."""
    own = F.struct(F.col(position).alias("p"), F.col(item).alias("x"))
    return rows.dropna(subset=[*keys, item]).groupBy(*keys).agg(F.sort_array(F.collect_list(own)).alias("own")).where(F.size("own") > 1)


def few_pairs(rows: DataFrame, keys: list[str], item: str, position: str, width: int) -> DataFrame:
    """keys, a and b of the pairs of band_pairs, for keys of few rows each."""

    def after(x, i):
        near = F.filter(F.slice("own", i + 2, F.size("own")), lambda y: (y["p"] - x["p"] <= width - 1) & (x["x"] != y["x"]))
        return F.transform(near, lambda y: F.struct(F.least(x["x"], y["x"]).alias("a"), F.greatest(x["x"], y["x"]).alias("b")))

    found = gathered(rows, keys, item, position)
    return found.select(*keys, F.explode(F.flatten(F.transform("own", after))).alias("z")).select(*keys, "z.a", "z.b")


def equal_pairs(rows: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Unordered pairs (a, b), a < b, of distinct items that share every key, for keys of few rows each."""
    own = rows.dropna(subset=[*keys, item]).groupBy(*keys).agg(F.sort_array(F.collect_set(item)).alias("own")).where(F.size("own") > 1)
    pairs = F.flatten(F.transform("own", lambda x, i: F.transform(F.slice("own", i + 2, F.size("own")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return own.select(*keys, F.explode(pairs).alias("z")).select(*keys, "z.a", "z.b")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, how: str, width: int = 64) -> DataFrame:
    """left_semi or left_anti join on [start, end) overlap within the keys, by buckets of width."""
    spread = lambda df: df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.greatest(F.col(end) - 1, F.col(start))) / width))))
    numbered = left.withColumn("_row", F.struct(*left.columns))
    a = spread(numbered).select(*keys, "_bucket", F.col(start).alias("_s"), F.col(end).alias("_e"), "_row")
    b = spread(right.select(*keys, start, end)).select(*keys, "_bucket", F.col(start).alias("_s2"), F.col(end).alias("_e2"))
    hit = a.join(b, [*keys, "_bucket"]).where("_s < _e2 AND _s2 < _e").select("_row").distinct()
    return numbered.join(hit, "_row", how).select(*left.columns)


def closest(left: DataFrame, right: DataFrame, keys: list[str], position: str, limit: int) -> DataFrame:
    """For each key the pair of positions (pos_a, pos_b) nearest to each other, within limit."""
    bucket = F.floor(F.col(position) / (limit + 1))
    a = left.select(*keys, F.col(position).alias("pos_a"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    b = right.select(*keys, F.col(position).alias("pos_b"), bucket.alias("_b"))
    near = a.join(b, [*keys, "_b"]).withColumn("distance", F.abs(F.col("pos_a") - F.col("pos_b"))).where(F.col("distance") <= limit)
    best = near.groupBy(*keys).agg(F.min(F.struct("distance", "pos_a", "pos_b")).alias("m"))
    return best.select(*keys, "m.distance", "m.pos_a", "m.pos_b")


def containing_all(postings: DataFrame, wanted: list[str], term: str, key: str) -> DataFrame:
    """Keys whose postings hold every wanted term. The filter on terms comes before the aggregate."""
    found = postings.where(F.col(term).isin(wanted)).groupBy(key).agg(F.count_distinct(term).alias("_n"))
    return found.where(F.col("_n") == len(set(wanted))).select(key)
