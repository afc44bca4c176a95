"""Nearest neighbours of many queries at once: exactly, or through coarse cells.

The index deals every vector to the cell of its nearest centre. A query looks into the cells of its nearest centres only, and
what it finds there is ranked by its true distance, so results are neighbours in earnest, though a few may be missed.
Cells meet the queries that probe them in tasks of bounded size (a large cell is dealt in chunks), each task keeps
the k best of each query, and a last step merges those.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Rows that the centres are fitted on, at most (those with the smallest hash of their key), and centres, at most.
SAMPLE_ROWS = 20_000
MOST_CELLS = 4096
#: Vectors of a task, and queries of a task, about.
CHUNK = 1 << 14
#: Likenesses that a worker holds at a time, about.
HELD = 1 << 20


def unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def slices(n: int, width: int) -> list[tuple[int, int]]:
    """(begin, length) of runs of n rows, each held against width others, that keep to HELD likenesses."""
    step = max(1, HELD // max(1, width))
    return [(at, min(step, n - at)) for at in range(0, n, step)]


def least(far: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k least of each row (k at most their number), ties to the smaller id, and their values, in order.
    Only what is no farther than a row's k-th is sorted."""
    row, place = np.nonzero(far <= np.partition(far, k - 1, axis=1)[:, k - 1 : k])
    value = far[row, place]
    order = np.lexsort((ids[place], value, row))
    first = np.searchsorted(row, np.arange(len(far)))  # row is sorted, before and after
    best = order[first[:, None] + np.arange(k)]
    return place[best], value[best]


def fit_centres(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means of unit rows; an empty cell takes the row that fits its own worst."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        like = x @ centres.T
        own = like.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        worst = np.argsort(like[np.arange(len(x)), own], kind="stable")[: len(empty)]
        sums[empty] = x[worst]
        centres = unit_rows(sums)
    return centres


def neighbour_ranks(x: np.ndarray, centres: np.ndarray, queries: int = 500, k: int = 10) -> np.ndarray:
    """For the first rows as queries and their k nearest among all rows: the place, from 1, of the neighbour's cell
    in the query's order of cells."""
    order = np.argsort(-(x[:queries] @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(1, len(centres) + 1)[None, :], axis=1)
    own = (x @ centres.T).argmax(1)
    near = np.argsort(-(x[:queries] @ x.T), axis=1, kind="stable")[:, :k]
    return np.sort(np.take_along_axis(place, own[near], axis=1).ravel())


@dataclass
class VectorIndex:
    """rows: key, vec, cell, chunk, as a written table; centres, at most MOST_CELLS, are the model's whole size.
    ranks: in how many nearest cells each of a sample's true neighbours was found, sorted."""

    rows: DataFrame
    centres: np.ndarray
    key: str
    size: int
    ranks: np.ndarray

    def probes(self, recall: float = 0.95, margin: float = 0.02) -> int:
        """Cells to look into so that the sample's queries find so many of their neighbours, and a margin more."""
        return int(np.quantile(self.ranks, min(1.0, recall + margin), method="higher")) if len(self.ranks) else len(self.centres)

    def search(self, queries: DataFrame, k: int, probes: int, key: str = "query", v: str = "vec") -> DataFrame:
        """query, key, distance, place of the k nearest of each query in its `probes` nearest cells, ties to the smaller key."""
        return _searched(_probed(queries, self.centres, probes, key, v), self.rows, k, self.key)

    def read_share(self, queries: DataFrame, probes: int, key: str = "query", v: str = "vec") -> DataFrame:
        """One row: queries, and the mean share of all rows that a query is held against."""
        cells = self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        met = _probed(queries, self.centres, probes, key, v).select("query", "cell").join(cells, "cell")
        return met.agg(F.count_distinct("query").alias("queries"), (F.sum("n") / F.count_distinct("query") / self.size).alias("share"))


def _keyed(df: DataFrame, key: str, v: str, name: str) -> DataFrame:
    return df.where(F.col(v).isNotNull() & (F.size(v) > 0)).select(F.col(key).cast("bigint").alias(name), F.transform(v, lambda x: x.cast("float")).alias("vec"))


def build(df: DataFrame, key: str = "id", v: str = "vec", cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> VectorIndex:
    """Index every row with a vector; all have the same length. cells: the root of their number by default."""
    rows = _keyed(df, key, v, "id")
    n = rows.count()
    if not n:
        raise ValueError("there are no vectors to index")
    sample = np.array([r["vec"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()], np.float64)
    count = min(MOST_CELLS, len(sample), cells or max(1, round(n**0.5)))
    centres = fit_centres(unit_rows(sample), count)
    ranks = neighbour_ranks(unit_rows(sample), centres)

    def run(batches):
        for b in batches:
            for at, n in slices(len(b), len(centres)):
                some = b.slice(at, n)
                own = (unit_rows(matrix(some.column(1))) @ centres.T).argmax(1)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(own, pa.int32())], ["id", "vec", "cell"])

    dealt = rows.mapInArrow(run, "id bigint, vec array<float>, cell int")
    # chunk: a cell's rows by hash, as many chunks as its share of all rows asks for
    dealt = written(dealt, "cells")
    size = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / CHUNK)).cast("int").alias("chunk")
    return VectorIndex(written(dealt.join(size, "cell").select("id", "vec", "cell", chunk), "index"), centres, key, n, ranks)


def _probed(queries: DataFrame, centres: np.ndarray, probes: int, key: str, v: str) -> DataFrame:
    """query, vec, cell: each query once for each of its nearest cells."""
    count = min(probes, len(centres))

    def run(batches):
        for b in batches:
            for at, n in slices(len(b), len(centres)):
                some = b.slice(at, n)
                near = np.argsort(-(unit_rows(matrix(some.column(1))) @ centres.T), axis=1, kind="stable")[:, :count]
                cells = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * count, pa.array(near.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([*some.columns, cells], ["query", "vec", "cells"])

    made = _keyed(queries, key, v, "query").mapInArrow(run, "query bigint, vec array<float>, cells array<int>")
    return made.select("query", "vec", F.explode("cells").alias("cell"))


def _searched(probes: DataFrame, rows: DataFrame, k: int, key: str) -> DataFrame:
    """Each chunk of a cell against each part of the queries that probe it, then the best of each query."""
    asked = probes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts"))
    part = F.pmod(F.xxhash64("query"), F.col("parts"))
    left = probes.join(asked, "cell").join(rows.select("cell", "chunk").distinct(), "cell").select("query", "vec", F.col("cell").alias("_cell"), F.col("chunk").alias("_chunk"), part.alias("_part"))
    right = rows.join(asked, "cell").select("id", "vec", "cell", "chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["query", "id", "distance"])
        ids, x = right.column("id").to_numpy(), unit_rows(matrix(right.column("vec")))
        out = []
        keep = min(k, len(ids))
        for at, n in slices(left.num_rows, len(ids)):
            some = left.slice(at, n)
            places, far = least(np.round(1 - unit_rows(matrix(some.column("vec"))) @ x.T, 6), ids, keep)
            out.append((np.repeat(some.column("query").to_numpy(), keep), ids[places].ravel(), far.ravel()))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query", "id", "distance"])

    found = left.groupBy("_cell", "_chunk", "_part").cogroup(right.groupBy("cell", "chunk", "part")).applyInArrow(best, "query bigint, id bigint, distance double")
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("query", F.col("id").alias(key), "distance", "place")


def exact(queries: DataFrame, df: DataFrame, k: int, query: str = "query", key: str = "id", v: str = "vec", query_v: str = "vec") -> DataFrame:
    """The same over all rows: every chunk of rows meets every query, in blocks."""
    rows = _keyed(df, key, v, "id")
    count = max(1, -(-rows.count() // CHUNK))

    held = rows.select("id", "vec", F.lit(0).alias("cell"), F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias("chunk"))
    probes = _keyed(queries, query, query_v, "query").select("query", "vec", F.lit(0).alias("cell"))
    return _searched(probes, written(held, "rows"), k, key)
