"""Dense vectors: likeness, nearest neighbours, clusters, truncation, text chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def dot(a, b) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a, b) -> Column:
    """0 for vectors of different length or without length."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def unit(v) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def centroid(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """keys, i, x: the mean of each component."""
    return df.select(*keys, F.posexplode(v).alias("i", "_x")).groupBy(*keys, "i").agg(F.avg(F.col("_x").cast("double")).alias("x"))


def nearest(df: DataFrame, query: list[float], k: int, key: str = "id", v: str = "vec", before: Column | None = None, after: Column | None = None) -> DataFrame:
    """The k rows nearest to query by cosine: all columns and distance. before filters what is searched,
    after what was found (which may leave fewer than k rows). Ties by key."""
    rows = df if before is None else df.where(before)
    asked = F.array(*[F.lit(float(x)) for x in query])
    found = rows.withColumn("distance", F.round(1 - cosine(v, asked), 6)).orderBy("distance", key).limit(k)
    return found if after is None else found.where(after)


def soft_assign(df: DataFrame, centers: list[list[float]], slack: float, key: str = "id", v: str = "vec") -> DataFrame:
    """key, cluster, distance: the nearest centre and those within (1 + slack) of its distance (within
    0.001 + slack, where the nearest is closer than 0.001). Centres are few and given."""
    each = F.array(*[F.struct(F.lit(i).alias("cluster"), (1 - cosine(v, F.array(*[F.lit(float(x)) for x in c]))).alias("distance")) for i, c in enumerate(centers)])
    rows = df.select(key, each.alias("_d"))
    least = F.array_min(F.transform("_d", lambda x: x["distance"]))
    bound = F.when(least < 0.001, 0.001 + slack).otherwise(least * (1 + slack))
    return rows.withColumn("_b", bound).select(key, "_b", F.explode("_d").alias("x")).where("x.distance <= _b").select(key, "x.cluster", F.round("x.distance", 6).alias("distance"))


def kmeans(df: DataFrame, k: int, iterations: int = 20, seed: int = 42, key: str = "id", v: str = "vec"):
    """key and cluster by cosine k-means with a fixed seed, and the centres."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.size(v) > 0).select(key, array_to_vector(F.transform(v, lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=iterations, distanceMeasure="cosine", tol=1e-4).fit(rows)
    return model.transform(rows).select(key, F.col("prediction").alias("cluster")), [c.tolist() for c in model.clusterCenters()]


def group_means(df: DataFrame, group: str, v: str) -> DataFrame:
    """group, n, mean of the vectors (of one length) of each group. A task sends one sum a group, however many rows."""
    import numpy as np
    import pyarrow as pa

    kind = df.schema[group].dataType.simpleString()

    def sums(batches):
        held: dict = {}
        for b in batches:
            names, codes = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            x = np.stack(b.column(1).to_numpy(zero_copy_only=False)) if len(b) else np.zeros((0, 1))
            total = np.zeros((len(names), x.shape[1]))
            np.add.at(total, codes, x)
            for g, s, n in zip(names.tolist(), total, np.bincount(codes, minlength=len(names)).tolist(), strict=True):
                s0, n0 = held.get(g, (0.0, 0))
                held[g] = (s0 + s, n0 + n)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([n for _, n in held.values()], pa.int64()), pa.array([s for s, _ in held.values()], pa.list_(pa.float64()))], ["group", "n", "sum"])

    parts = df.select(group, F.transform(v, lambda x: x.cast("double"))).mapInArrow(sums, f"group {kind}, n bigint, sum array<double>")
    each = parts.select("group", "n", F.posexplode("sum").alias("i", "x")).groupBy("group", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return each.groupBy("group").agg(F.max("n").alias("n"), whole.alias("sum")).select(F.col("group").alias(group), "n", F.transform("sum", lambda x: x / F.col("n")).alias("mean"))


def _halved(rows: DataFrame, largest: int) -> DataFrame:
    """rows (id, vec, part) with the parts of more than largest rows cut in two, across the line from the part's mean to
    its farthest row, at the median. A part whose rows can't be told apart so is cut by a hash of the id."""
    means = group_means(rows, "part", "vec").where(F.col("n") > largest)
    met = rows.join(means, "part", "left")
    far = F.max_by("vec", F.struct(F.when(F.col("mean").isNotNull(), -cosine("vec", "mean")), "id"))
    ends = met.where("mean IS NOT NULL").groupBy("part").agg(far.alias("far"))
    line = F.zip_with("far", "mean", lambda a, b: a - b)
    placed = met.join(ends, "part", "left").select("id", "vec", "part", "n", F.when(F.col("far").isNotNull(), F.round(dot("vec", line), 9)).alias("place"), F.xxhash64("id").alias("luck"))
    placed = written(placed, "placed")
    middle = placed.where("place IS NOT NULL").groupBy("part").agg(F.percentile_approx("place", 0.5, 100_000).alias("cut"), F.percentile_approx("luck", 0.5, 100_000).alias("other"))
    low = placed.join(middle, "part").groupBy("part").agg(F.first("cut").alias("cut"), F.first("other").alias("other"), F.sum((F.col("place") <= F.col("cut")).cast("int")).alias("low"), F.count(F.lit(1)).alias("all"))
    fair = F.col("low").between(F.col("all") / 3, F.col("all") * 2 / 3)
    side = F.when(F.when(fair, F.col("place") <= F.col("cut")).otherwise(F.col("luck") <= F.col("other")), "0").otherwise("1")
    return placed.join(low, "part", "left").select("id", "vec", F.when(F.col("place").isNotNull(), F.concat("part", side)).otherwise(F.col("part")).alias("part"))


def cluster_tree(df: DataFrame, largest: int, key: str = "id", v: str = "vec") -> DataFrame:
    """level, node, parent, n (rows under the node at level 0: 1; above: members) of a tree: rows are bisected into groups
    of at most largest (4 or more), each group's mean is a node of the next level, and so on until a level fits.

    Every node has one parent but those of the last level, and each level has at most half as many nodes as the one
    below, as no group has fewer than two members. Means and cuts are tables; nothing is gathered on the driver but
    the number of rows. Ties and equal vectors are cut by a hash of the id, so the result is the same in every run."""
    if largest < 4:
        raise ValueError("a group needs room for four rows")
    rows = written(df.where(F.col(v).isNotNull()).select(F.col(key).cast("string").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("vec"), F.lit(1).cast("bigint").alias("n")), "level0")
    out, level = None, 0
    while True:
        n = rows.count()
        if n <= largest:
            top = rows.select(F.lit(level).alias("level"), F.col("id").alias("node"), F.lit(None).cast("string").alias("parent"), "n")
            return top if out is None else out.unionByName(top)
        parts = written(rows.select("id", "vec", F.lit(f"L{level + 1}-").alias("part")), "parts")
        while parts.groupBy("part").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > largest).limit(1).count():
            parts = written(_halved(parts, largest), "parts")
        one = rows.join(parts.select("id", F.col("part").alias("parent")), "id").select(F.lit(level).alias("level"), F.col("id").alias("node"), "parent", "n")
        out = one if out is None else out.unionByName(one)
        level += 1
        rows = written(group_means(parts, "part", "vec").select(F.col("part").alias("id"), F.col("mean").alias("vec"), "n"), f"level{level}")


def truncated(v: str, size: int, strict: bool = True) -> Column:
    """The first size components; a shorter vector is an error, or stays as it is."""
    short = F.raise_error(F.lit("vector is shorter than asked")).cast("array<double>") if strict else F.col(v)
    return F.when(F.size(v) < size, short).otherwise(F.slice(v, 1, size))


def encoded(column: str) -> Column:
    """Little-endian 32-bit floats of a vector, as a blob."""
    import numpy as np

    @F.pandas_udf("binary")
    def raw(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return raw(column)


def decoded(column: str) -> Column:
    """Little-endian 32-bit floats of a binary column."""
    import numpy as np

    @F.pandas_udf("array<float>")
    def floats(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return floats(column)


def chunks(docs: DataFrame, text: str, size: int = 1024, key: str = "id") -> DataFrame:
    """key, place, chunk: pieces of at most size characters that end at the last paragraph, or else
    sentence, break in their second half where there is one."""

    def pieces(t: str) -> list[str]:
        out, at = [], 0
        while at < len(t):
            end = min(len(t), at + size)
            if end < len(t):
                for mark in ("\n\n", ". "):
                    cut = t.rfind(mark, at + size // 2, end)
                    if cut >= 0:
                        end = cut + len(mark)
                        break
            piece = t[at:end].strip()
            if piece:
                out.append(piece)
            at = end
        return out

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: pieces(t or ""))

    return docs.select(key, F.posexplode(split(text)).alias("place", "chunk"))


def diverse(df: DataFrame, query: list[float], k: int, share: float = 0.5, pool: int = 100, key: str = "id", v: str = "vec") -> DataFrame:
    """key, place: k rows picked one by one from the pool nearest to query, each the best by
    share x likeness to query - (1 - share) x greatest likeness to those picked. Only the pool is gathered."""
    import numpy as np

    found = nearest(df, query, pool, key, v).select(key, F.transform(v, lambda x: x.cast("double")).alias("_v"), (1 - F.col("distance")).alias("_near"))
    kind = df.schema[key].dataType.simpleString()

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_near", key], ascending=[False, True]).reset_index(drop=True)
        x = np.stack(rows["_v"].to_list())
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(norm == 0, 1, norm)
        near, worst, out = rows["_near"].to_numpy(), np.zeros(len(rows)), []
        while len(out) < min(k, len(rows)):
            score = share * near - (1 - share) * worst
            score[out] = -np.inf
            best = int(np.argmax(np.round(score, 9)))
            out.append(best)
            like = x @ x[best]
            worst = like if len(out) == 1 else np.maximum(worst, like)
        return pd.DataFrame({key: rows[key].iloc[out], "place": range(1, len(out) + 1)})

    return found.groupBy().applyInPandas(pick, f"{key} {kind}, place int")
