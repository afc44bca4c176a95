"""Blocks of whole documents and questions that blocks put to shards.

Operators that compare everything with everything read a corpus as blocks of a few megabytes of text.
A block asks each of its distinct keys once, sorted into shards by the key's hash. What the blocks ask of
a shard is gathered in two steps, first within groups of GROUP blocks and then over the groups, into the
shard's state, a row of a table in the shared folder. The blocks' questions then meet the state and are
answered, and the answers meet the blocks through a bucketed join that moves no text. A key that fills a
third of the corpus costs one entry a block and then one a group; a shard that is asked more than
ASKED_BYTES because of such a key is answered in parts that each meet a copy of its state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import MOST_PARTITIONS, TIDY, materialize, partitions, shared_dir, sized_partitions, written_at

BLOCK_BYTES = 2 << 20
#: Blocks whose questions to one shard are gathered at once.
GROUP = 1 << 12
#: Questions that one task answers at once.
ASKED_BYTES = 64 << 20
WHITE_BYTES = [0x20, *range(0x09, 0x0E)]
MULTIPLIER = 0x9E3779B97F4A7C15
WORD = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, MULTIPLIER, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _byte_table(fold: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER))
    if fold:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    values[WHITE_BYTES] = 0
    return values


class Words:
    """Words of a block's texts: where each begins and ends in data, its document, its 64-bit hash."""

    def __init__(self, texts: list[bytes], fold: bool = False):
        self.data = b" ".join(texts) + b" "
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.text_starts = np.cumsum(sizes) - sizes
        raw = np.frombuffer(self.data, np.uint8)
        white = np.zeros(256, bool)
        white[WHITE_BYTES] = True
        edge = np.diff(white[raw].view(np.int8), prepend=np.int8(1))
        self.starts = np.flatnonzero(edge == -1)
        self.ends = np.flatnonzero(edge[1:] == 1) + 1 if len(self.starts) else self.starts
        self.ends = self.ends[-len(self.starts) :] if len(self.starts) else self.ends
        self.doc = np.searchsorted(self.text_starts, self.starts, side="right") - 1
        self.counts = np.bincount(self.doc, minlength=len(texts))
        self.first = np.cumsum(self.counts) - self.counts
        if not len(self.starts):
            self.hashes = np.zeros(0, np.uint64)
            return
        begin = self.starts[0]
        spans = np.diff(np.append(self.starts, len(raw)))
        place = np.arange(begin, len(raw), dtype=np.int32) - np.repeat(self.starts.astype(np.int32), spans)
        lengths = self.ends - self.starts
        place = np.minimum(place, lengths.max())
        terms = _byte_table(fold)[raw[begin:]] * _powers(int(lengths.max()) + 1)[place]
        self.hashes = mix(np.add.reduceat(terms, self.starts - begin) + lengths.astype(np.uint64) * np.uint64(MULTIPLIER))

    def span(self, a: int, b: int) -> bytes:
        """Words a to b (b not included) joined by one space."""
        return b" ".join(self.data[self.starts[a] : self.ends[b - 1]].split()) if b > a else b""


def rolled(hashes: np.ndarray, k: int, multiplier: int = MULTIPLIER) -> np.ndarray:
    """Hash of every k consecutive words; another odd multiplier gives an independent hash."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * np.uint64(pow(multiplier, j + 1, 1 << 64))
    return mix(out)


def planes(x: np.ndarray) -> bytes:
    """Bytes of x by significance, so that small numbers compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(data, kind: str, n: int, at: int) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind), at + n * size


def pack(*columns: np.ndarray) -> bytes:
    """Columns of unsigned integers, each as narrow as its largest value allows."""
    parts = []
    for x in columns:
        width = next(k for k in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * k)
        parts.append(np.array([len(x), width], "<i8").tobytes() + planes(x.astype(f"<u{width}")))
    return b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, width = np.frombuffer(data, "<i8", 2, at).tolist()
        column, at = unplanes(data, f"<u{width}", n, at + 16)
        out.append(column.astype(np.uint64))
    return out


def build_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, doc_ids, texts and extra (the other columns, as an array of structs), written as a table in
    the shared folder that is bucketed by block. A block holds whole documents, one at least."""
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    extra = StructType([docs.schema[c] for c in others])
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *others)
    kinds = to_arrow_schema(extra)
    kind = pa.struct(list(kinds))

    def run(batches):
        ids, texts, rest, held, seq, part = [], [], [], 0, 0, TaskContext.get().partitionId()

        def flush():
            arrays = [pa.array([(part << 32) | seq], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.string()))]
            if others:
                arrays.append(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays(rest)))
            return pa.RecordBatch.from_arrays(arrays, ["block", "doc_ids", "texts", *["extra"] * bool(others)])

        for b in batches:
            whole = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(b.columns[2:], kinds, strict=True)], fields=list(kinds)) if others else None
            at = 0
            for k, text in enumerate(b.column(1)):
                texts.append(text.as_py())
                ids.append(b.column(0)[k].as_py())
                held += len(texts[-1] or "")
                if held >= block_bytes or len(ids) >= 1 << 20:
                    if others:
                        rest.append(whole[at : k + 1])
                    at = k + 1
                    yield flush()
                    ids, texts, rest, held, seq = [], [], [], 0, seq + 1
            if others and at < len(b):
                rest.append(whole[at:])
        if ids:
            yield flush()

    schema = StructType.fromDDL("block bigint, doc_ids array<bigint>, texts array<string>")
    if others:
        from pyspark.sql.types import ArrayType

        schema = schema.add("extra", ArrayType(extra, False))
    return _bucketed(rows.mapInArrow(run, schema), sized_partitions(docs), "block")


def encoded(texts: list) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def over_blocks(blocks: DataFrame, work: Callable[[dict], Iterator[dict]], schema: str | StructType) -> DataFrame:
    """work on each block (a dict of its columns); it yields dicts of arrays, one per column of schema."""
    arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    names = blocks.columns

    def run(batches):
        for b in batches:
            for k in range(len(b)):
                row = {n: b.column(i)[k].as_py() if n != "extra" else b.column(i)[k].values for i, n in enumerate(names)}
                for made in work(row):
                    yield pa.RecordBatch.from_arrays([made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in arrow], names=arrow.names)

    return blocks.mapInArrow(run, schema)


def dealt(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts keys by shard (keys stay in their order within one), and where each shard begins."""
    shard = (mix(keys) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))


def questions(block: int, parts: list[tuple[int, bytes]]) -> dict:
    return {"shard": [s for s, _ in parts], "block": [block] * len(parts), "payload": [p for _, p in parts]}


ASKED = "shard int, block bigint, payload binary"


def _bucketed(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df as a table in the shared folder, bucketed by keys: what is grouped by them moves no more."""
    spark = df.sparkSession
    name = f"{keys[0]}s_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    spark.conf.set(TIDY, "true")
    df.write.option("path", path).option("compression", "zstd").bucketBy(n, *keys).saveAsTable(name)
    out = spark.table(name)
    out.schema  # noqa: B018  resolved before the name goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return written_at(out, path)


def ask(blocks: DataFrame, work: Callable[[dict], Iterator[dict]], count: int, shards: int) -> DataFrame:
    """shard, group, block, payload: what each of the (count) blocks asks of each shard, in the shared folder.
    Shards take longer than their bytes suggest, so each may have a task."""
    groups = -(-max(1, count) // GROUP)
    n = max(partitions(blocks.sparkSession), min(MOST_PARTITIONS, shards))
    group = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group")
    asked = over_blocks(blocks, work, ASKED).select("shard", group, "block", "payload")
    asked = _bucketed(asked.repartition(n, "shard", "group"), n, "shard", "group")
    asked._groups, asked._tasks = groups, n
    return asked


def gathered(asked: DataFrame, combine: Callable[[list[bytes]], bytes], merge: Callable[[list[bytes], int], tuple[bytes, int, int]], name: str) -> DataFrame:
    """shard, state, x, y, asked: combine joins the payloads of one group of blocks into one, merge those of a
    shard's groups (and its number) into its state and two numbers; asked is the size of the questions.
    A lone group's payloads are merged at once. Written to the shared folder."""

    def join(t: pa.Table) -> pa.Table:
        payloads = t.column("payload").to_pylist()
        return pa.table({"shard": t.column("shard").slice(0, 1), "payload": pa.array([combine(payloads)], pa.binary()), "asked": pa.array([sum(map(len, payloads)) + 64 * len(payloads)], pa.int64())})

    def unite(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        payloads = t.column("payload").to_pylist()
        state, x, y = merge(payloads, shard)
        size = sum(t.column("asked").to_pylist()) if "asked" in t.column_names else sum(map(len, payloads)) + 64 * len(payloads)
        return pa.table({"shard": pa.array([shard], pa.int32()), "state": pa.array([state], pa.binary()), **{n: pa.array([v], pa.int64()) for n, v in (("x", x), ("y", y), ("asked", size))}})

    rows, united = asked.select("shard", "group", "payload"), "shard int, state binary, x bigint, y bigint, asked bigint"
    if asked._groups == 1:  # the states lie where their questions do
        made = rows.groupBy("shard", "group").applyInArrow(unite, united)
        return _bucketed(made.select(F.lit(0).alias("group"), "*"), asked._tasks, "shard", "group")
    joined = rows.groupBy("shard", "group").applyInArrow(join, "shard int, payload binary, asked bigint")
    return materialize(joined.repartition(asked._tasks, "shard").groupBy("shard").applyInArrow(unite, united), name)


def answered(asked: DataFrame, states: DataFrame, answer: Callable[[bytes, list[bytes]], list[bytes]], name: str) -> DataFrame:
    """block and its replies (shard, reply): answer(state, payloads) replies to each payload that asks the
    state's shard; a shard without a state does not reply. What is broadcast has one row for each
    ASKED_BYTES of questions at most."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):  # nothing asked, or nothing known
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.binary())], ["block", "shard", "reply"])
        replies = answer(right.column("state")[0].as_py(), left.column("payload").to_pylist())
        return pa.table([left.column("block"), left.column("shard"), pa.chunked_array([pa.array(replies, pa.binary())])], ["block", "shard", "reply"])

    if asked._groups == 1:
        questions_, held = asked, states.select("shard", "group", "state")
    else:
        parts = F.ceil(F.col("asked") / ASKED_BYTES)
        hot = F.broadcast(states.where(parts > 1).select("shard", parts.alias("parts")))
        part = F.pmod(F.xxhash64("block"), F.coalesce("parts", F.lit(1))).alias("group")
        questions_ = asked.drop("group").join(hot, "shard", "left").select("shard", part, "block", "payload").repartition(asked._tasks, "shard", "group")
        held = states.select("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("group"), "state")
    made = questions_.groupBy("shard", "group").cogroup(held.groupBy("shard", "group")).applyInArrow(run, "block bigint, shard int, reply binary")
    made = materialize(made, name)
    out = made.groupBy("block").agg(F.collect_list(F.struct("shard", "reply")).alias("replies"))
    out._written = made._written
    return out


def totals(states: DataFrame) -> tuple[int, int]:
    """Sums of x and y over all shards."""
    return tuple(states.agg(F.coalesce(F.sum("x"), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0))).first())


def by_shard(replies: list | None) -> dict[int, bytes]:
    return {r["shard"]: r["reply"] for r in replies or ()}
