"""Removal of long repeated word sequences through a compacted de Bruijn graph of word k-mers.

Every k-mer of words is an edge between the two (k-1)-mers it overlaps. Only edges that may repeat are
gathered: each is represented by the smallest hash among the shorter word sequences inside it, equal edges
share that representative, and one seen in a single document settles all its edges at once. A repeated
edge takes as its source the place of its first occurrence in the document with the smallest id.

The repeated edges make the graph. Its nodes' degrees are a grouped count; edges that meet in a node with
one edge in and one out are joined, within a document by their places and across documents by pointer
doubling, into paths without a branch. A document's run of repeated edges is verified path by path: the
words of each path's part are digested where its source stands, once for all documents that hold it, and
only what has the same words is removed.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import Words, answered, ask, build_blocks, by_shard, dealt, encoded, gathered, over_blocks, pack, questions, rolled, unpack
from .common import discard, materialize, table

K = 13
#: Words of the corpus per shard of edges.
SHARD_WORDS = 1 << 21
#: An edge is known by two independent hashes, 128 bits; n counts the blocks that hold it, up to 2.
SOURCE = np.dtype([("edge", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("place", "<i4"), ("n", "u1")])
#: Multiplier of the second hash.
OTHER = 0xC2B2AE3D27D4EB4F


class Edges:
    """The k-mers of a block that lie within one document with an id."""

    def __init__(self, row: dict, k: int):
        self.words = w = Words(encoded(row["texts"]))
        n = max(0, len(w.hashes) - k + 1)
        ids = np.array([0 if i is None else i for i in row["doc_ids"]], np.int64)
        named = np.array([i is not None for i in row["doc_ids"]], bool)
        whole = (w.doc[:n] == w.doc[k - 1 :]) & named[w.doc[:n]] if n else np.zeros(0, bool)
        self.at = np.flatnonzero(whole)
        self.local = w.doc[self.at]
        self.doc = ids[self.local]
        self.place = (self.at - w.first[self.local]).astype(np.int32)
        self.edge = rolled(w.hashes, k)[self.at]
        self.check = rolled(w.hashes, k, OTHER)[self.at]
        inner = max(1, 2 * k // 5)
        least = rolled(w.hashes, inner)
        for _ in range(k - inner):
            least = np.minimum(least[:-1], least[1:])
        self.least = least[self.at]

    def representatives(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct representatives, whether the block has each in two documents, and each edge's index."""
        distinct, index = np.unique(self.least, return_inverse=True)
        low, high = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, index, self.doc)
        np.maximum.at(high, index, self.doc)
        return distinct, low < high, index

    def firsts(self, own: np.ndarray) -> np.ndarray:
        """First occurrence (smallest document, then place) of each distinct edge among those chosen."""
        found = np.zeros(len(own), SOURCE)
        found["edge"], found["check"], found["doc"], found["place"], found["n"] = self.edge[own], self.check[own], self.doc[own], self.place[own], 1
        return first_of_each(found)

    def repeated(self, elsewhere: np.ndarray) -> np.ndarray:
        """Indexes of the edges that stand in the block more than once or are among those of elsewhere
        (by the first hash alone)."""
        order = np.argsort(self.edge)
        edge = self.edge[order]
        same = edge[1:] == edge[:-1]
        chosen = np.append(same, False) | np.append(False, same) if len(edge) else np.zeros(0, bool)
        chosen |= np.isin(edge, elsewhere)
        return np.sort(order[chosen])


def first_of_each(found: np.ndarray) -> np.ndarray:
    """The first row of each edge, with the sum of the rows' n, up to 2; sorted by edge."""
    if not len(found):
        return found
    order = np.lexsort((found["place"], found["doc"]))
    order = order[np.lexsort((found["check"][order], found["edge"][order]))]
    edge, check = found["edge"][order], found["check"][order]
    first = np.flatnonzero(np.append(True, (edge[1:] != edge[:-1]) | (check[1:] != check[:-1])))
    out = found[order[first]]
    out["n"] = np.minimum(np.add.reduceat(found["n"][order].astype(np.int64), first), 2)
    return out


def places_of(sources: np.ndarray, edge: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Index of each edge among sources (sorted, distinct); -1 where it is not there."""
    out = np.full(len(edge), -1, np.int64)
    known, checks = np.ascontiguousarray(sources["edge"]), np.ascontiguousarray(sources["check"])
    at, going = np.searchsorted(known, edge), np.arange(len(edge))
    while len(going):  # a second round only where first hashes collide
        inside = at < len(known)
        going, at = going[inside], at[inside]
        same = known[at] == edge[going]
        going, at = going[same], at[same]
        hit = checks[at] == check[going]
        out[going[hit]] = at[hit]
        going, at = going[~hit], at[~hit] + 1
    return out


def _dealt_out(row: dict, keys: np.ndarray, shards: int, payload) -> dict:
    order, cuts = dealt(keys, shards)
    return questions(row["block"], [(s, payload(order[a:b])) for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a])


def _ask_representatives(k: int, shards: int):
    def work(row):
        distinct = np.unique(Edges(row, k).least)
        yield _dealt_out(row, distinct, shards, lambda own: pack(distinct[own], np.ones(len(own), np.uint64)))

    return work


def _join_representatives(payloads: list[bytes]) -> bytes:
    """Distinct representatives and in how many blocks each stands, up to 2."""
    kinds, n = (np.concatenate(c) for c in zip(*map(unpack, payloads), strict=True))
    distinct, index = np.unique(kinds, return_inverse=True)
    return pack(distinct, np.minimum(np.bincount(index, weights=n, minlength=len(distinct)), 2).astype(np.uint64))


def _shared_representatives(payloads: list[bytes], shard: int) -> tuple[bytes, int, int]:
    kinds, n = unpack(_join_representatives(payloads))
    return pack(kinds[n > 1]), int((n > 1).sum()), 0


def _tell_shared(state: bytes, payloads: list[bytes]) -> list[bytes]:
    """One bit for each representative: whether another block has it too."""
    (shared,) = unpack(state)
    own = [unpack(p)[0] for p in payloads]
    every = np.concatenate(own)
    at = np.searchsorted(shared, every)
    hit = at < len(shared)
    hit[hit] = shared[at[hit]] == every[hit]
    return [np.packbits(x).tobytes() for x in np.split(hit, np.cumsum([len(x) for x in own])[:-1])]


def _candidates(row: dict, k: int, shards: int) -> tuple[Edges, np.ndarray]:
    """The block's edges, and the first of each of those whose representative stands in two documents."""
    edges = Edges(row, k)
    distinct, within, index = edges.representatives()
    order, cuts = dealt(distinct, shards)
    for s, reply in by_shard(row["shared"]).items():
        a, b = cuts[s], cuts[s + 1]
        within[order[a:b]] |= np.unpackbits(np.frombuffer(reply, np.uint8), count=b - a).astype(bool)
    return edges, edges.firsts(np.flatnonzero(within[index]) if len(index) else index)


def _ask_sources(k: int, shards: int):
    def work(row):
        _, firsts = _candidates(row, k, shards)
        yield _dealt_out(row, firsts["edge"], shards, lambda own: firsts[own].tobytes())

    return work


def _join_sources(payloads: list[bytes]) -> bytes:
    return first_of_each(np.concatenate([np.frombuffer(p, SOURCE) for p in payloads])).tobytes()


def _shared_sources(payloads: list[bytes], shard: int) -> tuple[bytes, int, int]:
    firsts = np.frombuffer(_join_sources(payloads), SOURCE)
    return firsts[firsts["n"] > 1].tobytes(), 0, 0


def _tell_sources(state: bytes, payloads: list[bytes]) -> list[bytes]:
    """To each block which of its edges another block has too, and the documents and places of their sources."""
    sources = np.frombuffer(state, SOURCE)
    own = [np.frombuffer(p, SOURCE) for p in payloads]
    every = np.concatenate(own)
    out = []
    for at in np.split(places_of(sources, every["edge"], every["check"]), np.cumsum([len(x) for x in own])[:-1]):
        found = sources[at[at >= 0]]
        out.append(pack((at >= 0).astype(np.uint64), found["doc"].astype(np.uint64), found["place"].astype(np.uint64)))
    return out


FOUND = "kind int, block bigint, local int, doc_id bigint, place int, n int, source bigint, source_place int, nodes array<bigint>"
SOURCES, RUN = 0, 1


def _breaks(*steps: tuple[np.ndarray, int]) -> np.ndarray:
    """Where a run begins: each of the columns grows by its step within a run."""
    n = len(steps[0][0])
    cut = np.zeros(max(0, n - 1), bool)
    for column, step in steps:
        cut |= np.diff(column) != step
    return np.append(0, np.flatnonzero(cut) + 1) if n else np.zeros(0, np.int64)


def _find(k: int, shards: int):
    """Two kinds of rows: runs of repeated edges whose sources stand in the block, with their nodes; and runs
    of edges of a document that have their sources one behind the other in a document with a smaller id."""

    def work(row):
        edges, asked = _candidates(row, k, shards)
        order, cuts = dealt(asked["edge"], shards)
        replies = [np.zeros(0, SOURCE)]
        for s, reply in by_shard(row["told"]).items():
            mask, doc, place = unpack(reply)
            told = asked[order[cuts[s] : cuts[s + 1]]][mask.astype(bool)]
            told["doc"], told["place"] = doc.astype(np.int64), place.astype(np.int32)
            replies.append(told)
        replies = np.concatenate(replies)
        own = edges.repeated(replies["edge"])
        if not len(own):
            return
        sources = first_of_each(np.concatenate([edges.firsts(own), replies]))
        index = places_of(sources, edges.edge[own], edges.check[own])
        source = sources[index]
        later = source["doc"] < edges.doc[own]
        shared = np.zeros(len(sources), bool)
        shared[index[later]] = True
        shared[places_of(sources, replies["edge"], replies["check"])] = True
        here = np.flatnonzero((source["doc"] == edges.doc[own]) & (source["place"] == edges.place[own]) & shared[index])
        here = np.sort(own[here[np.unique(index[here], return_index=True)[1]]])
        first = _breaks((edges.at[here], 1), (edges.local[here], 0))
        length = np.diff(np.append(first, len(here)))
        starts = edges.at[here][first]
        offsets = np.append(0, np.cumsum(length + 1))
        node = rolled(edges.words.hashes, k - 1)[np.repeat(starts - offsets[:-1], length + 1) + np.arange(offsets[-1])]
        begins = here[first]
        source, own = source[later], own[later]
        first = _breaks((edges.at[own], 1), (edges.local[own], 0), (source["doc"], 0), (source["place"], 1))
        n = np.diff(np.append(first, len(own)))
        e, r, runs = len(begins), len(first), own[first]
        none = np.zeros(e, np.int64)
        yield {
            "kind": np.repeat(np.array([SOURCES, RUN], np.int32), [e, r]),
            "block": np.full(e + r, row["block"]),
            "local": np.append(edges.local[begins], edges.local[runs]).astype(np.int32),
            "doc_id": np.append(edges.doc[begins], edges.doc[runs]),
            "place": np.append(edges.place[begins], edges.place[runs]).astype(np.int32),
            "n": np.append(length, n).astype(np.int32),
            "source": np.append(none, source["doc"][first]),
            "source_place": np.append(none, source["place"][first]).astype(np.int32),
            "nodes": pa.ListArray.from_arrays(pa.array(np.append(offsets, np.full(r, offsets[-1])), pa.int32()), pa.array(node.view(np.int64))),
        }

    return work


def cut_at_branches(runs: DataFrame) -> DataFrame:
    """Pieces (doc_id, place, n, tail, head) of runs of edges (doc_id, place, nodes), cut at every node that
    stands in more than one place; no node inside a piece has a branch, for its other edges would stand
    in another place too."""
    at = runs.select("doc_id", "place", F.posexplode("nodes").alias("i", "node"))
    again = at.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    cuts = at.join(again, "node", "left_semi").groupBy("doc_id", "place").agg(F.collect_set("i").alias("cuts"))
    bounds = F.array_sort(F.array_union(F.array(F.lit(0), F.size("nodes") - 1), F.coalesce("cuts", F.array().cast("array<int>"))))
    cut = runs.join(cuts, ["doc_id", "place"], "left").withColumn("bounds", bounds)
    pieces = F.transform(F.slice("bounds", 2, F.size("bounds")), lambda b, j: F.struct(F.get("bounds", j).alias("a"), b.alias("b")))
    cut = cut.select("doc_id", "place", "nodes", F.explode(pieces).alias("x"))
    return cut.select("doc_id", (F.col("place") + F.col("x.a")).alias("place"), (F.col("x.b") - F.col("x.a")).alias("n"), F.get("nodes", "x.a").alias("tail"), F.get("nodes", "x.b").alias("head"))


def compacted(edges: DataFrame) -> DataFrame:
    """Paths without a branch of the graph with these edges, or pieces of n edges (doc_id, place: where it stands;
    tail, head: its nodes). Rows are pieces: doc_id, place, n (edges that follow each other there), and path_doc,
    path_place (the first piece of the path that the piece belongs to; a ring's least).

    Edges that meet in a node with one edge in and one out belong to one path. In a document they are found
    by place; pieces of different documents are joined where one's last node is the other's first, and every
    round of pointer doubling halves what is left of the way to the path's beginning."""
    ends = edges.select(F.col("tail").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(
        edges.select(F.col("head").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    )
    through = ends.groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).where("i = 1 AND o = 1").select(F.col("node").alias("tail"), F.lit(True).alias("inner"))
    marked = edges.join(through, "tail", "left").withColumn("inner", F.coalesce("inner", F.lit(False)))
    order = Window.partitionBy("doc_id").orderBy("place")
    begins = ~(F.col("inner") & F.coalesce(F.lag(F.col("place") + F.col("n")).over(order) == F.col("place"), F.lit(False)))
    numbered = marked.withColumn("begins", begins.cast("int")).withColumn("piece", F.sum("begins").over(order))
    at = F.struct("doc_id", "place").alias("id")
    pieces = numbered.groupBy("doc_id", "piece").agg(
        F.min("place").alias("place"), F.sum("n").cast("int").alias("n"),
        F.min_by("tail", "place").alias("tail"), F.min_by("inner", "place").alias("inner"), F.max_by("head", "place").alias("head"),
    )
    pieces = materialize(pieces.drop("piece"), "pieces")
    before = pieces.select(F.col("head").alias("tail"), at.alias("up"))
    state = materialize(pieces.where("inner").select("tail", at).join(before, "tail").select("id", "up", F.least("id", "up").alias("least")), "ways")
    links = state.count()
    for _ in range(links.bit_length() + 1 if links else 0):
        # who has no row of their own begins a path; a way that never ends is a ring
        beyond = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("least").alias("next_least"))
        step = state.join(beyond, "up", "left").select("id", F.coalesce("next", "up").alias("up"), F.least("least", F.coalesce("next_least", "least")).alias("least"))
        last, state = state, materialize(step, "ways")
        discard(last)
    begin = state.join(state.select(F.col("id").alias("up"), F.lit(True).alias("ring")), "up", "left_outer").select("id", F.when(F.col("ring"), F.col("least")).otherwise(F.col("up")).alias("path"))
    named = pieces.withColumn("id", F.struct("doc_id", "place")).join(begin, "id", "left").withColumn("path", F.coalesce("path", "id"))
    return named.select("doc_id", "place", "n", F.col("path.doc_id").alias("path_doc"), F.col("path.place").alias("path_place"))


def _digest(words: Words, a: int, n: int, k: int) -> bytes:
    return hashlib.blake2b(words.span(a, a + n + k - 1), digest_size=16).digest()


def _source_digests(blocks: DataFrame, spans: DataFrame, pieces: DataFrame, k: int) -> DataFrame:
    """source, source_place, n of every span, with the sizes of its parts (a part ends where a path's piece
    begins) and the digests of their words, read where the source stands."""
    homes = blocks.select("block", F.posexplode("doc_ids").alias("local", "source")).where("source IS NOT NULL")
    cuts = pieces.groupBy(F.col("doc_id").alias("source")).agg(F.sort_array(F.collect_set("place")).alias("cuts"))
    own = spans.groupBy("source").agg(F.collect_set(F.struct("source_place", "n")).alias("spans"))
    asked = own.join(cuts, "source", "left").join(homes, "source").groupBy("block").agg(F.collect_list(F.struct("source", "local", "spans", "cuts")).alias("asked"))

    def work(row):
        words = Words(encoded(row["texts"]))
        out = {"source": [], "source_place": [], "n": [], "sizes": [], "digests": []}
        for doc in row["asked"]:
            first, cuts = int(words.first[doc["local"]]), doc["cuts"] or []
            known: dict[tuple[int, int], bytes] = {}
            for span in doc["spans"]:
                place, n = span["source_place"], span["n"]
                if place + n + k - 1 > words.counts[doc["local"]]:
                    continue  # the words stand in another row with this doc_id
                edge = [place, *cuts[bisect_right(cuts, place) : bisect_left(cuts, place + n)], place + n]
                parts = list(zip(edge, edge[1:], strict=False))
                for a, b in parts:
                    if (a, b) not in known:
                        known[a, b] = _digest(words, first + a, b - a, k)
                for c, v in zip(out.values(), (doc["source"], place, n, [b - a for a, b in parts], [known[p] for p in parts]), strict=True):
                    c.append(v)
        yield out

    found = over_blocks(blocks.select("block", "texts").join(asked, "block"), work, "source bigint, source_place int, n int, sizes array<int>, digests array<binary>")
    return found.distinct()


def repeated_paths(docs: DataFrame, k: int = K, shard_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The blocks of docs, and for each block with repeats its spans: the places (local, place) at which a
    run of n edges stands that has a source, and the sizes and digests of the run's parts there."""
    blocks = build_blocks(docs)
    text, count = blocks.select(F.expr("aggregate(texts, 0L, (s, t) -> s + coalesce(length(t), 0L))").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    shards = max(1, int(-(-text // (6 * (shard_words or SHARD_WORDS)))))
    plain = blocks.select("block", "doc_ids", "texts")
    asked = ask(plain, _ask_representatives(k, shards), count, shards)
    state = gathered(asked, _join_representatives, _shared_representatives, "representatives")
    shared = answered(asked, state, _tell_shared, "shared")
    discard(asked, state)
    known = plain.join(shared.withColumnRenamed("replies", "shared"), "block", "left")
    asked = ask(known, _ask_sources(k, shards), count, shards)
    state = gathered(asked, _join_sources, _shared_sources, "sources")
    told = answered(asked, state, _tell_sources, "told")
    discard(asked, state)
    found = materialize(over_blocks(known.join(told.withColumnRenamed("replies", "told"), "block", "left"), _find(k, shards), FOUND), "found")
    discard(shared, told)
    pieces = materialize(cut_at_branches(found.where(F.col("kind") == SOURCES).select("doc_id", "place", "nodes")), "cut")
    pieces = materialize(compacted(pieces), "paths")
    runs = found.where(F.col("kind") == RUN).groupBy("block", "source", "source_place", "n").agg(F.collect_list(F.struct("local", "place")).alias("at"))
    runs = materialize(runs, "runs")
    digests = materialize(_source_digests(plain, runs.select("source", "source_place", "n").distinct(), pieces, k), "digests")
    spans = runs.join(digests, ["source", "source_place", "n"]).groupBy("block").agg(F.collect_list(F.struct("at", "sizes", "digests")).alias("spans"))
    return blocks, materialize(spans, "spans")


def verified(words: Words, spans: list, k: int):
    """local, place and n of every part of the block's runs that has its source's words."""
    for span in spans or ():
        for at in span["at"]:
            place = at["place"]
            for n, digest in zip(span["sizes"], span["digests"], strict=True):
                if _digest(words, int(words.first[at["local"]]) + place, n, k) == digest:
                    yield at["local"], place, n
                place += n


def covered(words: Words, spans: list, k: int) -> np.ndarray:
    """Which words of the block a verified path covers."""
    change = np.zeros(len(words.starts) + 1, np.int64)
    for local, place, n in verified(words, spans, k):
        a = int(words.first[local]) + place
        change[a] += 1
        change[a + n + k - 1] -= 1
    return np.cumsum(change)[:-1] > 0


def remove_repeats(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row.

    A word goes if it is covered by k consecutive words that also stand in a document with a smaller
    doc_id. Null, empty and blank texts have no words; rows that repeat a doc_id are one document in
    comparisons and give a row each; a row with a null doc_id neither loses words nor makes others lose
    any; other columns are ignored; an empty table gives no rows."""
    blocks, spans = repeated_paths(docs.select("doc_id", "text"), k)

    def work(row):
        words = Words(encoded(row["texts"]))
        gone = covered(words, row["spans"], k)
        removed = np.bincount(words.doc[gone], minlength=len(words.counts))
        kept = []
        for j, text in enumerate(encoded(row["texts"])):
            own = text.split()
            if removed[j]:
                own = compress(own, (~gone[words.first[j] : words.first[j] + words.counts[j]]).tolist())
            kept.append(hashlib.sha256(b" ".join(own)).hexdigest())
        yield {"doc_id": row["doc_ids"], "n_words": words.counts.astype(np.int64), "n_removed": removed.astype(np.int64), "kept_sha256": kept}

    rows = blocks.join(spans, "block", "left").select("block", "doc_ids", "texts", "spans")
    return over_blocks(rows, work, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def cut_repeats(docs: DataFrame, k: int = K) -> DataFrame:
    """docs with the repeated words cut from text, each with the white space before it; n_chars, if there
    is such a column, follows. Texts that lose nothing stay as they are; rows whose text had words and
    lost all of them go. Columns unchanged."""
    from pyspark.sql.types import StructType

    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    if not others:
        docs = docs.withColumn("n_chars", F.length("text"))
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    blocks, spans = repeated_paths(docs, k)

    def work(row):
        words = Words(encoded(row["texts"]))
        gone = covered(words, row["spans"], k)
        texts, stay = [], []
        for j, text in enumerate(row["texts"]):
            a, b = int(words.first[j]), int(words.first[j] + words.counts[j])
            lost = int(gone[a:b].sum())
            if lost:
                base = int(words.text_starts[j])
                left = [int(words.ends[i - 1]) if i > a else base for i in range(a, b)]
                end = base + len(text.encode("utf-8", "surrogatepass"))
                kept = [words.data[left[i - a] : words.ends[i]] for i in range(a, b) if not gone[i]]
                text = (b"".join(kept).strip(b" \t\n\v\f\r") + words.data[words.ends[b - 1] : end]).decode("utf-8", "surrogatepass")
            texts.append(text)
            stay.append(not lost or lost < b - a)
        keep = pa.array(stay)
        out = {"doc_id": pa.array(row["doc_ids"], pa.int64()).filter(keep), "text": pa.array(texts, pa.string()).filter(keep)}
        extra = row["extra"]
        for i, n in enumerate(names):
            out[n] = extra.field(i).filter(keep)
        if "n_chars" in out:
            new = [None if n is None and t is None else len(t or "") for n, t in zip(out["n_chars"].to_pylist(), out["text"].to_pylist(), strict=True)]
            out["n_chars"] = pa.array(new, pa.int64()).cast(out["n_chars"].type)
        yield out

    schema = StructType([docs.schema[c] if c not in ("doc_id", "text") else StructType.fromDDL({"doc_id": "doc_id bigint", "text": "text string"}[c])[0] for c in docs.columns])
    rows = blocks.join(spans, "block", "left").select("block", "doc_ids", "texts", "extra", "spans")
    return over_blocks(rows, work, schema).select(*(others and docs.columns or ["doc_id", "text"]))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE_OP10 = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
spans AS (SELECT doc_id, i, list_slice(ws, i, i + 12) AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
firsts AS (SELECT gram, min(doc_id) AS source FROM spans GROUP BY gram),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM spans JOIN firsts USING (gram) WHERE source < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL) AS t
         FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
