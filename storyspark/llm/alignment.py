"""Alignment of two tokenizers over the same bytes, by coalescing of intervals.

Tokens are byte ranges. All tokens of both tokenizers are sorted by where they start (np.lexsort); a running
maximum of their ends (np.maximum.accumulate) cuts them into groups where a start reaches it, and within a
group the overlapping pairs are expanded. How often a pair of ids is linked in the whole corpus is counted by
block first and joined back by block, so that no table of pairs is ever on the driver or broadcast.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import _bucketed
from .common import materialize, sized_partitions, table
from .packing import OTHER, Encoder
from .pieces import MARK, ChunkTable, public_model

#: Text of a block, whose distinct pairs are counted together.
BLOCK_CHARS = 4 << 20
#: Text that is tokenised and aligned at once; a longer text is taken alone.
BATCH_CHARS = 1 << 18
#: Pair of ids as one number: A above, B below.
SHIFT = 20


def byte_level() -> dict[str, int]:
    """Character that stands for a byte in the entries of a byte-level vocabulary: printable Latin-1 stands for
    itself, the other bytes, in order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PlainEncoder(Encoder):
    """Ids of byte_bpe_50k.json for a space and the text; strings of special tokens are plain text."""

    SPECIAL = re.compile(OTHER.pattern.removesuffix(r"|<\|"))

    def __init__(self):
        super().__init__()
        self.exact.encode_special_tokens = True
        letters = byte_level()
        size = self.exact.get_vocab_size()
        self.bytes = [bytes(letters[c] for c in self.exact.id_to_token(i)) if all(c in letters for c in self.exact.id_to_token(i)) else self.exact.id_to_token(i).encode() for i in range(size)]

    def __call__(self, text: str) -> list[int]:
        text = " " + text
        if self.SPECIAL.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def piece_bytes(processor) -> list[bytes]:
    """What each piece stands for: its text with markers as spaces, or the byte that it names."""
    out = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if processor.is_byte(i) else piece.replace(MARK, " ").encode())
    return out


def coalesced(starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all tokens by start (kind 0 before 1), and in that order the number of each token's group: a
    group breaks where a start reaches the running maximum of the ends before it."""
    order = np.lexsort((kind, starts))
    if not len(order):
        return order, order
    most = np.maximum.accumulate(ends[order])
    fresh = np.append(True, starts[order][1:] >= most[:-1])
    return order, np.cumsum(fresh) - 1


def overlaps(a_starts: np.ndarray, a_ends: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and in B of all pairs whose ranges overlap; each side is in order and its ranges are apart."""
    low = np.searchsorted(b_ends, a_starts, side="right")
    n = np.searchsorted(b_starts, a_ends, side="left") - low
    a = np.repeat(np.arange(len(a_starts)), n)
    within = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
    return a, np.repeat(low, n) + within


class Aligner:
    """Both tokenizers, their tables of bytes and of the digests' parts."""

    def __init__(self, model: str):
        self.a, self.b = PlainEncoder(), ChunkTable(model)
        self.b_bytes = piece_bytes(self.b.processor)
        self.a_size = np.array([len(x) for x in self.a.bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        # an id with what follows it: , between ids, | after the last A, ; after the last B of a group
        self.ids = max(len(self.a_size), len(self.b_size))
        self.parts = [f"{i}{after}" for after in ",|;" for i in range(self.ids)]

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both; none where either doesn't spell a space and the text."""
        if not text:
            return [], []
        wanted = (" " + text).encode("utf-8", "surrogatepass")
        a, b = self.a(text), self.b.encode(text)
        if b"".join(map(self.a.bytes.__getitem__, a)) != wanted or b"".join(map(self.b_bytes.__getitem__, b)) != wanted:
            return [], []
        return a, b

    def align(self, texts: list[str | None]) -> list[dict]:
        """For each text n_a, n_b, n_groups, n_links, groups (the written form) and pairs (one number a link)."""
        both = [self.tokens(t) for t in texts]
        n_a, n_b = (np.array([len(x[k]) for x in both], np.int64) for k in (0, 1))
        a_ids, b_ids = (np.fromiter(chain.from_iterable(x[k] for x in both), np.int64, int(n.sum())) for k, n in ((0, n_a), (1, n_b)))
        a_ends, b_ends = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])  # texts end to end
        a_starts, b_starts = a_ends - self.a_size[a_ids], b_ends - self.b_size[b_ids]
        at_a, at_b = overlaps(a_starts, a_ends, b_starts, b_ends)
        pairs = a_ids[at_a] << SHIFT | b_ids[at_b]
        kind = np.repeat([0, 1], [len(a_ids), len(b_ids)])
        order, group = coalesced(np.concatenate([a_starts, b_starts]), np.concatenate([a_ends, b_ends]), kind)
        order = order[np.lexsort((kind[order], group))]  # each group's A tokens before its B tokens
        sorted_kind = kind[order]
        last = np.append(np.diff(group) > 0, np.ones(min(1, len(group)), bool))
        turn = np.append(np.diff(sorted_kind) != 0, np.zeros(min(1, len(group)), bool)) & ~last
        after = np.where(last, 2, np.where(turn, 1, 0))
        ids = np.concatenate([a_ids, b_ids])[order]
        written = list(map(self.parts.__getitem__, (after * self.ids + ids).tolist()))
        tokens_to = np.cumsum(n_a + n_b)
        links_to = np.searchsorted(at_a, np.cumsum(n_a))
        groups_to = np.append(np.cumsum(last), 0)
        out, token_at, link_at, group_at = [], 0, 0, 0
        for k, (token, link) in enumerate(zip(tokens_to.tolist(), links_to.tolist(), strict=True)):
            done = int(groups_to[token - 1]) if token else 0
            out.append({"n_a": int(n_a[k]), "n_b": int(n_b[k]), "n_groups": done - group_at, "n_links": link - link_at, "groups": "".join(written[token_at:token])[:-1], "pairs": pairs[link_at:link]})
            token_at, link_at, group_at = token, link, done
        return out


@lru_cache(1)
def _aligner(model: str) -> Aligner:
    return Aligner(model)


ALIGNED = "block bigint, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, {groups}pairs array<bigint>, times array<bigint>, kinds array<int>, own array<int>, often array<int>"


def aligned_blocks(docs: DataFrame, model: str | None = None, keep_groups: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row a block of whole documents: its documents' columns as arrays; pairs and times, the distinct id pairs
    linked in it and how often; kinds, how many distinct pairs each document has, and, end to end for all its
    documents, own (which of pairs) and often (how many times)."""
    model = model or public_model()

    def run(batches):
        aligner, part, seq = _aligner(model), TaskContext.get().partitionId(), 0
        ids, texts, made, waiting, held = [], [], [], 0, 0

        def work():
            nonlocal texts, waiting
            for x in aligner.align(texts):
                pairs, often = np.unique(x.pop("pairs"), return_counts=True)
                groups = x.pop("groups")
                made.append(x | {"sha": hashlib.sha256(groups.encode()).hexdigest() if x["n_a"] else "", "pairs": pairs, "often": often} | ({"groups": groups} if keep_groups else {}))
            texts, waiting = [], 0

        def flush():
            nonlocal ids, made, held, seq
            work()
            every = np.concatenate([x["pairs"] for x in made])
            often = np.concatenate([x["often"] for x in made])
            pairs, own = np.unique(every, return_inverse=True)
            times = np.zeros(len(pairs), np.int64)
            np.add.at(times, own, often)
            row = [pa.array([(part << 32) | seq], pa.int64()), pa.array([ids], pa.list_(pa.int64()))]
            row += [pa.array([[x[n] for x in made]], pa.list_(pa.int64())) for n in ("n_a", "n_b", "n_groups", "n_links")]
            row += [pa.array([[x[n] for x in made]], pa.list_(pa.string())) for n in ("sha", *["groups"] * keep_groups)]
            row += [pa.array([pairs], pa.list_(pa.int64())), pa.array([times], pa.list_(pa.int64()))]
            row += [pa.array([x], pa.list_(pa.int32())) for x in ([len(x["pairs"]) for x in made], own.astype(np.int32), often.astype(np.int32))]
            ids, made, held, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays(row, names)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                ids.append(doc_id)
                texts.append(text)
                size = len(text or "")
                waiting, held = waiting + size, held + size
                if waiting >= BATCH_CHARS or len(texts) >= 1 << 14:
                    work()
                if held >= block_chars or len(ids) >= 1 << 18:
                    yield flush()
        if ids:
            yield flush()

    schema = ALIGNED.format(groups="groups array<string>, " * keep_groups)
    names = [c.split()[0] for c in schema.split(", ")]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair and n: how many links of the corpus hold it."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    return each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))


def align(docs: DataFrame, model: str | None = None, keep_groups: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups, as written) of every row.

    A is byte_bpe_50k.json over a space and the text, B the SentencePiece model over the text; neither has special
    tokens. Null and empty texts, and those that either tokenizer doesn't spell byte by byte, have no tokens: zeros
    and an empty digest; they link nothing. Rows that repeat count each; a null doc_id stays null; an empty table
    gives no rows; other columns are ignored.

    Only a block's distinct pairs move: once to be counted (the same pair of all blocks meets in a sum, after
    partial sums), and once, with their counts, back to their block, which is bounded whatever the corpus."""
    blocks = _bucketed(aligned_blocks(docs, model, keep_groups, block_chars), sized_partitions(docs), "block")
    counts = materialize(pair_counts(blocks), "pair_counts")
    by_b = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    most = counts.groupBy(by_b.alias("b")).agg(F.max("n").alias("most"))
    known = counts.join(F.broadcast(most), by_b == F.col("b"))  # at most as many rows as B has ids
    known = known.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    asked = blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    told = asked.join(known, "pair").select(F.col("block").alias("of"), "at", "n", "best")

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {n: left.column(n)[0] for n in left.column_names}
        n = np.zeros(right.num_rows, np.int64)
        best = np.zeros(right.num_rows, bool)
        at = right.column("at").to_numpy()
        n[at], best[at] = right.column("n").to_numpy(), right.column("best").to_numpy()
        kinds, own, often = (row[c].values.to_numpy() for c in ("kinds", "own", "often"))
        document = np.repeat(np.arange(len(kinds)), kinds)
        n_best, count_sum = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
        np.add.at(n_best, document, np.where(best[own], often, 0))
        np.add.at(count_sum, document, n[own] * often)
        columns = [row["doc_ids"].values, *(row[c].values for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(n_best), pa.array(count_sum), *(row[c].values for c in names[7:])]
        return pa.table(columns, names)

    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string" + ", groups string" * keep_groups
    names = [c.split()[0] for c in schema.split(", ")]
    held = blocks.drop("pairs", "times")
    return held.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(fill, schema)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
