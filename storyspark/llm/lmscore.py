"""Language-model scores from an Elias-Fano n-gram trie with quantised smoothed probabilities.

The model is a word trigram with Dirichlet smoothing down to an add-0.1 unigram p1:
p2(x|w) = n(w,x) / (c(w) + prior2) + prior2 / (c(w) + prior2) * p1(x) after a known word w, and
p3(x|v,w) = n(v,w,x) / (c(v,w) + prior3) + prior3 / (c(v,w) + prior3) * p2(x|w) after a pair v,w that was seen.
The trie holds the first parts of both. Its levels are the contexts, pointers to their successors, the
successors' ids made monotone by each context's base, the pointers of these pairs to the words that
follow them, and those words, all Elias-Fano coded, with one byte for each number: its logarithm to a
fixed step. The weight of p2 follows from a pair's own number, of which c(v,w) is a multiple.

The trie is cut into shards by pair. Blocks of documents count; a shard is built from all counts and
written to the shared folder; then the tasks that score map the shards' levels into memory and search
them as they are, without decoding them. No count is dropped, and shards, like blocks, grow in number
and not in size.
"""

from __future__ import annotations

import mmap
import zlib
from functools import partial

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as corpus
from .blocks import Words, answered, ask, by_shard, dealt, encoded, gathered, over_blocks, pack, questions, totals, unpack
from .common import discard, table

END = np.uint64(0x5EED0FE4D0C5E2D5)
ADD = 0.1
#: Weight of the shorter context, in tokens, after one and after two words.
PRIORS = (5.0, 2.0)
HELD_OUT = 10
#: Tokens of the corpus per shard of the trie.
SHARD_TOKENS = 1 << 20
#: Text of a block: the more of it, the fewer of its words and n-grams are asked for again by other blocks.
BLOCK_BYTES = 4 << 20
build_blocks = partial(corpus.build_blocks, block_bytes=BLOCK_BYTES)
ALL = 0xFFFFFFFFFFFFFFFF
#: Bytes of payloads searched at once: enough for long arrays, few enough for a processor's cache.
TOGETHER = 1 << 18
#: A number's code is its logarithm in these steps, from 1 for one itself; numbers below the last code take it.
STEP = 9 / 254
CODES = np.append(0.0, 10.0 ** (-STEP * np.arange(255)))


def quantised(value: np.ndarray) -> np.ndarray:
    """Codes of numbers in (0, 1]; 0, the code of nothing, is never among them."""
    return (np.clip(np.rint(-np.log10(value) / STEP), 0, 254) + 1).astype(np.uint8)


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class EliasFano:
    """A non-decreasing sequence in its coded form: low bits packed, high bits in unary. Each word of 64
    unary bits has the number of ones before it, by which any element is found without decoding."""

    LINE = 64
    CHUNK = 1 << 15
    #: Place of the k-th one in a byte, and what adds up or spreads the bytes of a word.
    SELECT = np.array([[*(k for k in range(8) if b >> k & 1), *[8] * (8 - b.bit_count())] for b in range(256)], np.int64)
    BYTES, TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low = min(56, max(0, (top // n).bit_length() - 1)) if n else 0
        bits = np.arange(low, dtype=np.uint64)
        step = EliasFano.CHUNK  # a multiple of 8, so chunks end at whole bytes
        packed = (((values[i : i + step, None] >> bits) & np.uint64(1)).astype(np.uint8).reshape(-1) for i in range(0, n if low else 0, step))
        lows = b"".join(np.packbits(p, bitorder="little").tobytes() for p in packed)
        lows += bytes(-len(lows) % 8 + 8)
        line = EliasFano.LINE
        high = np.zeros(-(-(n + (top >> low) + 1) // line) * line, np.uint8)
        high[(values >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
        ones = np.append(0, np.cumsum(high.reshape(-1, line).sum(1, dtype=np.int64))).astype("<i8")
        head = np.array([n, low, len(lows), len(ones)], "<i8")
        return head.tobytes() + lows + ones.tobytes() + np.packbits(high, bitorder="little").tobytes()

    def __init__(self, data, at: int = 0):
        self.n, self.low, n_low, n_ones = np.frombuffer(data, "<i8", 4, at).tolist()
        at += 32
        # eight bytes from any byte on
        self.lows = np.ndarray((n_low - 7,), "<u8", data, at, (1,))
        self.ones = np.frombuffer(data, "<i8", n_ones, at + n_low)
        self.zeros = np.arange(n_ones, dtype=np.int64) * self.LINE - self.ones
        at += n_low + 8 * n_ones
        self.high = np.frombuffer(data, "<u8", n_ones - 1, at)
        self.end = at + 8 * (n_ones - 1)

    def _select(self, rank: np.ndarray, before: np.ndarray, flip: int) -> np.ndarray:
        """Place of the rank-th one (flip 0) or zero (flip all ones) among the unary bits."""
        line = np.searchsorted(before, rank, side="right") - 1
        word = self.high[line] ^ np.uint64(flip)
        rest = (rank - before[line]).astype(np.uint64)
        # ones in each byte, then in all bytes up to it
        pair = word - (word >> np.uint64(1) & np.uint64(0x5555555555555555))
        four = (pair & np.uint64(0x3333333333333333)) + (pair >> np.uint64(2) & np.uint64(0x3333333333333333))
        sums = (four + (four >> np.uint64(4)) & np.uint64(0x0F0F0F0F0F0F0F0F)) * self.BYTES
        passed = np.bitwise_count((rest * self.BYTES | self.TOPS) - sums & self.TOPS)
        shift = passed.astype(np.uint64) * np.uint64(8)
        rest -= (sums << np.uint64(8)) >> shift & np.uint64(255)
        return line * self.LINE + shift.astype(np.int64) + self.SELECT[word >> shift & np.uint64(255), rest]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low
        return self.lows[bit >> 3] >> (bit & 7).astype(np.uint64) & np.uint64((1 << self.low) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        high = self._select(i, self.ones, 0) - i
        return high.astype(np.uint64) << np.uint64(self.low) | self._lows(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first element that is x or more (n where there is none), and whether it is x. Elements
        with the same high bits stand between two zeros; among them the low bits are bisected."""
        high = (x >> np.uint64(self.low)).astype(np.int64)
        at = np.full(len(x), self.n, np.int64)
        inside = np.flatnonzero(high < len(self.high) * self.LINE - self.n)  # so many zeros there are
        high = high[inside]
        end = self._select(high, self.zeros, ALL) - high
        begin = np.zeros(len(inside), np.int64)
        later = np.flatnonzero(high > 0)
        begin[later] = self._select(high[later] - 1, self.zeros, ALL) + 1 - high[later]
        going, low, top, wanted = np.flatnonzero(begin < end), begin, end.copy(), x[inside] & np.uint64((1 << self.low) - 1)
        while len(going):
            middle = (low[going] + top[going]) >> 1
            less = self._lows(middle) < wanted[going]
            low[going[less]] = middle[less] + 1
            top[going[~less]] = middle[~less]
            going = going[low[going] < top[going]]
        at[inside] = low
        same = np.flatnonzero(low < end)
        same = same[self._lows(low[same]) == wanted[same]]
        equal = np.zeros(len(x), bool)
        equal[inside[same]] = True
        return at, equal


class Trie:
    """One shard of the model in its coded form: contexts, pairs and triples."""

    @staticmethod
    def encode(v: np.ndarray, w: np.ndarray, pair_value: np.ndarray, degree: np.ndarray, x: np.ndarray, triple_value: np.ndarray) -> bytes:
        """v, w: pairs sorted by (v, w), with what is known of each; degree: triples of each pair; x: their last words, sorted within the pair, with what is known of each."""
        first = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
        pairs = np.append(first, len(v))
        triples = np.append(0, np.cumsum(degree))
        levels = (v[first], pairs, Trie._monotone(w, pairs), triples, Trie._monotone(x, triples))
        return b"".join([*map(EliasFano.encode, levels), quantised(pair_value).tobytes(), quantised(triple_value).tobytes()])

    @staticmethod
    def _monotone(ids: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """ids, sorted within each context, plus the context's base: one more than all before it."""
        full = np.flatnonzero(np.diff(cuts))
        base = np.zeros(len(full), np.uint64)
        if len(full):
            base[1:] = np.cumsum(ids[cuts[full[1:]] - 1] + np.uint64(1))
        return ids + np.repeat(base, np.diff(cuts)[full])

    def __init__(self, data: bytes):
        self.map = mmap.mmap(-1, max(1, len(data)))  # anonymous: nothing is left on a machine's disk
        self.map[: len(data)] = data
        at, self.levels = 0, []
        for _ in range(5):
            self.levels.append(EliasFano(self.map, at))
            at = self.levels[-1].end
        self.contexts, self.pair_pointers, self.pairs, self.triple_pointers, self.triples = self.levels
        self.pair_codes = np.frombuffer(self.map, np.uint8, self.pairs.n, at)
        self.triple_codes = np.frombuffer(self.map, np.uint8, self.triples.n, at + self.pairs.n)

    @staticmethod
    def _below(level: EliasFano, begin: np.ndarray, end: np.ndarray, ids: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Place of each id among the successors begin to end of its context (which); -1 where it is not one."""
        base = np.zeros(len(begin), np.uint64)
        inner = np.flatnonzero(begin > 0)
        base[inner] = level[begin[inner] - 1] + np.uint64(1)
        wanted = ids + base[which]
        at, hit = level.successor(wanted)
        hit &= at < end[which]
        out = np.full(len(ids), -1, np.int64)
        out[hit] = at[hit]
        return out

    def find_pairs(self, v: np.ndarray, which: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Place of each pair (v[which], w), -1 where the trie has none."""
        out = np.full(len(w), -1, np.int64)
        if not self.pairs.n or not len(w):
            return out
        at, known = self.contexts.successor(v)
        at = np.where(known, at, 0)
        begin, end = self.pair_pointers[at].astype(np.int64), self.pair_pointers[at + 1].astype(np.int64)
        own = np.flatnonzero(known[which])
        out[own] = self._below(self.pairs, begin, end, w[own], which[own])
        return out

    def find_triples(self, pair: np.ndarray, which: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Place of each triple (pair[which], x), pairs by their place; -1 where the trie has none."""
        out = np.full(len(x), -1, np.int64)
        own = np.flatnonzero(pair[which] >= 0)
        if not self.triples.n or not len(own):
            return out
        at = np.maximum(pair, 0)
        begin, end = self.triple_pointers[at].astype(np.int64), self.triple_pointers[at + 1].astype(np.int64)
        out[own] = self._below(self.triples, begin, end, x[own], which[own])
        return out


class Tokens:
    """Tokens of a block: the words of each document, lower-cased in A-Z, and its end."""

    def __init__(self, row: dict):
        words = Words(encoded(row["texts"]), fold=True)
        n = len(words.counts)
        self.sizes = words.counts + 1
        self.doc = np.repeat(np.arange(n), self.sizes)
        hashes = np.full(len(self.doc), END)
        hashes[np.arange(len(words.doc)) + words.doc] = words.hashes
        self.kinds, self.kind = np.unique(hashes, return_inverse=True)
        begin = np.cumsum(self.sizes) - self.sizes
        self.end = int(np.searchsorted(self.kinds, END)) if n else 0
        self.before = np.roll(self.kind, 1)
        self.before[begin] = self.end  # a document begins after an end
        self.inner = np.ones(len(self.doc), bool)
        self.inner[begin] = False
        rest = [None if i is None else zlib.crc32(str(i).encode()) % HELD_OUT for i in row["doc_ids"]]
        self.held_out = np.array([r == 0 for r in rest], bool)
        self.trained = np.array([r is not None and r != 0 for r in rest], bool)[self.doc]


def _ask_words(shards: int):
    def work(row):
        t = Tokens(row)
        n = np.bincount(t.kind[t.trained], minlength=len(t.kinds)).astype(np.uint64)
        order, cuts = dealt(t.kinds, shards)
        kinds, n = t.kinds[order], n[order]
        yield questions(row["block"], [(s, pack(kinds[a:b], n[a:b])) for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a])

    return work


def _add(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of payloads (word, count) with the sums of their counts."""
    kinds, n = (np.concatenate(c) for c in zip(*map(unpack, payloads), strict=True))
    order = np.argsort(kinds, kind="stable")
    kinds, n = kinds[order], n[order]
    first = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1])) if len(kinds) else np.zeros(0, np.int64)
    return kinds[first], np.add.reduceat(n, first) if len(kinds) else n


def _join_words(payloads: list[bytes]) -> bytes:
    return pack(*_add(payloads))


def _count_words(shards: int):
    """Words, their ids and training counts; sums: known words, training tokens. Frequent words have small
    ids, and an id is a rank in its shard times the number of shards: 64 bits, whatever the corpus."""

    def merge(payloads, shard):
        kinds, count = _add(payloads)
        known = np.flatnonzero(count > 0)
        ranked = known[np.argsort(-count[known].astype(np.int64), kind="stable")]
        ids = np.zeros(len(kinds), np.uint64)
        ids[ranked] = np.arange(len(ranked), dtype=np.uint64) * np.uint64(shards) + np.uint64(shard) + np.uint64(1)
        return pack(kinds, ids, count), len(known), int(count.sum())

    return merge


def _tell_words(state: bytes, payloads: list[bytes]) -> list[bytes]:
    """To each word its id, 0 for one that training has not seen, and its training count."""
    kinds, ids, count = unpack(state)
    out = []
    for p in payloads:
        at = np.searchsorted(kinds, unpack(p)[0])
        out.append(squeeze(pack(ids[at], count[at])))
    return out


class Known(Tokens):
    """Tokens with the ids and training counts of their words, and the distinct pairs (v, w) and triples
    (context, x) of known words in the order of their ids."""

    def __init__(self, row: dict, shards: int):
        super().__init__(row)
        self.ids = np.zeros(len(self.kinds), np.uint64)
        self.count = np.zeros(len(self.kinds), np.uint64)
        order, cuts = dealt(self.kinds, shards)
        for s, reply in by_shard(row["words"]).items():
            own = order[cuts[s] : cuts[s + 1]]
            self.ids[own], self.count[own] = unpack(unsqueeze(reply))
        # kinds in the order of ids, which is the same in every block
        order = np.argsort(self.ids, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.count = self.ids[order], self.count[order]
        self.kind, self.before = place[self.kind], place[self.before]
        kinds = max(1, len(order))
        known = self.count > 0
        self.both = np.flatnonzero(known[self.kind] & known[self.before])
        pairs, self.pair = np.unique(self.before[self.both] * kinds + self.kind[self.both], return_inverse=True)
        self.v, self.w = pairs // kinds, pairs % kinds
        of = np.full(len(self.kind), -1, np.int64)
        of[self.both] = self.pair
        self.after = np.roll(of, 1)  # of each token but a document's first the pair before it, -1 for none
        self.third = np.flatnonzero(self.inner & (self.after >= 0) & known[self.kind])
        triples, self.triple = np.unique(self.after[self.third] * kinds + self.kind[self.third], return_inverse=True)
        context, self.x = triples // kinds, triples % kinds
        self.degree = np.bincount(context, minlength=len(self.v))

    def dealt(self, shards: int):
        """For each shard its pairs, in order, and their triples (indexes of both)."""
        v, w = self.ids[self.v], self.ids[self.w]
        order, cuts = dealt(v * np.uint64(0xD6E8FEB86659FD93) + w, shards)
        begin = np.cumsum(self.degree) - self.degree
        for s, (a, b) in enumerate(zip(cuts.tolist(), cuts.tolist()[1:], strict=False)):
            if b > a:
                own = order[a:b]
                size = self.degree[own]
                yield s, own, np.repeat(begin[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _grouped(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal values."""
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(v)))


def _steps(v: np.ndarray) -> np.ndarray:
    return np.diff(v, prepend=v.dtype.type(0))


def _swings(v: np.ndarray) -> np.ndarray:
    """Steps up and down, the small ones of either kind as small numbers."""
    step = _steps(v.astype(np.int64))
    return (step << 1 ^ step >> 63).astype(np.uint64)


def _unswung(swings: np.ndarray) -> np.ndarray:
    return np.cumsum((swings >> np.uint64(1)).astype(np.int64) ^ -(swings & np.uint64(1)).astype(np.int64)).astype(np.uint64)


def _ask_grams(shards: int):
    """Distinct pairs and triples of known words: contexts (as steps) and how many pairs each has, second
    words, how many triples each pair has, third words; then the counts of training, of contexts (as steps:
    contexts of about the same id are about as frequent) and both."""

    def work(row):
        t = Known(row, shards)
        pair_n = np.bincount(t.pair[t.trained[t.both]], minlength=len(t.v))
        triple_n = np.bincount(t.triple[t.trained[t.third]], minlength=len(t.x))
        parts = []
        for s, own, triples in t.dealt(shards):
            first, size = _grouped(t.v[own])
            contexts = t.v[own][first]
            body = (_steps(t.ids[contexts]), size, t.ids[t.w[own]], t.degree[own], t.ids[t.x[triples]], _swings(t.count[contexts]), pair_n[own], triple_n[triples])
            parts.append((s, squeeze(pack(*body))))
        yield questions(row["block"], parts)

    return work


def _join_grams(payloads: list[bytes]) -> bytes:
    return squeeze(pack(*_sum_grams(payloads)))


def _fused(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """A number for each (high, low) that keeps their order: their bits side by side where 64 are enough,
    else those of their ranks, which are below 2^32."""
    bits = [int(c.max()).bit_length() if len(c) else 0 for c in (high, low)]
    if sum(bits) > 64:
        high, low = (np.unique(c, return_inverse=True)[1].astype(np.uint64) for c in (high, low))
        bits[1] = int(low.max()).bit_length()
    return high << np.uint64(bits[1]) | low


def _distinct(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct key, in order, a place where it stands and the sum of its n; of each key its number."""
    kinds, own = np.unique(keys, return_inverse=True)
    at = np.zeros(len(kinds), np.int64)
    at[own] = np.arange(len(keys))
    return at, np.bincount(own, weights=n, minlength=len(kinds)).astype(np.uint64), own


def _sum_grams(payloads: list[bytes]) -> tuple[np.ndarray, ...]:
    """The sums of payloads, in the same columns."""
    columns = [[] for _ in range(7)]
    for p in payloads:
        steps, size, *rest = unpack(unsqueeze(p))
        rest[3] = np.repeat(_unswung(rest[3]), size.astype(np.int64))
        for c, values in zip(columns, (np.repeat(np.cumsum(steps), size.astype(np.int64)), *rest), strict=True):
            c.append(values)
    v, w, degree, x, context, n, m = (np.concatenate(c) for c in columns)
    at, n, pair = _distinct(_fused(v, w), n)
    v, w, context = v[at], w[at], context[at]
    pair = np.repeat(pair, degree.astype(np.int64)).astype(np.uint64)
    at, m, _ = _distinct(_fused(pair, x), m)
    degree = np.bincount(pair[at].astype(np.int64), minlength=len(v))
    first, size = _grouped(v)
    return _steps(v[first]), size, w, degree, x[at], _swings(context[first]), n, m


def _build_trie(priors: tuple[float, float]):
    def merge(payloads, shard):
        steps, size, w, degree, x, context, n, m = _sum_grams(payloads)
        size, degree = size.astype(np.int64), degree.astype(np.int64)
        v, context = np.repeat(np.cumsum(steps), size), np.repeat(_unswung(context), size)
        # what training has not seen is not in the trie
        of = np.repeat(np.arange(len(w)), degree)[m > 0]
        x, m, degree = x[m > 0], m[m > 0], np.bincount(of, minlength=len(w))
        v, w, context, degree, n = (c[n > 0] for c in (v, w, context, degree, n))
        pair_value = n / (context.astype(float) + priors[0])
        after = np.append(0, np.cumsum(m))
        end = np.cumsum(degree)
        total = (after[end] - after[end - degree]).astype(float)
        state = Trie.encode(v, w, pair_value, degree, x, m / (np.repeat(total, degree) + priors[1]))
        return state, len(v), len(x)

    return merge


def _search_trie(state: bytes, payloads: list[bytes]) -> list[bytes]:
    """To each pair the code of what is known of it, then those of the triples."""
    trie, out = Trie(state), []
    ends = np.cumsum([len(p) for p in payloads]) // TOGETHER
    for own in np.split(np.arange(len(payloads)), np.flatnonzero(np.diff(ends)) + 1):
        columns = [unpack(unsqueeze(payloads[i]))[:5] for i in own]
        v = np.concatenate([np.cumsum(c[0]) for c in columns])
        size, w, degree, x = (np.concatenate([c[k] for c in columns]) for k in (1, 2, 3, 4))
        size, degree = size.astype(np.int64), degree.astype(np.int64)
        pair = trie.find_pairs(v, np.repeat(np.arange(len(size)), size), w)
        triple = trie.find_triples(pair, np.repeat(np.arange(len(w)), degree), x)
        codes = []
        for at, known, k in ((pair, trie.pair_codes, 2), (triple, trie.triple_codes, 4)):
            found = np.zeros(len(at), np.uint8)
            found[at >= 0] = known[at[at >= 0]]
            codes.append(np.split(found, np.cumsum([len(c[k]) for c in columns])[:-1]))
        out += [squeeze(a.tobytes() + b.tobytes()) for a, b in zip(*codes, strict=True)]
    return out


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _scores(shards: int, n_train: int, n_known: int, priors: tuple[float, float]):
    def work(row):
        t = Known(row, shards)
        docs = len(row["doc_ids"])
        pair, triple = np.zeros(len(t.v)), np.zeros(len(t.x))
        replies = by_shard(row["grams"])
        for s, own, triples in t.dealt(shards):
            if s in replies:
                codes = CODES[np.frombuffer(unsqueeze(replies[s]), np.uint8)]
                pair[own], triple[triples] = codes[: len(own)], codes[len(own) :]
        # a pair's training count, and from it the weight of the shorter context after the pair
        seen = pair * (t.count[t.v].astype(float) + priors[0])
        weight = np.where(pair > 0, priors[1] / (np.maximum(np.rint(seen), 1) + priors[1]), 0.0)
        unigram = (t.count.astype(float) + ADD) / (n_train + ADD * (n_known + 1))
        p1 = unigram[t.kind]
        context = t.count[t.before].astype(float)
        p = np.where(context > 0, priors[0] / (context + priors[0]) * p1, p1)
        p[t.both] += pair[t.pair]
        # after a pair that was seen its weight goes to p so far, else p stays
        after = np.where(t.inner & (t.after >= 0), np.append(weight, 0.0)[t.after], 0.0)
        p = np.where(after > 0, after * p, p)
        p[t.third] += triple[t.triple]
        total = lambda x: np.bincount(t.doc, weights=x, minlength=docs)
        yield {
            "doc_id": row["doc_ids"],
            "held_out": t.held_out,
            "n_tokens": t.sizes.astype(np.int64),
            "n_known": total(t.count[t.kind] > 0).astype(np.int64),
            "train_tokens": np.full(docs, n_train, np.int64),
            "base_score": total(np.log10(p1)),
            "score": total(np.log10(p)),
        }

    return work


def score_texts(docs: DataFrame, priors: tuple[float, float] = PRIORS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learned from every row whose crc32(doc_id as text) mod HELD_OUT is not 0. Null, empty and blank texts
    are one end token; rows that repeat are learned from as often as they stand there; a row with a null
    doc_id is scored, but neither held out nor learned from; other columns are ignored; an empty table
    gives no rows; without any training token every token has probability one. A worker holds one
    block, which is one text where that is longer than a block."""
    blocks = build_blocks(docs.select("doc_id", "text"))
    size, n = blocks.select(F.expr("aggregate(texts, 0L, (s, t) -> s + coalesce(length(t), 0L))").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    shards = max(1, int(-(-size // (6 * shard_tokens))))
    asked = ask(blocks, _ask_words(shards), n, shards)
    counted = gathered(asked, _join_words, _count_words(shards), "vocabulary")
    n_known, n_train = totals(counted)
    words = answered(asked, counted, _tell_words, "words")
    discard(asked, counted)
    known = blocks.join(words.withColumnRenamed("replies", "words"), "block", "left")
    asked = ask(known, _ask_grams(shards), n, shards)
    trie = gathered(asked, _join_grams, _build_trie(priors), "trie")
    grams = answered(asked, trie, _search_trie, "grams")
    discard(asked, trie)
    known = known.join(grams.withColumnRenamed("replies", "grams"), "block", "left")
    return over_blocks(known, _scores(shards, n_train, n_known, priors), SCORES)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
