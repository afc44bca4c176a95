import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from storyspark.llm import packing, pieces

SCHEMA = "doc_id bigint, text string, ids string, piece int, lang string, part string"
TEXTS = [None, "", " ", "   ", "the", " the", "the ", "a  b   c\n\nd\t e", "▁x ▁▁ y", "日本 語 𝔘nicode\u0000 é̀", "the " * 3000, "x" * 5000, "<s> </s> <unk> <|endoftext|> don't", "   \x1c 12३", "dup", "dup"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in enumerate(texts)], SCHEMA)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁\nabthe.é<0x>語"), st.characters(codec="utf-8")), max_size=60))
def test_chunk_table_encodes_like_the_library(text):
    words = test_chunk_table_encodes_like_the_library.words = getattr(
        test_chunk_table_encodes_like_the_library, "words", None
    ) or pieces.ChunkTable(pieces.public_model(), limit=50)
    assert words.encode(text) == words.processor.encode(text)


def test_sentencepiece_rows(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in pieces.encode(frame(spark, TEXTS)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want = sp.encode(t or "", add_bos=True, add_eos=True)
        assert (got[i].ids, got[i].text) == (want, sp.decode(want))
        n, ids_sha, text_sha = pieces._digests(want, sp.decode(want))
        assert ids_sha == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest() and n == len(want)
        assert text_sha == hashlib.sha256(sp.decode(want).encode()).hexdigest()
    assert pieces.encode(frame(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'abcst09.,é<| \x85\x1c"), st.characters(codec="utf-8")), max_size=60))
def test_ranks_encode_like_the_tokenizer_file(text):
    encode = test_ranks_encode_like_the_tokenizer_file.encode = getattr(
        test_ranks_encode_like_the_tokenizer_file, "encode", None
    ) or packing.Encoder()
    assert encode(text) == encode.exact.encode(text, add_special_tokens=False).ids


def lower_bound(histogram, capacity):
    """Martello and Toth's L2."""
    best = 0
    for k in range(capacity // 2 + 1):
        big = sum(n for w, n in histogram.items() if w > capacity - k)
        mid = {w: n for w, n in histogram.items() if capacity / 2 < w <= capacity - k}
        small = sum(w * n for w, n in histogram.items() if k <= w <= capacity / 2)
        room = sum(n * (capacity - w) for w, n in mid.items())
        best = max(best, big + sum(mid.values()) + max(0, -(-(small - room) // capacity)))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_bins_hold_every_piece_and_are_few(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 1024])
    histogram = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(rng.randint(1, 80))}
    bins = packing.plan_bins(histogram, capacity)
    held = Counter()
    for lengths, times in bins:
        assert times > 0 and sum(lengths) <= capacity
        for w in lengths:
            held[w] += times
    assert held == Counter(histogram)
    n, bound = sum(t for _, t in bins), lower_bound(histogram, capacity)
    assert bound <= n <= bound * 1.1 + 1


def test_reduction_keeps_the_optimum():
    """Against an exhaustive search: fixing the dominating sets never costs a bin."""

    def optimum(items, capacity):
        best = [len(items)]

        def put(k, rooms):
            if len(rooms) >= best[0]:
                return
            if k == len(items):
                best[0] = len(rooms)
                return
            for j in range(len(rooms)):
                if rooms[j] >= items[k] and rooms[j] not in rooms[:j]:
                    put(k + 1, [*rooms[:j], rooms[j] - items[k], *rooms[j + 1 :]])
            put(k + 1, [*rooms, capacity - items[k]])

        put(0, [])
        return best[0]

    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.choice([10, 20, 37])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        count = Counter(items)
        fixed = packing.reduce_dominated(count, capacity)
        left = sorted(count.elements(), reverse=True)
        assert sum(t for _, t in fixed) + (optimum(left, capacity) if left else 0) == optimum(items, capacity)


def test_packing_rows(spark):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(frame(spark, TEXTS).repartition(3), keep_ids=True).collect()
    docs, places = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 1024
        docs[r.doc_id].append((r.piece, r.start, r.ids))
        places[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(TEXTS):
        want = [*exact.encode(t or "", add_special_tokens=False).ids, 2]
        parts = sorted(docs[i])
        assert [x for p in parts for x in p[2]] == want and [p[0] for p in parts] == list(range(len(parts)))
        head = len(want) % 1024 or 1024  # only the first piece may be shorter
        assert [p[1] for p in parts] == [0, *range(head, len(want), 1024)]
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(frame(spark, [])).count() == 0


def test_only_the_first_piece_is_shorter(spark):
    texts = ["the " * 3000, "x" * 5000, "the", "the " * 1022 + "the", None]
    encode, docs = packing.Encoder(), defaultdict(list)
    for r in packing.pack(frame(spark, texts)).collect():
        docs[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for i, t in enumerate(texts):
        want = np.array([*encode(t or ""), packing.END], "<u4")
        head, rows = len(want) % 1024, []
        for a, b in zip([0, *range(head or 1024, len(want), 1024)], [*range(head or 1024, len(want) + 1, 1024)], strict=True):
            rows.append((len(rows), a, b - a, zlib.crc32(want[a:b].tobytes())))
        assert sorted(docs[i]) == rows
    assert len(docs[0]) > 1 and docs[0] and min(docs[0])[2] < 1024
    assert len([*encode(texts[3]), packing.END]) == 1024 and len(docs[3]) == 1


def test_pieces_around_whole_capacities(spark):
    lengths = [1024 * k + d for k in (1, 2, 3) for d in (-1, 0, 1)]
    docs = frame(spark, ["the " * (n - 2) + "the" for n in lengths])
    got = defaultdict(list)
    for r in packing.pack(docs).collect():
        got[r.doc_id].append((r.piece, r.start, r.length))
    for i, n in enumerate(lengths):
        head = n % 1024 or 1024
        starts = [0, *range(head, n, 1024)]
        assert sorted(got[i]) == [(k, a, b - a) for k, (a, b) in enumerate(zip(starts, [*starts[1:], n]))]


def test_dominating_sets_save_a_sequence():
    items, capacity = [36, 35, 32, 19, 16, 13, 10, 8, 8, 3], 37
    count = Counter(items)
    fixed = packing.reduce_dominated(count, capacity)
    assert any(len(own) > 1 for own, _ in fixed)
    plan = fixed + packing.best_fit(count, capacity)
    assert (sum(t for _, t in plan), sum(t for _, t in packing.best_fit(Counter(items), capacity))) == (5, 6)


def test_reduction_goes_on_and_fixes_three():
    """A length that can't be fixed does not end the reduction, and three may dominate."""
    count = Counter({90: 1, 7: 3, 6: 1, 4: 2, 3: 1, 98: 1, 1: 2, 100: 2})
    fixed = packing.reduce_dominated(count, 100)
    assert ((100,), 2) in fixed and any(len(own) == 3 and own[0] == 98 for own, _ in fixed)


def test_null_and_repeated_ids(spark):
    """A null doc_id stays, and rows of one doc_id with different texts each count."""
    df = spark.createDataFrame([(None, "one text"), (None, "one text"), (7, "first of seven"), (7, "second, longer, of seven")], "doc_id bigint, text string")
    made = pieces.encode(df).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in made) == [(0, "one text")] * 2 + [(7, "first of seven"), (7, "second, longer, of seven")]
    packed = packing.pack(df, 16).collect()
    encode = packing.Encoder()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in packed) == sorted((d or 0, len(encode(t)) + 1) for d, t in [(r["doc_id"], r["text"]) for r in made])
    for place in Counter((r["sequence_id"], r["offset"]) for r in packed).values():
        assert place == 1
    assert pieces.encode(df.limit(0)).collect() == [] and packing.pack(df.limit(0)).collect() == []
