"""Alignment of two tokenizers against all pairs of tokens."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from storyspark.llm import alignment

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def ranges(sizes):
    ends = np.cumsum(sizes).tolist() if sizes else []
    return list(zip([0, *ends[:-1]], ends, strict=False))


def brute(docs, both):
    """Rows by comparing every token of A with every one of B."""
    a_tok, b_tok = both
    stands_for = alignment.byte_level()
    seen, links = [], Counter()
    for doc_id, text in docs:
        wanted = (" " + (text or "")).encode()
        a_ids = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b_ids = b_tok.encode(text) if text else []
        a_bytes = [bytes(stands_for[c] for c in a_tok.id_to_token(i)) for i in a_ids]
        b_bytes = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        if b"".join(a_bytes) != wanted or b"".join(b_bytes) != wanted:
            a_ids, b_ids, a_bytes, b_bytes = [], [], [], []
        a, b = ranges([len(x) for x in a_bytes]), ranges([len(x) for x in b_bytes])
        own = [(i, j) for i, (s, e) in zip(a_ids, a, strict=True) for j, (t, f) in zip(b_ids, b, strict=True) if s < f and t < e]
        links.update(own)
        cuts = sorted({e for _, e in a} & {f for _, f in b})
        groups, low = [], 0
        for cut in cuts:
            groups.append(",".join(str(i) for i, (s, _) in zip(a_ids, a, strict=True) if low <= s < cut) + "|" + ",".join(str(j) for j, (t, _) in zip(b_ids, b, strict=True) if low <= t < cut))
            low = cut
        seen.append((doc_id, len(a_ids), len(b_ids), groups, own))
    most = defaultdict(int)
    for (_, j), n in links.items():
        most[j] = max(most[j], n)
    return sorted(
        (
            (d, n_a, n_b, len(g), len(own), sum(links[x] == most[x[1]] for x in own), sum(links[x] for x in own), hashlib.sha256(";".join(g).encode()).hexdigest() if n_a else "")
            for d, n_a, n_b, g, own in seen
        ),
        key=repr,
    )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


ODD = [
    None, "", " ", "  two  spaces ", "a", "Hello, world!", "Hello, world!", "<|endoftext|> and <s> </s> <unk> <0x41>", "naïve café — “quotes” 日本語 🙂👩‍👩‍👧", "tab\tand\nline\r\n\n end", "▁ mark ▁▁",
    "x" * 400, "\x00\x01 null", "ẞ\u00a0\u2028\u200b\ufeff", "1234567890 12,5 %", "don't we'll I'M", "ﬁ ² Å", "a\u0301 e\u0301", "!!!???...", "\n", "end with space ", "Ünïcödé " * 30,
]


@pytest.mark.parametrize("block_chars", [1, 1 << 22])
def test_against_all_pairs(spark, both, block_chars):
    docs = list(enumerate(ODD)) + [(None, "no id"), (3, "same id"), (3, "same id")]
    df = spark.createDataFrame([(t, d, 1, "x") for d, t in docs], "text string, doc_id bigint, block int, pair string").repartition(5)
    assert got(alignment.align(df, block_chars=block_chars)) == brute(docs, both)


def test_registered_query_against_all_pairs(spark, both):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    out = alignment.op11_tokenizer_alignment(spark, FOLDER)
    short = [d for d in docs if len(d[1] or "") < 1500]
    rows = {r[0]: r for r in got(out)}
    assert sorted(rows) == sorted(d for d, _ in docs)
    for r in brute(short, both):  # counts are of the whole corpus, so only what a document alone decides
        assert rows[r[0]][:5] == r[:5] and rows[r[0]][7] == r[7]


def test_long_text_and_kept_groups(spark, both):
    text = "The quick brown fox, 日本 and naïve words. " * 9000
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in alignment.align(df, keep_groups=True).collect()}
    assert hashlib.sha256(rows[1]["groups"].encode()).hexdigest() == rows[1]["groups_sha256"]
    assert rows[1]["n_a"] == len(both[0].encode(" " + text, add_special_tokens=False).ids)
    assert rows[1]["n_links"] == rows[1]["n_a"] + rows[1]["n_b"] - rows[1]["n_groups"]  # true of any two tilings
    assert rows[2]["groups"].count(";") + 1 == rows[2]["n_groups"]


def test_no_rows(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_coalescing_of_ranges_with_gaps_and_overlaps():
    starts, ends = np.array([0, 2, 7, 9, 0, 3, 7]), np.array([2, 5, 9, 12, 3, 5, 12])
    order, group = alignment.coalesced(starts, ends, np.array([0, 0, 0, 0, 1, 1, 1]))
    assert order.tolist() == [0, 4, 1, 5, 2, 6, 3] and group.tolist() == [0, 0, 0, 0, 1, 1, 1]
    a, b = alignment.overlaps(starts[:4], ends[:4], starts[4:], ends[4:])
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 0), (1, 0), (1, 1), (2, 2), (3, 2)]
