"""Order MinHash fingerprints, in DataFrame functions only.

A text is the sequence of its word k-mers, each numbered by its occurrence so that repeats are told
apart. One hash deals the numbered k-mers out to BINS bins, which stand in for as many independent
permutations; every bin selects its two minimal ones, puts them back into text order, and hashes that
tuple. Two texts agree in a bin if the selected k-mers are the same and follow in the same order, so the
share of agreeing bins falls with edit distance and not only with the overlap of their k-mers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WHITE, sized_partitions, table

KMER = 3
BINS = 64
#: Bits of a packed long that hold a k-mer's place in the text; beyond 2**24 words places start over.
PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1
#: doc_ids per block, as a power of two, when a document's successor is sought.
BLOCK_BITS = 8


def _number(i) -> Column:
    return F.coalesce(i, F.lit(0).cast("bigint"))


def with_signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the array column out: for each bin that has a k-mer, a long of its number (above bit 32)
    and its tuple's hash (below). No word gives an empty array; fewer than KMER words are one k-mer."""
    words, grams, sorted_grams, numbered = (f"_{out}_{k}" for k in ("words", "grams", "sorted", "numbered"))
    high = F.lit(~PLACE)
    df = df.withColumn(words, F.array_remove(F.split(text, WHITE), ""))
    n = F.greatest(F.size(words) - (KMER - 1), F.least(F.size(words), F.lit(1)))
    none = F.array().cast("array<bigint>")
    # a hash above, the place below
    df = df.withColumn(
        grams,
        F.when(n < 1, none).otherwise(
            F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, KMER)).bitwiseAND(high).bitwiseOR((i - 1).cast("bigint").bitwiseAND(F.lit(PLACE))))
        ),
    ).drop(words)
    df = df.withColumn(sorted_grams, F.sort_array(grams)).drop(grams)

    s = F.col(sorted_grams)
    gram = lambda i: F.shiftright(F.get(s, i), PLACE_BITS)
    every = F.when(F.size(s) < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(s) - 1))
    firsts = f"_{out}_firsts"
    df = df.withColumn(firsts, F.filter(every, lambda i: (i == 0) | (gram(i) != gram(i - 1))))

    def occurrence(packed: Column, number: Column) -> Column:
        place = packed.bitwiseAND(F.lit(PLACE))
        return F.xxhash64(F.shiftright(packed, PLACE_BITS), number).bitwiseAND(high).bitwiseOR(place)

    f = F.col(firsts)
    runs = F.transform(
        f,
        lambda a, r: F.transform(
            F.sequence(F.lit(0), F.coalesce(F.get(f, r + 1), F.size(s)) - a - 1), lambda o: occurrence(_number(F.get(s, a + o)), o)
        ),
    )
    plain = F.transform(s, lambda x: occurrence(x, F.lit(0)))
    df = df.withColumn(numbered, F.sort_array(F.when(F.size(f) == F.size(s), plain).otherwise(F.flatten(runs)))).drop(sorted_grams, firsts)

    u = F.col(numbered)
    at = lambda i: F.get(u, i)
    bin_of = lambda x: F.shiftright(x, 58)
    chosen = f"_{out}_chosen"
    every = F.when(F.size(u) < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(u) - 1))
    df = df.withColumn(chosen, F.filter(every, lambda i: (i == 0) | (bin_of(at(i)) != bin_of(at(i - 1)))))

    def tuple_hash(i: Column) -> Column:
        a, b = at(i), at(i + 1)
        x, y = F.shiftright(a, PLACE_BITS), F.shiftright(b, PLACE_BITS)
        two = b.isNotNull() & (bin_of(a) == bin_of(b))
        ahead = a.bitwiseAND(F.lit(PLACE)) < b.bitwiseAND(F.lit(PLACE))
        hashed = F.when(~two, F.xxhash64(x)).when(ahead, F.xxhash64(x, y)).otherwise(F.xxhash64(y, x))
        number = F.shiftleft((bin_of(a) + BINS // 2).cast("bigint"), 32)
        return number.bitwiseOR(hashed.bitwiseAND(F.lit((1 << 32) - 1)))

    return df.withColumn(out, F.transform(chosen, tuple_hash)).drop(numbered, chosen)


def fingerprint_text(signature: str) -> Column:
    """Ten hex digits for each bin that has a k-mer: two of its number, eight of its tuple's hash."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Share of the bins used by either text in which both agree; 1 for two texts without words."""
    bins = lambda c: F.transform(c, lambda x: F.shiftright(x, 32))
    used = F.size(a) + F.size(b) - F.size(F.array_intersect(bins(a), bins(b)))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row; null text counts as empty, and rows may repeat."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return with_signature(rows, "text", "signature").select("doc_id", fingerprint_text("signature").alias("fingerprint"))


def next_keys(keys: DataFrame) -> DataFrame:
    """key and next: the largest smaller key; after the smallest the largest (keys: distinct column key).

    Keys are grouped by their upper bits, so that only one row for each 4096 keys' group reaches the one
    window without partitions."""
    grouped = keys.withColumn("group", F.shiftright("key", 12))
    inside = grouped.withColumn("next", F.lead("key").over(Window.partitionBy("group").orderBy(F.desc_nulls_last("key"))))
    whole = Window.orderBy(F.desc_nulls_last("group"))
    heads = grouped.groupBy("group").agg(F.max("key").alias("head"))
    heads = heads.withColumn("after", F.lead("head").over(whole))
    heads = heads.withColumn("after", F.coalesce("after", F.first("head").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return inside.join(heads.select("group", "after"), inside["group"].eqNullSafe(heads["group"])).select("key", F.coalesce("next", "after").alias("next"))


def with_next(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, own) with next_text and following, text and signature of the next row in
    descending doc_id (ties by text; nulls last); after the last row, the first. Texts are dealt out
    once, by block of neighbouring ids."""
    # the block of a null id comes after every other
    block = F.coalesce(F.shiftright("doc_id", BLOCK_BITS), F.lit(-(1 << 60)).cast("bigint"))
    keys = next_keys(rows.select(block.alias("key")).distinct())
    rows = rows.withColumn("block", block).repartition(sized_partitions(rows), "block")
    order = Window.partitionBy("block").orderBy(F.desc_nulls_last("doc_id"), "text")
    rows = rows.select(
        "*", F.lead("text").over(order).alias("later_text"), F.lead("own").over(order).alias("later"), F.row_number().over(order).alias("rank")
    )
    firsts = rows.where("rank = 1").select(F.col("block").alias("next"), F.col("text").alias("after_text"), F.col("own").alias("after"))
    firsts = keys.join(firsts, "next").select(F.col("key").alias("block"), "after_text", "after")
    return rows.join(firsts, "block").select(
        "doc_id", "text", "own", F.coalesce("later_text", "after_text").alias("next_text"), F.coalesce("later", "after").alias("following")
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text ends in the beginning of the next row's instead of its own last third. Null text
    counts as empty; a text of fewer than three characters is its own edited text; a table's only row
    follows itself; other columns are ignored; an empty table gives no rows."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(with_signature(rows, "text", "own"))
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("doc_id", "own", "following", F.length("text").cast("bigint").alias("n_chars"), edited.alias("edited"))
    rows = with_signature(rows.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "changed")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint_text("own").alias("fingerprint"),
        fingerprint_text("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"),
        likeness("own", "following").alias("near_next"),
    )


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
