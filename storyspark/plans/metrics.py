"""Registered document metrics over all documents; syllables and reading levels, whose rules are English, over the English ones."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as op
from .registry import query


def docs(m):
    return m.documents.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("t"))


def english(m):
    return m.documents.where("lang = 'en'").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("t"))


D = "SELECT doc_id AS id, coalesce(text, '') AS t FROM documents"
ENGLISH = f"{D} WHERE lang = 'en'"
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
W = r"list_filter(string_split_regex(regexp_replace({}, '[^0-9A-Za-z_\s''-]', ' ', 'g'), '\s+'), lambda x: x <> '')"
S = f"list_filter([{TRIM.format('x')} FOR x IN string_split_regex(t, '[.!?]+')], lambda x: x <> '')"
P = f"list_filter([{TRIM.format('x')} FOR x IN string_split_regex(t, '\n\n+')], lambda x: x <> '')"
LEN = f"[len({W.format('y')}) FOR y IN {S}]"
SYL = r"CASE WHEN length(w) <= 3 THEN 1 ELSE greatest(len(regexp_extract_all(regexp_replace(regexp_replace(lower(w), '(?:[^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', ''), '[aeiouy]{1,2}')), 1) END"
RANGE = "CASE WHEN n = 1 THEN '1' WHEN n <= 6 THEN '2-6' WHEN n <= 15 THEN '7-15' WHEN n <= 25 THEN '16-25' WHEN n <= 39 THEN '26-39' ELSE '40+' END"
SENT = f"SELECT id, i, len({W.format('s')}) AS n FROM (SELECT id, unnest(s) AS s, unnest(range(len(s))) AS i FROM (SELECT id, {S} AS s FROM ({D})))"

query("met_words", lambda m: docs(m).select("id", F.size(op.words("t")).alias("n")), f"SELECT id, CAST(len({W.format('t')}) AS INT) AS n FROM ({D})")
query("met_sentences", lambda m: docs(m).select("id", F.posexplode(op.sentences("t")).alias("i", "s")), f"SELECT id, CAST(unnest(range(len(s))) AS INT) AS i, unnest(s) AS s FROM (SELECT id, {S} AS s FROM ({D}))")
query("met_paragraphs", lambda m: docs(m).select("id", F.size(op.paragraphs("t")).alias("n")), f"SELECT id, CAST(len({P}) AS INT) AS n FROM ({D})")
query("met_syllables", lambda m: english(m).select(F.explode(op.words("t")).alias("w")).distinct().select("w", op.syllables("w").alias("n")), f"SELECT w, CAST({SYL} AS INT) AS n FROM (SELECT DISTINCT unnest({W.format('t')}) AS w FROM ({ENGLISH}))")
query("met_length_hist", lambda m: docs(m).select(F.explode(op.sentence_lengths("t")).alias("n")).groupBy(op.range_of(F.col("n")).alias("range")).agg(F.count(F.lit(1)).alias("sentences")), f"SELECT {RANGE} AS range, count(*) AS sentences FROM ({SENT}) GROUP BY 1")
ISLANDS = f"""SELECT id, i, row_number() OVER (PARTITION BY id, g ORDER BY i) AS run FROM (SELECT *, sum(CASE WHEN abs(n - p) <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY i) AS g FROM (SELECT *, lag(n) OVER (PARTITION BY id ORDER BY i) AS p FROM ({SENT})))"""
query("met_consecutive", lambda m: docs(m).select("id", op.runs(op.sentence_lengths("t"))["hits"].alias("n")), f"SELECT d.id, CAST(coalesce(n, 0) AS INT) AS n FROM ({D}) d LEFT JOIN (SELECT id, count_if(run >= 3) AS n FROM ({ISLANDS}) GROUP BY id) r ON r.id = d.id")
VARIETY = f"""SELECT id, CASE WHEN count(*) <= 1 THEN 0 ELSE CAST(floor(round(sum(-(c / t) * log2(c / t)) / log2(count(*)) * 100, 9) + 0.5) AS INT) END AS v, CAST(max(t) AS INT) AS sentences FROM (SELECT *, sum(c) OVER (PARTITION BY id) AS t FROM (SELECT id, {RANGE} AS r, count(*) AS c FROM ({SENT}) GROUP BY ALL)) GROUP BY id"""
query("met_variety", lambda m: op.text_metrics(docs(m), "t").where("sentences > 0").select("id", F.col("variety").alias("v"), "sentences"), VARIETY)
query("met_flow_insights", lambda m: op.text_metrics(docs(m), "t").where("sentences > 0").select("id", "monotony", "consecutive"), f"SELECT id, max(run) >= 5 AS monotony, CAST(count_if(run >= 3) AS INT) AS consecutive FROM ({ISLANDS}) GROUP BY id")
def numbers(source):
    base = f"SELECT id, {W.format('t')} AS w, {LEN} AS l FROM ({source})"
    return f"SELECT id, len(w) AS words, len(l) AS sentences, CAST(coalesce(list_sum([{SYL} FOR w IN w]), 0) AS BIGINT) AS syllables FROM ({base})"


NUMBERS = numbers(D)
GRADE = "0.39 * words / sentences + 11.8 * syllables / words - 15.59"
query(
    "met_reading_level",
    lambda m: op.text_metrics(english(m), "t").select("id", "reading_level"),
    f"SELECT id, CASE WHEN words = 0 OR sentences = 0 THEN 'N/A' " + " ".join(f"WHEN {GRADE} < {b} THEN '{n}'" for b, n in op.LEVELS[:-1]) + f" ELSE '{op.LEVELS[-1][1]}' END AS reading_level FROM ({numbers(ENGLISH)})",
)
query("met_stddev", lambda m: op.text_metrics(docs(m), "t").where("sentences > 0").select("id", F.round("deviation", 3).alias("v")), f"SELECT id, round(stddev_pop(n), 3) AS v FROM ({SENT}) GROUP BY id")
query(
    "met_flow_len",
    lambda m: op.text_metrics(docs(m), "t").where("sentences > 0").select("id", "flow"),
    f"SELECT id, CAST(floor(round(least(100, sd / 8 * 100) * 0.6 + v * 0.4, 9) + 0.5) AS INT) AS flow FROM (SELECT id, stddev_pop(n) AS sd FROM ({SENT}) GROUP BY id) JOIN ({VARIETY}) USING (id)",
)
query(
    "met_text",
    lambda m: op.text_metrics(docs(m), "t").select("id", "characters", "characters_no_spaces", "words", "sentences", "paragraphs", "syllables", "reading_seconds", "speaking_seconds", "mean_sentence"),
    rf"""SELECT id, CAST(length(t) AS INT) AS characters, CAST(length(regexp_replace(t, '\s', '', 'g')) AS INT) AS characters_no_spaces, CAST(words AS INT) AS words, CAST(sentences AS INT) AS sentences, CAST(len({P}) AS INT) AS paragraphs,
        CAST(syllables AS INT) AS syllables, CAST(ceil(words * 60 / 225) AS INT) AS reading_seconds, CAST(ceil(words * 60 / 150) AS INT) AS speaking_seconds, CASE WHEN sentences > 0 THEN floor(words * 10 / sentences + 0.5) / 10 ELSE 0.0 END AS mean_sentence
        FROM ({D}) JOIN ({NUMBERS}) USING (id)""",
)
query("met_analyze", lambda m: op.text_metrics(docs(m), "t").select("id", "words", "characters", "sentences", F.round(F.col("words") / 250, 4).alias("minutes")), f"SELECT id, CAST(words AS INT) AS words, CAST(length(t) AS INT) AS characters, CAST(sentences AS INT) AS sentences, round(words / 250, 4) AS minutes FROM ({D}) JOIN ({NUMBERS}) USING (id)")


def ranges(m):
    """Numbers of the first and last token of each sentence; the tail without an end mark is one too."""
    tokens = docs(m).select("id", F.posexplode(F.regexp_extract_all("t", F.lit("[A-Za-z0-9'-]+|[.!?]"), 0)).alias("i", "w"))
    before = F.coalesce(F.sum(F.col("w").rlike("^[.!?]$").cast("int")).over(Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return tokens.withColumn("sentence", before).groupBy("id", "sentence").agg(F.min("i").alias("first"), F.max("i").alias("last"))


query(
    "met_sentence_ranges",
    ranges,
    f"""SELECT id, CAST(sentence AS BIGINT) AS sentence, CAST(min(i) AS INT) AS first, CAST(max(i) AS INT) AS last FROM (SELECT id, i, coalesce(sum(CASE WHEN w IN ('.', '!', '?') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence
        FROM (SELECT id, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT id, regexp_extract_all(t, '[A-Za-z0-9''-]+|[.!?]') AS w FROM ({D})))) GROUP BY id, sentence""",
)
query("met_footer", lambda m: m.mentions.groupBy("note_id").agg(F.count_distinct("entity_id").alias("entities"), F.sum("n").alias("mentions")), "SELECT note_id, count(DISTINCT entity_id) AS entities, CAST(sum(n) AS BIGINT) AS mentions FROM mentions GROUP BY note_id")
query("win_adjacent", lambda m: docs(m).select("id", F.posexplode(op.sentence_lengths("t")).alias("i", "n")).withColumn("step", F.col("n") - F.lag("n").over(Window.partitionBy("id").orderBy("i"))).select("id", "i", "step"), f"SELECT id, CAST(i AS INT) AS i, CAST(n - lag(n) OVER (PARTITION BY id ORDER BY i) AS INT) AS step FROM ({SENT})")
