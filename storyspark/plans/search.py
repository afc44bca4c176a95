"""Registered q-gram searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as op
from ..operators.joins import containing_all
from .registry import query

FIELDS = ["title", "content"]


def search_sql(text: str, k: int | None, fields=("title", "content"), table: str = "notes", settings=op.Settings(), scope: str = "true", key: str = "id") -> str:
    """The same search in DuckDB; patterns must not overlap themselves."""
    clauses = op.parse(text)
    wanted = list(dict.fromkeys(g for c in clauses for g in op.grams(c.pattern)))
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    has = lambda s: "(" + " OR ".join(f"contains(lower({f}), {lit(s)})" for f in fields) + ")"
    stats = ", ".join(["CAST(count(*) AS DOUBLE) AS nn", *[f"sum(coalesce(length({f}), 0)) / count(*) AS mean_{f}" for f in fields], *[f"CAST(sum(CASE WHEN {has(g)} THEN 1 ELSE 0 END) AS DOUBLE) AS df{i}" for i, g in enumerate(wanted)]])
    cols = []
    for i, c in enumerate(clauses):
        p = lit(c.pattern)
        tf = lambda f: f"coalesce((length(lower({f})) - length(replace(lower({f}), {p}, ''))) // {len(c.pattern)}, 0)"  # noqa: E731, B023
        star = " + ".join(f"{settings.weights.get(f, 1.0)} * {tf(f)} / ({1 - settings.b} + {settings.b} * coalesce(length({f}), 0) / CASE WHEN mean_{f} > 0 THEN mean_{f} ELSE 100.0 END)" for f in fields)
        mask = " | ".join(
            f"coalesce(list_sum([CASE WHEN ceil(length({f}) * (s + 1) / 32) > ceil(length({f}) * s / 32) AND contains(substr(lower({f}), CAST(ceil(length({f}) * s / 32) AS INT) + 1, CAST(ceil(length({f}) * (s + 1) / 32) - ceil(length({f}) * s / 32) AS INT) + {len(c.pattern) - 1}), {p}) THEN (1::BIGINT << s) ELSE 0 END FOR s IN range(32)])::BIGINT, 0)"
            for f in fields
        )
        own = [f"ln(1 + greatest(0.0, (nn - df{wanted.index(g)} + 0.5) / (df{wanted.index(g)} + 0.5)))" for g in op.grams(c.pattern)]
        best = f"greatest({', '.join(own)})" if own else "0.0"
        cols += [f"{star} AS star{i}", f"CASE WHEN {best} = 0 THEN 1.0 ELSE {best} END AS idf{i}", f"{mask} AS mask{i}"]
    n = len(clauses)
    matched = " + ".join(f"(star{i} > 0)::INT" for i in range(n))
    base = " + ".join(f"CASE WHEN star{i} > 0 THEN idf{i} * {settings.k1 + 1} * star{i} / ({settings.k1} + star{i}) ELSE 0 END" for i in range(n))
    common = " & ".join(f"CASE WHEN star{i} > 0 THEN mask{i} ELSE 4294967295 END" for i in range(n))
    length, mean = " + ".join(f"coalesce(length({f}), 0)" for f in fields), " + ".join(f"mean_{f}" for f in fields)
    ratio = "1.0" if settings.constant_decay else f"(CASE WHEN {mean} > 0 THEN ({length}) / ({mean}) ELSE 1.0 END)"
    near = f"CASE WHEN matched > 1 THEN 1 + {settings.proximity} * bit_count({common}) / least(matched, 32) * exp(-{settings.decay} * {ratio}) ELSE 1.0 END" if n > 1 else "1.0"
    phrases = "".join(f" AND star{i} > 0" for i, c in enumerate(clauses) if c.phrase and settings.phrases_required)
    return f"""SELECT {key}, round(({base}) * pow({settings.coverage_floor} + matched / {n}, {settings.coverage_power}) * {near}, 6) AS score, round(matched / {n}, 6) AS coverage
        FROM (SELECT *, {matched} AS matched FROM (SELECT t.*, st.*, {', '.join(cols)} FROM {table} t, (SELECT {stats} FROM {table}) st WHERE {scope})) q
        WHERE matched > 0{phrases}""" + (f" ORDER BY score DESC, {key} LIMIT {k}" if k else "")


MAIN = 'the onthe "and the"'
query("qg_search", lambda m: op.search(m.notes, MAIN, 50, FIELDS), search_sql(MAIN, 50))
query("qg_score", lambda m: op.search(m.notes, 'tion "of the"', None, FIELDS), search_sql('tion "of the"', None))
WEIGHTED = op.Settings(weights={"title": 10.0}, coverage_power=0.0)
query("qg_match_any", lambda m: op.search(m.notes, "handan ereti", 50, FIELDS, WEIGHTED), search_sql("handan ereti", 50, settings=WEIGHTED))
SOFT = op.Settings(phrases_required=False)
query("qg_phrase_hard", lambda m: op.search(m.notes, '"with the" ingly', None, FIELDS), search_sql('"with the" ingly', None))
query("qg_phrase_soft", lambda m: op.search(m.notes, '"with the" ingly', None, FIELDS, SOFT), search_sql('"with the" ingly', None, settings=SOFT))
CONST = op.Settings(constant_decay=True)
query("qg_compressed_search", lambda m: op.search(m.notes, MAIN, 40, FIELDS, CONST), search_sql(MAIN, 40, settings=CONST))
query(
    "qg_scope",
    lambda m: op.search(m.notes, "tion er", 30, FIELDS, scope=(F.col("narrative_id") == "en") & F.startswith("folder_id", F.lit("src1"))),
    search_sql("tion er", 30, scope="narrative_id = 'en' AND starts_with(folder_id, 'src1')"),
)
query(
    "fts_notes_store",
    lambda m: op.search(m.notes, "tion er", 20, FIELDS, scope=F.col("folder_id").isin("src2", "src3") & (F.col("narrative_id") == "en")).join(m.notes.select("id", "title"), "id"),
    "WITH hits AS (" + search_sql("tion er", 20, scope="folder_id IN ('src2', 'src3') AND narrative_id = 'en'") + ") SELECT h.*, n.title FROM hits h JOIN notes n ON n.id = h.id",
)
query("srt_topk_heap", lambda m: op.search(m.notes, "ander", 10, FIELDS), search_sql("ander", 10))

query("qg_normalize", lambda m: m.notes.select("id", F.lower("content").alias("text")), "SELECT id, lower(content) AS text FROM notes")
PARSED = ['mara "folded bronze" thorn', '"C.E.O."', 'open "never closed words', '  Two  WORDS ', '""']
query(
    "qg_parse",
    lambda m: m.spark.createDataFrame([(i, j, c.pattern, c.phrase) for i, q in enumerate(PARSED) for j, c in enumerate(op.parse(q))], "query int, clause int, pattern string, phrase boolean"),
    """SELECT * FROM (VALUES (0, 0, 'mara', false), (0, 1, 'folded bronze', true), (0, 2, 'thorn', false), (1, 0, 'c.e.o.', true), (2, 0, 'open', false),
       (2, 1, 'never closed words', false), (3, 0, 'two', false), (3, 1, 'words', false)) v(query, clause, pattern, phrase)""",
)
GRAMS = "SELECT item_id AS id, length(text) AS length, i - 1 AS pos, substr(lower(text), i, 3) AS gram FROM (SELECT item_id, text, unnest(range(1, length(text) - 1)) AS i FROM benchmark)"
POSTED = f"SELECT gram, id, length, count(*) AS tf, bit_or(1::BIGINT << (pos * 32 // length)) AS mask FROM ({GRAMS}) GROUP BY ALL"


def posted(m):
    return op.postings(m.benchmark.withColumnRenamed("item_id", "id"), "text")


query("qg_grams", lambda m: m.benchmark.select(F.col("item_id").alias("id"), F.posexplode(op.gram_column("text")).alias("pos", "gram")).withColumn("pos", F.col("pos").cast("bigint")), f"SELECT id, CAST(pos AS BIGINT) AS pos, gram FROM ({GRAMS})")
query("qg_index", posted, f"SELECT gram, id, CAST(length AS BIGINT) AS length, tf, mask FROM ({POSTED})")
query("qg_remove", lambda m: posted(m).join(m.spark.createDataFrame([(3,), (8,)], "id bigint"), "id", "left_anti").groupBy("gram").agg(F.count(F.lit(1)).alias("df")), f"SELECT gram, count(*) AS df FROM ({POSTED}) WHERE id NOT IN (3, 8) GROUP BY gram")
query(
    "qg_candidates",
    lambda m: containing_all(posted(m), op.grams("tion"), "gram", "id").union(containing_all(posted(m), op.grams("with"), "gram", "id")).distinct(),
    f"""SELECT id FROM ({POSTED}) WHERE gram IN ('tio', 'ion') GROUP BY id HAVING count(DISTINCT gram) = 2 UNION SELECT id FROM ({POSTED}) WHERE gram IN ('wit', 'ith') GROUP BY id HAVING count(DISTINCT gram) = 2""",
)
query(
    "qg_gram_idf",
    lambda m: posted(m).groupBy("gram").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(m.benchmark.agg(F.count(F.lit(1)).alias("n")))).select("gram", "df", F.round(op.idf(F.col("n"), F.col("df")), 6).alias("idf")),
    f"SELECT gram, df, round(ln(1 + greatest(0.0, (n - df + 0.5) / (df + 0.5))), 6) AS idf FROM (SELECT gram, count(*) AS df FROM ({POSTED}) GROUP BY gram), (SELECT count(*) AS n FROM benchmark)",
)
query(
    "qg_verify",
    lambda m: m.benchmark.select("item_id", op.frequency(F.lower("text"), "the").alias("tf"), op.segment_mask(F.lower("text"), "the").alias("mask")).where("tf > 0"),
    f"""SELECT id AS item_id, CAST(count(*) AS INT) AS tf, bit_or(1::BIGINT << (pos * 32 // length)) AS mask FROM ({GRAMS}) WHERE gram = 'the' GROUP BY id""",
)
query(
    "qg_verify_all",
    lambda m: m.benchmark.select("item_id", *[op.frequency(F.lower("text"), p).alias(f"tf_{p}") for p in ("the", "ing", "and")]),
    "SELECT item_id, " + ", ".join(f"CAST((length(text) - length(replace(lower(text), '{p}', ''))) // 3 AS INT) AS tf_{p}" for p in ("the", "ing", "and")) + " FROM benchmark",
)
query(
    "qg_proximity",
    lambda m: m.benchmark.select("item_id", op.segment_mask(F.lower("text"), "the").alias("a"), op.segment_mask(F.lower("text"), "ing").alias("b")).select("item_id", F.bit_count(F.col("a").bitwiseAND(F.col("b"))).alias("shared")),
    f"""SELECT item_id, CAST(bit_count(coalesce(a.mask, 0) & coalesce(b.mask, 0)) AS INT) AS shared FROM benchmark LEFT JOIN (SELECT id, mask FROM ({POSTED}) WHERE gram = 'the') a ON a.id = item_id
        LEFT JOIN (SELECT id, mask FROM ({POSTED}) WHERE gram = 'ing') b ON b.id = item_id""",
)
query(
    "qg_upper_bound",
    lambda m: posted(m).where("gram IN ('the', 'ing', 'tio')").groupBy("gram").agg(F.max("tf").alias("tf"), F.min("length").alias("length")).crossJoin(F.broadcast(m.benchmark.agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("mean")))).select("gram", F.round(F.log(1 + F.col("n")) * op.saturate(op.length_normal(F.col("tf"), F.col("length"), F.col("mean"), 0.75), 1.2), 6).alias("bound")),
    f"""SELECT gram, round(ln(1 + n) * 2.2 * s / (1.2 + s), 6) AS bound FROM (SELECT gram, n, max(tf) / (0.25 + 0.75 * min(length) / any_value(mean)) AS s FROM ({POSTED}), (SELECT count(*) AS n, avg(length(text)) AS mean FROM benchmark)
        WHERE gram IN ('the', 'ing', 'tio') GROUP BY gram, n)""",
)
query(
    "qg_union_bounds",
    lambda m: posted(m).where("gram IN ('the', 'ing', 'tio')").groupBy("id").agg(F.round(F.sum(op.saturate(F.col("tf").cast("double"), 1.2)), 6).alias("bound")),
    f"SELECT id, round(sum(2.2 * tf / (1.2 + tf)), 6) AS bound FROM ({POSTED}) WHERE gram IN ('the', 'ing', 'tio') GROUP BY id",
)
query("qg_adaptive", lambda m: op.rarest_grams(posted(m), "thatition", 3), f"SELECT gram, count(*) AS df FROM ({POSTED}) WHERE gram IN ({', '.join(repr(g) for g in op.grams('thatition'))}) GROUP BY gram ORDER BY df, gram LIMIT 3")
query(
    "qg_candidates_adaptive",
    lambda m: posted(m).join(F.broadcast(op.rarest_grams(posted(m), "thatition", 2)), "gram").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("id"),
    f"""WITH p AS ({POSTED}), r AS (SELECT gram FROM p WHERE gram IN ({', '.join(repr(g) for g in op.grams('thatition'))}) GROUP BY gram ORDER BY count(*), gram LIMIT 2)
        SELECT id FROM p WHERE gram IN (SELECT gram FROM r) GROUP BY id HAVING count(*) = 2""",
)
query("qg_intersect_many", lambda m: containing_all(posted(m), ["the", "ing", "and", "ion"], "gram", "id"), f"SELECT id FROM ({POSTED}) WHERE gram IN ('the', 'ing', 'and', 'ion') GROUP BY id HAVING count(DISTINCT gram) = 4")
query("qg_lazy_delete", lambda m: posted(m).where("gram = 'the'").join(m.benchmark.where("item_id % 5 = 0").select(F.col("item_id").alias("id")), "id", "left_anti").select("id", "tf"), f"SELECT id, tf FROM ({POSTED}) WHERE gram = 'the' AND id % 5 <> 0")
query("qg_compact", lambda m: posted(m).where("id % 5 <> 0").groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")), f"SELECT gram, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM ({POSTED}) WHERE id % 5 <> 0 GROUP BY gram")


def docs_with(m, gram):
    return posted(m).where(F.col("gram") == gram).select("id")


WITH_GRAM = "SELECT id FROM (" + POSTED + ") WHERE gram = '{}'"
query("qg_postings_ops", lambda m: docs_with(m, "ion").intersect(docs_with(m, "wit")), f"{WITH_GRAM.format('ion')} INTERSECT {WITH_GRAM.format('wit')}")
query("qg_postings_or", lambda m: docs_with(m, "ion").union(docs_with(m, "wit")).distinct(), f"{WITH_GRAM.format('ion')} UNION {WITH_GRAM.format('wit')}")
query("qg_payload", lambda m: posted(m).where("gram = 'the'").select("id", "tf", "mask"), f"SELECT id, tf, mask FROM ({POSTED}) WHERE gram = 'the'")
query("set_intersect", lambda m: m.note_tags.where("tag = 'lang-en'").select("note_id").intersect(m.note_tags.where("tag = 'toxic'").select("note_id")), "SELECT note_id FROM note_tags WHERE tag = 'lang-en' INTERSECT SELECT note_id FROM note_tags WHERE tag = 'toxic'")
query("set_union", lambda m: m.edges.select("source_id").union(m.edges.select("target_id")).distinct(), "SELECT source_id FROM edges UNION SELECT target_id FROM edges")
query("set_union_sorted", lambda m: m.note_tags.where("tag = 'toxic'").select("note_id").union(m.note_tags.where("tag = 'src-src4'").select("note_id")).distinct().orderBy("note_id"), "SELECT note_id FROM note_tags WHERE tag = 'toxic' UNION SELECT note_id FROM note_tags WHERE tag = 'src-src4'")
query("set_except", lambda m: m.note_tags.where("tag = 'lang-en'").select("note_id").subtract(m.note_tags.where("tag = 'toxic'").select("note_id")), "SELECT note_id FROM note_tags WHERE tag = 'lang-en' EXCEPT SELECT note_id FROM note_tags WHERE tag = 'toxic'")
query("set_dedup", lambda m: m.sentence_mentions.select("episode_id", "entity_id").distinct(), "SELECT DISTINCT episode_id, entity_id FROM sentence_mentions")
query("set_append_unique", lambda m: m.note_tags.groupBy("note_id").agg(F.array_join(F.sort_array(F.array_union(F.collect_set("tag"), F.array(F.lit("added")))), ",").alias("tags")), "SELECT note_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT DISTINCT note_id, tag FROM note_tags UNION SELECT note_id, 'added' FROM note_tags) GROUP BY note_id")
