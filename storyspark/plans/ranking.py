"""Registered ranking and full-text queries over messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as op
from ..operators.search import saturate
from ..sources.shared import written
from .registry import query

TERMS = ["the", "and", "tion"]
T3 = "'the', 'and', 'tion'"
TOKS = "list_filter(string_split(regexp_replace(lower(content), '[^0-9a-z_]+', ' ', 'g'), ' '), lambda x: x <> '')"
WORDS = f"SELECT id, 'body' AS field, {TOKS} AS w FROM messages UNION ALL SELECT id, 'lead', list_slice({TOKS}, 1, 8) FROM messages"
POST = f"""SELECT term, id, field, field_len, count(*) AS tf, bit_or(1::BIGINT << CAST(pos * 32 // field_len AS INT)) AS mask FROM
           (SELECT id, field, len(w) AS field_len, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM ({WORDS})) GROUP BY ALL"""


def posted(m, where="true"):
    """The index, written once for all that reads it."""
    return written(op.index(m.messages.where(where), {"body": op.tokens("content"), "lead": F.slice(op.tokens("content"), 1, 8)}), "postings")


def scores_sql(b=0.75, k1=1.2, lead=1.0, terms=T3, entropy=False) -> str:
    """CTEs post, ts (id, term, place, idf, score, mask, n)."""
    names = [t.strip().strip("'") for t in terms.split(",")]
    place = "CASE term " + " ".join(f"WHEN '{t}' THEN {i + 1}" for i, t in enumerate(names)) + " END"
    gamma = f" + {k1 / 2} * spread" if entropy else ""
    spread = f", (SELECT sum(e / greatest(mx, 1e-9)) / {len(names)} AS spread FROM (SELECT e, max(e) OVER () AS mx FROM ent))" if entropy else ""
    return f"""WITH post AS ({POST}), nn AS (SELECT CAST(count(DISTINCT id) AS DOUBLE) AS n FROM post),
        means AS (SELECT field, sum(field_len) / any_value(n) AS mean FROM (SELECT DISTINCT id, field, field_len FROM post), nn GROUP BY field),
        dfs AS (SELECT term, CAST(count(DISTINCT id) AS DOUBLE) AS df FROM post WHERE term IN ({terms}) GROUP BY term),
        ent AS (SELECT term, sum(CASE WHEN p > 1e-6 AND p < 0.999999 THEN -p * ln(p) ELSE 0 END) AS e FROM (SELECT term, id, 1 / (1 + exp(-least(sum(tf), 10))) AS p FROM post WHERE term IN ({terms}) GROUP BY term, id) GROUP BY term),
        ts AS (SELECT id, term, {place} AS place, idf, idf * {k1 + 1} * star / ({k1} + star) AS score, mask, n FROM (SELECT id, term, any_value(ln(1 + greatest(0, (n - df + 0.5) / (df + 0.5)))) AS idf, any_value(n) AS n, bit_or(mask) AS mask,
        sum(CASE WHEN field = 'lead' THEN {lead} ELSE 1.0 END * tf / ({1 - b} + {b} * field_len / mean{gamma})) AS star FROM post JOIN dfs USING (term) JOIN means USING (field), nn{spread} WHERE term IN ({terms}) GROUP BY id, term))"""


def ranked_sql(boost: str, extra: str = "1.0", **kw) -> str:
    return scores_sql(**kw) + f""" SELECT id, round(base * CASE WHEN matched > 1 THEN {boost} ELSE 1.0 END * {extra}, 6) AS score, matched FROM (SELECT id, sum(score) AS base, count(*) AS matched, bit_count(bit_and(mask)) AS bits, avg(idf) AS idf,
        list(mask ORDER BY place) AS own FROM ts GROUP BY id)"""


def ranked(m, near, phrase=None, lead=1.0, entropy=False):
    scores = op.term_scores(posted(m), TERMS, weights={"lead": lead}, entropy=entropy)
    return op.ranked(scores, len(TERMS), near=near, phrase=phrase).withColumn("score", F.round("score", 6))


GLOBAL = "1 + 0.5 * bits / least(matched, 32) * exp(-0.1)"
IDF = "1 + 0.5 * bits / least(matched, 32) * exp(-0.1) * (1 + idf / 5.0)"
M = "SELECT entity_id, note_id, n, CAST(note_id AS DOUBLE) AS x FROM mentions"
query("rr_idf", lambda m: m.mentions.select("entity_id", "note_id", F.round(op.idf(F.lit(1000.0), F.col("n")), 6).alias("v")), "SELECT entity_id, note_id, round(CASE WHEN n = 0 THEN 0.0 ELSE ln(1 + greatest(0.0, (1000 - n + 0.5) / (n + 0.5))) END, 6) AS v FROM mentions")
query("rr_ntf", lambda m: m.mentions.select("entity_id", "note_id", F.round(op.normal_tf(F.col("n"), F.col("note_id"), F.lit(500.0), 0.75, 0.4, 0.6), 6).alias("v")), "SELECT entity_id, note_id, round(n / (0.25 + 0.75 * note_id / 500.0 + 0.24), 6) AS v FROM mentions")
query("rr_saturate", lambda m: m.mentions.select("entity_id", "note_id", F.round(saturate(F.col("n").cast("double"), 1.2), 6).alias("v")), "SELECT entity_id, note_id, round(2.2 * n / (1.2 + n), 6) AS v FROM mentions")
query("rr_popcount", lambda m: m.mentions.select("entity_id", "note_id", F.bit_count("n").alias("v")), "SELECT entity_id, note_id, CAST(bit_count(n) AS INT) AS v FROM mentions")
query("rr_adaptive_segments", lambda m: m.notes.select("id", op.adaptive_segments(F.col("n_chars")).cast("int").alias("v")), "SELECT id, CAST(least(32, greatest(8, ceil(n_chars / 50))) AS INT) AS v FROM notes")
query("rr_adaptive_alpha", lambda m: m.notes.groupBy("folder_id").agg(F.round(op.adaptive_alpha(F.avg(F.col("n_chars") % 200)), 6).alias("v")), "SELECT folder_id, round(least(1.5, greatest(0.5, avg(n_chars % 200) / 100)), 6) AS v FROM notes GROUP BY folder_id")
query("rr_beta", lambda m: m.notes.groupBy("folder_id").agg(F.round(op.beta(F.count(F.lit(1))), 6).alias("v")), "SELECT folder_id, round(1 / ln(1.0 + count(*)), 6) AS v FROM notes GROUP BY folder_id")
query("rr_normalize_score", lambda m: m.mentions.select("entity_id", "note_id", F.round(op.normalized(F.col("n").cast("double"), 3, F.lit(1000)), 6).alias("v")), "SELECT entity_id, note_id, round(n / (3 * (ln(1 + 999.5 / 1.5) + 1)), 6) AS v FROM mentions")
query("rr_sigmoid", lambda m: m.episodes.select("id", F.round(op.sigmoid(F.col("value") / 100), 6).alias("v")), "SELECT id, round(1 / (1 + exp(-value / 100)), 6) AS v FROM episodes")
query(
    "rr_remap_mask",
    lambda m: posted(m).where("term = 'the' AND field = 'body'").select("id", op.remapped(F.col("mask"), 32, 12).alias("v")),
    f"SELECT id, CAST(bit_or(CASE WHEN (mask >> i) & 1 = 1 THEN 1::BIGINT << CAST(i * 12 // 32 AS INT) ELSE 0 END) AS BIGINT) AS v FROM ({POST}), (SELECT unnest(range(32))::INT AS i) WHERE term = 'the' AND field = 'body' GROUP BY id",
)
query(
    "rr_score_term",
    lambda m: op.term_scores(posted(m), TERMS, weights={"lead": 3.0}).select("id", "term", F.round("idf", 6).alias("idf"), F.round("score", 6).alias("score"), "mask"),
    scores_sql(lead=3.0) + " SELECT id, term, round(idf, 6) AS idf, round(score, 6) AS score, mask FROM ts",
)
query("rr_prox_global", lambda m: ranked(m, "global"), ranked_sql(GLOBAL))
query("rr_prox_idf", lambda m: ranked(m, "idf"), ranked_sql(IDF))
PAIR = "1 + 0.5 * (CASE WHEN len(own) = 2 THEN bit_count(own[1] & own[2]) ELSE bit_count(own[1] & own[2]) + bit_count(own[1] & own[3]) + bit_count(own[2] & own[3]) END) / 32.0 / (len(own) * (len(own) - 1) / 2)"
query("rr_prox_pair", lambda m: ranked(m, "pair"), ranked_sql(PAIR))
query(
    "rr_prox_term",
    lambda m: ranked(m, "term"),
    scores_sql() + """ SELECT id, round(sum(score * (1 + CASE WHEN k = 0 THEN 0 ELSE 0.5 * shared / k / 32 END)), 6) AS score, count(*) AS matched FROM (SELECT t.id, t.term, any_value(t.score) AS score, count(o.term) AS k,
       CAST(coalesce(sum(bit_count(t.mask & o.mask)), 0) AS DOUBLE) AS shared FROM ts t LEFT JOIN ts o ON o.id = t.id AND o.place < t.place GROUP BY t.id, t.term) GROUP BY id""",
)
query("rr_phrase", lambda m: ranked(m, "idf", phrase=1.5), ranked_sql(IDF, "CASE WHEN matched = 3 AND ((own[1] << 1) & own[2] & 4294967295) <> 0 AND ((own[2] << 1) & own[3] & 4294967295) <> 0 THEN 1.5 ELSE 1.0 END"))
query("rr_entropy", lambda m: op.term_entropy(posted(m).where(F.col("term").isin(TERMS))).select("term", F.round("entropy", 6).alias("entropy"), F.round("normalized", 6).alias("normalized")), scores_sql() + " SELECT term, round(e, 6) AS entropy, round(e / (SELECT max(e) FROM ent), 6) AS normalized FROM ent")
query("rr_bmx", lambda m: ranked(m, "idf", entropy=True), ranked_sql(IDF, entropy=True))
query(
    "rr_similarity",
    lambda m: op.term_scores(posted(m), TERMS).groupBy("id").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("k"), F.first("n").alias("n")).crossJoin(F.broadcast(op.term_entropy(posted(m).where(F.col("term").isin(TERMS))).agg(F.sum("normalized").alias("e")))).select("id", F.round(F.col("s") + op.beta(F.col("n")) * F.col("k") / len(TERMS) * F.col("e"), 6).alias("score")),
    scores_sql() + " SELECT id, round(sum(score) + 1 / ln(1 + any_value(n)) * count(*) / 3 * any_value(se), 6) AS score FROM ts, (SELECT sum(e / mx) AS se FROM (SELECT e, max(e) OVER () AS mx FROM ent)) GROUP BY id",
)


def vectors(m):
    """A vector per message: the embedding whose id has the same remainder as the message's time."""
    return m.messages.select("id", (F.col("created_at") % 500).alias("v")).join(m.blocks.select(F.col("id").alias("v"), "vec"), "v")


def first_vector(m):
    return m.blocks.where("id = 0").select(F.col("vec").alias("q"))


def cosine():
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot("vec", "q") / F.sqrt(dot("vec", "vec") * dot("q", "q"))


VEC = "SELECT m.id, list_cosine_similarity(CAST(b.vec AS DOUBLE[]), (SELECT CAST(vec AS DOUBLE[]) FROM blocks WHERE id = 0)) AS c FROM messages m JOIN blocks b ON b.id = m.created_at % 500"
query(
    "rr_hybrid",
    lambda m: ranked(m, "idf").join(vectors(m).crossJoin(F.broadcast(first_vector(m))).select("id", cosine().alias("c")), "id", "full").select("id", F.round(op.mixed(F.col("score"), F.col("c"), 0.4), 4).alias("score")),
    ranked_sql(IDF).replace("SELECT id, round(base", "SELECT coalesce(t.id, v.id) AS id, round(0.6 * coalesce(score, 0) + 8 * greatest(0, coalesce(c, 0)), 4) AS score FROM (SELECT id, round(base", 1) + f") t FULL JOIN ({VEC}) v ON v.id = t.id",
)
query(
    "rr_search",
    lambda m: ranked(m, "idf").where("score > 0").join(m.messages.where("role = 'assistant'").select("id"), "id", "left_semi").orderBy(F.desc("score"), "id").limit(25),
    "SELECT * FROM (" + ranked_sql(IDF) + ") WHERE score > 0 AND id IN (SELECT id FROM messages WHERE role = 'assistant') ORDER BY score DESC, id LIMIT 25",
)
query("rr_compact", lambda m: posted(m, "role = 'user'").unionByName(posted(m, "role <> 'user'")).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("tf")), f"SELECT field, count(*) AS n, CAST(sum(tf) AS BIGINT) AS tf FROM ({POST}) GROUP BY field")
query(
    "rr_overlay",
    lambda m: op.overlay(posted(m).where("term = 'the'"), posted(m, "role = 'user'").where("term = 'the'").withColumn("tf", F.col("tf") + 100), ["term", "id"]).groupBy("field").agg(F.sum("tf").alias("tf")),
    f"SELECT field, CAST(sum(tf + CASE WHEN id IN (SELECT id FROM messages WHERE role = 'user') THEN 100 ELSE 0 END) AS BIGINT) AS tf FROM ({POST}) WHERE term = 'the' GROUP BY field",
)

# full-text searches: the default ranking, a least score, a scope
BASE = ranked_sql(IDF)


def fts(m, least=0.3, k=20, scope=None):
    found = ranked(m, "idf").where(F.col("score") >= least)
    found = found if scope is None else found.join(scope, "id", "left_semi")
    return found.orderBy(F.desc("score"), "id").limit(k).select("id", "score")


def fts_sql(least=0.3, k=20, scope="true"):
    return f"SELECT id, score FROM ({BASE}) WHERE score >= {least} AND {scope} ORDER BY score DESC, id LIMIT {k}"


query("fts_blocks", fts, fts_sql())
query("fts_blocks_local", lambda m: fts(m, scope=m.messages.join(m.threads.where("narrative_id = 'nar2'").select(F.col("id").alias("thread_id")), "thread_id", "left_semi")), fts_sql(scope="id IN (SELECT id FROM messages WHERE thread_id IN (SELECT id FROM threads WHERE narrative_id = 'nar2'))"))
query("fts_blocks_bubble", lambda m: fts(m, scope=m.messages.join(m.threads.where("narrative_id IN ('nar2', 'nar3')").select(F.col("id").alias("thread_id")), "thread_id", "left_semi")), fts_sql(scope="id IN (SELECT id FROM messages WHERE thread_id IN (SELECT id FROM threads WHERE narrative_id IN ('nar2', 'nar3')))"))
query("fts_blocks_rlm", lambda m: fts(m, least=0.0, k=50), fts_sql(0.0, 50))


def field_score(m, field):
    one = op.index(m.messages, {field: op.tokens("content") if field == "body" else F.slice(op.tokens("content"), 1, 8)})
    return op.ranked(op.term_scores(one, TERMS), len(TERMS), near="none").select("id", F.round("score", 6).alias("score"))


def field_sql(field):
    return ranked_sql("1.0").replace(f"WITH post AS ({POST})", f"WITH post AS (SELECT * FROM ({POST}) WHERE field = '{field}')").replace(", matched FROM (SELECT id, sum", " FROM (SELECT id, sum")


query("fts_notes_title", lambda m: field_score(m, "lead").orderBy(F.desc("score"), "id").limit(20), f"SELECT * FROM ({field_sql('lead')}) ORDER BY score DESC, id LIMIT 20")
query("fts_notes_content", lambda m: field_score(m, "body").orderBy(F.desc("score"), "id").limit(20), f"SELECT * FROM ({field_sql('body')}) ORDER BY score DESC, id LIMIT 20")
query("fts_notes_combined", lambda m: field_score(m, "body").unionByName(field_score(m, "lead")).groupBy("id").agg(F.max("score").alias("score")), f"SELECT id, max(score) AS score FROM (SELECT * FROM ({field_sql('lead')}) UNION ALL SELECT * FROM ({field_sql('body')})) GROUP BY id")
query("fts_notes_local", lambda m: field_score(m, "body").join(m.messages.where("role = 'user'").select("id"), "id", "left_semi"), f"SELECT * FROM ({field_sql('body')}) WHERE id IN (SELECT id FROM messages WHERE role = 'user')")
query("fts_blocks_regex", lambda m: m.messages.where(F.col("content").rlike("(?i)th[aeo]n ")).select("id", F.lit(1.0).alias("score")), "SELECT id, CAST(1.0 AS DOUBLE) AS score FROM messages WHERE regexp_matches(content, '(?i)th[aeo]n ')")
query("fts_notes_regex", lambda m: m.notes.where(F.col("title").rlike("^the [a-z]+ion") | F.col("content").rlike("ing(ing)+ ")).select("id"), "SELECT id FROM notes WHERE regexp_matches(title, '^the [a-z]+ion') OR regexp_matches(content, 'ing(ing)+ ')")
query(
    "fts_hybrid",
    lambda m: ranked(m, "idf").select("id", "score").join(vectors(m).crossJoin(F.broadcast(first_vector(m))).select("id", cosine().alias("c")).where("c >= 0.1"), "id", "full").select("id", F.round(0.5 * F.coalesce("score", F.lit(0.0)) + 0.5 * F.coalesce("c", F.lit(0.0)), 4).alias("score")),
    f"SELECT coalesce(t.id, v.id) AS id, round(0.5 * coalesce(score, 0) + 0.5 * coalesce(c, 0), 4) AS score FROM ({BASE}) t FULL JOIN (SELECT * FROM ({VEC}) WHERE c >= 0.1) v ON v.id = t.id",
)


def dispatched(m):
    """The ranked search, or the escaped pattern without regard to case where it finds nothing."""
    found = fts(m, least=1e9)
    other = m.messages.where(F.col("content").rlike("(?i)\\Qand the\\E")).select("id", F.lit(1.0).alias("score")).orderBy("id").limit(20)
    return found.unionByName(other.join(F.broadcast(found.agg(F.count(F.lit(1)).alias("n"))), F.col("n") == 0, "left_semi"))


query("fts_dispatch", dispatched, "SELECT id, CAST(1.0 AS DOUBLE) AS score FROM messages WHERE contains(lower(content), 'and the') ORDER BY id LIMIT 20")
query("fts_regex_snippet", lambda m: m.notes.where(F.col("content").rlike("[a-z]*tion[a-z]* of")).select("id", F.substring(F.regexp_extract("content", "[a-z]*tion[a-z]* of", 0), 1, 200).alias("snippet")).orderBy("id").limit(40), "SELECT id, substr(regexp_extract(content, '[a-z]*tion[a-z]* of'), 1, 200) AS snippet FROM notes WHERE regexp_matches(content, '[a-z]*tion[a-z]* of') ORDER BY id LIMIT 40")
query("fts_regex_blocks", lambda m: m.messages.where(F.col("content").rlike("^[A-Z][a-z]+ and")).select("id", "role"), "SELECT id, role FROM messages WHERE regexp_matches(content, '^[A-Z][a-z]+ and')")
