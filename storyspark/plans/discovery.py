"""Registered queries of the discovery of names; their SQL spreads by recursion over the whole state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..operators import discovery as op
from ..sources.shared import written
from .language import STEM, VERBS
from .registry import query

TOKENS = r"[\p{L}\p{Nd}''\-·._/#&]+"
STOPPED = ", ".join(f"'{w}'" for w in op.STOP_WORDS)


def words_sql(text):
    return f"regexp_extract_all(translate({text}, '’', ''''), '{TOKENS}')"


def key_sql(word):
    bare = rf"regexp_replace({word}, '^[^\p{{L}}\p{{Nd}}''-]+|[^\p{{L}}\p{{Nd}}''-]+$', '', 'g')"
    own = f"(CASE WHEN length({bare}) > 2 AND ends_with(lower({bare}), '''s') THEN left({bare}, length({bare}) - 2) ELSE {bare} END)"
    return rf"CASE WHEN regexp_matches({own}, '\p{{L}}') AND length({own}) >= 2 THEN lower({own}) END"


CAPITAL = r"regexp_matches({}, '^\p{{Lu}}')"
query(
    "nlp_discover",
    lambda m: op.candidates(m.documents, "text").withColumn("status", F.when(F.col("n") >= op.THRESHOLD, "promoted").otherwise("watching")),
    f"""SELECT name, CAST(sum(n) AS BIGINT) AS n, arg_max(w, (n, w)) AS display, CASE WHEN sum(n) >= {op.THRESHOLD} THEN 'promoted' ELSE 'watching' END AS status
        FROM (SELECT w, {key_sql("w")} AS name, n FROM (SELECT w, count(*) AS n FROM (SELECT unnest({words_sql("text")}) AS w FROM documents) WHERE {CAPITAL.format("w")} GROUP BY w)) WHERE name IS NOT NULL AND name NOT IN ({STOPPED}) GROUP BY name""",
)

SEEDS = [("p7", "CHARACTER"), ("p30", "FACTION")]
SEEN = 4


def discovered(m):
    seeds = m.spark.createDataFrame(SEEDS, "name string, kind string")
    told = written(m.rumours, "rumours")  # once for both
    return op.spread(op.candidates(told, "t"), op.triples(told, "t"), seeds, threshold=SEEN)


TELLS = "CASE " + " ".join(f"WHEN k = '{kind}' AND event IN ({', '.join(repr(n) for n in names.split())}) THEN '{to}'" for kind, table in lx.INFERRED.items() for names, to in table.items()) + " END"
VERB = STEM.replace("lower(w)", "lower(regexp_replace(w, '[._]+$', ''))")
query(
    "nlp_discover_virus",
    discovered,
    f"""WITH RECURSIVE word AS (SELECT id, unnest(range(len(w))) AS place, unnest(w) AS w FROM (SELECT id, {words_sql("t")} AS w FROM rumours)),
        named AS (SELECT id, place, w, {key_sql("w")} AS name FROM word),
        counted AS (SELECT name, count(*) AS n FROM named WHERE {CAPITAL.format("w")} AND name IS NOT NULL AND name NOT IN ({STOPPED}) GROUP BY name),
        triple AS (SELECT a.name AS source, v.e AS event, b.name AS target, a.id, a.place FROM named a JOIN (SELECT id, place, {VERB} AS stem FROM word) c ON c.id = a.id AND c.place = a.place + 1
            JOIN named b ON b.id = a.id AND b.place = a.place + 2 JOIN (VALUES {VERBS}) v(s, e, r, x) ON v.s = stem WHERE {CAPITAL.format("b.w")} AND a.name IS NOT NULL AND b.name IS NOT NULL AND b.name NOT IN ({STOPPED})),
        seed AS (SELECT * FROM (VALUES {", ".join(f"('{n}', '{k}')" for n, k in SEEDS)}) s(name, kind)),
        st(step, name, n, kind, round) AS (
            SELECT 0, name, CAST(coalesce(n, 0) AS BIGINT), kind, CASE WHEN kind IS NOT NULL THEN 0 END FROM (SELECT name, sum(n) AS n FROM (SELECT name, n FROM counted UNION ALL SELECT target, 0 FROM triple) GROUP BY name) FULL JOIN seed USING (name)
            UNION ALL
            SELECT step + 1, name, n + coalesce(more, 0), coalesce(kind, told), CASE WHEN round IS NULL AND coalesce(kind, told) IS NOT NULL AND n + coalesce(more, 0) >= {SEEN} THEN step + 1 ELSE round END
            FROM st LEFT JOIN (SELECT target AS name, count(*) AS more, arg_min(told, (id, place, source)) AS told FROM (SELECT target, id, place, source, {TELLS} AS told FROM (SELECT name AS s, kind AS k FROM st WHERE round = step) JOIN triple ON source = s) GROUP BY target) USING (name)
            WHERE (SELECT count(*) FROM st WHERE round = step) > 0)
        SELECT name, n, kind, CASE WHEN n >= {SEEN} OR round = 0 THEN 'promoted' ELSE 'watching' END AS status, round FROM st WHERE step = (SELECT max(step) FROM st)""",
)
