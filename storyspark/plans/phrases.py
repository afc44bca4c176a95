"""Registered queries of words, tags, phrases, events and the tree of spans. Their SQL splits, tags a word by the two
before it (determiners, adjectives and adverbs never change, and a modal does only after these or after `of`), and
finds phrases as runs of tags by one regular expression."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..operators import language as op
from ..operators import scan as sc
from .language import STEM, VERBS
from .registry import query

WORD = r"[\p{L}\p{N}]+(?:[''\-]+[\p{L}\p{N}]*)*|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{1c}-\x{1f}\v]|_"
PARTS = ", ".join(f"('{w}', '{p}')" for p, words in lx.PARTS_OF_SPEECH for w in words)
ENDS = " ".join(f"WHEN {' OR '.join(f'''ends_with(low, '{e}')''' for e in ends)} THEN '{p}'" for p, ends in lx.SUFFIXES)
RUNS = op.re.sub(r"\?P<\w+>", "", op.PHRASE.pattern)
DOCS = "SELECT doc_id AS id, text AS t FROM documents WHERE lang = 'en'"
TALES = "SELECT id, t FROM tales WHERE narrative_id = 'en'"


def parsed(source: str) -> str:
    """Common table expressions token (id, i, w, a, b, base, tag) and phrase (id, n, kind, a, b, head) of source (id, t)."""
    return rf"""WITH src AS ({source}),
    piece AS (SELECT id, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS w, unnest(p[1:len(v)]) AS gap FROM (SELECT id, regexp_extract_all(t, '{WORD}') AS v, string_split_regex(t, '{WORD}') AS p FROM src)),
    place AS (SELECT id, i, w, lower(w) AS low, CAST(sum(length(gap) + length(w)) OVER (PARTITION BY id ORDER BY i) AS INT) AS b, lag(lower(w), 1, '') OVER (PARTITION BY id ORDER BY i) AS previous FROM piece),
    base AS (SELECT id, i, w, b - length(w) AS a, b, previous, coalesce(k.p, CASE WHEN length(w) = 1 AND NOT regexp_matches(w, '[\p{{L}}\p{{N}}]') THEN 'U' WHEN regexp_matches(w, '^\p{{Lu}}') THEN 'P' {ENDS} ELSE 'N' END) AS base
             FROM place LEFT JOIN (VALUES {PARTS}) k(w2, p) ON k.w2 = low),
    near_by AS (SELECT *, lag(base, 1, 'O') OVER (PARTITION BY id ORDER BY i) AS p1, lag(base, 2, 'O') OVER (PARTITION BY id ORDER BY i) AS p2, lag(previous, 1, '') OVER (PARTITION BY id ORDER BY i) AS w2 FROM base),
    token AS (SELECT id, i, w, a, b, base, CASE WHEN p1 IN ('D', 'J', 'A') AND base IN ('V', 'X', 'M') THEN 'N'
              WHEN ((p1 = 'M' AND p2 NOT IN ('D', 'J', 'A') AND w2 <> 'of') OR previous = 'to') AND base IN ('N', 'P', 'R') THEN 'V' WHEN previous = 'of' AND base IN ('V', 'X', 'M') THEN 'N' ELSE base END AS tag FROM near_by),
    letters AS (SELECT id, string_agg(tag, '' ORDER BY i) AS s FROM token GROUP BY id),
    run AS (SELECT id, unnest(range(1, len(v) + 1)) AS n, unnest(v) AS own, unnest(p[1:len(v)]) AS gap, unnest(pp) AS pp, unnest(vp) AS vp, unnest(np) AS np FROM (SELECT id, regexp_extract_all(s, '{RUNS}') AS v, string_split_regex(s, '{RUNS}') AS p,
            regexp_extract_all(s, '{RUNS}', 1) AS pp, regexp_extract_all(s, '{RUNS}', 2) AS vp, regexp_extract_all(s, '{RUNS}', 3) AS np FROM letters)),
    span AS (SELECT id, n, own, CASE WHEN pp <> '' THEN 'PP' WHEN vp <> '' THEN 'VP' WHEN np <> '' THEN 'NP' ELSE 'CLAUSE' END AS kind, sum(length(gap) + length(own)) OVER (PARTITION BY id ORDER BY n) AS last FROM run),
    mid AS (SELECT id, n, kind, last - length(own) + 1 AS first, last, last - length(own) + 1 + CASE kind WHEN 'PP' THEN 0 WHEN 'NP' THEN length(own) - 1
            ELSE CASE WHEN instr(own, 'V') > 0 THEN instr(own, 'V') - 1 ELSE greatest(length(regexp_extract(own, '^L?[XM]?A*')) - 1, 0) END END AS head FROM span),
    phrase AS (SELECT mid.id, n, kind, x.a, y.b, h.w AS head FROM mid JOIN token x ON x.id = mid.id AND x.i = first JOIN token y ON y.id = mid.id AND y.i = last JOIN token h ON h.id = mid.id AND h.i = mid.head),
    near AS (SELECT *, last_value(CASE WHEN kind = 'NP' THEN head END IGNORE NULLS) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
             first_value(CASE WHEN kind = 'NP' THEN head END IGNORE NULLS) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM phrase),
    event AS (SELECT id, a, b, v.e AS event, v.r AS relation, coalesce(before, 'Unknown') AS subject, coalesce(after, 'Unknown') AS object
              FROM (SELECT *, {STEM.replace("lower(w)", "lower(head)")} AS stem FROM near WHERE kind = 'VP') JOIN (VALUES {VERBS}) v(s, e, r, k) ON v.s = stem) """


def sample(m):
    """English documents: the tags are those of English."""
    return m.documents.where("lang = 'en'").select(F.col("doc_id").alias("id"), F.col("text").alias("t"))


def part(m, name, *fields):
    return sc.rows_of(sample(m), "t", name, fields=list(fields))


def tales(m):
    return m.tales.where("narrative_id = 'en'").select("id", "t")


P = parsed(DOCS)
query("nlp_pos_base", lambda m: op.exploded(sample(m), "t", op.base_counts, "tag:string,n:bigint").groupBy("id", "tag").agg(F.sum("n").alias("n")), P + "SELECT id, base AS tag, count(*) AS n FROM token GROUP BY ALL")
query("nlp_pos_tag", lambda m: op.exploded(sample(m), "t", op.tag_counts, "tag:string,n:bigint,places:bigint").groupBy("id", "tag").agg(F.sum("n").alias("n"), F.sum("places").alias("places")), P + "SELECT id, tag, count(*) AS n, CAST(sum(a) AS BIGINT) AS places FROM token GROUP BY ALL")
query("nlp_chunks", lambda m: op.phrase_rows(sample(m), "t", fields=["kind", "place", "end"]), P + 'SELECT id, kind, a AS place, b AS "end" FROM phrase')
for name, kind in (("nlp_np", "NP"), ("nlp_vp", "VP"), ("nlp_pp", "PP"), ("nlp_adjp", "ADJP"), ("nlp_clause", "CLAUSE")):
    query(name, lambda m, kind=kind: op.phrase_rows(sample(m), "t", kinds={kind}, fields=["place", "end", "head"]), P + f"""SELECT id, a AS place, b AS "end", head FROM phrase WHERE kind = '{kind}'""")
query("nlp_events", lambda m: part(m, "events", "place", "event", "relation", "subject", "object").select("id", "place", "event", "relation", "subject", "object"), P + "SELECT id, a AS place, event, relation, subject, object FROM event")


def beside(m, order):
    """Each verb phrase's nearest noun phrase before it in that order: a running value, whatever a text's length."""
    rows = op.phrase_rows(sample(m), "t", kinds={"NP", "VP"}, fields=["kind", "place", "head"])
    w = Window.partitionBy("id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("near", F.last(F.when(F.col("kind") == "NP", F.col("head")), ignorenulls=True).over(w)).where("kind = 'VP'").select("id", "place", "near")


query("nlp_prev_np", lambda m: beside(m, F.asc("place")), P + "SELECT id, a AS place, before AS near FROM near WHERE kind = 'VP'")
query("nlp_next_np", lambda m: beside(m, F.desc("place")), P + "SELECT id, a AS place, after AS near FROM near WHERE kind = 'VP'")
query("nlp_svo", lambda m: part(m, "events", "relation", "subject", "object").where("subject <> 'Unknown' AND object <> 'Unknown'").groupBy("subject", "relation", "object").agg(F.count(F.lit(1)).alias("n")),
    P + "SELECT subject, relation, object, count(*) AS n FROM event WHERE subject <> 'Unknown' AND object <> 'Unknown' GROUP BY ALL")
query("nlp_project", lambda m: part(m, "events", "relation", "subject", "object").where("subject <> 'Unknown'").select(F.lower("subject").alias("source"), "relation", F.lower("object").alias("target")).distinct(),
    P + "SELECT DISTINCT lower(subject) AS source, relation, lower(object) AS target FROM event WHERE subject <> 'Unknown'")
query("nlp_recipient", lambda m: sc.rows_of(tales(m), "t", "events", ["place", "event", "recipient"]).where("recipient IS NOT NULL").select("id", "place", "event", "recipient"),
    parsed(TALES) + """, given AS (SELECT x.id, x.a, y.w FROM token x JOIN token y ON y.id = x.id AND y.i = x.i + 1 WHERE lower(x.w) = 'to' AND regexp_matches(y.w, '^[A-Z]'))
      SELECT event.id, event.a AS place, any_value(event) AS event, arg_min(w, given.a) AS recipient FROM event JOIN given ON given.id = event.id AND given.a >= event.b GROUP BY event.id, event.a""")  # fmt: skip



def scanned(m):
    """How many rows each part of each tale has, and where they lie."""
    whole = sc.scan(tales(m), "t")
    rows = F.array(*[F.struct(F.lit(p).alias("part"), F.size(p).alias("n"), F.aggregate(p, F.lit(0).cast("bigint"), lambda s, x: s + x["place"]).alias("places")) for p in sc.PARTS])
    return whole.select("id", F.explode(rows).alias("x")).select("id", "x.*")


#: No & stands before a # in tales, and SQL's expressions can't look behind.
MARKS = "|".join(f"({p})" for _, p in op.MARKS).replace("(?<!&)", "")
GROUP = [1 + sum(op.re.compile(p).groups + 1 for _, p in op.MARKS[:k]) for k in range(len(op.MARKS))]
ENTITY = r"^\[([A-Za-z_]+)[|:]([^\]|@]+)"
GENDERS = ", ".join(f"('{w}', '{g}')" for g, words in lx.PRONOUNS.items() for w in words.split())
FITS = "(g IN (y.gender, 'unknown') OR y.gender = 'unknown' OR (y.gender = 'plural' AND g = 'neutral'))"
SCAN = (
    parsed(TALES)
    + rf""", mark AS (SELECT id, i, v, CAST(sum(length(gap) + length(v)) OVER (PARTITION BY id ORDER BY i) AS INT) AS b, entity FROM (SELECT id, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS v, unnest(p[1:len(v)]) AS gap, unnest(e) <> '' AS entity
        FROM (SELECT id, regexp_extract_all(t, '{MARKS}') AS v, string_split_regex(t, '{MARKS}') AS p, regexp_extract_all(t, '{MARKS}', {GROUP[3]}) AS e FROM src))),
    tagged AS (SELECT id, b - length(v) AS a, b, regexp_extract(v, '{ENTITY}', 2) AS label, CASE WHEN upper(regexp_extract(v, '{ENTITY}', 1)) IN ({", ".join(f"'{k}'" for k in sorted(sc.NEUTRAL_KINDS))}) THEN 'neutral' ELSE 'unknown' END AS g FROM mark WHERE entity),
    asked AS (SELECT token.id, a, b, w, gender, tag FROM token LEFT JOIN (VALUES {GENDERS}) y(q, gender) ON q = lower(w) WHERE (gender IS NOT NULL OR tag = 'P') AND NOT EXISTS (SELECT 1 FROM tagged x WHERE x.id = token.id AND x.a <= token.a AND token.a < x.b)),
    seen AS (SELECT y.id, y.a, y.gender, y.w, x.label, max(x.b) AS last, arg_max(x.g, x.b) AS g FROM asked y JOIN tagged x ON x.id = y.id AND x.b <= y.a GROUP BY ALL),
    late AS (SELECT *, row_number() OVER (PARTITION BY id, a ORDER BY last DESC) AS rn FROM seen),
    reference AS (SELECT DISTINCT id, a FROM late y WHERE (gender IS NOT NULL AND rn <= {sc.HISTORY} AND {FITS}) OR (gender IS NULL AND lower(w) = lower(label))),
    every AS (SELECT id, 'tokens' AS part, a FROM token UNION ALL SELECT id, 'phrases', a FROM phrase UNION ALL SELECT id, 'events', a FROM event UNION ALL SELECT id, 'marks', b - length(v) FROM mark
        UNION ALL SELECT id, 'candidates', a FROM phrase WHERE kind = 'NP' AND regexp_matches(head, '^\p{{Lu}}') UNION ALL SELECT id, 'references', a FROM reference)
    SELECT src.id, part, CAST(count(a) AS INT) AS n, CAST(coalesce(sum(a), 0) AS BIGINT) AS places FROM src CROSS JOIN (VALUES ('tokens'), ('phrases'), ('events'), ('marks'), ('candidates'), ('references')) p(part) LEFT JOIN every USING (id, part) GROUP BY ALL"""
)
query("nlp_scan", scanned, SCAN)
query("nlp_syntax", lambda m: sc.rows_of(m.tales, "t", "marks", ["kind", "place"]).groupBy("id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("place").alias("places")),
    f"""WITH mark AS (SELECT id, unnest(v) AS v, {", ".join(f"unnest(g{k}) AS g{k}" for k in range(len(op.MARKS)))}, unnest(p[1:len(v)]) AS gap, unnest(range(len(v))) AS i FROM (SELECT id, regexp_extract_all(t, '{MARKS}') AS v, string_split_regex(t, '{MARKS}') AS p,
        {", ".join(f"regexp_extract_all(t, '{MARKS}', {g}) AS g{k}" for k, g in enumerate(GROUP))} FROM tales)),
      located AS (SELECT id, CASE {" ".join(f"WHEN g{k} <> '' THEN '{name}'" for k, (name, _) in enumerate(op.MARKS))} END AS kind, sum(length(gap) + length(v)) OVER (PARTITION BY id ORDER BY i) - length(v) AS a FROM mark)
      SELECT id, kind, count(*) AS n, CAST(sum(a) AS BIGINT) AS places FROM located GROUP BY ALL""")  # fmt: skip


def tree(m):
    """Every span but the words, with its parent and how many words and marks of punctuation stand directly in it."""
    rows = sc.nested(m.tales, "t", levels=["paragraph", "sentence", "phrase", "mark"])
    return rows.select("id", "node", "parent", "depth", "level", "kind", "place", "end", "leaves")


query("nlp_cst", tree)
