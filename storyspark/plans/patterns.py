"""Registered queries of span patterns. Their SQL finds every match by splitting at it, and chooses by a fold."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import patterns as op
from .registry import query


def chosen_sql(sources: list[str], groups: int = 7) -> str:
    """id, k (which expression), a, b (from, to), v (the match), g (its groups) of the matches left over tales."""
    each = " UNION ALL ".join(
        rf"""SELECT id, {k} AS k, i, list_sum([length(x) FOR x IN p[1:i]]) + coalesce(list_sum([length(x) FOR x IN v[1:i - 1]]), 0) AS a, v[i] AS v,
             [{", ".join(f"g{g}[i]" if g <= _groups(s) else "''" for g in range(1, groups + 1))}] AS g
             FROM (SELECT id, string_split_regex(t, '{s}') AS p, regexp_extract_all(t, '{s}') AS v,
                   {", ".join(f"regexp_extract_all(t, '{s}', {g}) AS g{g}" for g in range(1, _groups(s) + 1))} FROM tales), unnest(range(1, len(v) + 1)) AS u(i)"""
        for k, s in enumerate(sources)
    )
    return f"""SELECT id, x.k AS k, x.a AS a, x.b AS b, x.v AS v, x.g AS g FROM (SELECT id, unnest(list_reduce(list([{{'k': k, 'a': a, 'b': a + length(v), 'v': v, 'g': g}}] ORDER BY k, a),
        lambda acc, y: CASE WHEN len(list_filter(acc, lambda z: z.a < y[1].b AND z.b > y[1].a)) > 0 THEN acc ELSE list_concat(acc, y) END)) AS x FROM ({each}) GROUP BY id)"""


def _groups(source: str) -> int:
    return re.compile(source).groups


def book_sql(book: op.PatternBook) -> str:
    patterns = book.active()
    done = {"upper": "upper({})", "trim": "trim({})", "": "{}"}

    def captures(p: op.Pattern) -> str:
        return "array_to_string([" + ", ".join(f"CASE WHEN g[{g}] <> '' THEN '{n}=' || {done[what].format(f'g[{g}]')} END" for n, g, what in p.captures) + "], ';')"

    by = lambda f: "CASE k " + " ".join(f"WHEN {k} THEN {f(p)}" for k, p in enumerate(patterns)) + " END"
    pattern, kind = by(lambda p: f"'{p.id}'"), by(lambda p: f"'{p.kind}'")
    return f"""SELECT id, {pattern} AS pattern, {kind} AS kind, CAST(a AS INT) AS "from", CAST(b AS INT) AS "to", v AS value, {by(captures)} AS captures FROM ({chosen_sql([p.source for p in patterns])})"""


def spans_of(m, book=None):
    spans = op.pattern_spans(m.tales, "t", book=book)
    return spans.withColumn("captures", F.array_join(F.transform("captures", lambda c: F.concat_ws("=", c["name"], c["value"])), ";"))


query("nlp_patterns_default", spans_of, book_sql(op.PatternBook()))

OWN = (
    op.PatternBook()
    .added(op.Pattern("own:number", "quantity", 65, r"\b(\d+) (\w+)", (("n", 1, ""), ("of", 2, "upper"))))
    .toggled("builtin:tag")
    .without("builtin:temporal-simple")
    .prioritised("builtin:wikilink", 300)
)
query("nlp_pattern_registry", lambda m: spans_of(m, OWN), book_sql(OWN))

TAG = r"\[([A-Z_]+)\|([^|\]]+)"
KNOWN = "SELECT DISTINCT 'hero ' || id AS known FROM notes WHERE id % 2 = 0"


def decorated_sql(order: list[str]) -> str:
    at = {n: order.index(n) for n in order}
    name = lambda g: rf"coalesce(nullif(regexp_extract({g}, '{TAG}', 2), ''), nullif(regexp_extract({g}, '\[\[([^\]]+)\]\]', 1), ''), regexp_extract({g}, '<<([^>]+)>>', 1))"
    row = lambda kind, a, b, label, k="NULL", verb="NULL", source="NULL", target="NULL", direction="NULL": f"SELECT id, {kind} AS type, {a} AS a, {b} AS b, {label} AS label, {k} AS kind, {verb} AS verb, {source} AS source, {target} AS target, {direction} AS direction FROM hit"
    parts = []
    for n in ("paren", "forward_verb", "backward_verb"):
        if n in at:
            tag = lambda g, part: f"regexp_extract({g}, '{TAG}', {part})"
            one, two = (tag("g[1]", 2), tag("g[4]", 2)) if n != "backward_verb" else (tag("g[4]", 2), tag("g[1]", 2))
            before = "a + instr(substring(v, length(g[1]) + 1), g[2]) - 1 + length(g[1])"
            parts += [
                row("'entity'", "a", "a + length(g[1])", tag("g[1]", 2), tag("g[1]", 1)) + f" WHERE k = {at[n]}",
                row("'predicate'", before, f"{before} + length(g[2])", "g[3]", verb="g[3]", source=one, target=two) + f" WHERE k = {at[n]}",
                row("'entity'", "b - length(g[4])", "b", tag("g[4]", 2), tag("g[4]", 1)) + f" WHERE k = {at[n]}",
            ]
    for n in ("bidirectional", "forward", "backward"):
        one, two = (name("g[1]"), name("g[3]")) if n != "backward" else (name("g[3]"), name("g[1]"))
        verb = "coalesce(nullif(g[2], ''), 'RELATES_TO')"
        parts.append(row("'relationship'", "a", "b", verb, verb=verb, source=one, target=two, direction=f"'{n}'") + f" WHERE k = {at[n]}")
    parts.append(row("'entity'", "a", "b", "g[2]", "g[1]") + f" WHERE k = {at['entity']}")
    parts.append(row("'entity_ref'", "a", "b", "g[1]", target="g[1]") + f" WHERE k = {at['entity_ref']}")
    parts.append(row("'wikilink'", "a", "b", "g[1]", target="g[1]") + f" WHERE k = {at['wikilink']}")
    return f"""WITH hit AS ({chosen_sql([op.DECORATIONS[n] for n in order], 4)}), span AS ({" UNION ALL ".join(parts)})
        SELECT id, type, CAST(a AS INT) AS "from", CAST(b AS INT) AS "to", label, kind, verb, source, target, direction,
               type = 'wikilink' OR (type IN ('entity', 'entity_ref') AND lower(trim(label)) IN ({KNOWN})) AS resolved FROM span"""


def decorations(m, order):
    known = m.notes.where("id % 2 = 0").select(F.concat(F.lit("HERO "), F.col("id").cast("string")).alias("label"))
    return op.resolved(op.decorated(m.tales, "t", order=order), known)


query("nlp_pattern_sync", lambda m: decorations(m, op.RELATIONS_FIRST), decorated_sql(op.RELATIONS_FIRST))
query("nlp_pattern_async", lambda m: decorations(m, op.MARKS_FIRST), decorated_sql(op.MARKS_FIRST))
