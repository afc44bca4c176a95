"""The scanner: everything that is found in a text from one pass over it, and the tree that its spans form.

A text is split into words once and tagged once; phrases, events, candidates for names and references follow from the
same tags. A scanned table holds the parts as arrays, so each is read by an explode and a column that nobody asks for
isn't read; write it (sources.shared.written) where several queries share it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import lexicon as lx
from . import language as op

PARTS = {
    "tokens": "word:string,tag:string,place:int,end:int",
    "phrases": "kind:string,place:int,end:int,head:string,value:string",
    "events": "place:int,end:int,verb:string,event:string,relation:string,subject:string,object:string,recipient:string",
    "marks": "kind:string,place:int,length:int,value:string",
    "candidates": "name:string,place:int",
    "references": "place:int,word:string,entity:string",
}
# Kinds of things, which `it` refers to.
NEUTRAL_KINDS = {"LOCATION", "OBJECT", "ITEM", "MONSTER"}
GENDER = {w: g for g, words in lx.PRONOUNS.items() for w in words.split()}
HISTORY = 10


def fits(entity: str, pronoun: str) -> bool:
    return "unknown" in (entity, pronoun) or entity == pronoun or (pronoun == "plural" and entity == "neutral")


def references_of(marks: list[dict], tokens: list[dict]) -> list[dict]:
    """Pronouns and proper nouns that stand for an entity tagged before them in the text: a name for the entity
    of that label, a pronoun for the latest of the last HISTORY distinct ones whose gender fits."""
    tags = []
    for m in marks:
        if m["kind"] == "entity":
            kind, label = op.re.match(op.ENTITY_TAG, m["value"]).group(1, 2)
            tags.append((m["place"], m["place"] + m["length"], label, "neutral" if kind.upper() in NEUTRAL_KINDS else "unknown"))
    if not tags:
        return []
    out, recent, at, inside = [], [], 0, [(a, b) for a, b, _, _ in tags]
    begins = [a for a, _ in inside]
    known: dict[str, str] = {}
    for t in tokens:
        while at < len(tags) and tags[at][1] <= t["place"]:
            _, _, label, gender = tags[at]
            recent = [(label, gender), *(x for x in recent if x[0] != label)][:HISTORY]
            known[label.lower()] = label
            at += 1
        k = bisect_left(begins, t["place"] + 1) - 1
        if k >= 0 and t["place"] < inside[k][1]:
            continue  # the tag's own words
        low = t["word"].lower()
        if low in GENDER:
            entity = next((label for label, gender in recent if fits(gender, GENDER[low])), None)
        else:
            entity = known.get(low) if t["tag"] == "P" else None
        if entity is not None:
            out.append({"place": t["place"], "word": t["word"], "entity": entity})
    return out


def parts_of(text: str, verbs: dict | None = None, wanted: set[str] | None = None) -> dict:
    """The wanted parts of one text (all by default); what no wanted part needs isn't made."""
    wanted = wanted or set(PARTS)
    out: dict[str, list] = {}
    if wanted & {"marks", "references"}:
        out["marks"] = op.marks_of(text)
    if wanted <= {"marks"}:
        return out
    plain, bounds = op.split(text)
    letters = op.tagged(plain)
    if wanted & {"tokens", "references"}:
        out["tokens"] = [{"word": w, "tag": c, "place": a, "end": b} for w, c, a, b in zip(plain, letters, bounds[::2], bounds[1::2], strict=False)]
    if wanted & {"phrases", "events", "candidates"}:
        out["phrases"] = op.phrases_of(text, plain, bounds, letters)
    if "candidates" in wanted:
        out["candidates"] = [{"name": p["head"], "place": p["place"]} for p in out["phrases"] if p["kind"] == "NP" and p["head"][:1].isupper()]
    if "events" in wanted:
        out["events"] = op.events_between(out["phrases"], verbs)
        given = [(bounds[2 * i], n) for i, (w, n) in enumerate(zip(plain, plain[1:], strict=False)) if w.lower() == "to" and "A" <= n[0] <= "Z"] if out["events"] else []
        for e in out["events"]:  # to whom: the first capitalised word after a `to` that follows the verb
            k = bisect_left(given, (e["end"],))
            e["recipient"] = given[k][1] if k < len(given) else None
    if "references" in wanted:
        out["references"] = references_of(out["marks"], out["tokens"])
    return {p: out[p] for p in PARTS if p in wanted}


def scan(docs: DataFrame, text: str, key: str = "id", parts: list[str] | None = None, verbs: dict | None = None) -> DataFrame:
    """key and, for each of parts (all of PARTS by default), an array of its rows in order of place. A null text is
    empty: its arrays are too. Texts are handed on every op.ROWS parts, so a worker holds those and one text's."""
    wanted = parts or list(PARTS)
    shape = StructType([docs.select(key).schema[0], *StructType.fromDDL(",".join(f"{p}:array<struct<{PARTS[p]}>>" for p in wanted)).fields])
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0

        def full() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist(rows, schema=arrow)
            rows.clear()
            return made

        for b in batches:
            for own, t in zip(b.column(0), b.column(1), strict=True):
                found = parts_of(t.as_py() or "", verbs, set(wanted))
                rows.append({key: own.as_py()} | found)
                held += 1 + sum(map(len, found.values()))
                if held >= op.ROWS:
                    yield full()
                    held = 0
        if rows:
            yield full()

    return docs.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, shape)


def rows_of(docs: DataFrame, text: str, name: str, fields: list[str] | None = None, key: str = "id", verbs: dict | None = None) -> DataFrame:
    """key and fields (all by default) of one part's rows, without arrays of a text between."""
    kinds = [f for f in PARTS[name].split(",") if fields is None or f.split(":")[0] in fields]
    return op.exploded(docs, text, lambda t: parts_of(t, verbs, {name})[name], ",".join(kinds), key)


def part(scanned: DataFrame, name: str, key: str = "id") -> DataFrame:
    """One part's rows."""
    return scanned.select(key, F.explode(name).alias("x")).select(key, "x.*")


def occurrences(docs: DataFrame, text: str, scanned: DataFrame, forms: DataFrame, key: str = "id") -> DataFrame:
    """key, place, words, surface, id: dictionary entries in the text, but those of which a tagged mark holds a word.

    Places count words of the canonical text, and so do the marks' when their surroundings are made canonical."""
    found = op.dictionary_scan(docs, forms, text, key)
    marked = part(scanned, "marks", key).join(docs, key)
    before = F.substring(F.col(text), F.lit(1), F.col("place"))
    count = lambda c: F.size(F.filter(F.split(op.canonical(c), " "), lambda w: w != ""))
    spans = marked.select(F.col(key).alias("_key"), count(before).alias("_a"), (count(before) + count(F.col("value"))).alias("_b"))
    inside = (F.col(key) == F.col("_key")) & (F.col("place") < F.col("_b")) & (F.col("place") + F.col("words") > F.col("_a"))
    return found.join(spans, inside, "left_anti")


# Which of two spans that begin together stands outside.
OUTSIDE = {"paragraph": 90, "sentence": 80, "phrase": 50, "mark": 40, "token": 10}


SENTENCE_END = op.re.compile("[.!?]")


def structure_of(text: str) -> list[tuple[int, int, str, str]]:
    """Paragraphs (between blank lines) and their sentences, which end with . ! or ?."""
    out, at = [], 0
    for block in text.split("\n\n"):
        if block:
            out.append((at, at + len(block), "paragraph", "paragraph"))
            begin = 0
            for m in SENTENCE_END.finditer(block):
                if (i := m.start()) >= begin:
                    out.append((at + begin, at + i + 1, "sentence", "sentence"))
                    begin = i + 1
                    while begin < len(block) and block[begin].isspace():
                        begin += 1
            if begin < len(block):
                out.append((at + begin, at + len(block), "sentence", "sentence"))
        at += len(block) + 2
    return out


def nested_spans(text: str, words: bool = True) -> list[dict]:
    """The spans of a text as a tree: node (its number in reading order), parent (null at the top), depth, level, kind,
    place, end, leaves (words and marks of punctuation that stand directly in it). A span's parent is the closest before it, in order of begin, level and length, that holds all of it; so
    a span that crosses another is that one's sibling. One sweep with a stack of the spans still open.

    A word holds no span and comes after those that begin with it; so words are numbered and counted by their places, between
    one span and the next, and become rows only where words are wanted."""
    plain, bounds = op.split(text)
    letters = op.tagged(plain)
    begins, ends = bounds[: 2 * len(plain) : 2], bounds[1 : 2 * len(plain) : 2]
    found = [*structure_of(text), *((bounds[2 * m.start()], bounds[2 * m.end() - 1], "phrase", m.lastgroup) for m in op.PHRASE.finditer(letters))]
    found += [(m["place"], m["place"] + m["length"], "mark", m["kind"]) for m in op.marks_of(text)]
    spans = sorted((a, -OUTSIDE[level], a - b, kind, b, level) for a, b, level, kind in found)
    out: list[dict] = []
    rows: list[dict] = []  # out and, where wanted, the words
    open_: list[int] = []  # places in out
    held = [s[4] for s in spans]

    def leaves(i: int, j: int) -> None:
        """Words i to j stand in the last open span that holds them."""
        at = i
        for k in reversed(open_):
            if at == j:
                break
            if (until := bisect_right(ends, held[k], at, j)) > at:
                out[k]["leaves"] += until - at
                if words:
                    token_rows(at, until, out[k])
                at = until
        if words:
            token_rows(at, j, None)

    def token_rows(i: int, j: int, parent: dict | None) -> None:
        place = {"parent": parent["node"], "depth": parent["depth"] + 1} if parent is not None else {"parent": None, "depth": 0}
        rows.extend({"node": len(out) + t, **place, "level": "token", "kind": "punctuation" if letters[t] == "U" else "word", "place": begins[t], "end": ends[t], "leaves": 0} for t in range(i, j))

    done, many = 0, len(plain)
    for a, _, _, kind, b, level in spans:
        if done < many and begins[done] < a:
            before = bisect_left(begins, a, done)
            leaves(done, before)
            done = before
        if open_ and held[open_[-1]] <= a or len(open_) > 8:
            open_ = [k for k in open_ if held[k] > a]
        parent, depth = None, 0
        for k in reversed(open_):
            if held[k] >= b:
                parent, depth = out[k]["node"], out[k]["depth"] + 1
                break
        row = {"node": len(out) + done, "parent": parent, "depth": depth, "level": level, "kind": kind, "place": a, "end": b, "leaves": 0}
        open_.append(len(out))
        out.append(row)
        rows.append(row)
    leaves(done, many)
    return rows


def nested(docs: DataFrame, text: str, key: str = "id", levels: list[str] | None = None) -> DataFrame:
    """key and every span of a text, or those of some levels, in the tree of all of them (see nested_spans)."""
    wanted = list(OUTSIDE) if levels is None else levels
    work = lambda t: [s for s in nested_spans(t, "token" in wanted) if s["level"] in wanted]
    return op.exploded(docs, text, work, "node:int,parent:int,depth:int,level:string,kind:string,place:int,end:int,leaves:bigint", key)
