"""Grounding of relations in text: where both ends stand, and whether they stand close to each other."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters between the nearest mentions of both ends, at most.
REACH = 500


def _places(text: str, word: str | None) -> list[int]:
    """Where word occurs in text, from the left without overlap, as characters before it; empty for an empty or null
    word. Case counts: give both in lower case where it shouldn't."""
    out = []
    at = text.find(word) if word else -1
    while at >= 0:
        out.append(at)
        at = text.find(word, at + len(word))
    return out


def _closest(a: list[int], b: list[int]) -> tuple[int, int] | None:
    """The closest places of two sorted lists, the earliest of equal ones; None where one is empty. In the order of both
    together the closest pair stands side by side."""
    best, gap, i, j = None, 0, 0, 0
    while i < len(a) and j < len(b):
        apart = abs(a[i] - b[j])
        if best is None or apart < gap:
            best, gap = (a[i], b[j]), apart
        if a[i] <= b[j]:
            i += 1
        else:
            j += 1
    return best


def nearest(a: Column, b: Column) -> Column:
    """struct(a, b) of the closest places of two sorted arrays (see _closest)."""

    @F.arrow_udf("struct<a:int,b:int>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        found = [_closest(p or [], q or []) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)]
        return pa.array([f and {"a": f[0], "b": f[1]} for f in found], pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    return run(a, b)


def ends(text: Column, subject: Column, object: Column) -> Column:
    """struct(subject_at, object_at, apart): the nearest mentions of two names in a text, or the first mention of one where
    the other has none; how far apart they are. One call for each text: expressions on arrays of places would make those
    again wherever they are named."""
    fields = ("subject_at", "object_at", "apart")

    @F.arrow_udf(",".join(f"{f}:int" for f in fields))
    def run(t: pa.Array, s: pa.Array, o: pa.Array) -> pa.Array:
        out: tuple[list, list, list] = ([], [], [])
        for x, y, z in zip(t, s, o, strict=True):
            x = x.as_py() or ""
            a, b = _places(x, y.as_py()), _places(x, z.as_py())
            pair = _closest(a, b)
            p, q = pair or (a[0] if a else None, b[0] if b else None)
            for c, v in zip(out, (p, q, abs(p - q) if pair else None), strict=True):
                c.append(v)
        return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in out], list(fields))

    return run(text, subject, object)


def grounded(relations: DataFrame, notes: DataFrame, note: str = "note_id", subject: str = "subject", object: str = "object", text: str = "text", reach: int = REACH) -> DataFrame:
    """relations (note, subject, object and others) with subject_at, object_at (of the nearest mentions), valid and issues.

    Each relation meets its note's text once, by an equality join on the note. Names are found in any case; a relation
    whose note is missing, or has no text, grounds nothing."""
    met = relations.join(notes.select(F.col("id").alias(note), F.col(text).alias("_note")), note, "left")
    return located(met, subject, object, "_note", reach).drop("_note")


def located(relations: DataFrame, subject: str = "subject", object: str = "object", text: str = "text", reach: int = REACH) -> DataFrame:
    """The same of relations that hold their note's text themselves, so that no text is shuffled. issues (an array, empty
    where all is well): subject not found, object not found, too far apart."""
    found = relations.withColumn("_x", ends(F.lower(F.col(text)), F.lower(F.col(subject)), F.lower(F.col(object))))
    found = found.withColumn("subject_at", F.col("_x.subject_at")).withColumn("object_at", F.col("_x.object_at"))
    missing = [F.when(F.col(f"_x.{c}_at").isNull(), f"{c} not found") for c in ("subject", "object")]
    issues = F.array_compact(F.array(*missing, F.when(F.col("_x.apart") > reach, "too far apart")))
    return found.withColumn("issues", issues).withColumn("valid", F.size("issues") == 0).drop("_x")
