"""Per-key machines over event time: rows in order, timers that fire between them, and state that ends.

Rows of a batch come in any order and some come late, so a key's rows wait in its state until the watermark has
passed them: from then on no earlier row can come. A machine then takes them one by one; before each, and up to the
watermark at last, its deadline fires if it has passed. What a key holds is bounded by the watermark's delay.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECOND = 1_000_000


class Machine:
    """State of one key. Times are microseconds since 1970; take and fire give output rows."""

    def deadline(self) -> int | None:
        return None

    def take(self, at: int, row: dict) -> list[tuple]:
        raise NotImplementedError

    def fire(self, at: int) -> list[tuple]:
        return []

    def idle(self) -> bool:
        """Whether nothing is held, so that the key's state can go."""
        return self.deadline() is None


@dataclass
class Debounce(Machine):
    """A flush `quiet` after the last event, and no later than `longest` after the first that waits."""

    quiet: int
    longest: int
    first: int | None = None
    last: int = 0
    n: int = 0

    def deadline(self) -> int | None:
        return None if self.first is None else min(self.last + self.quiet, self.first + self.longest)

    def take(self, at: int, row: dict) -> list[tuple]:
        self.first = at if self.first is None else self.first
        self.last, self.n = at, self.n + 1
        return []

    def fire(self, at: int) -> list[tuple]:
        out = [(self.first, at, self.n, "quiet" if self.last + self.quiet <= at else "longest")]
        self.first, self.last, self.n = None, 0, 0
        return out


@dataclass
class Session(Machine):
    """Entities of one note wait until a sentence ends, the note changes or nothing happens for `pause`. Rows have
    kind (entity, end or key; the others only touch the timer), note and entity."""

    pause: int
    note: str | None = None
    entities: list = field(default_factory=list)
    first: int = 0
    last: int = 0

    def deadline(self) -> int | None:
        return self.last + self.pause if self.entities else None

    def flush(self, at: int, why: str) -> list[tuple]:
        out = [(self.note, self.first, at, len(self.entities), why)]
        self.entities = []
        return out

    def fire(self, at: int) -> list[tuple]:
        return self.flush(at, "idle")

    def take(self, at: int, row: dict) -> list[tuple]:
        out = []
        if row["kind"] == "entity":
            if self.entities and self.note != row["note"]:
                out = self.flush(at, "note")
            if not self.entities:
                self.first = at
            if row["entity"] not in self.entities:
                self.entities.append(row["entity"])
            self.note, self.last = row["note"], at
        elif self.entities:
            self.last = at
            out = self.flush(at, "end") if row["kind"] == "end" else []
        return out


def advanced(machine: Machine, rows: list[tuple[int, int, dict]], until: int) -> list[tuple]:
    """Output of a machine that takes rows (time, number, row) in order, and fires up to `until`."""
    out = []
    for at, _, row in rows:
        while (d := machine.deadline()) is not None and d <= at:
            out += machine.fire(d)
        out += machine.take(at, row)
    while (d := machine.deadline()) is not None and d <= until:
        out += machine.fire(d)
    return out


#: Keys are dealt to so many groups, each with one state and one call of the worker a batch: a call costs more than a key's rows.
GROUPS = 1024


def timed(stream: DataFrame, key: str, columns: list[str], machine: Callable[[], Machine], schema: str, late: str = "1 hour") -> DataFrame:
    """key and what a machine for each key gives out. stream: key, ts, event_id (which orders equal times) and columns
    (text or numbers, as key is); rows later than the watermark's delay are dropped by Spark."""
    kinds = dict(stream.dtypes)
    names = [c.split()[0] for c in schema.split(", ")]

    def work(_, batches: Iterator[pd.DataFrame], held):
        kept = json.loads(held.get[0]) if held.exists else []
        waiting = {k: [tuple(r) for r in rows] for k, rows, _ in kept}
        states = {k: own for k, _, own in kept}
        for b in batches:
            for k, at, number, *values in zip(b["_key"].tolist(), b["_at"].tolist(), b["event_id"].tolist(), *(b[c].tolist() for c in columns), strict=True):
                waiting.setdefault(k, []).append((at, number, dict(zip(columns, values, strict=True))))
        passed = held.getCurrentWatermarkMs() * 1000
        out, kept, nearest = [], [], []
        for k, rows in waiting.items():
            own = machine()
            own.__dict__.update(states.get(k, {}))
            rows.sort(key=lambda r: r[:2])
            ready = bisect_right(rows, passed, key=lambda r: r[0])
            out += [(k, *row) for row in advanced(own, rows[:ready], passed)]
            if ready < len(rows) or not own.idle():
                kept.append((k, rows[ready:], own.__dict__))
                nearest += [t for t in (rows[ready][0] if ready < len(rows) else None, own.deadline()) if t is not None]
        if kept:
            held.update((json.dumps(kept),))
            held.setTimeoutTimestamp(max(min(nearest) // 1000 + 1, passed // 1000 + 1))
        else:
            held.remove()
        yield pd.DataFrame(out, columns=["_key", *names])

    rows = stream.withColumn("_at", F.unix_micros("ts")).withWatermark("ts", late)
    rows = rows.withColumn("_key", F.col(key).cast("string")).withColumn("_group", F.pmod(F.hash("_key"), F.lit(GROUPS)))
    made = rows.groupBy("_group").applyInPandasWithState(work, f"_key string, {schema}", "state string", "append", "EventTimeTimeout")
    return made.select(F.col("_key").cast(kinds[key]).alias(key), *names)


def debounced(stream: DataFrame, key: str, quiet: float = 3.0, longest: float = 10.0, late: str = "1 hour") -> DataFrame:
    """key, first, moment, n, why of every flush of a key's events: `quiet` seconds after the last of them, or `longest`
    after the first where they don't stop."""
    return timed(stream, key, [], lambda: Debounce(round(quiet * SECOND), round(longest * SECOND)), "first bigint, moment bigint, n bigint, why string", late)


def flushed(stream: DataFrame, key: str, pause: float = 0.5, late: str = "1 hour") -> DataFrame:
    """key, note, first, moment, n, why: how many entities a note's buffer held when it was flushed. stream: key, ts,
    event_id, kind (entity, end of a sentence, or another key), note, entity."""
    return timed(stream, key, ["kind", "note", "entity"], lambda: Session(round(pause * SECOND)), "note string, first bigint, moment bigint, n bigint, why string", late)
