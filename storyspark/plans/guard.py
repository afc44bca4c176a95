"""Queries from outside: what may run, how many rows come back, and what to try next.

A statement is judged by its parsed plan, not by its text: commands and writes are no reads, and only
workspace tables may be written to.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException, ParseException

WORKSPACE = ("ws_session", "ws_node", "ws_edge", "ws_view_cache", "ws_metric")


@dataclass(frozen=True)
class Caps:
    rows: int = 1000
    bytes: int = 1_000_000
    seconds: float = 5.0
    limit_required: bool = True


READ, WRITE = Caps(), Caps(5000, 5_000_000, 10.0, False)


@dataclass
class Verdict:
    valid: bool
    lane: str
    error: str = ""
    targets: list[str] = field(default_factory=list)


def plan_of(spark: SparkSession, sql: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def _nodes(plan) -> list:
    out, queue = [], [plan]
    while queue:
        node = queue.pop()
        out.append(node)
        children = node.children()
        queue += [children.apply(i) for i in range(children.size())]
    return out


def targets(spark: SparkSession, sql: str) -> list[str]:
    """Tables that a statement would change."""
    found = re.findall(r"\b(?:INSERT\s+(?:INTO|OVERWRITE)(?:\s+TABLE)?|UPDATE|DELETE\s+FROM|MERGE\s+INTO|REPLACE\s+TABLE|TRUNCATE\s+TABLE)\s+([\w.`]+)", re.sub(r"'[^']*'", "''", sql), re.I)
    return list(dict.fromkeys(t.replace("`", "").lower() for t in found))


def changes(spark: SparkSession, sql: str) -> bool:
    """Whether the parsed statement is anything but a query."""
    names = [n.getClass().getSimpleName() for n in _nodes(plan_of(spark, sql))]
    return any(re.search(r"Command|Insert|Create|Drop|Delete|Update|Merge|Truncate|Alter|Replace|Set|Add|Cache|Load|Refresh|Analyze", n) and n not in ("SetOperation",) for n in names)


def limited(spark: SparkSession, sql: str) -> bool:
    return any(n.getClass().getSimpleName() in ("GlobalLimit", "LocalLimit") for n in _nodes(plan_of(spark, sql)))


def check_read(spark: SparkSession, sql: str, caps: Caps = READ) -> Verdict:
    try:
        if changes(spark, sql):
            return Verdict(False, "read", "a read may not change anything", targets(spark, sql))
        if caps.limit_required and not limited(spark, sql):
            return Verdict(False, "read", "a read needs a LIMIT")
    except ParseException as e:
        return Verdict(False, "read", f"not a statement: {e.getMessage()[:200]}")
    return Verdict(True, "read")


def check_write(spark: SparkSession, sql: str) -> Verdict:
    try:
        if not changes(spark, sql):
            return Verdict(True, "read")
        if re.match(r"\s*(CREATE|DROP|ALTER)\b", sql, re.I):
            return Verdict(False, "write", "the schema may not change")
    except ParseException as e:
        return Verdict(False, "write", f"not a statement: {e.getMessage()[:200]}")
    own = targets(spark, sql)
    other = [t for t in own if t not in WORKSPACE]
    if not own or other:
        return Verdict(False, "write", "only workspace tables may change" + (": " + other[0] if other else ""), own)
    return Verdict(True, "write", "", own)


def check(spark: SparkSession, sql: str) -> Verdict:
    """The write lane for what changes something, else the read lane."""
    try:
        return check_write(spark, sql) if changes(spark, sql) else check_read(spark, sql)
    except ParseException as e:
        return Verdict(False, "read", f"not a statement: {e.getMessage()[:200]}")


def run_read(spark: SparkSession, sql: str, parameters: dict | None = None, caps: Caps = READ, log: list | None = None) -> tuple[list, bool]:
    """Rows of a checked read within the caps, and whether any were cut off. Stops fetching beyond them;
    a read that takes too long is cancelled."""
    verdict = check_read(spark, sql, caps)
    if not verdict.valid:
        raise PermissionError(verdict.error)
    rows, size, cut, began = [], 0, False, time.monotonic()
    tag = f"read-{id(rows)}"
    spark.addTag(tag)
    try:
        for row in spark.sql(sql, args=parameters or {}).limit(caps.rows + 1).toLocalIterator():
            size += len(str(row))
            if len(rows) == caps.rows or size > caps.bytes:
                cut = True
                break
            if time.monotonic() - began > caps.seconds:
                spark.interruptTag(tag)
                raise TimeoutError(f"more than {caps.seconds} seconds")
            rows.append(row)
    finally:
        spark.removeTag(tag)
    if log is not None:
        log.append((sql, len(rows), cut, time.monotonic() - began))
    return rows, cut


def run_write(spark: SparkSession, sql: str) -> DataFrame:
    verdict = check_write(spark, sql)
    if not verdict.valid:
        raise PermissionError(verdict.error)
    return spark.sql(sql)


def planned(entities: int, blocks: int) -> list[str]:
    """Steps worth trying after an observation."""
    return ["expand neighborhood"] * (entities > 0) + ["extract claims"] * (blocks > 0)


def judged(success, rows, depth, most):
    """struct(complete, recurse, confidence): nothing found .5; something .8; failed with depth left .4; else .3."""
    empty, deeper = success & (rows == 0), ~success & (depth < most)
    return F.struct(
        (~deeper).alias("complete"), deeper.alias("recurse"),
        F.when(empty, 0.5).when(success, 0.8).when(deeper, 0.4).otherwise(0.3).alias("confidence"),
    )


def explore(observe, expand, claim, most: int = 3) -> list[tuple[int, str, int]]:
    """Observe, plan, execute and judge, deeper while a level fails and depth is left: (depth, step, rows).

    observe() gives the numbers of entities and blocks; expand and claim run a step and give rows, or raise."""
    trace = []
    for depth in range(most + 1):
        entities, blocks = observe()
        success, rows = True, 0
        for step in planned(entities, blocks):
            try:
                n = (expand if step.startswith("expand") else claim)(depth)
                trace.append((depth, step, n))
                rows += n
            except (AnalysisException, TimeoutError, PermissionError):
                success = False
        if success or depth == most:
            break
    return trace
