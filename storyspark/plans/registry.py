"""The registered queries of the engine's own operators, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Model, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, build: Callable[[Model], DataFrame], sql: str | None = None) -> None:
    """Register build(model) under name; sql is the same over the model's tables, where SQL can say it."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return build(Model(spark, sf_dir))

    run.__name__ = name
    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = oracle(sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three clauses, one a phrase, over every note."""
    return QUERIES["qg_search"](spark, sf_dir)


query(
    "corpus_totals",
    lambda m: m.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars")),
    "SELECT lang, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY lang",
)
