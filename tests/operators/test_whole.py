"""Queries over documents read every one; those whose rules are English, every English one."""

import duckdb
import pytest

from storyspark.plans import metrics, phrases
from storyspark.plans.model import Model
from storyspark.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.01"


def ids(where=""):
    return {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{FOLDER}/documents.parquet' {where}").fetchall()}


@pytest.mark.parametrize("name", ["met_words", "met_paragraphs", "met_consecutive", "met_text", "met_analyze", "nlp_tokenize", "nlp_sentences", "nlp_paragraphs", "nlp_cst"])
def test_what_knows_no_language_reads_every_document(spark, name):
    assert {r.id for r in QUERIES[name](spark, FOLDER).select("id").distinct().collect()} == ids()


def test_english_is_asked_for_where_the_rules_are_english(spark):
    for rows in (phrases.sample, metrics.english):
        assert {r.id for r in rows(Model(spark, FOLDER)).select("id").collect()} == ids("WHERE lang = 'en'")
    assert {r.id for r in QUERIES["met_reading_level"](spark, FOLDER).select("id").collect()} == ids("WHERE lang = 'en'")


def test_spans_hold_every_line(spark):
    m = Model(spark, FOLDER)
    assert m.spans.count() == m.lineitem.count()
    assert m.memories.where("length(content) > 40").count() > 0
