"""Every registered query against its SQL oracle, at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as spark_entry
from check_oracle import TABLES, compare
from conftest import SMALL
from tidemark.operators.sizing import Sizing
from tidemark.plans import documents, inputs, registry


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_oracle(spark, con, name):
    assert name in registry.ORACLE and name in spark_entry.queries()
    verdict = compare(spark, con, name, SMALL)
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 12


def test_published_counts_of_the_derived_log(spark):
    judged = documents.classified(spark, SMALL)
    counts = {(r["result"]): r["count"] for r in judged.groupBy("result").count().collect()}
    assert counts == {"applied": 241, "superseded": 818}
    docs = documents.documents_arrival_order(spark, SMALL)
    assert docs.filter("not has_props").count() == 4 and docs.filter("deleted").count() == 3


def test_chunked_form_gives_the_same_documents(spark, monkeypatch):
    want = sorted(documents.documents_arrival_order(spark, SMALL).collect())
    monkeypatch.setattr(inputs, "size", lambda *_: Sizing(rows_per_chunk=100))
    assert sorted(documents.documents_arrival_order(spark, SMALL).collect()) == want


def test_session_zone_does_not_matter(spark):
    want = sorted(documents.commit_bounds(spark, SMALL).collect())
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert sorted(documents.commit_bounds(spark, SMALL).collect()) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
