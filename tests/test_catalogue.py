"""Every query of the engine against its oracle SQL in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_its_oracle(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE) - {"louvain_communities"}))
def test_query_without_oracle_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_ann_recall(spark):
    pairs = lambda q: {(r.query_id, r.doc_id) for r in catalogue.QUERIES[q](spark, "/root/testdata/sf0.1").collect()}
    exact, near = pairs("vector_topk"), pairs("ann_topk")
    assert len(exact & near) >= 0.9 * len(exact)
