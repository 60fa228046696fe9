"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from tarnfield import queries as base

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return v if isinstance(v, (int, str)) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(base.queries()))
def test_query(spark, sf_dir, duck, name):
    df = base.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    if name not in base.oracle_sql():
        assert got
        return
    r = duck.execute(base.oracle_sql()[name])
    own = [c[0] for c in r.description]
    assert sorted(own) == cols
    want = sorted((tuple(plain(row[own.index(c)]) for c in cols) for row in r.fetchall()), key=repr)
    assert got == want


def test_search_over_documents_is_the_plain_functions(spark, sf_dir):
    from tarnfield.functions.locales import locale

    got = sorted(r["doc_id"] for r in base.queries()["search_documents"](spark, sf_dir).collect())
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted(r["doc_id"] for r in rows if {"the", "and"} <= set(locale("gb").words(r["text"], True)))


def test_entry(spark):
    assert entry.entry(spark).columns == ["p_partkey", "p_brand", "p_size", "p_retailprice"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
