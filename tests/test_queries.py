"""Every registered query with SQL against DuckDB on the smallest tables."""

import inspect
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from veldrin import catalogue
from veldrin.operators.learning import train_heads

FOLDER = Path("/root/testdata/sf0.001")
QUERIES, SQL = {n: q for n, q in __spark_entry__.queries().items() if n in catalogue.QUERIES}, catalogue.ORACLE_SQL


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return tuple(sorted((k, plain(x)) for k, x in v.items())) if isinstance(v, dict) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def test_names():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(SQL)))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(FOLDER))
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == sorted(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in found.fetchall())


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["linear_head", "scored_cases", "export_round_trip", "p4_nodes", "p4_entities", "canonical_leakage", "canonical_repeats"])
def test_query_without_sql_runs(spark, name):
    rows = QUERIES[name](spark, str(FOLDER)).count()
    assert rows == 0 if name == "export_round_trip" else rows > 0


def test_linear_head_runs_the_whole_search():
    asked = {n: p.default for n, p in inspect.signature(train_heads).parameters.items()}
    assert asked["epochs"] == 120 and len(asked["rates"]) == len(asked["penalties"]) == len(asked["controls"]) == 2
