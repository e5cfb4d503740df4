"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from loamgrid.plans import catalogue
from loamgrid.plans.dialect import TABLES, expand

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v + 0.0:.9g}")
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    cur = duck.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    theirs = sorted(repr(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols)) for r in cur.fetchall())
    assert mine == theirs


def test_result_does_not_depend_on_partitions(spark):
    q = catalogue.queries()["round_robin_budget"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, q(spark, DIR).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_macros_nest_and_keep_quoted_brackets():
    assert expand("@sha(@join(@words(t)))", 1) == "sha256(array_to_string(regexp_extract_all(lower(t), '[a-z0-9]+'), ' '))"
    assert expand("@rlike(x, 'a(b')", 0) == "x RLIKE 'a(b'"


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_factorials(duck):
    for n in (0, 1, 5, 170, 10**9):
        got = duck.execute(f"SELECT {expand(f'@lnfact({n}e0)', 1)}").fetchall()[0][0]
        assert math.isclose(got, math.lgamma(n + 1), rel_tol=1e-12, abs_tol=1e-9)
