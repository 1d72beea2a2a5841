"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from folioscope.plans import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        path = f"{DIR}/{name}/*.parquet" if os.path.isdir(f"{DIR}/{name}") else f"{DIR}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def plain(row):
    return repr(tuple(round(float(x), 9) if isinstance(x, float) else x for x in row))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_like_sql(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    want = duck.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(plain(r) for r in df.select(*cols).collect()) == sorted(plain(r) for r in want.fetchall())


def test_flagship(spark):
    assert registry.flagship(spark, DIR).count() > 0


def test_long_urls_keep_their_rest(spark, tmp_path):
    url = "https://host.example/" + "a" * 20_000 + "Z"
    spark.createDataFrame([(1, url, "")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert [r.url for r in registry.queries()["url_norm"](spark, str(tmp_path)).collect()] == [url]
