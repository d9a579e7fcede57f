"""Every registered query against its DuckDB equivalent on the smallest tables; plans without nested loops over facts."""

import math
import pathlib
import re

import duckdb
import pytest

from ledgerloom import plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "NULL"
        return f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__name__ == "Decimal" else str(x)

    return sorted(columns), sorted(tuple(one(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    if name in plans.ORACLE_SQL:
        result = duck.execute(plans.ORACLE_SQL[name])
        columns = [d[0] for d in result.description]
        assert plain(rows, df.columns) == plain(result.fetchall(), columns)


@pytest.mark.parametrize("name", ["res01_tiers", "str02_matching_names", "res03_duplicate_groups", "pre04_unseen_urls", "qry01_deals_page", "enr13_crossref_dates"])
def test_no_nested_loops(spark, name):
    plan = plans.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_date_votes_of_every_deal(spark, duck):
    from ledgerloom.plans.views import with_views

    deals = duck.execute(with_views("SELECT DISTINCT deal_id FROM articles WHERE published_date IS NOT NULL")).fetchall()
    assert {r["deal_id"] for r in plans.QUERIES["enr01_date_votes"](spark, FOLDER).collect()} == {d for d, in deals}
    assert max(d for d, in deals) >= 300


@pytest.mark.parametrize("name", ["val03_judged_articles", "cls01_crypto", "cls02_consumer_fintech", "cls03_consumer_ai", "cls04_grounded_category"])
def test_articles_are_lowered_once(spark, name):
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        plan = plans.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert len(re.findall(r"lower\((?:coalesce\()?(?:text#|concat\(CASE)", plan)) == 1
