import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from bookloom.plans import queries as plans

SF = "/root/testdata/sf0.001"


def cells(frame, columns):
    out = []
    for row in frame[columns].astype(object).itertuples(index=False, name=None):
        values = [None if v is None or pd.isna(v) else v.item() if hasattr(v, "item") else v for v in row]
        out.append(repr([round(float(v), 5) if not isinstance(v, (str, bool)) and v is not None and not hasattr(v, "year") else v for v in values]))
    return sorted(out)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = plans.queries()[name](spark, SF).toPandas()
    want = duck.sql(plans.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert cells(got, columns) == cells(want, columns)


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["id", "pos", "total", "query_hash"] and rows.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_blocks(spark):
    rows = plans.queries()["page_blocks"](spark, SF)
    assert rows.where("text = '' OR text LIKE '%<script%'").count() == 0
    assert rows.groupBy("id", "anchor").count().where("count > 1").count() == 0


def test_page_plan_sorts_no_whole_table(spark):
    plan = plans.queries()["search_books_ranked_page"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan


def test_matches_are_worked_out_once(spark):
    rows = plans.queries()["search_books_ranked_page"](spark, SF)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("part.parquet") == 1 and "ReusedExchange" in plan
