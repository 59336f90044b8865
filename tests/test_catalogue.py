"""Every query against its SQL, over whole tables."""

import math
import re

import duckdb
import pytest
from sievework.plans import catalogue, model

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, sql, name):
    df = catalogue.queries()[name](spark, SF)
    names = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    cursor = sql.execute(catalogue.oracle_sql()[name])
    at = [[d[0] for d in cursor.description].index(c) for c in names]
    assert ours == sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)


def exchanges(spark, name):
    return catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString().count("Exchange")


def dealt(df):
    """Partitions that rows are dealt into by REPARTITION_BY_NUM."""
    return int(re.search(r"Exchange hashpartitioning\(.*, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())[1])


def test_dedupe_deals_its_rows_once(spark):
    assert exchanges(spark, "q_dedupe_location") == 1


def test_correlation_deals_its_rows_once(spark):
    assert exchanges(spark, "q_correlate_root_cause") == 1


@pytest.mark.parametrize("name", ["q_correlate_root_cause", "q_dedupe_location"])
def test_folds_sort_once(spark, name):
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("- Sort [") == 1 and "ObjectHashAggregate" not in plan


@pytest.mark.parametrize("name", ["q_correlate_root_cause", "q_dedupe_location"])
def test_folds_of_more_lines_have_more_tasks(spark, monkeypatch, name):
    run, in_order = catalogue.queries()[name], lambda df: sorted(df.collect(), key=repr)
    few = run(spark, SF)
    monkeypatch.setattr(model, "_LINES_A_TASK", 1000)
    many = run(spark, SF)
    assert dealt(few) == 4 and dealt(many) == math.ceil(spark.read.parquet(f"{SF}/lineitem.parquet").count() / 1000) > 4
    assert in_order(few) == in_order(many)


def test_external_merge_deals_its_rows_once(spark):
    assert exchanges(spark, "q_external_merge") == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(catalogue.oracle_sql()) <= set(__spark_entry__.queries())
