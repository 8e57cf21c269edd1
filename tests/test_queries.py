"""Registered queries against their SQL on the smallest data, plus plan checks."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tickerloom.plans.queries import QUERIES
from tickerloom.plans.stages import Stages
from tools.compare import TABLES, compare

SF = "/root/testdata/sf0.001"
SAMPLE = ("universe_load", "bars_daily", "fundamentals_load", "statements_wide", "ind_sma", "ind_macd", "ind_adx", "ind_psar",
          "score_daytrade", "score_longterm", "magic_formula", "piotroski", "news_sentiment", "macro_context", "snapshot",
          "entry_score", "trade_plan", "projection", "portfolio_trades", "equity_vs_benchmark", "stream_sessions")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    sql = entry.oracle_sql()
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(sql) and set(sql) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert compare(got, con.execute(entry.oracle_sql()[name]).fetchdf()) == "ok"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_features_plan(spark):
    from tickerloom.operators import indicators
    b = indicators.clean_bars(Stages(spark, SF).bars())
    window = plan_of(indicators.tail_features(b))
    assert window.count("Exchange hashpartitioning") == 1  # one shuffle by symbol serves every window
    assert "WindowGroupLimit" in window and "Partial" in window  # rows are cut before that shuffle
    assert "PythonUDF" not in window and "BatchEvalPython" not in window
    pruned = plan_of(indicators.folded_features(b).select("symbol", "rsi"))
    assert "pdi" not in pruned and "peak" not in pruned  # folds nobody asked for are not evaluated


def test_no_single_task_rank(spark):
    from tickerloom.operators import reports
    df = spark.range(100).selectExpr("id ord", "cast(id as double) ret_60d")
    plan = plan_of(reports.rs_rating(df).select("ord"))
    # only the bin table (at most 4096 rows) is windowed over a constant key
    assert "hashpartitioning(_v" in plan or "hashpartitioning(_bin" in plan
    assert "Exchange SinglePartition" not in plan
