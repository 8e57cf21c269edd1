"""Ties of rounding are those of the SQL: the shortest decimal form counts with 16 decimals."""

from __future__ import annotations

import math
import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from oracle.base import r
from tickerloom.functions.core import num, rnd
from tickerloom.operators import outlook


def test_doubles_beside_a_tie_round_like_the_sql(spark):
    rng = random.Random(4)
    ties = [sign * k / 10**d for d in (2, 3, 5, 7) for k in [5, 15, 25, 35, 45, *(10 * rng.randrange(5000) + 5 for _ in range(60))] for sign in (1, -1)]
    values = [x for t in ties for x in (t, math.nextafter(t, 9e9), math.nextafter(t, -9e9), t * (1 + 1e-15), t * (1 - 1e-15), t * (1 + 1e-13))]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-12, 9) for _ in range(500)] + [0.0, 1e-300, 1e20]
    x = pd.DataFrame({"i": range(len(values)), "x": values})
    scales = (1, 2, 4, 6)
    got = spark.createDataFrame(x).select("i", *[rnd("x", n).alias(f"r{n}") for n in scales]).orderBy("i").toPandas()
    con = duckdb.connect()
    con.register("given", x)
    want = con.execute(f"SELECT i, {', '.join(f'{r(chr(120), n)} AS r{n}' for n in scales)} FROM given ORDER BY i").fetchdf()
    assert sum(0 < abs(v) < 0.5 for v in values) > 1000
    for n in scales:
        assert got[f"r{n}"].tolist() == want[f"r{n}"].tolist()


def test_a_month_of_a_slow_drift_is_a_tie(spark):
    # drifts of 0.6 and 1.8 percent a year; a twelfth of them is 0.05 and 0.15 but for the last bit
    rows = spark.createDataFrame([(x,) for x in (0.6, 0.6000000000000001, 1.8, 1.7999999999999998)], "signal double")
    month = rows.select("signal", (F.col("signal") * (num(21) / num(252))).alias("center"))
    got = {v.signal: v.c for v in month.select("signal", rnd("center", 1).alias("c")).collect()}
    assert got == {0.6: 0.0, 0.6000000000000001: 0.0, 1.8: 0.2, 1.7999999999999998: 0.2}


COLUMNS = ("price double, vol_daily double, atr_pct double, daytrade_score double, daytrade_direction string, investment_score double, "
           "analyst_upside_pct double, analyst_n int")


def projected(spark, cases):
    """Rows of (investment score, analysts' upside) with their projections."""
    rows = [(20.0, 0.01, 2.0, 0.0, "NEUTRAL", inv, up, 1) for inv, up in cases]
    return outlook.projections(spark.createDataFrame(rows, COLUMNS))


def test_projection_takes_the_tie(spark):
    # the center of one month is 0.05 or 0.15 but for the last bits
    cases = {(30.8, 11.7): 0.2, (31.6, 8.4): 0.0, (30.0, 3.0): -0.2, (33.2, 7.8): 0.0}
    got = projected(spark, cases).collect()
    assert {(v.investment_score, v.analyst_upside_pct): v.projection_long[0].center_pct for v in got} == cases


def test_upside_takes_the_tie(spark):
    # one analyst only, so the upside is the projection of twelve months: 0.05 but for the last bits
    cases = {(37.0, 5.0): 0.0, (41.4, 3.1): 0.0, (43.0, 2.5): 0.0, (45.0, 2.0): 0.0, (49.0, 0.5): 0.0}
    got = outlook.upside(projected(spark, cases)).collect()
    assert {(v.investment_score, v.analyst_upside_pct): v.upside_pct for v in got} == cases
