"""The finite windows of the newest bar are slices of the symbol's array: its bars are sorted once and never aggregated again."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from tickerloom.operators import indicators


def test_latest_features_read_slices_of_one_array(spark, tmp_path):
    rng, rows = random.Random(5), []
    for n in (29, 30, 38, 39, 40, 60, 61, 62, 171, 172, 199, 200, 222, 252, 253, 281, 300):
        for gaps in (0.0, 0.1):
            price = 50.0
            for i in range(n):
                price *= math.exp(rng.choice((-0.02, 0.0, 0.01)))  # equal extremes occur
                miss = lambda x: None if i < n - 1 and rng.random() < gaps else x
                rows.append((f"S{n}-{gaps}", i, price, miss(price * 1.01), miss(price * 0.99), miss(price), miss(float(rng.randint(0, 9)))))
    b = spark.createDataFrame(rows, "symbol string, i int, open double, high double, low double, close double, volume double")
    b.withColumn("ts", F.date_add(F.lit("1999-01-01").cast("date"), F.col("i"))).drop("i").write.parquet(str(tmp_path / "b"))
    bars = spark.read.parquet(str(tmp_path / "b"))
    latest = indicators.latest_features(bars)
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and "Generate" not in plan and "stddev_samp" not in plan
    want = {r["symbol"]: r.asDict() for r in indicators.latest_window_features(bars).collect()}
    got = {r["symbol"]: r.asDict() for r in latest.collect()}
    assert set(got) == set(want) and len(got) == 32
    for sym, r in want.items():
        for k, v in r.items():
            x = got[sym][k]
            assert x == v or (isinstance(v, float) and x is not None and math.isclose(x, v, rel_tol=1e-12, abs_tol=1e-12)), (sym, k, x, v)
