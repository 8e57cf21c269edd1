"""Only the bars of the ten most traded symbols are numbered for the open positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.plans.stages import Stages
from tickerloom.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_positions_number_the_bars_of_ten_symbols(spark):
    b = Stages(spark, SF).bars()
    df = fx.positions(spark, SF, b)
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    window = next(i for i, line in enumerate(plan) if "Window [" in line)
    depth = len(plan[window]) - len(plan[window].lstrip(" :+-"))
    below = [x for x in plan[window + 1:] if len(x) - len(x.lstrip(" :+-")) > depth]
    assert any("GlobalLimit 10" in x for x in below)
    got = {r["symbol"]: r for r in df.collect()}
    bars = b.toPandas().sort_values("ts")
    most = bars.groupby("symbol").volume.sum().reset_index().sort_values(["volume", "symbol"], ascending=[False, True]).head(10).symbol
    assert set(got) == set(most)
    for s in most:
        c = bars[bars.symbol == s].close.tolist()[::-1]
        if len(c) > 60:
            assert got[s]["entry_price"] == round(c[60], 4) and got[s]["peak_price"] == round(max(c[10:61]), 4)
