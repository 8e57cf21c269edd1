"""Sums whose last bits decide a rule are added in the order of the input's rows."""

from __future__ import annotations

import os
import random
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq

from tickerloom.sources import fixtures as fx


def test_yearly_revenue_is_added_in_row_order(spark, tmp_path):
    rng = random.Random(3)
    folder = tmp_path / "lineitem.parquet"
    os.makedirs(folder)
    want: dict[tuple[int, int], float] = {}
    for part in range(8):
        rows = []
        for _ in range(1500):
            supplier, year, price = rng.randrange(40), 1998 + rng.randrange(2), round(rng.uniform(900, 100000), 2)
            want[supplier, year] = want.get((supplier, year), 0.0) + price
            rows.append({"l_suppkey": supplier, "l_shipdate": datetime(year, 5, 1), "l_extendedprice": price, "l_discount": 0.05, "l_tax": 0.02,
                         "l_returnflag": "N", "l_quantity": 1.0})
        pq.write_table(pa.Table.from_pylist(rows), folder / f"part-{part}.parquet", row_group_size=500)
    got = fx._yearly(spark, str(tmp_path)).select("suppkey", "yr", "revenue", "shares").collect()
    assert {(r.suppkey, r.yr): r.revenue for r in got} == want
    assert sum(r.shares for r in got) == 12000
