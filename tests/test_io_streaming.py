from __future__ import annotations

import datetime as dt
import json
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_indicators import make_bars
from tickerloom.operators import indicators
from tickerloom.sources import landing, sinks
from tickerloom.streaming import bars as sb
from tickerloom.streaming import jobs


def test_universe_csv(spark, tmp_path):
    p = tmp_path / "tickers.csv"
    p.write_text("﻿symbol,name,exchange\n aapl ,Apple , NASDAQ\n# note\n\n#x,y,z\nAAPL,Other,X\nsap.de,SAP,\n", encoding="utf-8")
    got = landing.universe(spark, str(p)).orderBy("ord").collect()
    assert [(r["symbol"], r["name"], r["exchange"]) for r in got] == [("AAPL", "Apple", "NASDAQ"), ("SAP.DE", "SAP", "")]


def test_json_documents(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"A": ["x", "y"], "B": []}))
    assert {r["symbol"]: r["tags"] for r in landing.tag_map(spark, str(tmp_path / "t.json")).collect()} == {"A": ["x", "y"], "B": []}
    (tmp_path / "bad.json").write_text("{oops")
    assert landing.tag_map(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "fx.json").write_text(json.dumps({"EUR": 1.1, "USD": 1.0, "_fetched_at": "2026-07-24T20:38:33+00:00"}))
    fx = {r["currency"]: (r["usd_rate"], r["fetched_at"]) for r in landing.fx_table(spark, str(tmp_path / "fx.json")).collect()}
    assert fx["EUR"][0] == 1.1 and fx["EUR"][1] is not None and "_fetched_at" not in fx
    (tmp_path / "h.json").write_text(json.dumps({"report_quarter": "2026-Q1", "holdings": {"X": {"name": "n", "stance": "LONG", "weight_pct": 1.5}}}))
    h = landing.holdings(spark, str(tmp_path / "h.json")).first()
    assert (h["symbol"], h["stance"], h["is_etf"]) == ("X", "LONG", False)


def test_holdings_report_xml(spark, tmp_path):
    item = ("<ns1:infoTable><ns1:nameOfIssuer>{0}</ns1:nameOfIssuer><ns1:titleOfClass>COM </ns1:titleOfClass><ns1:cusip>1</ns1:cusip>"
            "<ns1:value>{1}</ns1:value><ns1:shrsOrPrnAmt><ns1:sshPrnamt>7</ns1:sshPrnamt><ns1:sshPrnamtType>SH</ns1:sshPrnamtType>"
            "</ns1:shrsOrPrnAmt>{2}</ns1:infoTable>")
    body = item.format("A CO", 10, "<ns1:putCall>Put</ns1:putCall>") + item.format("A CO", 3, "")
    (tmp_path / "r.xml").write_text(f'<?xml version="1.0"?><ns1:informationTable xmlns:ns1="u">{body}</ns1:informationTable>')
    rows = landing.holdings_report(spark, str(tmp_path / "r.xml")).orderBy("value").collect()
    assert [(r["issuer"], r["value"], r["shares"], r["put_call"]) for r in rows] == [("A CO", 3, 7, None), ("A CO", 10, 7, "Put")]


def test_snapshot_sink_is_idempotent(spark, tmp_path):
    root = str(tmp_path / "snap")
    a = spark.createDataFrame([("A", 1), ("B", 2)], "symbol string, x int")
    sinks.write_snapshot(a, root, "20240101_0900")
    sinks.write_snapshot(a.withColumn("x", F.col("x") + 1), root, "20240102_0900")
    sinks.write_snapshot(a.withColumn("x", F.col("x") + 1), root, "20240102_0900")
    assert spark.read.parquet(f"{root}/history").count() == 4
    assert sorted(r["x"] for r in sinks.previous_snapshot(spark, root).collect()) == [2, 3]


def test_bars_table_prunes_by_year(spark, tmp_path):
    b = spark.createDataFrame(make_bars())
    sinks.write_bars(b, str(tmp_path / "bars"))
    got = landing.bars(spark, str(tmp_path / "bars"), since="2020-06-01")
    assert got.count() == b.where("ts >= '2020-06-01'").where("not isnan(close) or volume is not null").count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "PushedFilters: [IsNotNull(ts)" in plan


def test_running_indicators_equal_the_folds(spark, tmp_path):
    f = make_bars()
    f = f[f.symbol.isin(["A", "D", "UP"])]
    for i, (lo, hi) in enumerate(((0, 50), (50, 120), (120, 400))):  # three arrivals in time order
        part = f[f.groupby("symbol").cumcount().between(lo, hi - 1)]
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p{i}"))
    schema = spark.createDataFrame(f).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    from tickerloom.streaming.indicators import running_indicators
    out = jobs.run_to_table(running_indicators(stream), "test")
    last = out.groupBy("symbol").agg(F.max_by(F.struct("macd", "macd_signal", "rsi", "psar_bull"), "ts").alias("r")).select("symbol", "r.*")
    got = last.toPandas().set_index("symbol").sort_index()
    want = indicators.folded_features(indicators.clean_bars(spark.createDataFrame(f))).toPandas().set_index("symbol").sort_index()
    for c in ("macd", "macd_signal", "rsi"):
        pd.testing.assert_series_equal(got[c].astype(float), want[c].astype(float), check_names=False, rtol=1e-9)
    assert got.psar_bull.tolist() == want.psar_bull.tolist()
    assert out.count() == len(f)


def _ticks(spark, rows):
    return spark.createDataFrame([(i, dt.datetime.fromisoformat(t), s, p, 1.0) for i, t, s, p in rows],
                                 "event_id long, ts timestamp, symbol string, price double, volume double")


def test_stream_bars_equal_batch_bars_and_drop_late_ticks(spark, tmp_path):
    src = str(tmp_path / "ticks")
    batches = [
        [(1, "2024-01-01T09:00:00", "A", 10.0), (2, "2024-01-01T09:20:00", "A", 12.0), (3, "2024-01-01T09:29:59", "A", 11.0)],
        [(4, "2024-01-01T14:00:00", "A", 20.0)],
        [(5, "2024-01-01T09:10:00", "A", 99.0), (6, "2024-01-01T20:00:00", "A", 21.0)]]
    for i, rows in enumerate(batches):
        _ticks(spark, rows).coalesce(1).write.parquet(f"{src}/b{i}")
    checkpoint, table = str(tmp_path / "cp"), str(tmp_path / "out")
    schema = _ticks(spark, batches[0]).schema
    for i in range(3):  # one arrival per run, so the watermark is known before the late tick
        s = spark.readStream.schema(schema).parquet(f"{src}/b[0-{i}]")
        (sb.ohlcv(s).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True)
         .start(table).awaitTermination())
    first = spark.read.parquet(table).orderBy("ts").first()
    assert (first["open"], first["high"], first["low"], first["close"], first["volume"]) == (10.0, 12.0, 10.0, 11.0, 3.0)


def test_alert_rules(spark):
    b = spark.createDataFrame([("A", 100.0, -8.0), ("B", 180.0, None), ("C", 100.0, -7.9)], "symbol string, volume double, ret_5d double")
    prof = spark.createDataFrame([(s, 100.0) for s in "ABC"], "symbol string, vol_avg20 double")
    got = {r["symbol"]: r["alert"] for r in sb.alerts(b.withColumn("ts", F.current_date()), prof).collect()}
    assert got == {"A": "drop", "B": "volume"}


def test_work_dir_is_refused_off_local_mode():
    from types import SimpleNamespace

    from tickerloom.session import work_dir
    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        work_dir(far)


def test_stage_tables_of_equal_last_folder(spark, tmp_path):
    from tickerloom.plans.stages import Stages
    got = []
    for part in ("x", "y"):
        got.append(Stages(spark, str(tmp_path / part / "sf")).table("t", lambda p=part: spark.createDataFrame([(p,)], "v string")))
    assert [g.first().v for g in got] == ["x", "y"]
