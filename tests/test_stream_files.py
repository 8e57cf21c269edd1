"""The snapshot stream's files keep their size while the input grows."""

from __future__ import annotations

import pandas as pd

from tickerloom.streaming import jobs


def test_snapshot_stream_is_cut_into_files_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "ROWS_A_FILE", 100, raising=False)
    monkeypatch.setattr(jobs, "work_dir", lambda _: str(tmp_path))
    days = pd.date_range("2001-01-01", periods=40).date
    f = pd.DataFrame([{"symbol": f"S{k}", "ts": d, "close": float(i * 100 + k)} for i, d in enumerate(days) for k in range(30)])
    side = spark.createDataFrame([(f"S{k}", f"S{k}.DE") for k in range(30)], "symbol string, listing string")
    got = {r.symbol: r.close for r in jobs.replay_snapshot(spark, spark.createDataFrame(f), side).collect()}
    assert got == {f"S{k}": float(3900 + k) for k in range(30)}
    sizes = [len(pd.read_parquet(p)) for p in (tmp_path / "tickerloom" / "streams").glob("latest-*-in/*.parquet")]
    assert sum(sizes) == 1200 and max(sizes) < 250
