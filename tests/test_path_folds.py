"""The path folds evaluate each test of a bar once, without arrays made to bind values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.functions import folds


def test_folds_bind_few_values_a_bar(spark):
    rows = [([(9.0, 8.0, 8.5), (10.0, 9.0, 9.5), (None, 7.0, 9.0), (9.0, 6.0, 6.5), (8.0, 7.0, None), (12.0, 9.0, 11.0)],)]
    bars = spark.createDataFrame(rows, "p array<struct<high:double,low:double,close:double>>")
    text = lambda c: bars.select(c)._jdf.queryExecution().analyzed().toString()
    assert text(folds.parabolic_sar(F.col("p"))).count("transform(") == 0
    assert text(folds.supertrend(F.col("p"))).count("transform(") <= 4
    # up to its i-th bar: rises, turns at the third low (7 < 8.1) though its high is missing, has no close, turns again at the last high
    sar = [bars.select(folds.parabolic_sar(F.slice("p", 1, i))).first()[0] for i in range(1, 7)]
    assert sar == [True, True, False, False, None, True]
