"""Window frames over (symbol, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("ts")


def trailing(n: int) -> WindowSpec:
    return by_symbol().rowsBetween(-(n - 1), 0)


def rolling(agg: Column, present: Column, n: int) -> Column:
    """Window aggregate that needs n non-NULL inputs, like a full rolling window."""
    return F.when(F.count(present).over(trailing(n)) == n, agg.over(trailing(n)))


def last_rows(df: DataFrame, n: int) -> DataFrame:
    """The newest n rows per symbol.

    row_number() <= n becomes a group limit that runs before the shuffle, so only
    n rows per symbol travel, however long the history is.
    """
    newest = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return df.withColumn("_rr", F.row_number().over(newest)).where(F.col("_rr") <= n).drop("_rr")
