"""Tick streams: de-duplication, OHLCV bars, mention counts and attention sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.core import div, num, rnd

C = F.col
LEAST_MENTIONS = 10  # in a window that counts as a surge


def drop_duplicate_ticks(ticks: DataFrame, keys: Sequence[str] = ("event_id",), delay: str = "2 hours") -> DataFrame:
    """Removes redelivered ticks; state is dropped once the watermark passes."""
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def ohlcv(ticks: DataFrame, width: str = "30 minutes", delay: str = "2 hours", order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """symbol, price, volume ticks -> bars. Late ticks beyond the watermark are dropped."""
    at = F.struct(*order)
    g = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))
    return g.select("symbol", C("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def mention_counts(mentions: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Mentions per symbol and hour: one state row for each, whatever the windows built from them."""
    g = mentions.withWatermark("ts", delay).groupBy("symbol", F.window("ts", "1 hour").alias("w"))
    return g.count().select("symbol", C("w.start").alias("hour"), C("count").alias("mentions"))


def near_surges(hourly: DataFrame, minimum: int = LEAST_MENTIONS, hours: int = 24) -> DataFrame:
    """Batch step: the hourly rows that a window of at least `minimum` mentions, or the window before it, can hold.

    Such a window's first hour with mentions has `minimum` from there on. All rows of the window and of the one before it stay, so
    their sums are whole; a window that loses rows stays below `minimum`. A symbol's hours are bounded by the calendar.
    """
    at = Window.partitionBy("symbol").orderBy("_at")
    span = lambda first, last: at.rangeBetween(first * 3600, last * 3600)
    ahead = hourly.withColumn("_at", F.unix_timestamp("hour")).withColumn("_ahead", F.sum("mentions").over(span(0, hours - 1)))
    return ahead.withColumn("_most", F.max("_ahead").over(span(1 - hours, 2 * hours - 1))).where(C("_most") >= minimum).select(*hourly.columns)


def rolling_mentions(hourly: DataFrame, closed: DataFrame, hours: int = 24) -> DataFrame:
    """Batch step: mentions in every window of `hours` that starts on an hour and ends by `closed` (one row: until)."""
    starts = F.sequence(C("hour") - F.expr(f"interval {hours - 1} hours"), C("hour"), F.expr("interval 1 hour"))
    each = hourly.select("symbol", F.explode(starts).alias("start"), "mentions")
    sums = each.groupBy("symbol", "start").agg(F.sum("mentions").alias("mentions")).crossJoin(closed.agg(F.max("until").alias("until")))
    return sums.where(C("start") + F.expr(f"interval {hours} hours") <= C("until")).drop("until")


def mention_surges(counts: DataFrame, factor: float = 1.5, minimum: int = LEAST_MENTIONS) -> DataFrame:
    """Windows whose mentions are at least `factor` times those of the 24 hours before."""
    before = counts.select("symbol", (C("start") + F.expr("interval 24 hours")).alias("start"),
                           C("mentions").alias("mentions_before"))
    j = counts.join(before, ["symbol", "start"])
    return j.where((C("mentions") >= num(factor) * C("mentions_before")) & (C("mentions") >= minimum)).withColumn(
        "change_pct", rnd((div("mentions", "mentions_before") - num(1)) * num(100), 0))


def attention_sessions(mentions: DataFrame, gap: str = "6 hours", delay: str = "2 hours") -> DataFrame:
    """Bursts of mentions per symbol separated by at least `gap`."""
    g = mentions.withWatermark("ts", delay).groupBy("symbol", F.session_window("ts", gap).alias("w"))
    return g.count().select("symbol", C("w.start").alias("start"), C("w.end").alias("end"), C("count").alias("mentions"))


def alerts(returns: DataFrame, profile: DataFrame) -> DataFrame:
    """Steep falls and volume spikes: symbol, ts, ret_5d, volume (five_day_returns) against a static profile.

    profile(symbol, vol_avg20): the stream-static join is left to Spark, which
    broadcasts the profile only while it is small.
    """
    j = returns.join(profile, "symbol")
    rvol, ret = rnd(div("volume", "vol_avg20"), 4), rnd("ret_5d", 4)
    kind = F.when(ret <= -8, F.lit("drop")).when(rvol >= 1.8, F.lit("volume"))
    return (j.select("symbol", "ts", rvol.alias("rvol"), ret.alias("ret_5d"), kind.alias("alert"))
            .where("alert is not null"))
