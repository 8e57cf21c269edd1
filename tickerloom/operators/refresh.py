"""Incremental maintenance: stale keys, bounded refresh, upsert, carry-forward, calendar lookups."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.core import num

C = F.col
# The columns carried over from the previous snapshot on a light run.
CARRIED = ("news_score", "news_sentiment", "news_n", "news", "news_mode", "news_override_reason", "next_earnings",
           "earnings_in_days", "intraday_note")


def stale_keys(universe: DataFrame, cache: DataFrame, as_of: str, max_age: str) -> DataFrame:
    """Symbols whose entry is missing, has an unreadable timestamp, or is older than `max_age` (interval text)."""
    seen = cache.select("symbol", F.lit(True).alias("_hit"), F.try_to_timestamp("fetched_at").alias("_at"))
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"interval {max_age}")
    j = universe.join(seen, "symbol", "left")
    reason = (F.when(C("_hit").isNull(), F.lit("missing")).when(C("_at").isNull(), F.lit("unreadable"))
              .when(C("_at") < cutoff, F.lit("old")))
    return j.withColumn("stale_reason", reason).where("stale_reason is not null").drop("_hit", "_at")


def refresh_queue(stale: DataFrame, scores: DataFrame, limit: int, score: str = "investment_score") -> DataFrame:
    """The first `limit` stale symbols, best score first, input order breaking ties."""
    j = stale.join(scores.select("symbol", score), "symbol", "left")
    return j.orderBy(F.coalesce(C(score), num(0)).desc(), "ord").limit(limit)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Rows of `new` replace rows of `old` with the same key; one aggregation, no join."""
    cols = [c for c in old.columns if c not in keys]
    tagged = old.select(*keys, F.struct(*cols).alias("_r"), F.lit(0).alias("_v")).unionByName(
        new.select(*keys, F.struct(*cols).alias("_r"), F.lit(1).alias("_v")))
    return tagged.groupBy(*keys).agg(F.max_by("_r", "_v").alias("_r")).select(*keys, "_r.*").select(*old.columns)


def carry_forward(rows: DataFrame, previous: DataFrame, columns: Sequence[str] = CARRIED) -> DataFrame:
    """Takes `columns` from the previous snapshot for every symbol it holds; other symbols keep their own."""
    have = [c for c in columns if c in previous.columns]
    prev = previous.select("symbol", F.lit(True).alias("_hit"), *[C(c).alias(f"_p_{c}") for c in have])
    j = rows.join(prev, "symbol", "left")

    def value(c: str) -> Column:
        own = C(c) if c in rows.columns else F.lit(None)
        return F.when(C("_hit"), C(f"_p_{c}")).otherwise(own).alias(c)

    return j.select(*[c for c in rows.columns if c not in have], *[value(c) for c in have])


def next_earnings(dates: DataFrame, as_of: date) -> DataFrame:
    """Per symbol: the next date on or after as_of, else the latest past one, and the days until it."""
    today = F.lit(as_of.isoformat()).cast("date")
    g = dates.groupBy("symbol").agg(
        F.coalesce(F.min(F.when(C("d") >= today, C("d"))), F.max("d")).alias("next_earnings"))
    return g.withColumn("earnings_in_days", F.datediff("next_earnings", today))


def coverage(universe: DataFrame, bars: DataFrame) -> DataFrame:
    """Every universe symbol with its number of closes, last close and ok / no_data status."""
    g = bars.where("close is not null").groupBy("symbol").agg(
        F.count("*").alias("n_closes"), F.max_by("close", "ts").alias("last_close"))
    return universe.join(g, "symbol", "left").select(
        "symbol", "name", F.coalesce("n_closes", F.lit(0)).alias("n_closes"), "last_close",
        F.when(C("n_closes") > 0, F.lit("ok")).otherwise(F.lit("no_data")).alias("status"))
