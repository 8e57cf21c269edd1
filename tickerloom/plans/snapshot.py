"""The full screen: bars and side tables in, one wide row per symbol out.

Order matters: G1/G2 scores see raw features, everything later sees 4-dp values and
USD prices. Ranks are checkpointed while the plan is built (see functions.ranks); all else is lazy, and a
query that selects a few columns computes only those.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.core import num
from tickerloom.operators import (
    fundamentals, holders, indicators, intraday, lookups, macro, news, outlook, rating, refresh, reports, scores,
)

C = F.col


@dataclass
class Inputs:
    """Source tables of a run. `universe` needs symbol, listing, name and a unique integer ord."""

    universe: DataFrame
    bars: DataFrame
    fundamentals: DataFrame
    statements: DataFrame
    fx_quotes: DataFrame
    headlines: DataFrame
    earnings: DataFrame
    social: DataFrame
    holdings: DataFrame
    themes: DataFrame
    experts: DataFrame
    macro_quotes: DataFrame
    bars30: DataFrame
    as_of: date
    positive_words: Sequence[str] = tuple(news.POSITIVE)
    negative_words: Sequence[str] = tuple(news.NEGATIVE)
    overrides: DataFrame | None = None
    previous: DataFrame | None = None
    light: bool = False


def scored_features(bars: DataFrame) -> DataFrame:
    """Latest features with the raw-feature scores, then rounded to 4 dp."""
    raw = indicators.latest_features(indicators.clean_bars(bars))
    raw = scores.longterm(scores.daytrade(raw))
    raw = raw.withColumn("daily_return_pct", C("daily_return") * num(100))
    return indicators.rounded(raw, keep=("daytrade_score", "longterm_score"))


def technical(inp: Inputs) -> DataFrame:
    """Features from bars up to as_of; the cut reaches the scan as a filter."""
    u = inp.universe.select("symbol", "listing", "name", "ord")
    return scored_features(inp.bars.where(C("ts") <= F.lit(inp.as_of.isoformat()).cast("date"))).join(u, "symbol")


def known_headlines(inp: Inputs) -> DataFrame:
    """Headlines published by as_of; one without a readable time counts as known."""
    at = F.try_to_timestamp("published")
    return inp.headlines.where(at.isNull() | (at < F.lit(inp.as_of.isoformat()).cast("date") + F.expr("interval 1 day")))


def run_row(rows: DataFrame, inp: Inputs, context: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """One row for the run: universe size, symbols analysed, market news (carried over on a light run) and the macro state."""
    counts = inp.universe.agg(F.count("*").alias("universe_size")).crossJoin(rows.agg(F.count("*").alias("analyzed")))
    if inp.light and previous is not None:
        market = previous.select("market_sentiment", "market_label", C("market_n").alias("n"))
    else:
        market = news.market_sentiment(known_headlines(inp), inp.positive_words, inp.negative_words).select("market_sentiment", "market_label", "n")
    macro_row = context.select("vix", "risk_regime", "rate_dir", "fomc_next", "fomc_in_days")
    return counts.crossJoin(market.withColumnRenamed("n", "market_n")).crossJoin(macro_row).withColumn("as_of", F.lit(inp.as_of.isoformat()).cast("date"))


def with_fundamentals(rows: DataFrame, inp: Inputs) -> DataFrame:
    f = fundamentals.scores(inp.fundamentals)
    magic = fundamentals.magic_formula(inp.fundamentals.join(inp.universe.select("symbol", "ord"), "symbol"))
    r = rows.join(f, "symbol", "left").join(magic, "symbol", "left")
    r = fundamentals.investment(fundamentals.valuation(r))
    r = r.withColumnRenamed("rec_key", "analyst_rating").withColumn("currency", lookups.currency_of("listing"))
    rates = lookups.fx_rates(inp.universe.select(lookups.currency_of("listing").alias("currency")), inp.fx_quotes)
    return lookups.fx_convert(r, rates)


def with_side_tables(rows: DataFrame, inp: Inputs) -> DataFrame:
    rows = reports.rs_rating(rows)  # before the joins, so that its checkpoint evaluates none of them
    if inp.light and inp.previous is not None:
        r = refresh.carry_forward(rows, inp.previous)
    else:
        n = news.news_sentiment(known_headlines(inp), inp.positive_words, inp.negative_words)
        r = rows.join(n, "symbol", "left").join(refresh.next_earnings(inp.earnings, inp.as_of), "symbol", "left")
        r = r.withColumns({  # a symbol without headlines is neutral
            "news_score": F.coalesce("news_score", F.lit(50)), "news_n": F.coalesce("news_n", F.lit(0)),
            "news_sentiment": F.coalesce("news_sentiment", F.lit("neutral"))})
        if inp.overrides is not None:
            r = news.apply_override(r, inp.overrides)
        r = r.join(intraday.patterns(inp.bars30).select("symbol", "intraday_note"), "symbol", "left")
    r = news.hype_signal(r, inp.social)
    w = fundamentals.statements_wide(inp.statements).join(
        inp.fundamentals.select("symbol", "market_cap"), "symbol", "left")
    deep = fundamentals.altman(fundamentals.piotroski(w)).select("symbol", "piotroski", "piotroski_n", "altman_z")
    r = r.join(deep, "symbol", "left")
    r = holders.stance(r, inp.holdings)
    r = r.join(inp.themes.withColumnRenamed("tags", "themes"), "symbol", "left")
    r = r.join(inp.experts.withColumnRenamed("tags", "expert_sources"), "symbol", "left")
    return lookups.with_country(r, "listing")


def with_rating(rows: DataFrame, context: DataFrame) -> DataFrame:
    r = scores.subscores(scores.weinstein(scores.minervini(rows)))
    r = rating.volume_signal(macro.adjust(r, context))
    r = rating.potential(rating.quality(rating.elo(r)))
    r = outlook.projections(outlook.actions(outlook.plain_summary(r)))
    r = rating.trend_phase(r)
    r = outlook.upside(rating.urgency(rating.conviction(r)))
    r = rating.supports(rating.timing_helpers(r))
    r = rating.bottoming(rating.falling_knife(r))
    r = rating.risk_warnings(rating.entry(r))
    r = rating.downside(outlook.priced_in(outlook.bull_thesis(r)))
    return outlook.trade_plan(outlook.trade_plan(r, "invest"), "trade")



def snapshot(inp: Inputs) -> DataFrame:
    """The whole screen as one plan; `plans.stages` writes the same stages as tables."""
    rows = with_side_tables(with_fundamentals(technical(inp), inp), inp)
    return with_rating(rows, macro.context(inp.macro_quotes, inp.as_of))
