"""The registered queries: name -> DataFrame builder over the test tables."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.core import num, rnd
from tickerloom.operators import (
    backtest, fundamentals, holders, indicators, intraday, lookups, macro, news, portfolio, rating, refresh, reports, scores,
)
from tickerloom.plans.snapshot import run_row, technical, with_side_tables
from tickerloom.plans.stages import Stages
from tickerloom.session import work_dir
from tickerloom.sources import fixtures as fx
from tickerloom.sources import landing, sinks
from tickerloom.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
C = F.col
QUERIES: dict[str, Query] = {}


def query(fn: Callable[[Stages], DataFrame]) -> Callable[[Stages], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Stages(spark, sf_dir))
    return fn


def _named(name: str, fn: Callable[[Stages], DataFrame]) -> None:
    fn.__name__ = name
    query(fn)


# ---- sources and refresh ----------------------------------------------------------------------------------------
@query
def universe_load(st: Stages) -> DataFrame:
    """Customers and suppliers as one raw ticker list with duplicates, blanks, comments and mixed case."""
    s = fx.table(st.spark, st.sf_dir, "supplier")
    c = fx.table(st.spark, st.sf_dir, "customer")
    raw = s.select(F.concat(F.lit("  s"), C("s_suppkey").cast("string"), F.lit(" ")).alias("symbol"),
                   C("s_name").alias("name"), F.lit(" main ").alias("exchange"), (C("s_suppkey") * 2).alias("ord")
                   ).unionByName(c.select(
                       F.when(C("c_acctbal") < 0, F.lit("# closed")).when(C("c_mktsegment") == "BUILDING", F.lit(" "))
                       .otherwise(F.concat(F.lit("S"), (C("c_custkey") % 700).cast("string"))).alias("symbol"),
                       C("c_name").alias("name"), C("c_mktsegment").alias("exchange"), (C("c_custkey") * 2 + 1).alias("ord")))
    return landing.clean_universe(raw).select("symbol", "name", "exchange", "ord")


@query
def bars_daily(st: Stages) -> DataFrame:
    b = indicators.clean_bars(fx.bars(st.spark, st.sf_dir))
    return b.select("symbol", "ts", *[rnd(c, 6).alias(c) for c in ("open", "high", "low", "close", "volume")])


@query
def tags_explode(st: Stages) -> DataFrame:
    return holders.explode_tags(fx.themes(st.spark, st.sf_dir)).unionByName(
        holders.explode_tags(fx.expert_sources(st.spark, st.sf_dir)))


@query
def holder_stance(st: Stages) -> DataFrame:
    h = holders.exposure(fx.holdings_raw(st.spark, st.sf_dir)).withColumnRenamed("issuer", "symbol")
    return holders.stance(fx.universe(st.spark, st.sf_dir).select("symbol"), h)


@query
def holder_13f_exposure(st: Stages) -> DataFrame:
    return holders.exposure(fx.holdings_raw(st.spark, st.sf_dir))


@query
def fundamentals_load(st: Stages) -> DataFrame:
    f = fundamentals.project_fields(fx.raw_fundamentals(st.spark, st.sf_dir, st.bars()))
    return f.select("symbol", *[rnd(c, 5).alias(c) if t == "double" else C(c) for c, t in f.dtypes[1:]])


@query
def statements_wide(st: Stages) -> DataFrame:
    w = fundamentals.statements_wide(fx.statements(st.spark, st.sf_dir))
    return w.select("symbol", *[rnd(c, 6).alias(c) for c in w.columns[1:]])


@query
def earnings_next(st: Stages) -> DataFrame:
    return refresh.next_earnings(fx.earnings_dates(st.spark, st.sf_dir), fx.AS_OF)


@query
def coverage_report(st: Stages) -> DataFrame:
    c = fx.table(st.spark, st.sf_dir, "customer").select(
        F.concat(F.lit("S"), C("c_custkey").cast("string")).alias("symbol"), C("c_name").alias("name"))
    return refresh.coverage(c, st.bars()).withColumn("last_close", rnd("last_close", 4))


def _cache(st: Stages) -> DataFrame:
    c = fx.cache_entries(st.spark, st.sf_dir)
    return refresh.upsert(c.where(~C("fresh")).drop("fresh"), c.where("fresh").drop("fresh"))


@query
def stale_keys(st: Stages) -> DataFrame:
    u = fx.universe(st.spark, st.sf_dir).select("symbol", "ord")
    return refresh.stale_keys(u, _cache(st), fx.CACHE_AS_OF, "12 hours").select("symbol", "ord", "stale_reason")


@query
def refresh_queue(st: Stages) -> DataFrame:
    u = fx.universe(st.spark, st.sf_dir).select("symbol", "ord")
    stale = refresh.stale_keys(u, _cache(st), fx.CACHE_AS_OF, "12 hours")
    return refresh.refresh_queue(stale, st.scored(), 60).select("symbol", "investment_score", "stale_reason")


@query
def cache_upsert(st: Stages) -> DataFrame:
    return _cache(st).select("symbol", "fetched_at", "mode", "hits")


def _news(st: Stages, source: DataFrame) -> DataFrame:
    return news.news_sentiment(source, fx.POS_WORDS, fx.NEG_WORDS)


@query
def carry_forward(st: Stages) -> DataFrame:
    prev = _news(st, fx.chat_headlines(st.spark, st.sf_dir)).drop("news")
    r = refresh.carry_forward(st.features().select("symbol", "price"), prev)
    return r.select("symbol", "price", "news_score", "news_sentiment", "news_n")


@query
def news_override(st: Stages) -> DataFrame:
    r = st.rows().select("symbol", "ord", "investment_score", "news_score", "news_sentiment")
    out = news.apply_override(r, fx.news_overrides(st.spark, st.sf_dir))
    return out.select("symbol", "news_score", "news_sentiment", "news_mode", "news_override_reason")


# ---- lookups ----------------------------------------------------------------------------------------------------
@query
def currency_map(st: Stages) -> DataFrame:
    return fx.universe(st.spark, st.sf_dir).select("symbol", "listing", lookups.currency_of("listing").alias("currency"))


@query
def country_map(st: Stages) -> DataFrame:
    return lookups.with_country(fx.universe(st.spark, st.sf_dir).select("symbol", "listing"), "listing")


@query
def fx_rates(st: Stages) -> DataFrame:
    u = fx.universe(st.spark, st.sf_dir).select(lookups.currency_of("listing").alias("currency"))
    return lookups.fx_rates(u, fx.fx_quotes(st.spark, st.sf_dir))


@query
def fx_convert(st: Stages) -> DataFrame:
    return st.scored().select("symbol", "currency", "fx_usd", "fx_missing", *lookups.PRICE_COLUMNS)


@query
def universe_search(st: Stages) -> DataFrame:
    hits = lookups.search(st.snapshot(), "industr", ["symbol", "name", "sector", "industry", "country"],
                          ["themes", "expert_sources"])
    return hits.select("symbol", "name", "sector", "industry", "country", "elo_score")


@query
def table_filter(st: Stages) -> DataFrame:
    """Filter over the whole table row, best score first."""
    rows = st.snapshot().select("ord", "symbol", "name", "sector", "industry", "country", "themes", "regime", "elo_score")
    return lookups.table_filter(rows, "TECH").select("symbol", "name", "sector", "industry", "country", "elo_score")


# ---- landed files and runs ---------------------------------------------------------------------------------------
def _folder(st: Stages, name: str) -> str:
    return f"{work_dir(st.spark).rstrip('/')}/tickerloom/landed/{name}-{uuid.uuid4().hex}"


@query
def universe_order(st: Stages) -> DataFrame:
    """Ticker list from CSV files: `ord` is the line number over all files, however they are split."""
    c = fx.table(st.spark, st.sf_dir, "customer").select(
        F.concat(F.lit("S"), (C("c_custkey") % 700).cast("string")).alias("symbol"), C("c_name").alias("name"), C("c_mktsegment").alias("exchange"), "c_custkey")
    path = _folder(st, "universe")
    c.repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey").drop("c_custkey").write.option("header", "true").csv(path)
    return landing.universe(st.spark, path)


@query
def bars30_landed(st: Stages) -> DataFrame:
    path = _folder(st, "bars30")
    fx.bars30(st.spark, st.sf_dir).write.parquet(path)
    b = landing.bars_intraday(st.spark, path)
    return b.select("symbol", "ts", *[rnd(c, 4).alias(c) for c in ("open", "high", "low", "close")], "volume")


@query
def fx_table_landed(st: Stages) -> DataFrame:
    """Rates written as one JSON object, as the refresh leaves them, and read back."""
    u = fx.universe(st.spark, st.sf_dir).select(lookups.currency_of("listing").alias("currency"))
    rates = lookups.fx_rates(u, fx.fx_quotes(st.spark, st.sf_dir)).where("usd_rate is not null")
    entries = F.array_append(F.collect_list(F.struct("currency", C("usd_rate").cast("string").alias("v"))),
                             F.struct(F.lit("_fetched_at").alias("currency"), F.lit(fx.CACHE_AS_OF).alias("v")))
    path = _folder(st, "fx")
    rates.agg(F.to_json(F.map_from_entries(entries)).alias("value")).coalesce(1).write.text(path)
    return landing.fx_table(st.spark, path).select("currency", "usd_rate", "fetched_at")


def _stored_run(st: Stages, chat: bool) -> str:
    """A full run in a sink of its own; its headlines are the older ones if `chat`."""
    root, inp = _folder(st, "runs"), st.inputs()
    if chat:
        inp = dataclasses.replace(inp, headlines=fx.chat_headlines(st.spark, st.sf_dir))
    rows = st.table("previous_rows", lambda: with_side_tables(st.scored(), inp)) if chat else st.rows()
    sinks.write_run(st.spark, root, "2001-11-03T18", rows, run_row(rows, inp, st.macro()))
    return root


RUN = ["universe_size", "analyzed", "market_sentiment", "market_label", "market_n", "vix", "risk_regime", "rate_dir", "fomc_next", "fomc_in_days", "as_of"]


@query
def run_output(st: Stages) -> DataFrame:
    """A run's row, written by the sink and read back."""
    return sinks.runs(st.spark, _stored_run(st, chat=False)).select("run_ts", *RUN)


@query
def snapshot_light(st: Stages) -> DataFrame:
    """A light run: prices and ranks are new, news, earnings days and intraday notes come from the stored run before it."""
    root = _stored_run(st, chat=True)
    inp = dataclasses.replace(st.inputs(), light=True, previous=sinks.previous_snapshot(st.spark, root))
    r = with_side_tables(st.scored(), inp)
    market = run_row(r, inp, st.macro(), sinks.runs(st.spark, root)).select("market_sentiment", "market_label", "market_n")
    return r.select("symbol", "price", "rs_rating", "news_score", "news_sentiment", "news_n", "next_earnings", "earnings_in_days", "intraday_note").crossJoin(market)


@query
def snapshot_as_of(st: Stages) -> DataFrame:
    """The technical part of a run for a day in the past."""
    t = technical(dataclasses.replace(st.inputs(), as_of=PAST))
    return t.select("symbol", "ts", "price", "rsi", "adx", "sma50", "macd_hist", "vol_daily", "longterm_score")


PAST = date(1996, 6, 28)


# ---- indicators -------------------------------------------------------------------------------------------------
WINDOWED = {
    "ind_returns": ["price", "prev_close", "daily_return", "ret_5d", "ret_20d", "ret_60d", "roc10"],
    "ind_sma": ["sma20", "sma50", "sma150", "sma200", "sma150_1m_ago", "sma200_1m_ago"],
    "ind_bollinger": ["bb_pctb", "bb_bandwidth"],
    "ind_volume": ["vol", "vol_avg20", "rvol"],
    "ind_breakout": ["high20", "low20"],
    "ind_range52": ["high52", "low52", "pct_from_high52", "pct_above_low52"],
    "ind_stoch": ["stoch_k", "stoch_d", "williams_r"],
    "ind_cci": ["cci"], "ind_obv": ["obv_rising"], "ind_mfi": ["mfi"], "ind_cmf": ["cmf"],
    "ind_aroon": ["aroon_up", "aroon_down"],
    "ind_ichimoku": ["ichimoku", "tenkan_above_kijun"],
    "ind_pivot": ["pivot", "pivot_r1", "pivot_s1"],
    "ind_fib": ["range_pos_pct", "fib_nearest"],
}
FOLDED = {
    "ind_macd": ["macd", "macd_signal", "macd_hist", "macd_hist_prev"],
    "ind_rsi": ["rsi"], "ind_ema": ["ema9", "ema21", "ema9_above_21"],
    "ind_adx": ["adx", "plus_di", "minus_di"], "ind_supertrend": ["supertrend_up"], "ind_psar": ["psar_bull"],
    "ind_keltner": ["keltner_pos"],
}
for _name, _cols in WINDOWED.items():
    _named(_name, lambda st, cols=_cols: indicators.rounded(
        indicators.tail_features(indicators.clean_bars(st.bars())).select("symbol", *cols)))
for _name, _cols in FOLDED.items():
    _named(_name, lambda st, cols=_cols: indicators.rounded(
        indicators.folded_features(indicators.clean_bars(st.bars())).select("symbol", *cols)))
_named("ind_atr", lambda st: indicators.rounded(
    indicators.latest_features(indicators.clean_bars(st.bars())).select("symbol", "atr", "atr_pct")))
_named("ind_volatility", lambda st: indicators.rounded(
    indicators.latest_features(indicators.clean_bars(st.bars())).select(
        "symbol", "vol_daily", "vol_annual_pct", "max_drawdown_pct")))


@query
def ind_volatility_gaps(st: Stages) -> DataFrame:
    """Volatilities where closes are missing: the look-back counts returns, not bars."""
    f = indicators.latest_features(indicators.clean_bars(fx.gappy_bars(st.bars())))
    return indicators.rounded(f.select("symbol", "vol_daily", "vol_annual_pct"))


@query
def path_flags_series(st: Stages) -> DataFrame:
    """Supertrend and SAR flags at every bar."""
    return indicators.path_flag_series(indicators.clean_bars(st.bars()))


@query
def intraday_pattern(st: Stages) -> DataFrame:
    return intraday.patterns(fx.bars30(st.spark, st.sf_dir))


# ---- scores -----------------------------------------------------------------------------------------------------
@query
def score_daytrade(st: Stages) -> DataFrame:
    raw = indicators.latest_features(indicators.clean_bars(st.bars()))
    return scores.daytrade(raw).select("symbol", "daytrade_score", "daytrade_direction",
                                       F.array_join("daytrade_reasons", " | ").alias("reasons"))


@query
def score_longterm(st: Stages) -> DataFrame:
    raw = indicators.latest_features(indicators.clean_bars(st.bars()))
    return scores.longterm(raw).select("symbol", "longterm_score",
                                       F.array_join("longterm_reasons", " | ").alias("reasons"))


for _name, _cols in {"score_value": ["value_score"], "score_quality": ["quality_score"], "score_growth": ["growth_score"],
                     "score_fundamental": ["fundamental_score"]}.items():
    _named(_name, lambda st, cols=_cols: fundamentals.scores(st.fundamentals()).select(
        "symbol", *cols, *([F.array_join("fundamental_reasons", " | ").alias("reasons")]
                           if cols == ["fundamental_score"] else [])))


@query
def score_investment(st: Stages) -> DataFrame:
    f = fundamentals.scores(st.fundamentals()).select("symbol", "fundamental_score")
    r = st.features().select("symbol", "longterm_score").join(f, "symbol", "left")
    return fundamentals.investment(r)


@query
def valuation_metrics(st: Stages) -> DataFrame:
    r = st.features().select("symbol", "price").join(st.fundamentals(), "symbol", "left")
    return fundamentals.valuation(r).select(
        "symbol", "analyst_upside_pct", "graham_number", "graham_margin_pct", "fcf_yield_pct", "rule40", "roe_pct",
        "revenue_growth_pct", "analyst_mean")


@query
def magic_formula(st: Stages) -> DataFrame:
    u = fx.universe(st.spark, st.sf_dir).select("symbol", "ord")
    return fundamentals.magic_formula(st.fundamentals().join(u, "symbol"))


def _deep(st: Stages) -> DataFrame:
    w = fundamentals.statements_wide(fx.statements(st.spark, st.sf_dir))
    return w.join(st.fundamentals().select("symbol", "market_cap"), "symbol", "left")


@query
def piotroski(st: Stages) -> DataFrame:
    return fundamentals.piotroski(_deep(st)).select("symbol", "piotroski", "piotroski_n")


@query
def altman_z(st: Stages) -> DataFrame:
    return fundamentals.altman(_deep(st)).select("symbol", "altman_z")


@query
def rs_rating(st: Stages) -> DataFrame:
    return reports.rs_rating(st.scored().select("symbol", "ord", "ret_60d")).select("symbol", "ret_60d", "rs_rating")


@query
def minervini(st: Stages) -> DataFrame:
    return scores.minervini(st.rows()).select(
        "symbol", "minervini_score", F.array_join("minervini_met", " | ").alias("met"),
        F.array_join("minervini_failed", " | ").alias("failed"))


@query
def weinstein(st: Stages) -> DataFrame:
    return scores.weinstein(st.rows()).select("symbol", "weinstein_stage", "weinstein_label")


for _name in ("tech_trend", "tech_momentum", "tech_volume"):
    _named(_name, lambda st, c=_name: scores.subscores(st.rows()).select("symbol", c))


# ---- news, social, macro ----------------------------------------------------------------------------------------
@query
def news_sentiment(st: Stages) -> DataFrame:
    n = _news(st, fx.headlines(st.spark, st.sf_dir))
    return n.select("symbol", "news_score", "news_sentiment", "news_n",
                    F.array_join(F.transform("news", lambda x: x["link"]), " ").alias("first_links"))


@query
def market_sentiment(st: Stages) -> DataFrame:
    m = news.market_sentiment(fx.headlines(st.spark, st.sf_dir), fx.POS_WORDS, fx.NEG_WORDS)
    return m.select("market_sentiment", "market_label", "n",
                    F.array_join(F.transform("headlines", lambda x: x["link"]), " ").alias("links"))


@query
def hype_signal(st: Stages) -> DataFrame:
    board = news.latest_board(fx.social(st.spark, st.sf_dir).withColumn("page", F.lit(1)))
    return news.hype_signal(fx.universe(st.spark, st.sf_dir).select("symbol"), board)


@query
def macro_series(st: Stages) -> DataFrame:
    return macro.last_and_prior(fx.macro_quotes(st.spark, st.sf_dir))


@query
def macro_context(st: Stages) -> DataFrame:
    return st.macro()


@query
def macro_statement(st: Stages) -> DataFrame:
    """The macro row with tone, headline and date of the newest rate statement."""
    s = macro.latest_statement(fx.press(st.spark, st.sf_dir), fx.AS_OF, HAWK_TERMS, DOVE_TERMS)
    return macro.with_statement(st.macro(), s).select("risk_regime", "rate_dir", "fomc_next", "fomc_in_days", "fomc_tone", "fomc_headline", "fomc_date")


HAWK_TERMS, DOVE_TERMS = [*macro.HAWKISH, "the ", "der "], [*macro.DOVISH, "tion", "la "]


@query
def policy_tone(st: Stages) -> DataFrame:
    return macro.policy_tone(fx.table(st.spark, st.sf_dir, "documents"), "text", HAWK_TERMS, DOVE_TERMS).select(
        "doc_id", "hawk_hits", "dove_hits", "tone")


@query
def macro_adjust(st: Stages) -> DataFrame:
    return macro.adjust(st.rows(), st.macro()).select("symbol", "macro_pts", F.size("macro_notes").alias("notes_n"))


# ---- rating layer (read from the snapshot table) ------------------------------------------------------------------
SNAPSHOT_VIEWS: dict[str, list] = {
    "composite_elo": ["elo", "elo_label", "elo_color", "elo_score", "stars"],
    "quality_rating": ["quality"], "potential": ["potential"], "regime": ["regime"],
    "downside": ["support1", "support1_pct", "support2", "support2_pct", "downside_risk", "downside_verdict"],
    "falling_knife": ["knife_warn"],
    "entry_score": ["entry_score", "entry_label", "entry_tone", "entry_reason"],
    "conviction": ["conviction"], "urgency": ["urgency", "urgency_tone"], "upside": ["upside_pct", "exp_return_12m"],
    "volume_signal": ["volume_pts", "volume_note"], "trend_phase": ["phase_code", "phase", "phase_tone", "phase_sell"],
    "bull_thesis": ["bull_thesis"], "priced_in": ["priced_in"], "plain_summary": ["plain_summary"],
}
for _name, _cols in SNAPSHOT_VIEWS.items():
    _named(_name, lambda st, cols=_cols: st.snapshot().select("symbol", *cols))


@query
def momentum_turn(st: Stages) -> DataFrame:
    return rating.timing_helpers(scores.weinstein(st.rows())).select(
        "symbol", rnd("extension_pct", 4).alias("extension_pct"), "momentum_turn")


@query
def supports(st: Stages) -> DataFrame:
    s = rating.supports(st.rows())
    return s.select("symbol", F.size("supports").alias("n"), F.array_join(F.transform(
        "supports", lambda x: F.format_string("%.2f", x)), " ").alias("supports"))


@query
def bottoming(st: Stages) -> DataFrame:
    return st.snapshot().select("symbol", "bottoming_n", "bottoming_strength",
                                F.array_join("bottoming_signals", " | ").alias("bottoming_signals"))


@query
def risk_warnings(st: Stages) -> DataFrame:
    return st.snapshot().select("symbol", F.array_join("risk_warnings", " | ").alias("risk_warnings"))


PLAN_FIELDS = ["side", "avoid", "entry_low", "entry_high", "target_low", "target_high", "stop", "potential_pct", "risk_pct",
               "rrr", "hold", "action_code", "action", "action_tone", "entry_when"]


@query
def trade_plan(st: Stages) -> DataFrame:
    s = st.snapshot()
    view = lambda c, k: s.select("symbol", F.lit(k).alias("context"), *[C(f"{c}.{f}").alias(f) for f in PLAN_FIELDS])
    return view("trade_plan_long", "invest").unionByName(view("trade_plan_short", "trade"))


@query
def actions(st: Stages) -> DataFrame:
    return st.snapshot().select("symbol", F.array_join(F.transform(
        "actions", lambda x: F.concat(x["tone"], F.lit(":"), x["text"])), " | ").alias("actions"))


@query
def projection(st: Stages) -> DataFrame:
    s = st.snapshot().select("symbol", F.explode(F.concat("projection_short", "projection_long")).alias("p"))
    return s.select("symbol", "p.*")


@query
def snapshot(st: Stages) -> DataFrame:
    return st.snapshot().select(
        "symbol", "listing", "price", "rsi", "adx", "longterm_score", "daytrade_score", "daytrade_direction",
        "fundamental_score", "investment_score", "rs_rating", "minervini_score", "weinstein_stage", "macro_pts", "elo",
        "elo_score", "quality", "potential", "conviction", "entry_score", "downside_risk", "regime", "phase_code",
        "exp_return_12m", C("trade_plan_long.action_code").alias("action_code"))


# ---- lists and reports --------------------------------------------------------------------------------------------
for _name, _fn, _cols in (
    ("top_daytrade", reports.top_daytrade, ["daytrade_score", "daytrade_direction"]),
    ("top_longterm", reports.top_longterm, ["investment_score", "exp_return_12m"]),
    ("top_fundamental", reports.top_fundamental, ["fundamental_score"]),
    ("top_holdings", reports.holdings_by_weight, ["holder_stance", "holder_weight_pct"]),
    ("top_hype", reports.top_hype, ["hype_rank", "hype_score", "hype_surging"]),
    ("best_entries", reports.best_entries, ["entry_opportunity", "entry_score", "elo_score"]),
    ("daily_top3", reports.daily_top3, ["daily_conviction", "entry_score", "elo_score"]),
):
    _named(_name, lambda st, fn=_fn, cols=_cols: fn(st.snapshot()).select("symbol", *cols))
_named("theme_leaderboard", lambda st: reports.tag_leaderboard(st.snapshot(), "themes", 60))
_named("expert_leaderboard", lambda st: reports.tag_leaderboard(st.snapshot(), "expert_sources", None))
_named("verdicts", lambda st: reports.verdicts(st.snapshot()))


# ---- backtest -----------------------------------------------------------------------------------------------------
@query
def rebalance_dates(st: Stages) -> DataFrame:
    return backtest.rebalance_dates(st.bars())


@query
def score_series(st: Stages) -> DataFrame:
    """The long-term score at every bar with at least 220 bars of history."""
    s = backtest.score_series(backtest.eligible(st.bars_by_symbol()))
    return s.where("rn + 1 >= 220").select("symbol", "ts", "longterm_score")


@query
def forward_returns(st: Stages) -> DataFrame:
    f = backtest.forward_returns(st.bars())
    return f.select("symbol", "ts", C("n_future").cast("int").alias("n_future"),
                    *[rnd(f"fwd_{h}", 6).alias(f"fwd_{h}") for h in backtest.HORIZONS])


def _panel(st: Stages) -> DataFrame:
    return st.table("panel", lambda: backtest.scored_panel(st.bars(), by_symbol_=st.bars_by_symbol()))


def _ranked(st: Stages) -> DataFrame:
    u = fx.universe(st.spark, st.sf_dir).select("symbol", "ord")
    return st.table("ranked", lambda: backtest.ranked_panel(_panel(st), u))


@query
def backtest_scores(st: Stages) -> DataFrame:
    return _panel(st).select("symbol", "rebalance", "horizon", "longterm_score", rnd("fwd_ret", 6).alias("fwd_ret"))


@query
def backtest_buckets(st: Stages) -> DataFrame:
    return backtest.bucket_returns(_ranked(st))


@query
def backtest_ic(st: Stages) -> DataFrame:
    return backtest.rank_correlation(_ranked(st))


@query
def backtest_summary(st: Stages) -> DataFrame:
    return backtest.summary(_ranked(st))


# ---- portfolio ----------------------------------------------------------------------------------------------------
class Book:
    """The revision of one day over the snapshot."""

    def __init__(self, st: Stages):
        self.rows = st.snapshot().select("symbol", "ord", "name", "price", "elo_score", "phase_code", "sector",
                                         "holder_stance")
        self.account = st.table("account", lambda: fx.account(st.bars()))
        positions = st.table("positions", lambda: fx.positions(st.spark, st.sf_dir, st.bars()))
        self.marked = st.table("marked", lambda: portfolio.mark(positions, self.rows))
        self.sold = st.table("sold", lambda: portfolio.sells(self.marked, self.rows))
        self.bought = st.table("bought", lambda: portfolio.buys(self.marked, self.sold, self.rows, self.account))
        self.trades = portfolio.trades(self.sold, self.bought, self.account)
        self.after = portfolio.next_positions(self.marked, self.sold, self.bought, self.account)
        self.row = portfolio.snapshot(self.after, self.sold, self.bought, self.account, st.macro())


@query
def portfolio_mark(st: Stages) -> DataFrame:
    return Book(st).marked.select("symbol", "name", "entry_price", "entry_date", "stake", "score_at_entry", "peak_price",
                                  "last_price", "value", "pnl", "pnl_pct")


@query
def portfolio_sells(st: Stages) -> DataFrame:
    return Book(st).sold.select("symbol", "sell_code", "price", "value", "pnl", "pnl_pct", "score_entry", "score_exit", "reason")


@query
def portfolio_buys(st: Stages) -> DataFrame:
    return Book(st).bought.select("symbol", "sector", "entry_price", "stake", "score_at_entry", "buy_rank")


@query
def portfolio_trades(st: Stages) -> DataFrame:
    return Book(st).trades


@query
def equity_snapshot(st: Stages) -> DataFrame:
    """Upsert of today's row into the equity curve, keyed by date."""
    curve = fx.equity_curve(st.spark, st.sf_dir, st.bars())
    row = Book(st).row.select(*curve.columns)
    return refresh.upsert(curve, row, keys=("date",))


@query
def portfolio_summary(st: Stages) -> DataFrame:
    b = Book(st)
    log = fx.trade_log(st.bars()).select("symbol").unionByName(b.trades.select("symbol"))
    return portfolio.totals(b.row, b.sold, log, b.account)


@query
def portfolio_next_state(st: Stages) -> DataFrame:
    """The account after the day's revision."""
    b = Book(st)
    return portfolio.next_account(b.sold, b.bought, b.account)


@query
def portfolio_rerun(st: Stages) -> DataFrame:
    """A second revision of the same day leaves the positions as they are."""
    b = Book(st)
    again = b.account.withColumn("last_trade_date", C("today"))
    return portfolio.next_positions(b.marked, b.sold, b.bought, again).select("symbol", "stake", "score_at_entry", "value")


@query
def equity_vs_benchmark(st: Stages) -> DataFrame:
    return reports.equity_vs_benchmark(fx.equity_curve(st.spark, st.sf_dir, st.bars()), fx.AS_OF, 365)


@query
def trade_stats(st: Stages) -> DataFrame:
    return reports.trade_stats(fx.trade_log(st.bars()))


@query
def open_positions(st: Stages) -> DataFrame:
    return reports.open_positions(Book(st).marked, fx.AS_OF)


# ---- streaming ----------------------------------------------------------------------------------------------------
@query
def stream_bars30(st: Stages) -> DataFrame:
    return jobs.replay_bars30(st.spark, st.sf_dir).select(
        "symbol", "ts", *[rnd(c, 4).alias(c) for c in ("open", "high", "low", "close")], "volume")


@query
def stream_dedup(st: Stages) -> DataFrame:
    return jobs.replay_dedup(st.spark, st.sf_dir)


@query
def stream_mention_surge(st: Stages) -> DataFrame:
    return jobs.replay_mention_surge(st.spark, st.sf_dir)


@query
def stream_sessions(st: Stages) -> DataFrame:
    return jobs.replay_sessions(st.spark, st.sf_dir)


@query
def stream_indicators(st: Stages) -> DataFrame:
    s = jobs.replay_indicators(st.spark, st.bars())
    last = s.groupBy("symbol").agg(F.max_by(F.struct(*[c for c in s.columns if c not in ("symbol", "ts")]), "ts").alias("r"))
    return indicators.rounded(last.select("symbol", "r.*"))


@query
def stream_alerts(st: Stages) -> DataFrame:
    profile = st.features().select("symbol", "vol_avg20")
    return jobs.replay_alerts(st.spark, st.bars(), profile)


@query
def stream_snapshot(st: Stages) -> DataFrame:
    side = fx.universe(st.spark, st.sf_dir).select("symbol", "listing", "sector")
    latest = jobs.replay_snapshot(st.spark, st.bars(), side)
    return latest.select("symbol", "ts", rnd("close", 4).alias("close"), "listing", "sector")
