"""Headline sentiment, social hype and override joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.core import clamp, div, lookup, num, rnd

C = F.col

# Sentiment word lists (EN + DE). The phrase "beat estimates" is a member that no single word can match.
POSITIVE = (
    "beat", "beats", "beat estimates", "surge", "surges", "jump", "jumps", "soar", "soars", "rally", "rallies", "upgrade",
    "upgraded", "raise", "raised", "record", "strong", "growth", "profit", "profits", "wins", "win", "deal", "approval",
    "approved", "breakthrough", "outperform", "bullish", "gain", "gains", "rebound", "expand", "expansion", "buyback", "tops",
    "top", "boost", "boosts", "optimistic", "steigt", "steigen", "gewinnt", "rekord", "stark", "starkes", "wächst", "wachstum",
    "gewinn", "übernahme", "hochgestuft", "erholung", "durchbruch", "dividende", "kaufen",
)
NEGATIVE = (
    "miss", "misses", "plunge", "plunges", "drop", "drops", "fall", "falls", "slump", "cut", "cuts", "downgrade", "downgraded",
    "warning", "warns", "lawsuit", "probe", "investigation", "recall", "layoff", "layoffs", "loss", "losses", "weak",
    "bankruptcy", "fraud", "decline", "declines", "slash", "halt", "delay", "delays", "bearish", "sinks", "tumble", "tumbles",
    "plummet", "slips", "concern", "concerns", "fear", "fears", "fällt", "fallen", "sinkt", "verlust", "warnung", "klage",
    "ermittlung", "rückruf", "entlassungen", "schwach", "insolvenz", "betrug", "gewinnwarnung", "abgestuft", "einbruch",
    "stürzt", "verkaufen",
)


def tokens(title: str | Column) -> Column:
    """Distinct lower-case words; comma, full stop and any Unicode white space (no-break spaces too) separate words."""
    c = C(title) if isinstance(title, str) else title
    words = F.split(F.translate(F.lower(c), ",.", "  "), r"[\s\x1C-\x1F\x85\p{Z}]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def _hits(words: Sequence[str]) -> Column:
    return F.size(F.array_intersect("_tok", F.array(*[F.lit(w) for w in words])))


def title_hits(headlines: DataFrame, positive: Sequence[str], negative: Sequence[str]) -> DataFrame:
    return (headlines.withColumn("_tok", tokens("title"))
            .withColumns({"pos_hits": _hits(positive), "neg_hits": _hits(negative)}).drop("_tok"))


def _score(net: Column) -> Column:
    return clamp(num(50) + net * num(6), 5, 95).cast("int")


def _label(score: Column) -> Column:
    return F.when(score >= 60, F.lit("positiv")).when(score <= 40, F.lit("negativ")).otherwise(F.lit("neutral"))


def news_sentiment(headlines: DataFrame, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE,
                   per_symbol: int | None = None, carry: int = 3) -> DataFrame:
    """symbol, news_score, news_sentiment, news_n and the first `carry` headlines.

    Every headline counts; per_symbol keeps only the first ones of a symbol, as a group limit before the shuffle.
    """
    first = Window.partitionBy("symbol").orderBy("pos")
    few = headlines.withColumn("_rn", F.row_number().over(first))
    if per_symbol is not None:
        few = few.where(C("_rn") <= per_symbol)
    titled = F.length("title") > 0
    hits = title_hits(few, positive, negative)
    item = F.struct("_rn", "title", "link", "published")
    g = hits.groupBy("symbol").agg(
        _score(F.sum(F.when(titled, C("pos_hits") - C("neg_hits")).otherwise(0))).alias("news_score"),
        F.count(F.when(titled, 1)).cast("int").alias("news_n"),
        F.sort_array(F.collect_list(F.when(C("_rn") <= carry, item))).alias("_items"))
    return g.select(
        "symbol", "news_score", _label(C("news_score")).alias("news_sentiment"), "news_n",
        F.transform("_items", lambda x: F.struct(x["title"].alias("title"), x["link"].alias("link"),
                                                 x["published"].alias("published"))).alias("news"))


def market_sentiment(headlines: DataFrame, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE,
                     keep: int = 24) -> DataFrame:
    """One row: sentiment over every headline plus the first `keep` headlines."""
    total = title_hits(headlines, positive, negative).agg(
        _score(F.sum(C("pos_hits") - C("neg_hits"))).alias("market_sentiment"), F.count("*").alias("n"))
    first = headlines.orderBy("pos").limit(keep).agg(
        F.sort_array(F.collect_list(F.struct("pos", "title", "link"))).alias("headlines"))
    return total.crossJoin(first).select("market_sentiment", _label(C("market_sentiment")).alias("market_label"),
                                         "n", "headlines")


# Override direction -> sentiment label.
DIRECTIONS = {"bullish": "positiv", "bearish": "negativ", "neutral": "neutral"}


def apply_override(rows: DataFrame, overrides: DataFrame, top: int | None = None, order_by: str = "investment_score") -> DataFrame:
    """Replaces score and sentiment where an override exists; top restricts this to the best rows by score."""
    best = rows if top is None else rows.orderBy(F.coalesce(C(order_by), num(0)).desc(), "ord").limit(top)
    chosen = (best.select("symbol")
              .join(overrides, "symbol")
              .select("symbol", clamp(F.coalesce(C("score"), F.lit(50)), 0, 100).cast("int").alias("_s"),
                      F.coalesce(lookup(DIRECTIONS, C("direction")), F.lit("neutral")).alias("_d"),
                      C("reason").alias("news_override_reason")))
    j = rows.join(chosen, "symbol", "left")
    return j.withColumns({
        "news_score": F.coalesce("_s", "news_score"), "news_sentiment": F.coalesce("_d", "news_sentiment"),
        "news_mode": F.when(C("_d").isNotNull(), F.lit("KI"))}).drop("_s", "_d")


def latest_board(pages: DataFrame) -> DataFrame:
    """Social board rows with upper-case tickers; the later page wins (column `page`)."""
    cols = [c for c in pages.columns if c not in ("ticker", "page")]
    best = F.max_by(F.struct(*cols), "page")
    return (pages.where(F.length("ticker") > 0).groupBy(F.upper("ticker").alias("ticker")).agg(best.alias("b"))
            .select("ticker", "b.*"))


def hype_signal(symbols: DataFrame, board: DataFrame) -> DataFrame:
    """Left join of the social board with rank score, 24h change, rank jump and surge flag."""
    b = board.where((C("rank").isNotNull()) & (C("rank") != 0))
    j = symbols.join(b, F.upper(symbols["symbol"]) == b["ticker"], "left")
    on_board = C("ticker").isNotNull()
    m, prev = F.coalesce("mentions", F.lit(0)), F.coalesce("mentions_24h_ago", F.lit(0))
    jump = F.when(F.coalesce("rank_24h_ago", F.lit(0)) != 0, C("rank_24h_ago") - C("rank")).otherwise(0)
    surge = ((prev != 0) & (m >= num(1.5) * prev) & (m >= 30)) | (jump >= 15)
    return j.select(
        *symbols.columns, C("rank").alias("hype_rank"), F.when(on_board, m).alias("hype_mentions"),
        F.when(on_board, rnd((div(m, F.nullif(prev, F.lit(0))) - num(1)) * num(100), 0)).alias("hype_change_pct"),
        rnd(clamp(num(100) - C("rank") * num(0.9), 5, 100), 0).alias("hype_score"),
        F.when(on_board, surge).alias("hype_surging"))
