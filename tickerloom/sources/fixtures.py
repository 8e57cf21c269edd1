"""Market-shaped tables derived from the star-schema test tables.

One symbol per supplier. Prices are a random walk: the running integer sum of
(discount in cents - 5) over the supplier's order lines, so accumulation is exact.
The running sum is taken in two levels (within a day, then over days), so the
rows of one busy symbol are spread over its days before any symbol-wide window.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.functions.core import div, num, rnd
from tickerloom.session import dealt

AS_OF = date(2001, 11, 4)  # the last day that has bars
EVENTS = ("2001-09-17", "2001-11-06", "2001-12-11")  # decision days around AS_OF
CACHE_AS_OF = "2024-01-31 00:00:00"

# One entry per nation key 0..24.
SUFFIXES = ["", ".DE", ".PA", ".L", ".T", "", ".HK", ".SW", ".JO", ".SA", ".TO", "", ".KS",
            ".MI", ".AX", "", ".ST", ".NS", ".MX", ".WA", "", ".XX", ".TWO", ".VX", ".AS"]
SECTORS = ["Technology", "Financial Services", "Energy", "Basic Materials", "Real Estate",
           "Healthcare", "Industrials", "Energy", "Basic Materials", "Technology",
           "Consumer Cyclical", "Utilities", "Technology", "Financial Services", "Basic Materials",
           "Communication Services", "Industrials", "Energy", "Real Estate", "Healthcare",
           "Technology", "Consumer Cyclical", "Basic Materials", "Industrials", "Financial Services"]
INDUSTRIES = ["Semiconductors", "Banks", "Oil & Gas E&P", "Gold", "REIT - Retail",
              "Biotechnology", "Airlines", "Oil & Gas Midstream", "Copper", "Software",
              "Auto Manufacturers", "Utilities - Regulated", "Computer Hardware", "Insurance", "Silver",
              "Internet Content", "Aerospace & Defense", "Uranium", "REIT - Office", "Medical Devices",
              "Semiconductor Equipment", "Homebuilding", "Other Industrial Metals & Mining", "Shipping", "Asset Management"]
PART_THEMES = {"ECONOMY": "KI", "SMALL": "Rüstung", "MEDIUM": "REIT", "PROMO": "Krypto",
               "STANDARD": "ETF", "LARGE": "Emerging Markets"}
SEGMENT_SOURCES = {"BUILDING": "Handelsblatt", "AUTOMOBILE": "LYNX", "MACHINERY": "DZ Bank",
                   "HOUSEHOLD": "Maydorn", "FURNITURE": "echtgeld.tv"}
POS_WORDS = ["the", "and", "la", "und", "that", "die", "this", "on"]
NEG_WORDS = ["of", "de", "in", "der", "is", "le", "was", "by", "er"]
PRIORITY_SERIES = {"1-URGENT": ("vix", 10000.0), "2-HIGH": ("tnx", 60000.0), "3-MEDIUM": ("oil", 3000.0),
                   "4-NOT SPECIFIED": ("gold", 100.0), "5-LOW": ("dxy", 2500.0)}
SEGMENT_SERIES = {"BUILDING": ("copper", 60000.0), "AUTOMOBILE": ("silver", 10000.0), "MACHINERY": ("btc", 4.0),
                  "HOUSEHOLD": ("spx", 50.0), "FURNITURE": ("ndx", 12.0)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def _symbol(key: Column) -> Column:
    return F.concat(F.lit("S"), key.cast("string"))


def _symbol_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-row table, so joining it is a bounded broadcast."""
    return table(spark, sf_dir, "supplier").agg(F.count("*").alias("n_sym"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    nk = F.col("s_nationkey")
    return (
        s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        .select(
            _symbol(F.col("s_suppkey")).alias("symbol"),
            F.concat(_symbol(F.col("s_suppkey")), _pick(SUFFIXES, nk)).alias("listing"),
            F.col("s_name").alias("name"),
            F.col("r_name").alias("exchange"),
            _pick(SECTORS, nk).alias("sector"),
            _pick(INDUSTRIES, nk).alias("industry"),
            F.col("s_acctbal").alias("acctbal"),
            F.col("s_suppkey").cast("long").alias("ord"),
        )
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: symbol, ts, open, high, low, close, volume."""
    li = table(spark, sf_dir, "lineitem")
    lines = li.count()  # from the footers
    tick = dealt(li.select(
        _symbol(F.col("l_suppkey")).alias("symbol"),
        F.col("l_shipdate").cast("date").alias("ts"),
        "l_orderkey", "l_linenumber", "l_partkey",
        (F.round(F.col("l_discount") * 100).cast("int") - 5).alias("step"),
        F.col("l_quantity").alias("qty"),
    ), lines, "symbol", "ts")
    within = Window.partitionBy("symbol", "ts").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    # a day's last line has its totals: the sort of the running sum serves them too, and no table of all days is held
    daily = (
        tick.withColumns({"net": F.sum("step").over(so_far), "volume": F.sum("qty").over(so_far), "_more": F.lead(F.lit(True)).over(within)})
        .withColumns({"hi": F.max("net").over(so_far), "lo": F.min("net").over(so_far)})
        .where("_more is null").select("symbol", "ts", "net", "hi", "lo", "volume")
    )
    days = Window.partitionBy("symbol").orderBy("ts")
    before = F.coalesce(F.sum("net").over(days.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def price(steps: Column) -> Column:
        return num(100) * F.exp(steps / num(200))

    walked = dealt(daily, lines, "symbol").select("symbol", "ts", "volume", "net", "hi", "lo", before.alias("before")).select(
        "symbol", "ts", "volume",
        price(F.col("before") + F.col("hi")).alias("h0"),
        price(F.col("before") + F.col("lo")).alias("l0"),
        price(F.col("before") + F.col("net")).alias("close"),
    )
    prev = F.lag("close").over(days)
    return walked.select(
        "symbol", "ts", F.coalesce(prev, "close").alias("open"),
        F.greatest("h0", prev).alias("high"), F.least("l0", prev).alias("low"),
        "close", F.col("volume").cast("double").alias("volume"),
    )


def bars30(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    slot = F.window("ts", "30 minutes").start
    at = F.struct("ts", "event_id")
    price = num(100) + F.col("value") / num(10)
    return (
        e.groupBy(F.col("event_type").alias("symbol"), slot.alias("slot"))
        .agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
             F.max_by(price, at).alias("close"), F.count("*").cast("double").alias("volume"))
        .select("symbol", F.col("slot").alias("ts"), "open", "high", "low", "close", "volume")
    )


def last_closes(daily: DataFrame) -> DataFrame:
    return daily.groupBy("symbol").agg(F.max_by("close", "ts").alias("last_close"))


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums per supplier and year.

    Total assets are a multiple of the revenue, so the test that compares their ratio over two years sees nothing but the
    last bits of the revenue, which depend on the order of the additions. It is added in the order of the file's rows: a
    running sum, whatever the splits and tasks.
    """
    li = table(spark, sf_dir, "lineitem")
    ep, disc, tax, flag = (F.col(c) for c in ("l_extendedprice", "l_discount", "l_tax", "l_returnflag"))
    key = [F.col("l_suppkey").alias("suppkey"), F.year("l_shipdate").alias("yr")]
    placed = li.select(*key, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), ep.alias("ep"))
    in_order = Window.partitionBy("suppkey", "yr").orderBy("file", "row").rowsBetween(Window.unboundedPreceding, 0)
    revenue = placed.withColumn("run", F.sum("ep").over(in_order)).groupBy("suppkey", "yr").agg(
        F.max_by("run", F.struct("file", "row")).alias("revenue"))
    sums = li.groupBy(*key).agg(
        F.sum(ep * (num(0.35) - disc)).alias("gross_profit"),
        F.sum(ep * (num(0.06) - disc)).alias("net_income"),
        F.sum(ep * (num(0.05) - tax)).alias("cfo"),
        F.sum(F.when(flag == "N", ep)).alias("current_assets"),
        F.sum(F.when(flag == "R", ep)).alias("current_liabilities"),
        F.sum(F.when(flag == "A", ep * num(0.5))).alias("long_term_debt"),
        F.sum("l_quantity").alias("shares"),
    )
    year = ["suppkey", "yr"]
    return revenue.join(sums.select(*[F.col(c).alias(f"_{c}") if c in year else c for c in sums.columns]),
                        F.col("suppkey").eqNullSafe(F.col("_suppkey")) & F.col("yr").eqNullSafe(F.col("_yr"))).drop("_suppkey", "_yr")


# Fixed values: (statement, preferred label, alias label, amount column).
STATEMENT_ITEMS = [
    ("income", "Net Income", "Net Income Common Stockholders", "net_income"),
    ("income", "Total Revenue", "Operating Revenue", "revenue"),
    ("income", "Gross Profit", "Gross Profit", "gross_profit"),
    ("income", "EBIT", "Operating Income", "ebit"),
    ("balance", "Total Assets", "Total Assets", "total_assets"),
    ("balance", "Current Assets", "Total Current Assets", "current_assets"),
    ("balance", "Current Liabilities", "Total Current Liabilities", "current_liabilities"),
    ("balance", "Long Term Debt", "Long Term Debt And Capital Lease Obligation", "long_term_debt"),
    ("balance", "Ordinary Shares Number", "Share Issued", "shares"),
    ("balance", "Retained Earnings", "Retained Earnings", "retained_earnings"),
    ("balance", "Total Liabilities Net Minority Interest", "Total Liab", "total_liabilities"),
    ("cashflow", "Operating Cash Flow", "Total Cash From Operating Activities", "cfo"),
]


def _yearly_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("suppkey").orderBy(F.desc("yr"))
    return _yearly(spark, sf_dir).select(
        "*",
        (F.col("revenue") * num(1.5)).alias("total_assets"),
        (F.col("net_income") * num(1.4)).alias("ebit"),
        (F.col("gross_profit") * num(0.4)).alias("retained_earnings"),
        (F.col("current_liabilities") + F.col("long_term_debt")).alias("total_liabilities"),
        (F.row_number().over(w) - 1).alias("period_rank"),
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: symbol, stmt, item, period_rank (0 = latest), amount."""
    odd = F.col("suppkey") % 2 == 1
    lines = F.array(*[
        F.struct(F.lit(s).alias("stmt"), F.when(odd, F.lit(alt)).otherwise(F.lit(item)).alias("item"),
                 F.col(c).alias("amount"))
        for s, item, alt, c in STATEMENT_ITEMS
    ])
    return (
        _yearly_full(spark, sf_dir)
        .select(_symbol(F.col("suppkey")).alias("symbol"), "period_rank", F.explode(lines).alias("l"))
        .where("l.amount is not null")
        .select("symbol", "l.stmt", "l.item", "period_rank", "l.amount")
    )


def raw_fundamentals(spark: SparkSession, sf_dir: str, daily: DataFrame) -> DataFrame:
    """Vendor-named fundamentals snapshot, one row per symbol."""
    y = _yearly_full(spark, sf_dir).where("period_rank <= 1")
    cur = lambda c: F.max(F.when(F.col("period_rank") == 0, F.col(c))).alias(c)
    prior = lambda c: F.max(F.when(F.col("period_rank") == 1, F.col(c))).alias(c + "_p")
    names = ["revenue", "net_income", "cfo", "total_assets", "ebit", "gross_profit", "current_assets",
             "current_liabilities", "long_term_debt", "total_liabilities", "shares"]
    wide = y.groupBy(_symbol(F.col("suppkey")).alias("symbol")).agg(
        *[cur(c) for c in names], prior("revenue"), prior("net_income"))
    u = universe(spark, sf_dir).select("symbol", "sector", "industry", "acctbal")
    b = (wide.join(u, "symbol").join(last_closes(daily), "symbol")
         .withColumn("equity", F.col("total_assets") - F.coalesce(F.col("total_liabilities"), num(0)))
         .withColumn("bal", F.abs("acctbal")))
    ok = F.col("acctbal") >= 0
    known = lambda c: F.when(ok, c)
    eps = div("net_income", F.col("shares") * num(4))
    mcap = F.col("last_close") * F.col("shares") * num(20)
    eg = F.when(F.col("net_income_p") > 0, div("net_income", "net_income_p") - num(1))
    pe = known(div("last_close", eps))
    mean = num(1) + F.col("bal") / num(2600)
    out = {
        "trailingPE": pe, "forwardPE": pe * (num(0.4) + F.col("bal") / num(10000)),
        "priceToBook": known(div(mcap, "equity")), "priceToSalesTrailing12Months": known(div(mcap, "revenue")),
        "enterpriseToEbitda": known(div(mcap + F.coalesce(F.col("long_term_debt"), num(0)), "ebit")),
        "trailingPegRatio": known(div(div("last_close", eps), eg * num(100))),
        "returnOnEquity": known(div(F.col("net_income") * num(5), "equity")),
        "returnOnAssets": known(div(F.col("net_income") * num(3), "total_assets")),
        "profitMargins": known(div(F.col("net_income") * num(5), "revenue")),
        "grossMargins": known(div("gross_profit", "revenue")),
        "operatingMargins": known(div("ebit", "revenue")),
        "debtToEquity": known(div(F.col("long_term_debt") * num(300), "equity")),
        "currentRatio": known(div("current_assets", "current_liabilities")),
        "revenueGrowth": div("revenue", "revenue_p") - num(1), "earningsGrowth": eg,
        "dividendYield": F.col("bal") / num(200000), "marketCap": mcap,
        "enterpriseValue": mcap + F.coalesce(F.col("long_term_debt"), num(0)), "ebitda": F.col("ebit"),
        "freeCashflow": F.col("cfo"), "sector": F.col("sector"), "industry": F.col("industry"),
        "recommendationMean": mean,
        "recommendationKey": F.when(mean < 2, "strong_buy").when(mean < 3, "buy").when(mean < 4, "hold")
        .otherwise("underperform"),
        "numberOfAnalystOpinions": F.floor(F.col("bal") / num(400)).cast("int"),
        "targetMeanPrice": F.col("last_close") * (num(0.8) + F.col("acctbal") / num(15000)),
        "trailingEps": eps, "bookValue": div("equity", F.col("shares") * num(20)),
        "beta": num(0.5) + F.col("bal") / num(5000), "totalRevenue": F.col("revenue"),
    }
    return b.select("symbol", *[c.alias(k) for k, c in out.items()])


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").crossJoin(_symbol_count(spark, sf_dir))
    return d.select(_symbol(F.col("doc_id") % F.col("n_sym")).alias("symbol"), F.col("doc_id").alias("pos"),
                    F.col("text").alias("title"), F.col("source").alias("link"), F.col("lang").alias("published"))


def press(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Press feed: pos, title, body, published; some titles are rate statements, some days lie after AS_OF."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    title = (F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("Federal Reserve issues <b>FOMC</b> statement no. "), n))
             .when(F.col("doc_id") % 9 == 4, F.concat(F.lit("Monetary Policy report "), n)).otherwise(F.concat(F.lit("Press release "), n)))
    day = F.date_add(F.lit(AS_OF.isoformat()).cast("date"), (F.col("doc_id") % 700 - 650).cast("int"))
    return d.select(F.col("doc_id").alias("pos"), title.alias("title"), F.col("text").alias("body"), day.alias("published"))


def gappy_bars(bars: DataFrame) -> DataFrame:
    """Bars with missing closes: those of every volume that 13 divides."""
    return bars.withColumn("close", F.when(F.col("volume").cast("long") % 13 != 0, F.col("close")))


def chat_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for the headlines of the previous full run."""
    c = table(spark, sf_dir, "conversations").crossJoin(_symbol_count(spark, sf_dir))
    return c.select(
        _symbol((F.col("conv_id") * 3) % F.col("n_sym")).alias("symbol"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.col("text").alias("title"),
        F.col("role").alias("link"), F.lit("").alias("published"))


def social(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mention board of the last day with events against the day before."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = e.agg(F.date_trunc("day", F.max("ts")).alias("_day"))  # one row
    e = e.crossJoin(last).where(F.col("ts") >= F.col("_day") - F.expr("interval 1 day")).crossJoin(_symbol_count(spark, sf_dir))
    now = F.col("ts") >= F.col("_day")
    board = e.groupBy(_symbol(F.col("user_id") % F.col("n_sym")).alias("ticker")).agg(
        F.count(F.when(now, 1)).cast("int").alias("mentions"),
        F.count(F.when(~now, 1)).cast("int").alias("mentions_24h_ago"),
        F.count(F.when(now & (F.col("event_type") == "click"), 1)).cast("int").alias("upvotes"))
    from tickerloom.functions.ranks import exact_rank
    board = board.withColumn("_tie", F.substring("ticker", 2, 20).cast("long"))
    for source, name in (("mentions", "rank"), ("mentions_24h_ago", "rank_24h_ago")):
        board = exact_rank(board.withColumn("_m", F.when(F.col(source) > 0, F.col(source))), "_m", "_tie", name,
                           descending=True).drop("_m")
    return board.select("ticker", F.col("rank").cast("int"), "mentions", "upvotes", "mentions_24h_ago",
                        F.col("rank_24h_ago").cast("int"))


def earnings_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").crossJoin(_symbol_count(spark, sf_dir))
    return o.select(_symbol(F.col("o_custkey") % F.col("n_sym")).alias("symbol"),
                    F.date_add(F.col("o_orderdate").cast("date"), 100).alias("d"))


def macro_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily close per macro series: series, d, close."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")

    def series(df: DataFrame, key: str, names: dict[str, tuple[str, float]]) -> DataFrame:
        name, scale = F.col(key), F.lit(None).cast("double")
        label = F.lit(None).cast("string")
        for k, (s, d) in names.items():
            label = F.when(name == k, F.lit(s)).otherwise(label)
            scale = F.when(name == k, num(d)).otherwise(scale)
        return df.groupBy(label.alias("series"), F.col("o_orderdate").cast("date").alias("d")).agg(
            (F.avg(F.col("o_totalprice") / scale)).alias("close"))

    by_segment = o.join(c, o.o_custkey == c.c_custkey).select("c_mktsegment", "o_orderdate", "o_totalprice")
    world = o.groupBy(F.lit("world").alias("series"), F.col("o_orderdate").cast("date").alias("d")).agg(
        F.avg(F.col("o_totalprice") / num(1000)).alias("close"))
    return (series(o, "o_orderpriority", PRIORITY_SERIES)
            .unionByName(series(by_segment, "c_mktsegment", SEGMENT_SERIES)).unionByName(world)
            .where("series is not null"))


def fx_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted pairs per trading currency: currency, direct, inverse."""
    from tickerloom.operators.lookups import currency_of

    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    suffix = F.concat(F.lit("X"), _pick(SUFFIXES, F.col("n_nationkey")))
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    acct = F.abs("c_acctbal")
    return j.groupBy(currency_of(suffix).alias("currency")).agg(
        rnd(F.avg(F.when((F.col("n_regionkey") < 2), acct)) / num(5000), 6).alias("direct"),
        rnd(F.avg(F.when((F.col("n_regionkey") == 2) | (F.col("n_regionkey") == 3), acct)) / num(4000), 6)
        .alias("inverse"))


def themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").crossJoin(_symbol_count(spark, sf_dir))
    from tickerloom.functions.core import lookup
    return p.groupBy(_symbol(F.col("p_partkey") % F.col("n_sym")).alias("symbol")).agg(
        F.array_sort(F.collect_set(lookup(PART_THEMES, F.col("p_type")))).alias("tags"))


def expert_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickerloom.functions.core import lookup
    c = table(spark, sf_dir, "customer").crossJoin(_symbol_count(spark, sf_dir))
    return c.groupBy(_symbol(F.col("c_custkey") % F.col("n_sym")).alias("symbol")).agg(
        F.array_sort(F.collect_set(lookup(SEGMENT_SOURCES, F.col("c_mktsegment")))).alias("tags"))


def holdings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter-end report lines: issuer, put_call (NULL = shares), value."""
    li = table(spark, sf_dir, "lineitem")
    pc = F.when(F.col("l_returnflag") == "R", "Put").when(F.col("l_returnflag") == "A", "Call")
    return li.select(_symbol(F.col("l_suppkey")).alias("issuer"), pc.alias("put_call"),
                     F.round("l_extendedprice").cast("long").alias("value"))


def news_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").crossJoin(_symbol_count(spark, sf_dir))
    q = F.avg("quality")
    return l.groupBy(_symbol(F.col("doc_id") % F.col("n_sym")).alias("symbol")).agg(
        F.floor(q * num(130) - F.avg("toxic") * num(40)).cast("int").alias("score"),
        F.when(q > 0.8, "bullish").when(q < 0.5, "bearish").when(q < 0.7, "unknown").otherwise("neutral")
        .alias("direction"),
        F.concat(F.lit("n="), F.count("*").cast("string")).alias("reason"))


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refresh log: symbol, fetched_at (text, may be unparsable), mode, hits."""
    e = table(spark, sf_dir, "events").crossJoin(_symbol_count(spark, sf_dir))
    at = F.struct("ts", "event_id")
    day = F.col("ts") >= F.lit("2024-01-29").cast("timestamp")
    g = e.groupBy(_symbol(F.col("user_id") % F.col("n_sym")).alias("symbol"), day.alias("fresh")).agg(
        F.max("ts").alias("last_ts"), F.max_by("event_type", at).alias("mode"), F.count("*").alias("hits"))
    stamp = F.date_format("last_ts", "yyyy-MM-dd'T'HH:mm:ss")
    return g.select("symbol", "fresh",
                    F.when(F.col("mode") == "error", "not a date").otherwise(stamp).alias("fetched_at"),
                    "mode", "hits")


def positions(spark: SparkSession, sf_dir: str, b: DataFrame) -> DataFrame:
    """Ten open positions: the most traded symbols, entered 60 bars ago."""
    last = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    # ten rows are chosen first, so that only their bars are numbered
    most = b.groupBy("symbol").agg(F.sum("volume").alias("traded")).orderBy(F.desc("traded"), "symbol").limit(10)
    top = b.join(most.select("symbol"), "symbol").withColumn("rr", F.row_number().over(last)).groupBy("symbol").agg(
        F.max(F.when(F.col("rr") == 61, F.col("close"))).alias("entry"),
        F.max(F.when(F.col("rr") == 61, F.col("ts"))).alias("entry_date"),
        F.max(F.when(F.col("rr").between(11, 61), F.col("close"))).alias("peak"))
    u = universe(spark, sf_dir).select("symbol", "name", "ord")
    return top.join(u, "symbol").select(
        "symbol", "name", rnd("entry", 4).alias("entry_price"), rnd("peak", 4).alias("peak_price"), "entry_date",
        num(900).alias("stake"), (F.lit(60) + F.col("ord") % 30).cast("int").alias("score_at_entry"))


def account(b: DataFrame) -> DataFrame:
    """One-row portfolio account (date of the newest bar = trading day)."""
    return b.agg(F.max("ts").alias("today")).select(
        "today", num(10000).alias("start_capital"), num(1500).alias("cash"),
        num(250).alias("realized_pnl"), F.date_sub("today", 1).alias("last_trade_date"))


def trade_log(b: DataFrame) -> DataFrame:
    """Closed monthly round trips of every symbol plus their opening buys."""
    m = b.groupBy("symbol", F.trunc("ts", "month").alias("month")).agg(
        F.min("ts").alias("d0"), F.max("ts").alias("d1"),
        F.min_by("close", "ts").alias("p0"), F.max_by("close", "ts").alias("p1"))
    sell = m.select("symbol", F.col("d1").alias("date"), F.lit("SELL").alias("action"), rnd("p1", 4).alias("price"),
                    rnd((div("p1", "p0") - num(1)) * num(100), 2).alias("pnl_pct"),
                    F.datediff("d1", "d0").alias("held_days"))
    buy = m.select("symbol", F.col("d0").alias("date"), F.lit("BUY").alias("action"), rnd("p0", 4).alias("price"),
                   num(0).alias("pnl_pct"), F.lit(None).cast("int").alias("held_days"))
    return sell.unionByName(buy)


def equity_curve(spark: SparkSession, sf_dir: str, daily: DataFrame) -> DataFrame:
    b = daily.groupBy(F.col("ts").alias("date")).agg(rnd(F.avg("close") * num(100), 2).alias("equity"))
    q = macro_quotes(spark, sf_dir).where("series in ('spx','ndx','world')").groupBy(F.col("d").alias("date")).agg(
        *[rnd(F.max(F.when(F.col("series") == s, F.col("close"))), 2).alias(f"bench_{n}")
          for s, n in (("spx", "sp500"), ("ndx", "ndx"), ("world", "world"))])
    return b.join(q, "date", "left")
