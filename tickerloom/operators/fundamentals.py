"""Fundamental scores, valuation metrics and statement-based scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.core import band, div, finite, mean_available, num, present, rint, rnd, txt, weighted_mean
from tickerloom.functions.ranks import exact_rank

C = F.col

# Vendor field -> short name.
FIELDS = {
    "trailingPE": "pe", "forwardPE": "forward_pe", "priceToBook": "pb", "priceToSalesTrailing12Months": "ps",
    "enterpriseToEbitda": "ev_ebitda", "trailingPegRatio": "peg", "returnOnEquity": "roe", "returnOnAssets": "roa",
    "profitMargins": "profit_margin", "grossMargins": "gross_margin", "operatingMargins": "operating_margin",
    "debtToEquity": "debt_to_equity", "currentRatio": "current_ratio", "revenueGrowth": "revenue_growth",
    "earningsGrowth": "earnings_growth", "dividendYield": "dividend_yield", "marketCap": "market_cap",
    "enterpriseValue": "enterprise_value", "ebitda": "ebitda", "freeCashflow": "free_cashflow", "sector": "sector",
    "industry": "industry", "recommendationMean": "rec_mean", "recommendationKey": "rec_key",
    "numberOfAnalystOpinions": "analyst_n", "targetMeanPrice": "target_price", "trailingEps": "eps",
    "bookValue": "bvps", "beta": "beta", "totalRevenue": "revenue",
}
TEXT_FIELDS = {"sector", "industry", "rec_key"}


def project_fields(raw: DataFrame) -> DataFrame:
    """Vendor names -> short names; absent columns become NULL, NaN becomes NULL."""
    def pick(src: str, dst: str) -> Column:
        dtype = "string" if dst in TEXT_FIELDS else "int" if dst == "analyst_n" else "double"
        c = C(src).try_cast(dtype) if src in raw.columns else F.lit(None).cast(dtype)
        return (finite(c) if dtype == "double" else c).alias(dst)

    return raw.select("symbol", *[pick(s, d) for s, d in FIELDS.items()])


def value_parts() -> list[Column]:
    pos = lambda c: F.when(C(c) > 0, C(c))
    return [
        band(pos("pe"), [(10, 100), (15, 85), (20, 70), (25, 55), (35, 35), (50, 20)], 5),
        band(pos("pb"), [(1, 100), (2, 80), (3, 65), (5, 45), (8, 25)], 10),
        band(pos("ps"), [(1, 100), (2, 82), (4, 65), (7, 45), (12, 25)], 10),
        band(pos("ev_ebitda"), [(8, 100), (12, 80), (16, 62), (22, 42), (35, 22)], 8),
        band(pos("peg"), [(1, 100), (1.5, 80), (2, 60), (3, 38)], 15)]


def quality_parts() -> list[Column]:
    pct = lambda c: C(c) * num(100)
    return [
        band(pct("roe"), [(0, 5), (8, 40), (15, 70), (20, 85)], 100),
        band(pct("roa"), [(0, 5), (2, 40), (5, 65), (10, 85)], 100),
        band(pct("profit_margin"), [(0, 5), (5, 45), (10, 65), (20, 85)], 100),
        band(F.when(C("debt_to_equity") >= 0, C("debt_to_equity")), [(30, 100), (80, 80), (150, 55), (250, 30)], 12),
        band("current_ratio", [(1, 30), (1.5, 70), (2, 90)], 100)]


def growth_parts() -> list[Column]:
    pct = lambda c: C(c) * num(100)
    return [band(pct("revenue_growth"), [(0, 20), (10, 60), (20, 85)], 100),
            band(pct("earnings_growth"), [(0, 20), (10, 60), (25, 85)], 100)]


def scores(df: DataFrame) -> DataFrame:
    """value_score, quality_score, growth_score, their blend and the first five reasons."""
    df = df.withColumns({"value_score": rnd(mean_available(value_parts()), 1),
                         "quality_score": rnd(mean_available(quality_parts()), 1),
                         "growth_score": rnd(mean_available(growth_parts()), 1)})
    blend = weighted_mean([(C("quality_score"), 0.40), (C("value_score"), 0.35), (C("growth_score"), 0.25)])
    pct = lambda c: C(c) * num(100)
    pe, pb, peg, de = C("pe"), C("pb"), C("peg"), C("debt_to_equity")
    # fixed output texts
    reasons = present([
        F.when(pct("roe") >= 20, F.concat(F.lit("Sehr hohe Eigenkapitalrendite (ROE "), txt(pct("roe"), 0), F.lit("%)")))
        .when(pct("roe") < 0, F.lit("Negative Eigenkapitalrendite – Verlust")),
        F.when(pct("profit_margin") >= 20, F.concat(F.lit("Hohe Nettomarge ("), txt(pct("profit_margin"), 0), F.lit("%)"))),
        F.when((de >= 0) & (de <= 50), F.lit("Solide Bilanz (wenig Schulden)"))
        .when(de >= 250, F.concat(F.lit("Hohe Verschuldung (D/E "), txt(de, 0), F.lit("%)"))),
        F.when((pe > 0) & (pe <= 15), F.concat(F.lit("Günstiges KGV ("), txt(pe, 0), F.lit(")")))
        .when(pe >= 40, F.concat(F.lit("Hohes KGV ("), txt(pe, 0), F.lit(") – teuer bewertet"))),
        F.when((pb > 0) & (pb <= 1.5), F.concat(F.lit("Kurs-Buchwert niedrig ("), txt(pb, 1), F.lit(")"))),
        F.when((C("ps") > 0) & (C("ps") <= 1.5), F.concat(F.lit("Kurs-Umsatz niedrig ("), txt("ps", 1), F.lit(")"))),
        F.when((C("ev_ebitda") > 0) & (C("ev_ebitda") <= 10),
               F.concat(F.lit("EV/EBITDA attraktiv ("), txt("ev_ebitda", 0), F.lit(")"))),
        F.when((peg > 0) & (peg <= 1), F.concat(F.lit("PEG < 1 ("), txt(peg, 2), F.lit(") – Wachstum günstig bezahlt"))),
        F.when(pct("revenue_growth") >= 20, F.concat(F.lit("Starkes Umsatzwachstum (+"), txt(pct("revenue_growth"), 0), F.lit("%)")))
        .when(pct("revenue_growth") < 0, F.concat(F.lit("Umsatz schrumpft ("), txt(pct("revenue_growth"), 0), F.lit("%)"))),
        F.when(pct("earnings_growth") >= 25, F.concat(F.lit("Starkes Gewinnwachstum (+"), txt(pct("earnings_growth"), 0), F.lit("%)"))),
    ])
    return df.withColumns({"fundamental_score": rnd(blend, 1), "fundamental_reasons": F.slice(reasons, 1, 5)})


def blended_investment() -> Column:
    """45 % trend, 55 % fundamentals; the trend score alone when fundamentals are missing."""
    return F.coalesce(rnd(num(0.45) * C("longterm_score") + num(0.55) * C("fundamental_score"), 1), C("longterm_score"))


def investment(df: DataFrame) -> DataFrame:
    return df.withColumn("investment_score", blended_investment())


def valuation(df: DataFrame) -> DataFrame:
    """Analyst upside, Graham number and margin, FCF yield, rule of 40 (local-currency prices)."""
    price = F.nullif(C("price"), num(0))
    graham = F.when((C("eps") > 0) & (C("bvps") > 0), F.sqrt(num(22.5) * C("eps") * C("bvps")))
    pct = lambda c: rnd(C(c) * num(100), 1)
    return df.withColumns({
        "analyst_upside_pct": F.when(C("target_price") > 0, rnd((div("target_price", price) - num(1)) * num(100), 1)),
        "graham_number": rnd(graham, 2),
        "graham_margin_pct": rnd((div(graham, price) - num(1)) * num(100), 1),
        "fcf_yield_pct": rnd(div("free_cashflow", F.nullif(C("market_cap"), num(0))) * num(100), 1),
        "rule40": rint(C("revenue_growth") * num(100) + div("free_cashflow", F.nullif(C("revenue"), num(0))) * num(100)),
        "roe_pct": pct("roe"), "revenue_growth_pct": pct("revenue_growth"),
        "analyst_mean": rnd("rec_mean", 4), "target_price": rnd("target_price", 4),
        "pe": rnd("pe", 4), "forward_pe": rnd("forward_pe", 4), "earnings_growth": rnd("earnings_growth", 4),
        "beta": rnd("beta", 4),
    })


def magic_formula(fundamentals: DataFrame) -> DataFrame:
    """symbol, magic_score: earnings-yield rank plus return-on-assets rank, best = 100.

    Ties follow `ord`, the input order. The sum of the two ranks is ranked as a share of its largest
    possible value, so that it fills the bins of exact_rank alike however many companies there are.
    """
    f = fundamentals.select("symbol", "ord", F.when(C("enterprise_value") > 0, div("ebitda", "enterprise_value"))
                            .alias("ey"), "roa")
    ey = exact_rank(f.select("symbol", "ord", "ey"), "ey", "ord", "ey_rank", total="ey_n", descending=True, scale=0.1)
    roa = exact_rank(f.select("ord", "roa"), "roa", "ord", "roa_rank", total="roa_n", descending=True, scale=0.1)
    both = ey.join(roa, "ord").where("ey_rank is not null and roa_rank is not null").select(
        "symbol", "ord", div(C("ey_rank") + C("roa_rank"), C("ey_n") + C("roa_n")).alias("rank_share"))
    out = exact_rank(both, "rank_share", "ord", "i", total="n", scale=0.5)
    return out.select("symbol", rnd(div(num(100) * (C("n") - C("i") + 1), C("n")), 1).alias("magic_score"))


# Canonical line item -> (statement, labels by priority).
LINE_ITEMS = {
    "ni": ("income", ["Net Income", "Net Income Common Stockholders", "Net Income Continuous Operations"]),
    "rev": ("income", ["Total Revenue", "Operating Revenue"]),
    "gp": ("income", ["Gross Profit"]),
    "ebit": ("income", ["EBIT", "Operating Income", "Total Operating Income As Reported"]),
    "ta": ("balance", ["Total Assets"]),
    "ca": ("balance", ["Current Assets", "Total Current Assets"]),
    "cl": ("balance", ["Current Liabilities", "Total Current Liabilities"]),
    "ltd": ("balance", ["Long Term Debt", "Long Term Debt And Capital Lease Obligation"]),
    "sh": ("balance", ["Ordinary Shares Number", "Share Issued", "Common Stock Shares Outstanding"]),
    "re": ("balance", ["Retained Earnings"]),
    "tl": ("balance", ["Total Liabilities Net Minority Interest", "Total Liab", "Total Liabilities"]),
    "cfo": ("cashflow", ["Operating Cash Flow", "Total Cash From Operating Activities",
                         "Cash Flow From Continuing Operating Activities"]),
}


def statements_wide(statements: DataFrame) -> DataFrame:
    """One row per symbol: every canonical item of the latest (_0) and prior (_1) period.

    The first label that is present wins; a present label whose value is missing
    yields NULL rather than falling through to the next label.
    """
    aggs = []
    for period in (0, 1):
        for name, (stmt, labels) in LINE_ITEMS.items():
            prio = F.lit(None).cast("int")
            for i, label in reversed(list(enumerate(labels))):
                prio = F.when(C("item") == label, F.lit(i)).otherwise(prio)
            hit = (C("period_rank") == period) & (C("stmt") == stmt)
            best = F.min_by(finite(C("amount")), F.when(hit, prio))
            aggs.append(best.alias(f"{name}_{period}"))
    return statements.where(C("period_rank") <= 1).groupBy("symbol").agg(*aggs)


def piotroski(wide: DataFrame) -> DataFrame:
    """piotroski 0-9 (NULL when fewer than five tests are computable) and piotroski_n."""
    nz = lambda c: F.nullif(C(c), num(0))
    ratio = lambda a, b, p: div(f"{a}_{p}", nz(f"{b}_{p}"))
    ratio_nz = lambda a, b, p: div(nz(f"{a}_{p}"), nz(f"{b}_{p}"))
    tests = [
        C("ni_0") > 0, C("cfo_0") > 0,
        ratio("ni", "ta", 0) > ratio("ni", "ta", 1),
        C("cfo_0") > C("ni_0"),
        ratio("ltd", "ta", 0) < ratio("ltd", "ta", 1),
        ratio_nz("ca", "cl", 0) > ratio_nz("ca", "cl", 1),
        C("sh_0") <= nz("sh_1") * num(1.01),
        ratio_nz("gp", "rev", 0) > ratio_nz("gp", "rev", 1),
        ratio_nz("rev", "ta", 0) > ratio_nz("rev", "ta", 1)]
    known = F.filter(F.array(*tests), lambda t: t.isNotNull())
    n = F.size(known)
    met = F.size(F.filter(known, lambda t: t))
    return wide.withColumns({"piotroski_n": n, "piotroski": F.when(n >= 5, met)})


def altman(wide: DataFrame) -> DataFrame:
    """altman_z; needs total assets, total liabilities, current items and a market cap."""
    nz = lambda c: F.nullif(C(c), num(0))
    ta, tl = nz("ta_0"), nz("tl_0")
    part = lambda c: F.coalesce(div(c, ta), num(0))
    z = (num(1.2) * div(C("ca_0") - C("cl_0"), ta) + num(1.4) * part("re_0") + num(3.3) * part("ebit_0")
         + num(0.6) * div(nz("market_cap"), tl) + num(1.0) * part("rev_0"))
    return wide.withColumn("altman_z", rnd(z, 2))

