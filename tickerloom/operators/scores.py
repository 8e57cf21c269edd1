"""Technical opportunity scores and expert frameworks (row-wise rules, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.core import (
    band, clamp, div, fmt, mean_available, null, num, points, present, rint, rnd, txt, yes,
)
from tickerloom.operators.indicators import ABOVE_CLOUD, BELOW_CLOUD, IN_CLOUD

C = F.col


def _add(cond: Column, pts: float) -> Column:
    return F.when(yes(cond), num(pts))


def daytrade(df: DataFrame) -> DataFrame:
    """Adds daytrade_score (0-100), daytrade_direction and daytrade_reasons."""
    price, rvol, rsi, atrp, dr = C("price"), C("rvol"), C("rsi"), C("atr_pct"), C("daily_return")
    h, hp = C("macd_hist"), C("macd_hist_prev")
    breakout, breakdown = yes(price > C("high20")), yes(price < C("low20"))
    cross_up, cross_dn = yes((h > 0) & (hp <= 0)), yes((h < 0) & (hp >= 0))
    oversold, overbought = yes(rsi <= 30), yes(rsi >= 70)
    wide, narrow = yes(atrp >= 2), yes(atrp < 0.8)
    big = yes(F.abs(dr) >= 0.03)
    score = points([
        F.when(yes(rvol >= 1.5), F.least(num(25), (rvol - num(1)) * num(20))),
        _add(breakout, 20), _add(breakdown, 20), _add(cross_up | cross_dn, 15),
        _add(oversold | overbought, 12), _add(wide, 8), _add(narrow, -5), _add(big, 10)])
    count = lambda *cs: sum((c.cast("int") for c in cs), F.lit(0))
    longs = count(breakout, cross_up, oversold, big & (dr > 0))
    shorts = count(breakdown, cross_dn, overbought, big & (dr <= 0))
    # fixed output texts
    reasons = present([
        F.when(yes(rvol >= 1.5), F.concat(F.lit("Hohes relatives Volumen (RVOL "), txt(rvol, 1),
                                          F.lit("×) – ungewöhnliches Marktinteresse"))),
        F.when(breakout, F.concat(F.lit("Ausbruch über 20-Tage-Hoch ("), txt("high20", 2), F.lit(") – Long-Momentum"))),
        F.when(breakdown, F.concat(F.lit("Bruch unter 20-Tage-Tief ("), txt("low20", 2), F.lit(") – Short-Momentum"))),
        F.when(cross_up, F.lit("MACD dreht bullisch (Histogramm kreuzt über Null)"))
        .when(cross_dn, F.lit("MACD dreht bärisch (Histogramm kreuzt unter Null)")),
        F.when(oversold, F.concat(F.lit("RSI überverkauft ("), txt(rsi, 0), F.lit(") – Erholungschance")))
        .when(overbought, F.concat(F.lit("RSI überkauft ("), txt(rsi, 0), F.lit(") – Rücksetzer-Chance (Short)"))),
        F.when(wide, F.concat(F.lit("Genug Tagesvolatilität (ATR "), txt(atrp, 1), F.lit("%) für eine Trading-Range")))
        .when(narrow, F.concat(F.lit("Sehr niedrige Volatilität (ATR "), txt(atrp, 1), F.lit("%) – wenig Bewegung"))),
        F.when(big, F.concat(F.lit("Kräftige Tagesbewegung ("), txt(dr * num(100), 1, True), F.lit("%)"))),
    ])
    direction = (F.when((longs == 0) & (shorts == 0), F.lit("NEUTRAL"))
                 .when(longs >= shorts, F.lit("LONG")).otherwise(F.lit("SHORT")))
    return df.withColumns({"daytrade_score": rnd(clamp(score, 0, 100), 1), "daytrade_direction": direction,
                           "daytrade_reasons": reasons})


def longterm_score() -> Column:
    price, s50, s200, rsi = C("price"), C("sma50"), C("sma200"), C("rsi")
    pfh, r60 = C("pct_from_high52"), C("ret_60d")
    dist = (div(price, s50) - num(1)) * num(100)
    return rnd(clamp(points([
        F.when(price > s200, num(25)).when(s200.isNotNull(), num(-10)),
        _add(s50 > s200, 15),
        F.when(rsi.between(40, 55), num(20)).when(rsi < 40, num(10)).when(rsi > 70, num(-10)),
        _add((price > s200) & dist.between(-3, 3), 15),
        F.when(pfh.between(-15, -3), num(10)).when(pfh <= -40, num(5)),
        F.when(r60 > 0, F.least(num(10), r60 / num(3))),
        _add(C("macd") > C("macd_signal"), 5)]), 0, 100), 1)


def longterm(df: DataFrame) -> DataFrame:
    """Adds longterm_score (0-100) and longterm_reasons."""
    price, s50, s200, rsi = C("price"), C("sma50"), C("sma200"), C("rsi")
    pfh, r60 = C("pct_from_high52"), C("ret_60d")
    dist = (div(price, s50) - num(1)) * num(100)
    # fixed output texts
    reasons = present([
        F.when(price > s200, F.lit("Kurs über 200-Tage-Linie – langfristiger Aufwärtstrend intakt"))
        .when(s200.isNotNull(), F.lit("Kurs unter 200-Tage-Linie – Trend angeschlagen")),
        F.when(s50 > s200, F.lit("Golden-Cross-Struktur (SMA50 über SMA200)")),
        F.when(rsi.between(40, 55), F.concat(F.lit("Gesunder Rücksetzer (RSI "), txt(rsi, 0),
                                             F.lit(") – attraktiver Einstieg statt überkauft")))
        .when(rsi < 40, F.concat(F.lit("RSI niedrig ("), txt(rsi, 0), F.lit(") – möglicher Boden, aber Trend prüfen")))
        .when(rsi > 70, F.concat(F.lit("RSI überkauft ("), txt(rsi, 0), F.lit(") – schlechter Langfrist-Einstieg"))),
        F.when((price > s200) & dist.between(-3, 3),
               F.lit("Kurs testet die 50-Tage-Linie im Aufwärtstrend – klassischer Einstiegspunkt")),
        F.when(pfh.between(-15, -3), F.concat(txt(F.abs(pfh), 0), F.lit(
            "% unter 52-Wochen-Hoch – Luft nach oben, aber nahe der Stärke")))
        .when(pfh <= -40, F.concat(txt(F.abs(pfh), 0), F.lit("% unter 52-Wochen-Hoch – tief, spekulativer Turnaround"))),
        F.when(r60 > 0, F.concat(F.lit("Positives 3-Monats-Momentum ("), txt(r60, 0, True), F.lit("%)"))),
        F.when(C("macd") > C("macd_signal"), F.lit("MACD über Signallinie – Momentum stützt")),
    ])
    return df.withColumns({"longterm_score": longterm_score(), "longterm_reasons": reasons})


def minervini(df: DataFrame) -> DataFrame:
    """Trend template: eight checks, only evaluable ones count."""
    price, s50, s150, s200 = C("price"), C("sma50"), C("sma150"), C("sma200")
    # fixed output texts
    checks = [
        ((price > s150) & (price > s200), price.isNotNull() & s150.isNotNull() & s200.isNotNull(),
         F.lit("Kurs über 150- & 200-Tage-Linie")),
        (s150 > s200, s150.isNotNull() & s200.isNotNull(), F.lit("150-Tage über 200-Tage-Linie")),
        (s200 > C("sma200_1m_ago"), s200.isNotNull() & C("sma200_1m_ago").isNotNull(), F.lit("200-Tage-Linie steigt")),
        ((s50 > s150) & (s50 > s200), s50.isNotNull() & s150.isNotNull() & s200.isNotNull(),
         F.lit("50-Tage über 150- & 200-Tage")),
        (price > s50, price.isNotNull() & s50.isNotNull(), F.lit("Kurs über 50-Tage-Linie")),
        (C("pct_above_low52") >= 30, C("pct_above_low52").isNotNull(), F.lit("≥30 % über 52-Wochen-Tief")),
        (C("pct_from_high52") >= -25, C("pct_from_high52").isNotNull(), F.lit("≤25 % unter 52-Wochen-Hoch")),
        (C("rs_rating") >= 70, C("rs_rating").isNotNull(),
         fmt("Relative Stärke stark (RS %d)", C("rs_rating"))),
    ]
    met = present([F.when(known & c, label) for c, known, label in checks])
    failed = present([F.when(known & ~c, label) for c, known, label in checks])
    df = df.withColumns({"minervini_met": met, "minervini_failed": failed})
    total = F.size("minervini_met") + F.size("minervini_failed")
    return df.withColumn("minervini_score", rint(div(F.size("minervini_met"), total) * num(100)))


# Stage number -> label.
STAGE_LABELS = {1: "Phase 1 – Bodenbildung (beobachten)", 2: "Phase 2 – Aufwärtstrend (kaufen/halten)",
                3: "Phase 3 – Topbildung (Gewinne sichern)", 4: "Phase 4 – Abwärtstrend (meiden)"}


def weinstein(df: DataFrame) -> DataFrame:
    """Stage 1-4 from the slope of the 150-day average and the price position."""
    price, ma = C("price"), C("sma150")
    slope = F.coalesce(div(ma - C("sma150_1m_ago"), ma), num(0))
    stage = F.when(price.isNotNull() & ma.isNotNull(),
                   F.when((price > ma) & (slope > 0.005), 2).when((price < ma) & (slope < -0.005), 4)
                   .when((price >= ma) & (slope <= 0.005), 3).otherwise(1))
    label = F.lit(None).cast("string")
    for k, text in STAGE_LABELS.items():
        label = F.when(C("weinstein_stage") == k, F.lit(text)).otherwise(label)
    return df.withColumn("weinstein_stage", stage).withColumn("weinstein_label", label)


def _either(c: Column, yes_: float, no_: float) -> Column:
    return F.when(c.isNotNull(), F.when(c, num(yes_)).otherwise(num(no_)))


def subscores(df: DataFrame) -> DataFrame:
    """tech_trend, tech_momentum and tech_volume, each a rounded mean of its available parts."""
    price, s50, s200 = C("price"), C("sma50"), C("sma200")
    strong = band(C("adx"), [(15, 40), (25, 65), (40, 85)], 100)
    h, hp = C("macd_hist"), C("macd_hist_prev")
    trend = [
        F.when(C("plus_di") >= C("minus_di"), strong).when(C("plus_di") < C("minus_di"), num(100) - strong),
        F.when(price.isNotNull() & s50.isNotNull() & s200.isNotNull(),
               F.when((price > s50) & (s50 > s200), num(100)).when(price > s200, num(70)).otherwise(num(25))),
        _either(C("ema9_above_21"), 75, 25),
        F.when(C("ichimoku") == ABOVE_CLOUD, num(90)).when(C("ichimoku") == IN_CLOUD, num(50))
        .when(C("ichimoku") == BELOW_CLOUD, num(15)),
        _either(C("supertrend_up"), 80, 20), _either(C("psar_bull"), 70, 30)]
    momentum = [
        band("rsi", [(30, 30), (45, 55), (60, 80), (70, 65)], 40),
        band("stoch_k", [(20, 30), (50, 60), (80, 80)], 45),
        band("williams_r", [(-80, 30), (-50, 60), (-20, 80)], 45),
        band("cci", [(-100, 30), (0, 55), (100, 80)], 55),
        band("roc10", [(-5, 30), (0, 50), (5, 70)], 85),
        F.when(h.isNotNull() & hp.isNotNull(),
               F.when((h > 0) & (h > hp), num(80)).when(h > 0, num(60)).otherwise(num(30))),
        band(C("aroon_up") - C("aroon_down"), [(-50, 25), (0, 50), (50, 75)], 90)]
    volume = [
        _either(C("obv_rising"), 75, 30),
        band("mfi", [(20, 30), (50, 60), (80, 80)], 45),
        band("cmf", [(-0.1, 30), (0, 50), (0.1, 70)], 85),
        band("rvol", [(0.7, 40), (1.2, 60), (2, 80)], 90)]
    return df.withColumns({"tech_trend": rint(mean_available(trend)), "tech_momentum": rint(mean_available(momentum)),
                           "tech_volume": rint(mean_available(volume))})
