"""Composite rating: ELO, quality, potential, trend phase, risk flags, entry timing.

Every function adds columns to a row-per-symbol DataFrame whose numeric features are
already rounded. German texts are fixed outputs; rules test the code columns
(`regime`, `phase_code`, `downside_risk`), not the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.core import (
    band, clamp, div, fmt, int_txt, null, num, points, present, rint, rnd, txt, weighted_mean, yes,
)

C = F.col
LONG, SHORT = "LONG", "SHORT"


def _is(c: str, value: str) -> Column:
    return yes(C(c) == value)


def _zero(c: str) -> Column:
    return F.coalesce(C(c), F.lit(0))


def analysts(n: int = 3) -> Column:
    return yes(C("analyst_n") >= n)


# Lower ELO bound, label, colour.
ELO_LABELS = [(1950, "Top-Chance", "#16a34a"), (1800, "Stark", "#65a30d"), (1650, "Solide", "#ca8a04"),
              (1500, "Neutral", "#6b7280"), (1350, "Schwach", "#ea580c")]
AVOID = ("Meiden", "#dc2626")


def elo(df: DataFrame) -> DataFrame:
    """elo (700-2200, steps of 5), elo_label, elo_color, elo_score (0-100), stars (0-5)."""
    base = F.coalesce(C("investment_score"), F.nullif(C("longterm_score"), num(0)), num(50))
    dt = F.coalesce(C("daytrade_score"), num(0))
    z = C("altman_z")
    raw = num(1000) + base * num(10) + points([
        F.when(_is("daytrade_direction", LONG) & (dt > 40), F.least(num(80), (dt - num(40)) * num(2)))
        .when(_is("daytrade_direction", SHORT) & (dt > 40), -F.least(num(60), (dt - num(40)) * num(1.5))),
        F.when(_is("holder_stance", "LONG"), num(60)).when(_is("holder_stance", "SHORT_BET"), num(-70)),
        F.when(yes(C("news_n") >= 2), clamp((C("news_score") - num(50)) * num(1.4), -55, 55)),
        F.when(yes(C("hype_surging")) & C("hype_score").isNotNull(), F.least(num(40), C("hype_score") * num(0.4))),
        F.when(analysts(), clamp(C("analyst_upside_pct") * num(0.55), -22, 28)),
        F.when(analysts(), clamp((num(3) - C("analyst_mean")) * num(9), -18, 18)),
        (C("minervini_score") - num(50)) * num(0.4),
        (C("piotroski") - num(4.5)) * num(7),
        F.when(z < 1.81, num(-45)).when(z > 2.99, num(12)),
        F.when(C("weinstein_stage") == 4, num(-30)).when(C("weinstein_stage") == 2, num(15)),
        C("macro_pts"), C("volume_pts")])
    df = df.withColumn("elo", (rint(clamp(raw, 700, 2200) / num(5)) * 5).cast("int"))
    label, color = F.lit(AVOID[0]), F.lit(AVOID[1])
    for bound, name, tint in reversed(ELO_LABELS):
        label = F.when(C("elo") >= bound, F.lit(name)).otherwise(label)
        color = F.when(C("elo") >= bound, F.lit(tint)).otherwise(color)
    df = df.withColumns({"elo_label": label, "elo_color": color,
                         "elo_score": clamp(rint((C("elo") - num(1000)) / num(10)), 0, 100).cast("int")})
    return df.withColumn("stars", rint(C("elo_score") / num(20)))


def quality(df: DataFrame) -> DataFrame:
    return df.withColumn("quality", rint(weighted_mean([
        (C("fundamental_score"), 0.5), (C("longterm_score"), 0.3),
        (F.when(analysts(), clamp((num(5) - C("analyst_mean")) / num(4) * num(100), 0, 100)), 0.1),
        (C("piotroski") / num(9) * num(100), 0.25)])))


def direction_sign() -> Column:
    return F.when(_is("daytrade_direction", LONG), 1).when(_is("daytrade_direction", SHORT), -1).otherwise(0)


def potential(df: DataFrame) -> DataFrame:
    return df.withColumn("potential", rint(weighted_mean([
        (F.when(analysts(), clamp(num(50) + C("analyst_upside_pct") * num(1.25), 0, 100)), 0.22),
        (clamp(num(50) + (C("daytrade_score") - num(50)) * direction_sign(), 0, 100), 0.2),
        (clamp(num(50) - C("pct_from_high52"), 0, 100), 0.18),
        (C("growth_score"), 0.28),
        (F.when(yes(C("hype_surging")), num(80)), 0.1)])))


def hist_rising() -> Column:
    return yes(C("macd_hist") > C("macd_hist_prev"))


def timing_helpers(df: DataFrame) -> DataFrame:
    """regime (up/down/neutral), extension_pct and momentum_turn (0-100)."""
    stage, lt = C("weinstein_stage"), C("longterm_score")
    p, m, mp = C("price"), C("sma150"), C("sma150_1m_ago")
    up = yes(stage == 2) | yes(lt >= 62) | yes((p > m) & (m > mp))
    down = yes(stage == 4) | yes(lt <= 30) | yes((p < m) & (m < mp))
    ref = F.coalesce("sma20", "sma50")
    k, d, h, hp = C("stoch_k"), C("stoch_d"), C("macd_hist"), C("macd_hist_prev")
    turn = num(50) + points([
        F.when(h > hp, num(18)).when(h <= hp, num(-18)),
        F.when((h > 0) & hp.isNotNull(), num(6)),
        F.when(_is("daytrade_direction", LONG), num(16)).when(_is("daytrade_direction", SHORT), num(-16)),
        F.when(p > C("ema9"), num(8)).when(p <= C("ema9"), num(-8)),
        F.when((k > d) & (k < 45), num(10)).when((k < d) & (k > 70), num(-8))])
    return df.withColumns({
        "regime": F.when(down & ~up, F.lit("down")).when(up & ~down, F.lit("up")).otherwise(F.lit("neutral")),
        "extension_pct": F.when(ref > 0, (div(p, ref) - num(1)) * num(100)),
        "momentum_turn": clamp(turn, 0, 100)})


SUPPORT_LEVELS = ("sma20", "sma50", "sma150", "sma200", "pivot", "pivot_s1", "low20", "low52", "ema21")


def supports(df: DataFrame) -> DataFrame:
    """Distinct support levels below the price, nearest first; levels within 1.5 % of the last kept one merge."""
    p = C("price")
    below = F.filter(F.array(*[C(c) for c in SUPPORT_LEVELS]), lambda x: x.isNotNull() & (x > 0) & (x < p))
    distinct = F.reverse(F.array_sort(F.array_distinct(F.transform(below, lambda x: F.bround(x, 2)))))

    def keep(acc: Column, x: Column) -> Column:
        near = F.abs(F.element_at(acc, -1) / x - num(1)) > 0.015
        return F.when((F.size(acc) == 0) | near, F.concat(acc, F.array(x))).otherwise(acc)

    merged = F.aggregate(distinct, F.array().cast("array<double>"), keep)
    return df.withColumn("supports", F.coalesce(merged, F.array().cast("array<double>")))


# Fixed output texts of the downside analysis.
DOWNSIDE_TEXT = {
    "trend": "Abwärtstrend intakt – ein weiterer Rückgang ist wahrscheinlicher als ein Boden.",
    "floor": "nahe einer starken Unterstützung und Momentum dreht – ein Boden ist wahrscheinlicher.",
    "near": "dicht an einer Unterstützung – dort erst Stabilisierung abwarten.",
    "air": "viel Luft nach unten bis zur nächsten Unterstützung – erhöhtes Rückschlagrisiko.",
    "buffer": "moderater Puffer bis zur nächsten Unterstützung.",
}


def downside(df: DataFrame) -> DataFrame:
    """support1/2 with distances, downside_risk (gering/mittel/hoch) and downside_verdict."""
    p = C("price")
    s1, s2 = F.get("supports", 0), F.get("supports", 1)
    room = (div(p, s1) - num(1)) * num(100)
    atrp = F.coalesce(F.nullif(C("atr_pct"), num(0)), num(3))
    turning = hist_rising() & ~_is("daytrade_direction", SHORT)
    near = yes(room <= num(1.5) * atrp)
    case = (F.when((C("regime") == "down") & ~turning, F.lit("trend"))
            .when(near & turning & (C("regime") != "down"), F.lit("floor"))
            .when(near, F.lit("near")).when(room > num(3) * atrp, F.lit("air")).otherwise(F.lit("buffer")))
    df = df.withColumns({
        "_case": F.when(p.isNotNull(), case), "_turning": turning,
        "support1": s1, "support1_pct": rnd(-room, 1),
        "support2": s2, "support2_pct": rnd(-(div(p, s2) - num(1)) * num(100), 1)})
    verdict = F.lit(None).cast("string")
    for k, text in DOWNSIDE_TEXT.items():
        verdict = F.when(C("_case") == k, F.lit(text)).otherwise(verdict)
    risk = (F.when(C("_case") == "trend", F.lit("hoch")).when(C("_case") == "floor", F.lit("gering"))
            .when((C("_case") == "air") & ~C("_turning"), F.lit("hoch")).when(C("_case").isNotNull(), F.lit("mittel")))
    return df.withColumns({"downside_risk": risk, "downside_verdict": verdict}).drop("_case", "_turning")


def falling_knife(df: DataFrame) -> DataFrame:
    """knife_warn: a steep drop that has not stabilised, else NULL."""
    fast, slow = yes(C("ret_5d") <= -8), yes(C("ret_20d") <= -15)
    falling = _is("daytrade_direction", SHORT) | ~hist_rising() | yes(C("price") < C("ema9"))
    hit = (fast | slow) & falling & yes(C("price") < C("sma20"))
    text = F.concat(
        F.lit("🔪 Fallendes Messer: Kurs stürzt aktuell steil ("),
        txt(F.when(fast, C("ret_5d")).otherwise(C("ret_20d")), 0), F.lit("% "),
        F.when(fast, F.lit("in 1 Woche")).otherwise(F.lit("in 1 Monat")),
        F.lit(") und hat sich noch nicht stabilisiert – nicht hineingreifen, erst einen Boden/Aufwärts-Dreh abwarten."))
    return df.withColumn("knife_warn", F.when(hit, text))


def bottoming(df: DataFrame) -> DataFrame:
    """bottoming_n / _strength / _signals: at least four turn-up signals after a real decline, not a knife."""
    declined = yes(C("pct_from_high52") <= -20) | yes(C("ret_60d") <= -20) | yes(C("ret_20d") <= -12)
    k, d = C("stoch_k"), C("stoch_d")
    # fixed output texts
    signals = present([F.when(c, F.lit(t)) for c, t in [
        (C("price") > C("low20") * num(1.03), "keine neuen Tiefs"),
        (C("price") > C("ema9"), "über EMA9"),
        (hist_rising(), "MACD dreht hoch"),
        ((k > d) & (k < 45), "Stochastik-Kreuz"),
        (C("rsi").between(32, 52), "RSI erholt sich"),
        (_is("daytrade_direction", LONG), "Käufer aktiv"),
        (C("bb_bandwidth") < 12, "Schwankung beruhigt sich"),
        (C("aroon_up") > C("aroon_down"), "Aroon dreht")]])
    df = df.withColumn("_sig", signals)
    hit = C("knife_warn").isNull() & declined & (F.size("_sig") >= 4)
    return df.withColumns({
        "bottoming_n": F.when(hit, F.size("_sig")),
        "bottoming_strength": F.when(hit, F.least(F.lit(100), F.lit(40) + F.size("_sig") * 8)),
        "bottoming_signals": F.when(hit, C("_sig"))}).drop("_sig")


# Fixed output texts: phase code -> (phase, tone).
PHASES = {
    "down": ("Abwärtstrend", "down"), "late": ("Spätphase (Top-Gefahr)", "soon"),
    "early_up": ("früher Aufwärtstrend", "up"), "mid_up": ("Aufwärtstrend (mittendrin)", "up"),
    "base": ("Bodenbildung (früh)", "soon"), "sideways": ("Seitwärts / unklar", "soon"),
}


def trend_phase(df: DataFrame) -> DataFrame:
    """phase_code, phase, phase_tone and phase_sell (when selling gets critical)."""
    stage, rsi, s50, h = C("weinstein_stage"), C("rsi"), C("sma50"), C("macd_hist")
    ext = F.when(s50 > 0, (div("price", s50) - num(1)) * num(100))
    late = yes(rsi >= 75) | yes(ext >= 22) | yes((h < 0) & (stage == 2) & (rsi > 60))
    code = (F.when(stage == 4, F.lit("down")).when((stage == 3) | ((stage == 2) & late), F.lit("late"))
            .when((stage == 2) & yes((ext < 6) & (rsi < 62)), F.lit("early_up")).when(stage == 2, F.lit("mid_up"))
            .when(stage == 1, F.lit("base")).otherwise(F.lit("sideways")))
    df = df.withColumn("phase_code", code)
    code = C("phase_code")
    up_text = F.concat(F.lit("kritisch, sobald der Kurs unter die 50-Tage-Linie"),
                       F.coalesce(F.concat(F.lit(" ($"), txt(s50, 2), F.lit(")")), F.lit("")),
                       F.lit(" fällt (Trendbruch)"))
    sell = (F.when(code == "down", F.lit("bereits im Abwärtstrend – für Käufe meiden, kein Halten"))
            .when(code == "late", F.concat(
                F.lit("überkauft/überdehnt ("),
                F.coalesce(F.concat(F.lit("RSI "), txt(rsi, 0)), F.lit("überdehnt")),
                F.lit(") – Teilverkauf oder engen Trailing-Stop erwägen")))
            .when(code.isin("early_up", "mid_up"), up_text)
            .when(code == "base", F.lit("noch kein Trend – erst den Ausbruch abwarten"))
            .otherwise(F.lit("kein klarer Trend – nur mit engem Stop")))
    ed = C("earnings_in_days")
    note = F.when(ed.between(0, 5) & stage.isin(2, 3), F.concat(
        F.lit(" · Zahlen in "), int_txt(ed), F.lit(" T.: „buy the rumor, sell the news\"-Risiko")))
    phase, tone = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (p, t) in PHASES.items():
        phase = F.when(code == k, F.lit(p)).otherwise(phase)
        tone = F.when(code == k, F.lit(t)).otherwise(tone)
    return df.withColumns({"phase": phase, "phase_tone": tone,
                           "phase_sell": F.concat(sell, F.coalesce(note, F.lit("")))})


def _damped(score: Column) -> Column:
    """Very swingy names get a lower entry score."""
    atrp, beta = C("atr_pct"), C("beta")
    less = points([F.when(atrp > 4, -F.least(num(22), (atrp - num(4)) * num(2.5))),
                   F.when(beta > 1.6, -F.least(num(10), (beta - num(1.6)) * num(8)))])
    return F.bround(clamp(score + less, 0, 100), 0)


def entry(df: DataFrame) -> DataFrame:
    """entry_score (0-100), entry_label, entry_tone and entry_reason.

    Needs timing_helpers, supports, trend_phase, falling_knife and bottoming.
    """
    rsi, atrp, bot = C("rsi"), C("atr_pct"), C("bottoming_n")
    has_bot = bot.isNotNull()
    short = _is("daytrade_direction", SHORT)
    parts = weighted_mean([
        (band("extension_pct", [(-6, 55), (0, 88), (4, 92), (9, 74), (16, 52), (30, 32)], 18), 0.28),
        (band(rsi, [(30, 55), (40, 82), (52, 90), (60, 70), (68, 48), (75, 28)], 15), 0.24),
        (C("momentum_turn"), 0.28), (C("longterm_score"), 0.12), (C("value_score"), 0.08)])
    room = (div("price", F.get("supports", 0)) - num(1)) * num(100)
    adjusted = parts + points([
        F.when(short, num(-18)), F.when(C("regime") == "neutral", num(-6)),
        F.when(yes(C("hype_surging")) & (rsi > 68), num(-12)),
        F.when(atrp > 0, F.when(room <= num(1.2) * atrp, num(8)).when(room >= num(4) * atrp, num(-8)))])
    df = df.withColumn("_e1", adjusted)
    capped = (F.when(C("knife_warn").isNotNull(), F.least(C("_e1"), num(15)))
              .when(C("phase_code") == "down", F.least(C("_e1"), F.when(has_bot, num(52)).otherwise(num(25))))
              .when(C("phase_code") == "late", F.least(C("_e1"), num(44))).otherwise(C("_e1")))
    df = df.withColumn("_e2", capped)
    short_capped = F.when(short & ~has_bot, F.least(C("_e2"), num(41))).otherwise(C("_e2"))
    df = df.withColumn("_e3", _damped(short_capped + F.coalesce(F.least(num(14), bot * num(2)), num(0))))
    clamped = F.when(has_bot, F.greatest(F.least(C("_e3"), num(66)), F.least(num(66), num(42) + bot * num(3))))
    rebound = _damped(F.when(yes(rsi < 30) & hist_rising(), num(34)).otherwise(num(20)))
    score = (F.when(C("price").isNull(), null())
             .when((C("regime") == "down") & ~has_bot, rebound)
             .otherwise(F.coalesce(clamped, C("_e3"))))
    df = df.withColumn("entry_score", score.cast("int")).drop("_e1", "_e2", "_e3")
    es = C("entry_score")
    # fixed output texts
    label = (F.when(es.isNull(), F.lit("–")).when(es >= 70, F.lit("sehr gut")).when(es >= 55, F.lit("gut"))
             .when(es >= 45, F.lit("okay")).when(es >= 32, F.lit("eher abwarten"))
             .otherwise(F.lit("schlecht (teuer/heiß)")))
    tone = (F.when(es.isNull(), F.lit("calm")).when(es >= 55, F.lit("up")).when(es >= 32, F.lit("soon"))
            .otherwise(F.lit("down")))
    turning = hist_rising() | _is("daytrade_direction", LONG)
    ext = C("extension_pct")
    reason = (
        F.when(C("price").isNull(), F.lit(""))
        .when((C("regime") == "down") & yes(rsi < 30) & turning,
              F.lit("Abwärtstrend, aber stark überverkauft und dreht – nur spekulativer Rebound"))
        .when(C("regime") == "down", F.lit("Abwärtstrend – Rücksetzer sind Fallende-Messer-Risiko, besser meiden"))
        .when(rsi >= 72, F.lit("heißgelaufen (überkauft) – besser einen Rücksetzer abwarten"))
        .when(ext > 15, F.lit("weit über dem Durchschnitt (gestreckt) – nicht hinterherlaufen"))
        .when(short, F.lit("kurzfristig noch fallend – auf Stabilisierung/Dreh nach oben warten"))
        .when(ext.between(-4, 8) & turning,
              F.lit("gesunder Rücksetzer im Aufwärtstrend, Momentum dreht – günstiges Fenster"))
        .when((rsi < 35) & turning, F.lit("stark abverkauft und dreht nach oben – spekulativer Rebound"))
        .when(turning, F.lit("Momentum dreht nach oben – Einstieg wird interessanter"))
        .otherwise(F.lit("kein klares Einstiegssignal – abwarten oder nur klein antesten")))
    return df.withColumns({"entry_label": label, "entry_tone": tone, "entry_reason": reason})


# Keywords of boom-bust industries.
CYCLICAL = ("semiconductor", "memory", "material", "metal", "mining", "steel", "copper", "aluminum", "gold",
            "silver", "chemical", "energy", "oil", "gas", "auto", "automobile", "airline", "shipping",
            "homebuild", "construction", "paper", "packaging")
PEAK_TEXT = "⚠️ Spitzenzyklus möglich – Gewinne evtl. nicht dauerhaft"
TIMING_TEXT = "⚠️ Langfristig positiv, aber kurzfristig fallend – Timing schlecht"


def risk_warnings(df: DataFrame) -> DataFrame:
    """risk_warnings array plus the boolean peak_warning behind its first entry."""
    text = F.lower(F.concat_ws(" ", F.coalesce("sector", F.lit("")), F.coalesce("industry", F.lit(""))))
    cyclical = F.lit(False)
    for word in CYCLICAL:
        cyclical = cyclical | F.contains(text, F.lit(word))
    fpe = C("forward_pe")
    peak = (yes(C("earnings_growth") >= 0.4) | yes(C("growth_score") >= 85)
            | yes((fpe > 0) & (fpe < C("pe") * num(0.6))))
    timing = ((yes(C("investment_score") >= 58) | yes(C("longterm_score") >= 62))
              & _is("daytrade_direction", SHORT))
    df = df.withColumn("peak_warning", cyclical & peak)
    return df.withColumn("risk_warnings", present([
        F.when(C("peak_warning"), F.lit(PEAK_TEXT)), F.when(timing, F.lit(TIMING_TEXT))]))


def _sign(c: Column, hi: float, lo: float) -> Column:
    return F.when(c >= hi, num(1)).when(c <= lo, num(-1)).when(c.isNotNull(), num(0))


def conviction(df: DataFrame) -> DataFrame:
    """Agreement of the available signals, 50-95."""
    signs = [
        _sign(C("longterm_score"), 55, 45), _sign(C("fundamental_score"), 60, 40),
        F.when(analysts(), _sign(C("analyst_upside_pct"), 10, -5)),
        F.when(yes(C("news_n") >= 2), _sign(C("news_score"), 60, 40)),
        F.when(yes(C("daytrade_score") >= 45), direction_sign().cast("double"))]
    count = sum((s.isNotNull().cast("int") for s in signs), F.lit(0))
    net = div(F.abs(points(signs)), count)
    return df.withColumn("conviction", F.coalesce(rint(num(50) + net * num(45)), F.lit(50)))


def urgency(df: DataFrame) -> DataFrame:
    dt, ed = F.coalesce(C("daytrade_score"), num(0)), C("earnings_in_days")
    directed = yes(C("daytrade_direction").isin(LONG, SHORT))
    tone = (F.when((directed & (dt >= 55)) | yes(C("hype_surging")) | yes(ed.between(0, 2)), F.lit("urgent"))
            .when((dt >= 45) | yes(ed.between(0, 7)), F.lit("soon")).otherwise(F.lit("calm")))
    df = df.withColumn("urgency_tone", tone)
    # fixed output texts
    return df.withColumn("urgency", F.when(C("urgency_tone") == "urgent", F.lit("⏱️ Sofort (heute)"))
                         .when(C("urgency_tone") == "soon", F.lit("📅 Diese Woche"))
                         .otherwise(F.lit("🧘 In Ruhe (Langzeit)")))


def volume_signal(df: DataFrame) -> DataFrame:
    """volume_pts and volume_note for sudden unusual volume."""
    rvol, dret = C("rvol"), C("daily_return_pct")
    strong = yes(rvol >= 1.8)
    extra = F.bround((rvol - num(1.8)) * num(5), 0) + num(5)
    up, down = strong & yes(dret >= 1), strong & yes(dret <= -1)
    pts = F.when(up, F.least(num(12), extra)).when(down, -F.least(num(12), extra)).otherwise(num(0))
    x = F.concat(F.bround(rvol, 1).cast("string"), F.lit("× normal) "))
    note = (F.when(up, F.concat(F.lit("🔊 Ungewöhnlich hohes Volumen ("), x, F.lit("bei +"), txt(dret, 1),
                                F.lit("% – Käufer aktiv (Akkumulation)")))
            .when(down, F.concat(F.lit("🔊 Ungewöhnlich hohes Volumen ("), x, F.lit("bei "), txt(dret, 1),
                                 F.lit("% – Verkaufsdruck (Distribution)")))
            .when(strong, F.concat(F.lit("🔊 Erhöhtes Volumen ("), x, F.lit("– gesteigerte Aufmerksamkeit"))))
    return df.withColumns({"volume_pts": pts.cast("int"), "volume_note": note})

