"""Projections, trade plans and the texts built on top of the rating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.core import clamp, div, fmt, int_txt, null, num, present, rint, rnd, txt, yes
from tickerloom.operators.rating import PEAK_TEXT, _is, analysts, direction_sign

C = F.col

# Horizon label and trading days.
SHORT_HORIZONS = [("1 Tag", 1), ("1 Woche", 5)]
LONG_HORIZONS = [("1 Monat", 21), ("6 Monate", 126), ("12 Monate", 252), ("24 Monate", 504)]


def _projection(mode: str) -> Column:
    trend = F.coalesce(C("investment_score") - num(50), num(0))
    signed = F.coalesce(C("daytrade_score"), num(0)) * direction_sign()
    short = mode == "short"
    bias = signed * num(0.7) + trend * num(0.3) if short else trend + signed * num(0.25)
    signal = clamp(bias * num(0.25), -25, 25)
    upside = C("analyst_upside_pct")
    drift = signal if short else F.coalesce(
        clamp(num(0.4) * clamp(upside, -35, 50) + num(0.6) * signal, -35, 55), signal)
    vol = F.coalesce(F.when(C("vol_daily") > 0, C("vol_daily")), F.when(C("atr_pct") > 0, C("atr_pct") / num(100)))
    direction = (F.when(bias > 12, F.lit("eher aufwärts")).when(bias < -12, F.lit("eher abwärts"))
                 .otherwise(F.lit("eher seitwärts")))
    extra = F.least(num(28), F.abs(bias) * num(0.5))
    base = F.struct(C("price").alias("p"), drift.alias("drift"), vol.alias("vol"), direction.alias("dir"),
                    extra.alias("extra"))
    horizons = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(d).alias("days"))
                         for n, d in (SHORT_HORIZONS if short else LONG_HORIZONS)])

    def one(b: Column, h: Column) -> Column:
        days = h["days"].cast("double")
        center = clamp(b["drift"] * (days / num(252)), -60, 90)
        sigma = b["vol"] * F.sqrt(days) * num(100)
        conf = rint(num(50) + b["extra"] * (num(1) / (num(1) + days / num(45))))
        price = lambda pct: rnd(b["p"] * (num(1) + pct / num(100)), 2)
        return F.struct(
            h["label"].alias("label"), h["days"].alias("days"), b["dir"].alias("direction"),
            rnd(center, 1).alias("center_pct"), price(center).alias("expected_price"),
            rnd(center - sigma, 1).alias("low_pct"), rnd(center + sigma, 1).alias("high_pct"),
            price(center - sigma).alias("low_price"), price(center + sigma).alias("high_price"),
            conf.alias("confidence_pct"),
            F.when(conf >= 68, F.lit("hoch")).when(conf >= 58, F.lit("mittel")).otherwise(F.lit("niedrig"))
            .alias("confidence_label"))

    rows = F.flatten(F.transform(F.array(base), lambda b: F.transform(horizons, lambda h: one(b, h))))
    return F.when((C("price") > 0) & vol.isNotNull(), rows)


def projections(df: DataFrame) -> DataFrame:
    """projection_short / projection_long (arrays of one struct per horizon) and exp_return_12m."""
    df = df.withColumns({"projection_short": _projection("short"), "projection_long": _projection("long")})
    twelve = F.filter("projection_long", lambda x: x["label"].startswith("12"))
    return df.withColumn("exp_return_12m", F.get(twelve, 0)["center_pct"])


def upside(df: DataFrame) -> DataFrame:
    """Analyst upside with at least three analysts, else the 12-month projection."""
    return df.withColumn("upside_pct", F.coalesce(F.when(analysts(), C("analyst_upside_pct")), C("exp_return_12m")))


PLAN_SUPPORTS = ("sma20", "sma50", "sma150", "sma200", "pivot", "pivot_s1", "low20", "ema21", "low52")
PLAN_RESISTANCES = ("sma20", "sma50", "sma150", "sma200", "pivot_r1", "high20", "high52", "ema9")
# Fixed output texts: holding period by estimated trading days.
HOLD_LABELS = [(3, "1–3 Handelstage"), (10, "1–2 Wochen"), (25, "2–5 Wochen"), (65, "1–3 Monate"),
               (130, "3–6 Monate"), (260, "6–12 Monate")]
# Fixed output texts: action code -> (text, tone, when).
ACTIONS = {
    "avoid": ("🚫 Meiden – aktuell kein sauberes Kaufsetup", "neg", "avoid"),
    "knife": ("🔪 Fallendes Messer – nicht greifen, erst Boden/Stabilisierung abwarten", "neg", "dip"),
    "base": ("🟢 Bodenbildung nach Absturz – frühe, spekulative Einstiegschance", "pos", "now"),
    "short": ("📉 Nur für Profis: Wette auf fallende Kurse (Short)", "neg", "short"),
    "buy": ("✅ Jetzt in der Einstiegszone kaufen", "pos", "now"),
    "staged": ("🟡 Gestaffelt kaufen (Teilpositionen)", "neutral", "now"),
    "wait": ("⏳ Zu teuer/heiß – erst auf Rücksetzer in die Kaufzone (unter aktuellem Kurs) warten", "neutral", "dip"),
}


def _first(levels: Column, cond) -> Column:
    return F.get(F.filter(levels, cond), 0)


def trade_plan(df: DataFrame, context: str = "invest") -> DataFrame:
    """Adds trade_plan_long (context "invest") or trade_plan_short (context "trade").

    Stages: levels, near levels, entry and first target, target zone, plan struct;
    each stage names its columns once so nothing is computed twice.
    """
    out = "trade_plan_long" if context == "invest" else "trade_plan_short"
    p, es, bot = C("price"), C("entry_score"), C("bottoming_n")
    level = lambda names: F.array(*[C(x) for x in names])
    atr = F.coalesce(F.when(C("atr") > 0, C("atr")), F.when(C("atr_pct") > 0, C("atr_pct") / num(100) * p),
                     num(0.02) * p)
    is_short = (_is("daytrade_direction", "SHORT") if context == "trade" else F.lit(False))
    lt = F.coalesce(F.nullif(C("longterm_score"), num(0)), num(50))
    keep = df.columns
    d = df.withColumns({
        "_a": F.greatest(atr, num(0.005) * p), "_short": is_short, "_wait": yes(es < 42),
        "_below": F.reverse(F.array_sort(F.filter(level(PLAN_SUPPORTS),
                                                  lambda x: x.isNotNull() & (x > 0) & (x < p)))),
        "_above": F.array_sort(F.filter(level(PLAN_RESISTANCES), lambda x: x.isNotNull() & (x > p))),
        "_avoid": yes(C("altman_z") < 1.81) | yes(C("elo_label") == "Meiden") | (
            bot.isNull() & (yes(C("weinstein_stage") == 4) | yes(C("phase_code") == "down") | (lt < 30))),
    })
    a, short, below, above = C("_a"), C("_short"), C("_below"), C("_above")
    d = d.withColumns({
        "_near_sup": _first(below, lambda s: s >= p - num(2.2) * a),
        "_near_res": _first(above, lambda r: r <= p + num(2.2) * a)})
    sup = C("_near_sup")
    wait_high = F.when(sup < p - num(0.3) * a, sup).otherwise(p - num(0.5) * a)
    d = d.withColumn("_eh", F.when(short, F.greatest(F.coalesce("_near_res", p + a), p + num(0.3) * a))
                     .when(C("_wait"), wait_high)
                     .otherwise(p + F.when(yes(es >= 55), num(0.2) * a).otherwise(num(0))))
    d = d.withColumns({
        "_el": F.when(short, p - num(0.2) * a)
        .when(C("_wait"), F.coalesce(_first(below, lambda s: s < C("_eh") - num(0.1) * a), C("_eh") - num(1.2) * a))
        .otherwise(F.least(F.coalesce(sup, p - a), p - num(0.3) * a)),
        "_t1": F.when(short, F.coalesce(_first(below, lambda s: s <= p - num(2) * a), p - num(3) * a))
        .otherwise(F.coalesce(_first(above, lambda r: r >= p + num(2) * a), p + num(3) * a))})
    t1, tgt = C("_t1"), C("target_price")
    far_up = _first(above, lambda r: r > t1 + num(0.5) * a)
    far_down = _first(below, lambda s: s < t1 - num(0.5) * a)
    lows = F.filter(F.array(t1 - num(2) * a, p - num(6) * a, far_down), lambda x: x > 0)
    d = d.withColumns({
        "_t2": F.when(short, F.coalesce(F.array_min(lows), p * num(0.5)))
        .otherwise(F.greatest(t1 + num(2) * a, p + num(6) * a, F.when(tgt > p, tgt), far_up)),
        "_stop": F.when(short, C("_eh") + a).otherwise(C("_el") - a),
        "_em": (C("_el") + C("_eh")) / num(2)})
    d = d.withColumn("_tm", (t1 + C("_t2")) / num(2))
    em, tm = C("_em"), C("_tm")
    ratio = div(tm, em)
    d = d.withColumns({
        "_pot": F.greatest(F.when(short, (num(1) - ratio) * num(100)).otherwise((ratio - num(1)) * num(100)), num(0)),
        "_risk": F.when(short, div(C("_stop") - em, em)).otherwise(div(em - C("_stop"), em)) * num(100),
        "_days": div(F.abs(tm - em), num(0.35) * a)})
    hold = F.when(yes(C("_days") > 0), F.lit("12–24 Monate")).otherwise(
        F.lit("wenige Tage" if context == "trade" else "einige Monate"))
    for bound, text in reversed(HOLD_LABELS):
        hold = F.when((C("_days") > 0) & (C("_days") <= bound), F.lit(text)).otherwise(hold)
    avoid = C("_avoid") & ~short
    code = (F.when(avoid, F.lit("avoid")).when(C("knife_warn").isNotNull() & ~short, F.lit("knife"))
            .when(bot.isNotNull() & ~short, F.lit("base")).when(short, F.lit("short"))
            .when(es >= 55, F.lit("buy")).when(es >= 42, F.lit("staged")).otherwise(F.lit("wait")))
    d = d.withColumn("_code", code)
    pick = lambda i: F.try_element_at(
        F.create_map(*[F.lit(x) for k, v in ACTIONS.items() for x in (k, v[i])]), C("_code"))
    r2 = lambda x: rnd(x, 2)
    plan = F.struct(
        F.when(short, F.lit("short")).otherwise(F.lit("long")).alias("side"), avoid.alias("avoid"),
        r2(F.least("_el", "_eh")).alias("entry_low"), r2(F.greatest("_el", "_eh")).alias("entry_high"),
        r2(F.least("_t1", "_t2")).alias("target_low"), r2(F.greatest("_t1", "_t2")).alias("target_high"),
        r2("_stop").alias("stop"), rnd("_pot", 1).alias("potential_pct"), rnd("_risk", 1).alias("risk_pct"),
        F.when(C("_risk") > 0, rnd(div("_pot", "_risk"), 1)).alias("rrr"), hold.alias("hold"),
        C("_code").alias("action_code"), pick(0).alias("action"), pick(1).alias("action_tone"),
        pick(2).alias("entry_when"))
    return d.withColumn(out, F.when(p > 0, plan)).select(*keep, out)


# Themes that count as megatrends, by priority of the symbol's own list.
MEGATRENDS = ("KI", "Kernenergie", "Quantum", "Space", "Robotik", "Data Center", "Ukraine-Wiederaufbau", "Rüstung")
HOLDER_SHORT, HOLDER_LONG = "Aschenbrenner", "Der KI-Investor Leopold Aschenbrenner"
JOIN = " · "


def bull_thesis(df: DataFrame) -> DataFrame:
    """The three strongest bullish drivers, by weight and then rule order."""
    strong = F.get(F.filter("themes", lambda t: t.isin(*MEGATRENDS)), 0)
    template = yes(C("minervini_score") >= 80)
    # fixed output texts with their weights
    drivers = [
        (6, F.when(C("growth_score") >= 75, F.lit("Umsatz/Gewinn wachsen kräftig"))),
        (5, F.when(C("value_score") >= 65, F.lit("günstig bewertet"))),
        (5, F.when(C("piotroski") >= 7, F.lit("sehr solide Bilanz"))),
        (4, F.when(template, F.lit("bestätigter Aufwärtstrend"))),
        (3, F.when(~template & (C("weinstein_stage") == 2) & (C("longterm_score") >= 58),
                   F.lit("intakter Aufwärtstrend"))),
        (3, F.when(analysts() & (C("analyst_upside_pct") >= 12),
                   F.concat(F.lit("Analysten sehen +"), txt("analyst_upside_pct", 0), F.lit("% Kursziel")))),
        (2, F.when(_is("daytrade_direction", "LONG"), F.lit("kurzfristig kaufen die Anleger zu"))),
        (2, F.when(C("news_sentiment") == "positiv", F.lit("positive Nachrichtenlage"))),
        (2, F.concat(F.lit("Rückenwind aus Megatrend "), strong)),
        (1, F.concat(F.lit("von "), F.get("expert_sources", 0), F.lit(" empfohlen"))),
        (3, F.when(C("holder_stance") == "LONG", F.lit(f"Smart Money ({HOLDER_SHORT}) ist long"))),
    ]
    ranked = F.array_sort(F.filter(F.array(*[
        F.struct(F.lit(-w).alias("w"), F.lit(i).alias("i"), t.alias("t")) for i, (w, t) in enumerate(drivers)]),
        lambda x: x["t"].isNotNull()))
    df = df.withColumn("_d", F.transform(F.slice(ranked, 1, 3), lambda x: x["t"]))
    return df.withColumn("bull_thesis", F.when(F.size("_d") > 0, F.array_join("_d", JOIN)).otherwise(
        F.lit("Keine starken Aufwärtstreiber erkennbar – eher neutral bis abwartend."))).drop("_d")


def priced_in(df: DataFrame) -> DataFrame:
    """How much optimism the price already holds, or NULL."""
    # fixed output texts
    flags = present([
        F.when(C("rsi") >= 72, F.lit("technisch heißgelaufen")),
        F.when(analysts() & (C("analyst_upside_pct") < 3), F.lit("kaum Luft zum Kursziel")),
        F.when(C("peak_warning"), F.lit("Spitzenzyklus")),
        F.when(F.array_contains("themes", "Rüstung"), F.lit("Rüstung trägt Kriegsprämie (Friedensrisiko)")),
        F.when(yes(C("hype_surging")), F.lit("Retail-Hype"))])
    df = df.withColumn("_f", flags)
    return df.withColumn("priced_in", F.when(F.size("_f") > 0, F.concat(
        F.lit("Viel Optimismus schon eingepreist: "), F.array_join("_f", ", ")))).drop("_f")


# Analyst consensus key -> German label.
CONSENSUS = {"strong_buy": "starker Kauf", "buy": "Kauf", "hold": "Halten", "underperform": "Untergewichten",
             "sell": "Verkauf"}


def plain_summary(df: DataFrame) -> DataFrame:
    """A few plain German sentences per symbol (fixed output texts)."""
    lt, rsi, fs = F.coalesce(C("longterm_score"), num(0)), C("rsi"), C("fundamental_score")
    vs, qs, au = C("value_score"), C("quality_score"), C("analyst_upside_pct")
    trend = (F.when(lt >= 70, F.lit("Die Aktie steckt in einem stabilen Aufwärtstrend"))
             .when(lt >= 45, F.lit("Der Trend ist grundsätzlich intakt, aber nicht überragend"))
             .otherwise(F.lit("Der langfristige Trend ist derzeit schwach")))
    timing = (F.when(rsi.between(40, 55) & (lt >= 55), F.lit(
        ", und der Kurs ist gerade etwas zurückgekommen – oft ein günstiger Einstiegsmoment."))
        .when(rsi > 70, F.lit(" – der Kurs ist zuletzt aber heiß gelaufen (überkauft)."))
        .when(rsi < 30, F.lit(" – aktuell ist er stark abverkauft, eine Gegenbewegung ist möglich."))
        .otherwise(F.lit(".")))
    earn = (F.when(qs >= 70, F.lit("Das Unternehmen verdient solide")).when(qs < 40, F.lit("Die Ertragskraft ist schwach"))
            .otherwise(F.lit("Die Geschäftszahlen sind durchschnittlich")))
    worth = (F.when(vs >= 65, F.lit(" und ist dabei günstig bewertet."))
             .when(vs <= 35, F.lit(", ist aber hoch bewertet (teuer)."))
             .when(vs.isNotNull(), F.lit(" zu einer fairen Bewertung.")).otherwise(F.lit(".")))
    label = F.coalesce(*[F.when(C("analyst_rating") == k, F.lit(v)) for k, v in CONSENSUS.items()],
                       F.nullif(C("analyst_rating"), F.lit("")), F.lit("—"))
    arrow = F.concat(F.when(au >= 0, F.lit("+")).otherwise(F.lit("")), txt(au, 0), F.lit("%"))
    template, pio, z, ed = yes(C("minervini_score") >= 80), C("piotroski"), C("altman_z"), C("earnings_in_days")
    hype = F.concat(
        F.lit("Auf Reddit stark diskutiert (Rang "), int_txt("hype_rank"),
        F.coalesce(F.concat(F.lit(", Erwähnungen "), txt("hype_change_pct", 0, True), F.lit("%")), F.lit("")),
        F.lit(") – hohe Retail-Aufmerksamkeit, aber auch Hype-Risiko."))
    dt = F.coalesce(C("daytrade_score"), num(0))
    sentences = [
        F.concat(trend, timing),
        F.when(fs.isNotNull(), F.concat(earn, worth)),
        F.when(analysts(), F.concat(int_txt("analyst_n"), F.lit(" Analysten: Konsens „"), label,
                                    F.lit("\", Ø-Kursziel "), arrow, F.lit(" zum aktuellen Kurs."))),
        F.when(template, F.lit("Erfüllt Minervinis Trend-Template (bestätigter Aufwärtstrend).")),
        F.when(C("weinstein_stage") == 4, F.lit("Weinstein-Phase 4 (Abwärtstrend) – für Käufe meiden."))
        .when((C("weinstein_stage") == 2) & ~template, F.lit("Weinstein-Phase 2 (Aufwärtstrend).")),
        F.when(pio >= 8, F.concat(F.lit("Bilanz sehr solide (Piotroski "), int_txt(pio), F.lit("/9).")))
        .when(pio <= 2, F.concat(F.lit("Bilanz schwach (Piotroski "), int_txt(pio), F.lit("/9)."))),
        F.when(z < 1.81, F.concat(F.lit("⚠️ Erhöhtes Pleiterisiko (Altman-Z "), z.cast("string"), F.lit(")."))),
        F.when(_is("daytrade_direction", "LONG") & (dt >= 45), F.lit("Kurzfristig greifen gerade Käufer zu."))
        .when(_is("daytrade_direction", "SHORT") & (dt >= 45), F.lit("Kurzfristig haben die Verkäufer die Oberhand.")),
        F.when(C("news_sentiment") == "positiv", F.lit("Die aktuellen Schlagzeilen sind überwiegend positiv."))
        .when(C("news_sentiment") == "negativ", F.lit("Achtung: die aktuellen Schlagzeilen sind überwiegend negativ.")),
        F.when(yes(C("hype_surging")), hype),
        F.when(ed.between(0, 10), F.concat(
            F.lit("📅 Zahlen "), F.when(ed == 0, F.lit("heute")).otherwise(
                F.concat(F.lit("in "), int_txt(ed), F.lit(" Tagen"))),
            F.lit(" ("), C("next_earnings").cast("string"), F.lit(") – bis dahin oft erhöhte Schwankung."))),
        F.when(C("holder_stance") == "LONG", F.concat(
            F.lit(f"{HOLDER_LONG} setzt hier auf steigende Kurse (rund "),
            C("holder_weight_pct").cast("string"), F.lit("% seines Fonds).")))
        .when(C("holder_stance") == "SHORT_BET", F.lit(
            f"Achtung: {HOLDER_SHORT} wettet über Put-Optionen gegen diese Aktie – "
            "er rechnet eher mit fallenden Kursen."))
        .when(C("holder_stance") == "MIXED", F.lit(
            f"{HOLDER_SHORT} hält hier gleichzeitig auf steigende und fallende Kurse "
            "gerichtete Positionen (Absicherung).")),
    ]
    return df.withColumn("plain_summary", F.concat_ws(" ", *sentences))


def actions(df: DataFrame) -> DataFrame:
    """Up to three {text, tone} ideas in rule order (fixed output texts)."""
    lt, dt = F.coalesce(C("longterm_score"), num(0)), F.coalesce(C("daytrade_score"), num(0))
    rsi, fs, vs, ns = C("rsi"), C("fundamental_score"), C("value_score"), C("news_score")
    au, ed, pio, has_news = C("analyst_upside_pct"), C("earnings_in_days"), C("piotroski"), yes(C("news_n") >= 2)

    def idea(text: Column | str, tone: str) -> Column:
        return F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(tone).alias("tone"))

    rules = [
        F.when(C("holder_stance") == "SHORT_BET", idea("Vorsicht: Smart Money wettet dagegen", "neg")),
        F.when(_is("daytrade_direction", "LONG") & (dt >= 50), idea("Momentum-Long (kurzfristig)", "pos"))
        .when(_is("daytrade_direction", "SHORT") & (dt >= 50), idea("Short-Setup (kurzfristig)", "neg")),
        F.when((lt >= 65) & rsi.between(38, 57), idea("Rücksetzer-Einstieg beobachten", "pos")),
        F.when((fs >= 70) & (vs >= 60), idea("Günstige Qualität – fürs Langfrist-Depot", "pos")),
        F.when((rsi >= 72) & (vs <= 40), idea("Abwarten – teuer & überkauft", "neg")),
        F.when(rsi <= 28, idea("Spekulativer Rebound möglich", "neutral")),
        F.when(has_news & (ns <= 38), idea("Negative News – abwarten", "neg"))
        .when(has_news & (ns >= 62), idea("Positive News – Rückenwind", "pos")),
        F.when(ed.between(0, 7), idea(F.concat(F.lit("Zahlen in "), int_txt(ed), F.lit(" T. – Vorsicht")), "neutral")),
        F.when(yes(C("hype_surging")),
               idea(F.concat(F.lit("🔥 Reddit-Hype (Rang "), int_txt("hype_rank"), F.lit(")")), "neutral")),
        F.when(C("minervini_score") >= 80, idea("Minervini Stage-2 ✓", "pos")),
        F.when(C("altman_z") < 1.81, idea("⚠️ Pleiterisiko (Altman)", "neg")),
        F.when(pio >= 8, idea(F.concat(F.lit("Bilanz stark (Piotroski "), int_txt(pio), F.lit("/9)")), "pos")),
        F.when(analysts(5) & (au >= 20), idea(F.concat(F.lit("Analysten-Kursziel +"), txt(au, 0), F.lit("%")), "pos"))
        .when(analysts(5) & (au <= -5), idea("Kurs über Analysten-Ziel", "neg")),
        F.when(C("holder_stance") == "LONG", idea(f"{HOLDER_SHORT}-Konviktion (long)", "pos")),
    ]
    df = df.withColumn("_i", F.slice(F.array_distinct(present(rules)), 1, 3))
    return df.withColumn("actions", F.when(F.size("_i") > 0, C("_i")).otherwise(
        F.array(idea("Beobachten", "neutral")))).drop("_i")
