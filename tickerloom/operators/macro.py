"""Market-wide context: one row, joined to every symbol by a one-row cross join."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.core import clamp, div, fmt, num, points, present, rnd, txt, yes

C = F.col

# Decision days of the rate-setting committee.
FOMC_DAYS = ("2026-01-28", "2026-03-18", "2026-04-29", "2026-06-17",
             "2026-07-29", "2026-09-16", "2026-10-28", "2026-12-09")
# Statement terms.
HAWKISH = ("raise", "hike", "tighten", "restrictive", "elevated inflation", "higher for longer", "firmer",
           "upside risks to inflation")
DOVISH = ("cut", "lower", "ease", "accommodative", "softening", "cooling", "rate reduction", "downside risks", "moderat")
# Countries that do not count as emerging markets.
DEVELOPED = ("us", "de", "fr", "gb", "ch", "jp", "ca", "nl", "it", "es", "se", "au", "nz", "dk", "no", "fi", "at",
             "ie", "be", "pt")
SERIES = ("vix", "tnx", "spx", "ndx", "world", "dxy", "oil", "gold", "copper", "silver", "btc")


def last_and_prior(quotes: DataFrame, days: int = 20) -> DataFrame:
    """Per series: last close and the close `days` bars earlier (or the oldest), 2 dp.

    Only the newest days+1 rows of a series are kept, before the shuffle.
    """
    newest = Window.partitionBy("series").orderBy(F.desc("d"))
    q = (quotes.where("close is not null").withColumn("_rr", F.row_number().over(newest))
         .where(C("_rr") <= days + 1))
    return q.groupBy("series").agg(rnd(F.max_by("close", "d"), 2).alias("last"),
                                   rnd(F.min_by("close", "d"), 2).alias("prior"))


def trend(last: Column, prior: Column, threshold: float) -> Column:
    change = (div(last, F.nullif(prior, num(0))) - num(1)) * num(100)
    return (F.when(change >= threshold, F.lit("rising")).when(change <= -threshold, F.lit("falling"))
            .otherwise(F.lit("flat")))


def context(quotes: DataFrame, as_of: date, events: Sequence[str] = FOMC_DAYS) -> DataFrame:
    """One row: levels, directions, risk regime, rate direction and the next event date, from quotes up to `as_of`."""
    p = last_and_prior(quotes.where(C("d") <= F.lit(as_of.isoformat()).cast("date"))).groupBy().agg(*[
        F.max(F.when(C("series") == s, C(c))).alias(s if c == "last" else f"{s}_prev")
        for s in SERIES for c in ("last", "prior")])
    percent = lambda c: F.when(C(c) > 20, rnd(C(c) / num(10), 2)).otherwise(rnd(c, 2))
    vix, change = C("vix"), C("tnx_pct") - F.nullif(C("tnx_prev_pct"), num(0))
    today = F.lit(as_of.isoformat()).cast("date")
    days = F.array(*[F.lit(d).cast("date") for d in events])
    p = p.withColumns({"tnx_pct": percent("tnx"), "tnx_prev_pct": percent("tnx_prev"),
                       "fomc_next": F.array_min(F.filter(days, lambda d: d >= today))})
    directions = {f"{s}_dir": trend(C(s), C(f"{s}_prev"), t) for s, t in
                  (("dxy", 1.5), ("oil", 3.0), ("gold", 3.0), ("copper", 3.0), ("silver", 3.0), ("btc", 6.0))}
    # fixed output texts
    return p.select(
        "vix", "vix_prev", "tnx_pct", "tnx_prev_pct", "spx", "ndx", "world", "dxy", "oil", "gold", "copper",
        "silver", "btc", yes(C("spx") > C("spx_prev")).alias("spx_up"),
        *[v.alias(k) for k, v in directions.items()],
        F.when(vix >= 22, F.lit("risk_off")).when(vix <= 15, F.lit("risk_on")).otherwise(F.lit("neutral"))
        .alias("risk_regime"),
        F.when(vix.isNull(), F.lit("unbekannt")).when(vix >= 30, F.lit("Risk-Off (Angst)"))
        .when(vix >= 22, F.lit("erhöhte Nervosität")).when(vix <= 15, F.lit("Risk-On (ruhig)"))
        .otherwise(F.lit("neutral")).alias("risk_label"),
        F.when(change >= 0.15, F.lit("rising")).when(change <= -0.15, F.lit("falling")).otherwise(F.lit("flat"))
        .alias("rate_dir"),
        "fomc_next", F.datediff("fomc_next", today).alias("fomc_in_days"))


def _overlaps_itself(term: str) -> bool:
    return any(term[:k] == term[-k:] for k in range(1, len(term)))


def with_term_counts(df: DataFrame, text: Column, lists: dict[str, Sequence[str]]) -> DataFrame:
    """Adds, for each named list, the sum over its terms of their non-overlapping occurrences in `text`.

    One pass: at each place where a term starts an alternation takes the longest one, which stands for all terms that it
    begins with, so occurrences of different terms may overlap. Terms that can overlap themselves are counted apart.
    """
    terms = sorted({w for words in lists.values() for w in words if w}, key=lambda w: (-len(w), w))
    once = [w for w in terms if not _overlaps_itself(w)]
    starts = "".join(sorted({re.escape(w[0]) for w in once}))
    pattern = f"(?=[{starts}])(?=({'|'.join(map(re.escape, once))}))"
    df = df.withColumn("_found", F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if once else F.array().cast("array<string>"))

    def hits(words: Sequence[str]) -> Column:
        total = F.lit(0)
        for n in range(1, len(words) + 1):  # a term that n of the words begin counts n times
            heavy = [w for w in once if sum(w.startswith(x) for x in words if x in once) == n]
            if heavy:
                total = total + F.size(F.filter("_found", lambda x: x.isin(*heavy))) * n
        apart = [(F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / F.lit(len(w)) for w in words if w and w not in once]
        return sum(apart, total).cast("long")

    counted = F.when(text.isNotNull(), F.struct(*[hits(words).alias(name) for name, words in lists.items()])).alias("_c")
    return df.select("*", counted).select(*[C(c) for c in df.columns if c != "_found"], *[C("_c")[name].alias(name) for name in lists])


def policy_tone(statements: DataFrame, text: str = "text", hawkish: Sequence[str] = HAWKISH,
                dovish: Sequence[str] = DOVISH) -> DataFrame:
    """Adds hawk_hits, dove_hits and tone from substring counts over the whole text."""
    df = with_term_counts(statements, F.lower(C(text)), {"hawk_hits": hawkish, "dove_hits": dovish})
    h, d = C("hawk_hits"), C("dove_hits")
    return df.withColumn("tone", F.when(h > d, F.lit("hawkish")).when(d > h, F.lit("dovish"))
                         .otherwise(F.lit("neutral")))


# What the title of a rate statement holds (the last in any case).
STATEMENT_MARKS = ("FOMC", "Federal Open Market")
STATEMENT_TOPIC = "monetary policy"


def latest_statement(feed: DataFrame, as_of: date, hawkish: Sequence[str] = HAWKISH, dovish: Sequence[str] = DOVISH) -> DataFrame:
    """fomc_tone, fomc_headline, fomc_date of the newest matching item by `as_of`: one row, or none.

    feed(pos, title, body, published date): of items of one day the first (by pos) counts. Only the item
    that was chosen is searched for terms.
    """
    title = F.coalesce("title", F.lit(""))
    match = F.lower(title).contains(STATEMENT_TOPIC)
    for mark in STATEMENT_MARKS:
        match = match | title.contains(mark)
    seen = feed.where(match & (C("published") <= F.lit(as_of.isoformat()).cast("date")))
    newest = seen.groupBy().agg(F.max_by(F.struct("title", "body", "published"), F.struct("published", -C("pos"))).alias("s")).where("s is not null").select("s.*")
    toned = policy_tone(newest.withColumn("_item", F.concat_ws(" ", "title", "body")), "_item", hawkish, dovish)
    headline = F.substring(F.trim(F.regexp_replace("title", "<[^>]+>", "")), 1, 120)
    return toned.select(C("tone").alias("fomc_tone"), headline.alias("fomc_headline"), C("published").alias("fomc_date"))


def with_statement(context_row: DataFrame, statement: DataFrame) -> DataFrame:
    """The macro row with the statement's columns (NULL without one); both sides have one row at most."""
    return context_row.join(statement, F.lit(True), "left")


MACRO_INPUTS = ("vix", "risk_regime", "rate_dir", "oil_dir", "gold_dir", "silver_dir", "copper_dir", "dxy_dir",
                "btc_dir", "fomc_in_days")


def adjust(rows: DataFrame, macro: DataFrame) -> DataFrame:
    """Adds macro_pts (-18..18) and macro_notes. `macro` has one row, so the cross join is a bounded broadcast."""
    m = macro.select(*[C(c).alias(f"_m_{c}") for c in MACRO_INPUTS])
    df = rows.crossJoin(m)
    g = lambda c: C(f"_m_{c}")
    up, down = (lambda c: yes(g(c) == "rising")), (lambda c: yes(g(c) == "falling"))
    beta, sector = C("beta"), F.coalesce(C("sector"), F.lit(""))
    industry = F.lower(F.coalesce(C("industry"), F.lit("")))
    themed = lambda *t: F.coalesce(F.arrays_overlap("themes", F.array(*[F.lit(x) for x in t])), F.lit(False))
    has = lambda c, w: F.contains(c, F.lit(w))
    off, on = yes(g("risk_regime") == "risk_off"), yes(g("risk_regime") == "risk_on")
    vix = txt(g("vix"), 0)
    rich = yes(C("forward_pe") > 40) | yes(C("value_score") < 35)
    energy = (F.lower(sector) == "energy") | has(industry, "oil") | has(industry, "gas")
    em = themed("Emerging Markets") | (C("cc").isNotNull() & ~C("cc").isin(*DEVELOPED))
    crypto = themed("Krypto") & ~F.upper("symbol").endswith("-USD")
    gold, copper = has(industry, "gold"), has(industry, "copper") | has(industry, "industrial metals")
    note = F.lit
    # (condition, points, note): fixed values and output texts
    rules = [
        (off & yes(beta >= 1.5), -8, F.concat(note("Risk-Off (VIX "), vix, note("): hohe Schwankung (Beta "),
                                              txt(beta, 1), note(") belastet"))),
        (off & yes(beta <= 0.9), 4, F.concat(note("Risk-Off (VIX "), vix,
                                             note("): defensiv (niedrige Beta) im Vorteil"))),
        (on & yes(beta >= 1.3), 5, F.concat(note("Risk-On (VIX "), vix, note("): Rückenwind für Wachstum/Beta"))),
        (up("rate_dir") & rich, -6, note("Steigende Zinsen: teure Bewertung unter Druck")),
        (up("rate_dir") & has(sector, "Financial"), 4, note("Steigende Zinsen: Banken/Versicherer profitieren")),
        (down("rate_dir") & (has(sector, "Real Estate") | themed("REIT", "Versorger")), 5,
         note("Fallende Zinsen: zinssensitiv (REIT/Versorger) im Vorteil")),
        (down("rate_dir") & yes(C("growth_score") >= 70), 3, note("Fallende Zinsen: Rückenwind für Wachstum")),
        (energy & up("oil_dir"), 5, note("Ölpreis steigt: Rückenwind für Energiewerte")),
        (energy & down("oil_dir"), -4, note("Ölpreis fällt: Gegenwind für Energiewerte")),
        (has(industry, "airline") & up("oil_dir"), -4, note("Ölpreis steigt: höhere Spritkosten (Airlines)")),
        (gold & up("gold_dir"), 5, note("Goldpreis steigt: Rückenwind für Goldminen")),
        (gold & down("gold_dir"), -4, note("Goldpreis fällt: Gegenwind für Goldminen")),
        (has(industry, "silver") & up("silver_dir"), 5, note("Silberpreis steigt: Rückenwind für Silberminen")),
        (copper & up("copper_dir"), 4, note("Kupferpreis steigt: Rückenwind")),
        (copper & down("copper_dir"), -3, note("Kupferpreis fällt: Gegenwind")),
        (em & up("dxy_dir"), -5, note("Starker Dollar: Gegenwind für Emerging Markets")),
        (em & down("dxy_dir"), 4, note("Schwacher Dollar: Rückenwind für Emerging Markets")),
        (crypto & up("btc_dir"), 6, note("Bitcoin steigt: Rückenwind für Krypto-Aktien/Miner")),
        (crypto & down("btc_dir"), -6, note("Bitcoin fällt: Gegenwind für Krypto-Aktien/Miner")),
        (yes(g("fomc_in_days").between(0, 3)), 0, fmt("📅 Fed-Entscheidung in %d T – bis dahin oft erhöhte Schwankung",
                                                      g("fomc_in_days"))),
    ]
    pts = clamp(points([F.when(c, num(p)) for c, p, _ in rules]), -18, 18).cast("int")
    return df.select(*rows.columns, pts.alias("macro_pts"),
                     present([F.when(c, t) for c, _, t in rules]).alias("macro_notes"))
