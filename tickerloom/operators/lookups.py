"""Symbol suffix lookups, FX rates and conversion, text search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.core import col, div, lookup, num, rnd

# Exchange suffix -> trading currency.
SUFFIX_CURRENCY = {
    ".DE": "EUR", ".F": "EUR", ".PA": "EUR", ".AS": "EUR", ".BR": "EUR", ".MI": "EUR", ".MC": "EUR",
    ".VI": "EUR", ".HE": "EUR", ".LS": "EUR", ".IR": "EUR", ".AT": "EUR", ".L": "GBp", ".SW": "CHF",
    ".VX": "CHF", ".ST": "SEK", ".OL": "NOK", ".CO": "DKK", ".WA": "PLN", ".HK": "HKD", ".T": "JPY",
    ".KS": "KRW", ".KQ": "KRW", ".TW": "TWD", ".TWO": "TWD", ".NS": "INR", ".BO": "INR", ".SA": "BRL",
    ".MX": "MXN", ".JK": "IDR", ".KL": "MYR", ".BK": "THB", ".SI": "SGD", ".SR": "SAR", ".JO": "ZAc",
    ".AX": "AUD", ".NZ": "NZD", ".TO": "CAD", ".V": "CAD", ".NE": "CAD", ".CN": "CAD",
}
# Minor unit -> (major currency, factor).
SUBUNITS = {"GBp": ("GBP", 0.01), "ZAc": ("ZAR", 0.01), "ILA": ("ILS", 0.01)}
# Exchange suffix -> country name and ISO-2 code.
SUFFIX_COUNTRY = [
    (".DE", "Deutschland", "de"), (".F", "Deutschland", "de"), (".BE", "Belgien", "be"), (".PA", "Frankreich", "fr"),
    (".AS", "Niederlande", "nl"), (".BR", "Belgien", "be"), (".L", "UK", "gb"), (".MI", "Italien", "it"), (".MC", "Spanien", "es"),
    (".SW", "Schweiz", "ch"), (".VX", "Schweiz", "ch"), (".ST", "Schweden", "se"), (".OL", "Norwegen", "no"),
    (".CO", "Dänemark", "dk"), (".HE", "Finnland", "fi"), (".VI", "Österreich", "at"), (".WA", "Polen", "pl"), (".IR", "Irland", "ie"),
    (".LS", "Portugal", "pt"), (".AT", "Griechenland", "gr"), (".HK", "Hongkong/China", "hk"), (".T", "Japan", "jp"),
    (".KS", "Südkorea", "kr"), (".KQ", "Südkorea", "kr"), (".TW", "Taiwan", "tw"), (".TWO", "Taiwan", "tw"), (".NS", "Indien", "in"),
    (".BO", "Indien", "in"), (".SA", "Brasilien", "br"), (".MX", "Mexiko", "mx"), (".JK", "Indonesien", "id"),
    (".KL", "Malaysia", "my"), (".BK", "Thailand", "th"), (".SI", "Singapur", "sg"), (".SR", "Saudi-Arabien", "sa"),
    (".JO", "Südafrika", "za"), (".AX", "Australien", "au"), (".NZ", "Neuseeland", "nz"), (".TO", "Kanada", "ca"),
    (".V", "Kanada", "ca"), (".NE", "Kanada", "ca"), (".CN", "Kanada", "ca"),
]
# US-listed foreign companies, by home country.
US_LISTED_FOREIGN = [
    ("China", "cn", "BABA PDD JD BIDU NIO LI XPEV NTES BILI TCEHY BYDDY FUTU YMM BEKE TME ZTO VNET GDS DQ TCOM MNSO TAL EDU VIPS"),
    ("Taiwan", "tw", "TSM UMC ASX HIMX"),
    ("Indien", "in", "IBN HDB INFY WIT RDY MMYT"),
    ("Brasilien", "br", "NU PBR ITUB BBD ABEV STNE XP GGB SBS BSBR VALE"),
    ("Argentinien", "ar", "MELI YPF GGAL BMA PAM"),
    ("Mexiko", "mx", "AMX FMX CX ASR PAC KOF"),
    ("Peru", "pe", "BAP"),
    ("Südkorea", "kr", "SHG CPNG"),
    ("Singapur", "sg", "SE GRAB"),
    ("Vietnam", "vn", "VFS"),
    ("Israel", "il", "ESLT MNDY WIX GLBE"),
    ("Südafrika", "za", "SSL GFI AU"),
    ("Kasachstan", "kz", "KSPI"),
    ("Uruguay", "uy", "DLO"),
    ("Irland", "ie", "CRH"),
    ("Finnland", "fi", "NOK"),
    ("Schweden", "se", "ERIC"),
    ("Schweiz", "ch", "STM"),
    ("Kanada", "ca", "GOLD FNV AEM WPM KGC TECK CCJ NXE DNN BN RY TD TRP CNQ SU SHOP GIB"),
]
# The columns that hold absolute prices.
PRICE_COLUMNS = ("price", "prev_close", "sma20", "sma50", "sma150", "sma200", "sma150_1m_ago",
                 "sma200_1m_ago", "ema9", "ema21", "high52", "low52", "high20", "low20", "atr",
                 "pivot", "pivot_r1", "pivot_s1", "target_price", "graham_number")


def exchange_suffix(symbol: str | Column) -> Column:
    """Text from the last dot on, '' when there is none."""
    return F.regexp_extract(F.upper(col(symbol)), r"\.[^.]*$", 0)


def currency_of(symbol: str | Column) -> Column:
    return F.coalesce(lookup(SUFFIX_CURRENCY, exchange_suffix(symbol)), F.lit("USD"))


def _home(symbol: str | Column, part: int) -> Column:
    """Country name (part 0) or ISO-2 code (part 1) of a listing's home."""
    s = F.upper(col(symbol))
    foreign = {sym: (name, code)[part] for name, code, syms in US_LISTED_FOREIGN for sym in syms.split()}
    by_suffix = {suffix: (name, code)[part] for suffix, name, code in SUFFIX_COUNTRY}
    coin = F.lit(("Krypto", None)[part]).cast("string")
    return F.when(s.endswith("-USD"), coin).otherwise(
        F.coalesce(lookup(foreign, s), lookup(by_suffix, exchange_suffix(symbol)), F.lit(("USA", "us")[part])))


def with_country(df: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Adds country and cc (ISO-2, NULL for coins)."""
    return df.withColumns({"country": _home(symbol, 0), "cc": _home(symbol, 1)})


def fx_rates(currencies: DataFrame, quotes: DataFrame) -> DataFrame:
    """currency -> usd_rate: direct pair, else inverse pair, times the sub-unit factor.

    `quotes(currency, direct, inverse)` is keyed by the major currency. Currencies
    without any quote are kept with a NULL rate.
    """
    major = F.coalesce(lookup({k: v[0] for k, v in SUBUNITS.items()}, F.col("currency")), F.col("currency"))
    factor = F.coalesce(lookup({k: str(v[1]) for k, v in SUBUNITS.items()}, F.col("currency")).cast("double"), num(1))
    q = quotes.select(F.col("currency").alias("major"), "direct", "inverse")
    direct = F.when(F.col("direct") > 0, F.col("direct"))
    inverse = F.when(F.col("inverse") > 0, div(num(1), "inverse"))
    rate = rnd(F.coalesce(direct, inverse) * F.col("factor"), 8)
    return (
        currencies.select("currency").distinct()
        .withColumns({"major": major, "factor": factor})
        .join(q, "major", "left")
        .select("currency", F.when(F.col("currency") == "USD", num(1)).otherwise(rate).alias("usd_rate"))
    )


def fx_convert(df: DataFrame, rates: DataFrame, price_columns: Sequence[str] = PRICE_COLUMNS) -> DataFrame:
    """Scales the price columns to USD (2 dp); a missing rate counts as 1.0 and is flagged."""
    r = rates.select(F.col("currency"), F.col("usd_rate").alias("_rate"))
    joined = df.join(r, "currency", "left")
    fx = F.coalesce(F.when(F.col("_rate") != 0, F.col("_rate")), num(1))
    scaled = {c: F.when(fx != 1, rnd(F.col(c) * fx, 2)).otherwise(F.col(c)) for c in price_columns if c in df.columns}
    keep = [scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns]
    return joined.select(*keep, fx.alias("fx_usd"), F.col("_rate").isNull().alias("fx_missing"))


def table_filter(df: DataFrame, query: str, order_by: str = "elo_score") -> DataFrame:
    """Rows whose columns, written out as text, hold the query in any case; greatest order_by first.

    Every column counts, nested ones as JSON; a missing value reads `None`.
    """
    flat = [F.coalesce((F.to_json(F.col(f"`{c}`")) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`").cast("string")), F.lit("None")) for c, t in df.dtypes]
    hits = df.where(F.contains(F.lower(F.concat_ws(" ", *flat)), F.lit(query.lower())))
    return hits.orderBy(F.col(order_by).desc_nulls_last(), "ord")


def search(df: DataFrame, query: str, columns: Sequence[str], array_columns: Sequence[str] = (),
           order_by: str = "elo_score", limit: int | None = 40) -> DataFrame:
    """Case-insensitive substring search over the concatenated columns, best score first; limit=None returns every hit."""
    hay = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns],
                      *[F.coalesce(F.array_join(F.col(c), " "), F.lit("")) for c in array_columns])
    hits = df.where(F.contains(F.lower(hay), F.lit(query.strip().lower())))
    ordered = hits.orderBy(F.coalesce(F.col(order_by), F.lit(0)).desc(), "ord")
    return ordered if limit is None else ordered.limit(limit)
