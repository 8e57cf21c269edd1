"""Side tables, fundamentals and lookups as SQL."""

from __future__ import annotations

from oracle.base import bd, cl, define, dv, in_list, picks, r, ri, t0, t1, wm
from oracle.market import AS_OF
from tickerloom.operators import fundamentals as fund
from tickerloom.operators import lookups as lk
from tickerloom.operators import macro as mc
from tickerloom.sources import fixtures as fx


def case_of(key: str, table: dict, default: str = "NULL") -> str:
    return f"(CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END)"


# ---- statements and fundamentals ------------------------------------------------------------------------------
define("q_year", """
  SELECT *, 1.5 * revenue AS total_assets, 1.4 * net_income AS ebit, 0.4 * gross_profit AS retained_earnings,
         current_liabilities + long_term_debt AS total_liabilities,
         row_number() OVER (PARTITION BY suppkey ORDER BY yr DESC) - 1 AS pr
  FROM (SELECT l_suppkey AS suppkey, year(l_shipdate) AS yr, sum(l_extendedprice) AS revenue,
               sum(l_extendedprice * (0.35 - l_discount)) AS gross_profit,
               sum(l_extendedprice * (0.06 - l_discount)) AS net_income, sum(l_extendedprice * (0.05 - l_tax)) AS cfo,
               sum(l_extendedprice) FILTER (l_returnflag = 'N') AS current_assets,
               sum(l_extendedprice) FILTER (l_returnflag = 'R') AS current_liabilities,
               sum(l_extendedprice * 0.5) FILTER (l_returnflag = 'A') AS long_term_debt, sum(l_quantity) AS shares
        FROM lineitem GROUP BY 1, 2)""")
_unions = " UNION ALL ".join(
    f"SELECT 'S' || suppkey AS symbol, '{s}' AS stmt, CASE WHEN suppkey % 2 = 1 THEN '{alt}' ELSE '{item}' END AS item, "
    f"pr AS period_rank, {c} AS amount FROM q_year WHERE {c} IS NOT NULL" for s, item, alt, c in fx.STATEMENT_ITEMS)
define("q_statements", _unions)
_items = []
for _p in (0, 1):
    for _name, (_stmt, _labels) in fund.LINE_ITEMS.items():
        _prio = "CASE item " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(_labels)) + " END"
        _items.append(f"arg_min(amount, {_prio}) FILTER (stmt = '{_stmt}' AND period_rank = {_p} AND {_prio} IS NOT NULL)"
                      f" AS {_name}_{_p}")
define("q_wide", f"SELECT symbol, {', '.join(_items)} FROM q_statements WHERE period_rank <= 1 GROUP BY symbol")
define("q_lastclose", "SELECT symbol, arg_max(close, ts) AS last_close FROM q_bars GROUP BY symbol")
_names = ("revenue net_income cfo total_assets ebit gross_profit current_assets current_liabilities long_term_debt "
          "total_liabilities shares").split()
define("q_fbase", f"""
  SELECT *, total_assets - coalesce(total_liabilities, 0) AS equity, abs(acctbal) AS bal,
         last_close * shares * 20 AS mcap, net_income / nullif(shares * 4, 0) AS eps0,
         CASE WHEN net_income_p > 0 THEN net_income / net_income_p - 1 END AS eg
  FROM (SELECT 'S' || suppkey AS symbol, {', '.join(f'max({c}) FILTER (pr = 0) AS {c}' for c in _names)},
               max(revenue) FILTER (pr = 1) AS revenue_p, max(net_income) FILTER (pr = 1) AS net_income_p
        FROM q_year WHERE pr <= 1 GROUP BY suppkey) JOIN q_universe USING (symbol) JOIN q_lastclose USING (symbol)""")
_k = lambda x: f"CASE WHEN acctbal >= 0 THEN {x} END"
define("q_fund", f"""
  SELECT symbol, ord, {_k('last_close / nullif(eps0, 0)')} AS pe,
         {_k('last_close / nullif(eps0, 0) * (0.4 + bal / 10000)')} AS forward_pe, {_k('mcap / nullif(equity, 0)')} AS pb,
         {_k('mcap / nullif(revenue, 0)')} AS ps,
         {_k('(mcap + coalesce(long_term_debt, 0)) / nullif(ebit, 0)')} AS ev_ebitda,
         {_k('last_close / nullif(eps0, 0) / nullif(eg * 100, 0)')} AS peg, {_k('net_income * 5 / nullif(equity, 0)')} AS roe,
         {_k('net_income * 3 / nullif(total_assets, 0)')} AS roa, {_k('net_income * 5 / nullif(revenue, 0)')} AS profit_margin,
         {_k('gross_profit / nullif(revenue, 0)')} AS gross_margin, {_k('ebit / nullif(revenue, 0)')} AS operating_margin,
         {_k('long_term_debt * 300 / nullif(equity, 0)')} AS debt_to_equity,
         {_k('current_assets / nullif(current_liabilities, 0)')} AS current_ratio,
         revenue / nullif(revenue_p, 0) - 1 AS revenue_growth, eg AS earnings_growth, bal / 200000 AS dividend_yield,
         mcap AS market_cap, mcap + coalesce(long_term_debt, 0) AS enterprise_value, ebit AS ebitda,
         cfo AS free_cashflow, sector, industry, 1 + bal / 2600 AS rec_mean,
         CASE WHEN 1 + bal / 2600 < 2 THEN 'strong_buy' WHEN 1 + bal / 2600 < 3 THEN 'buy'
              WHEN 1 + bal / 2600 < 4 THEN 'hold' ELSE 'underperform' END AS rec_key,
         CAST(floor(bal / 400) AS INTEGER) AS analyst_n, last_close * (0.8 + acctbal / 15000) AS target_price,
         eps0 AS eps, equity / nullif(shares * 20, 0) AS bvps, 0.5 + bal / 5000 AS beta, revenue
  FROM q_fbase""")
V = [bd("CASE WHEN pe > 0 THEN pe END", 10, 100, 15, 85, 20, 70, 25, 55, 35, 35, 50, 20, 5),
     bd("CASE WHEN pb > 0 THEN pb END", 1, 100, 2, 80, 3, 65, 5, 45, 8, 25, 10),
     bd("CASE WHEN ps > 0 THEN ps END", 1, 100, 2, 82, 4, 65, 7, 45, 12, 25, 10),
     bd("CASE WHEN ev_ebitda > 0 THEN ev_ebitda END", 8, 100, 12, 80, 16, 62, 22, 42, 35, 22, 8),
     bd("CASE WHEN peg > 0 THEN peg END", 1, 100, 1.5, 80, 2, 60, 3, 38, 15)]
Q = [bd("roe * 100", 0, 5, 8, 40, 15, 70, 20, 85, 100), bd("roa * 100", 0, 5, 2, 40, 5, 65, 10, 85, 100),
     bd("profit_margin * 100", 0, 5, 5, 45, 10, 65, 20, 85, 100),
     bd("CASE WHEN debt_to_equity >= 0 THEN debt_to_equity END", 30, 100, 80, 80, 150, 55, 250, 30, 12),
     bd("current_ratio", 1, 30, 1.5, 70, 2, 90, 100)]
G = [bd("revenue_growth * 100", 0, 20, 10, 60, 20, 85, 100), bd("earnings_growth * 100", 0, 20, 10, 60, 25, 85, 100)]
_one = lambda parts: r(wm(*[(p, 1.0) for p in parts]), 1)
define("q_fs", f"""
  SELECT *, {r(wm(('quality_score', 0.4), ('value_score', 0.35), ('growth_score', 0.25)), 1)} AS fundamental_score
  FROM (SELECT *, {_one(V)} AS value_score, {_one(Q)} AS quality_score, {_one(G)} AS growth_score FROM q_fund)""")
REASONS = picks(
    f"CASE WHEN roe * 100 >= 20 THEN 'Sehr hohe Eigenkapitalrendite (ROE ' || {t0('roe * 100')} || '%)' "
    "WHEN roe * 100 < 0 THEN 'Negative Eigenkapitalrendite – Verlust' END",
    f"CASE WHEN profit_margin * 100 >= 20 THEN 'Hohe Nettomarge (' || {t0('profit_margin * 100')} || '%)' END",
    "CASE WHEN debt_to_equity >= 0 AND debt_to_equity <= 50 THEN 'Solide Bilanz (wenig Schulden)' "
    f"WHEN debt_to_equity >= 250 THEN 'Hohe Verschuldung (D/E ' || {t0('debt_to_equity')} || '%)' END",
    f"CASE WHEN pe > 0 AND pe <= 15 THEN 'Günstiges KGV (' || {t0('pe')} || ')' "
    f"WHEN pe >= 40 THEN 'Hohes KGV (' || {t0('pe')} || ') – teuer bewertet' END",
    f"CASE WHEN pb > 0 AND pb <= 1.5 THEN 'Kurs-Buchwert niedrig (' || {t1('pb')} || ')' END",
    f"CASE WHEN ps > 0 AND ps <= 1.5 THEN 'Kurs-Umsatz niedrig (' || {t1('ps')} || ')' END",
    f"CASE WHEN ev_ebitda > 0 AND ev_ebitda <= 10 THEN 'EV/EBITDA attraktiv (' || {t0('ev_ebitda')} || ')' END",
    f"CASE WHEN peg > 0 AND peg <= 1 THEN 'PEG < 1 (' || printf('%.2f', {r('peg', 2)}) || ') – Wachstum günstig bezahlt' END",
    f"CASE WHEN revenue_growth * 100 >= 20 THEN 'Starkes Umsatzwachstum (+' || {t0('revenue_growth * 100')} || '%)' "
    f"WHEN revenue_growth * 100 < 0 THEN 'Umsatz schrumpft (' || {t0('revenue_growth * 100')} || '%)' END",
    f"CASE WHEN earnings_growth * 100 >= 25 THEN 'Starkes Gewinnwachstum (+' || {t0('earnings_growth * 100')} || '%)' END")
define("q_magic", f"""
  SELECT symbol, {r('100.0 * (n - i + 1) / n', 1)} AS magic_score
  FROM (SELECT symbol, row_number() OVER (ORDER BY a + b, ord) AS i, count(*) OVER () AS n
        FROM (SELECT symbol, ord, row_number() OVER (ORDER BY ebitda / enterprise_value DESC, ord) AS a
              FROM q_fund WHERE enterprise_value > 0 AND ebitda IS NOT NULL)
        JOIN (SELECT symbol, row_number() OVER (ORDER BY roa DESC, ord) AS b FROM q_fund WHERE roa IS NOT NULL) USING (symbol))""")
_t = lambda a, b, p: f"{a}_{p} / nullif({b}_{p}, 0)"
_tz = lambda a, b, p: f"nullif({a}_{p}, 0) / nullif({b}_{p}, 0)"
TESTS = ["ni_0 > 0", "cfo_0 > 0", f"{_t('ni', 'ta', 0)} > {_t('ni', 'ta', 1)}", "cfo_0 > ni_0",
         f"{_t('ltd', 'ta', 0)} < {_t('ltd', 'ta', 1)}", f"{_tz('ca', 'cl', 0)} > {_tz('ca', 'cl', 1)}",
         "sh_0 <= nullif(sh_1, 0) * 1.01", f"{_tz('gp', 'rev', 0)} > {_tz('gp', 'rev', 1)}",
         f"{_tz('rev', 'ta', 0)} > {_tz('rev', 'ta', 1)}"]
define("q_deep", f"""
  SELECT symbol, CASE WHEN n >= 5 THEN met END AS piotroski, n AS piotroski_n,
         {r('1.2 * (ca_0 - cl_0) / ta_0 + 1.4 * coalesce(re_0, 0) / ta_0 + 3.3 * coalesce(ebit_0, 0) / ta_0 '
            '+ 0.6 * nullif(market_cap, 0) / nullif(tl_0, 0) + coalesce(rev_0, 0) / ta_0', 2)} AS altman_z
  FROM (SELECT *, CAST({' + '.join(f'coalesce(({t})::INT, 0)' for t in TESTS)} AS INTEGER) AS met,
               CAST({' + '.join(f'(({t}) IS NOT NULL)::INT' for t in TESTS)} AS INTEGER) AS n
        FROM q_wide LEFT JOIN (SELECT symbol, market_cap FROM q_fund) USING (symbol))""")

# ---- lookups --------------------------------------------------------------------------------------------------
SUFFIX = "regexp_extract(upper({0}), '\\.[^.]*$')"


def currency(x: str) -> str:
    return case_of(SUFFIX.format(x), lk.SUFFIX_CURRENCY, "'USD'")


_country = {s: f"{name}|{code}" for name, code, syms in lk.US_LISTED_FOREIGN for s in syms.split()}
_suffix = {s: f"{name}|{code}" for s, name, code in lk.SUFFIX_COUNTRY}
COUNTRY_PAIR = (f"(CASE WHEN upper(listing) LIKE '%-USD' THEN 'Krypto' ELSE coalesce({case_of('upper(listing)', _country)}, "
                f"{case_of(SUFFIX.format('listing'), _suffix)}, 'USA|us') END)")
define("q_country", f"""
  SELECT symbol, listing, split_part({COUNTRY_PAIR}, '|', 1) AS country,
         nullif(split_part({COUNTRY_PAIR}, '|', 2), '') AS cc FROM q_universe""")
define("q_quotes", f"""
  SELECT {currency(f"('X' || ({in_list(fx.SUFFIXES)})[n_nationkey + 1])")} AS currency,
         {r('avg(abs(c_acctbal)) FILTER (n_regionkey < 2) / 5000', 6)} AS direct,
         {r('avg(abs(c_acctbal)) FILTER (n_regionkey IN (2, 3)) / 4000', 6)} AS inverse
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
define("q_rates", f"""
  SELECT c.currency, CASE WHEN c.currency = 'USD' THEN 1.0::DOUBLE ELSE
         {r("coalesce(direct, 1 / inverse) * (CASE WHEN c.currency IN ('GBp', 'ZAc', 'ILA') THEN 0.01 ELSE 1.0 END)", 8)} END AS usd_rate
  FROM (SELECT DISTINCT {currency('listing')} AS currency FROM q_universe) c LEFT JOIN q_quotes q
    ON q.currency = CASE c.currency WHEN 'GBp' THEN 'GBP' WHEN 'ZAc' THEN 'ZAR' WHEN 'ILA' THEN 'ILS' ELSE c.currency END""")

# ---- headlines, social, calendar, tags, holdings ----------------------------------------------------------------
define("q_headlines", """
  SELECT 'S' || (doc_id % n_sym) AS symbol, doc_id AS pos, text AS title, source AS link, lang AS published
  FROM documents, q_nsym""")
define("q_chat", """
  SELECT 'S' || ((conv_id * 3) % n_sym) AS symbol, conv_id * 1000 + turn AS pos, text AS title, role AS link, '' AS published
  FROM conversations, q_nsym""")


def title_net(title: str = "title") -> str:
    tok = f"list_distinct(string_split_regex(translate(lower({title}), ',.', '  '), '\\s+'))"
    return (f"(len(list_intersect({tok}, {in_list(fx.POS_WORDS)})) - len(list_intersect({tok}, {in_list(fx.NEG_WORDS)})))")


def news_of(source: str) -> str:
    return f"""
  SELECT symbol, news_score, CASE WHEN news_score >= 60 THEN 'positiv' WHEN news_score <= 40 THEN 'negativ' ELSE 'neutral' END
         AS news_sentiment, news_n, first_links
  FROM (SELECT symbol, CAST(least(greatest(50 + 6 * coalesce(sum(net) FILTER (length(title) > 0), 0), 5), 95) AS INTEGER) AS news_score,
               CAST(count(*) FILTER (length(title) > 0) AS INTEGER) AS news_n,
               string_agg(link, ' ' ORDER BY rn) FILTER (rn <= 3) AS first_links
        FROM (SELECT *, {title_net()} AS net FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pos) AS rn FROM {source}))
        GROUP BY symbol)"""


define("q_news", news_of("q_headlines"))
define("q_prevnews", news_of("q_chat"))
define("q_board", """
  SELECT ticker, CAST(CASE WHEN mentions > 0 THEN row_number() OVER (ORDER BY mentions > 0 DESC, mentions DESC, CAST(substr(ticker, 2) AS BIGINT)) END AS INTEGER) AS rank,
         mentions, upvotes, mentions_24h_ago,
         CAST(CASE WHEN mentions_24h_ago > 0 THEN row_number() OVER (ORDER BY mentions_24h_ago > 0 DESC, mentions_24h_ago DESC, CAST(substr(ticker, 2) AS BIGINT)) END AS INTEGER) AS rank_24h_ago
  FROM (SELECT 'S' || (user_id % n_sym) AS ticker,
               CAST(count(*) FILTER (ts >= TIMESTAMP '2024-01-30') AS INTEGER) AS mentions,
               CAST(count(*) FILTER (ts < TIMESTAMP '2024-01-30') AS INTEGER) AS mentions_24h_ago,
               CAST(count(*) FILTER (ts >= TIMESTAMP '2024-01-30' AND event_type = 'click') AS INTEGER) AS upvotes
        FROM events, q_nsym WHERE ts >= TIMESTAMP '2024-01-29' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1)""")
define("q_hype", f"""
  SELECT u.symbol, rank AS hype_rank, mentions AS hype_mentions,
         {r('(mentions / nullif(mentions_24h_ago, 0)::DOUBLE - 1) * 100', 0)} AS hype_change_pct,
         {r(cl('100 - rank * 0.9', 5, 100), 0)} AS hype_score,
         CASE WHEN rank IS NOT NULL THEN (mentions_24h_ago > 0 AND mentions >= 1.5 * mentions_24h_ago AND mentions >= 30)
              OR coalesce(rank_24h_ago - rank, 0) >= 15 END AS hype_surging
  FROM q_universe u LEFT JOIN (SELECT * FROM q_board WHERE rank IS NOT NULL) b ON b.ticker = u.symbol""")
define("q_earn", f"""
  SELECT symbol, next_earnings, CAST(next_earnings - {AS_OF} AS INTEGER) AS earnings_in_days
  FROM (SELECT symbol, coalesce(min(d) FILTER (d >= {AS_OF}), max(d)) AS next_earnings
        FROM (SELECT 'S' || (o_custkey % n_sym) AS symbol, CAST(o_orderdate AS DATE) + 100 AS d FROM orders, q_nsym) GROUP BY symbol)""")
define("q_themes", f"""
  SELECT 'S' || (p_partkey % n_sym) AS symbol, list_sort(list_distinct(list({case_of('p_type', fx.PART_THEMES)}))) AS tags
  FROM part, q_nsym GROUP BY 1""")
define("q_experts", f"""
  SELECT 'S' || (c_custkey % n_sym) AS symbol, list_sort(list_distinct(list({case_of('c_mktsegment', fx.SEGMENT_SOURCES)}))) AS tags
  FROM customer, q_nsym GROUP BY 1""")
define("q_13f", f"""
  SELECT *, {r('100.0 * gross_value / sum(gross_value) OVER ()', 2)} AS weight_pct,
         CASE WHEN put_value > 0 AND call_value > 0 THEN 'MIXED' WHEN put_value > shares_value THEN 'SHORT_BET' ELSE 'LONG' END AS stance
  FROM (SELECT issuer, CAST(coalesce(sum(v) FILTER (f = 'N'), 0) AS BIGINT) AS shares_value,
               CAST(coalesce(sum(v) FILTER (f = 'A'), 0) AS BIGINT) AS call_value,
               CAST(coalesce(sum(v) FILTER (f = 'R'), 0) AS BIGINT) AS put_value, CAST(sum(v) AS BIGINT) AS gross_value
        FROM (SELECT 'S' || l_suppkey AS issuer, l_returnflag AS f, CAST(round(l_extendedprice) AS BIGINT) AS v FROM lineitem) GROUP BY issuer)""")
define("q_overrides", """
  SELECT 'S' || (doc_id % n_sym) AS symbol, CAST(floor(avg(quality) * 130 - avg(toxic) * 40) AS INTEGER) AS score,
         CASE WHEN avg(quality) > 0.8 THEN 'bullish' WHEN avg(quality) < 0.5 THEN 'bearish' WHEN avg(quality) < 0.7 THEN 'unknown'
              ELSE 'neutral' END AS direction, 'n=' || count(*) AS reason
  FROM labels, q_nsym GROUP BY 1""")
define("q_cache", """
  SELECT symbol, fresh, CASE WHEN mode = 'error' THEN 'not a date' ELSE strftime(last_ts, '%Y-%m-%dT%H:%M:%S') END AS fetched_at,
         mode, hits
  FROM (SELECT 'S' || (user_id % n_sym) AS symbol, ts >= TIMESTAMP '2024-01-29' AS fresh, max(ts) AS last_ts,
               arg_max(event_type, row(ts, event_id)) AS mode, count(*) AS hits FROM events, q_nsym GROUP BY 1, 2)""")

# ---- macro ----------------------------------------------------------------------------------------------------


def _series(source: str, key: str, table: dict) -> str:
    name = f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{s}'" for k, (s, _) in table.items()) + " END"
    scale = f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {d}::DOUBLE" for k, (_, d) in table.items()) + " END"
    return (f"SELECT {name} AS series, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice / {scale}) AS close "
            f"FROM {source} GROUP BY 1, 2")


define("q_quotes_macro", f"""
  SELECT * FROM ({_series('orders', 'o_orderpriority', fx.PRIORITY_SERIES)} UNION ALL
  {_series('(orders JOIN customer ON o_custkey = c_custkey)', 'c_mktsegment', fx.SEGMENT_SERIES)} UNION ALL
  SELECT 'world', CAST(o_orderdate AS DATE), avg(o_totalprice / 1000.0::DOUBLE) FROM orders GROUP BY 2) WHERE series IS NOT NULL""")
define("q_levels", f"""
  SELECT series, {r('max(close) FILTER (rr = 1)', 2)} AS last, {r('arg_max(close, rr)', 2)} AS prior
  FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY d DESC) AS rr FROM q_quotes_macro) WHERE rr <= 21 GROUP BY series""")
_lv = ", ".join(f"max({c}) FILTER (series = '{s}') AS {s}{p}" for s in mc.SERIES for c, p in (("last", ""), ("prior", "_prev")))
_pc = lambda x: f"CASE WHEN {x} > 20 THEN {r(x + ' / 10', 2)} ELSE {r(x, 2)} END"


def _dir(s: str, thr: float) -> str:
    chg = f"({s} / nullif({s}_prev, 0) - 1) * 100"
    return f"CASE WHEN {chg} >= {thr} THEN 'rising' WHEN {chg} <= -{thr} THEN 'falling' ELSE 'flat' END AS {s}_dir"


_days = "DATE '2001-09-17', DATE '2001-11-06', DATE '2001-12-11'"
define("q_macro", f"""
  SELECT *, CASE WHEN tnx_pct - nullif(tnx_prev_pct, 0) >= 0.15 THEN 'rising' WHEN tnx_pct - nullif(tnx_prev_pct, 0) <= -0.15
            THEN 'falling' ELSE 'flat' END AS rate_dir, CAST(fomc_next - {AS_OF} AS INTEGER) AS fomc_in_days
  FROM (SELECT *, {_pc('tnx')} AS tnx_pct, {_pc('tnx_prev')} AS tnx_prev_pct, coalesce(spx > spx_prev, FALSE) AS spx_up,
               {_dir('dxy', 1.5)}, {_dir('oil', 3)}, {_dir('gold', 3)}, {_dir('copper', 3)}, {_dir('silver', 3)}, {_dir('btc', 6)},
               CASE WHEN vix >= 22 THEN 'risk_off' WHEN vix <= 15 THEN 'risk_on' ELSE 'neutral' END AS risk_regime,
               CASE WHEN vix IS NULL THEN 'unbekannt' WHEN vix >= 30 THEN 'Risk-Off (Angst)' WHEN vix >= 22 THEN 'erhöhte Nervosität'
                    WHEN vix <= 15 THEN 'Risk-On (ruhig)' ELSE 'neutral' END AS risk_label,
               (SELECT min(x) FROM (SELECT unnest([{_days}]) AS x) WHERE x >= {AS_OF}) AS fomc_next
        FROM (SELECT {_lv} FROM q_levels))""")
