"""query name -> SQL text whose result must equal the registered query's."""

from __future__ import annotations

import oracle.company as co  # noqa: F401
import oracle.market as mk
import oracle.rating as rg
from oracle.base import cl, compose, define, dv, in_list, picks, pts, r, ri, s0, t0, t1, wm
from tickerloom.operators import holders as hd
from tickerloom.operators import macro as mc
from tickerloom.operators import outlook as ol
from tickerloom.operators import rating as rt
from tickerloom.operators import fundamentals as fund
from tickerloom.operators.lookups import PRICE_COLUMNS
from tickerloom.operators.scores import STAGE_LABELS
from tickerloom.plans import queries as qs
from tickerloom.sources import fixtures as fx

CHECKS: dict[str, str] = {}


def check(name: str, body: str) -> None:
    CHECKS[name] = compose(body)


def case(key: str, table: dict) -> str:
    return f"(CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END)"


# ---- sources and refresh
check("universe_load", """
  SELECT symbol, name, exchange, ord FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ord) AS rn FROM (
    SELECT 'S' || s_suppkey AS symbol, s_name AS name, 'main' AS exchange, s_suppkey * 2 AS ord FROM supplier UNION ALL
    SELECT 'S' || (c_custkey % 700), c_name, c_mktsegment, c_custkey * 2 + 1 FROM customer
    WHERE c_acctbal >= 0 AND c_mktsegment <> 'BUILDING')) WHERE rn = 1""")
check("bars_daily", f"SELECT symbol, ts, {', '.join(f'{r(c, 6)} AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))} FROM q_bars")
check("tags_explode", """
  SELECT symbol, CAST(generate_subscripts(tags, 1) - 1 AS INTEGER) AS pos, unnest(tags) AS tag
  FROM (SELECT * FROM q_themes UNION ALL SELECT * FROM q_experts)""")
check("holder_stance", f"""
  SELECT u.symbol, stance AS holder_stance, weight_pct AS holder_weight_pct, {case('stance', hd.STANCE_LABELS)} AS holder_label
  FROM q_universe u LEFT JOIN q_13f h ON h.issuer = u.symbol""")
check("holder_13f_exposure", "SELECT issuer, shares_value, call_value, put_value, gross_value, weight_pct, stance FROM q_13f")
_f = [d for d in fund.FIELDS.values()]
check("fundamentals_load", "SELECT symbol, " + ", ".join(
    d if d in fund.TEXT_FIELDS or d == "analyst_n" else f"{r(d, 5)} AS {d}" for d in _f) + " FROM q_fund")
check("statements_wide", "SELECT symbol, " + ", ".join(
    f"{r(f'{n}_{p}', 6)} AS {n}_{p}" for p in (0, 1) for n in fund.LINE_ITEMS) + " FROM q_wide")
check("earnings_next", "SELECT symbol, next_earnings, earnings_in_days FROM q_earn")
check("coverage_report", f"""
  SELECT 'S' || c_custkey AS symbol, c_name AS name, coalesce(n, 0) AS n_closes, {r('last_close', 4)} AS last_close,
         CASE WHEN n > 0 THEN 'ok' ELSE 'no_data' END AS status
  FROM customer LEFT JOIN (SELECT symbol, count(*) AS n, arg_max(close, ts) AS last_close FROM q_bars GROUP BY symbol) b
    ON b.symbol = 'S' || c_custkey""")
define("q_merged", "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fresh DESC) AS rn FROM q_cache) WHERE rn = 1")
define("q_stale", """
  SELECT u.symbol, u.ord, CASE WHEN c.symbol IS NULL THEN 'missing' WHEN try_cast(fetched_at AS TIMESTAMP) IS NULL THEN 'unreadable'
         WHEN try_cast(fetched_at AS TIMESTAMP) < TIMESTAMP '2024-01-31' - INTERVAL 12 HOUR THEN 'old' END AS stale_reason
  FROM q_universe u LEFT JOIN q_merged c ON c.symbol = u.symbol""")
check("stale_keys", "SELECT * FROM q_stale WHERE stale_reason IS NOT NULL")
check("refresh_queue", """
  SELECT s.symbol, investment_score, stale_reason FROM q_stale s LEFT JOIN q_usd v ON v.symbol = s.symbol WHERE stale_reason IS NOT NULL
  ORDER BY coalesce(investment_score, 0) DESC, s.ord LIMIT 60""")
check("cache_upsert", "SELECT symbol, fetched_at, mode, hits FROM q_merged")
check("carry_forward", """
  SELECT f.symbol, price, news_score, news_sentiment, news_n FROM q_feat f LEFT JOIN q_prevnews p ON p.symbol = f.symbol""")
check("news_override", """
  SELECT r.symbol, CASE WHEN o.symbol IS NOT NULL THEN least(greatest(score, 0), 100) ELSE news_score END AS news_score,
         CASE WHEN o.symbol IS NULL THEN news_sentiment WHEN direction = 'bullish' THEN 'positiv' WHEN direction = 'bearish' THEN 'negativ' ELSE 'neutral' END AS news_sentiment,
         CASE WHEN o.symbol IS NOT NULL THEN 'KI' END AS news_mode, reason AS news_override_reason
  FROM (SELECT *, row_number() OVER (ORDER BY coalesce(investment_score, 0) DESC, ord) AS place FROM q_rows) r
    LEFT JOIN q_overrides o ON o.symbol = r.symbol""")
# ---- lookups
check("currency_map", f"SELECT symbol, listing, {co.currency('listing')} AS currency FROM q_universe")
check("country_map", "SELECT * FROM q_country")
check("fx_rates", "SELECT currency, usd_rate FROM q_rates")
check("fx_convert", "SELECT symbol, currency, fx_usd::DOUBLE AS fx_usd, fx_missing, " + ", ".join(f'"{c}"' for c in PRICE_COLUMNS) + " FROM q_usd")
check("universe_search", """
  SELECT symbol, name, sector, industry, country, elo_score FROM q_r6
  WHERE contains(lower(concat_ws(' ', coalesce(symbol, 'None'), coalesce(name, 'None'), coalesce(sector, 'None'), coalesce(industry, 'None'),
    coalesce(country, 'None'), coalesce(array_to_string(themes, ' '), ''), coalesce(array_to_string(expert_sources, ' '), ''))), 'industr')
  ORDER BY elo_score DESC, ord LIMIT 40""")
# ---- indicators
for _name, _cols in {**qs.WINDOWED, **qs.FOLDED, "ind_atr": ["atr", "atr_pct"],
                     "ind_volatility": ["vol_daily", "vol_annual_pct", "max_drawdown_pct"]}.items():
    _src = "q_win" if _name in qs.WINDOWED else "q_folded" if _name in qs.FOLDED else "q_raw"
    check(_name, "SELECT symbol, " + ", ".join(f'"{c}"' if c in mk.FLAGS else f'{r(chr(34) + c + chr(34), 4)} AS "{c}"' for c in _cols) + f" FROM {_src}")
define("q_intraday", f"""
  SELECT symbol, o AS open_ret_pct, c AS close_ret_pct, g AS gap_pct, n_days,
         CASE WHEN len(bits) > 0 THEN array_to_string(bits[1:2], ' · ') || ' (Muster aus ' || n_days || ' Tagen, keine Garantie)' END AS intraday_note
  FROM (SELECT *, {picks(
      f"CASE WHEN o <= -0.25 THEN 'neigt nach Handelsstart zum Abverkauf (Ø ' || {t1('o')} || '% 1. Std.) – oft besser 1–2 h nach Open' WHEN o >= 0.25 THEN 'läuft nach Handelsstart meist an (Ø +' || {t1('o')} || '% 1. Std.)' END",
      f"CASE WHEN c >= 0.25 THEN 'zieht oft zum Schluss an (Ø +' || {t1('c')} || '%)' WHEN c <= -0.25 THEN 'schwächelt oft zum Schluss (Ø ' || {t1('c')} || '%)' END",
      f"CASE WHEN g >= 0.4 THEN 'öffnet meist mit Gap up (Ø +' || {t1('g')} || '%) – vorbörslich oft schon teuer' WHEN g <= -0.4 THEN 'öffnet oft schwächer (Gap Ø ' || {t1('g')} || '%)' END")} AS bits
    FROM (SELECT symbol, CAST(count(*) FILTER (n >= 4) AS INTEGER) AS n_days, {r('avg((op[2] / op0 - 1) * 100) FILTER (n >= 4)', 2)} AS o,
                 {r('avg((lastc / cl[n - 2] - 1) * 100) FILTER (n >= 4)', 2)} AS c, {r('avg((op0 / prevc - 1) * 100) FILTER (n >= 4)', 2)} AS g, sum(n) AS bars
          FROM (SELECT symbol, day, n, cl AS op, cl, o[1] AS op0, cl[n] AS lastc, lag(cl[n]) OVER (PARTITION BY symbol ORDER BY day) AS prevc
                FROM (SELECT symbol, CAST(ts AS DATE) AS day, count(*) AS n, list(open ORDER BY ts) AS o, list(close ORDER BY ts) AS cl FROM q_bars30 GROUP BY 1, 2))
          GROUP BY symbol) WHERE bars >= 32 AND n_days >= 8)""")
check("intraday_pattern", "SELECT * FROM q_intraday")
# ---- scores
_day = picks(
    f"CASE WHEN rvol >= 1.5 THEN 'Hohes relatives Volumen (RVOL ' || {t1('rvol')} || '×) – ungewöhnliches Marktinteresse' END",
    f"CASE WHEN price > high20 THEN 'Ausbruch über 20-Tage-Hoch (' || printf('%.2f', {r('high20', 2)}) || ') – Long-Momentum' END",
    f"CASE WHEN price < low20 THEN 'Bruch unter 20-Tage-Tief (' || printf('%.2f', {r('low20', 2)}) || ') – Short-Momentum' END",
    "CASE WHEN macd_hist > 0 AND macd_hist_prev <= 0 THEN 'MACD dreht bullisch (Histogramm kreuzt über Null)' WHEN macd_hist < 0 AND macd_hist_prev >= 0 THEN 'MACD dreht bärisch (Histogramm kreuzt unter Null)' END",
    f"CASE WHEN rsi <= 30 THEN 'RSI überverkauft (' || {t0('rsi')} || ') – Erholungschance' WHEN rsi >= 70 THEN 'RSI überkauft (' || {t0('rsi')} || ') – Rücksetzer-Chance (Short)' END",
    f"CASE WHEN atr_pct >= 2 THEN 'Genug Tagesvolatilität (ATR ' || {t1('atr_pct')} || '%) für eine Trading-Range' WHEN atr_pct < 0.8 THEN 'Sehr niedrige Volatilität (ATR ' || {t1('atr_pct')} || '%) – wenig Bewegung' END",
    f"CASE WHEN abs(daily_return) >= 0.03 THEN 'Kräftige Tagesbewegung (' || {t1('daily_return * 100', '+')} || '%)' END")
check("score_daytrade", f"""
  SELECT symbol, daytrade_score, daytrade_direction, reasons FROM q_feat
  JOIN (SELECT symbol, array_to_string({_day}, ' | ') AS reasons FROM q_raw) USING (symbol)""")
_long = picks(
    "CASE WHEN price > sma200 THEN 'Kurs über 200-Tage-Linie – langfristiger Aufwärtstrend intakt' WHEN sma200 IS NOT NULL THEN 'Kurs unter 200-Tage-Linie – Trend angeschlagen' END",
    "CASE WHEN sma50 > sma200 THEN 'Golden-Cross-Struktur (SMA50 über SMA200)' END",
    f"CASE WHEN rsi BETWEEN 40 AND 55 THEN 'Gesunder Rücksetzer (RSI ' || {t0('rsi')} || ') – attraktiver Einstieg statt überkauft' WHEN rsi < 40 THEN 'RSI niedrig (' || {t0('rsi')} || ') – möglicher Boden, aber Trend prüfen' WHEN rsi > 70 THEN 'RSI überkauft (' || {t0('rsi')} || ') – schlechter Langfrist-Einstieg' END",
    "CASE WHEN price > sma200 AND (price / sma50 - 1) * 100 BETWEEN -3 AND 3 THEN 'Kurs testet die 50-Tage-Linie im Aufwärtstrend – klassischer Einstiegspunkt' END",
    f"CASE WHEN pct_from_high52 BETWEEN -15 AND -3 THEN {t0('abs(pct_from_high52)')} || '% unter 52-Wochen-Hoch – Luft nach oben, aber nahe der Stärke' WHEN pct_from_high52 <= -40 THEN {t0('abs(pct_from_high52)')} || '% unter 52-Wochen-Hoch – tief, spekulativer Turnaround' END",
    f"CASE WHEN ret_60d > 0 THEN 'Positives 3-Monats-Momentum (' || {s0('ret_60d')} || '%)' END",
    "CASE WHEN macd > macd_signal THEN 'MACD über Signallinie – Momentum stützt' END")
check("score_longterm", f"""
  SELECT symbol, longterm_score, reasons FROM q_feat JOIN (SELECT symbol, array_to_string({_long}, ' | ') AS reasons FROM q_raw) USING (symbol)""")
for _c in ("value_score", "quality_score", "growth_score"):
    check("score_" + _c.split("_")[0], f"SELECT symbol, {_c} FROM q_fs")
check("score_fundamental", f"SELECT symbol, fundamental_score, array_to_string(({co.REASONS})[1:5], ' | ') AS reasons FROM q_fs")
check("score_investment", "SELECT symbol, longterm_score, fundamental_score, investment_score FROM q_valued")
check("valuation_metrics", "SELECT symbol, analyst_upside_pct, graham_number, graham_margin_pct, fcf_yield_pct, rule40, roe_pct, revenue_growth_pct, analyst_mean FROM q_valued")
check("magic_formula", "SELECT symbol, magic_score FROM q_magic")
check("piotroski", "SELECT symbol, piotroski, piotroski_n FROM q_deep")
check("altman_z", "SELECT symbol, altman_z FROM q_deep")
check("rs_rating", "SELECT symbol, ret_60d, rs_rating FROM q_rows")
check("minervini", "SELECT symbol, minervini_score, array_to_string(minervini_met, ' | ') AS met, array_to_string(minervini_failed, ' | ') AS failed FROM q_r1")
check("weinstein", "SELECT symbol, weinstein_stage, CASE weinstein_stage " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in STAGE_LABELS.items()) + " END AS weinstein_label FROM q_r1")
for _c in ("tech_trend", "tech_momentum", "tech_volume"):
    check(_c, f"SELECT symbol, {_c} FROM q_r1")
# ---- news, social, macro
check("news_sentiment", "SELECT symbol, news_score, news_sentiment, news_n, first_links FROM q_news")
check("market_sentiment", f"""
  SELECT s AS market_sentiment, CASE WHEN s >= 60 THEN 'positiv' WHEN s <= 40 THEN 'negativ' ELSE 'neutral' END AS market_label, n,
         (SELECT string_agg(link, ' ' ORDER BY pos) FROM (SELECT * FROM q_headlines ORDER BY pos LIMIT 24)) AS links
  FROM (SELECT CAST(least(greatest(50 + 6 * sum({co.title_net()}), 5), 95) AS INTEGER) AS s, count(*) AS n FROM q_headlines)""")
check("hype_signal", "SELECT * FROM q_hype")
check("macro_series", "SELECT series, last, prior FROM q_levels")
check("macro_context", """
  SELECT vix, vix_prev, tnx_pct, tnx_prev_pct, spx, ndx, world, dxy, oil, gold, copper, silver, btc, spx_up, dxy_dir, oil_dir, gold_dir,
         copper_dir, silver_dir, btc_dir, risk_regime, risk_label, rate_dir, fomc_next, fomc_in_days FROM q_macro""")
_hits = lambda ws: "CAST(" + " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}" for w in ws) + " AS BIGINT)"
check("policy_tone", f"""
  SELECT *, CASE WHEN hawk_hits > dove_hits THEN 'hawkish' WHEN dove_hits > hawk_hits THEN 'dovish' ELSE 'neutral' END AS tone
  FROM (SELECT doc_id, {_hits(qs.HAWK_TERMS)} AS hawk_hits, {_hits(qs.DOVE_TERMS)} AS dove_hits FROM documents)""")
check("macro_adjust", "SELECT symbol, macro_pts, macro_notes_n AS notes_n FROM q_r2")
# ---- rating layer
check("composite_elo", f"SELECT symbol, elo, elo_label, elo_color, elo_score, {ri('elo_score / 20.0::DOUBLE')} AS stars FROM q_r6")
for _n, _c in (("quality_rating", "quality"), ("potential", "potential"), ("regime", "regime"), ("conviction", "conviction")):
    check(_n, f"SELECT symbol, {_c} FROM q_r6")
check("momentum_turn", f"SELECT symbol, {r('extension_pct', 4)} AS extension_pct, momentum_turn FROM q_r6")
check("supports", "SELECT symbol, CAST(len(supports) AS INTEGER) AS n, coalesce(array_to_string(list_transform(supports, lambda x: printf('%.2f', x)), ' '), '') AS supports FROM q_sup")
check("downside", f"""
  SELECT symbol, supports[1] AS support1, {r('-(price / supports[1] - 1) * 100', 1)} AS support1_pct, supports[2] AS support2,
         {r('-(price / supports[2] - 1) * 100', 1)} AS support2_pct, downside_risk, {case('d_case', rt.DOWNSIDE_TEXT)} AS downside_verdict FROM q_r6""")
check("falling_knife", f"""
  SELECT symbol, CASE WHEN knife THEN '🔪 Fallendes Messer: Kurs stürzt aktuell steil (' || CASE WHEN ret_5d <= -8 THEN {t0('ret_5d')} || '% in 1 Woche'
         ELSE {t0('ret_20d')} || '% in 1 Monat' END || ') und hat sich noch nicht stabilisiert – nicht hineingreifen, erst einen Boden/Aufwärts-Dreh abwarten.' END AS knife_warn FROM q_r6""")
check("bottoming", "SELECT symbol, bottoming_n, CASE WHEN bottoming_n IS NOT NULL THEN CAST(least(100, 40 + bottoming_n * 8) AS INTEGER) END AS bottoming_strength, bottoming_signals FROM q_r6")
_turn = "(rising OR daytrade_direction = 'LONG')"
check("entry_score", f"""
  SELECT symbol, entry_score, CASE WHEN entry_score >= 70 THEN 'sehr gut' WHEN entry_score >= 55 THEN 'gut' WHEN entry_score >= 45 THEN 'okay' WHEN entry_score >= 32
         THEN 'eher abwarten' ELSE 'schlecht (teuer/heiß)' END AS entry_label, CASE WHEN entry_score >= 55 THEN 'up' WHEN entry_score >= 32 THEN 'soon' ELSE 'down' END AS entry_tone,
         CASE WHEN regime = 'down' AND rsi < 30 AND {_turn} THEN 'Abwärtstrend, aber stark überverkauft und dreht – nur spekulativer Rebound'
              WHEN regime = 'down' THEN 'Abwärtstrend – Rücksetzer sind Fallende-Messer-Risiko, besser meiden'
              WHEN rsi >= 72 THEN 'heißgelaufen (überkauft) – besser einen Rücksetzer abwarten'
              WHEN extension_pct > 15 THEN 'weit über dem Durchschnitt (gestreckt) – nicht hinterherlaufen'
              WHEN daytrade_direction = 'SHORT' THEN 'kurzfristig noch fallend – auf Stabilisierung/Dreh nach oben warten'
              WHEN extension_pct BETWEEN -4 AND 8 AND {_turn} THEN 'gesunder Rücksetzer im Aufwärtstrend, Momentum dreht – günstiges Fenster'
              WHEN rsi < 35 AND {_turn} THEN 'stark abverkauft und dreht nach oben – spekulativer Rebound'
              WHEN {_turn} THEN 'Momentum dreht nach oben – Einstieg wird interessanter' ELSE 'kein klares Einstiegssignal – abwarten oder nur klein antesten' END AS entry_reason
  FROM q_r6""")
check("risk_warnings", f"SELECT symbol, coalesce(array_to_string({picks(f'''CASE WHEN peak_warning THEN '{rt.PEAK_TEXT}' END''', f'''CASE WHEN timing_warning THEN '{rt.TIMING_TEXT}' END''')}, ' | '), '') AS risk_warnings FROM q_r6")
check("urgency", "SELECT symbol, CASE urgency_tone WHEN 'urgent' THEN '⏱️ Sofort (heute)' WHEN 'soon' THEN '📅 Diese Woche' ELSE '🧘 In Ruhe (Langzeit)' END AS urgency, urgency_tone FROM q_r6")
check("upside", "SELECT symbol, upside_pct, exp_return_12m FROM q_r6")
_x = "CAST(round_even(rvol, 1) AS VARCHAR)"
check("volume_signal", f"""
  SELECT symbol, volume_pts, CASE WHEN rvol >= 1.8 AND daily_return_pct >= 1 THEN '🔊 Ungewöhnlich hohes Volumen (' || {_x} || '× normal) bei +' || {t1('daily_return_pct')} || '% – Käufer aktiv (Akkumulation)'
         WHEN rvol >= 1.8 AND daily_return_pct <= -1 THEN '🔊 Ungewöhnlich hohes Volumen (' || {_x} || '× normal) bei ' || {t1('daily_return_pct')} || '% – Verkaufsdruck (Distribution)'
         WHEN rvol >= 1.8 THEN '🔊 Erhöhtes Volumen (' || {_x} || '× normal) – gesteigerte Aufmerksamkeit' END AS volume_note FROM q_r2""")
check("trend_phase", f"""
  SELECT symbol, phase_code, {case('phase_code', {k: v[0] for k, v in rt.PHASES.items()})} AS phase, {case('phase_code', {k: v[1] for k, v in rt.PHASES.items()})} AS phase_tone,
         CASE phase_code WHEN 'down' THEN 'bereits im Abwärtstrend – für Käufe meiden, kein Halten'
              WHEN 'late' THEN 'überkauft/überdehnt (RSI ' || {t0('rsi')} || ') – Teilverkauf oder engen Trailing-Stop erwägen'
              WHEN 'base' THEN 'noch kein Trend – erst den Ausbruch abwarten' WHEN 'sideways' THEN 'kein klarer Trend – nur mit engem Stop'
              ELSE 'kritisch, sobald der Kurs unter die 50-Tage-Linie ($' || printf('%.2f', {r('sma50', 2)}) || ') fällt (Trendbruch)' END
         || CASE WHEN earnings_in_days BETWEEN 0 AND 5 AND weinstein_stage IN (2, 3) THEN ' · Zahlen in ' || earnings_in_days || ' T.: „buy the rumor, sell the news"-Risiko' ELSE '' END AS phase_sell
  FROM q_r6""")
_mega = f"(list_filter(themes, lambda t: list_contains({in_list(list(ol.MEGATRENDS))}, t)))[1]"
_drv = [(6, "CASE WHEN growth_score >= 75 THEN 'Umsatz/Gewinn wachsen kräftig' END"), (5, "CASE WHEN value_score >= 65 THEN 'günstig bewertet' END"),
        (5, "CASE WHEN piotroski >= 7 THEN 'sehr solide Bilanz' END"),
        (4, "CASE WHEN minervini_score >= 80 THEN 'bestätigter Aufwärtstrend' END"),
        (3, "CASE WHEN coalesce(minervini_score < 80, TRUE) AND weinstein_stage = 2 AND longterm_score >= 58 THEN 'intakter Aufwärtstrend' END"),
        (3, f"CASE WHEN a3 AND analyst_upside_pct >= 12 THEN 'Analysten sehen +' || {t0('analyst_upside_pct')} || '% Kursziel' END"),
        (2, "CASE WHEN daytrade_direction = 'LONG' THEN 'kurzfristig kaufen die Anleger zu' END"), (2, "CASE WHEN news_sentiment = 'positiv' THEN 'positive Nachrichtenlage' END"),
        (2, f"'Rückenwind aus Megatrend ' || {_mega}"), (1, "'von ' || expert_sources[1] || ' empfohlen'"),
        (3, f"CASE WHEN holder_stance = 'LONG' THEN 'Smart Money ({ol.HOLDER_SHORT}) ist long' END")]
check("bull_thesis", f"""
  SELECT symbol, coalesce(string_agg(t, ' · ' ORDER BY w DESC, i), 'Keine starken Aufwärtstreiber erkennbar – eher neutral bis abwartend.') AS bull_thesis
  FROM (SELECT s.symbol, t, w, i FROM (SELECT symbol FROM q_r6) s LEFT JOIN
    (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY w DESC, i) AS place FROM (
      {' UNION ALL '.join(f'SELECT symbol, {w} AS w, {i} AS i, {t} AS t FROM q_r6' for i, (w, t) in enumerate(_drv))}) WHERE t IS NOT NULL) d
    ON d.symbol = s.symbol AND place <= 3) GROUP BY symbol""")
_flags = picks("CASE WHEN rsi >= 72 THEN 'technisch heißgelaufen' END", "CASE WHEN a3 AND analyst_upside_pct < 3 THEN 'kaum Luft zum Kursziel' END",
               "CASE WHEN peak_warning THEN 'Spitzenzyklus' END", "CASE WHEN list_contains(themes, 'Rüstung') THEN 'Rüstung trägt Kriegsprämie (Friedensrisiko)' END",
               "CASE WHEN hype_surging THEN 'Retail-Hype' END")
check("priced_in", f"SELECT symbol, CASE WHEN len({_flags}) > 0 THEN 'Viel Optimismus schon eingepreist: ' || array_to_string({_flags}, ', ') END AS priced_in FROM q_r6")
_sum = [
    """CASE WHEN longterm_score >= 70 THEN 'Die Aktie steckt in einem stabilen Aufwärtstrend' WHEN longterm_score >= 45 THEN 'Der Trend ist grundsätzlich intakt, aber nicht überragend' ELSE 'Der langfristige Trend ist derzeit schwach' END
       || CASE WHEN rsi BETWEEN 40 AND 55 AND longterm_score >= 55 THEN ', und der Kurs ist gerade etwas zurückgekommen – oft ein günstiger Einstiegsmoment.' WHEN rsi > 70 THEN ' – der Kurs ist zuletzt aber heiß gelaufen (überkauft).' WHEN rsi < 30 THEN ' – aktuell ist er stark abverkauft, eine Gegenbewegung ist möglich.' ELSE '.' END""",
    """CASE WHEN fundamental_score IS NOT NULL THEN CASE WHEN quality_score >= 70 THEN 'Das Unternehmen verdient solide' WHEN quality_score < 40 THEN 'Die Ertragskraft ist schwach' ELSE 'Die Geschäftszahlen sind durchschnittlich' END
       || CASE WHEN value_score >= 65 THEN ' und ist dabei günstig bewertet.' WHEN value_score <= 35 THEN ', ist aber hoch bewertet (teuer).' WHEN value_score IS NOT NULL THEN ' zu einer fairen Bewertung.' ELSE '.' END END""",
    f"""CASE WHEN a3 THEN analyst_n || ' Analysten: Konsens „' || {case('analyst_rating', ol.CONSENSUS)} || '", Ø-Kursziel ' || CASE WHEN analyst_upside_pct >= 0 THEN '+' ELSE '' END || {t0('analyst_upside_pct')} || '% zum aktuellen Kurs.' END""",
    "CASE WHEN minervini_score >= 80 THEN 'Erfüllt Minervinis Trend-Template (bestätigter Aufwärtstrend).' END",
    "CASE WHEN weinstein_stage = 4 THEN 'Weinstein-Phase 4 (Abwärtstrend) – für Käufe meiden.' WHEN weinstein_stage = 2 AND coalesce(minervini_score < 80, TRUE) THEN 'Weinstein-Phase 2 (Aufwärtstrend).' END",
    "CASE WHEN piotroski >= 8 THEN 'Bilanz sehr solide (Piotroski ' || piotroski || '/9).' WHEN piotroski <= 2 THEN 'Bilanz schwach (Piotroski ' || piotroski || '/9).' END",
    "CASE WHEN altman_z < 1.81 THEN '⚠️ Erhöhtes Pleiterisiko (Altman-Z ' || CAST(altman_z AS VARCHAR) || ').' END",
    "CASE WHEN daytrade_direction = 'LONG' AND daytrade_score >= 45 THEN 'Kurzfristig greifen gerade Käufer zu.' WHEN daytrade_direction = 'SHORT' AND daytrade_score >= 45 THEN 'Kurzfristig haben die Verkäufer die Oberhand.' END",
    "CASE news_sentiment WHEN 'positiv' THEN 'Die aktuellen Schlagzeilen sind überwiegend positiv.' WHEN 'negativ' THEN 'Achtung: die aktuellen Schlagzeilen sind überwiegend negativ.' END",
    f"CASE WHEN hype_surging THEN 'Auf Reddit stark diskutiert (Rang ' || hype_rank || coalesce(', Erwähnungen ' || {s0('hype_change_pct')} || '%', '') || ') – hohe Retail-Aufmerksamkeit, aber auch Hype-Risiko.' END",
    "CASE WHEN earnings_in_days BETWEEN 0 AND 10 THEN '📅 Zahlen ' || CASE WHEN earnings_in_days = 0 THEN 'heute' ELSE 'in ' || earnings_in_days || ' Tagen' END || ' (' || CAST(next_earnings AS VARCHAR) || ') – bis dahin oft erhöhte Schwankung.' END",
    f"CASE holder_stance WHEN 'LONG' THEN '{ol.HOLDER_LONG} setzt hier auf steigende Kurse (rund ' || CAST(holder_weight_pct AS VARCHAR) || '% seines Fonds).' "
    f"WHEN 'SHORT_BET' THEN 'Achtung: {ol.HOLDER_SHORT} wettet über Put-Optionen gegen diese Aktie – er rechnet eher mit fallenden Kursen.' "
    f"WHEN 'MIXED' THEN '{ol.HOLDER_SHORT} hält hier gleichzeitig auf steigende und fallende Kurse gerichtete Positionen (Absicherung).' END"]
check("plain_summary", f"SELECT symbol, concat_ws(' ', {', '.join(_sum)}) AS plain_summary FROM q_r6")
_act = picks(
    "CASE WHEN holder_stance = 'SHORT_BET' THEN 'neg:Vorsicht: Smart Money wettet dagegen' END",
    "CASE WHEN daytrade_direction = 'LONG' AND daytrade_score >= 50 THEN 'pos:Momentum-Long (kurzfristig)' WHEN daytrade_direction = 'SHORT' AND daytrade_score >= 50 THEN 'neg:Short-Setup (kurzfristig)' END",
    "CASE WHEN longterm_score >= 65 AND rsi BETWEEN 38 AND 57 THEN 'pos:Rücksetzer-Einstieg beobachten' END",
    "CASE WHEN fundamental_score >= 70 AND value_score >= 60 THEN 'pos:Günstige Qualität – fürs Langfrist-Depot' END",
    "CASE WHEN rsi >= 72 AND value_score <= 40 THEN 'neg:Abwarten – teuer & überkauft' END", "CASE WHEN rsi <= 28 THEN 'neutral:Spekulativer Rebound möglich' END",
    "CASE WHEN news_n >= 2 AND news_score <= 38 THEN 'neg:Negative News – abwarten' WHEN news_n >= 2 AND news_score >= 62 THEN 'pos:Positive News – Rückenwind' END",
    "CASE WHEN earnings_in_days BETWEEN 0 AND 7 THEN 'neutral:Zahlen in ' || earnings_in_days || ' T. – Vorsicht' END",
    "CASE WHEN hype_surging THEN 'neutral:🔥 Reddit-Hype (Rang ' || hype_rank || ')' END", "CASE WHEN minervini_score >= 80 THEN 'pos:Minervini Stage-2 ✓' END",
    "CASE WHEN altman_z < 1.81 THEN 'neg:⚠️ Pleiterisiko (Altman)' END", "CASE WHEN piotroski >= 8 THEN 'pos:Bilanz stark (Piotroski ' || piotroski || '/9)' END",
    f"CASE WHEN analyst_n >= 5 AND analyst_upside_pct >= 20 THEN 'pos:Analysten-Kursziel +' || {t0('analyst_upside_pct')} || '%' WHEN analyst_n >= 5 AND analyst_upside_pct <= -5 THEN 'neg:Kurs über Analysten-Ziel' END",
    f"CASE WHEN holder_stance = 'LONG' THEN 'pos:{ol.HOLDER_SHORT}-Konviktion (long)' END")
check("actions", f"SELECT symbol, coalesce(nullif(array_to_string(({_act})[1:3], ' | '), ''), 'neutral:Beobachten') AS actions FROM q_r6")
_ACT = {k: v for k, v in ol.ACTIONS.items()}
check("trade_plan", f"""
  SELECT p.*, {case('action_code', {k: v[0] for k, v in _ACT.items()})} AS action, {case('action_code', {k: v[1] for k, v in _ACT.items()})} AS action_tone,
         {case('action_code', {k: v[2] for k, v in _ACT.items()})} AS entry_when
  FROM (SELECT 'invest' AS context, * FROM q_plan_long UNION ALL SELECT 'trade', * FROM q_plan_short) p""")
_bs = f"(coalesce(daytrade_score, 0) * {rg.SIGN} * 0.7 + coalesce(investment_score - 50, 0) * 0.3)"
_hz = " UNION ALL ".join(f"SELECT '{m}' AS mode, '{n}' AS label, {d} AS days" for m, hs in (("s", ol.SHORT_HORIZONS), ("l", ol.LONG_HORIZONS)) for n, d in hs)
check("projection", f"""
  SELECT symbol, label, CAST(days AS INTEGER) AS days, CASE WHEN bias > 12 THEN 'eher aufwärts' WHEN bias < -12 THEN 'eher abwärts' ELSE 'eher seitwärts' END AS direction,
         {r('c', 1)} AS center_pct, {r('price * (1 + c / 100)', 2)} AS expected_price, {r('c - sg', 1)} AS low_pct, {r('c + sg', 1)} AS high_pct,
         {r('price * (1 + (c - sg) / 100)', 2)} AS low_price, {r('price * (1 + (c + sg) / 100)', 2)} AS high_price, conf AS confidence_pct,
         CASE WHEN conf >= 68 THEN 'hoch' WHEN conf >= 58 THEN 'mittel' ELSE 'niedrig' END AS confidence_label
  FROM (SELECT *, {cl('drift * (days / 252.0::DOUBLE)', -60, 90)} AS c, vd * sqrt(days) * 100 AS sg,
               {ri('50 + least(28, abs(bias) * 0.5) * (1 / (1 + days / 45.0::DOUBLE))')} AS conf
        FROM (SELECT symbol, price, {rg.VD} AS vd, label, days, CASE WHEN mode = 's' THEN {_bs} ELSE {rg.BIAS_L} END AS bias,
                     CASE WHEN mode = 's' THEN {cl(_bs + ' * 0.25', -25, 25)} ELSE {rg.DRIFT_L} END AS drift
              FROM q_r2, ({_hz})))""")
check("snapshot", """
  SELECT symbol, listing, price, rsi, adx, longterm_score, daytrade_score, daytrade_direction, fundamental_score, investment_score, rs_rating,
         minervini_score, weinstein_stage, macro_pts, elo, elo_score, quality, potential, conviction, entry_score, downside_risk, regime, phase_code,
         exp_return_12m, action_code FROM q_r6 JOIN (SELECT symbol, action_code FROM q_plan_long) USING (symbol)""")
# ---- lists and reports
check("top_daytrade", "SELECT symbol, daytrade_score, daytrade_direction FROM q_r6 ORDER BY daytrade_score DESC, ord LIMIT 10")
check("top_longterm", "SELECT symbol, investment_score, exp_return_12m FROM q_r6 ORDER BY coalesce(investment_score, 0) + coalesce(least(greatest(exp_return_12m, -30), 50) * 0.6::DOUBLE, 0) DESC, ord LIMIT 10")
check("top_fundamental", "SELECT symbol, fundamental_score FROM q_r6 WHERE fundamental_score IS NOT NULL ORDER BY fundamental_score DESC, ord LIMIT 10")
check("top_holdings", "SELECT symbol, holder_stance, holder_weight_pct FROM q_r6 WHERE holder_stance IS NOT NULL")
check("top_hype", "SELECT symbol, hype_rank, hype_score, hype_surging FROM q_r6 WHERE hype_rank IS NOT NULL ORDER BY hype_score DESC, ord LIMIT 10")
_dn = lambda a, b: f"CASE downside_risk WHEN 'gering' THEN {a} WHEN 'hoch' THEN {b} ELSE 0 END"
check("best_entries", f"""
  SELECT symbol, opp AS entry_opportunity, entry_score, elo_score FROM (SELECT *, {r(f'entry_score * 0.6::DOUBLE + elo_score * 0.3::DOUBLE + {_dn(12, -18)} - 14 * warnings', 1)} AS opp FROM q_r6)
  WHERE entry_score >= 58 AND elo_score >= 45 AND downside_risk <> 'hoch' AND warnings = 0 ORDER BY opp DESC, ord LIMIT 40""")
check("daily_top3", f"""
  SELECT symbol, conv AS daily_conviction, entry_score, elo_score
  FROM (SELECT *, {r(f'elo_score * 0.4::DOUBLE + entry_score * 0.35::DOUBLE + conviction * 0.15::DOUBLE + {_dn(10, -25)} + CASE WHEN bottoming_n IS NOT NULL THEN -8 ELSE 0 END', 1)} AS conv FROM q_r6)
  JOIN (SELECT symbol, action_code FROM q_plan_long) USING (symbol)
  WHERE NOT coalesce(list_contains(themes, 'ETF'), FALSE) AND listing NOT LIKE '%-USD' AND NOT knife AND warnings = 0 AND entry_score >= 55 AND elo_score >= 55
    AND downside_risk <> 'hoch' AND action_code IN ('base', 'buy', 'staged') ORDER BY conv DESC, ord LIMIT 3""")
for _n, _c, _lim in (("theme_leaderboard", "themes", "WHERE place <= 60"), ("expert_leaderboard", "expert_sources", "")):
    check(_n, f"""
  SELECT tag, tag_count, CAST(place AS INTEGER) AS place, symbol, elo_score
  FROM (SELECT *, count(*) OVER (PARTITION BY tag) AS tag_count, row_number() OVER (PARTITION BY tag ORDER BY elo_score DESC, ord) AS place
        FROM (SELECT symbol, ord, elo_score, unnest({_c}) AS tag FROM q_r6)) {_lim}""")
check("verdicts", f"""
  SELECT symbol, CASE WHEN phase_code IN ('early_up', 'mid_up') THEN 'up' WHEN phase_code = 'down' THEN 'down' ELSE 'side' END AS invest_direction,
         CASE daytrade_direction WHEN 'LONG' THEN 'up' WHEN 'SHORT' THEN 'down' ELSE 'side' END AS trade_direction,
         CASE WHEN altman_z > 2.99 THEN 'sicher' WHEN altman_z >= 1.81 THEN 'Graubereich' WHEN altman_z < 1.81 THEN 'kritisch!' END AS altman_zone,
         coalesce(exp_return_12m < 7, FALSE) AS below_market_12m, hv AS high_volatility,
         CASE WHEN hv THEN '⚠️ Sehr schwankungsstark · ±' || {t0('atr_pct')} || '%/Tag' END AS volatility_badge, {s0('exp_return_12m')} || '%' AS scenario_median,
         '+' || {t0('potential_pct')} || '%' AS scenario_chance, '−' || {t0('risk_pct')} || '%' AS scenario_risk
  FROM (SELECT *, coalesce(atr_pct >= 5, FALSE) OR coalesce(beta >= 1.8, FALSE) AS hv FROM q_r6) JOIN (SELECT symbol, potential_pct, risk_pct FROM q_plan_long) USING (symbol)""")
# ---- backtest
define("q_cal", "SELECT date_trunc('month', ts)::DATE AS month, max(ts) AS rebalance FROM q_bars GROUP BY 1")
check("rebalance_dates", "SELECT month, rebalance FROM q_cal")
define("q_hist", f"""
  SELECT b.*, f.sig AS macd_signal, f.e12 - f.e26 AS macd, CASE WHEN f.i > 14 THEN 100 - 100 / (1 + f.g / nullif(f.l, 0)) END AS rsi, b.close AS price,
         (b.close / high52 - 1) * 100 AS pct_from_high52, CASE WHEN n > 61 THEN (b.close / c60 - 1) * 100 END AS ret_60d
  FROM q_b3 b JOIN q_fold f ON f.symbol = b.symbol AND f.ts = b.ts WHERE b.symbol IN (SELECT symbol FROM q_bars GROUP BY symbol HAVING count(*) > 472)""")
define("q_scored", f"SELECT symbol, ts, n, {mk.g2()} AS longterm_score FROM q_hist")
check("score_series", "SELECT symbol, ts, longterm_score FROM q_scored WHERE n >= 220")
_ld = ", ".join(f"(lead(close, {h}) OVER w / close - 1) * 100 AS fwd_{h}" for h in (21, 63, 126, 252))
define("q_fwd", f"SELECT symbol, ts, CAST(count(*) OVER (PARTITION BY symbol) - row_number() OVER w AS INTEGER) AS n_future, {_ld} FROM q_bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)")
check("forward_returns", "SELECT symbol, ts, n_future, " + ", ".join(f"{r(f'fwd_{h}', 6)} AS fwd_{h}" for h in (21, 63, 126, 252)) + " FROM q_fwd")
define("q_asof", f"""
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY rebalance) AS names FROM (
    SELECT c.rebalance, s.*, n_future, fwd_21, fwd_63, fwd_126, fwd_252
    FROM q_cal c JOIN (SELECT *, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS next_ts FROM q_scored) s
      ON s.ts <= c.rebalance AND (s.next_ts IS NULL OR s.next_ts > c.rebalance) JOIN q_fwd f ON f.symbol = s.symbol AND f.ts = s.ts
    WHERE n >= 220 AND n_future >= 21)) WHERE names >= 15""")
define("q_panel", " UNION ALL ".join(f"SELECT symbol, rebalance, {h} AS horizon, longterm_score, {r(f'fwd_{h}', 9)} AS fwd_ret FROM q_asof WHERE fwd_{h} IS NOT NULL" for h in (21, 63, 126, 252)))
check("backtest_scores", f"SELECT symbol, rebalance, horizon, longterm_score, {r('fwd_ret', 6)} AS fwd_ret FROM q_panel")
define("q_ranked", """
  SELECT *, CAST(least(4, floor((sr - 1) * 5 / n)) AS INTEGER) AS bucket, row_number() OVER (PARTITION BY rebalance, horizon ORDER BY fwd_ret, sr) AS rr
  FROM (SELECT p.*, count(*) OVER (PARTITION BY rebalance, horizon) AS n, row_number() OVER (PARTITION BY rebalance, horizon ORDER BY longterm_score, ord) AS sr
        FROM q_panel p JOIN q_universe USING (symbol)) WHERE n >= 15""")
check("backtest_buckets", f"SELECT rebalance, horizon, bucket, count(*) AS names, {r('avg(fwd_ret)', 3)} AS avg_fwd_ret FROM q_ranked GROUP BY ALL")
check("backtest_ic", f"SELECT rebalance, horizon, count(*) AS names, {r('corr(sr, rr)', 4)} AS ic FROM q_ranked GROUP BY ALL")
check("backtest_summary", f"""
  SELECT d.*, {', '.join(f'bucket_{b}_pct' for b in range(5))} FROM
    (SELECT horizon, count(*) AS n_dates, {r('avg(ic)', 3)} AS avg_ic, {r('avg(spread)', 3)} AS top_minus_bottom_pct,
            {r('count(*) FILTER (spread > 0) / count(spread)::DOUBLE * 100', 1)} AS hit_rate_pct
     FROM (SELECT rebalance, horizon, {r('corr(sr, rr)', 4)} AS ic, {r('avg(fwd_ret) FILTER (bucket = 4)', 3)} - {r('avg(fwd_ret) FILTER (bucket = 0)', 3)} AS spread
           FROM q_ranked GROUP BY ALL) GROUP BY horizon) d
    JOIN (SELECT horizon, {', '.join(f"{r(f'avg(fwd_ret) FILTER (bucket = {b})', 3)} AS bucket_{b}_pct" for b in range(5))} FROM q_ranked GROUP BY horizon) p USING (horizon)""")
# ---- portfolio
define("q_newest", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rr FROM q_bars")
define("q_pos", f"""
  SELECT t.symbol, name, {r('entry', 4)} AS entry_price, {r('peak', 4)} AS peak0, entry_date, 900.0::DOUBLE AS stake, CAST(60 + ord % 30 AS INTEGER) AS score_at_entry
  FROM (SELECT symbol, sum(volume) AS traded, max(close) FILTER (rr = 61) AS entry, max(ts) FILTER (rr = 61) AS entry_date,
               max(close) FILTER (rr BETWEEN 11 AND 61) AS peak FROM q_newest GROUP BY symbol ORDER BY traded DESC, symbol LIMIT 10) t JOIN q_universe USING (symbol)""")
define("q_marked", f"""
  SELECT p.symbol, p.name, entry_price, entry_date, stake, score_at_entry, {r('greatest(peak0, price)', 4)} AS peak_price, {r('price', 4)} AS last_price,
         {r('stake * price / entry_price', 2)} AS value, {r(r('stake * price / entry_price', 2) + ' - stake', 2)} AS pnl, {r('(price / entry_price - 1) * 100', 2)} AS pnl_pct,
         price AS cur, elo_score, phase_code, sector
  FROM q_pos p JOIN q_r6 USING (symbol)""")
check("portfolio_mark", "SELECT * EXCLUDE (cur, elo_score, phase_code, sector) FROM q_marked")
define("q_place", "SELECT *, row_number() OVER (ORDER BY elo_score DESC, ord) AS place FROM q_r6")
define("q_sold", f"""
  SELECT * FROM (SELECT m.*, (cur / entry_price - 1) * 100 AS ret, (cur / peak_price - 1) * 100 AS give,
    CASE WHEN (cur / entry_price - 1) * 100 <= -22 THEN 'hard_stop' WHEN (peak_price / entry_price - 1) * 100 >= 12 AND (cur / peak_price - 1) * 100 <= -10 THEN 'trailing_stop'
         WHEN m.phase_code = 'down' THEN 'downtrend' WHEN m.elo_score < 50 THEN 'score' WHEN place > 16 AND m.elo_score < 60 THEN 'dropped' END AS sell_code
    FROM q_marked m JOIN (SELECT symbol, place FROM q_place) USING (symbol)) WHERE sell_code IS NOT NULL""")
_reason = f"""CASE sell_code WHEN 'hard_stop' THEN 'Not-Stop (' || {s0('ret')} || '%)' WHEN 'trailing_stop' THEN 'Trailing-Stop – Gewinn gesichert (' || {s0('ret')} || '%, vom Hoch ' || {t0('give')} || '%)'
    WHEN 'downtrend' THEN 'Trend gedreht (Abwärtstrend) → raus (' || {s0('ret')} || '%)' WHEN 'score' THEN 'Rating auf ' || elo_score || ' gefallen → These weg (' || {s0('ret')} || '%)'
    ELSE 'aus den Top-Tipps gefallen (' || {s0('ret')} || '%)' END || CASE WHEN score_at_entry <> elo_score THEN ' · Rating ' || score_at_entry || '→' || elo_score ELSE '' END"""
check("portfolio_sells", f"""
  SELECT symbol, sell_code, {r('cur', 4)} AS price, {r('stake * cur / entry_price', 2)} AS value, {r('stake * cur / entry_price - stake', 2)} AS pnl, {r('ret', 2)} AS pnl_pct,
         score_at_entry AS score_entry, elo_score AS score_exit, {_reason} AS reason FROM q_sold""")
define("q_kept", "SELECT * FROM q_marked WHERE symbol NOT IN (SELECT symbol FROM q_sold)")
define("q_book", """
  SELECT cash, (cash + inv) / 10 AS target, 10 - open AS slots
  FROM (SELECT 1500 + coalesce((SELECT sum(stake * cur / entry_price) FROM q_sold), 0) AS cash, coalesce(sum(value), 0) AS inv, count(*) AS open FROM q_kept)""")
define("q_cand", """
  SELECT c.*, row_number() OVER (PARTITION BY c.sector ORDER BY place) AS in_sector, coalesce(held, 0) AS held
  FROM q_place c LEFT JOIN (SELECT sector, count(*) AS held FROM q_kept GROUP BY sector) h ON h.sector = c.sector
  WHERE place <= 50 AND elo_score >= 60 AND phase_code <> 'down' AND coalesce(holder_stance, '') <> 'SHORT_BET' AND symbol NOT IN (SELECT symbol FROM q_kept)""")
define("q_bought", """
  SELECT * FROM (SELECT *, least(target, cash - (i - 1) * target) AS s FROM
    (SELECT *, row_number() OVER (ORDER BY place) AS i FROM q_cand WHERE in_sector <= 3 - held), q_book) WHERE i <= slots AND s >= 50""")
check("portfolio_buys", f"SELECT symbol, sector, {r('price', 4)} AS entry_price, {r('s', 2)} AS stake, elo_score AS score_at_entry, CAST(i AS INTEGER) AS buy_rank FROM q_bought")
define("q_today", "SELECT max(ts) AS today FROM q_bars")
check("portfolio_trades", f"""
  SELECT today AS date, 'SELL' AS action, symbol, name, {r('cur', 4)} AS price, {r('stake', 2)} AS stake, {r('stake * cur / entry_price', 2)} AS value, {r('stake * cur / entry_price - stake', 2)} AS pnl,
         {r('ret', 2)} AS pnl_pct, score_at_entry AS score_entry, elo_score AS score_exit, CAST(today - entry_date AS INTEGER) AS held_days, {_reason} AS reason FROM q_sold, q_today
  UNION ALL SELECT today, 'BUY', symbol, name, {r('price', 4)}, {r('s', 2)}, {r('s', 2)}, 0.0, 0.0, NULL, NULL, NULL, 'Top-Tipp gekauft (Score ' || elo_score || ')' FROM q_bought, q_today""")
define("q_curve", f"""
  SELECT date, equity, bench_sp500, bench_ndx, bench_world FROM (SELECT ts AS date, {r('avg(close) * 100', 2)} AS equity FROM q_bars GROUP BY ts)
  LEFT JOIN (SELECT d AS date, {r("max(close) FILTER (series = 'spx')", 2)} AS bench_sp500, {r("max(close) FILTER (series = 'ndx')", 2)} AS bench_ndx,
                    {r("max(close) FILTER (series = 'world')", 2)} AS bench_world FROM q_quotes_macro GROUP BY d) USING (date)""")
define("q_day", f"""
  SELECT today AS date, {r('cash0 + inv', 2)} AS equity, {r('cash0', 2)} AS cash, {r('inv', 2)} AS invested, CAST(n AS INTEGER) AS n_positions, {r('spx', 2)} AS bench_sp500, {r('ndx', 2)} AS bench_ndx, {r('world', 2)} AS bench_world
  FROM (SELECT cash - coalesce((SELECT sum(s) FROM q_bought), 0) AS cash0, (SELECT coalesce(sum(value), 0) FROM q_kept) + coalesce((SELECT sum({r('s', 2)}) FROM q_bought), 0) AS inv,
               (SELECT count(*) FROM q_kept) + (SELECT count(*) FROM q_bought) AS n FROM q_book), q_today, q_macro""")
check("equity_snapshot", "SELECT * FROM q_curve WHERE date NOT IN (SELECT date FROM q_day) UNION ALL SELECT date, equity, bench_sp500, bench_ndx, bench_world FROM q_day")
define("q_log", f"""
  SELECT symbol, {r('(p1 / p0 - 1) * 100', 2)} AS pnl_pct, CAST(d1 - d0 AS INTEGER) AS held FROM (SELECT symbol, date_trunc('month', ts) AS m, min(ts) AS d0, max(ts) AS d1, arg_min(close, ts) AS p0, arg_max(close, ts) AS p1
    FROM q_bars GROUP BY 1, 2)""")
check("portfolio_summary", f"""
  SELECT equity, cash, invested, {r('(equity / 10000 - 1) * 100', 2)} AS total_return_pct, {r('250 + coalesce((SELECT sum(stake * cur / entry_price - stake) FROM q_sold), 0)', 2)} AS realized_pnl, n_positions,
         2 * (SELECT count(*) FROM q_log) + (SELECT count(*) FROM q_sold) + (SELECT count(*) FROM q_bought) AS n_trades FROM q_day""")
check("portfolio_next_state", f"""
  SELECT 10000.0::DOUBLE AS start_capital, cash, {r('250 + coalesce((SELECT sum(stake * cur / entry_price - stake) FROM q_sold), 0)', 2)} AS realized_pnl, date AS last_trade_date FROM q_day""")
check("portfolio_rerun", "SELECT symbol, stake, score_at_entry, value FROM q_marked")
_b3 = ("bench_sp500", "bench_ndx", "bench_world")
_mv = lambda c: f"(CASE WHEN points >= 2 THEN (arg_z.{c} / nullif(arg_a.{c}, 0) - 1) * 100 END)"
_rb = ", ".join(f"c.{b} / (SELECT arg_min({b}, date) FROM q_curve WHERE {b} IS NOT NULL) * 10000 AS {b}" for b in _b3)
check("equity_vs_benchmark", f"""
  SELECT points, {r(_mv('equity'), 4)} AS depot_pct, {', '.join(f"{r(_mv(b), 4)} AS {b}_pct" for b in _b3)},
         {r('(' + ' + '.join(f'coalesce({_mv("equity")} - {_mv(b)}, 0)' for b in _b3) + ') / nullif(' + ' + '.join(f'(({_mv(b)}) IS NOT NULL)::INT' for b in _b3) + ', 0)', 4)} AS excess_pct
  FROM (SELECT count(*) AS points FROM q_curve WHERE date >= DATE '2000-11-04'), (SELECT equity, {_rb} FROM q_curve c WHERE date >= DATE '2000-11-04' ORDER BY date LIMIT 1) arg_a,
       (SELECT equity, {_rb} FROM q_curve c WHERE date >= DATE '2000-11-04' ORDER BY date DESC LIMIT 1) arg_z""")
check("trade_stats", f"""
  SELECT count(*) AS n_trades, {r('count(*) FILTER (pnl_pct > 0) / count(pnl_pct)::DOUBLE * 100', 2)} AS hit_rate_pct, {r('avg(pnl_pct)', 4)} AS avg_return_pct, {r('avg(held)', 4)} AS avg_held_days,
         {r('coalesce(avg(pnl_pct) FILTER (pnl_pct > 0), 0)', 4)} AS avg_win_pct, {r('coalesce(avg(pnl_pct) FILTER (pnl_pct <= 0), 0)', 4)} AS avg_loss_pct FROM q_log""")
check("open_positions", f"SELECT symbol, name, entry_date, CAST({mk.AS_OF} - entry_date AS INTEGER) AS days_held, entry_price, last_price, pnl_pct, stake, value, pnl FROM q_marked")
# ---- streaming
define("q_wm", "SELECT max(ts) - INTERVAL 2 HOUR AS wm FROM events")
check("stream_bars30", f"SELECT symbol, ts, {', '.join(f'{r(c, 4)} AS {c}' for c in ('open', 'high', 'low', 'close'))}, volume FROM q_bars30, q_wm WHERE ts + INTERVAL 30 MINUTE <= wm")
check("stream_dedup", "SELECT event_id, user_id, event_type, value FROM events")
define("q_mh", "SELECT user_id, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY user_id, h")
define("q_mc", """
  SELECT 'S' || user_id AS symbol, start, sum(n) AS mentions FROM (SELECT user_id, h - to_hours(k) AS start, n FROM q_mh, range(0, 24) AS t(k))
  WHERE start <= (SELECT wm - INTERVAL 24 HOUR FROM q_wm) GROUP BY user_id, start""")
check("stream_mention_surge", f"""
  SELECT symbol, start, CAST(mentions AS BIGINT) AS mentions, CAST(mentions_before AS BIGINT) AS mentions_before, {r('(mentions / mentions_before::DOUBLE - 1) * 100', 0)} AS change_pct
  FROM (SELECT symbol, start, mentions, max(mentions) OVER (PARTITION BY symbol ORDER BY start RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 24 HOUR PRECEDING) AS mentions_before FROM q_mc)
  WHERE mentions >= 1.5 * mentions_before AND mentions >= 10""")
check("stream_sessions", """
  SELECT symbol, start, "end", mentions FROM (SELECT symbol, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS mentions FROM
    (SELECT *, sum(brk) OVER (PARTITION BY symbol ORDER BY ts) AS grp FROM (SELECT 'S' || user_id AS symbol, ts,
       CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY symbol, grp), q_wm WHERE "end" <= wm""")
_RUNNING = ("macd", "macd_signal", "macd_hist", "rsi", "atr", "ema9", "ema21", "adx", "plus_di", "minus_di")
check("stream_indicators", f"SELECT symbol, {', '.join(f'{r(c, 4)} AS {c}' for c in _RUNNING)}, supertrend_up, psar_bull FROM q_folded")
check("stream_alerts", f"""
  SELECT symbol, ts, rvol, ret_5d, CASE WHEN ret_5d <= -8 THEN 'drop' ELSE 'volume' END AS alert
  FROM (SELECT symbol, ts, {r('volume / nullif(vol_avg20, 0)', 4)} AS rvol, {r('(close / nullif(c5, 0) - 1) * 100', 4)} AS ret_5d
        FROM (SELECT *, lag(close, 5) OVER (PARTITION BY symbol ORDER BY ts) AS c5 FROM q_bars) JOIN (SELECT symbol, vol_avg20 FROM q_feat) USING (symbol))
  WHERE ret_5d <= -8 OR rvol >= 1.8""")
check("stream_snapshot", f"SELECT b.symbol, ts, {r('close', 4)} AS close, listing, sector FROM q_newest b JOIN q_universe USING (symbol) WHERE rr = 1")
check("path_flags_series", "SELECT symbol, ts, CASE WHEN i > 1 THEN up END AS supertrend_up, pc > ps AS psar_bull FROM q_fold")
# ---- statements, landed files, runs
AS_OF = "DATE '2001-11-04'"
_marks = "(contains(title, 'FOMC') OR contains(title, 'Federal Open Market') OR contains(lower(title), 'monetary policy'))"
define("q_press", f"""
  SELECT doc_id AS pos, text, CASE doc_id % 9 WHEN 0 THEN 'Federal Reserve issues <b>FOMC</b> statement no. ' || doc_id WHEN 4 THEN 'Monetary Policy report ' || doc_id
         ELSE 'Press release ' || doc_id END AS title, {AS_OF} + CAST(doc_id % 700 - 650 AS INTEGER) AS published FROM documents""")
define("q_statement", f"""
  SELECT title, published, {_hits(qs.HAWK_TERMS)} AS hawk, {_hits(qs.DOVE_TERMS)} AS dove
  FROM (SELECT title, published, concat_ws(' ', title, text) AS text FROM q_press WHERE {_marks} AND published <= {AS_OF} ORDER BY published DESC, pos LIMIT 1)""")
check("macro_statement", """
  SELECT risk_regime, rate_dir, fomc_next, fomc_in_days, CASE WHEN hawk > dove THEN 'hawkish' WHEN dove > hawk THEN 'dovish' WHEN title IS NOT NULL THEN 'neutral' END AS fomc_tone,
         substr(trim(regexp_replace(title, '<[^>]+>', '', 'g')), 1, 120) AS fomc_headline, published AS fomc_date FROM q_macro LEFT JOIN q_statement ON true""")
check("table_filter", """
  SELECT symbol, name, sector, industry, country, elo_score FROM q_r6
  WHERE contains(lower(concat_ws(' ', ord, symbol, coalesce(name, 'None'), coalesce(sector, 'None'), coalesce(industry, 'None'), coalesce(country, 'None'),
    coalesce(to_json(themes)::VARCHAR, 'None'), coalesce(regime, 'None'), coalesce(elo_score::VARCHAR, 'None'))), 'tech')""")
check("universe_order", """
  SELECT symbol, name, exchange, ord FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ord) AS k FROM
    (SELECT 'S' || c_custkey % 700 AS symbol, c_name AS name, c_mktsegment AS exchange, row_number() OVER (ORDER BY c_custkey) - 1 AS ord FROM customer)) WHERE k = 1""")
check("bars30_landed", f"SELECT symbol, ts, {', '.join(f'{r(c, 4)} AS {c}' for c in ('open', 'high', 'low', 'close'))}, volume FROM q_bars30")
check("fx_table_landed", "SELECT currency, usd_rate, TIMESTAMP '2024-01-31 00:00:00' AS fetched_at FROM q_rates WHERE usd_rate IS NOT NULL")


def _market(source: str) -> str:
    return f"""SELECT s AS market_sentiment, CASE WHEN s >= 60 THEN 'positiv' WHEN s <= 40 THEN 'negativ' ELSE 'neutral' END AS market_label, n AS market_n
      FROM (SELECT CAST(least(greatest(50 + 6 * sum({co.title_net()}), 5), 95) AS INTEGER) AS s, count(*) AS n FROM {source})"""


check("run_output", f"""
  SELECT '2001-11-03T18' AS run_ts, (SELECT count(*) FROM q_universe) AS universe_size, (SELECT count(*) FROM q_feat) AS analyzed, market_sentiment, market_label, market_n,
         vix, risk_regime, rate_dir, fomc_next, fomc_in_days, {AS_OF} AS as_of FROM q_macro, ({_market('q_headlines')})""")
check("snapshot_light", f"""
  SELECT r.symbol, r.price, r.rs_rating, coalesce(p.news_score, 50) AS news_score, coalesce(p.news_sentiment, 'neutral') AS news_sentiment, coalesce(p.news_n, 0) AS news_n,
         e.next_earnings, e.earnings_in_days, i.intraday_note, market_sentiment, market_label, market_n
  FROM q_rows r LEFT JOIN q_prevnews p USING (symbol) LEFT JOIN q_earn e USING (symbol) LEFT JOIN q_intraday i USING (symbol), ({_market('q_chat')})""")
_past = "FROM q_ticks WHERE d <= DATE '1996-06-28' GROUP BY symbol, d)"
check("snapshot_as_of", "SELECT symbol, ts, price, rsi, adx, sma50, macd_hist, vol_daily, longterm_score FROM q_feat")
assert CHECKS["snapshot_as_of"].count("FROM q_ticks GROUP BY symbol, d)") == 1
CHECKS["snapshot_as_of"] = CHECKS["snapshot_as_of"].replace("FROM q_ticks GROUP BY symbol, d)", _past)
check("ind_volatility_gaps", f"""
  SELECT symbol, {r('CASE WHEN n >= 20 THEN vd END', 4)} AS vol_daily, {r('CASE WHEN n >= 30 THEN va * sqrt(252) * 100 END', 4)} AS vol_annual_pct
  FROM (SELECT symbol, count(*) AS n, stddev_samp(lr) FILTER (k <= 60) AS vd, stddev_samp(lr) FILTER (k <= 252) AS va
        FROM (SELECT symbol, lr, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM
          (SELECT symbol, ts, ln(c / lag(c) OVER (PARTITION BY symbol ORDER BY ts)) AS lr FROM
            (SELECT symbol, ts, CASE WHEN CAST(volume AS BIGINT) % 13 <> 0 THEN close END AS c FROM q_bars)) WHERE lr IS NOT NULL) GROUP BY symbol)""")
