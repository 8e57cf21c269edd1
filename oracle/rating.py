"""Snapshot and rating layer as SQL."""

from __future__ import annotations

from oracle.base import bd, cl, define, dv, in_list, picks, pts, r, ri, t0, wm
from oracle.company import case_of, currency
from oracle.market import BASIC, FLAGS
from tickerloom.operators import lookups as lk
from tickerloom.operators import macro as mc
from tickerloom.operators import outlook as ol
from tickerloom.operators import rating as rt
from tickerloom.operators.scores import STAGE_LABELS

_feature_cols = [c for c in [*BASIC, *FLAGS, "daily_return_pct"] if c not in lk.PRICE_COLUMNS]
_fx = lambda c: f'CASE WHEN rate <> 1 THEN {r(f"""x."{c}" * rate""", 2)} ELSE x."{c}" END AS "{c}"'
define("q_valued", f"""
  SELECT f.symbol, listing, name, f.ord, {', '.join(f'f."{c}"' for c in [*BASIC, *FLAGS, 'daily_return_pct'])},
         daytrade_score, daytrade_direction, longterm_score, value_score, quality_score, growth_score, fundamental_score,
         magic_score, sector, industry, rec_key AS analyst_rating, analyst_n, market_cap,
         coalesce({r('0.45 * longterm_score + 0.55 * fundamental_score', 1)}, longterm_score) AS investment_score,
         CASE WHEN target_price > 0 THEN {r('(target_price / price - 1) * 100', 1)} END AS analyst_upside_pct,
         CASE WHEN eps > 0 AND bvps > 0 THEN {r('sqrt(22.5 * eps * bvps)', 2)} END AS graham_number,
         CASE WHEN eps > 0 AND bvps > 0 THEN {r('(sqrt(22.5 * eps * bvps) / price - 1) * 100', 1)} END AS graham_margin_pct,
         {r('free_cashflow / nullif(market_cap, 0) * 100', 1)} AS fcf_yield_pct,
         {ri('revenue_growth * 100 + free_cashflow / nullif(revenue, 0) * 100')} AS rule40,
         {r('roe * 100', 1)} AS roe_pct, {r('revenue_growth * 100', 1)} AS revenue_growth_pct, {r('rec_mean', 4)} AS analyst_mean,
         {r('target_price', 4)} AS target_price, {r('pe', 4)} AS pe, {r('forward_pe', 4)} AS forward_pe,
         {r('earnings_growth', 4)} AS earnings_growth, {r('beta', 4)} AS beta, {currency('listing')} AS currency
  FROM q_feat f LEFT JOIN q_fs s ON f.symbol = s.symbol LEFT JOIN q_magic m ON f.symbol = m.symbol""")
define("q_usd", f"""
  SELECT x.* EXCLUDE ({', '.join(f'"{c}"' for c in lk.PRICE_COLUMNS)}), {', '.join(_fx(c) for c in lk.PRICE_COLUMNS)}, rate AS fx_usd, fx_missing
  FROM (SELECT v.*, coalesce(nullif(usd_rate, 0), 1.0) AS rate, usd_rate IS NULL AS fx_missing
        FROM q_valued v LEFT JOIN q_rates USING (currency)) x""")
define("q_rows", f"""
  SELECT u.*, coalesce(news_score, 50) AS news_score, coalesce(news_sentiment, 'neutral') AS news_sentiment,
         coalesce(news_n, 0) AS news_n, next_earnings, earnings_in_days, hype_rank, hype_mentions, hype_change_pct,
         hype_score, hype_surging,
         CASE WHEN ret_60d IS NOT NULL THEN {ri('(row_number() OVER (ORDER BY ret_60d NULLS LAST, u.ord))::DOUBLE / count(ret_60d) OVER () * 100')} END AS rs_rating,
         piotroski, piotroski_n, altman_z, stance AS holder_stance, weight_pct AS holder_weight_pct, t.tags AS themes,
         e.tags AS expert_sources, country, cc
  FROM q_usd u LEFT JOIN q_news n USING (symbol) LEFT JOIN q_earn USING (symbol) LEFT JOIN q_hype USING (symbol)
    LEFT JOIN q_deep USING (symbol) LEFT JOIN q_13f h ON h.issuer = u.symbol LEFT JOIN q_themes t ON t.symbol = u.symbol
    LEFT JOIN q_experts e ON e.symbol = u.symbol JOIN q_country c ON c.symbol = u.symbol""")

CHECKS = [("price > sma150 AND price > sma200", "Kurs über 150- & 200-Tage-Linie"), ("sma150 > sma200", "150-Tage über 200-Tage-Linie"),
          ("sma200 > sma200_1m_ago", "200-Tage-Linie steigt"), ("sma50 > sma150 AND sma50 > sma200", "50-Tage über 150- & 200-Tage"),
          ("price > sma50", "Kurs über 50-Tage-Linie"), ("pct_above_low52 >= 30", "≥30 % über 52-Wochen-Tief"),
          ("pct_from_high52 >= -25", "≤25 % unter 52-Wochen-Hoch")]
_lab = lambda want: picks(*[f"CASE WHEN {want} ({c}) THEN '{t}' END" for c, t in CHECKS],
                          f"CASE WHEN {want} (rs_rating >= 70) THEN 'Relative Stärke stark (RS ' || rs_rating || ')' END")
SLOPE = "coalesce((sma150 - sma150_1m_ago) / nullif(sma150, 0), 0)"
_ei = lambda c, a, b: f"CASE WHEN {c} THEN {a}.0 WHEN NOT {c} THEN {b}.0 END"
STRONG = bd("adx", 15, 40, 25, 65, 40, 85, 100)
TREND = [f"CASE WHEN plus_di >= minus_di THEN {STRONG} WHEN plus_di < minus_di THEN 100 - {STRONG} END",
         "CASE WHEN price > sma50 AND sma50 > sma200 THEN 100.0 WHEN price > sma200 THEN 70.0 WHEN sma50 IS NOT NULL AND sma200 IS NOT NULL THEN 25.0 END",
         _ei("ema9_above_21", 75, 25), "CASE ichimoku WHEN 'über Wolke' THEN 90.0 WHEN 'in Wolke' THEN 50.0 WHEN 'unter Wolke' THEN 15.0 END",
         _ei("supertrend_up", 80, 20), _ei("psar_bull", 70, 30)]
MOMENTUM = [bd("rsi", 30, 30, 45, 55, 60, 80, 70, 65, 40), bd("stoch_k", 20, 30, 50, 60, 80, 80, 45),
            bd("williams_r", -80, 30, -50, 60, -20, 80, 45), bd("cci", -100, 30, 0, 55, 100, 80, 55),
            bd("roc10", -5, 30, 0, 50, 5, 70, 85),
            "CASE WHEN macd_hist > 0 AND macd_hist > macd_hist_prev THEN 80.0 WHEN macd_hist > 0 THEN 60.0 WHEN macd_hist_prev IS NOT NULL AND macd_hist IS NOT NULL THEN 30.0 END",
            bd("aroon_up - aroon_down", -50, 25, 0, 50, 50, 75, 90)]
VOLUME = [_ei("obv_rising", 75, 30), bd("mfi", 20, 30, 50, 60, 80, 80, 45), bd("cmf", -0.1, 30, 0, 50, 0.1, 70, 85),
          bd("rvol", 0.7, 40, 1.2, 60, 2, 80, 90)]
_avg = lambda parts: ri(wm(*[(p, 1.0) for p in parts]))
_has = lambda c, w: f"contains({c}, '{w}')"
IND, SEC = "lower(coalesce(industry, ''))", "coalesce(sector, '')"
THEMED = lambda *t: f"coalesce(list_has_any(themes, {in_list(list(t))}), FALSE)"
ENERGY = f"(lower({SEC}) = 'energy' OR {_has(IND, 'oil')} OR {_has(IND, 'gas')})"
COPPER = f"({_has(IND, 'copper')} OR {_has(IND, 'industrial metals')})"
EM = f"({THEMED('Emerging Markets')} OR coalesce(NOT list_contains({in_list(list(mc.DEVELOPED))}, cc), FALSE))"
CRYPTO = f"({THEMED('Krypto')} AND upper(symbol) NOT LIKE '%-USD')"
MACRO_RULES = [
    ("risk_regime = 'risk_off' AND beta >= 1.5", -8), ("risk_regime = 'risk_off' AND beta <= 0.9", 4),
    ("risk_regime = 'risk_on' AND beta >= 1.3", 5), ("rate_dir = 'rising' AND (coalesce(forward_pe > 40, FALSE) OR coalesce(value_score < 35, FALSE))", -6),
    (f"rate_dir = 'rising' AND {_has(SEC, 'Financial')}", 4),
    (f"rate_dir = 'falling' AND ({_has(SEC, 'Real Estate')} OR {THEMED('REIT', 'Versorger')})", 5),
    ("rate_dir = 'falling' AND growth_score >= 70", 3), (f"{ENERGY} AND oil_dir = 'rising'", 5), (f"{ENERGY} AND oil_dir = 'falling'", -4),
    (f"{_has(IND, 'airline')} AND oil_dir = 'rising'", -4), (f"{_has(IND, 'gold')} AND gold_dir = 'rising'", 5),
    (f"{_has(IND, 'gold')} AND gold_dir = 'falling'", -4), (f"{_has(IND, 'silver')} AND silver_dir = 'rising'", 5),
    (f"{COPPER} AND copper_dir = 'rising'", 4), (f"{COPPER} AND copper_dir = 'falling'", -3), (f"{EM} AND dxy_dir = 'rising'", -5),
    (f"{EM} AND dxy_dir = 'falling'", 4), (f"{CRYPTO} AND btc_dir = 'rising'", 6), (f"{CRYPTO} AND btc_dir = 'falling'", -6),
    ("fomc_in_days BETWEEN 0 AND 3", 0)]
_mkeys = "risk_regime, rate_dir, oil_dir, gold_dir, silver_dir, copper_dir, dxy_dir, btc_dir, fomc_in_days"
EXTRA = "round_even((rvol - 1.8) * 5, 0) + 5"
define("q_r1", f"""
  SELECT *, {ri('len(minervini_met)::DOUBLE / nullif(len(minervini_met) + len(minervini_failed), 0) * 100')} AS minervini_score,
         CASE WHEN price IS NOT NULL AND sma150 IS NOT NULL THEN CASE WHEN price > sma150 AND {SLOPE} > 0.005 THEN 2
              WHEN price < sma150 AND {SLOPE} < -0.005 THEN 4 WHEN price >= sma150 AND {SLOPE} <= 0.005 THEN 3 ELSE 1 END END AS weinstein_stage,
         {_avg(TREND)} AS tech_trend, {_avg(MOMENTUM)} AS tech_momentum, {_avg(VOLUME)} AS tech_volume
  FROM (SELECT *, {_lab('')} AS minervini_met, {_lab('NOT')} AS minervini_failed FROM q_rows)""")
define("q_r2", f"""
  SELECT q_r1.*, CAST(least(greatest({' + '.join(f'(CASE WHEN {c} THEN {p} ELSE 0 END)' for c, p in MACRO_RULES)}, -18), 18) AS INTEGER) AS macro_pts,
         CAST({' + '.join(f'(CASE WHEN {c} THEN 1 ELSE 0 END)' for c, _ in MACRO_RULES)} AS INTEGER) AS macro_notes_n,
         CAST(CASE WHEN rvol >= 1.8 AND daily_return_pct >= 1 THEN least(12, {EXTRA}) WHEN rvol >= 1.8 AND daily_return_pct <= -1
              THEN -least(12, {EXTRA}) ELSE 0 END AS INTEGER) AS volume_pts,
         analyst_n >= 3 AS a3
  FROM q_r1, (SELECT {_mkeys} FROM q_macro)""")
ELO = "1000 + 10 * coalesce(investment_score, nullif(longterm_score, 0), 50) + " + pts(
    "CASE WHEN daytrade_direction = 'LONG' AND daytrade_score > 40 THEN least(80, (daytrade_score - 40) * 2) "
    "WHEN daytrade_direction = 'SHORT' AND daytrade_score > 40 THEN -least(60, (daytrade_score - 40) * 1.5) END",
    "CASE holder_stance WHEN 'LONG' THEN 60 WHEN 'SHORT_BET' THEN -70 END",
    f"CASE WHEN news_n >= 2 THEN {cl('(news_score - 50) * 1.4', -55, 55)} END",
    "CASE WHEN hype_surging THEN least(40, hype_score * 0.4) END",
    f"CASE WHEN a3 THEN {cl('analyst_upside_pct * 0.55', -22, 28)} END", f"CASE WHEN a3 THEN {cl('(3 - analyst_mean) * 9', -18, 18)} END",
    "(minervini_score - 50) * 0.4", "(piotroski - 4.5) * 7", "CASE WHEN altman_z < 1.81 THEN -45 WHEN altman_z > 2.99 THEN 12 END",
    "CASE weinstein_stage WHEN 4 THEN -30 WHEN 2 THEN 15 END", "macro_pts", "volume_pts")
SIGN = "(CASE daytrade_direction WHEN 'LONG' THEN 1 WHEN 'SHORT' THEN -1 ELSE 0 END)"
_sg = lambda x, hi, lo: f"CASE WHEN {x} >= {hi} THEN 1 WHEN {x} <= {lo} THEN -1 WHEN {x} IS NOT NULL THEN 0 END"
SIGNS = [_sg("longterm_score", 55, 45), _sg("fundamental_score", 60, 40), f"CASE WHEN a3 THEN {_sg('analyst_upside_pct', 10, -5)} END",
         f"CASE WHEN news_n >= 2 THEN {_sg('news_score', 60, 40)} END", f"CASE WHEN daytrade_score >= 45 THEN {SIGN} END"]
BIAS_L = f"(coalesce(investment_score - 50, 0) + coalesce(daytrade_score, 0) * {SIGN} * 0.25)"
SIG_L = cl(f"{BIAS_L} * 0.25", -25, 25)
DRIFT_L = f"coalesce({cl('0.4 * ' + cl('analyst_upside_pct', -35, 50) + ' + 0.6 * ' + SIG_L, -35, 55)}, {SIG_L})"
VD = "coalesce(CASE WHEN vol_daily > 0 THEN vol_daily END, CASE WHEN atr_pct > 0 THEN atr_pct / 100 END)"
LATE = "(coalesce(rsi >= 75, FALSE) OR coalesce((price / sma50 - 1) * 100 >= 22, FALSE) OR coalesce(macd_hist < 0 AND weinstein_stage = 2 AND rsi > 60, FALSE))"
UP = "(coalesce(weinstein_stage = 2, FALSE) OR coalesce(longterm_score >= 62, FALSE) OR coalesce(price > sma150 AND sma150 > sma150_1m_ago, FALSE))"
DOWN = "(coalesce(weinstein_stage = 4, FALSE) OR coalesce(longterm_score <= 30, FALSE) OR coalesce(price < sma150 AND sma150 < sma150_1m_ago, FALSE))"
RISING = "coalesce(macd_hist > macd_hist_prev, FALSE)"
TURN = "50 + " + pts(
    "CASE WHEN macd_hist > macd_hist_prev THEN 18 WHEN macd_hist <= macd_hist_prev THEN -18 END",
    "CASE WHEN macd_hist > 0 AND macd_hist_prev IS NOT NULL THEN 6 END", "CASE daytrade_direction WHEN 'LONG' THEN 16 WHEN 'SHORT' THEN -16 END",
    "CASE WHEN price > ema9 THEN 8 WHEN price <= ema9 THEN -8 END",
    "CASE WHEN stoch_k > stoch_d AND stoch_k < 45 THEN 10 WHEN stoch_k < stoch_d AND stoch_k > 70 THEN -8 END")
_two = lambda c: r(f'"{c}"', 2)
LEVELS = "[" + ", ".join(_two(c) for c in rt.SUPPORT_LEVELS) + "]"
BELOW_RAW = "[" + ", ".join(f'CASE WHEN "{c}" > 0 AND "{c}" < price THEN {_two(c)} END' for c in rt.SUPPORT_LEVELS) + "]"
DECLINED = "(coalesce(pct_from_high52 <= -20, FALSE) OR coalesce(ret_60d <= -20, FALSE) OR coalesce(ret_20d <= -12, FALSE))"
SIGNALS = picks(*[f"CASE WHEN {c} THEN '{t}' END" for c, t in [
    ("price > low20 * 1.03", "keine neuen Tiefs"), ("price > ema9", "über EMA9"), (RISING, "MACD dreht hoch"),
    ("stoch_k > stoch_d AND stoch_k < 45", "Stochastik-Kreuz"), ("rsi BETWEEN 32 AND 52", "RSI erholt sich"),
    ("daytrade_direction = 'LONG'", "Käufer aktiv"), ("bb_bandwidth < 12", "Schwankung beruhigt sich"), ("aroon_up > aroon_down", "Aroon dreht")]])
TXT = "lower(coalesce(sector, '') || ' ' || coalesce(industry, ''))"
CYC = "(" + " OR ".join(_has(TXT, w) for w in rt.CYCLICAL) + ")"
define("q_r3", f"""
  SELECT *, CASE WHEN elo >= 1950 THEN 'Top-Chance' WHEN elo >= 1800 THEN 'Stark' WHEN elo >= 1650 THEN 'Solide' WHEN elo >= 1500
         THEN 'Neutral' WHEN elo >= 1350 THEN 'Schwach' ELSE 'Meiden' END AS elo_label,
         CASE WHEN elo >= 1950 THEN '#16a34a' WHEN elo >= 1800 THEN '#65a30d' WHEN elo >= 1650 THEN '#ca8a04' WHEN elo >= 1500
         THEN '#6b7280' WHEN elo >= 1350 THEN '#ea580c' ELSE '#dc2626' END AS elo_color,
         CAST(least(greatest(round_even((elo - 1000) / 10.0::DOUBLE, 0), 0), 100) AS INTEGER) AS elo_score,
         {ri(wm(('fundamental_score', 0.5), ('longterm_score', 0.3), ('CASE WHEN a3 THEN ' + cl('(5 - analyst_mean) / 4 * 100', 0, 100) + ' END', 0.1), ('(piotroski / 9.0::DOUBLE * 100)', 0.25)))} AS quality,
         {ri(wm(('CASE WHEN a3 THEN ' + cl('50 + analyst_upside_pct * 1.25', 0, 100) + ' END', 0.22), (cl('50 + (daytrade_score - 50) * ' + SIGN, 0, 100), 0.2), (cl('50 - pct_from_high52', 0, 100), 0.18), ('growth_score', 0.28), ('CASE WHEN hype_surging THEN 80.0::DOUBLE END', 0.1)))} AS potential,
         coalesce({ri('50 + abs(' + ' + '.join(f'coalesce({s}, 0)' for s in SIGNS) + ')::DOUBLE / nullif(' + ' + '.join(f'(({s}) IS NOT NULL)::INT' for s in SIGNS) + ', 0) * 45')}, 50) AS conviction,
         CASE WHEN (daytrade_direction IN ('LONG', 'SHORT') AND daytrade_score >= 55) OR coalesce(hype_surging, FALSE) OR coalesce(earnings_in_days BETWEEN 0 AND 2, FALSE)
              THEN 'urgent' WHEN daytrade_score >= 45 OR coalesce(earnings_in_days BETWEEN 0 AND 7, FALSE) THEN 'soon' ELSE 'calm' END AS urgency_tone,
         CASE WHEN price > 0 AND {VD} IS NOT NULL THEN {r(cl(DRIFT_L, -60, 90), 1)} END AS exp_return_12m,
         CASE WHEN weinstein_stage = 4 THEN 'down' WHEN weinstein_stage = 3 OR (weinstein_stage = 2 AND {LATE}) THEN 'late'
              WHEN weinstein_stage = 2 AND coalesce((price / sma50 - 1) * 100 < 6 AND rsi < 62, FALSE) THEN 'early_up' WHEN weinstein_stage = 2 THEN 'mid_up'
              WHEN weinstein_stage = 1 THEN 'base' ELSE 'sideways' END AS phase_code,
         CASE WHEN {DOWN} AND NOT {UP} THEN 'down' WHEN {UP} AND NOT {DOWN} THEN 'up' ELSE 'neutral' END AS regime,
         (price / coalesce(sma20, sma50) - 1) * 100 AS extension_pct, {cl(TURN, 0, 100)} AS momentum_turn, {RISING} AS rising,
         (coalesce(ret_5d <= -8, FALSE) OR coalesce(ret_20d <= -15, FALSE)) AND coalesce(price < sma20, FALSE)
           AND (daytrade_direction = 'SHORT' OR NOT {RISING} OR coalesce(price < ema9, FALSE)) AS knife,
         list_reverse_sort(list_distinct(list_filter({BELOW_RAW}, lambda x: x IS NOT NULL))) AS lv,
         {CYC} AND (coalesce(earnings_growth >= 0.4, FALSE) OR coalesce(growth_score >= 85, FALSE) OR coalesce(forward_pe > 0 AND forward_pe < pe * 0.6, FALSE)) AS peak_warning,
         (coalesce(investment_score >= 58, FALSE) OR coalesce(longterm_score >= 62, FALSE)) AND daytrade_direction = 'SHORT' AS timing_warning
  FROM (SELECT *, CAST(round_even({cl(ELO, 700, 2200)} / 5, 0) * 5 AS INTEGER) AS elo FROM q_r2)""")
# merge support levels within 1.5 % of the last one kept, walking down the list
define("q_merge", """
  SELECT symbol, lv, 1 AS i, CASE WHEN len(lv) > 0 THEN [lv[1]] ELSE [] END AS kept FROM (SELECT symbol, lv FROM q_r3)
  UNION ALL
  SELECT symbol, lv, i + 1, CASE WHEN abs(kept[len(kept)] / lv[i + 1] - 1) > 0.015 THEN list_append(kept, lv[i + 1]) ELSE kept END
  FROM q_merge WHERE i < len(lv)""")
define("q_sup", "SELECT symbol, arg_max(kept, i) AS supports FROM q_merge GROUP BY symbol")
DAMP = lambda x: "round_even(" + cl(f"({x}) + " + pts(
    "CASE WHEN atr_pct > 4 THEN -least(22, (atr_pct - 4) * 2.5) END", "CASE WHEN beta > 1.6 THEN -least(10, (beta - 1.6) * 8) END"), 0, 100) + ", 0)"
define("q_r4", f"""
  SELECT * EXCLUDE (sig), CASE WHEN NOT knife AND {DECLINED} AND len(sig) >= 4 THEN CAST(len(sig) AS INTEGER) END AS bottoming_n,
         CASE WHEN NOT knife AND {DECLINED} AND len(sig) >= 4 THEN array_to_string(sig, ' | ') END AS bottoming_signals
  FROM (SELECT q_r3.*, supports, {SIGNALS} AS sig, (price / supports[1] - 1) * 100 AS room1 FROM q_r3 JOIN q_sup USING (symbol))""")
PARTS = wm((bd("extension_pct", -6, 55, 0, 88, 4, 92, 9, 74, 16, 52, 30, 32, 18), 0.28),
           (bd("rsi", 30, 55, 40, 82, 52, 90, 60, 70, 68, 48, 75, 28, 15), 0.24), ("momentum_turn", 0.28), ("longterm_score", 0.12), ("value_score", 0.08))
define("q_r5", f"""
  SELECT * EXCLUDE (e1, e2, e3), CAST(CASE WHEN regime = 'down' AND bottoming_n IS NULL
              THEN {DAMP('CASE WHEN rsi < 30 AND rising THEN 34 ELSE 20 END')}
              WHEN bottoming_n IS NOT NULL THEN greatest(least(e3, 66), least(66, 42 + 3 * bottoming_n)) ELSE e3 END AS INTEGER) AS entry_score
  FROM (SELECT *, {DAMP("(CASE WHEN daytrade_direction = 'SHORT' AND bottoming_n IS NULL THEN least(e2, 41) ELSE e2 END) + coalesce(least(14, 2 * bottoming_n), 0)")} AS e3
        FROM (SELECT *, CASE WHEN knife THEN least(e1, 15) WHEN phase_code = 'down' THEN least(e1, CASE WHEN bottoming_n IS NOT NULL THEN 52 ELSE 25 END)
                             WHEN phase_code = 'late' THEN least(e1, 44) ELSE e1 END AS e2
              FROM (SELECT *, {PARTS} + {pts("CASE WHEN daytrade_direction = 'SHORT' THEN -18 END", "CASE WHEN regime = 'neutral' THEN -6 END",
                                            "CASE WHEN hype_surging AND rsi > 68 THEN -12 END",
                                            "CASE WHEN atr_pct > 0 THEN CASE WHEN room1 <= 1.2 * atr_pct THEN 8 WHEN room1 >= 4 * atr_pct THEN -8 END END")} AS e1
                    FROM q_r4)))""")
TURNING = "(rising AND daytrade_direction <> 'SHORT')"
ATR3 = "coalesce(nullif(atr_pct, 0), 3)"
CASE_ = (f"CASE WHEN regime = 'down' AND NOT {TURNING} THEN 'trend' WHEN coalesce(room1 <= 1.5 * {ATR3}, FALSE) AND {TURNING} AND regime <> 'down' THEN 'floor' "
         f"WHEN coalesce(room1 <= 1.5 * {ATR3}, FALSE) THEN 'near' WHEN room1 > 3 * {ATR3} THEN 'air' ELSE 'buffer' END")
define("q_r6", f"""
  SELECT *, CASE WHEN d_case = 'trend' THEN 'hoch' WHEN d_case = 'floor' THEN 'gering' WHEN d_case = 'air' AND NOT {TURNING} THEN 'hoch' ELSE 'mittel' END AS downside_risk,
         CAST(peak_warning AS INT) + CAST(timing_warning AS INT) AS warnings, coalesce(CASE WHEN a3 THEN analyst_upside_pct END, exp_return_12m) AS upside_pct
  FROM (SELECT *, {CASE_} AS d_case FROM q_r5)""")

# ---- trade plans ------------------------------------------------------------------------------------------------


def plan(side_short: str, name: str) -> str:
    sup = "[" + ", ".join(f'CASE WHEN "{c}" > 0 AND "{c}" < price THEN "{c}" END' for c in ol.PLAN_SUPPORTS) + "]"
    res = "[" + ", ".join(f'CASE WHEN "{c}" > price THEN "{c}" END' for c in ol.PLAN_RESISTANCES) + "]"
    first = lambda lst, fn, cond: f"list_{fn}(list_filter({lst}, lambda x: {cond}))"
    hold = "CASE " + " ".join(f"WHEN days > 0 AND days <= {b} THEN '{t}'" for b, t in ol.HOLD_LABELS) + \
        f" WHEN days > 0 THEN '12–24 Monate' ELSE '{'wenige Tage' if name == 'short' else 'einige Monate'}' END"
    return f"""
  SELECT symbol, CASE WHEN s THEN 'short' ELSE 'long' END AS side, avoid, {r('least(el, eh)', 2)} AS entry_low, {r('greatest(el, eh)', 2)} AS entry_high,
         {r('least(t1, t2)', 2)} AS target_low, {r('greatest(t1, t2)', 2)} AS target_high, {r('stop', 2)} AS stop, {r('pot', 1)} AS potential_pct,
         {r('risk', 1)} AS risk_pct, CASE WHEN risk > 0 THEN {r('pot / nullif(risk, 0)', 1)} END AS rrr, {hold} AS hold, code AS action_code
  FROM (SELECT *, greatest(CASE WHEN s THEN (1 - tm / em) * 100 ELSE (tm / em - 1) * 100 END, 0) AS pot,
               CASE WHEN s THEN (stop - em) / em ELSE (em - stop) / em END * 100 AS risk, abs(tm - em) / nullif(0.35 * a, 0) AS days,
               CASE WHEN avoid THEN 'avoid' WHEN knife AND NOT s THEN 'knife' WHEN bottoming_n IS NOT NULL AND NOT s THEN 'base' WHEN s THEN 'short'
                    WHEN entry_score >= 55 THEN 'buy' WHEN entry_score >= 42 THEN 'staged' ELSE 'wait' END AS code
        FROM (SELECT *, (el + eh) / 2 AS em, (t1 + t2) / 2 AS tm, CASE WHEN s THEN eh + a ELSE el - a END AS stop
              FROM (SELECT *, CASE WHEN s THEN coalesce(list_min(list_filter([t1 - 2 * a, price - 6 * a, {first('sup', 'max', 'x < t1 - 0.5 * a')}], lambda x: x > 0)), price * 0.5)
                             ELSE greatest(t1 + 2 * a, price + 6 * a, CASE WHEN target_price > price THEN target_price END, {first('res', 'min', 'x > t1 + 0.5 * a')}) END AS t2
                    FROM (SELECT *, CASE WHEN s THEN price - 0.2 * a WHEN entry_score < 42 THEN coalesce({first('sup', 'max', 'x < eh - 0.1 * a')}, eh - 1.2 * a)
                                         ELSE least(coalesce(near_sup, price - a), price - 0.3 * a) END AS el,
                                 CASE WHEN s THEN coalesce({first('sup', 'max', 'x <= price - 2 * a')}, price - 3 * a)
                                      ELSE coalesce({first('res', 'min', 'x >= price + 2 * a')}, price + 3 * a) END AS t1
                          FROM (SELECT *, CASE WHEN s THEN greatest(coalesce({first('res', 'min', 'x <= price + 2.2 * a')}, price + a), price + 0.3 * a)
                                               WHEN entry_score < 42 THEN CASE WHEN near_sup < price - 0.3 * a THEN near_sup ELSE price - 0.5 * a END
                                               ELSE price + CASE WHEN entry_score >= 55 THEN 0.2 * a ELSE 0 END END AS eh
                                FROM (SELECT *, {first('sup', 'max', 'x >= price - 2.2 * a')} AS near_sup
                                      FROM (SELECT *, {side_short} AS s, greatest(coalesce(CASE WHEN atr > 0 THEN atr END, CASE WHEN atr_pct > 0 THEN atr_pct / 100 * price END, 0.02 * price), 0.005 * price) AS a,
                                                   {sup} AS sup, {res} AS res,
                                                   NOT ({side_short}) AND (coalesce(altman_z < 1.81, FALSE) OR elo_label = 'Meiden' OR (bottoming_n IS NULL AND
                                                     (coalesce(weinstein_stage = 4, FALSE) OR phase_code = 'down' OR coalesce(nullif(longterm_score, 0), 50) < 30))) AS avoid
                                            FROM q_r6)))))))"""


define("q_plan_long", plan("FALSE", "long"))
define("q_plan_short", plan("coalesce(daytrade_direction = 'SHORT', FALSE)", "short"))
