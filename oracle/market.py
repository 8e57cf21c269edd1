"""Fixture tables and indicators as SQL."""

from __future__ import annotations

from oracle.base import bd, cl, define, dv, in_list, pts, r, ri
from tickerloom.sources import fixtures as fx

AS_OF = "DATE '2001-11-04'"

define("q_nsym", "SELECT count(*) AS n_sym FROM supplier")
define("q_universe", f"""
  SELECT 'S' || s_suppkey AS symbol, 'S' || s_suppkey || ({in_list(fx.SUFFIXES)})[s_nationkey + 1] AS listing,
         s_name AS name, r_name AS exchange, ({in_list(fx.SECTORS)})[s_nationkey + 1] AS sector,
         ({in_list(fx.INDUSTRIES)})[s_nationkey + 1] AS industry, s_acctbal AS acctbal, s_suppkey AS ord
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
define("q_ticks", """
  SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS d, l_orderkey ok, l_linenumber ln, l_partkey pk,
         l_quantity qty,
         100.0::DOUBLE * exp(sum(CAST(round(l_discount * 100) AS INT) - 5) OVER (PARTITION BY l_suppkey
           ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING)::DOUBLE / 200.0::DOUBLE) AS px
  FROM lineitem""")
define("q_bars", """
  SELECT symbol, d AS ts, coalesce(lag(close) OVER w, close) AS open,
         greatest(h0, coalesce(lag(close) OVER w, close)) AS high, least(l0, coalesce(lag(close) OVER w, close)) AS low,
         close, volume
  FROM (SELECT symbol, d, max(px) h0, min(px) l0, max_by(px, row(ok, ln, pk)) AS close, sum(qty) AS volume
        FROM q_ticks GROUP BY symbol, d) WINDOW w AS (PARTITION BY symbol ORDER BY d)""")
define("q_bars30", """
  SELECT event_type AS symbol, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '2000-01-01') AS ts,
         min_by(100.0 + value / 10.0, row(ts, event_id)) AS open, max(100.0 + value / 10.0) AS high,
         min(100.0 + value / 10.0) AS low, max_by(100.0 + value / 10.0, row(ts, event_id)) AS close,
         count(*)::DOUBLE AS volume
  FROM events GROUP BY 1, 2""")

# ---- finite windows -------------------------------------------------------------------------------------------


def win(n: int, first: int = 0) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1 + first} PRECEDING AND {first} PRECEDING)" if first \
        else f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(fn: str, x: str, n: int) -> str:
    return f"(CASE WHEN count({x}) OVER {win(n)} = {n} THEN {fn}({x}) OVER {win(n)} END)"


define("q_b1", """
  SELECT *, row_number() OVER w AS n, lag(close) OVER w AS pc, (high + low + close) / 3 AS tp,
         (lag(high) OVER w + lag(low) OVER w + lag(close) OVER w) / 3 AS ptp,
         ln(close / lag(close) OVER w) AS lr,
         ((close - low) - (high - close)) / nullif(high - low, 0) AS mfm,
         coalesce(sign(close - lag(close) OVER w), 0) * volume AS signed
  FROM q_bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
define("q_b2", f"""
  SELECT *, {full('avg', 'close', 20)} AS sma20, {full('avg', 'close', 50)} AS sma50,
         {full('avg', 'close', 150)} AS sma150, {full('avg', 'close', 200)} AS sma200,
         {full('stddev_samp', 'close', 20)} AS sd20, {full('avg', 'volume', 20)} AS vol_avg20,
         CASE WHEN count(close) OVER {win(20, 1)} = 20 THEN max(close) OVER {win(20, 1)} END AS high20,
         CASE WHEN count(close) OVER {win(20, 1)} = 20 THEN min(close) OVER {win(20, 1)} END AS low20,
         max(close) OVER {win(252)} AS high52, min(close) OVER {win(252)} AS low52,
         max(high) OVER {win(252)} AS h52, min(low) OVER {win(252)} AS l52,
         stddev_samp(lr) OVER {win(60)} AS vd, stddev_samp(lr) OVER {win(252)} AS va,
         {full('max', 'high', 14)} AS hh14, {full('min', 'low', 14)} AS ll14, {full('avg', 'tp', 20)} AS sma_tp,
         sum(signed) OVER {win(20)} AS obv20,
         {full('sum', '(CASE WHEN tp > ptp THEN tp * volume ELSE 0 END)', 14)} AS pos14,
         {full('sum', '(CASE WHEN tp < ptp THEN tp * volume ELSE 0 END)', 14)} AS neg14,
         {full('sum', '(mfm * volume)', 20)} AS mv20, {full('sum', 'volume', 20)} AS v20,
         list(high) OVER {win(26)} AS hs, list(low) OVER {win(26)} AS ls,
         {full('max', 'high', 9)} AS mh9, {full('min', 'low', 9)} AS ml9, {full('max', 'high', 26)} AS mh26,
         {full('min', 'low', 26)} AS ml26, {full('max', 'high', 52)} AS mh52, {full('min', 'low', 52)} AS ml52
  FROM q_b1""")
define("q_b3", f"""
  SELECT *, 100 * (close - ll14) / nullif(hh14 - ll14, 0) AS k, abs(tp - sma_tp) AS dev,
         (mh9 + ml9) / 2 AS tenkan, (mh26 + ml26) / 2 AS kijun, (mh52 + ml52) / 2 AS span_b,
         lag(sma150, 21) OVER w AS s150p, lag(sma200, 21) OVER w AS s200p, lag(close, 5) OVER w AS c5,
         lag(close, 10) OVER w AS c10, lag(close, 20) OVER w AS c20, lag(close, 60) OVER w AS c60
  FROM q_b2 WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
define("q_b4", f"""
  SELECT *, {full('avg', 'k', 3)} AS d3, {full('avg', 'dev', 20)} AS mad, (tenkan + kijun) / 2 AS span_a,
         lead(ts) OVER (PARTITION BY symbol ORDER BY ts) IS NULL AS newest
  FROM q_b3""")
define("q_win", f"""
  SELECT symbol, ts, n AS bar_no, close AS price, pc AS prev_close, close / pc - 1 AS daily_return,
         sma20, sma50, sma200, (close - (sma20 - 2 * sd20)) / nullif(4 * sd20, 0) AS bb_pctb,
         4 * sd20 / sma20 * 100 AS bb_bandwidth, volume AS vol, vol_avg20, volume / vol_avg20 AS rvol, high20, low20,
         high52, low52, (close / high52 - 1) * 100 AS pct_from_high52,
         CASE WHEN n > 6 THEN (close / c5 - 1) * 100 END AS ret_5d,
         CASE WHEN n > 21 THEN (close / c20 - 1) * 100 END AS ret_20d,
         CASE WHEN n > 61 THEN (close / c60 - 1) * 100 END AS ret_60d,
         CASE WHEN n > 20 THEN vd END AS vol_daily, sma150, s150p AS sma150_1m_ago, s200p AS sma200_1m_ago,
         (close / low52 - 1) * 100 AS pct_above_low52, k AS stoch_k, d3 AS stoch_d,
         -100 * (hh14 - close) / nullif(hh14 - ll14, 0) AS williams_r, (tp - sma_tp) / nullif(0.015 * mad, 0) AS cci,
         (close / c10 - 1) * 100 AS roc10, obv20 > 0 AS obv_rising,
         100 - 100 / (1 + pos14 / nullif(neg14, 0)) AS mfi, mv20 / v20 AS cmf,
         (25 - (list_position(hs, list_max(hs)) - 1)) / 25 * 100 AS aroon_up,
         (25 - (list_position(ls, list_min(ls)) - 1)) / 25 * 100 AS aroon_down,
         CASE WHEN close > greatest(span_a, span_b) THEN 'über Wolke' WHEN close < least(span_a, span_b) THEN 'unter Wolke'
              ELSE 'in Wolke' END AS ichimoku,
         tenkan > kijun AS tenkan_above_kijun, va * sqrt(252) * 100 AS vol_annual_pct,
         (high + low + close) / 3 AS "pivot", 2 * ((high + low + close) / 3) - low AS pivot_r1,
         2 * ((high + low + close) / 3) - high AS pivot_s1,
         {r('(close - l52) / nullif(h52 - l52, 0) * 100', 1)} AS range_pos_pct,
         (list_sort([row(abs(l52 - close), 0, '0%'), row(abs(h52 - 0.236 * (h52 - l52) - close), 1, '23.6%'),
           row(abs(h52 - 0.382 * (h52 - l52) - close), 2, '38.2%'), row(abs((h52 + l52) / 2 - close), 3, '50%'),
           row(abs(h52 - 0.618 * (h52 - l52) - close), 4, '61.8%'), row(abs(h52 - close), 5, '100%')]))[1][3] AS fib_nearest
  FROM q_b4 WHERE newest AND n >= 40""")

# ---- recursions: one row per bar, carried by a recursive query --------------------------------------------------
TR = "greatest(b.high - b.low, abs(b.high - f.pc), abs(b.low - f.pc))"


def ema(x: str, prev: str, span: int) -> str:
    return f"({x} * (2.0::DOUBLE / {span + 1}) + {prev} * (1.0::DOUBLE - 2.0::DOUBLE / {span + 1}))"


W = "(1.0::DOUBLE / 14)"
define("q_seq", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM q_bars")
define("q_fold", f"""
  SELECT symbol, i, ts, close AS pc, high AS ph, low AS pl, close AS e9, close AS e12, close AS e20, close AS e21,
         close AS e26, 0.0::DOUBLE AS sig, 0.0::DOUBLE AS hist, NULL::DOUBLE AS hist_prev,
         0.0::DOUBLE AS g, 0.0::DOUBLE AS l, high - low AS trn, 1.0::DOUBLE AS trd, high - low AS wtr, 0.0::DOUBLE AS wp, 0.0::DOUBLE AS wm,
         NULL::DOUBLE AS adx, 1.0::DOUBLE AS adxw, 0 AS adxn, NULL::DOUBLE AS pdi, NULL::DOUBLE AS mdi,
         high - low AS st, NULL::DOUBLE AS fu, NULL::DOUBLE AS fl, TRUE AS up,
         low AS ps, high AS ep, 0.02::DOUBLE AS af, TRUE AS bull, close AS peak, 0.0::DOUBLE AS dd
  FROM q_seq WHERE i = 1
  UNION ALL
  SELECT symbol, i, ts, close, high, low, e9, e12, e20, e21, e26, sig, (e12 - e26) - sig, hist_prev, g, l, trn, trd,
         wtr, wp, wm,
         CASE WHEN dx IS NULL THEN adx0 WHEN adx0 IS NULL THEN dx
              ELSE (adxw * (1 - {W}) * adx0 + {W} * dx) / (adxw * (1 - {W}) + {W}) END,
         CASE WHEN adx0 IS NULL THEN 1.0 WHEN dx IS NULL THEN adxw * (1 - {W}) ELSE 1.0 END,
         adxn + (CASE WHEN dx IS NULL THEN 0 ELSE 1 END), pdi, mdi, st, fu, fl, up,
         CASE WHEN flip THEN ep0 ELSE cand END,
         CASE WHEN flip THEN (CASE WHEN bull0 THEN low ELSE high END)
              WHEN bull0 AND high > ep0 THEN high WHEN NOT bull0 AND low < ep0 THEN low ELSE ep0 END,
         CASE WHEN flip THEN 0.02 WHEN (bull0 AND high > ep0) OR (NOT bull0 AND low < ep0) THEN least(af0 + 0.02, 0.2)
              ELSE af0 END,
         CASE WHEN flip THEN NOT bull0 ELSE bull0 END, peak, least(dd0, close / peak - 1)
  FROM (SELECT *, {ema('(e12 - e26)', 'sig0', 9)} AS sig,
               CASE WHEN pdi + mdi <> 0 THEN 100 * abs(pdi - mdi) / (pdi + mdi) END AS dx,
               CASE WHEN bull0 THEN low < cand ELSE high > cand END AS flip
        FROM (SELECT *, CASE WHEN i >= 14 THEN 100 * wp / nullif(wtr, 0) END AS pdi,
                     CASE WHEN i >= 14 THEN 100 * wm / nullif(wtr, 0) END AS mdi,
                     CASE WHEN i >= 10 THEN (high + low) / 2 + 3 * st END AS ub,
                     CASE WHEN i >= 10 THEN (high + low) / 2 - 3 * st END AS lb,
                     CASE WHEN pc0 <= fu0 THEN least((high + low) / 2 + 3 * st, fu0)
                          WHEN i >= 10 THEN (high + low) / 2 + 3 * st END AS fu,
                     CASE WHEN pc0 >= fl0 THEN greatest((high + low) / 2 - 3 * st, fl0)
                          WHEN i >= 10 THEN (high + low) / 2 - 3 * st END AS fl,
                     CASE WHEN close > fu0 THEN TRUE WHEN close < fl0 THEN FALSE ELSE up0 END AS up
              FROM (SELECT b.symbol, b.i, b.ts, b.close, b.high, b.low, f.pc AS pc0, {ema('b.close', 'f.e9', 9)} AS e9,
                           {ema('b.close', 'f.e12', 12)} AS e12, {ema('b.close', 'f.e20', 20)} AS e20,
                           {ema('b.close', 'f.e21', 21)} AS e21, {ema('b.close', 'f.e26', 26)} AS e26, f.sig AS sig0,
                           f.hist AS hist_prev, greatest(b.close - f.pc, 0) + f.g * (1 - {W}) AS g,
                           greatest(f.pc - b.close, 0) + f.l * (1 - {W}) AS l, {TR} + f.trn * (1 - {W}) AS trn,
                           1 + f.trd * (1 - {W}) AS trd, {TR} * {W} + f.wtr * (1 - {W}) AS wtr,
                           (CASE WHEN b.high - f.ph > f.pl - b.low AND b.high > f.ph THEN b.high - f.ph ELSE 0 END) * {W}
                             + f.wp * (1 - {W}) AS wp,
                           (CASE WHEN f.pl - b.low > b.high - f.ph AND b.low < f.pl THEN f.pl - b.low ELSE 0 END) * {W}
                             + f.wm * (1 - {W}) AS wm,
                           f.adx AS adx0, f.adxw, f.adxn, {TR} * 0.1 + f.st * 0.9 AS st, f.fu AS fu0, f.fl AS fl0, f.up AS up0,
                           f.ps + f.af * (f.ep - f.ps) AS cand, f.ep AS ep0, f.af AS af0, f.bull AS bull0,
                           greatest(f.peak, b.close) AS peak, f.dd AS dd0
                    FROM q_fold f JOIN q_seq b ON b.symbol = f.symbol AND b.i = f.i + 1)))""")
define("q_lasti", "SELECT symbol, max(i) AS i FROM q_seq GROUP BY symbol")
define("q_folded", f"""
  SELECT f.symbol, e12 - e26 AS macd, sig AS macd_signal, hist AS macd_hist, hist_prev AS macd_hist_prev,
         100 - 100 / (1 + g / nullif(l, 0)) AS rsi, trn / trd AS atr, e9 AS ema9, e21 AS ema21, e9 > e21 AS ema9_above_21,
         CASE WHEN adxn >= 14 THEN adx END AS adx, pdi AS plus_di, mdi AS minus_di, up AS supertrend_up,
         pc > ps AS psar_bull, (pc - (e20 - 2 * wtr)) / nullif(4 * wtr, 0) * 100 AS keltner_pos, dd * 100 AS max_drawdown_pct
  FROM q_fold f JOIN q_lasti USING (symbol, i)""")
define("q_raw", "SELECT w.*, f.* EXCLUDE (symbol), 100 * atr / price AS atr_pct FROM q_win w JOIN q_folded f USING (symbol)")

BASIC = ("price prev_close daily_return sma20 sma50 sma200 bb_pctb bb_bandwidth vol vol_avg20 rvol high20 low20 high52 "
         "low52 pct_from_high52 ret_5d ret_20d ret_60d vol_daily sma150 sma150_1m_ago sma200_1m_ago pct_above_low52 "
         "stoch_k stoch_d williams_r cci roc10 mfi cmf aroon_up aroon_down vol_annual_pct pivot pivot_r1 pivot_s1 "
         "range_pos_pct macd macd_signal macd_hist macd_hist_prev rsi atr atr_pct ema9 ema21 adx plus_di minus_di "
         "keltner_pos max_drawdown_pct").split()
FLAGS = "obv_rising ichimoku tenkan_above_kijun fib_nearest ema9_above_21 supertrend_up psar_bull".split()

G1 = pts("CASE WHEN rvol >= 1.5 THEN least(25, (rvol - 1) * 20) END", "CASE WHEN price > high20 THEN 20 END",
         "CASE WHEN price < low20 THEN 20 END",
         "CASE WHEN (macd_hist > 0 AND macd_hist_prev <= 0) OR (macd_hist < 0 AND macd_hist_prev >= 0) THEN 15 END",
         "CASE WHEN rsi <= 30 OR rsi >= 70 THEN 12 END", "CASE WHEN atr_pct >= 2 THEN 8 WHEN atr_pct < 0.8 THEN -5 END",
         "CASE WHEN abs(daily_return) >= 0.03 THEN 10 END")
LONGS = ("((price > high20)::INT + (macd_hist > 0 AND macd_hist_prev <= 0)::INT + (rsi <= 30)::INT "
         "+ (daily_return >= 0.03)::INT)")
SHORTS = ("((price < low20)::INT + (macd_hist < 0 AND macd_hist_prev >= 0)::INT + coalesce((rsi >= 70)::INT, 0) "
          "+ (daily_return <= -0.03)::INT)")


def g2() -> str:
    return r(cl(pts(
        "CASE WHEN price > sma200 THEN 25 WHEN sma200 IS NOT NULL THEN -10 END", "CASE WHEN sma50 > sma200 THEN 15 END",
        "CASE WHEN rsi >= 40 AND rsi <= 55 THEN 20 WHEN rsi < 40 THEN 10 WHEN rsi > 70 THEN -10 END",
        "CASE WHEN price > sma200 AND (price / sma50 - 1) * 100 >= -3 AND (price / sma50 - 1) * 100 <= 3 THEN 15 END",
        "CASE WHEN pct_from_high52 >= -15 AND pct_from_high52 <= -3 THEN 10 WHEN pct_from_high52 <= -40 THEN 5 END",
        "CASE WHEN ret_60d > 0 THEN least(10, ret_60d / 3) END", "CASE WHEN macd > macd_signal THEN 5 END"), 0, 100), 1)


define("q_feat", f"""
  SELECT q.symbol, q.ts, u.listing, u.name, u.ord, {', '.join(f'{r(chr(34) + c + chr(34), 4)} AS "{c}"' for c in BASIC)}, {', '.join(FLAGS)},
         {r('daily_return * 100', 4)} AS daily_return_pct, {r(cl(G1, 0, 100), 1)} AS daytrade_score,
         CASE WHEN {LONGS} + {SHORTS} = 0 THEN 'NEUTRAL' WHEN {LONGS} >= {SHORTS} THEN 'LONG' ELSE 'SHORT' END
           AS daytrade_direction, {g2()} AS longterm_score,
         daily_return AS raw_daily_return, rsi AS raw_rsi, rvol AS raw_rvol, atr_pct AS raw_atr_pct,
         high20 AS raw_high20, low20 AS raw_low20, price AS raw_price, sma50 AS raw_sma50, sma200 AS raw_sma200,
         pct_from_high52 AS raw_pfh, ret_60d AS raw_ret60, macd AS raw_macd, macd_signal AS raw_signal,
         macd_hist AS raw_hist, macd_hist_prev AS raw_hist_prev
  FROM q_raw q JOIN q_universe u USING (symbol)""")
