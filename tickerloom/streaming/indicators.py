"""Running indicators and alerts per symbol over a bar stream: keyed state with event-time timers.

Defined behaviour of both: within a micro-batch the bars of a symbol are taken in time order; a bar that isn't later than
the symbol's newest one is dropped (the state has gone past it). A missing price counts as in the batch folds: means stay
and their weights decay, comparisons are false. A symbol starts anew with a bar that comes more than `idle_days` after the one before
it; a timer removes its state once that much event time went by without one. The state is a few dozen numbers a symbol; the store keeps it on disk (RocksDB).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickerloom.operators.indicators import EMA, PERIOD, SIGNAL, WILDER

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = ("symbol string, ts date, macd double, macd_signal double, macd_hist double, rsi double, atr double, ema9 double, ema21 double, adx double, "
          "plus_di double, minus_di double, supertrend_up boolean, psar_bull boolean")
MEANS = ("avg array<double>, w array<double>, n array<long>, close double, high double, low double, bars long, newest long, "
         "band_up double, band_low double, rising boolean, level double, extreme double, speed double, bull boolean")

# the smoothings in state order: of the close, of gains, losses and ranges, of directed moves, of Supertrend's range; then MACD's signal and DX
FIRST = (*EMA, "gain", "loss", "range", "wilder", "plus", "minus", "trend")
ALPHA = (*EMA.values(), *[WILDER] * 6, 0.1, SIGNAL, WILDER)
ADJUST = tuple(k in ("gain", "loss", "range") for k in (*FIRST, "signal", "dx"))
# per smoothing: decay of a bar, weight of a new value, what the weight grows by
RATES = tuple((1 - a, 1.0 if adjust else a, adjust) for a, adjust in zip(ALPHA, ADJUST, strict=True))
AT = {k: i for i, k in enumerate((*FIRST, "signal", "dx"))}


def _most(a: float, b: float) -> float:
    """The larger one; of a missing value and a value, the value."""
    return b if a != a else a if b != b else max(a, b)


class _Symbol:
    """The recursions of one symbol."""

    def __init__(self, kept: tuple | None):
        if kept is None:
            size, nan = len(AT), float("nan")
            kept = ([nan] * size, [1.0] * size, [0] * size, nan, nan, nan, 0, 0, nan, nan, True, nan, nan, 0.02, True)
        avg, w, n, *rest = kept
        self.avg, self.w, self.n = [float(x) for x in avg], [float(x) for x in w], [int(x) for x in n]
        (self.close, self.high, self.low, self.bars, self.newest, self.band_up, self.band_low, self.rising, self.level, self.extreme, self.speed, self.bull) = rest

    def kept(self) -> tuple:
        return (list(self.avg), list(self.w), list(self.n), self.close, self.high, self.low, self.bars, self.newest,
                self.band_up, self.band_low, self.rising, self.level, self.extreme, self.speed, self.bull)

    def _smooth(self, first: int, values: tuple[float, ...]) -> None:
        """One bar for the smoothings from `first` on, in plain floats: arrays of a dozen numbers cost more than the numbers. NaN is a missing value."""
        avg, weights, n = self.avg, self.w, self.n
        for i, x in enumerate(values, first):
            keep, gain, adjust = RATES[i]
            old, decayed = avg[i], weights[i] * keep
            if x != x:
                weights[i] = 1.0 if old != old else decayed
                continue
            if old != old:
                avg[i], weights[i] = x, 1.0
            else:
                avg[i], weights[i] = (decayed * old + gain * x) / (decayed + gain), decayed + 1 if adjust else 1.0
            n[i] += 1

    def _ready(self, name: str, least: int = PERIOD) -> float:
        return self.avg[AT[name]] if self.n[AT[name]] >= least else float("nan")

    def _trend(self, high: float, low: float, close: float) -> None:
        reach, mid = 3.0 * self._ready("trend", 10), (high + low) / 2
        upper, lower = mid + reach, mid - reach
        self.rising = True if close > self.band_up else False if close < self.band_low else self.rising
        self.band_up = -_most(-upper, -self.band_up) if self.close <= self.band_up else upper
        self.band_low = _most(lower, self.band_low) if self.close >= self.band_low else lower

    def _reverse(self, high: float, low: float) -> None:
        if self.level != self.level:
            self.level, self.extreme, self.speed, self.bull = low, high, 0.02, True
            return
        level = self.level + self.speed * (self.extreme - self.level)
        best, worst = (high, low) if self.bull else (low, high)
        side = 1 if self.bull else -1
        if side * worst < side * level:
            self.level, self.extreme, self.speed, self.bull = self.extreme, worst, 0.02, not self.bull
            return
        self.level = level
        if side * best > side * self.extreme:
            self.extreme, self.speed = best, min(self.speed + 0.02, 0.2)

    def bar(self, high: float, low: float, close: float) -> tuple:
        up, down, change = high - self.high, self.low - low, close - self.close
        span = _most(_most(high - low, abs(high - self.close)), abs(low - self.close))
        self._smooth(0, (*[close] * len(EMA), max(change, 0.0) if change == change else change, max(-change, 0.0) if change == change else change, span, span,
                         up if up > down and up > 0 else 0.0, down if down > up and down > 0 else 0.0, span))
        macd = self.avg[AT["ema12"]] - self.avg[AT["ema26"]]
        true = self._ready("wilder")
        plus, minus = (100 * self._ready(m) / true if true else float("nan") for m in ("plus", "minus"))
        dx = 100 * abs(plus - minus) / (plus + minus) if plus + minus else float("nan")
        self._smooth(len(FIRST), (macd, dx))
        self._trend(high, low, close)
        self._reverse(high, low)
        self.high, self.low, self.close, self.bars = high, low, close, self.bars + 1
        loss = self._ready("loss")
        rsi = 100 - 100 / (1 + self._ready("gain") / loss) if loss else float("nan")
        signal = self.avg[AT["signal"]]
        return (macd, signal, macd - signal, rsi, self._ready("range"), self.avg[AT["ema9"]], self.avg[AT["ema21"]], self._ready("dx"), plus, minus,
                self.rising if self.bars > 1 else None, bool(close > self.level) if close == close and self.level == self.level else None)


def _in_order(rows: Iterator[pd.DataFrame], newest: int) -> tuple[pd.DataFrame, np.ndarray]:
    """The bars after `newest`, in time order and with one bar a time, and their times in milliseconds."""
    frame = pd.concat(list(rows)).sort_values("at", kind="stable").drop_duplicates("at", keep="last")
    at = (frame["at"].astype("int64") // {"ns": 1_000_000, "us": 1_000, "ms": 1}[np.datetime_data(frame["at"].dt.tz_localize(None).dtype)[0]]).to_numpy()
    return frame[at > newest], at[at > newest]


class _Expiring(StatefulProcessor):
    """Common part: one timer a symbol, moved on with its newest bar; when it fires the state goes."""

    def __init__(self, idle_days: int):
        self.idle = idle_days * 86_400_000

    def _wait(self, last: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.idle)

    def close(self) -> None:
        pass


class RunningIndicators(_Expiring):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("recursions", MEANS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s = _Symbol(tuple(self.state.get()) if self.state.exists() else None)
        frame, at = _in_order(rows, s.newest if s.bars else -(1 << 62))
        if not len(frame):
            return
        out = []
        for time, *bar in zip(at.tolist(), *(frame[c].astype(float).tolist() for c in ("high", "low", "close")), strict=True):
            s = s if not s.bars or time - s.newest <= self.idle else _Symbol(None)
            out.append(s.bar(*bar))
            s.newest = time
        self.state.update(s.kept())
        self._wait(s.newest)
        names = [c.strip().split(" ")[0] for c in OUTPUT.split(",")]
        table = pd.DataFrame(out, columns=names[2:])
        table[names[2:12]] = table[names[2:12]].astype(float)
        table.insert(0, "ts", frame["ts"].to_numpy())
        table.insert(0, "symbol", key[0])
        yield table.astype({"supertrend_up": "boolean", "psar_bull": "boolean"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter(())


class DropAndVolume(_Expiring):
    """The last five closes of a symbol: each bar's return over five bars."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.closes, self.newest = handle, handle.getListState("closes", "close double"), handle.getValueState("newest", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame, at = _in_order(rows, self.newest.get()[0] if self.newest.exists() else -(1 << 62))
        at, frame = at[frame["close"].notna().to_numpy()], frame[frame["close"].notna()]
        if not len(frame):
            return
        closes = [x[0] for x in self.closes.get()] if self.closes.exists() else []
        change, last = [], self.newest.get()[0] if self.newest.exists() else int(at[0])
        for time, close in zip(at.tolist(), frame["close"].astype(float), strict=True):
            closes = closes if time - last <= self.idle else []
            change.append((close / closes[0] - 1) * 100 if len(closes) == 5 and closes[0] else None)
            closes, last = [*closes, close][-5:], time
        self.closes.put([(float(x),) for x in closes])
        self.newest.update((last,))
        self._wait(int(at[-1]))
        yield pd.DataFrame({"symbol": key[0], "ts": frame["ts"].to_numpy(), "volume": frame["volume"].astype(float).to_numpy(), "ret_5d": np.array(change, float)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.closes.clear()
        self.newest.clear()
        return iter(())


def use_disk_state(spark: SparkSession) -> None:
    """Typed state needs the store that keeps it on disk; another one that was chosen for the session stays."""
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _keyed(bars: DataFrame, delay: str, columns: tuple[str, ...]) -> DataFrame:
    use_disk_state(bars.sparkSession)
    timed = bars.select("symbol", "ts", F.col("ts").cast("timestamp").alias("at"), *[F.col(c).cast("double").alias(c) for c in columns])
    return timed.withWatermark("at", delay)


def running_indicators(bars: DataFrame, idle_days: int = 400, delay: str = "7 days") -> DataFrame:
    """Bar stream -> MACD, RSI, ATR, EMA, ADX, Supertrend and SAR at every bar."""
    rows = _keyed(bars, delay, ("high", "low", "close"))
    return rows.groupBy("symbol").transformWithStateInPandas(RunningIndicators(idle_days), OUTPUT, "Append", "EventTime")


def five_day_returns(bars: DataFrame, idle_days: int = 400, delay: str = "7 days") -> DataFrame:
    """Bar stream -> symbol, ts, volume, ret_5d (percent against the close five bars before; NULL until there is one)."""
    rows = _keyed(bars, delay, ("close", "volume"))
    return rows.groupBy("symbol").transformWithStateInPandas(DropAndVolume(idle_days), "symbol string, ts date, volume double, ret_5d double", "Append", "EventTime")
