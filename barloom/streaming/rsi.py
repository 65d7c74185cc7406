"""The oscillator bar by bar: on streams, with the state of each series kept by Spark, and in plain Python."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.kernel import SETTLED

STATE = "close double, ranges array<double>, stages array<double>, ts timestamp"
#: What one update tells besides the oscillator.
VALUES = ("tr", "atr", "min_atr", "max_atr", "adaptive_coeff", "period", "gamma", "l0", "l1", "l2", "l3", "rsi")


class Oscillator:
    """Updates of one series; begins cold, and can be exported and taken up again."""

    def __init__(self, period: int = 14, offset: float = 0.75):
        if period < 1:
            raise ValueError("a period is one bar or more")
        self.period, self.offset = period, offset
        self.reset()

    def reset(self) -> None:
        self.close, self.ranges, self.stages = None, [], [0.0] * 4

    def export(self) -> tuple:
        return self.close, list(self.ranges), list(self.stages)

    def restore(self, close: float | None, ranges: list[float], stages: list[float]) -> Oscillator:
        self.close, self.ranges, self.stages = close, list(ranges), list(stages)
        return self

    def update(self, bar: dict) -> float:
        return self.update_full(bar)["rsi"]

    def update_full(self, bar: dict) -> dict[str, float]:
        missing = [c for c in ("high", "low", "close") if bar.get(c) is None]
        if missing:
            raise ValueError(f"missing values: {', '.join(missing)}")
        high, low, close = (float(bar[c]) for c in ("high", "low", "close"))
        tr = high - low if self.close is None else max(high, self.close) - min(low, self.close)
        self.close = close
        self.ranges = [*self.ranges, tr][-self.period :]
        means, total = [], 0.0
        for k, x in enumerate(reversed(self.ranges), 1):
            total += x
            means.append(total / k)
        atr, least, most = means[-1], min(means), max(means)
        coeff = 0.5 if least == most else 1 - (atr - least) / (most - least)
        length = self.period * (coeff + self.offset)
        g = 1 - 10 / (length + 9)
        a, b, c, d = self.stages
        a1 = close + g * (a - close)
        b1 = a + g * (b - a1)
        c1 = b + g * (c - b1)
        self.stages = [a1, b1, c1, c + g * (d - c1)]
        pairs = list(zip(self.stages, self.stages[1:]))  # noqa: B905
        gaps = [0.0 if abs(x - y) <= SETTLED * (abs(x) + abs(y)) else x - y for x, y in pairs]
        moved = math.fsum(map(abs, gaps))
        rsi = math.fsum(max(x, 0.0) for x in gaps) / moved if moved else 0.0
        return dict(zip(VALUES, (tr, atr, least, most, coeff, length, g, *self.stages, rsi), strict=True))


class _Processor(StatefulProcessor):
    def __init__(self, period: int, offset: float):
        self.period, self.offset = period, offset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        bars = pd.concat(list(rows)).sort_values("ts")
        one, last = Oscillator(self.period, self.offset), None
        if self.held.exists():
            close, ranges, stages, last = self.held.get()
            one.restore(close, list(ranges), list(stages))
        out = []
        for bar in bars.to_dict("records"):
            # A bar no later than the last one is late: it changes nothing and is told with a null.
            late = last is not None and bar["ts"] <= last
            if not late:
                last = bar["ts"]
            out.append({"series": key[0], "ts": bar["ts"], "close": bar["close"], "rsi": None if late else one.update(bar), "late": late})
        if last is not None:
            self.held.update((one.close, one.ranges, one.stages, last))
        yield pd.DataFrame(out, columns=["series", "ts", "close", "rsi", "late"])

    def close(self) -> None:
        pass


def stream_oscillator(bars: DataFrame, period: int = 14, offset: float = 0.75) -> DataFrame:
    """(series, ts, close, rsi, late) of a stream of bars; ``ts`` is a timestamp.

    Bars of a micro-batch are put in order; bars that come after a later one of
    their series are marked ``late`` and don't touch the state.  Needs the
    RocksDB state store provider.
    """
    own = bars.select("series", "ts", "high", "low", "close")
    out = own.groupBy("series").transformWithStateInPandas(_Processor(period, offset), "series string, ts timestamp, close double, rsi double, late boolean", outputMode="Append", timeMode="None")
    return out


def stream_bars(events: DataFrame, minutes: int, delay: str = "10 minutes", series: str = "event_type") -> DataFrame:
    """Bars of a stream of events (ts, value, event_id, ``series``), each told once its window is ``delay`` behind the latest event."""
    place = F.struct("ts", "event_id")
    window = F.window("ts", f"{minutes} minutes")
    out = events.where("value IS NOT NULL").withWatermark("ts", delay).groupBy(F.col(series).alias("series"), window)
    out = out.agg(F.min_by("value", place).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", place).alias("close"), F.count("*").cast("double").alias("volume"))
    return out.select("series", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


class _Once(StatefulProcessor):
    """Lets each row of a key pass once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getValueState("told", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(list(rows))
        if not self.told.exists():
            self.told.update((1,))
            yield got.head(1)

    def close(self) -> None:
        pass


def alert_once(alerts: DataFrame, keys: tuple[str, ...] = ("series", "ts", "kind")) -> DataFrame:
    """A stream of alerts, each key's first one only."""
    return alerts.groupBy(*keys).transformWithStateInPandas(_Once(), alerts.schema, outputMode="Append", timeMode="None")


