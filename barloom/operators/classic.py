"""The oscillator in its first, chart-platform form, and bars of any number of minutes mapped back to a chart."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.averages import add_average, applied_price
from ..functions.columns import from_seconds, seconds
from ..plans.scan import scan, spread
from .kernel import SETTLED, order, rows


def _stages(period: int):
    def make():
        state: list = []

        def work(price: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
            out = []
            for p, n in zip(price.tolist(), length.tolist(), strict=True):
                if not state or not n > 1:
                    state[:] = [p] * 4
                    out.append((p, p, p, p, 0.0))
                    continue
                g = 1 - 10 / (n + 9)
                a, b, c, d = state
                a1 = p + g * (a - p)
                b1 = a + g * (b - a1)
                c1 = b + g * (c - b1)
                d1 = c + g * (d - c1)
                state[:] = a1, b1, c1, d1
                gaps = [0.0 if abs(x - y) <= SETTLED * (abs(x) + abs(y)) else x - y for x, y in zip(state, state[1:])]  # noqa: B905
                moved = sum(map(abs, gaps))
                out.append((*state, sum(max(x, 0.0) for x in gaps) / moved if moved else 0.0))
            return tuple(np.array(out, dtype=float).reshape(-1, 5).T)

        return work

    return make


def classic_rsi(bars: DataFrame, period: int = 32, smoothing: int = 5, method: str = "exponential", price: str = "close", up: float = 0.85, down: float = 0.15) -> DataFrame:
    """``bars`` with rsi and level (1 above ``up``, 2 below ``down``, else 0).

    What differs from ``kernel.indicator``: the price is smoothed first (itself
    where the average doesn't exist yet), the range average always divides by
    ``period``, its least and greatest are of the ``period`` - 1 averages before,
    the stages start at the price, and again wherever the period is 1 or less.
    """
    before = F.lag("close").over(order())
    tr = F.when(before.isNull(), F.col("high") - F.col("low")).otherwise(F.greatest("high", before) - F.least("low", before))
    out = bars.withColumn("__price", applied_price(price)).withColumn("__tr", tr)
    out = add_average(out, "__smooth", method, smoothing, "__price").withColumn("__smooth", F.coalesce("__smooth", "__price"))
    out = out.withColumn("__atr", F.sum("__tr").over(rows(1 - period)) / period)
    past = rows(1 - period, -1) if period > 1 else rows(0)
    low, high = (F.coalesce(f("__atr").over(past), F.col("__atr")) for f in (F.min, F.max))
    low, high = F.least(low, "__atr"), F.greatest(high, "__atr")
    out = out.withColumns({"__low": low, "__high": high})
    coeff = F.when(F.col("__low") == F.col("__high"), 0.5).otherwise(1 - (F.col("__atr") - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0)))
    out = out.withColumn("__length", period * (coeff + 0.75))
    fields = ("l0", "l1", "l2", "l3", "rsi")
    out = spread(scan(out, "__s", _stages(period), ["__smooth", "__length"], dict.fromkeys(fields, "double")), "__s", fields)
    level = F.when(F.col("rsi") > up, 1).when(F.col("rsi") < down, 2).otherwise(0).cast("long")
    return out.withColumn("level", level).select(*bars.columns, "rsi", "level")


def minute_bars(bars: DataFrame, minutes: int, week: bool = False) -> DataFrame:
    """Bars of ``minutes`` from midnight of their day, or from Monday's with ``week``; incomplete ones included."""
    if minutes < 1:
        raise ValueError("a bar has a minute or more")
    at, width = seconds("ts"), minutes * 60
    # 1970-01-05 was a Monday.
    origin = F.floor((at - 4 * 86400) / (7 * 86400)) * (7 * 86400) + 4 * 86400 if week else F.floor(at / 86400) * 86400
    start = from_seconds(origin + F.floor((at - origin) / width) * width)
    out = bars.groupBy("series", start.alias("bar")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return out.withColumnRenamed("bar", "ts")


def map_to_chart(chart: DataFrame, bars: DataFrame, names: list[str], suffix: str = "_bar") -> DataFrame:
    """Adds to each chart row the bar that it lies in, or the latest that began before; null before the first."""
    from .multi import as_of

    return as_of(chart, bars, names, suffix, time="ts", strict=False)


def classic_rsi_of_minutes(bars: DataFrame, minutes: int, period: int = 32, smoothing: int = 5, price: str = "close") -> DataFrame:
    """``bars`` with rsi_bar: the oscillator, smoothed by a simple mean, of bars of ``minutes`` on the chart's bars.

    Within its window a bar's value is that of the whole window, as on a chart;
    for values without look-ahead shift ``ts`` of the bars by their width.
    """
    return map_to_chart(bars, classic_rsi(minute_bars(bars, minutes), period, smoothing, "simple", price), ["rsi"])
