"""True range, its averages, and the adaptive Laguerre oscillator.

Everything but the filter is window expressions.  The filter's state after a
bar depends on all bars before, but with a factor gamma of at most
1 - 10 / (1.75 P + 9) for each step: what lies ``reach`` bars back weighs less
than 1e-15, so a slice of a series may start from zero that much earlier.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.scan import scan, spread

#: Gaps between stages (and changes of one), relative to the stages, that count
#: as none.  On a flat tail they become rounding residue, whose signs mean nothing and depend on
#: where the fold began; below this bound they are taken as settled.
SETTLED = 1e-12


def settled(a: Column, b: Column) -> Column:
    """a - b, or 0 if that is residue."""
    return F.when(F.abs(a - b) <= SETTLED * (F.abs(a) + F.abs(b)), 0.0).otherwise(a - b)


def order():
    return Window.partitionBy("series").orderBy("ts")


def rows(a: int, b: int = 0):
    return order().rowsBetween(a, b)


def reach(period: int, offset: float = 0.75) -> int:
    """Bars after which a state's weight is below 1e-15 (four stages add a polynomial factor)."""
    gamma = 1 - 10 / (period * (1 + offset) + 9)
    n = 1
    while n**3 * gamma**n > 1e-15:
        n += 1
    return n


def volatility(df: DataFrame, period: int = 14, offset: float = 0.75) -> DataFrame:
    """Adds tr, atr, min_atr, max_atr, adaptive_coeff, gamma."""
    before = F.lag("close").over(order())
    tr = F.when(before.isNull(), F.col("high") - F.col("low")).otherwise(F.greatest("high", before) - F.least("low", before))
    out = df.withColumn("tr", tr)
    out = out.withColumn("trs", F.collect_list("tr").over(rows(1 - period))).withColumn("atr", F.avg("tr").over(rows(1 - period)))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k"), F.lit(math.inf).alias("lo"), F.lit(-math.inf).alias("hi"))

    def step(acc, x):
        s, k = acc["s"] + x, acc["k"] + 1
        return F.struct(s.alias("s"), k.alias("k"), F.least(acc["lo"], s / k).alias("lo"), F.greatest(acc["hi"], s / k).alias("hi"))

    out = out.withColumn("ends", F.aggregate(F.reverse("trs"), start, step))
    out = out.withColumns({"min_atr": F.col("ends.lo"), "max_atr": F.col("ends.hi")})
    hi, lo = F.greatest("max_atr", "atr"), F.least("min_atr", "atr")
    out = out.withColumn("adaptive_coeff", F.when(hi == lo, 0.5).otherwise(1 - (F.col("atr") - lo) / F.nullif(hi - lo, F.lit(0.0))))
    return out.withColumn("gamma", 1 - 10 / (period * (F.col("adaptive_coeff") + offset) + 9)).drop("trs", "ends")


def filter_stages(seeded: bool = False, span: int = 5):
    """For ``scan``: a function of arrays (price, gamma) to l0 to l3, rsi and its velocity (the average, of ``span``, of its changes)."""
    alpha = 2 / (span + 1)

    def make():
        state, known = [0.0] * 4, []

        def work(price: np.ndarray, gamma: np.ndarray) -> tuple[np.ndarray, ...]:
            a, b, c, d = state
            if seeded and not known and len(price):
                a = b = c = d = float(price[0])
            out = np.empty((len(price), 4))
            rows = []
            for p, g in zip(price.tolist(), gamma.tolist(), strict=True):
                if p == p and g == g:  # a bar without a price leaves the state as it is
                    a0, b0, c0 = a, b, c
                    a = p + g * (a - p)
                    b = a0 + g * (b - a)
                    c = b0 + g * (c - b)
                    d = c0 + g * (d - c)
                rows.append((a, b, c, d))
            out[:] = rows if rows else out
            state[:] = a, b, c, d
            gaps = out[:, :-1] - out[:, 1:]
            gaps[np.abs(gaps) <= SETTLED * (np.abs(out[:, :-1]) + np.abs(out[:, 1:]))] = 0.0
            up, moved = np.maximum(gaps, 0).sum(axis=1), np.abs(gaps).sum(axis=1)
            rsi = np.where(moved == 0, 0.0, up / np.where(moved == 0, 1.0, moved))
            last, velocity = known if known else (rsi[0] if len(rsi) else 0.0, 0.0)
            speed = []
            for change in np.diff(rsi, prepend=last).tolist():
                velocity += alpha * (change - velocity)
                speed.append(velocity)
            if len(rsi):
                known[:] = float(rsi[-1]), velocity
            return (*out.T, rsi, np.array(speed))

        return work

    return make


STAGES = ("l0", "l1", "l2", "l3", "rsi", "rsi_velocity")


def laguerre(df: DataFrame, period: int = 14, offset: float = 0.75, price: str = "close", gamma: str = "gamma", seeded: bool = False, span: int = 5) -> DataFrame:
    """Adds l0 to l3, rsi and rsi_velocity; stages start from zero or, ``seeded``, from the first price."""
    out = scan(df, "__stages", filter_stages(seeded, span), [F.col(price).cast("double"), F.col(gamma).cast("double")], dict.fromkeys(STAGES, "double"))
    return spread(out, "__stages", STAGES)


def fixed_period(df: DataFrame, period: float, price: str = "close") -> DataFrame:
    """Adds l0 to l3 and rsi of a filter of one constant period, whose stages start from the first price."""
    if period <= 0:
        raise ValueError("a period is positive")
    out = laguerre(df.withColumn("__gamma", F.lit(1.0 - 10.0 / (period + 9.0))), price=price, gamma="__gamma", seeded=True)
    return out.drop("__gamma", "rsi_velocity")


def ranges_of(period: int, offset: float):
    """A function of arrays (high, low, close), piece after piece, to tr, atr, min_atr, max_atr, adaptive_coeff and gamma.

    Sums of the newest ranges grow one range at a time for all bars at once, so
    a flat stretch has sums of exactly 0.
    """
    past, last = np.zeros(0), []

    def work(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> tuple[np.ndarray, ...]:
        nonlocal past
        n = len(close)
        before = np.concatenate((last or [np.nan], close[:-1])) if n else close
        tr = np.where(np.isnan(before), high - low, np.fmax(high, before) - np.fmin(low, before))
        every, m = np.concatenate((past, tr)), len(past)
        total, atr = np.zeros(n), np.zeros(n)
        least, most = np.full(n, np.inf), np.full(n, -np.inf)
        for k in range(period):
            first = max(0, k - m)  # bars that have k ranges before them
            if first >= n:
                break
            total[first:] += every[m - k + first : m - k + n]
            mean = total[first:] / (k + 1)
            atr[first:] = mean
            np.minimum(least[first:], mean, out=least[first:])
            np.maximum(most[first:], mean, out=most[first:])
        if n:
            last[:] = [float(close[-1])]
            past = every[-(period - 1) :] if period > 1 else past
        span = most - least
        coeff = np.where(span == 0, 0.5, 1 - (atr - least) / np.where(span == 0, 1.0, span))
        return tr, atr, least, most, coeff, 1 - 10 / (period * (coeff + offset) + 9)

    return work


def ranks_of(window: int):
    """A function of an array, piece after piece, to the share, in percent, of the last ``window`` values that lie below the newest."""
    past = np.zeros(0)

    def work(x: np.ndarray) -> np.ndarray:
        nonlocal past
        every, m, n = np.concatenate((past, x)), len(past), len(x)
        below = np.zeros(n)
        for k in range(1, window):
            first = max(0, k - m)
            if first >= n:
                break
            below[first:] += every[m - k + first : m - k + n] < x[first:]
        past = every[-(window - 1) :] if window > 1 else past
        return below / np.minimum(np.arange(m, m + n) + 1, window) * 100

    return work


INDICATOR = ("tr", "atr", "min_atr", "max_atr", "adaptive_coeff", "gamma", *STAGES, "rsi_percentile")


def indicator(df: DataFrame, period: int = 14, offset: float = 0.75, span: int = 5, window: int = 20) -> DataFrame:
    """Bars (series, ts, open, high, low, close, volume) with all of the above and rsi_percentile, its rank within ``window`` bars.

    One pass in Arrow batches: what ``volatility`` does by windows is here a few
    array operations.  A bar with a null price has nulls and counts for nothing.
    """
    if period < 1 or window < 1 or span < 1:
        raise ValueError("periods are one bar or more")

    def make():
        ranges, stages, ranks = ranges_of(period, offset), filter_stages(span=span)(), ranks_of(window)

        def work(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> tuple[np.ndarray, ...]:
            known = ~(np.isnan(high) | np.isnan(low) | np.isnan(close))
            if not known.all():
                out = [np.full(len(close), np.nan) for _ in INDICATOR]
                for full, own in zip(out, work(high[known], low[known], close[known]), strict=True):
                    full[known] = own
                return tuple(out)
            found = ranges(high, low, close)
            filtered = stages(close, found[-1])
            return (*found, *filtered, ranks(filtered[4]))

        return work

    out = scan(df, "__all", make, [F.col(c).cast("double") for c in ("high", "low", "close")], dict.fromkeys(INDICATOR, "double"))
    return spread(out, "__all", INDICATOR)
