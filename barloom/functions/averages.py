"""Moving averages, applied prices and bands over bars (series, ts, open, high, low, close, volume)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.scan import scan

#: Prices by name.
PRICES = ("open", "high", "low", "close", "median", "typical", "weighted")
METHODS = ("simple", "exponential", "smoothed", "weighted")


def _rows(a: int, b: int = 0):
    return Window.partitionBy("series").orderBy("ts").rowsBetween(a, b)


def applied_price(name: str) -> Column:
    """A bar's price by name: one of its four, or a mean of some of them."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    made = {"median": (h + low) / 2, "typical": (h + low + c) / 3, "weighted": (h + low + 2 * c) / 4}
    if name not in PRICES:
        raise ValueError(f"a price is one of {', '.join(PRICES)}")
    return made.get(name, {"open": o, "high": h, "low": low, "close": c}.get(name))


def _check(period: int) -> None:
    if period < 1:
        raise ValueError("a period is one bar or more")


def _full(period: int) -> Column:
    return F.count(F.lit(1)).over(_rows(1 - period)) >= period


def simple(price: str, period: int) -> Column:
    """The mean of the last ``period`` prices; null before there are so many."""
    _check(period)
    return F.when(_full(period), F.avg(price).over(_rows(1 - period)))


def weighted(price: str, period: int) -> Column:
    """The mean of the last ``period`` prices with weights from 1 (oldest) to ``period``; null before there are so many."""
    _check(period)
    parts = [(period - k) * (F.col(price) if not k else F.lag(price, k).over(Window.partitionBy("series").orderBy("ts"))) for k in range(period)]
    return F.when(_full(period), sum(parts[1:], parts[0]) / (period * (period + 1) / 2))


def recursive(share: float, seed: str, period: int):
    """For ``scan``: prev + ``share`` * (price - prev), and how it begins.

    seed "first": the first price.  "mean": null until ``period`` prices have
    come, then their mean.  "either": the price itself until then (and again
    whenever the value before was 0, the mean of the last prices if there are
    enough).
    """

    def make():
        past: list[float] = []
        held = [None, 0]

        def work(price: np.ndarray) -> tuple[np.ndarray]:
            prev, n = held
            out = np.full(len(price), np.nan)
            for k, p in enumerate(price.tolist()):
                if p != p:  # a bar without a price has no value and changes none
                    continue
                n += 1
                past.append(p)
                del past[:-period]
                if seed == "first":
                    prev = p if prev is None else prev + share * (p - prev)
                elif seed == "mean":
                    if prev is not None:
                        prev += share * (p - prev)
                    elif n == period:
                        prev = sum(past) / period
                else:
                    if prev is None or prev == 0.0:
                        prev = sum(past) / period if n >= period else p
                    else:
                        prev += share * (p - prev)
                if prev is not None:
                    out[k] = prev
            held[:] = prev, n
            return (out,)

        return work

    return make


def add_recursive(df: DataFrame, name: str, price: str | Column, share: float, seed: str, period: int) -> DataFrame:
    out = scan(df, "__average", recursive(share, seed, period), [F.col(price) if isinstance(price, str) else price], {"v": "double"})
    return out.withColumn(name, F.col("__average.v")).drop("__average")


def add_average(df: DataFrame, name: str, method: str, period: int, price: str = "close") -> DataFrame:
    """``df`` with a moving average: simple, exponential (from the first price), smoothed (from the mean of the first ``period``) or weighted."""
    _check(period)
    if method == "simple":
        return df.withColumn(name, simple(price, period))
    if method == "weighted":
        return df.withColumn(name, weighted(price, period))
    if method == "exponential":
        return add_recursive(df, name, price, 2 / (period + 1), "first", period)
    if method == "smoothed":
        return add_recursive(df, name, price, 1 / period, "mean", period)
    raise ValueError(f"a method is one of {', '.join(METHODS)}")


def add_framework_average(df: DataFrame, name: str, method: str, period: int, price: str = "close") -> DataFrame:
    """The same four, but exponential and smoothed ones begin with the price itself (the mean, for a period of 1)."""
    _check(period)
    if method in ("exponential", "smoothed"):
        return add_recursive(df, name, price, 2 / (period + 1) if method == "exponential" else 1 / period, "either", period)
    return add_average(df, name, method, period, price)


def fast_and_slow(df: DataFrame, method: str = "simple", fast: int = 12, slow: int = 48, price: str = "close") -> DataFrame:
    """``df`` with the averages ``fast`` and ``slow``."""
    return add_average(add_average(df, "fast", method, fast, price), "slow", method, slow, price)


def volume_average(df: DataFrame, period: int = 14, scale: float = 1.0, threshold: float = 0.0) -> DataFrame:
    """``df`` with volume_ema (begun with a mean of ``period``, null before, times ``scale``) and volume_class: 0 up, 1 down by more than ``threshold``, 2 neither."""
    out = add_recursive(df, "volume_ema", F.col("volume").cast("double"), 2 / (period + 1), "mean", period)
    change = F.col("volume") - F.lag("volume").over(Window.partitionBy("series").orderBy("ts"))
    kind = F.when(change > threshold, 0).when(change < -threshold, 1).otherwise(2).cast("long")
    return out.withColumns({"volume_ema": F.col("volume_ema") * scale, "volume_class": kind})


def bollinger_width(df: DataFrame, period: int = 20, deviations: float = 2.0, price: str = "close", history: int = 999, most: int = 123) -> DataFrame:
    """``df`` with bb_width, its change in percent and a class of the change.

    The width is 2 x ``deviations`` x the standard deviation (of the whole) of
    the last ``period`` prices, null before; a change from a width of 0 is 0.
    Classes: 0 none; 1, 2, 3 slow, medium, fast increase; 4, 5, 6 the same of a
    decrease, by thirds of the last ``most`` changes of that sign within the
    last ``history`` bars, the bar's own included, so no class looks ahead.
    """
    _check(period)
    along = Window.partitionBy("series").orderBy("ts")
    out = df.withColumn("bb_width", F.when(_full(period), 2 * deviations * F.stddev_pop(price).over(_rows(1 - period))))
    before = F.lag("bb_width").over(along)
    out = out.withColumn("bb_change", F.when(before.isNull() | (before == 0), 0.0).otherwise((F.col("bb_width") - before) / before * 100))

    def thirds():
        def make():
            held: list[list] = [[], []]
            count = [0]

            def work(change: np.ndarray) -> tuple[np.ndarray]:
                out = np.zeros(len(change), dtype=np.int64)
                for k, x in enumerate(change.tolist()):
                    n = count[0] = count[0] + 1
                    side = held[x < 0]
                    if x > 0 or x < 0:
                        side.append((n, abs(x)))
                    for own in held:
                        del own[:-most]
                        while own and own[0][0] <= n - history:
                            del own[0]
                    if abs(x) < 1e-4 or x != x:
                        continue
                    sizes = sorted((v for _, v in side), reverse=True)
                    high, low = (sizes[len(sizes) // 3], sizes[2 * len(sizes) // 3]) if len(sizes) >= 3 else (sizes[0] / 2,) * 2
                    out[k] = (3 if abs(x) > high else 2 if abs(x) > low else 1) + 3 * (x < 0)
                return (out,)

            return work

        return make

    out = scan(out, "__class", thirds(), ["bb_change"], {"v": "long"})
    return out.withColumn("bb_class", F.col("__class.v")).drop("__class")


def bollinger_delta(df: DataFrame, period: int = 20, deviations: float = 2.0, ago: int = 20, percent: bool = False, point: float = 0.01, price: str = "close", calm: float = 10.0, bars: int = 10, pause: int = 50) -> DataFrame:
    """``df`` with bb_delta, its class and alerts.

    The normalised width (width by mean) less that ``ago`` - 1 bars before, in
    points or percent of it, 0 where the mean is 0, null before both exist.
    Class: 0 above the bar before, 1 below, 2 neither.  Alert 1: ``bars`` bars in
    a row within ``calm`` of 0, then none for ``pause`` bars.
    """
    _check(period)
    _check(ago)
    along = Window.partitionBy("series").orderBy("ts")
    mean = F.avg(price).over(_rows(1 - period))
    width = F.when(mean == 0, 0.0).otherwise(2 * deviations * F.stddev_pop(price).over(_rows(1 - period)) / F.nullif(mean, F.lit(0.0)))
    out = df.withColumn("__width", F.when(_full(period), width))
    then = F.lag("__width", ago - 1).over(along) if ago > 1 else F.col("__width")
    delta = (F.when(then == 0, 0.0).otherwise(100 * (F.col("__width") - then) / F.nullif(then, F.lit(0.0)))) if percent else (F.col("__width") - then) / point
    out = out.withColumn("bb_delta", F.when(then.isNotNull(), delta)).drop("__width")
    before = F.lag("bb_delta").over(along)
    out = out.withColumn("bb_delta_class", F.when(F.col("bb_delta") > before, 0).when(F.col("bb_delta") < before, 1).otherwise(2).cast("long"))

    def make():
        held = [0, 0]

        def work(delta: np.ndarray) -> tuple[np.ndarray]:
            run, rest = held
            out = np.zeros(len(delta), dtype=np.int64)
            for k, x in enumerate(delta.tolist()):
                if rest:
                    rest -= 1
                    continue
                run = run + 1 if -calm < x < calm else 0
                if run >= bars:
                    out[k], run, rest = 1, 0, pause
            held[:] = run, rest
            return (out,)

        return work

    out = scan(out, "__alert", make, ["bb_delta"], {"v": "long"})
    return out.withColumn("bb_alert", F.col("__alert.v")).drop("__alert")


def _runs(df: DataFrame, smaller: bool, count: int, same: bool) -> Column:
    along = Window.partitionBy("series").orderBy("ts")
    if count < 2:
        raise ValueError("a pattern has two bars or more")
    ago = lambda c, k: F.lag(c, k).over(along) if k else c
    body, rises = F.abs(F.col("close") - F.col("open")), F.col("close") > F.col("open")
    ok = F.lit(True)
    for k in range(count - 1):
        near, far = ago(body, k), ago(body, k + 1)
        ok = ok & (near < far if smaller else near > far)
        if same:
            ok = ok & (ago(rises, k + 1) == rises)
    return F.coalesce(ok, F.lit(False))


def contraction(df: DataFrame, count: int = 3, same: bool = True) -> DataFrame:
    """``df`` with contraction: 1 rising or -1 falling bar that ends ``count`` bars of strictly shrinking bodies (of one direction, if ``same``), else 0."""
    side = F.when(F.col("close") > F.col("open"), 1).otherwise(-1)
    return df.withColumn("contraction", F.when(_runs(df, True, count, same), side).otherwise(0).cast("long"))


def expansion(df: DataFrame, count: int = 3, same: bool = True, point: float = 0.01) -> DataFrame:
    """``df`` with expansion (as ``contraction``, of growing bodies), its signal (10 points above the high or below the low) and run: signals of one direction in a row."""
    side = F.when(F.col("close") > F.col("open"), 1).otherwise(-1)
    out = df.withColumn("expansion", F.when(_runs(df, False, count, same), side).otherwise(0).cast("long"))
    along = Window.partitionBy("series").orderBy("ts")
    out = out.withColumn("expansion_signal", F.when(F.col("expansion") == 1, F.col("high") + 10 * point).when(F.col("expansion") == -1, F.col("low") - 10 * point))
    out = out.withColumn("__rn", F.row_number().over(along))
    turn = F.coalesce(F.lag("expansion").over(along) != F.col("expansion"), F.lit(True))
    since = F.max(F.when(turn, F.col("__rn"))).over(along.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("expansion_run", F.when(F.col("expansion") == 0, 0).otherwise(F.col("__rn") - since + 1).cast("long")).drop("__rn")


def patterns(df: DataFrame, count: int = 3, same: bool = True, point: float = 0.01) -> DataFrame:
    """``df`` with both patterns."""
    return expansion(contraction(df, count, same), count, same, point)
