"""Checks of a feature column: predictive power, look-ahead, behaviour over regimes."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.ranks import ranked_columns
from .kernel import order, rows

#: Least rows beyond the horizon, and least valid pairs, of an information coefficient.
LEAST = 30


def ahead_return(price: str, ahead: int, log: bool) -> Column:
    """The return over the next ``ahead`` bars; null at a series' end and for prices that aren't positive."""
    later, now = F.lead(price, ahead).over(order()), F.col(price)
    gain = F.log(later / now) if log else later / now - 1
    return F.when((later > 0) & (now > 0), gain)


def correlation(a: str, b: str) -> Column:
    """Pearson's, null where either column doesn't vary."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def information_coefficient(df: DataFrame, feature: str, price: str = "close", ahead: int = 1, log: bool = True, least: int = LEAST) -> DataFrame:
    """(series, n, ic): Spearman correlation of the feature with the return over the next ``ahead`` bars, ties at average rank.

    Nulls and NaN leave their pair out; ``ic`` is null for a series of fewer
    than ``ahead + least`` bars or ``least`` pairs, or without variation.
    """
    if ahead < 1:
        raise ValueError("the horizon is one bar or more")
    sane = lambda c: F.when(~F.isnan(c), c)
    own = df.select("series", "ts", sane(F.col(feature).cast("double")).alias("x"), sane(ahead_return(price, ahead, log)).alias("y"))
    bars = own.groupBy("series").agg(F.count("*").alias("bars"))
    pairs = own.where("x IS NOT NULL AND y IS NOT NULL")
    ranked = ranked_columns(pairs, ["x", "y"], ["series", "ts"], ("series",))
    ic = ranked.groupBy("series").agg(F.count("*").alias("n"), correlation("x", "y").alias("ic")).join(bars, "series", "right")
    enough = (F.col("bars") >= ahead + least) & (F.col("n") >= least)
    return ic.select("series", F.coalesce("n", F.lit(0)).alias("n"), F.when(enough, F.col("ic")).alias("ic"))


def passes(ic: float | None, least: float = 0.03) -> bool:
    return ic is not None and not math.isnan(ic) and ic > least


def require_information(df: DataFrame, feature: str, least: float = 0.03, **how) -> list:
    """The rows of ``information_coefficient``; ValueError names the series that don't exceed ``least``."""
    got = information_coefficient(df, feature, **how).orderBy("series").collect()
    poor = [r.series for r in got if not passes(r.ic, least)]
    if poor:
        raise ValueError(f"information coefficient is not above {least} for {', '.join(map(str, poor))}")
    return got


def look_ahead(bars: DataFrame, make: Callable[[DataFrame], DataFrame], prefixes: int = 100, relative: float = 1e-9, absolute: float = 1e-12) -> DataFrame:
    """(series, column, n_wrong): of the columns that ``make`` adds, the values that change when later bars are cut off.

    Prefixes end at up to ``prefixes`` evenly spaced bars from a series' middle
    on; all are made in one job, each as a series of its own, and compared at
    their last bar with the whole.  Two nulls are equal; a null and a value aren't.
    """
    placed = bars.withColumn("__rn", F.row_number().over(order()))
    size = bars.groupBy("series").agg(F.count("*").alias("__size"))
    ends = size.withColumn("__from", F.greatest(F.expr("__size div 2"), F.lit(1)))
    ends = ends.select("series", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(prefixes - 1)), lambda k: F.expr("__from") + F.floor(k * (F.col("__size") - F.col("__from")) / max(prefixes - 1, 1))))).alias("__end"))
    cut = placed.join(ends, "series").where("__rn <= __end").withColumn("__whole", F.col("series")).withColumn("series", F.concat_ws("#", F.col("series").cast("string"), F.col("__end").cast("string")))
    names = cut.select("series", F.col("__whole").alias("__of"), "__end").distinct()
    made = make(cut.drop("__rn", "__end", "__whole"))
    added = [c for c in made.columns if c not in ("series", "ts")]
    last = made.join(names, "series").join(placed.select(F.col("series").alias("__of"), "ts", "__rn"), ["__of", "ts"]).where("__rn = __end")
    whole = make(bars).select(F.col("series").alias("__of"), "ts", *(F.col(c).alias(f"__{c}") for c in added))
    both = last.join(whole, ["__of", "ts"])

    def wrong(c: str) -> Column:
        a, b = F.col(c).cast("double"), F.col(f"__{c}").cast("double")
        near = F.abs(a - b) <= absolute + relative * F.abs(b)
        return F.sum(F.when(a.isNull() & b.isNull(), 0).otherwise(1 - F.coalesce(near, F.lit(False)).cast("int"))).cast("long")

    sums = both.groupBy(F.col("__of").alias("series")).agg(*(wrong(c).alias(c) for c in added))
    return sums.unpivot(["series"], added, "column", "n_wrong")


def split_by_volatility(bars: DataFrame, q: float = 0.5, window: int = 20) -> DataFrame:
    """``bars`` with atr (mean true range), and volatility: "low" up to the quantile ``q`` of the series' atr, "high" above; null before ``window`` bars."""
    before = F.lag("close").over(order())
    tr = F.when(before.isNull(), F.col("high") - F.col("low")).otherwise(F.greatest("high", before) - F.least("low", before))
    out = bars.withColumn("atr", tr)
    full = F.count("*").over(rows(1 - window)) >= window
    out = out.withColumn("atr", F.when(full, F.avg("atr").over(rows(1 - window))))
    return _split(out, "atr", "volatility", q, "low", "high")


def split_by_trend(bars: DataFrame, q: float = 0.5, window: int = 50) -> DataFrame:
    """``bars`` with slope and trend: "ranging" up to the quantile ``q`` of the absolute slope over the ``window`` bars before, "trending" above; null before.

    The slope is the covariance (of a sample) by the variance (of the whole), as
    it has been defined: the least-squares slope times n / (n - 1).
    """
    out = bars.withColumn("rn", F.row_number().over(order()).cast("double"))
    slope = F.abs(F.regr_slope("close", "rn").over(rows(-window, -1)) * window / (window - 1))
    out = out.withColumn("slope", F.when(F.col("rn") > window, slope)).drop("rn")
    return _split(out, "slope", "trend", q, "ranging", "trending")


def _split(df: DataFrame, value: str, name: str, q: float, low: str, high: str) -> DataFrame:
    if not 0 < q < 1:
        raise ValueError("the quantile lies between 0 and 1")
    edge = df.groupBy("series").agg(F.percentile(value, q).alias("__edge"))
    side = F.when(F.col(value) <= F.col("__edge"), low).when(F.col(value) > F.col("__edge"), high)
    return df.join(edge, "series").withColumn(name, side).drop("__edge")


def robustness(bars: DataFrame, make: Callable[[DataFrame], DataFrame], feature: str, by: str = "volatility", q: float = 0.5, least: float = 0.03, most: float = 0.02, ahead: int = 1) -> DataFrame:
    """(series, n and ic of either side, difference, robust): the feature made anew on each side's bars.

    Robust: both coefficients are at least ``least`` and differ by ``most`` or less.
    """
    cut, sides = (split_by_volatility(bars, q), ("low", "high")) if by == "volatility" else (split_by_trend(bars, q), ("ranging", "trending"))
    out = None
    for side in sides:
        own = cut.where(F.col(by) == side).select(*bars.columns)
        frame = own.select("series", "ts", "close").join(make(own).select("series", "ts", feature), ["series", "ts"])
        ic = information_coefficient(frame, feature, ahead=ahead).select("series", F.col("n").alias(f"n_{side}"), F.col("ic").alias(f"ic_{side}"))
        out = ic if out is None else out.join(ic, "series", "full")
    a, b = (F.col(f"ic_{s}") for s in sides)
    return out.withColumn("difference", F.abs(a - b)).withColumn("robust", F.coalesce((a >= least) & (b >= least) & (F.col("difference") <= most), F.lit(False)))


def walk_forward(bars: DataFrame, folds: int = 5, least: int = LEAST) -> DataFrame:
    """``bars`` once for each fold that uses them, with fold and part: fold k is tested on the k + 1-th of ``folds`` + 1 equal runs of a series and trained on all before."""
    if folds < 1:
        raise ValueError("one fold or more")
    out = bars.withColumn("__rn", F.row_number().over(order()))
    size = bars.groupBy("series").agg(F.count("*").alias("__size")).where(F.col("__size") >= (folds + 1) * least)
    run = F.least(F.expr(f"(__rn - 1) * {folds + 1} div __size"), F.lit(folds))
    out = out.join(size, "series").withColumn("__run", run.cast("int"))
    fold = F.explode(F.sequence(F.greatest(F.col("__run"), F.lit(1)), F.lit(folds)))
    return out.withColumn("fold", fold).withColumn("part", F.when(F.col("__run") == F.col("fold"), "test").otherwise("train")).drop("__rn", "__size", "__run")


def walk_forward_coefficients(bars: DataFrame, make: Callable[[DataFrame], DataFrame], feature: str, folds: int = 5, ahead: int = 1) -> DataFrame:
    """(series, fold, n, ic): the coefficient on each fold's test bars, the feature made from these bars alone."""
    cut = walk_forward(bars, folds).where("part = 'test'")
    cut = cut.withColumn("__of", F.col("series")).withColumn("series", F.concat_ws("#", F.col("series").cast("string"), F.col("fold").cast("string")))
    names = cut.groupBy("series").agg(F.first("__of").alias("__of"), F.first("fold").alias("fold"))
    own = cut.select(*bars.columns)
    frame = own.select("series", "ts", "close").join(make(own).select("series", "ts", feature), ["series", "ts"])
    return information_coefficient(frame, feature, ahead=ahead).join(names, "series").select(F.col("__of").alias("series"), "fold", "n", "ic")
