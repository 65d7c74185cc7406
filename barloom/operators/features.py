"""The 43 single-interval features of an indicator frame (see ``kernel.indicator``)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.averages import add_recursive
from ..plans.scan import scan
from ..plans.slices import deal
from .kernel import indicator, order, ranks_of, reach, rows, settled

#: The output's columns in their order.
FEATURES = (
    "rsi regime regime_bearish regime_neutral regime_bullish regime_changed bars_in_regime regime_strength "
    "dist_overbought dist_oversold dist_midline abs_dist_overbought abs_dist_oversold "
    "cross_above_oversold cross_below_overbought cross_above_midline cross_below_midline "
    "bars_since_oversold bars_since_overbought bars_since_extreme rsi_change_1 rsi_change_5 rsi_velocity "
    "rsi_percentile_20 rsi_zscore_20 rsi_volatility_20 rsi_range_20 "
    "rsi_shock_1bar extreme_regime_persistence rsi_volatility_spike tail_risk_score "
    "adaptive_coeff adaptive_coeff_roc_1 gamma_value gamma_spread laguerre_spread laguerre_mid_convergence laguerre_slope "
    "atr_range_width efficiency_ratio efficiency_trend cycle_phase cycle_phase_changed"
).split()


def back(name: str, n: int = 1) -> Column:
    """The value n bars ago, or the series' first."""
    return F.coalesce(F.lag(name, n).over(order()), F.first(name).over(order().rowsBetween(Window.unboundedPreceding, 0)))


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("long")


def one_if_zero(c: Column) -> Column:
    return F.when(c.isNull() | (c == 0), 1.0).otherwise(c)


def average_reach(span: int) -> int:
    """Bars after which the weight of what lies further back in an average of ``span`` is below 1e-15."""
    rest = 1 - 2 / (span + 1)
    return math.ceil(math.log(1e-15) / math.log(rest)) if rest else 1


def look_back(df: DataFrame, up: float = 0.85, down: float = 0.15, window: int = 20) -> DataFrame:
    """An indicator frame (of the same ``window``) with all features but those that count bars, and the numbers of the last bars of their events."""
    if not 0 < down < up < 1 or window < 1:
        raise ValueError("levels must satisfy 0 < down < up < 1 and windows be positive")
    r, w = F.col("rsi"), rows(1 - window)
    own = F.col("own") if "own" in df.columns else F.lit(True)
    base = F.col("base") if "base" in df.columns else F.lit(0)
    upto = order().rowsBetween(Window.unboundedPreceding, 0)
    # In a slice, bars are numbered as in the whole series, and events count on the slice's own bars only.
    x = df.withColumn("rn", base + F.sum(own.cast("long")).over(upto)).withColumn("regime", F.when(r < down, 0).when(r > up, 2).otherwise(1).cast("long"))
    was = back("rsi")
    gap = lambda a, b: settled(F.col(a), F.col(b))
    latest = lambda c: F.max(F.when(c & own, F.col("rn"))).over(upto)
    x = x.withColumns({
        "regime_bearish": flag(F.col("regime") == 0), "regime_neutral": flag(F.col("regime") == 1), "regime_bullish": flag(F.col("regime") == 2),
        "regime_changed": flag(F.col("regime") != back("regime")),
        "regime_strength": F.when(r > up, r - up).when(r < down, down - r).otherwise(0.0),
        "dist_overbought": r - up, "dist_oversold": r - down, "dist_midline": r - 0.5,
        "abs_dist_overbought": F.abs(r - up), "abs_dist_oversold": F.abs(r - down),
        "cross_above_oversold": flag((was <= down) & (r > down)), "cross_below_overbought": flag((was >= up) & (r < up)),
        "cross_above_midline": flag((was <= 0.5) & (r > 0.5)), "cross_below_midline": flag((was >= 0.5) & (r < 0.5)),
        "at_oversold": latest(r < down), "at_overbought": latest(r > up),
        "rsi_change_1": r - was, "rsi_change_5": r - back("rsi", 5),
        "rsi_percentile_20": F.col("rsi_percentile"),
        "mean": F.avg("rsi").over(w), "rsi_volatility_20": F.coalesce(F.stddev_samp("rsi").over(w), F.lit(0.0)),
        "rsi_range_20": F.max("rsi").over(w) - F.min("rsi").over(w),
        "adaptive_coeff_roc_1": F.col("adaptive_coeff") - back("adaptive_coeff"), "gamma_value": F.col("gamma"), "gamma_spread": F.col("gamma") - F.avg("gamma").over(w),
        "laguerre_spread": (F.col("l0") - F.col("l3")) / (F.abs("l0") + F.abs("l3") + 1e-10),
        "laguerre_mid_convergence": F.abs(gap("l1", "l2")) / (F.abs(gap("l0", "l1")) + F.abs(gap("l2", "l3")) + 1e-10),
        "dl0": settled(F.col("l0"), back("l0")), "dc": F.abs(F.col("close") - back("close")), "far": F.abs(F.col("close") - back("close", 20)),
        "atr_range_width": (F.col("max_atr") - F.col("min_atr")) / (F.col("max_atr") + 1e-10),
        "cycle_phase": F.when((gap("l0", "l1") > 0) & (gap("l2", "l3") > 0), 2).when(gap("l0", "l1") > 0, 1).when(gap("l2", "l3") > 0, 3).otherwise(0).cast("long"),
    })
    hundred = rows(-99)
    path = F.sum("dc").over(w)
    x = x.withColumns({
        "at_change": latest(F.col("regime_changed") == 1),
        "rsi_zscore_20": (r - F.col("mean")) / one_if_zero(F.col("rsi_volatility_20")),
        "rsi_shock_1bar": flag(F.abs("rsi_change_1") > 0.3),
        "rsi_volatility_spike": flag((F.count("rsi_volatility_20").over(hundred) >= 20) & (F.col("rsi_volatility_20") > F.avg("rsi_volatility_20").over(hundred) + 2 * F.stddev_samp("rsi_volatility_20").over(hundred))),
        "laguerre_slope": F.col("dl0") / one_if_zero(F.stddev_samp("dl0").over(w)),
        "efficiency_ratio": F.least(F.greatest(F.col("far") / one_if_zero(path), F.lit(0.0)), F.lit(1.0)),
        "cycle_phase_changed": flag(F.col("cycle_phase") != back("cycle_phase")),
    })
    return x.withColumn("efficiency_trend", flag(F.col("efficiency_ratio") > 0.5))


#: Bytes of bars, as planned, whose series stay whole.
WHOLE = 256 << 20
EVENTS = ("at_oversold", "at_overbought", "at_change")


def count_bars(x: DataFrame) -> DataFrame:
    """(series, ts, the 43 features): what counts bars since an event, and what follows from it."""
    x = x.withColumns({
        "bars_since_oversold": F.col("rn") - F.coalesce("at_oversold", F.lit(0)), "bars_since_overbought": F.col("rn") - F.coalesce("at_overbought", F.lit(0)),
        "bars_in_regime": F.col("rn") - F.coalesce("at_change", F.lit(1)) + 1,
    })
    x = x.withColumns({"bars_since_extreme": F.least("bars_since_oversold", "bars_since_overbought"), "extreme_regime_persistence": flag((F.col("regime") != 1) & (F.col("bars_in_regime") > 10))})
    risk = 0.4 * F.col("rsi_shock_1bar") + 0.3 * F.col("extreme_regime_persistence") + 0.3 * F.col("rsi_volatility_spike")
    return x.withColumn("tail_risk_score", F.least(F.greatest(risk, F.lit(0.0)), F.lit(1.0))).select("series", "ts", *FEATURES)


def expand(df: DataFrame, up: float = 0.85, down: float = 0.15, window: int = 20, span: int = 5) -> DataFrame:
    """(series, ts, the 43 features) of an indicator frame; of one made with another span than 5, the same ``span``."""
    if span < 1:
        raise ValueError("a span is one bar or more")
    if window != 20:
        df = scan(df, "__rank", lambda: lambda x, of=ranks_of(window): (of(x),), ["rsi"], {"v": "double"}).withColumn("rsi_percentile", F.col("__rank.v")).drop("__rank")
    if span != 5:
        df = add_recursive(df, "rsi_velocity", F.col("rsi") - back("rsi"), 2 / (span + 1), "first", 1)
    return count_bars(look_back(df, up, down, window))


def halo(period: int = 14, offset: float = 0.75, window: int = 20, span: int = 5) -> int:
    """Bars before a slice on which its values depend."""
    return period + reach(period, offset) + max(average_reach(span), 100 + window) + 1


def features(bars: DataFrame, period: int = 14, offset: float = 0.75, up: float = 0.85, down: float = 0.15, window: int = 20, span: int = 5, minutes: int | None = None, per: int | None = None) -> DataFrame:
    """(series, ts, the 43 features) of bars.

    With ``minutes``, the bars' width, long series are cut into slices of ``per``
    bars, each a task's work: within a slice, values equal those of the whole
    series to about 1e-15, and bars since an event beyond it come from a table
    with a row for each slice.  Without ``per``, that is done (with 16384) where
    the planner takes the bars for more than ``WHOLE`` bytes.
    """
    if minutes is not None and per is None:
        size = int(bars._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        per = 16384 if WHOLE < size < 1 << 62 else None  # a size beyond is unknown
    if minutes is None or per is None:
        return count_bars(look_back(indicator(bars, period, offset, span, window), up, down, window))
    x = look_back(indicator(deal(bars, minutes, halo(period, offset, window, span), per), period, offset, span, window), up, down, window).where("own")
    key = [F.col("series.series").alias("of"), F.col("series.slice").alias("slice")]
    ends = x.groupBy("series").agg(*(F.max(c).alias(c) for c in EVENTS)).select(*key, *EVENTS)
    before = Window.partitionBy("of").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.struct(F.col("of").alias("series"), "slice").alias("series"), *(F.max(c).over(before).alias(f"{c}_before") for c in EVENTS))
    x = x.join(ends, "series").withColumns({c: F.coalesce(c, f"{c}_before") for c in EVENTS})
    return count_bars(x.withColumn("series", F.col("series.series")))
