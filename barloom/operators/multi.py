"""Several intervals: resampling, leak-free as-of alignment, and 40 interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import fresh, from_seconds, seconds
from ..plans.ranks import ranked_columns
from .features import FEATURES, features, flag
from .kernel import order, rows

#: The 40 interactions in their order.
INTERACTIONS = (
    "all_intervals_bullish all_intervals_bearish all_intervals_neutral regime_agreement_count regime_majority regime_unanimity "
    "base_bull_higher_bear base_bear_higher_bull divergence_strength divergence_direction base_extreme_higher_neutral base_neutral_higher_extreme "
    "gradient_up gradient_down rsi_spread_base_mult1 rsi_spread_base_mult2 rsi_spread_mult1_mult2 momentum_direction momentum_magnitude momentum_consistency "
    "any_interval_crossed_overbought all_intervals_crossed_overbought any_interval_crossed_oversold all_intervals_crossed_oversold "
    "base_crossed_while_higher_extreme cascade_crossing_up cascade_crossing_down higher_crossed_first regime_persistence_ratio regime_change_cascade "
    "regime_stability_score bars_since_alignment alignment_duration higher_interval_leads regime_transition_pattern "
    "mean_rsi_across_intervals std_rsi_across_intervals rsi_range_across_intervals rsi_skew_across_intervals interval_momentum_agreement"
).split()
#: The 48 redundant columns that ``prune`` drops by default.
REDUNDANT = (
    "all_intervals_bearish all_intervals_crossed_overbought all_intervals_crossed_oversold all_intervals_neutral cascade_crossing_up gradient_up "
    "bars_since_overbought_mult1 bars_since_oversold_mult2 cascade_crossing_down cross_above_oversold_mult2 "
    "dist_midline_base dist_midline_mult1 dist_midline_mult2 dist_overbought_base dist_overbought_mult1 dist_overbought_mult2 "
    "dist_oversold_base dist_oversold_mult1 dist_oversold_mult2 higher_crossed_first momentum_direction "
    "regime_base regime_bullish_mult1 regime_change_cascade regime_changed_base regime_changed_mult2 regime_mult1 regime_neutral_base regime_neutral_mult1 "
    "regime_persistence_ratio regime_strength_base regime_strength_mult1 regime_strength_mult2 regime_transition_pattern regime_unanimity "
    "rsi_base rsi_mult1 rsi_mult2 rsi_percentile_20_mult1 rsi_range_across_intervals rsi_skew_across_intervals rsi_spread_base_mult2 rsi_spread_mult1_mult2 "
    "rsi_velocity_base rsi_velocity_mult1 rsi_volatility_20_base rsi_zscore_20_base rsi_zscore_20_mult1"
).split()


def resample(bars: DataFrame, m: int, minutes: int) -> DataFrame:
    """Bars of ``m`` times ``minutes``, from midnight of each series' first day; only complete ones, with ``ready``, the last base bar's end."""
    if m < 2:
        raise ValueError("a multiplier is 2 or more")
    width = m * minutes * 60
    at = seconds("ts")
    if 86400 % width == 0:  # every midnight begins a bar, whichever day was the first
        out = bars.withColumn("bar", from_seconds(F.floor(at / width) * width))
    else:
        days = bars.groupBy("series").agg(F.floor(F.min(seconds(F.col("ts"))) / 86400).alias("day"))
        origin = F.col("day") * 86400
        out = bars.join(days, "series").withColumn("bar", from_seconds(origin + F.floor((at - origin) / width) * width))
    out = out.groupBy("series", "bar")
    out = out.agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n"), F.max("ts").alias("last"))
    return out.where(F.col("n") == m).select("series", F.col("bar").alias("ts"), "open", "high", "low", "close", "volume", F.expr(f"last + INTERVAL {minutes} MINUTES").alias("ready"))


def as_of(base: DataFrame, higher: DataFrame, names: list[str], suffix: str, time: str = "ready", strict: bool = True) -> DataFrame:
    """Adds to each base row the latest higher row that was ready before it (``strict``) or by then; null before the first.

    A union and one ordered window: no range join, one shuffle by series.
    """
    side = [F.col(c).alias(f"{c}{suffix}") for c in names]
    value = F.struct(*side).alias("__v")
    left = base.select("*", F.col(time).alias("__t"), F.lit(0 if strict else 1).alias("__o"), F.lit(None).cast(higher.select(value).schema[0].dataType).alias("__v"))
    right = higher.select("series", F.col(time).alias("__t"), F.lit(1 if strict else 0).alias("__o"), value)
    every = left.withColumn("__base", F.lit(True)).unionByName(right, allowMissingColumns=True)
    past = Window.partitionBy("series").orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, 0)
    seen = every.withColumn("__v", F.last("__v", ignorenulls=True).over(past)).where("__base")
    return seen.select(*base.columns, "__v.*")


def as_of_grid(base: DataFrame, higher: DataFrame, names: list[str], suffix: str, at, width: int) -> DataFrame:
    """Adds to each base row the latest higher row that begins by ``at`` seconds, where higher rows begin at multiples of ``width`` seconds.

    Only the higher side, one row for each window, is put in order; base rows
    find theirs by an equality join on (series, window), so a long series isn't
    one task's work and its rows aren't moved if the other side is small.
    """
    key, time = fresh(base, "window", "time")
    base = base.withColumn(key, F.floor(at / width).cast("long"))
    value = F.struct(*(F.col(c).alias(f"{c}{suffix}") for c in names)).alias("__v")
    own = higher.select("series", F.floor(seconds("ts") / width).cast("long").alias(time), value)
    # Windows that base rows ask for, and those that have a bar.
    asked = base.select("series", F.col(key).alias(time)).distinct()
    both = own.join(asked.withColumn("__asked", F.lit(True)), ["series", time], "full")
    past = Window.partitionBy("series").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    told = both.withColumn("__v", F.last("__v", ignorenulls=True).over(past)).where("__asked").select("series", F.col(time).alias(key), "__v")
    names_left = [c for c in base.columns if c != key]
    return base.join(told, ["series", key], "left").select(*names_left, "__v.*")


def redundant(n_features: int = 169) -> list[str]:
    """The names that ``prune`` drops by default; a single interval has none of them."""
    return list(REDUNDANT) if n_features > len(FEATURES) else []


def size_after_pruning(n_features: int) -> int:
    """Columns left of a table of 43 or 169; other sizes stay as they are."""
    whole = 3 * len(FEATURES) + len(INTERACTIONS)
    return whole - len(REDUNDANT) if n_features == whole else n_features


def prune(df: DataFrame, names=REDUNDANT, apply: bool = True) -> DataFrame:
    """``df`` without those of ``names`` that it has."""
    return df.drop(*[c for c in names if c in df.columns]) if apply else df


def correlation_prune(df: DataFrame, columns: list[str], most: float = 0.9, keys: tuple[str, ...] = ("series", "ts")) -> list[str]:
    """The columns to drop so that no two left have an absolute rank correlation above ``most``; the earlier of two stays.

    Ranks are over the whole table, averages over ties; ``keys`` tell rows
    apart.  Nulls leave a row out of that column's pairs.  Only the matrix of
    correlations, columns squared, reaches the driver.
    """
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    if not pairs:
        return []
    got = ranked_columns(df, columns, list(keys)).agg(*((F.covar_samp(a, b) / F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0))).alias(f"c{k}") for k, (a, b) in enumerate(pairs))).first()
    gone: list[str] = []
    for k, (a, b) in enumerate(pairs):
        if a not in gone and b not in gone and got[k] is not None and abs(got[k]) > most:
            gone.append(b)
    return gone


def interactions(df: DataFrame) -> DataFrame:
    """Adds the 40 interactions of columns with the suffixes _base, _mult1 and _mult2.

    All 40 are null until all three intervals are known; counts start there,
    and rows before count as no crossing and no change.
    """
    c = lambda name: [F.col(f"{name}_{k}") for k in ("base", "mult1", "mult2")]
    g, r, chg, ob, os_, moved = c("regime"), c("rsi"), c("rsi_change_1"), c("cross_below_overbought"), c("cross_above_oversold"), c("regime_changed")
    same = (g[0] == g[1]) & (g[1] == g[2])
    pair = (g[0] == g[1]) | (g[1] == g[2]) | (g[0] == g[2])
    every = lambda v: flag((g[0] == v) & (g[1] == v) & (g[2] == v))
    sign = lambda x: F.signum(x).cast("long")
    ago: Column = lambda x, n: F.coalesce(F.lag(x, n).over(order()), F.lit(0))
    lately = lambda x, n: F.coalesce(F.max(x).over(rows(-n, -1)), F.lit(0))
    mean = (r[0] + r[1] + r[2]) / 3
    std = F.sqrt(sum(((x - mean) * (x - mean) for x in r[1:]), (r[0] - mean) * (r[0] - mean)) / 2)
    cascade = flag((moved[0] == 1) & (lately(moved[2], 5) == 1))
    crossed = F.greatest(ob[2], os_[2])
    out = df.withColumns({
        "all_intervals_bullish": every(2), "all_intervals_bearish": every(0), "all_intervals_neutral": every(1),
        "regime_agreement_count": F.when(same, 3).when(pair, 2).otherwise(1).cast("long"),
        "regime_majority": F.when((g[0] == g[1]) | (g[0] == g[2]), g[0]).when(g[1] == g[2], g[1]).otherwise(F.least(*g)),
        "regime_unanimity": flag(same),
        "base_bull_higher_bear": flag((g[0] == 2) & ((g[1] == 0) | (g[2] == 0))), "base_bear_higher_bull": flag((g[0] == 0) & ((g[1] == 2) | (g[2] == 2))),
        "divergence_strength": F.greatest(*r) - F.least(*r), "divergence_direction": sign(r[0] - r[2]),
        "base_extreme_higher_neutral": flag((g[0] != 1) & (g[2] == 1)), "base_neutral_higher_extreme": flag((g[0] == 1) & (g[2] != 1)),
        "gradient_up": flag((r[0] > r[1]) & (r[1] > r[2])), "gradient_down": flag((r[0] < r[1]) & (r[1] < r[2])),
        "rsi_spread_base_mult1": r[0] - r[1], "rsi_spread_base_mult2": r[0] - r[2], "rsi_spread_mult1_mult2": r[1] - r[2],
        "momentum_direction": sign(r[0] - r[2]), "momentum_magnitude": F.abs(r[0] - r[2]), "momentum_consistency": flag(F.signum(chg[0]) == F.signum(chg[2])),
        "any_interval_crossed_overbought": F.greatest(*ob), "all_intervals_crossed_overbought": F.least(*ob),
        "any_interval_crossed_oversold": F.greatest(*os_), "all_intervals_crossed_oversold": F.least(*os_),
        "base_crossed_while_higher_extreme": flag((os_[0] == 1) & (g[2] != 1)),
        "cascade_crossing_up": flag((ago(os_[2], 2) == 1) & (ago(os_[1], 1) == 1) & (os_[0] == 1)), "cascade_crossing_down": flag((ago(ob[2], 2) == 1) & (ago(ob[1], 1) == 1) & (ob[0] == 1)),
        "higher_crossed_first": flag((F.greatest(ob[0], os_[0]) == 1) & (lately(crossed, 10) == 1)),
        "regime_persistence_ratio": F.col("bars_in_regime_base") / F.nullif(F.col("bars_in_regime_mult2"), F.lit(0)),
        "regime_change_cascade": cascade, "regime_stability_score": 1 - (moved[0] + moved[1] + moved[2]) / 3,
        "higher_interval_leads": cascade, "regime_transition_pattern": 4 * g[0] + 2 * g[1] + g[2],
        "mean_rsi_across_intervals": mean, "std_rsi_across_intervals": std, "rsi_range_across_intervals": F.greatest(*r) - F.least(*r),
        "rsi_skew_across_intervals": (r[0] - mean) / F.when(std == 0, 1.0).otherwise(std),
        "interval_momentum_agreement": sum((flag(x > 0) for x in chg[1:]), flag(chg[0] > 0)),
    })
    known = g[0].isNotNull() & g[1].isNotNull() & g[2].isNotNull()
    upto = order().rowsBetween(Window.unboundedPreceding, 0)
    (n,) = fresh(df, "n")
    out = out.withColumn(n, F.sum(known.cast("long")).over(upto))
    last = lambda v: F.coalesce(F.max(F.when(known & (F.col("regime_unanimity") == v), F.col(n))).over(upto), F.lit(0))
    out = out.withColumns({"bars_since_alignment": F.col(n) - last(1), "alignment_duration": F.col(n) - last(0)})
    return out.select(*df.columns, *(F.when(known, F.col(c)).alias(c) for c in INTERACTIONS))


ALIGNMENTS = ("availability", "label", "positional")


def align(base: DataFrame, higher: DataFrame, names: list[str], suffix: str, how: str = "availability", clamp_first: bool = False, width: int | None = None) -> DataFrame:
    """Adds to each base row a row of the higher interval.

    ``availability``: the latest that was ready before the base row's own end
    (no look-ahead).  ``label``: the latest whose window began by the base
    row's start; its values are those of the whole window, so they look ahead.
    ``positional``: base row i takes higher row i, and the last one beyond; that
    looks ahead too, and exists for parity only.  Rows before the first match
    are null or, with ``clamp_first``, take the first higher row.  ``width``,
    the seconds of a higher bar, spares an ordered pass over the base rows where
    days are made of whole windows.
    """
    if how not in ALIGNMENTS:
        raise ValueError(f"alignment is one of {', '.join(ALIGNMENTS)}")
    grid = width is not None and 86400 % width == 0
    if how == "availability":
        # A window that ended before the row's end began more than a width before it.
        out = as_of_grid(base, higher, names, suffix, seconds("ready") - width - 1, width) if grid else as_of(base, higher, names, suffix)
    elif how == "label" and grid:
        out = as_of_grid(base, higher, names, suffix, seconds("ts"), width)
    elif how == "label":
        out = as_of(base, higher, names, suffix, time="ts", strict=False)
    else:
        (at,) = fresh(base, "at")
        place = lambda df: df.withColumn(at, F.row_number().over(order()))
        out = as_of(place(base), place(higher), names, suffix, time=at, strict=False).drop(at)
    if not clamp_first:
        return out
    first = higher.groupBy("series").agg(F.min_by(F.struct(*names), "ts").alias("first"))
    values = [F.coalesce(F.col(f"{c}{suffix}"), F.col(f"first.{c}")).alias(f"{c}{suffix}") for c in names]
    return out.join(first, "series", "left").select(*base.columns, *values)


def least_rows(period: int = 14, smoothing: int = 5, window: int = 20, multiplier: int = 1) -> int:
    """Base bars that a series needs; ``smoothing`` counts here only, no value depends on it."""
    return (max(period, smoothing, window) + 10) * multiplier


def check_multipliers(m1: int, m2: int) -> None:
    if not all(isinstance(m, int) and m >= 2 for m in (m1, m2)) or m1 >= m2:
        raise ValueError("multipliers must be whole numbers with 2 <= m1 < m2")


def check_higher_bars(higher: DataFrame, least: int = 30) -> None:
    """ValueError names a series with fewer than ``least`` complete higher bars."""
    few = higher.groupBy("series").count().where(F.col("count") < least).orderBy("series").first()
    if few is not None:
        raise ValueError(f"series {few.series} has {few['count']} complete higher bars; {least} are needed")


def extract(bars: DataFrame, minutes: int, extractor, names: list[str], m1: int = 4, m2: int = 12, how: str = "availability", clamp_first: bool = False) -> DataFrame:
    """``extractor`` (bars and their width in minutes to a frame of series, ts and ``names``) on the base bars and on both higher intervals, side by side."""
    check_multipliers(m1, m2)
    base = extractor(bars, minutes).withColumn("ready", F.expr(f"ts + INTERVAL {minutes} MINUTES"))
    out = base.select("series", "ts", "ready", *(F.col(c).alias(f"{c}_base") for c in names))
    for m, name in ((m1, "mult1"), (m2, "mult2")):
        # What a bar's features know, they know when its window ends.
        own = extractor(resample(bars, m, minutes), m * minutes).withColumn("ready", F.expr(f"ts + INTERVAL {m * minutes} MINUTES"))
        out = align(out, own, names, f"_{name}", how, clamp_first, m * minutes * 60)
    return out


def multi_features(bars: DataFrame, minutes: int, m1: int = 4, m2: int = 12, period: int = 14, how: str = "availability", clamp_first: bool = False) -> DataFrame:
    """(series, ts) and 3 x 43 + 40 columns; by default a base bar sees only higher bars that ended before its own end."""
    return interactions(extract(bars, minutes, lambda b, width: features(b, period, minutes=width), FEATURES, m1, m2, how, clamp_first)).drop("ready")
