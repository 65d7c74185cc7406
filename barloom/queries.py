"""Registered queries of the feature engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import oracle as O
from .functions import averages
from .operators import classic, features, kernel, multi, validation, zigzag
from .operators.features import FEATURES
from .operators.multi import INTERACTIONS, REDUNDANT
from .plans import engine
from .sources import events, feeds

MINUTES = 60


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.bars(spark.read.parquet(f"{sf_dir}/events.parquet"), MINUTES)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields))


def _volatility(b: DataFrame) -> DataFrame:
    return kernel.volatility(b).select("series", "ts", "tr", "atr", "min_atr", "max_atr", "adaptive_coeff", "gamma")


def _oscillator(b: DataFrame) -> DataFrame:
    return kernel.indicator(b).select("series", "ts", "l0", "l1", "l2", "l3", "rsi")


def _rsi(b: DataFrame) -> DataFrame:
    return kernel.indicator(b).select("series", "ts", "rsi")


def _sliced(b: DataFrame) -> DataFrame:
    """The same 43 columns by slices of 256 bars: what long series take."""
    return features.features(b, minutes=MINUTES, per=256)


def _aligned(b: DataFrame, how: str, clamp_first: bool = False) -> DataFrame:
    names = ["rsi", "regime"]
    out = multi.extract(b, MINUTES, lambda x, width: features.features(x, minutes=width).select("series", "ts", *names), names, 4, 12, how, clamp_first)
    return out.drop("ready")


def _prices(b: DataFrame) -> DataFrame:
    return b.select("series", "ts", *(averages.applied_price(p).alias(p) for p in averages.PRICES))


def _averages(b: DataFrame) -> DataFrame:
    for name, method in (("sma", "simple"), ("ema", "exponential"), ("lwma", "weighted"), ("smma", "smoothed")):
        b = averages.add_average(b, name, method, 10)
    return b.select("series", "ts", "sma", "ema", "lwma", "smma")


def _framework(b: DataFrame) -> DataFrame:
    for name, method in (("sma", "simple"), ("ema", "exponential"), ("lwma", "weighted"), ("smma", "smoothed")):
        b = averages.add_framework_average(b, name, method, 10)
    return b.select("series", "ts", "sma", "ema", "lwma", "smma")


def _zigzag(b: DataFrame) -> DataFrame:
    return zigzag.zigzag(b, 12, 0.05, 3)


def _broken(b: DataFrame) -> DataFrame:
    """The rules that bars break whose high is their close."""
    return events.violations(b.withColumn("high", F.col("close")))


def _pruned(b: DataFrame) -> DataFrame:
    return multi.prune(multi.multi_features(b, MINUTES))


def _redundant(b: DataFrame) -> DataFrame:
    """The columns of the 43 that correlate with an earlier one, for the whole table."""
    x = features.features(b)
    gone = multi.correlation_prune(x, ["rsi", "dist_midline", "rsi_change_1", "abs_dist_overbought", "gamma_value", "adaptive_coeff"])
    return x.sparkSession.createDataFrame([(c,) for c in gone], "name string")


def _look_ahead(b: DataFrame) -> DataFrame:
    names = ["rsi", "regime", "bars_in_regime", "rsi_velocity", "efficiency_ratio"]
    return validation.look_ahead(b, lambda x: features.features(x).select("series", "ts", *names), prefixes=10)


ON_BARS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "bars": lambda b: b,
    "resample": lambda b: multi.resample(b, 4, MINUTES),
    "volatility": _volatility,
    "oscillator": _oscillator,
    "fixed_period": lambda b: kernel.fixed_period(b, 32.0).select("series", "ts", "l0", "l1", "l2", "l3", "rsi"),
    "features": lambda b: features.features(b, minutes=MINUTES),
    "features_sliced": _sliced,
    "multi_features": lambda b: multi.multi_features(b, MINUTES),
    "pruned_features": _pruned,
    "single_feature": lambda b: engine.compute_feature(b, "rsi_zscore_20"),
    "compute_indicator": lambda b: engine.make_indicator(period=20, offset=0.5)(b),
    "align_label": lambda b: _aligned(b, "label"),
    "align_positional": lambda b: _aligned(b, "positional"),
    "align_clamped": lambda b: _aligned(b, "availability", True),
    "information_coefficient": lambda b: validation.information_coefficient(kernel.indicator(b), "rsi"),
    "ic_simple_return": lambda b: validation.information_coefficient(kernel.indicator(b), "rsi", ahead=5, log=False),
    "look_ahead": _look_ahead,
    "split_volatility": lambda b: validation.split_by_volatility(b).select("series", "ts", "atr", "volatility"),
    "split_trend": lambda b: validation.split_by_trend(b).select("series", "ts", "slope", "trend"),
    "robustness_volatility": lambda b: validation.robustness(b, _rsi, "rsi", "volatility"),
    "robustness_trend": lambda b: validation.robustness(b, _rsi, "rsi", "trend"),
    "walk_forward": lambda b: validation.walk_forward_coefficients(b, _rsi, "rsi"),
    "correlation_prune": _redundant,
    "range_bars": lambda b: feeds.enrich_range_bars(b, dict(feeds.RANGE_SETUP)).select("series", "ts", *feeds.RANGE_COLUMNS),
    "session_flags": lambda b: feeds.session_flags(b).select("series", "ts", *feeds.SESSIONS),
    "violations": _broken,
    "applied_prices": _prices,
    "moving_averages": _averages,
    "framework_averages": _framework,
    "fast_and_slow": lambda b: averages.fast_and_slow(b, "exponential").select("series", "ts", "fast", "slow"),
    "volume_average": lambda b: averages.volume_average(b).select("series", "ts", "volume_ema", "volume_class"),
    "bollinger_width": lambda b: averages.bollinger_width(b).select("series", "ts", "bb_width", "bb_change", "bb_class"),
    "bollinger_delta": lambda b: averages.bollinger_delta(b).select("series", "ts", "bb_delta", "bb_delta_class"),
    "patterns": lambda b: averages.patterns(b).select("series", "ts", "contraction", "expansion", "expansion_signal", "expansion_run"),
    "classic_rsi": lambda b: classic.classic_rsi(b).select("series", "ts", "rsi", "level"),
    "classic_rsi_minutes": lambda b: classic.classic_rsi_of_minutes(b, 300).select("series", "ts", "rsi_bar"),
    "minute_bars": lambda b: classic.minute_bars(b, 300),
    "week_bars": lambda b: classic.minute_bars(b, 2400, week=True),
    "map_to_chart": lambda b: classic.map_to_chart(b.select("series", "ts", "close"), classic.minute_bars(b, 300), ["open", "volume"]),
    "zigzag": lambda b: _zigzag(b).select("series", "ts", "peak", "bottom"),
    "zigzag_confirmed": lambda b: zigzag.confirmed(_zigzag(b)),
    "zigzag_not_repainted": lambda b: zigzag.not_repainted(_zigzag(b)).select("series", "ts", "peak", "bottom"),
    "zigzag_alerts": lambda b: zigzag.alerts(_zigzag(b)),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda s, d, f=f: _rounded(f(_bars(s, d)))) for name, f in ON_BARS.items()}


#: The features that are doubles; the others are whole numbers.
DOUBLES = {
    "rsi", "regime_strength", "dist_overbought", "dist_oversold", "dist_midline", "abs_dist_overbought", "abs_dist_oversold", "rsi_change_1", "rsi_change_5", "rsi_velocity",
    "rsi_percentile_20", "rsi_zscore_20", "rsi_volatility_20", "rsi_range_20", "tail_risk_score", "adaptive_coeff", "adaptive_coeff_roc_1", "gamma_value", "gamma_spread",
    "laguerre_spread", "laguerre_mid_convergence", "laguerre_slope", "atr_range_width", "efficiency_ratio",
}
MULTI_DOUBLES = {f"{c}_{k}" for c in DOUBLES for k in ("base", "mult1", "mult2")} | {
    "divergence_strength", "rsi_spread_base_mult1", "rsi_spread_base_mult2", "rsi_spread_mult1_mult2", "momentum_magnitude", "regime_persistence_ratio", "regime_stability_score",
    "mean_rsi_across_intervals", "std_rsi_across_intervals", "rsi_range_across_intervals", "rsi_skew_across_intervals",
}


def oracle_sql() -> dict[str, str]:
    r = lambda *names: ", ".join(f"round({c}, 6) AS {c}" for c in names)
    window = lambda n, end="CURRENT ROW": f"(PARTITION BY series ORDER BY ts ROWS BETWEEN {n} PRECEDING AND {end})"
    whole = [f"{c}_{k}" for k in ("base", "mult1", "mult2") for c in FEATURES] + list(INTERACTIONS)
    every = f"WITH RECURSIVE {O.multi(list(FEATURES))}, {O.interactions()} "
    single = f"WITH RECURSIVE {O.BARS}, {O.interval('b', 'x')} "
    pair = ["rsi", "regime"]
    six = ", ".join(f"{f'round({c}, 6)' if c in DOUBLES else c} AS {name}" for name, c in feeds.RANGE_COLUMNS.items())
    aligned = ", ".join(f"round(rsi_{k}, 6) AS rsi_{k}, regime_{k}" for k in ("base", "mult1", "mult2"))
    sides = f"""SELECT m.series, m.ts, round(rsi_base, 6) AS rsi_base, regime_base,
        {', '.join(f"round(coalesce(rsi_{k}, f{n}.r), 6) AS rsi_{k}, coalesce(regime_{k}, f{n}.g) AS regime_{k}" for n, k in ((1, 'mult1'), (2, 'mult2')))}
        FROM m JOIN (SELECT series, arg_min(rsi_mult1, ts) AS r, arg_min(regime_mult1, ts) AS g FROM h1 GROUP BY series) f1 ON m.series = f1.series
        JOIN (SELECT series, arg_min(rsi_mult2, ts) AS r, arg_min(regime_mult2, ts) AS g FROM h2 GROUP BY series) f2 ON m.series = f2.series"""
    rising = "close > open"
    bodies = "abs(close - open) AS body, close > open AS rises"
    pattern = lambda op: f"coalesce(body {op} lag(body) OVER w AND lag(body) OVER w {op} lag(body, 2) OVER w AND rises = lag(rises) OVER w AND rises = lag(rises, 2) OVER w, false)"
    bucket = lambda n, unit: f"time_bucket(INTERVAL {n} MINUTE, ts, date_trunc('{unit}', ts))"
    grouped = lambda n, unit: f"SELECT series, {bucket(n, unit)} AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM b GROUP BY series, {bucket(n, unit)}"
    local = {"nyse": ("America/New_York", "BETWEEN 570 AND 959"), "lse": ("Europe/London", "BETWEEN 480 AND 989"), "xtks": ("Asia/Tokyo", "BETWEEN 540 AND 899 AND NOT m BETWEEN 690 AND 749")}
    session = ", ".join(
        f"(SELECT (m {hours} AND d BETWEEN 1 AND 5)::INT FROM (SELECT extract(hour FROM t) * 60 + extract(minute FROM t) AS m, extract(dow FROM t) AS d FROM (SELECT ts AT TIME ZONE 'UTC' AT TIME ZONE '{zone}' AS t))) AS is_{name}_session"
        for name, (zone, hours) in local.items()
    )
    thirds = lambda x: f"CASE WHEN len({x}) >= 3 THEN [{x}[len({x}) // 3 + 1], {x}[2 * len({x}) // 3 + 1]] ELSE [{x}[1] / 2, {x}[1] / 2] END"
    return {
        "bars": f"WITH {O.BARS} SELECT series, ts, {r('open', 'high', 'low', 'close')}, volume FROM b",
        "resample": f"WITH {O.BARS}, {O.resample('b', 'x', 4)} SELECT series, ts, {r('open', 'high', 'low', 'close')}, volume, ready FROM x",
        "volatility": f"WITH {O.BARS}, {O.volatility()} SELECT series, ts, {r('tr', 'atr', 'min_atr', 'max_atr', 'adaptive_coeff', 'gamma')} FROM v",
        "oscillator": f"WITH RECURSIVE {O.BARS}, {O.volatility()}, {O.stages()} SELECT series, ts, {r('l0', 'l1', 'l2', 'l3', 'rsi')} FROM o",
        "fixed_period": f"WITH RECURSIVE {O.BARS}, c AS (SELECT series, ts, close, row_number() OVER w AS rn, 1 - 10 / 41.0::DOUBLE AS gamma FROM b {O.ALONG}), {O.stages('c', 'o', seeded=True)} SELECT series, ts, {r('l0', 'l1', 'l2', 'l3', 'rsi')} FROM o",
        "features": single + O.rounded(FEATURES, "x", DOUBLES),
        "features_sliced": single + O.rounded(FEATURES, "x", DOUBLES),
        "multi_features": every + O.rounded(whole, "i", MULTI_DOUBLES),
        "pruned_features": every + O.rounded([c for c in whole if c not in REDUNDANT], "i", MULTI_DOUBLES),
        "single_feature": f"{single} SELECT series, ts, round(rsi_zscore_20, 6) AS rsi_zscore_20 FROM x",
        "compute_indicator": f"WITH RECURSIVE {O.BARS}, {O.volatility('b', 'v', 20, 0.5)}, {O.stages()} SELECT series, ts, round(rsi, 6) AS rsi FROM o",
        "align_label": f"WITH RECURSIVE {O.multi(pair, match='l.ts >= h.ts')} SELECT series, ts, {aligned} FROM m",
        "align_positional": f"WITH RECURSIVE {O.multi(pair, match='l.rn >= h.rn')} SELECT series, ts, {aligned} FROM m",
        "align_clamped": f"WITH RECURSIVE {O.multi(pair)} {sides}",
        "information_coefficient": f"WITH RECURSIVE {O.BARS}, {O.oscillator('b', 'x')}, {O.coefficient('x', 'c')} SELECT series, n, round(ic, 6) AS ic FROM c",
        "ic_simple_return": f"WITH RECURSIVE {O.BARS}, {O.oscillator('b', 'x')}, {O.coefficient('x', 'c', ahead=5, log=False)} SELECT series, n, round(ic, 6) AS ic FROM c",
        "look_ahead": f"WITH {O.BARS} SELECT DISTINCT series, c AS \"column\", 0::BIGINT AS n_wrong FROM b, (SELECT unnest(['rsi', 'regime', 'bars_in_regime', 'rsi_velocity', 'efficiency_ratio']) AS c)",
        "split_volatility": f"WITH {O.BARS}, {O.BY_VOLATILITY} SELECT series, ts, round(atr, 6) AS atr, volatility FROM split",
        "split_trend": f"WITH {O.BARS}, {O.BY_TREND} SELECT series, ts, round(slope, 6) AS slope, trend FROM split",
        "robustness_volatility": O.robustness(O.BY_VOLATILITY, "volatility", ("low", "high")),
        "robustness_trend": O.robustness(O.BY_TREND, "trend", ("ranging", "trending")),
        "walk_forward": f"WITH RECURSIVE {O.BARS}, {O.WALK} SELECT split_part(series, '#', 1) AS series, split_part(series, '#', 2)::INT AS fold, n, round(ic, 6) AS ic FROM c4",
        "range_bars": f"WITH RECURSIVE {O.BARS}, {O.volatility('b', 'v', 14, 0.5)}, {O.stages()}, {O.features('v', 'o', 'x', 0.75, 0.1)} SELECT series, ts, {six} FROM x",
        "session_flags": f"WITH {O.BARS} SELECT series, ts, {session} FROM b",
        "violations": f"""WITH {O.BARS}, c AS (SELECT * REPLACE (close AS high), lag(ts) OVER w AS was FROM b {O.ALONG})
            SELECT series, ts, unnest(list_filter([CASE WHEN high < open THEN 'high_open' END, CASE WHEN high < low THEN 'high_low' END, CASE WHEN low > open THEN 'low_open' END,
                CASE WHEN low > close THEN 'low_close' END, CASE WHEN least(open, high, low, close) <= 0 THEN 'positive' END, CASE WHEN volume < 0 THEN 'volume' END, CASE WHEN ts <= was THEN 'increasing' END],
                lambda z: z IS NOT NULL)) AS rule FROM c""",
        "applied_prices": f"WITH {O.BARS} SELECT series, ts, {r('open', 'high', 'low', 'close')}, round((high + low) / 2, 6) AS median, round((high + low + close) / 3, 6) AS typical, round((high + low + 2 * close) / 4, 6) AS weighted FROM b",
        "moving_averages": f"""WITH {O.BARS}, c AS (SELECT *, list(close) OVER w AS l, row_number() OVER w AS rn, avg(close) OVER t AS mean FROM b WINDOW w AS (PARTITION BY series ORDER BY ts), t AS {window(9)})
            SELECT series, ts, CASE WHEN rn >= 10 THEN round(mean, 6) END AS sma, round(list_reduce(l, lambda a, z: a + 2 / 11 * (z - a)), 6) AS ema,
                   CASE WHEN rn >= 10 THEN round(list_sum(list_transform(range(1, 11), lambda k: k * l[rn - 10 + k])) / 55, 6) END AS lwma, round({O.begun_with_mean('l', 0.1, 10)}, 6) AS smma FROM c""",
        "framework_averages": f"""WITH {O.BARS}, c AS (SELECT *, list(close) OVER w AS l, row_number() OVER w AS rn, avg(close) OVER t AS mean FROM b WINDOW w AS (PARTITION BY series ORDER BY ts), t AS {window(9)})
            SELECT series, ts, CASE WHEN rn >= 10 THEN round(mean, 6) END AS sma, round(list_reduce(l, lambda a, z: a + 2 / 11 * (z - a)), 6) AS ema,
                   CASE WHEN rn >= 10 THEN round(list_sum(list_transform(range(1, 11), lambda k: k * l[rn - 10 + k])) / 55, 6) END AS lwma, round(list_reduce(l, lambda a, z: a + 0.1 * (z - a)), 6) AS smma FROM c""",
        "fast_and_slow": f"WITH {O.BARS}, c AS (SELECT *, list(close) OVER w AS l FROM b {O.ALONG}) SELECT series, ts, round(list_reduce(l, lambda a, z: a + 2 / 13 * (z - a)), 6) AS fast, round(list_reduce(l, lambda a, z: a + 2 / 49 * (z - a)), 6) AS slow FROM c",
        "volume_average": f"""WITH {O.BARS}, c AS (SELECT *, list(volume) OVER w AS l, volume - lag(volume) OVER w AS change FROM b {O.ALONG})
            SELECT series, ts, round({O.begun_with_mean('l', 2 / 15, 14)}, 6) AS volume_ema, CASE WHEN change > 0 THEN 0 WHEN change < 0 THEN 1 ELSE 2 END::BIGINT AS volume_class FROM c""",
        "bollinger_width": f"""WITH {O.BARS}, c AS (SELECT *, CASE WHEN count(*) OVER t >= 20 THEN 4 * stddev_pop(close) OVER t END AS width FROM b WINDOW t AS {window(19)}),
            d AS (SELECT *, CASE WHEN lag(width) OVER w IS NULL OR lag(width) OVER w = 0 THEN 0 ELSE (width - lag(width) OVER w) / lag(width) OVER w * 100 END AS change FROM c {O.ALONG}),
            e AS (SELECT *, list(change) OVER t AS l FROM d WINDOW t AS {window(998)}),
            f AS (SELECT *, list_reverse_sort(list_filter(l, lambda z: z > 0)[-123:]) AS ups, list_reverse_sort(list_transform(list_filter(l, lambda z: z < 0)[-123:], lambda z: -z)) AS downs FROM e),
            g AS (SELECT *, CASE WHEN change > 0 THEN {thirds('ups')} ELSE {thirds('downs')} END AS edge FROM f)
            SELECT series, ts, round(width, 6) AS bb_width, round(change, 6) AS bb_change,
                   CASE WHEN abs(change) < 1e-4 THEN 0 ELSE CASE WHEN abs(change) > edge[1] THEN 3 WHEN abs(change) > edge[2] THEN 2 ELSE 1 END + CASE WHEN change < 0 THEN 3 ELSE 0 END END::BIGINT AS bb_class FROM g""",
        "bollinger_delta": f"""WITH {O.BARS}, c AS (SELECT *, CASE WHEN count(*) OVER t >= 20 THEN 4 * stddev_pop(close) OVER t / avg(close) OVER t END AS width FROM b WINDOW t AS {window(19)}),
            d AS (SELECT *, (width - lag(width, 19) OVER w) / 0.01 AS delta FROM c {O.ALONG})
            SELECT series, ts, round(delta, 6) AS bb_delta, CASE WHEN delta > lag(delta) OVER w THEN 0 WHEN delta < lag(delta) OVER w THEN 1 ELSE 2 END::BIGINT AS bb_delta_class FROM d {O.ALONG}""",
        "patterns": f"""WITH {O.BARS}, c AS (SELECT *, {bodies} FROM b),
            d AS (SELECT *, CASE WHEN {pattern('<')} THEN CASE WHEN {rising} THEN 1 ELSE -1 END ELSE 0 END::BIGINT AS contraction, CASE WHEN {pattern('>')} THEN CASE WHEN {rising} THEN 1 ELSE -1 END ELSE 0 END::BIGINT AS expansion, row_number() OVER w AS rn FROM c {O.ALONG}),
            e AS (SELECT *, rn - row_number() OVER (PARTITION BY series, expansion ORDER BY ts) AS island FROM d)
            SELECT series, ts, contraction, expansion, round(CASE expansion WHEN 1 THEN high + 0.1 WHEN -1 THEN low - 0.1 END, 6) AS expansion_signal,
                   CASE WHEN expansion = 0 THEN 0 ELSE row_number() OVER (PARTITION BY series, expansion, island ORDER BY ts) END::BIGINT AS expansion_run FROM e""",
        "classic_rsi": f"WITH RECURSIVE {O.BARS}, {O.classic('b', 'k')} SELECT series, ts, round(rsi, 6) AS rsi, CASE WHEN rsi > 0.85 THEN 1 WHEN rsi < 0.15 THEN 2 ELSE 0 END::BIGINT AS level FROM k",
        "classic_rsi_minutes": f"""WITH RECURSIVE {O.BARS}, g AS ({grouped(300, 'day')}), {O.classic('g', 'k', smooth=f"CASE WHEN row_number() OVER w >= 5 THEN avg(close) OVER {window(4)} ELSE close END")}
            SELECT b.series, b.ts, round(rsi, 6) AS rsi_bar FROM b ASOF LEFT JOIN k ON b.series = k.series AND b.ts >= k.ts""",
        "minute_bars": f"WITH {O.BARS}, g AS ({grouped(300, 'day')}) SELECT series, ts, {r('open', 'high', 'low', 'close')}, volume FROM g",
        "week_bars": f"WITH {O.BARS}, g AS ({grouped(2400, 'week')}) SELECT series, ts, {r('open', 'high', 'low', 'close')}, volume FROM g",
        "map_to_chart": f"WITH {O.BARS}, g AS ({grouped(300, 'day')}) SELECT b.series, b.ts, round(b.close, 6) AS close, round(g.open, 6) AS open_bar, g.volume AS volume_bar FROM b ASOF LEFT JOIN g ON b.series = g.series AND b.ts >= g.ts",
    }
