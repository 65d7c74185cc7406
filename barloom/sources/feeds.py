"""Feeds of bars: schema checks, a Parquet cache by name, range bars and session flags."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, IntegerType, LongType, NumericType, TimestampNTZType, TimestampType

from ..functions.columns import seconds

#: The record's columns, in order, and the kind of each.
RECORD = {
    "date": "time", "open": "number", "high": "number", "low": "number", "close": "number", "volume": "number", "close_time": "time",
    "quote_asset_volume": "number", "number_of_trades": "whole", "taker_buy_base_asset_volume": "number", "taker_buy_quote_asset_volume": "number",
}
_KINDS: dict[str, Callable[[DataType], bool]] = {
    "time": lambda t: isinstance(t, (TimestampType, TimestampNTZType)),
    "number": lambda t: isinstance(t, (DoubleType, FloatType)),
    "whole": lambda t: isinstance(t, (LongType, IntegerType)),
}


def check_records(df: DataFrame) -> DataFrame:
    """``df``, if it has the record's columns and kinds; ValueError names those that are missing or of another kind."""
    types = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in RECORD if c not in types]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    wrong = [f"{c} ({types[c].simpleString()} instead of a {kind})" for c, kind in RECORD.items() if not _KINDS[kind](types[c])]
    if wrong:
        raise ValueError(f"columns of another kind: {', '.join(wrong)}")
    return df


def record_violations(df: DataFrame) -> DataFrame:
    """(date, rule) for each rule that a record breaks, nulls included."""
    price = F.least("open", "high", "low", "close")
    rules = {
        "high_open": F.col("high") < F.col("open"), "high_low": F.col("high") < F.col("low"), "high_close": F.col("high") < F.col("close"),
        "low_open": F.col("low") > F.col("open"), "low_close": F.col("low") > F.col("close"), "positive": price <= 0,
        "volume": F.least("volume", "quote_asset_volume", "taker_buy_base_asset_volume", "taker_buy_quote_asset_volume", "number_of_trades") < 0,
        "close_time": F.col("close_time") <= F.col("date"), "null": sum((F.col(c).isNull().cast("int") for c in RECORD), F.lit(0)) > 0,
    }
    return check_records(df).select("date", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))).alias("rule"))


class BarCache:
    """Bars by symbol, interval and span: Parquet under a folder, fetched by a function where they are missing.

    There is no network here: ``fetch`` is the connector, a function of (spark,
    symbol, interval, start, end) to a frame of records; a Spark data source in
    Python is one.  Files are read and written by Spark alone.
    """

    def __init__(self, spark: SparkSession, place: str, fetch: Callable[[SparkSession, str, str, str, str], DataFrame] | None = None):
        self.spark, self.place, self.source = spark, place.rstrip("/"), fetch

    def path(self, symbol: str, interval: str, start: str, end: str) -> str:
        for name, value in (("symbol", symbol), ("interval", interval), ("start", start), ("end", end)):
            if not value or not str(value).strip():
                raise ValueError(f"{name} is empty")
        return f"{self.place}/{symbol}_{interval}_{start}_{end}.parquet"

    def exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def write(self, df: DataFrame, path: str) -> None:
        check_records(df).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").mode("overwrite").parquet(path)

    def fetch(self, symbol: str, interval: str, start: str, end: str, use_cache: bool = True) -> DataFrame:
        path = self.path(symbol, interval, start, end)
        if use_cache and self.exists(path):
            return check_records(self.spark.read.parquet(path))
        if self.source is None:
            raise ValueError(f"{path} isn't there, and no connector was given")
        got = check_records(self.source(self.spark, symbol, interval, start, end))
        if not use_cache:
            return got
        self.write(got, path)
        return self.spark.read.parquet(path)


#: The columns that range bars get, and the features that they are.
RANGE_COLUMNS = {
    "laguerre_rsi": "rsi", "laguerre_regime": "regime", "laguerre_regime_strength": "regime_strength", "laguerre_bars_in_regime": "bars_in_regime",
    "laguerre_tail_risk_score": "tail_risk_score", "laguerre_rsi_velocity": "rsi_velocity",
}
#: How range bars are set up, and the environment's names for it.
RANGE_SETUP = {"period": 14, "smoothing": 3, "up": 0.75, "down": 0.10, "offset": 0.50}
RANGE_NAMES = {"period": "ATR_PERIOD", "smoothing": "SMOOTHING", "up": "LEVEL_UP", "down": "LEVEL_DOWN", "offset": "ADAPTIVE_OFFSET"}


def range_setup() -> dict:
    """The setup, with what the environment says if it names a period."""
    if "RANGEBAR_LAGUERRE_ATR_PERIOD" not in os.environ:
        return dict(RANGE_SETUP)
    return {k: type(v)(os.environ.get(f"RANGEBAR_LAGUERRE_{RANGE_NAMES[k]}", v)) for k, v in RANGE_SETUP.items()}


def enrich_range_bars(bars: DataFrame, setup: dict | None = None) -> DataFrame:
    """Range bars with six ``laguerre_`` columns; bars that have them already come back as they are.

    A bar's time is ``ts``, else ``timestamp_ms``, else its place (``row``), in
    that order of what there is; series that have fewer bars than the lookback
    get nulls.  Warm-up bars aren't masked.
    """
    from ..operators.features import count_bars, look_back
    from ..operators.kernel import indicator
    from ..operators.multi import least_rows
    from pyspark.sql import Window

    if "laguerre_rsi" in bars.columns:
        return bars
    s = setup or range_setup()
    out = bars if "series" in bars.columns else bars.withColumn("series", F.lit(""))
    if "ts" not in bars.columns:
        if "timestamp_ms" in bars.columns:
            # Milliseconds from 1970 as a time without zone.
            out = out.withColumn("ts", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval((F.col("timestamp_ms") / 86400000).cast("int"), F.lit(0), F.lit(0), ((F.col("timestamp_ms") % 86400000) / 1000).cast("decimal(18,6)")))
        elif "row" in bars.columns:
            out = out.withColumn("ts", F.expr("TIMESTAMP_NTZ'2020-01-01 00:00:00'") + F.make_dt_interval((F.col("row") / 86400).cast("int"), F.lit(0), F.lit(0), (F.col("row") % 86400).cast("decimal(18,6)")))
        else:
            raise ValueError("range bars need ts, timestamp_ms or row: a table has no order of its own")
    made = count_bars(look_back(indicator(out, s["period"], s["offset"]), s["up"], s["down"]))
    found = made.select("series", "ts", *(F.col(f).alias(c) for c, f in RANGE_COLUMNS.items()))
    enough = F.count(F.lit(1)).over(Window.partitionBy("series")) >= least_rows(s["period"], s["smoothing"])
    out = out.join(found, ["series", "ts"]).withColumn("__enough", enough)
    return out.select(*bars.columns, *(F.when(F.col("__enough"), F.col(c)).alias(c) for c in RANGE_COLUMNS))


#: Sessions by their flag: exchange, time zone, opening and closing minute of the day; lunch breaks left out.
SESSIONS = {
    "is_nyse_session": ("New York Stock Exchange", "America/New_York", ((570, 960),)),
    "is_lse_session": ("London Stock Exchange", "Europe/London", ((480, 990),)),
    "is_xtks_session": ("Tokyo Stock Exchange", "Asia/Tokyo", ((540, 690), (750, 900))),
}


def session_names() -> list[str]:
    return list(SESSIONS)


def session_info() -> dict[str, dict[str, str]]:
    """Of each flag: exchange, time zone and hours."""
    clock = lambda m: f"{m // 60:02d}:{m % 60:02d}"
    return {k: {"exchange": e, "timezone": z, "hours": ", ".join(f"{clock(a)}-{clock(b)}" for a, b in spans), "type": "INTEGER {0, 1}"} for k, (e, z, spans) in SESSIONS.items()}


def has_sessions(df: DataFrame) -> dict[str, bool]:
    """Which flags a frame has."""
    return {c: c in df.columns for c in SESSIONS}


def session_flags(bars: DataFrame) -> DataFrame:
    """``bars`` with three flags, 0 or 1: whether ``ts``, in UTC, lies in the exchange's hours from Monday to Friday.

    Holidays aren't known here, so the flags are approximate; the break in Tokyo
    is taken as 11:30 to 12:30.
    """
    out = {}
    for name, (_, zone, spans) in SESSIONS.items():
        local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("ts"))
        minute = F.floor(seconds(local) / 60) % 1440
        open_ = F.lit(False)
        for a, b in spans:
            open_ = open_ | ((minute >= a) & (minute < b))
        out[name] = (open_ & (F.dayofweek(local.cast("date")).between(2, 6))).cast("int")
    return bars.withColumns(out)


def extract_sessions(df: DataFrame, keys: tuple[str, ...] = ("series", "ts")) -> DataFrame:
    """Keys and flags of a vendor's frame; ValueError if a flag is missing or holds anything but 0 and 1."""
    missing = [c for c in SESSIONS if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    odd = df.agg(*(F.sum((~F.coalesce(F.col(c).isin(0, 1), F.lit(False))).cast("int")).alias(c) for c in SESSIONS)).first()
    bad = [c for c in SESSIONS if odd[c]]
    if bad:
        raise ValueError(f"values other than 0 and 1 in {', '.join(bad)}")
    return df.select(*keys, *(F.col(c).cast("int").alias(c) for c in SESSIONS))


def combine_sessions(features: DataFrame, sessions: DataFrame, n_features: int = 121, keys: tuple[str, ...] = ("series", "ts")) -> DataFrame:
    """Features and flags side by side; ValueError unless there are ``n_features`` and both have the same keys."""
    own = [c for c in features.columns if c not in keys]
    if len(own) != n_features:
        raise ValueError(f"{len(own)} features; {n_features} are needed")
    flags = extract_sessions(sessions, keys)
    alone = features.select(*keys).join(flags, list(keys), "left_anti").limit(1).count() + flags.join(features.select(*keys), list(keys), "left_anti").limit(1).count()
    if alone:
        raise ValueError("features and sessions have different keys")
    return features.join(flags, list(keys))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


#: What enriches bars, by name: a plug-in adds its own.
PROVIDERS: dict[str, Callable[[DataFrame], DataFrame]] = {"laguerre": enrich_range_bars, "sessions": session_flags}


def enrich(bars: DataFrame, *names: str) -> DataFrame:
    """``bars`` through the named providers, in order."""
    for name in names:
        if name not in PROVIDERS:
            raise ValueError(f"no provider {name}; there are {', '.join(sorted(PROVIDERS))}")
        bars = PROVIDERS[name](bars)
    return bars
