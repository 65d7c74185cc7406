"""Bars from an event table, and a checked Parquet bar source and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import from_seconds, seconds

BAR = "series string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def bars(events: DataFrame, minutes: int, series: str = "event_type") -> DataFrame:
    """Tumbling bars, labelled by their start: first, greatest, least and last value, and the number of events.

    One partial aggregate and one shuffle of bars; ties of ts go by event_id.
    """
    width = minutes * 60
    start = from_seconds(F.floor(seconds("ts") / width) * width)
    place = F.struct("ts", "event_id")
    return (
        events.where("value IS NOT NULL AND ts IS NOT NULL")
        .select(F.col(series).alias("series"), start.alias("bar"), "ts", "event_id", "value")
        .groupBy("series", F.col("bar"))
        .agg(F.min_by("value", place).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", place).alias("close"), F.count("*").cast("double").alias("volume"))
        .withColumnRenamed("bar", "ts")
    )


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars from Parquet; ValueError names missing columns."""
    found = spark.read.parquet(path)
    missing = [f.split()[0] for f in BAR.split(", ") if f.split()[0] not in found.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return found


def write_bars(df: DataFrame, path: str) -> None:
    df.write.option("compression", "zstd").partitionBy("series").mode("overwrite").parquet(path)


def violations(df: DataFrame) -> DataFrame:
    """(series, ts, rule) for each rule that a bar breaks, order of time included."""
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("series").orderBy("ts"))
    rules = {
        "high_open": F.col("high") < F.col("open"), "high_close": F.col("high") < F.col("close"), "high_low": F.col("high") < F.col("low"),
        "low_open": F.col("low") > F.col("open"), "low_close": F.col("low") > F.col("close"),
        "positive": F.least("open", "high", "low", "close") <= 0, "volume": F.col("volume") < 0, "increasing": F.col("ts") <= F.col("__before"),
    }
    return df.withColumn("__before", before).withColumn("rule", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items()))))).select("series", "ts", "rule")
