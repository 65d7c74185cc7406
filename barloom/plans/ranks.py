"""Ranks of a column over all rows, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Ranges that values are cut into.
RANGES = 64
#: Bytes of a table, as planned, whose values stay in one range.
SMALL = 256 << 20


def average_ranks(df: DataFrame, value: str, out: str, by: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """Adds ``out``: the average rank (from 1) of the number ``value`` among the rows of ``by``; null where ``value`` is null.

    Distinct values are counted first, so a value that many rows share is one
    row.  Approximate quantiles, at most ``ranges`` numbers, cut the values into
    ranges; counts add up in each range and the few ranges' totals shift them.
    Only the speed depends on the quantiles, not the ranks; a table that the
    planner takes for small has one range.
    """
    if ranges is None:
        ranges = RANGES if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > SMALL else 1
    edges = [] if ranges == 1 else sorted(set(df.where(F.col(value).isNotNull()).approxQuantile(value, [k / ranges for k in range(1, ranges)], 0.5 / ranges)))
    key = [F.col(c) for c in by]
    part = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("__value"))) if edges else F.lit(0)
    counts = df.where(F.col(value).isNotNull()).groupBy(*key, F.col(value).alias("__value")).agg(F.count("*").alias("__n")).withColumn("__part", part)
    within = Window.partitionBy(*key, "__part").orderBy("__value").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy(*key, "__part").agg(F.sum("__n").alias("__own"))
    parts = parts.withColumn("__base", F.coalesce(F.sum("__own").over(before), F.lit(0))).drop("__own")
    ranks = counts.join(parts, [*by, "__part"]).withColumn(out, F.col("__base") + F.coalesce(F.sum("__n").over(within), F.lit(0)) + (F.col("__n") + 1) / 2)
    ranks = ranks.select(*(F.col(c).alias(f"__by_{c}") for c in by), F.col("__value").alias("__of"), out)
    match = F.col(value) == F.col("__of")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return df.join(ranks, match, "left").drop("__of", *(f"__by_{c}" for c in by))


def ranked_columns(df: DataFrame, columns: list[str], keys: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """``keys`` and, under their own names, the average ranks of the ``columns`` among the rows of ``by``; ``keys`` tell rows apart and hold ``by``.

    All columns are ranked in one pass, as rows of a long table.
    """
    long = df.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(keys, columns, "__which", "__v")
    ranked = average_ranks(long, "__v", "__rank", (*by, "__which"))
    return ranked.groupBy(*keys).agg(*(F.max(F.when(F.col("__which") == c, F.col("__rank"))).alias(c) for c in columns))
