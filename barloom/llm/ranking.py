"""Global row numbers without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, shuffle_partitions


def ranked(df: DataFrame, keys: list, scratch: Scratch, name: str, within: list[str] = (), weight: Column | None = None) -> DataFrame:
    """Adds ``rank`` (0, 1, ...) of each row by ``keys`` (expressions), started anew for each value of ``within``.

    ``keys`` must begin with ``within``.  Rows are range-partitioned, numbered
    in their partition, and shifted by the counts of the partitions before;
    that table has a row for each partition and value that meet there, at most
    partitions + values.  With ``weight``, ``before`` is the sum of the weights
    of all rows before instead.
    """
    n = shuffle_partitions(df.sparkSession)
    cut = df.repartitionByRange(n, *keys).withColumn("part", F.spark_partition_id())
    cut = scratch.keep(cut, name)  # once, so that each row has one partition number for good
    place = Window.partitionBy("part", *within).orderBy(*keys)
    one = F.lit(1).cast("long") if weight is None else weight
    per = cut.groupBy("part", *within).agg(F.sum(one).alias("own"))
    before = per.withColumn("base", F.coalesce(F.sum("own").over(Window.partitionBy(*within).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    names = {c: f"__of_{k}" for k, c in enumerate(("part", *within))}
    before = before.select(*(F.col(c).alias(to) for c, to in names.items()), "base")
    match = None
    for c, to in names.items():
        same = F.col(c).eqNullSafe(F.col(to))
        match = same if match is None else match & same
    joined = cut.join(before, match).drop(*names.values())
    if weight is None:
        return joined.withColumn("rank", F.col("base") + F.row_number().over(place) - 1).drop("part", "base")
    return joined.withColumn("before", F.col("base") + F.coalesce(F.sum(weight).over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("part", "base")
