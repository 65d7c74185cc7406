"""Cuts long series into slices of time, each with the bars that it looks back on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import seconds

#: Fine cells of a slice: a halo is made of whole cells.
CELLS = 16


def slice_of(ts: str, minutes: int, per: int) -> Column:
    """The number of the slice of ``per`` bars' time that a bar lies in."""
    return F.floor(seconds(ts) / (per * minutes * 60)).cast("long")


def deal(bars: DataFrame, minutes: int, halo: int, per: int) -> DataFrame:
    """``bars`` with ``series`` as a struct of series and slice, and with ``own`` and ``base``.

    A slice holds at most ``per`` bars of its own, and before them at least the
    last ``halo`` bars of its series (all, if there are fewer) with ``own``
    false; ``base`` counts the bars of the series before the slice's own.  What
    is planned from is a table with one row for each cell of per / 16 bars.
    """
    cell = F.floor(seconds("ts") / (max(per // CELLS, 1) * minutes * 60)).cast("long")
    rows = bars.withColumn("__cell", cell)
    counts = rows.groupBy("series", "__cell").agg(F.count("*").alias("n"))
    counts = counts.withColumn("slice", F.floor(F.col("__cell") / CELLS).cast("long"))
    along = Window.partitionBy("series").orderBy("__cell")
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    opens = F.coalesce(F.lag("slice").over(along) != F.col("slice"), F.lit(True))
    counts = counts.withColumn("opens", F.when(opens, F.struct("slice", "before")))
    # Slices that begin within the halo; a cell holds a bar at least, so no more cells than bars of the halo need be looked at.
    counts = counts.withColumns({"ahead": F.collect_list("opens").over(along.rowsBetween(1, halo)), "first": F.min("before").over(Window.partitionBy("series", "slice"))})
    ahead = F.filter("ahead", lambda s: s["before"] < F.col("before") + F.col("n") + halo)
    sent = counts.select("series", "__cell", "slice", F.explode(F.concat(F.array(F.struct("slice", F.col("first").alias("before"))), ahead)).alias("to"))
    sent = sent.select("series", "__cell", F.col("to.slice").alias("__to"), F.col("to.before").alias("base"), (F.col("to.slice") == F.col("slice")).alias("own"))
    out = rows.join(sent, ["series", "__cell"])
    return out.withColumn("series", F.struct("series", F.col("__to").alias("slice"))).drop("__cell", "__to")
