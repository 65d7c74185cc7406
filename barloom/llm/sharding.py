"""Operator 10: sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; row r of the n
rows of a source stands at (2 r + 1) / 2 n.  All rows are sorted by that
fraction and cut into equal runs, so that every shard holds each source in the
proportion of the whole, to within one row or so at each cut.

Ranks come from range partitions and a small table of their counts, so a
source with a third of all rows is spread like any other.

Defined results: a null source is a source of its own; a null text has size 1
and the crc of the empty text; null ids, ties and repeated rows get places of
their own in an order that their ids, texts' crc and sizes decide; an empty
table gives an empty result; other columns are passed through by ``shard``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, documents, fresh
from .ranking import ranked

SHARDS = 16
SEED = 10


def assign(rows: DataFrame, shards: int, scratch: Scratch, seed: int = SEED) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows with doc_id, source, size and text_crc32 (and little else: texts stay out)."""
    mixed = rows.withColumn("mixed", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    mixed = scratch.keep(mixed, "rows")
    own = ["mixed", "text_crc32", "size"]
    sizes = mixed.groupBy("source").agg(F.count("*").alias("n"))
    by_source = ranked(mixed, ["source", *own], scratch, "source", within=["source"]).withColumnRenamed("rank", "own_rank")
    sizes = sizes.withColumnRenamed("source", "of")
    placed = by_source.join(sizes, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    placed = placed.withColumn("place", (2 * F.col("own_rank") + 1) / (2 * F.col("n")))
    whole = ranked(placed, ["place", *own], scratch, "place")
    total = mixed.count()
    out = whole.withColumn("shard", F.expr(f"int(rank * {shards} div {max(total, 1)})"))  # an empty table has no row to place
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return out.withColumn("slot", (F.col("rank") - first).cast("long")).drop("mixed", "own_rank", "n", "place", "rank")


def _meta(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more) -> DataFrame:
    text = F.encode(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "UTF-8")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *more)


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, which replace columns of those names."""
    scratch = Scratch(docs.sparkSession, "shard")
    docs = docs.drop("shard", "slot")
    (row,) = fresh(docs, "row_number")
    rows = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()), "docs")
    placed = assign(_meta(rows, id_col, text_col, source_col, F.col(row).alias("row_")), shards, scratch, seed)
    return rows.join(placed.select(F.col("row_").alias(row), "shard", "slot"), row).drop(row)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(_meta(documents(spark, sf_dir), "doc_id", "text", "source"), SHARDS, Scratch(spark, "shards"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
