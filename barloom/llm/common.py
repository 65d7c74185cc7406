"""Session helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset on one machine (tests) a temporary folder is made and set.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = f"file://{tempfile.mkdtemp(prefix='barloom-')}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


class Scratch:
    """Tables written once in the shared folder, so that lineage is cut and a lost executor costs a reread only."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.dir = spark, f"{shared_dir(spark)}/barloom/{what}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        path = f"{self.dir}/{name}"
        df.write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def sweep(self) -> None:
        """Shuffle files of finished tables go when the driver collects its garbage, which may be long after."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def plan_bytes(df: DataFrame) -> int:
    """The planner's estimate of a DataFrame's size; nothing is run."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_arrow(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]]) -> DataFrame:
    """``mapInArrow`` with a function made once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            yield from work(batch)

    return df.mapInArrow(run, schema)


def texts(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """Only the named columns, so that any others, whatever their names, stay out of the way."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), *more)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, whatever its case."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def text_udf(kind: str, make: Callable[[], Callable], inputs: int = 1):
    """A column function of a text (and more), Arrow arrays to Arrow array, made once per task: the other columns stay in the JVM."""
    of = pa.Array if inputs == 1 else tuple[(pa.Array,) * inputs]

    def run(batches: Iterator) -> Iterator:
        work = make()
        for batch in batches:
            yield work(batch) if inputs == 1 else work(*batch)

    run.__annotations__ = {"batches": Iterator[of], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def choose(rows: DataFrame, label: str, most: int, seed: int) -> tuple[Column, dict]:
    """(condition that about ``most`` rows (doc_id, ``label``) of each label meet, by a hash of their id; rows of each label).

    A label of n rows keeps those whose hash is below most / n of its range, so
    nothing is ranked or gathered; the number kept differs from ``most`` by a
    few times its root.  Only the labels and their counts reach the driver.
    """
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    at = F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, most / n))).otherwise(share)
    return at < share, counts
