"""Recursions along a series as a column: Arrow batches in the order of a window."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F


def scan(df: DataFrame, name: str, make: Callable[[], Callable], inputs: list, fields: dict[str, str], order: str = "ts") -> DataFrame:
    """Adds the struct ``name`` with ``fields`` (name to SQL type): what ``make()`` returns, called with arrays of the inputs, piece after piece.

    ``make`` is called at the start of each series, so its function may keep the
    state of a recursion.  A window numbers the bars first, so the rows of a task
    lie series by series in order.  The column isn't deterministic for the
    planner, so it moves nothing past it; the planner doesn't know how rows lie
    behind a Python column, so windows after it deal them once more.
    """
    first = F.row_number().over(Window.partitionBy("series").orderBy(order)) == 1
    columns = [F.col(c) if isinstance(c, str) else c for c in inputs]

    def run(batches: Iterator) -> Iterator:
        work = None
        for start, *arrays in batches:
            start = start.to_numpy(zero_copy_only=False).astype(bool)
            values = [a.to_numpy(zero_copy_only=False) for a in arrays]
            edges = np.unique(np.concatenate(([0], np.flatnonzero(start), [len(start)])))
            out = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if start[a]:
                    work = make()
                out.append(work(*(v[a:b] for v in values)))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate([x[k] for x in out]) if out else [], from_pandas=True) for k in range(len(fields))], names=list(fields))

    run.__annotations__ = {"batches": Iterator[tuple[(pa.Array,) * (len(columns) + 1)]], "return": Iterator[pa.Array]}
    kind = "struct<" + ", ".join(f"{k}: {v}" for k, v in fields.items()) + ">"
    flag = "__first"
    out = df.withColumn(flag, first)
    return out.withColumn(name, F.arrow_udf(run, kind).asNondeterministic()(F.col(flag), *columns)).drop(flag)


def spread(df: DataFrame, name: str, fields) -> DataFrame:
    """The fields of the struct ``name`` as columns."""
    return df.select(*(c for c in df.columns if c != name and c not in fields), *(F.col(f"{name}.{k}").alias(k) for k in fields))


