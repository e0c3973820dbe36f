"""What the vector operators share: which vectors take part, and Arrow lists as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def usable(table: DataFrame, id: str, vector: str) -> DataFrame:
    """``(id, v)`` for vectors that take part, one row an id: of several vectors under one id the smallest, component by component.

    Null, empty and zero vectors and those with null or non-finite components take no part; neither do null ids. Vectors
    of any lengths do (see ``by_length``).
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (table.select(F.col(id).alias("id"), F.col(vector).alias("v"))
            .where(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0)).groupBy("id").agg(F.min("v").alias("v")))


def by_length(rows: DataFrame) -> list[DataFrame]:
    """The rows of each length of ``v`` by themselves, as only vectors of one length compare; without any row, ``rows`` as it is."""
    sizes = sorted(r[0] for r in rows.select(F.size("v").alias("n")).distinct().collect())
    return [rows.where(F.size("v") == n) for n in sizes] if len(sizes) > 1 else [rows]


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """A list column whose lists have one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Sorted batches as one table per run of equal first ``keys`` columns. Runs must fit in memory."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(k[:, a].tolist())
            if held and key != now:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            now = key
    if held:
        yield pa.Table.from_batches(held)
