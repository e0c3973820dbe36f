"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of the pivots by nearness. The inverted file of a pivot lists the place that it
takes in the order of every vector. Vectors are ranked for a query by the footrule distance of the two orders, summed
pivot by pivot over the inverted files, and the best are reranked by the inner product in double precision.

For the largest inner product, vectors get one more component that makes all as long as the longest, and a query gets
zero there, so the nearest vector is the one of largest inner product.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.llm.vectors import by_length, matrix, runs, usable
from pulsegrid.session import cut_lineage

#: Pivots are chosen from this many vectors, those whose ids hash lowest.
SAMPLE = 2048
PIVOTS, BLOCK, QUERY_BLOCK = 128, 4096, 8192
#: Share of a block that is reranked for a query, and at least so many vectors.
SHARE, LEAST = 0.15, 256
#: Vectors whose footrule distance is below this share of that of unrelated orders are always reranked.
NEAR = 0.3


def choose_pivots(sample: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Farthest first: each pivot is the vector least near to those chosen before it."""
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < min(pivots, len(sample)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    return sample[chosen]


def places(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The place of each pivot in each vector's order: vectors x pivots, from 0."""
    order = np.argsort(-(x @ pivots.T), axis=1, kind="stable")
    out = np.empty(order.shape, np.uint8)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.uint8)[None], axis=1)
    return out


def search_block(queries: tuple, rows: tuple, pivots: np.ndarray, longest: float, k: int) -> Iterator[tuple]:
    """``(query_id, ids, scores)`` of up to ``k`` nearest rows of one block for each query."""
    (q_ids, q), (ids, x) = queries, rows
    norms = np.sqrt((x * x).sum(axis=1))
    more = np.sqrt(np.maximum(0, longest ** 2 - norms ** 2))
    # The inverted files: a row a pivot.
    files = np.ascontiguousarray(places(np.column_stack([x, more]) / longest, pivots).T)
    q_places = places(np.column_stack([q / np.sqrt((q * q).sum(axis=1))[:, None], np.zeros(len(q))]), pivots)
    m, n = files.shape
    want = min(n, max(LEAST, k + 1, int(np.ceil(SHARE * n))))
    for i in range(len(q)):
        place = q_places[i][:, None]
        footrule = np.add.reduce(np.maximum(files, place) - np.minimum(files, place), axis=0, dtype=np.uint16)
        limit = max(int(np.partition(footrule, want - 1)[want - 1]), int(NEAR * m * m / 3))
        found = np.flatnonzero((footrule <= limit) & (ids != q_ids[i]))
        rough = x[found] @ q[i]
        if len(found) > 2 * k:
            found = found[rough >= np.partition(rough, -2 * k)[-2 * k]]
        scores = (x[found] * q[i]).sum(axis=1)
        best = np.lexsort((ids[found], -scores))[:k]
        yield q_ids[i], ids[found][best], scores[best]


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, <id>, score)``: the ``k`` nearest found of every row that the condition ``queries`` on column
    ``id`` picks, among all other rows; fewer if there are fewer. Ties go to the smaller id.

    See ``vectors.usable`` for what takes no part and for repeated ids. A query is compared with the vectors of its length; each length
    has an index of its own. Every row is indexed, in blocks of about ``BLOCK``; each block meets the queries in blocks of about
    ``QUERY_BLOCK``, and a block's files live in one task only. The driver gets the sample.
    """
    own = cut_lineage(usable(vectors, id, vector).withColumn("q", queries_on(queries, id)), "vectors")
    parts = [_nearest(part, k, id) for part in by_length(own)]
    return reduce(DataFrame.union, parts)


def _nearest(own: DataFrame, k: int, id: str) -> DataFrame:
    """``nearest`` among vectors ``(id, v, q)`` of one length."""
    spark = own.sparkSession
    facts = own.agg(F.count(F.lit(1)), F.count(F.when(F.col("q"), 1)), F.max(F.aggregate(
        "v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()
    n, n_queries, longest = facts[0], facts[1], float(facts[2] or 0) ** 0.5
    out = f"query_id long, `{id}` long, score double"
    if not n_queries:
        return spark.createDataFrame([], f"query_id long, rank int, `{id}` long, score double")
    sample = np.array([r[0] for r in own.orderBy(F.xxhash64("id", F.lit("pivots")), "id").limit(SAMPLE).select("v").collect()], np.float64)
    more = np.sqrt(np.maximum(0, longest ** 2 - (sample * sample).sum(axis=1)))
    pivots = choose_pivots(np.column_stack([sample, more]) / longest)
    blocks, q_blocks = -(-n // BLOCK), -(-n_queries // QUERY_BLOCK)
    block = lambda of, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(of))
    each = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long")))
    asked = own.where("q").select(each(blocks).alias("b"), block(q_blocks, "query").alias("c"), F.lit(0).alias("side"), "id", "v")
    posted = own.select(block(blocks, "row").alias("b"), each(q_blocks).alias("c"), F.lit(1).alias("side"), "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 2):
            side, ids, x = table["side"].to_numpy(), table["id"].to_numpy(), matrix(table["v"].combine_chunks())
            if side.min() == 0 and side.max() == 1:
                for q, found, scores in search_block((ids[side == 0], x[side == 0]), (ids[side == 1], x[side == 1]), pivots, longest, k):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), q)), pa.array(found), pa.array(scores)], names=["query_id", id, "score"])

    # Several partitions a group, so that two groups seldom share a task; groups are of bounded size.
    found = (asked.union(posted).repartition(4 * blocks * q_blocks, "b", "c").sortWithinPartitions("b", "c", "side", "id").mapInArrow(run, out))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), id)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", id, "score")


def queries_on(condition: Column, id: str) -> Column:
    """The condition, false where it is null. It speaks of a column named ``id``."""
    return F.coalesce(condition, F.lit(False))
