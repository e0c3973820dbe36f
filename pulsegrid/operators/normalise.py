"""Amplitude normalisers on blocks: abs-max, min-max, z-score, k-peak."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from pulsegrid.operators.blocks import KEYS, attach, record_stats
from pulsegrid.operators.repair import fill_gaps


def _scaled(blocks, stats, fn, keys):
    joined = attach(blocks, stats, keys)
    return joined.select(*keys, "block", F.transform("values", fn).alias("values"))


def abs_max(blocks: DataFrame, keys: Sequence[str] = KEYS, block: int | None = None) -> DataFrame:
    """Zero mean, peak magnitude 1 (constant signals stay 0), clipped to [-1, 1].

    The peak of the centred signal follows from mean, minimum and maximum, so one pass is enough. With the
    block length, gaps are filled first; without it (chains fill them at their start), null and NaN samples
    stay as they are and don't count.
    """
    if block is not None:
        blocks = fill_gaps(blocks, block, keys)
    valid = F.when(~F.isnan("value"), F.col("value"))
    stats = record_stats(blocks, [F.avg(valid).alias("__m"), F.min(valid).alias("__lo"), F.max(valid).alias("__hi")], keys)
    stats = stats.withColumn("__peak", F.greatest(F.col("__hi") - F.col("__m"), F.col("__m") - F.col("__lo")))

    def scale(x):
        # A constant record has no peak: its samples are all zero after centring.
        at = (x - F.col("__m")) / F.col("__safe")
        return F.when(x.isNull() | F.isnan(x), x).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), at)))

    safe = F.when(F.col("__peak") > 0, F.col("__peak")).otherwise(1.0)
    return _scaled(blocks, stats.withColumn("__safe", safe), scale, keys)


def min_max(blocks: DataFrame, lo: float = -1.0, hi: float = 1.0, keys: Sequence[str] = KEYS
            ) -> DataFrame:
    """Rescale to [lo, hi]; a constant signal becomes the midpoint."""
    stats = record_stats(blocks, [F.min("value").alias("__lo"), F.max("value").alias("__hi")], keys)
    span = F.col("__hi") - F.col("__lo")
    scale = lambda x: F.when(span <= 0, F.lit((lo + hi) / 2)).otherwise(
        (x - F.col("__lo")) / span * (hi - lo) + lo)
    return _scaled(blocks, stats, scale, keys)


def z_score(blocks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Zero mean, unit population standard deviation (plus 1e-8)."""
    stats = record_stats(blocks, [F.avg("value").alias("__m"), F.stddev_pop("value").alias("__s")],
                         keys)
    return _scaled(blocks, stats, lambda x: (x - F.col("__m")) / (F.col("__s") + 1e-8), keys)


def peak_means(blocks: DataFrame, k: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean of the k smallest and of the k largest samples per record.

    Each block first keeps its own k ends; the rank filter then keeps at most k rows per record in
    every map task before the exchange.
    """
    ends = lambda ascending: F.slice(F.sort_array("values", ascending), 1, k)

    def mean_of(ascending, name):
        long = blocks.select(*keys, "block", F.explode(ends(ascending)).alias("value"))
        order = F.col("value").asc() if ascending else F.col("value").desc()
        ranked = long.withColumn("__r", F.row_number().over(
            Window.partitionBy(*keys).orderBy(order)))
        return ranked.where(F.col("__r") <= k).groupBy(*keys).agg(F.avg("value").alias(name))

    blocks_of = blocks.groupBy(*keys).agg((F.max("block") + 1).alias("__blocks"))
    return mean_of(True, "__lo").join(mean_of(False, "__hi"), list(keys)).join(blocks_of, list(keys))


def k_peak(blocks: DataFrame, k: int = 3, lo: float = -1.0, hi: float = 1.0,
           keys: Sequence[str] = KEYS) -> DataFrame:
    """Min-max with the mean of the k smallest and k largest samples as the range."""
    span = F.col("__hi") - F.col("__lo")
    scale = lambda x: F.when(span <= 0, F.lit((lo + hi) / 2)).otherwise(
        F.lit(lo) + (x - F.col("__lo")) / span * (hi - lo))
    return _scaled(blocks, peak_means(blocks, k, keys), scale, keys)
