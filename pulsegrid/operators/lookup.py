"""Interval lookup with a fractional position on a small ascending or descending grid."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

from pulsegrid.functions.arrays import bind
from pulsegrid.functions.keyed import gaussian
from pulsegrid.operators.ranking import split_cumsum


def linear_betas(start: float, end: float, steps: int) -> np.ndarray:
    return np.linspace(start, end, steps)


def schedule_table(spark: SparkSession, betas: Sequence[float]) -> DataFrame:
    """Fixed dimension table ``(step, beta)``."""
    rows = [(i, float(b)) for i, b in enumerate(betas)]
    return spark.createDataFrame(rows, "step INT, beta DOUBLE")


def running_product(rates: DataFrame, keys: Sequence[str], order: str, rate: str = "beta",
                    out: str = "alpha_cum", span: int = 100_000) -> DataFrame:
    """Running product of ``1 - rate`` per key, as the exponential of a running sum of logs.

    ``order`` is an integer column; a key is summed in slices of ``span`` order values.
    """
    logs = rates.withColumn("__log", F.log(F.lit(1.0) - F.col(rate)))
    return split_cumsum(logs, keys, order, "__log", span, "__before").withColumn(
        out, F.exp(F.col("__before") + F.col("__log"))).drop("__log", "__before")


def noise_levels(schedule: DataFrame) -> DataFrame:
    """Steps with the variance kept (``alpha_cum``) and its root, the continuous noise level."""
    return running_product(schedule, [], "step").withColumn("level", F.sqrt("alpha_cum"))


def fractional_step(value: Column, grid: Sequence[float]) -> Column:
    """Fractional position of ``value`` between descending grid points, by distance of the roots.

    Null outside the grid. The grid is a short literal list; each value is found by binary search.
    """
    points = np.asarray(grid, float)
    roots = np.sqrt(points)

    @pandas_udf("double")
    def locate(v: pd.Series) -> pd.Series:
        x = v.to_numpy(float)
        inside = (x <= points[0]) & (x >= points[-1])
        # Interval t holds points[t+1] <= x <= points[t].
        t = np.clip(len(points) - 1 - np.searchsorted(points[::-1], x, side="right"), 0, len(points) - 2)
        step = t + (roots[t] - np.sqrt(np.where(inside, x, 0))) / (roots[t] - roots[t + 1])
        return pd.Series(np.where(inside, step, np.nan)).where(inside)

    return locate(value)


def _mixed(col: str, keep: Column, add: Column, seed, step: str, key: Sequence[Column]) -> Column:
    """``keep`` times the signal plus ``add`` times normal noise."""
    parts = F.struct(keep.alias("keep"), add.alias("add"))
    return bind(parts, lambda p: F.transform(col, lambda x, i: p["keep"] * x + p["add"] * gaussian(seed, step, *key, i)))


def diffuse(rows: DataFrame, levels: DataFrame, col: str, seed, step: str, key: Sequence[Column]
            ) -> DataFrame:
    """Signal and normal noise mixed at the row's schedule step: ``sqrt(a) x + sqrt(1-a) e``.

    ``levels`` is the schedule table, one row a step; whether it is broadcast is left to its measured size.
    """
    joined = rows.join(levels.select("step", "alpha_cum"), "step")
    mixed = _mixed(col, F.sqrt("alpha_cum"), F.sqrt(1 - F.col("alpha_cum")), seed, step, key)
    return joined.withColumn(col, mixed).drop("alpha_cum")


def diffuse_at(rows: DataFrame, level: str, col: str, seed, step: str, key: Sequence[Column]) -> DataFrame:
    """Mixing at a continuous noise level ``l`` in [0, 1]: ``l x + sqrt(1 - l^2) e``."""
    l = F.col(level)
    return rows.withColumn(col, _mixed(col, l, F.sqrt(1 - l * l), seed, step, key))
