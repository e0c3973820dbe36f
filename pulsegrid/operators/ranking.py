"""Ranks, ordinals and carries inside groups that may be too large for one task.

A plain ``row_number() OVER (PARTITION BY key)`` sends a whole key to one task. Here each key is cut
into ordered buckets: rows are numbered inside their bucket, and the small per-bucket counts give
the offset. The largest unit of work is one bucket, not one key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from pulsegrid.operators.joins import measured_join
from pulsegrid.session import cut_lineage


def hash_bucket(hexed: Column, chars: int = 3) -> Column:
    """Order-preserving bucket of a hex digest: 16**chars even slices."""
    return F.substring(hexed, 1, chars)


def split_rank(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Column,
               out: str = "rank", size: str | None = None) -> DataFrame:
    """1-based position of each row within ``keys``, ordered by ``(bucket, *order)``.

    ``bucket`` must grow with ``order`` (a coarser form of the first order column). Keys must not
    be null. ``size`` names an optional column with the number of rows of the key; it comes from
    the same per-bucket counts.
    """
    b, off = f"__{out}_bucket", f"__{out}_offset"
    cut = df.withColumn(b, bucket)
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum("__n").over(Window.partitionBy(*keys)).alias(size)] if size else []
    offsets = cut.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("__n")).select(
        *keys, b, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(off), *whole)
    inside = Window.partitionBy(*keys, b).orderBy(*order)
    numbered = cut.withColumn(out, F.row_number().over(inside).cast("long"))
    return (numbered.join(offsets, [*keys, b])
            .withColumn(out, F.col(out) + F.col(off))
            .select(*df.columns, out, *([size] if size else [])))


def split_cumsum(df: DataFrame, keys: Sequence[str], order: str, value: str, span: int,
                 out: str = "before") -> DataFrame:
    """Sum of ``value`` over the earlier rows of the key, in slices of ``span`` order values."""
    cut = df.withColumn("__slice", F.expr(f"{order} div {span}"))
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "__slice").orderBy(order).rowsBetween(*before)
    sums = cut.groupBy(*keys, "__slice").agg(F.sum(value).alias("__s"))
    offsets = sums.select(*keys, "__slice", F.sum("__s").over(
        Window.partitionBy(*keys).orderBy("__slice").rowsBetween(*before)).alias("__o"))
    run = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return (cut.withColumn(out, run).join(offsets, [*keys, "__slice"])
            .withColumn(out, F.col(out) + F.coalesce("__o", F.lit(0))).select(*df.columns, out))


def sample_index(df: DataFrame, record: str, time: str, tie: str, bucket: str = "day") -> DataFrame:
    """0-based sample index of each row of a record in time order, split by calendar bucket."""
    ranked = split_rank(df, [record], [time, tie], F.date_trunc(bucket, F.col(time)), "idx")
    return ranked.withColumn("idx", F.col("idx") - 1)


def rank_median(df: DataFrame, keys: Sequence[str], value: str, bucket: Column | None = None,
                out: str = "median") -> DataFrame:
    """Exact median per key (mean of the middle pair), without holding a key's values in memory."""
    v = F.col(value)
    # Sixteen buckets per octave keep the order; zero and negatives get their own ends.
    grow = F.when(v > 0, F.floor(F.log2(v) * 16)).otherwise(F.lit(-100000)).cast("long")
    ranked = split_rank(df, keys, [value], grow if bucket is None else bucket, "__pos", "__size")
    middle = ranked.where(
        F.col("__pos").isin(F.floor((F.col("__size") + 1) / 2), F.floor(F.col("__size") / 2) + 1))
    return middle.groupBy(*keys).agg(F.avg(value).alias(out))


def order_key(value: Column) -> Column:
    """A 64-bit integer that orders as the double does; both zeros are one, and null and NaN stay out (null)."""

    @pandas_udf("bigint")
    def keyed(v: pd.Series) -> pd.Series:
        bits = (v.to_numpy(np.float64, na_value=np.nan) + 0.0).view(np.int64)
        keys = np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF))
        return pd.Series(keys, dtype="Int64").mask(v.isna().to_numpy())

    return keyed(value)


def key_value(key: int) -> float:
    """The double that an order key stands for."""
    bits = np.int64(key)
    return float((bits if bits >= 0 else bits ^ np.int64(0x7FFFFFFFFFFFFFFF)).view(np.float64))


def select_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column], digit: int = 16) -> DataFrame:
    """The values at given 1-based ranks within ``keys``, in ascending order, by radix selection: ``keys, which, value``.

    ``ranks`` names expressions of ``n``, the key's number of values. Values become order-preserving integers, equal ones are counted into one
    row before anything is shuffled by key, and histograms of ``digit`` bits at a time narrow each rank down to its value. No value is ranked or
    sorted, a key's histogram has at most ``2 ** digit`` rows, and the values that a pass looks at are dealt to tasks by their count. Null and
    NaN values don't count; keys without any value are left out.
    """
    keys = list(keys)
    distinct = cut_lineage(df.select(*keys, order_key(F.col(value)).alias("__k")).where(F.col("__k").isNotNull())
                           .groupBy(*keys, "__k").agg(F.count(F.lit(1)).alias("__c")), "distinct-values")
    sizes = distinct.groupBy(*keys).agg(F.sum("__c").alias("n"))
    asked = sizes.select(*keys, F.explode(F.array(*[F.struct(F.lit(w).alias("which"), r.cast("long").alias("left")) for w, r in ranks.items()])).alias("a"))
    state = asked.select(*keys, "a.which", "a.left", F.lit(0).cast("long").alias("__prefix")).where(F.col("left").isNotNull())
    part = Window.partitionBy(*keys, "which").orderBy("__digit")
    for shift in range(64 - digit, -1, -digit):
        above = F.shiftright("__k", shift + digit) if shift + digit < 64 else F.lit(0).cast("long")
        # The first digit keeps the sign; the others are bits below it.
        own = F.shiftright("__k", shift) if shift + digit == 64 else F.shiftright("__k", shift).bitwiseAND(2 ** digit - 1)
        cut = distinct.withColumns({"__prefix": above, "__digit": own})
        state = cut_lineage(state, "ranks")
        met = measured_join(cut, state, [*keys, "__prefix"], F.col("__k"))
        cells = met.groupBy(*keys, "which", "left", "__prefix", "__digit").agg(F.sum("__c").alias("__m"))
        run = cells.withColumn("__upto", F.sum("__m").over(part.rowsBetween(Window.unboundedPreceding, 0)))
        found = run.where((F.col("left") <= F.col("__upto")) & (F.col("left") > F.col("__upto") - F.col("__m")))
        state = found.select(*keys, "which", (F.col("left") - (F.col("__upto") - F.col("__m"))).alias("left"),
                             (F.shiftleft("__prefix", digit) + F.col("__digit")).alias("__prefix"))

    @pandas_udf("double")
    def valued(k: pd.Series) -> pd.Series:
        return pd.Series([key_value(x) for x in k], dtype=float)

    return state.select(*keys, "which", valued("__prefix").alias("value"))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """Exact median per key (mean of the middle pair); a key may hold any number of values, equal or not."""
    middle = {"low": F.floor((F.col("n") + 1) / 2), "high": F.floor(F.col("n") / 2) + 1}
    return select_ranks(df, keys, value, middle).groupBy(*keys).agg(F.avg("value").alias(out))


def carry_ends(summary: DataFrame, keys: Sequence[str], order: str, last: str, first: str,
               fan: int = 1024) -> DataFrame:
    """Adds ``prev``: the nearest non-null ``last`` of earlier rows of the key, and ``next``: the
    nearest non-null ``first`` of later rows.

    ``summary`` has one row per block. Blocks are grouped in runs of ``fan``; the ends of runs are
    carried separately and joined back, so a task sees at most ``fan`` blocks of a key, or one row
    per run.
    """
    cut = summary.withColumn("__run", F.floor(F.col(order) / fan).cast("long"))
    before, after = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    inner = Window.partitionBy(*keys, "__run").orderBy(order)
    near = (cut.withColumn("__p", F.last(last, True).over(inner.rowsBetween(*before)))
            .withColumn("__q", F.first(first, True).over(inner.rowsBetween(*after))))
    tip = lambda value: F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    runs = cut.groupBy(*keys, "__run").agg(F.max(tip(last)).v.alias("__l"), F.min(tip(first)).v.alias("__f"))
    outer = Window.partitionBy(*keys).orderBy("__run")
    far = runs.select(*keys, "__run",
                      F.last("__l", True).over(outer.rowsBetween(*before)).alias("__fp"),
                      F.first("__f", True).over(outer.rowsBetween(*after)).alias("__fq"))
    return near.join(far, [*keys, "__run"]).select(
        *summary.columns, F.coalesce("__p", "__fp").alias("prev"), F.coalesce("__q", "__fq").alias("next"))
