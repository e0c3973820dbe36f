"""Signals as blocks: fixed-length pieces of a record, so that a record of any length is split.

Long form is ``(record_id, channel, idx, value)``. Block form is ``(record_id, channel, block,
values)`` where block ``b`` holds samples ``b*B .. b*B+B-1`` and only the last block is shorter.
Work that needs neighbours gets a halo from the adjacent blocks; work that needs a whole-record
figure gets it from a partial aggregate. No step gathers a record in one task.

Arrays that were just computed are exploded in the ``outer`` form: for the inner form the optimizer
adds a ``size(array) > 0`` filter below, which works the whole array out a second time. Blocks are
never empty, so both forms give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

KEYS = ("record_id", "channel")


def to_blocks(samples: DataFrame, block: int, keys: Sequence[str] = KEYS, value: str = "value"
              ) -> DataFrame:
    """Long form to blocks; each group holds at most ``block`` samples."""
    cut = samples.withColumn("block", F.expr(f"idx div {block}"))
    packed = cut.groupBy(*keys, "block").agg(
        F.array_sort(F.collect_list(F.struct("idx", F.col(value).alias("v")))).alias("s"))
    return packed.select(*keys, "block", F.col("s.v").alias("values"))


def to_samples(blocks: DataFrame, block: int, keys: Sequence[str] = KEYS) -> DataFrame:
    return (blocks.select(*keys, "block", F.posexplode_outer("values").alias("__pos", "value"))
            .select(*keys, (F.col("block") * block + F.col("__pos")).alias("idx"), "value"))


def cut_arrays(rows: DataFrame, values: str, block: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows with one whole-signal array each to blocks, without a shuffle."""
    n = F.size(values)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")))
    return (rows.where(n > 0).select(*keys, F.col(values).alias("__v"),
                                     F.explode(starts).alias("__b"))
            .select(*keys, F.col("__b").cast("long").alias("block"),
                    F.slice("__v", F.col("__b") * block + 1, F.lit(block)).alias("values")))


def with_halo(blocks: DataFrame, left: int, right: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds ``before`` and ``after``: the nearest samples of the adjacent blocks (empty at the ends).

    Each block sends its tail to the next block and its head to the previous one; the group key is
    the block, so a long record spreads over all tasks. Halos must not exceed the block length.
    """
    empty = F.array().cast("array<double>")
    piece = lambda b, own, before, after: F.struct(
        b.alias("block"), own.alias("own"), before.alias("before"), after.alias("after"))
    none = F.lit(None).cast("array<double>")
    v, b = F.col("values"), F.col("block")
    sends = [piece(b, v, none, none)]
    if left:
        tail = F.slice(v, F.greatest(F.size(v) - left + 1, F.lit(1)), F.lit(left))
        sends.append(piece(b + 1, none, tail, none))
    if right:
        sends.append(piece(b - 1, none, none, F.slice(v, F.lit(1), F.lit(right))))
    spread = blocks.select(*keys, F.explode_outer(F.array(*sends)).alias("p")).select(*keys, "p.*")
    joined = spread.groupBy(*keys, "block").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("own", "before", "after")])
    return joined.where(F.col("own").isNotNull()).select(
        *keys, "block", F.col("own").alias("values"),
        F.coalesce("before", empty).alias("before"), F.coalesce("after", empty).alias("after"))


def record_stats(blocks: DataFrame, aggs: Sequence[Column], keys: Sequence[str] = KEYS) -> DataFrame:
    """Whole-record figures over ``value``, and the number of blocks as ``__blocks``."""
    long = blocks.select(*keys, "block", F.explode_outer("values").alias("value"))
    return long.groupBy(*keys).agg(*aggs, (F.max("block") + 1).alias("__blocks"))


def attach(blocks: DataFrame, stats: DataFrame, keys: Sequence[str] = KEYS, fan: int = 4096
           ) -> DataFrame:
    """Join per-record figures to every block of the record.

    The figures are repeated once per block, so the join key ``(keys, block)`` is unique and is the
    key that block tables are already partitioned by: the samples stay where they are and only the
    small figures move. A record with very many blocks is expanded in two steps, spread in between.
    """
    parts = (stats.withColumn("__part", F.explode(F.sequence(
                F.lit(0), F.floor((F.col("__blocks") - 1) / fan).cast("int"))))
             .repartition(*keys, "__part"))
    first = F.col("__part").cast("long") * fan
    each = parts.withColumn("block", F.explode(F.sequence(
        first, F.least(first + fan, F.col("__blocks")) - 1))).drop("__part", "__blocks")
    return blocks.join(each, [*keys, "block"])


def recut(pieces: DataFrame, first: str, values: str, block: int, keys: Sequence[str] = KEYS
          ) -> DataFrame:
    """Pieces that start at sample ``first`` to blocks of ``block`` samples; slices move, not rows."""
    n = F.size(values)
    cut = (pieces.where(n > 0).withColumn("block", F.explode(F.sequence(
        F.floor(F.col(first) / block), F.floor((F.col(first) + n - 1) / block)))))
    begin = F.greatest(F.col(first), F.col("block") * block)
    end = F.least(F.col(first) + n, (F.col("block") + 1) * block)
    piece = F.struct(begin.alias("b"), F.slice(
        values, (begin - F.col(first) + 1).cast("int"), (end - begin).cast("int")).alias("v"))
    return cut.select(*keys, "block", piece.alias("p")).groupBy(*keys, "block").agg(
        F.flatten(F.array_sort(F.collect_list("p")).v).alias("values"))


def resize(blocks: DataFrame, old: int, new: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The same signals in blocks of another length."""
    if old == new:
        return blocks
    return recut(blocks.select(*keys, (F.col("block") * old).alias("__first"), "values"),
                 "__first", "values", new, keys)


def salted_join(rows: DataFrame, side: DataFrame, on: str, spread: Column, salts: int = 16) -> DataFrame:
    """Inner join on ``on`` with a small side of unique keys; a key's rows spread over ``salts`` tasks."""
    copies = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (rows.withColumn("__salt", F.pmod(spread, F.lit(salts)).cast("int"))
            .join(copies, [on, "__salt"]).drop("__salt"))


def map_values(blocks: DataFrame, fn, keys: Sequence[str] = KEYS) -> DataFrame:
    """Apply an element-wise column function to every sample."""
    return blocks.select(*keys, "block", F.transform("values", fn).alias("values"))
