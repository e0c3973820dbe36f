"""Joins whose hot keys are found by counting and spread as far as their counts ask for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


#: Pieces that a task's share of a hot key is cut to: hashing deals out many small pieces more evenly than few large ones.
PIECES = 16


def measured_salts(rows: DataFrame, on: Sequence[str], parts: int) -> dict[int, int]:
    """Pieces that each hot key is cut to, by the key's hash: those with more than one in ``parts`` of all rows, so fewer than ``parts`` of them.

    Only the key columns are read, once counted per key in the map tasks and once counted as a whole.
    """
    keys = rows.where(~F.greatest(*[F.col(c).isNull() for c in on], F.lit(False))).select(F.xxhash64(*on).alias("k"))
    total = keys.count()
    counts = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * parts > total)
    return {r["k"]: -(-r["n"] * parts * PIECES // total) for r in counts.collect()}


def measured_join(rows: DataFrame, side: DataFrame, on: Sequence[str], spread: Column, how: str = "inner", parts: int | None = None) -> DataFrame:
    """``rows`` joined to ``side`` on ``on``; no task gets much more than one in ``parts`` of the rows, whatever the keys' shares.

    The keys that hold more than that are counted first; each is cut to as many pieces as its count asks for, by a hash of ``spread``, and
    only their rows of the side are repeated. ``parts`` defaults to the number of shuffle partitions. ``how`` is inner or left; null keys match
    nothing, and with ``left`` they are spread too. Columns are those of a join by name.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"rows of a hot key are dealt to several tasks, which a {how} join doesn't allow")
    on = list(on)
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = measured_salts(rows, on, parts)
    null = F.greatest(*[F.col(c).isNull() for c in on], F.lit(False))
    if how == "inner":
        rows = rows.where(~null)
    known = F.create_map(*[F.lit(x).cast("long") for kv in salts.items() for x in kv]) if salts else None
    many = F.coalesce(F.try_element_at(known, F.xxhash64(*on)), F.lit(1)) if salts else F.lit(1).cast("long")
    dealt = F.pmod(F.xxhash64(spread, F.lit("salt")), F.when(null, F.lit(parts).cast("long")).otherwise(many))
    salted = rows.withColumn("__salt", dealt)
    copies = side.where(~null).withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")
