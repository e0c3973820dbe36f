"""Small numeric column helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_even(x: Column) -> Column:
    """Round to an integer, ties to the even neighbour."""
    return F.bround(x, 0).cast("long")


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, and 0 where the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def tidy(x: Column, places: int = 6) -> Column:
    """Rounded for reports and comparisons, with negative zero folded into zero."""
    return F.round(x, places) + F.lit(0.0)


def binary_label(raw: Column) -> Column:
    """1 for abnormal (raw label 1), 0 for every other encoding."""
    return F.when(raw.cast("int") == 1, F.lit(1)).otherwise(F.lit(0))
