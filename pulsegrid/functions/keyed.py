"""Keyed-hash randomness: draws that depend on the row's key, never on its partition.

Every random choice is a function of ``seed:purpose:row key``. A task that is re-run, a table with
another partitioning, and a second engine all see the same draws.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

_SCALE = 4294967296.0


def digest(*parts) -> Column:
    """Hex digest of the colon-joined parts; literals may be given as plain values."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]).cast("binary"))


def _word(hexed: Column, slot: int) -> Column:
    return F.conv(F.substring(hexed, 1 + 8 * slot, 8), 16, 10).cast("double") / F.lit(_SCALE)


def unit(*parts, slot: int = 0) -> Column:
    """Uniform draw in [0, 1); ``slot`` 0..3 gives four independent draws from one digest."""
    return _word(digest(*parts), slot)


def between(lo, hi, *parts, slot: int = 0) -> Column:
    return F.lit(lo) + unit(*parts, slot=slot) * (F.lit(hi) - F.lit(lo))


def chance(p: float, *parts) -> Column:
    """Bernoulli gate with probability ``p``."""
    return unit(*parts) < F.lit(float(p))


def pick(n, *parts, slot: int = 0) -> Column:
    """Integer draw in ``0..n-1``."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.floor(unit(*parts, slot=slot) * n).cast("long")


def gaussian(*parts) -> Column:
    """Standard normal draw (Box-Muller on two words of one digest)."""
    def draw(hexed: Column) -> Column:
        radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - _word(hexed, 0)))
        return radius * F.cos(F.lit(2.0 * math.pi) * _word(hexed, 1))

    # As the variable of a lambda the digest is worked out once.
    return F.get(F.transform(F.array(digest(*parts)), draw), F.lit(0))
