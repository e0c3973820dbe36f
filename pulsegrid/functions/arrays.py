"""Column functions on one fragment's samples (``ARRAY<DOUBLE>``), evaluated inside the JVM.

``bind`` names an intermediate value for reuse. Without it, a figure used inside ``transform`` would
be worked out again for every sample.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from pulsegrid.functions.keyed import between, gaussian, pick, unit

NOISE_STDS = (0.0001, 0.001, 0.01)  # fixed values: white-noise levels
SLOW_AND_FAST = ((0.05, 0.5), (0.001, 0.05))  # fixed values: modulation frequency ranges in Hz


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def as_doubles(v) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def clip(x: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def fill_gaps(v: Column) -> Column:
    """Linear interpolation over null or NaN samples; the ends hold the nearest valid one. Without any valid
    sample the array stays as it is."""

    def filled(c):
        points = F.filter(F.transform(c, lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
                          lambda p: p.x.isNotNull() & ~F.isnan(p.x))

        def between_points(p):
            first, last = F.get(p, F.lit(0)), F.element_at(p, -1)
            steps = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.transform(
                F.sequence(F.lit(0), b.i - a.i - 1), lambda k: a.x + (b.x - a.x) / (b.i - a.i) * k))
            return F.when(F.size(p) == 0, c).otherwise(F.concat(
                F.array_repeat(first.x, first.i), F.flatten(steps), F.array_repeat(last.x, F.size(c) - last.i)))

        return bind(points, between_points)

    return bind(v, lambda c: F.when(F.exists(c, lambda x: x.isNull() | F.isnan(x)), filled(c)).otherwise(c))


def abs_max(v: Column) -> Column:
    """Gaps filled, zero mean, peak magnitude 1; a constant signal becomes 0, one without a valid sample stays."""

    def scaled(c):
        figures = F.struct(mean(c).alias("m"), F.array_min(c).alias("lo"), F.array_max(c).alias("hi"))
        return bind(figures, lambda s: bind(
            F.greatest(s.hi - s.m, s.m - s.lo),
            lambda p: F.transform(c, lambda x: F.when(p > 0, clip((x - s.m) / p)).otherwise(x - s.m))))

    valid = lambda c: F.exists(c, lambda x: ~F.isnan(x))
    return bind(fill_gaps(as_doubles(v)), lambda c: F.when(valid(c), scaled(c)).otherwise(c))


def min_max(v: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    """Rescaled to [lo, hi]; a constant signal becomes the midpoint."""

    def scaled(c):
        ends = F.struct(F.array_min(c).alias("a"), F.array_max(c).alias("b"))
        return bind(ends, lambda s: F.transform(c, lambda x: F.when(
            s.b <= s.a, F.lit((lo + hi) / 2)).otherwise((x - s.a) / (s.b - s.a) * (hi - lo) + lo)))

    return bind(v, scaled)


def z_score(v: Column) -> Column:
    def scaled(c):
        return bind(mean(c), lambda m: bind(
            F.sqrt(total(F.transform(c, lambda x: (x - m) * (x - m))) / F.size(c)),
            lambda s: F.transform(c, lambda x: (x - m) / (s + 1e-8))))

    return bind(v, scaled)


def k_peak(v: Column, k: int = 3, lo: float = -1.0, hi: float = 1.0) -> Column:
    """Min-max with the mean of the k smallest and k largest samples as the range."""

    def scaled(c):
        ends = F.struct(mean(F.slice(F.sort_array(c), 1, k)).alias("a"),
                        mean(F.slice(F.sort_array(c, False), 1, k)).alias("b"))
        return bind(ends, lambda s: F.transform(c, lambda x: F.when(
            s.b <= s.a, F.lit((lo + hi) / 2)).otherwise(
            F.lit(lo) + (x - s.a) / (s.b - s.a) * (hi - lo))))

    return bind(v, scaled)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def mix_down(channels: Column) -> Column:
    """Sample-wise mean over equally long channels."""
    return bind(channels, lambda cs: F.transform(
        F.aggregate(F.slice(cs, 2, F.greatest(F.size(cs) - 1, F.lit(0))), F.get(cs, F.lit(0)), add),
        lambda x: x / F.size(cs)))


def align(channels: Column) -> Column:
    """Cut every channel to the shortest one."""
    return bind(channels, lambda cs: bind(
        F.array_min(F.transform(cs, F.size)),
        lambda n: F.transform(cs, lambda c: F.slice(c, F.lit(1), n))))


def select_channels(channels: Column, names) -> Column:
    """Channels by name, in the asked order; names that are absent are skipped."""
    wanted = F.array(*[F.lit(str(n)) for n in names])
    found = F.transform(wanted, lambda n: F.get(F.filter(channels, lambda c: c["name"] == n), F.lit(0)))
    return F.filter(found, lambda c: c.isNotNull())


def _at(first: Column | None, i: Column) -> Column:
    """Number of a sample in its signal, for an array that begins at sample ``first`` (None: at 0)."""
    return i if first is None else first + i


def raw_noise(v: Column, seed, step: str, *key, first: Column | None = None) -> Column:
    """Additive normal noise at one of three levels."""
    stds = F.array(*[F.lit(s) for s in NOISE_STDS])
    level = (F.get(stds, pick(3, seed, step, "std", *key).cast("int"))
             * between(0.0, 0.1, seed, step, "scale", *key))
    return bind(level, lambda g: F.transform(
        v, lambda x, i: x + g * gaussian(seed, step, *key, _at(first, i))))


def white_noise(v: Column, seed, step: str, *key) -> Column:
    """Additive normal noise, then abs-max."""
    return abs_max(raw_noise(v, seed, step, *key))


def _sines(seed, step: str, fs: float, amp, key) -> Column:
    """Two sine terms (amplitude, frequency, phase) from one draw each, as a struct array."""
    terms = [F.struct(between(amp[0], amp[1], seed, step, n, *key, slot=0).alias("a"),
                      between(lo, hi, seed, step, n, *key, slot=1).alias("f"),
                      unit(seed, step, n, *key, slot=2).alias("p"))
             for n, (lo, hi) in enumerate(SLOW_AND_FAST)]
    return F.array(*terms)


def _wave(terms: Column, i: Column, fs: float) -> Column:
    wave = lambda t: t.a * F.sin(F.lit(2 * math.pi) * (t.f * (i / F.lit(float(fs))) + t.p))
    return wave(F.get(terms, F.lit(0))) + wave(F.get(terms, F.lit(1)))


def slow_gain(v: Column, fs: float, seed, step: str, *key, first: Column | None = None) -> Column:
    """Slow and fast sinusoidal volume change, without normalising."""
    return bind(_sines(seed, step, fs, (0.01, 0.25), key),
                lambda t: F.transform(v, lambda x, i: x * (1.0 + _wave(t, _at(first, i), fs))))


def volume(v: Column, fs: float, seed, step: str, *key) -> Column:
    return abs_max(slow_gain(v, fs, seed, step, *key))


def drift(v: Column, fs: float, seed, step: str, *key, first: Column | None = None) -> Column:
    """Slow and fast additive baseline drift, without normalising."""
    return bind(_sines(seed, step, fs, (0.01, 0.2), key),
                lambda t: F.transform(v, lambda x, i: x + _wave(t, _at(first, i), fs)))


def wander(v: Column, fs: float, seed, step: str, *key) -> Column:
    """Slow and fast additive baseline drift, then abs-max."""
    return abs_max(drift(v, fs, seed, step, *key))


def stretch(v: Column, rate: Column, keep_length: bool = False) -> Column:
    """Time scaling by linear interpolation at ``i * rate``; pitch moves with the rate."""

    def read(c, r):
        n = F.size(c)
        count = (F.floor((n - 1) / r) + 1).cast("int")
        count = F.least(count, n) if keep_length else count
        at = lambda i: bind(F.struct((i * r).alias("t"), F.floor(i * r).cast("int").alias("k")),
                            lambda p: F.get(c, p.k) + (p.t - p.k) * (
                                F.get(c, F.least(p.k + 1, n - 1)) - F.get(c, p.k)))
        return F.transform(F.sequence(F.lit(0), count - 1), at)

    return bind(F.struct(v.alias("c"), rate.alias("r")),
                lambda b: F.when(F.size(b.c) > 0, read(b.c, b.r)).otherwise(b.c))


def chirp(v: Column, fs: float) -> Column:
    """Adds a linear sweep from 0 to half the rate, scaled to the signal's peak (at least 0.5)."""

    def added(c):
        n = F.size(c)
        end = (n - 1) / F.lit(float(fs))
        sweep = F.transform(c, lambda x, i: F.cos(
            F.lit(2 * math.pi) * (fs / 4.0) * (i / F.lit(float(fs))) * (i / F.lit(float(fs))) / end))
        size = lambda a: F.array_max(F.transform(a, F.abs))
        return bind(sweep, lambda w: bind(
            F.greatest(F.lit(0.5), size(c)) / F.when(size(w) == 0, 1.0).otherwise(size(w)),
            lambda g: F.zip_with(c, w, lambda x, y: x + g * y)))

    return bind(v, lambda c: F.when(F.size(c) > 1, added(c)).otherwise(c))
