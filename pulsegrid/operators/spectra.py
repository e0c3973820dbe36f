"""Spectral tables of fragments: magnitudes, log-mel features, soft masks, exact envelopes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.keyed import between, pick
from pulsegrid.functions.pieces import pieces_udf

# Upper mel edge in Hz per signal kind.
MEL_TOP = {"ecg": 200.0, "pcg": 500.0, "pcg_ref": 500.0}


@dataclass(frozen=True)
class MelSpec:
    """Geometry of a log-mel table; ``win`` defaults to ``n_fft``."""

    fs: int
    n_fft: int
    hop: int
    win: int | None = None
    n_mels: int = 80
    f_min: float = 0.125
    f_max: float = 500.0

    def window(self) -> np.ndarray:
        """Periodic Hann window, centred in the frame, divided by its root energy."""
        size = self.win or self.n_fft
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
        left = (self.n_fft - size) // 2
        return np.pad(w, (left, self.n_fft - size - left)) / np.sqrt((w ** 2).sum())

    def filterbank(self) -> np.ndarray:
        """Triangles on the mel scale, shape ``[n_fft // 2 + 1, n_mels]``."""
        mel = lambda f: 2595.0 * np.log10(1.0 + f / 700.0)
        points = 700.0 * (10.0 ** (np.linspace(mel(self.f_min), mel(self.f_max), self.n_mels + 2)
                                   / 2595.0) - 1.0)
        freqs = np.linspace(0, self.fs // 2, self.n_fft // 2 + 1)[:, None]
        rise = (freqs - points[:-2]) / (points[1:-1] - points[:-2])
        fall = (points[2:] - freqs) / (points[2:] - points[1:-1])
        return np.maximum(0.0, np.minimum(rise, fall))


def conditioning(generator: str, signal: str) -> tuple[MelSpec, int]:
    """Mel geometry and crop frames of the two generators, by name."""
    top = MEL_TOP.get(signal, 500.0)
    # Rate, frame and hop lengths of the two feature sets.
    presets = {"diffwave": (MelSpec(4000, 1024, 256, None, 80, f_max=top), 96),
               "wavegrad": (MelSpec(4000, 2048, 300, 1200, 128, f_max=top), 96)}
    if generator.lower() not in presets:
        raise ValueError(f"unknown generator {generator!r}; known: {sorted(presets)}")
    return presets[generator.lower()]


def _frames(x: np.ndarray, n_fft: int, hop: int) -> np.ndarray:
    padded = np.pad(x, n_fft // 2, mode="reflect")
    return np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop]


def magnitudes(values: Column, n_fft: int, hop: int, window: np.ndarray) -> Column:
    """Centred short-time magnitudes ``[frame][bin]``."""

    @pieces_udf("array<array<double>>")
    def apply(xs: pd.Series) -> pd.Series:
        return pd.Series([list(np.abs(np.fft.rfft(_frames(np.asarray(x, float), n_fft, hop) * window)))
                          for x in xs])

    return apply(values)


def log_mel(values: Column, spec: MelSpec, frames: int) -> Column:
    """Log-mel table ``[frame][mel]`` in [0, 1], cut or padded with zeros to ``frames``."""
    window, bank = spec.window(), spec.filterbank()

    @pieces_udf("array<array<double>>")
    def apply(xs: pd.Series) -> pd.Series:
        out = []
        for x in xs:
            mel = np.abs(np.fft.rfft(_frames(np.asarray(x, float), spec.n_fft, spec.hop) * window)) @ bank
            db = 20.0 * np.log10(np.maximum(mel, 1e-5)) - 20.0
            scaled = np.clip((db + 100.0) / 100.0, 0.0, 1.0)[:frames]
            out.append(list(np.pad(scaled, ((0, frames - len(scaled)), (0, 0)))))
        return pd.Series(out)

    return apply(values)


def analytic_envelope(values: Column) -> Column:
    """Exact amplitude envelope of a fragment by its analytic signal."""

    @pieces_udf("array<double>")
    def apply(xs: pd.Series) -> pd.Series:
        out = []
        for x in xs:
            n = len(x)
            keep = np.zeros(n)
            keep[0] = 1
            keep[1:(n + 1) // 2] = 2
            if n % 2 == 0:
                keep[n // 2] = 1
            out.append(np.abs(np.fft.ifft(np.fft.fft(x) * keep)))
        return pd.Series(out)

    return apply(values)


def spectra_table(rows: DataFrame, keys, values: str, n_fft: int, hop: int, window: np.ndarray
                  ) -> DataFrame:
    """``(keys, frame, mags)`` with one row per frame."""
    made = rows.select(*keys, magnitudes(F.col(values), n_fft, hop, window).alias("__m"))
    return made.select(*keys, F.posexplode_outer("__m").alias("frame", "mags"))


#: Numbers that the running median lays out at a time.
MEDIAN_CELLS = 1 << 20


def running_median(x: np.ndarray, size: int) -> np.ndarray:
    """Down each column of ``x``, the median of ``size`` neighbours with mirrored ends; upper middle for even sizes."""
    n, half = len(x), size // 2
    at = (np.arange(n)[:, None] + np.arange(size)[None, :] - half) % (2 * n)
    at = np.minimum(at, 2 * n - 1 - at)
    step = max(1, MEDIAN_CELLS // at.size)
    parts = [np.partition(x[:, i:i + step][at], half, axis=1)[:, half] for i in range(0, x.shape[1], step)]
    return np.concatenate(parts, axis=1)


def soft_mask(x: Column, ref: Column, split_zeros: Column) -> Column:
    """Share of ``x`` against ``ref`` by squared magnitude."""
    z = F.greatest(x, ref)
    share = F.pow(x / z, F.lit(2.0)) / (F.pow(x / z, F.lit(2.0)) + F.pow(ref / z, F.lit(2.0)))
    return F.when(z < 1e-300, F.when(split_zeros, F.lit(0.5)).otherwise(0.0)).otherwise(share)


def soft_masks(spectra: DataFrame, keys, time_size: Column, freq_size: Column,
               margins: tuple[Column, Column]) -> DataFrame:
    """Harmonic and percussive masks ``(keys, frame, bin, mag, harmonic, percussive)``.

    Both medians lie inside one fragment, so its frames (few, by its fixed length) meet as whole rows and no cell
    is shuffled. Sizes depend on the keys only.
    """
    keys = list(keys)

    @pieces_udf("array<struct<h: array<double>, p: array<double>>>")
    def medians(tables: pd.Series, time: pd.Series, freq: pd.Series) -> pd.Series:
        out = []
        for rows, over_time, over_freq in zip(tables, time, freq):
            x = np.stack(list(rows)) if len(rows) else np.zeros((0, 0))
            h, p = (running_median(x, over_time), running_median(x.T, over_freq).T) if x.size else (x, x)
            out.append([{"h": a, "p": b} for a, b in zip(h, p)])
        return pd.Series(out)

    fragments = spectra.where(F.col("mags").isNotNull()).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("frame", "mags"))).alias("__s"))
    with_medians = fragments.withColumn("__m", medians(
        F.transform("__s", lambda c: c["mags"]), time_size.cast("int"), freq_size.cast("int")))
    frames = with_medians.select(*keys, F.explode_outer(F.arrays_zip("__s", "__m")).alias("z")).select(
        *keys, "z.__s.frame", "z.__s.mags", F.col("z.__m.h").alias("h"), F.col("z.__m.p").alias("p"))
    flat = frames.select(*keys, "frame", F.posexplode_outer(F.arrays_zip("mags", "h", "p")).alias("bin", "z")).select(
        *keys, "frame", "bin", F.col("z.mags").alias("mag"), F.col("z.h").alias("__h"), F.col("z.p").alias("__p"))
    m1, m2 = margins
    even = (m1 == 1) & (m2 == 1)
    return flat.select(*keys, "frame", "bin", "mag",
                       soft_mask(F.col("__h"), F.col("__p") * m1, even).alias("harmonic"),
                       soft_mask(F.col("__p"), F.col("__h") * m2, even).alias("percussive"))


def reweight(masks: DataFrame, seed, key) -> DataFrame:
    """Randomly weighted sum of harmonic, percussive and residual magnitudes."""
    w = [between(0.01, 10.0, seed, "weight", i, *key) for i in range(3)]
    rest = 1.0 - F.col("harmonic") - F.col("percussive")
    return masks.withColumn("reweighted", F.col("mag") * (
        w[0] * F.col("harmonic") + w[1] * F.col("percussive") + w[2] * rest))


def drawn_sizes(seed, key, low: int = 5, high: int = 30) -> tuple[Column, Column]:
    """Random median lengths over time and frequency."""
    draw = lambda name: (pick(high - low + 1, seed, "size", name, *key) + low).cast("int")
    return draw("time"), draw("freq")


def drawn_margins(seed, key, high: float = 2.0) -> tuple[Column, Column]:
    return (between(1.0, high, seed, "margin", "h", *key), between(1.0, high, seed, "margin", "p", *key))
