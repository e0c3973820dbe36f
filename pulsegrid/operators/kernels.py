"""Finite-kernel operators on blocks: convolution, sub-bands, resampling, envelopes, beams."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions import filter_design as D
from pulsegrid.functions.pieces import pieces_udf
from pulsegrid.operators.blocks import KEYS, recut, with_halo

# How a record continues beyond its ends.
EDGES = {"zero": {"mode": "constant"}, "reflect": {"mode": "reflect"},
         "odd": {"mode": "reflect", "reflect_type": "odd"}}


def _framed(number, before, values, after, half: int, edge: str) -> np.ndarray:
    """Own samples with ``half`` neighbours per side; missing ones follow the edge rule.

    Only the adjacent blocks are at hand, so an inner block that has too few samples before it is an error: the
    blocks are shorter than the kernel reaches.
    """
    if number > 0 and len(before) < half:
        raise ValueError(f"blocks of {len(before)} samples are shorter than the {half} that a kernel reaches; resize them")
    body = np.concatenate([before, values, after])
    return np.pad(body, (half - len(before), half - len(after)), **EDGES[edge])


def convolve(blocks: DataFrame, kernel: np.ndarray, edge: str = "zero", keys: Sequence[str] = KEYS
             ) -> DataFrame:
    """``y[i] = sum_k h[k] x[i + c - k]`` with an odd-length kernel centred on the sample.

    One exchange carries each block with its halo; a record is never gathered.
    """
    kernel = np.asarray(kernel, float)
    half = len(kernel) // 2

    @pieces_udf("array<double>")
    def apply(number: pd.Series, before: pd.Series, values: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([np.convolve(_framed(n, b, v, a, half, edge), kernel, "valid")
                          for n, b, v, a in zip(number, before, values, after)])

    return with_halo(blocks, half, half, keys).select(
        *keys, "block", apply("block", "before", "values", "after").alias("values"))


def split_bands(blocks: DataFrame, kernels: Sequence[np.ndarray], keys: Sequence[str] = KEYS
                ) -> DataFrame:
    """Zero-phase FIR bands as rows with a ``band`` key; all bands share one exchange."""
    symmetric = [D.zero_phase_kernel(np.asarray(k)) for k in kernels]
    half = len(symmetric[0]) // 2

    @pieces_udf("array<array<double>>")
    def apply(number: pd.Series, before: pd.Series, values: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([[np.convolve(x, k, "valid") for k in symmetric]
                          for x in (_framed(n, b, v, a, half, "odd")
                                    for n, b, v, a in zip(number, before, values, after))])

    wide = with_halo(blocks, half, half, keys).select(
        *keys, "block", apply("block", "before", "values", "after").alias("bands"))
    return wide.select(*keys, "block", F.posexplode_outer("bands").alias("band", "values"))


def four_bands(blocks: DataFrame, fs: float, keys: Sequence[str] = KEYS, **design) -> DataFrame:
    return split_bands(blocks, D.four_bands(fs, **design), keys)


@lru_cache(maxsize=64)
def _bank(fs_in: int, fs_out: int) -> tuple[int, int, int, np.ndarray]:
    """``up, down, reach`` and the weights per phase of the output position between two input samples."""
    up, down, taps = D.resample_kernel(fs_in, fs_out)
    h = np.array(taps)
    half = len(h) // 2
    reach = half // up + 1
    lag = np.arange(up)[:, None] - np.arange(-reach, reach + 1)[None, :] * up + half
    return up, down, reach, np.where((lag >= 0) & (lag < len(h)), h[np.clip(lag, 0, len(h) - 1)], 0.0)


def _resampled(number: int, before, values, after, block: int, fs_in: int, fs_out: int) -> tuple[int, np.ndarray]:
    """The output samples whose position a block holds, and the number of the first."""
    up, down, reach, weights = _bank(fs_in, fs_out)
    base = number * block
    first = -(-base * up // down)
    m = np.arange(first, -(-(base + len(values)) * up // down))
    at, phase = np.divmod(m * down, up)
    x = _framed(number, before[max(0, len(before) - reach):], values, after[:reach], reach, "zero")
    frames = np.lib.stride_tricks.sliding_window_view(x, 2 * reach + 1)[at - base]
    return first, (frames * weights[phase]).sum(axis=1)


def resample(blocks: DataFrame, block: int, fs_in: int, fs_out: int, keys: Sequence[str] = KEYS
             ) -> DataFrame:
    """Rational-rate resampling; output sample ``m`` sits at input position ``m * down / up``.

    Each block makes the output samples whose position it holds, then blocks are re-cut.
    """
    if fs_in == fs_out:
        return blocks
    return _resample(blocks.withColumn("__fs", F.lit(fs_in)), block, fs_out, _bank(fs_in, fs_out)[2], keys)


def resample_mixed(blocks: DataFrame, block: int, fs_out: int, fs: str = "fs", keys: Sequence[str] = KEYS) -> DataFrame:
    """Recordings of any rates in one table, each from the whole-numbered rate in its ``fs`` column to ``fs_out``.

    Filter banks are made per rate and task; block borders follow from each recording's own ratio. The halo is that of the highest rate,
    one number worked out from the table. Recordings that have ``fs_out`` already stay as they are. Each recording has one rate above
    0; one with another or none is refused.
    """
    rates = blocks.agg(F.max(fs), F.min(fs), F.count_if(F.col(fs).isNull())).first()
    if rates[2] or (rates[1] is not None and rates[1] <= 0):
        raise ValueError("every recording needs a rate above 0")
    if rates[0] is None:
        return blocks.select(*keys, "block", "values")
    # A kernel reaches ten input samples, or ten output samples where those lie further apart.
    reach = max(10, 10 * int(rates[0]) // fs_out) + 1
    return _resample(blocks.withColumn("__fs", F.col(fs)), block, fs_out, reach, keys)


def _resample(blocks: DataFrame, block: int, fs_out: int, reach: int, keys: Sequence[str]) -> DataFrame:
    @pieces_udf("struct<first: bigint, values: array<double>>")
    def apply(number: pd.Series, fs: pd.Series, before: pd.Series, values: pd.Series, after: pd.Series
              ) -> pd.DataFrame:
        made = [(n * block, v) if r == fs_out else _resampled(n, b, v, a, block, int(r), fs_out)
                for n, r, b, v, a in zip(number, fs, before, values, after)]
        return pd.DataFrame({"first": [m[0] for m in made], "values": [m[1] for m in made]})

    rated = [*keys, "__fs"]
    made = with_halo(blocks, reach, reach, rated).select(
        *keys, apply("block", "__fs", "before", "values", "after").alias("r"))
    return recut(made.select(*keys, F.col("r.first").alias("__f"), F.col("r.values").alias("__v")),
                 "__f", "__v", block, keys)


def hilbert_kernel(taps: int) -> np.ndarray:
    """Odd-length Hamming-windowed Hilbert transformer."""
    m = np.arange(taps) - taps // 2
    h = np.where(m % 2 != 0, 2.0 / (np.pi * np.where(m == 0, 1, m)), 0.0)
    return h * np.hamming(taps)


def envelope(blocks: DataFrame, taps: int = 255, keys: Sequence[str] = KEYS) -> DataFrame:
    """Amplitude envelope of a long record by a finite Hilbert transformer."""
    kernel = hilbert_kernel(taps)
    half = taps // 2

    @pieces_udf("array<double>")
    def apply(number: pd.Series, before: pd.Series, values: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([np.hypot(v, np.convolve(_framed(n, b, v, a, half, "zero"), kernel, "valid"))
                          for n, b, v, a in zip(number, before, values, after)])

    return with_halo(blocks, half, half, keys).select(
        *keys, "block", apply("block", "before", "values", "after").alias("values"))


def sinc_weights(delays: np.ndarray, taps: int) -> np.ndarray:
    """Unit-sum Hamming-sinc weights per sample for fractional delays, shape ``[T, taps]``."""
    t = np.arange(taps) - taps // 2
    k = np.sinc(t[None, :] - delays[:, None]) * np.hamming(taps)[None, :]
    return k / k.sum(axis=1, keepdims=True)


def delay_energy(rows: DataFrame, values: str, delays: str, taps: int = 41, out: str = "energy"
                 ) -> DataFrame:
    """Squared, fractionally delayed channel of a fragment; one row per fragment and channel."""
    half = taps // 2

    @pieces_udf("array<double>")
    def apply(x: pd.Series, by: pd.Series) -> pd.Series:
        outs = []
        for v, d in zip(x, by):
            padded = np.pad(np.asarray(v, float), half, mode="reflect")
            frames = np.lib.stride_tricks.sliding_window_view(padded, taps)
            outs.append((frames * sinc_weights(np.asarray(d, float), taps)).sum(axis=1) ** 2)
        return pd.Series(outs)

    return rows.withColumn(out, apply(values, delays))


def beam(rows: DataFrame, keys: Sequence[str], values: str = "values", delays: str = "delays",
         taps: int = 41) -> DataFrame:
    """Sum over the channels of a fragment of the squared delayed signals, per sample.

    A fragment's channels, as many as the device has, meet as whole arrays; a shorter one counts as silence beyond its end.
    """
    silent = lambda x: F.coalesce(x, F.lit(0.0))
    fragments = delay_energy(rows, values, delays, taps).groupBy(*keys).agg(F.collect_list("energy").alias("__e"))
    total = F.aggregate("__e", F.array().cast("array<double>"), lambda s, e: F.zip_with(s, e, lambda a, b: silent(a) + silent(b)))
    return fragments.select(*keys, F.posexplode_outer(total).alias("idx", "value"))
