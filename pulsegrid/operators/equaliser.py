"""Row-wise operators whose coefficients differ per row: random equaliser, gain kernel."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.functions.keyed import between, unit
from pulsegrid.functions.pieces import pieces_udf
from pulsegrid.operators.recursive import NEGLIGIBLE, bounded, run_sections


def band_edges(draws: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Random band edges in Hz from three draws per band: a uniform lower edge; the upper one free
    or at a fixed distance. ``draws`` is ``[rows, bands, 3]``."""
    lo = low + draws[..., 0] * (0.95 * high - low)
    least = lo + 0.05 * (high - low)
    free = least + draws[..., 2] * (high - least)
    return lo, np.where(draws[..., 1] < 0.5, free, lo + (high - low) / draws.shape[1])


def band_sections(lo: np.ndarray, hi: np.ndarray, fs: float) -> np.ndarray:
    """First-order Butterworth band-pass per edge pair, as ``[..., 6]`` sections."""
    a, b = np.tan(np.pi * lo / fs), np.tan(np.pi * hi / fs)
    d = 1.0 + (b - a) + a * b
    g, z = (b - a) / d, np.zeros_like(d)
    return np.stack([g, z, -g, z + 1.0, 2.0 * (a * b - 1.0) / d, (1.0 - (b - a) + a * b) / d], axis=-1)


def coloured(v: Column, draws: Column, fs: float, low: float, high: float) -> Column:
    """Causal random band cascade per row; rows of a batch run side by side, null rows are skipped."""

    @pieces_udf("array<double>")
    def run(values: pd.Series, draws: pd.Series) -> pd.Series:
        out = [None] * len(values)
        for live in bounded([-1 if x is None else len(x) for x in values]):
            sizes = [len(values.iloc[i]) for i in live]
            x = np.zeros((len(live), max(sizes)))
            for j, i in enumerate(live):
                x[j, :sizes[j]] = values.iloc[i]
            u = np.stack([np.stack(draws.iloc[i]) for i in live])
            sos = band_sections(*band_edges(u, low, high), fs)
            y, _ = run_sections(x, sos, np.zeros((len(live), 2 * sos.shape[1])))
            for j, i in enumerate(live):
                out[i] = y[j, :sizes[j]]
        return pd.Series(out)

    # Marked so that the optimizer does not copy the call into every place that uses its result.
    return run.asNondeterministic()(v, draws)


def band_draws(seed, step: str, *key, bands: int = 5) -> Column:
    """Three uniform draws for each of ``bands`` random bands."""
    three = lambda b: F.array(*[unit(seed, step, b, *key, slot=s) for s in range(3)])
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), three)


def _sections(draws: Sequence, fs: float, low: float, high: float) -> np.ndarray:
    return band_sections(*band_edges(np.stack([np.stack(d) for d in draws]), low, high), fs)


def coloured_blocks(blocks: DataFrame, block: int, draws: Column, fs: float, low: float, high: float, keys: Sequence[str],
                    blocks_left: str, bands: int = 5) -> DataFrame:
    """``coloured`` for signals in blocks: adds ``tinted`` to ``keys, block, values, draws and blocks_left``.

    Every signal has filters of its own. A block's response from rest is worked out where the block lies; its end state, multiplied by the
    signal's own transition once per block passed, goes to the later blocks where it exceeds rounding error, of which there are
    ``blocks_left``. So all blocks of a signal run in parallel, and samples move once.
    """
    size, keys = 2 * bands, list(keys)

    @pieces_udf("struct<y: array<double>, sends: array<double>>")
    def from_rest(values: pd.Series, draws: pd.Series, left: pd.Series) -> pd.DataFrame:
        ys, sends = [None] * len(values), [None] * len(values)
        for rows in bounded([len(v) for v in values]):
            sos = _sections(draws.iloc[rows], fs, low, high)
            x = np.zeros((len(rows), max(len(values.iloc[i]) for i in rows)))
            for j, i in enumerate(rows):
                x[j, :len(values.iloc[i])] = values.iloc[i]
            y, end = run_sections(x, sos, np.zeros((len(rows), size)))
            # One sample on, from each unit state: the transition of a sample; a block's is its power.
            step = run_sections(np.zeros((len(rows) * size, 1)), np.repeat(sos, size, axis=0), np.tile(np.eye(size), (len(rows), 1)))[1]
            step = np.linalg.matrix_power(step.reshape(len(rows), size, size), block)
            # Only a full block has blocks behind it, so padding never reaches a state that is sent.
            shares, todo = [[] for _ in rows], left.iloc[rows].to_numpy()
            while (live := (todo > 0) & (np.abs(end).max(axis=1) > NEGLIGIBLE)).any():
                for j in np.flatnonzero(live):
                    shares[j].append(end[j].copy())
                end, todo = np.einsum("ri,rij->rj", end, step), np.where(live, todo - 1, 0)
            for j, i in enumerate(rows):
                ys[i], sends[i] = y[j, :len(values.iloc[i])], np.concatenate(shares[j]) if shares[j] else np.empty(0)
        return pd.DataFrame({"y": ys, "sends": sends})

    @pieces_udf("array<double>")
    def add_state(y: pd.Series, states: pd.Series, draws: pd.Series) -> pd.Series:
        out = [None] * len(y)
        for rows in bounded([len(v) for v in y]):
            width = max(len(y.iloc[i]) for i in rows)
            more, _ = run_sections(np.zeros((len(rows), width)), _sections(draws.iloc[rows], fs, low, high), np.stack(states.iloc[rows].to_list()))
            for j, i in enumerate(rows):
                out[i] = y.iloc[i] + more[j, :len(y.iloc[i])]
        return pd.Series(out)

    drawn = blocks.withColumn("__d", draws)
    ran = drawn.select(*keys, "block", "values", "__d", from_rest.asNondeterministic()("values", "__d", blocks_left).alias("r"))
    none = F.lit(None).cast("array<double>")
    own = F.struct("block", F.col("r.y").alias("y"), F.col("values").alias("v"), F.col("__d").alias("d"), none.alias("s"))
    hops = F.expr(f"size(r.sends) div {size}")
    sent = F.transform(F.when(hops > 0, F.sequence(F.lit(1), hops)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(
        (F.col("block") + i).alias("block"), none.alias("y"), none.alias("v"), F.lit(None).cast("array<array<double>>").alias("d"),
        F.slice("r.sends", (i - 1).cast("int") * size + 1, F.lit(size)).alias("s")))
    spread = ran.select(*keys, F.explode_outer(F.concat(F.array(own), sent)).alias("p")).select(*keys, "p.*")
    sums = [F.coalesce(F.sum(F.get("s", F.lit(k))), F.lit(0.0)).alias(f"__s{k}") for k in range(size)]
    firsts = [F.first(c, ignorenulls=True).alias(c) for c in ("y", "v", "d")]
    met = spread.groupBy(*keys, "block").agg(*firsts, *sums).where(F.col("y").isNotNull())
    states = F.array(*[F.col(f"__s{k}") for k in range(size)])
    return met.select(*keys, "block", F.col("v").alias("values"), add_state.asNondeterministic()("y", states, "d").alias("tinted"))


def equalise(v: Column, fs: float, low: float, high: float, seed, step: str, *key, bands: int = 5
             ) -> Column:
    """A fiftieth of a randomly coloured copy blended into the normalised signal."""
    tinted = coloured(v, band_draws(seed, step, *key, bands=bands), fs, low, high)
    return A.abs_max(F.zip_with(A.abs_max(tinted), A.abs_max(v), lambda c, x: c / 50.0 + x))


def gain_kernel(points: np.ndarray, taps: int) -> np.ndarray:
    """Unit-sum kernel through evenly spaced control points, one row per row of ``points``."""
    at = np.linspace(0, points.shape[1] - 1, taps)
    lo = np.minimum(at.astype(int), points.shape[1] - 2)
    k = points[:, lo] + (points[:, lo + 1] - points[:, lo]) * (at - lo)
    return k / k.sum(axis=1, keepdims=True)


def warp(v: Column, seed, step: str, *key, points: int = 12, taps: int = 65) -> Column:
    """Smoothing by a random unit-sum gain kernel, with reflected ends."""
    control = F.array(*[between(0.7, 1.3, seed, step, n, *key) for n in range(points)])

    @pieces_udf("array<double>")
    def apply(values: pd.Series, ctl: pd.Series) -> pd.Series:
        kernels = gain_kernel(np.stack(ctl.to_numpy()), taps)
        return pd.Series([np.correlate(np.pad(x, taps // 2, mode="reflect"), k, "valid")
                          for x, k in zip(values, kernels)])

    return apply(v, control)
