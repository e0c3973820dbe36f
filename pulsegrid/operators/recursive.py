"""Recursive (IIR) filters on blocks.

A block's output is its response from rest plus the decaying response to the state it starts with.
The state at a block's start is a sum of earlier blocks' end states, each multiplied by the block
transition matrix once per block passed. That matrix shrinks geometrically for a stable filter, so
only the few blocks whose share exceeds rounding error have to send theirs. All blocks of a record
run in parallel; no task reads a record from start to end.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions import filter_design as D
from pulsegrid.functions.pieces import pieces_udf
from pulsegrid.operators.blocks import KEYS, map_values, with_halo
from pulsegrid.session import cut_lineage

#: Samples that are filtered side by side.
CELLS = 1 << 21
NEGLIGIBLE = 1e-20  # share of an earlier block's state that is below rounding error


def run_sections(x: np.ndarray, sos: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cascade over rows of ``x`` at once. ``sos`` is ``[S, 6]`` or one set per row ``[R, S, 6]``."""
    y = np.array(x, dtype=float)
    state = np.array(state, dtype=float)
    for s in range(sos.shape[-2]):
        b0, b1, b2, _, a1, a2 = np.moveaxis(sos[..., s, :], -1, 0)
        s1, s2 = state[:, 2 * s].copy(), state[:, 2 * s + 1].copy()
        cols = np.ascontiguousarray(y.T)
        for n in range(cols.shape[0]):
            v = cols[n].copy()
            out = b0 * v + s1
            s1 = b1 * v - a1 * out + s2
            s2 = b2 * v - a2 * out
            cols[n] = out
        y = cols.T
        state[:, 2 * s], state[:, 2 * s + 1] = s1, s2
    return y, state


def bounded(sizes: Sequence[int]) -> list[list[int]]:
    """Rows, by number, in groups whose padded grid has at most ``CELLS`` numbers, whatever the Arrow batch
    holds; rows of negative size are left out."""
    groups: list[list[int]] = []
    width = 0
    for i, n in enumerate(sizes):
        if n < 0:
            continue
        if not groups or max(width, n) * (len(groups[-1]) + 1) > CELLS:
            groups.append([])
            width = 0
        groups[-1].append(i)
        width = max(width, n)
    return groups


def state_responses(sos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Outputs (``[2S, length]``) and end states for each unit start state and no input."""
    size = 2 * len(sos)
    return run_sections(np.zeros((size, length)), sos, np.eye(size))


def reach(sos: np.ndarray, block: int) -> int:
    """How many blocks on a block's end state still matters."""
    step = state_responses(sos, block)[1]
    power, n = step.copy(), 1
    while np.abs(power).max() > NEGLIGIBLE:
        power, n = power @ step, n + 1
        if n > 100000 or not np.isfinite(power).all():
            raise ValueError("the filter does not settle; it is unstable or the block is too short")
    return n


def run(blocks: DataFrame, sos: np.ndarray, block: int, keys: Sequence[str] = KEYS,
        backward: bool = False, settled: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Filter along the record (or against it when ``backward``), from rest.

    ``settled`` starts each record in the steady state of its first value. The block that starts a
    record carries ``starts``; without that column it is block 0, or the last one backward.
    Columns named in ``carry`` go with their block.
    """
    sos = np.asarray(sos, float)
    size = 2 * len(sos)
    far = reach(sos, block)
    responses, transition = state_responses(sos, block)
    rest_state = D.steady_state(sos) if settled else np.zeros(size)

    @pieces_udf("struct<y: array<double>, sends: array<double>>")
    def from_rest(values: pd.Series, starts: pd.Series) -> pd.DataFrame:
        parts = [side_by_side(values.iloc[g], starts.iloc[g]) for g in bounded([len(v) for v in values])]
        return pd.DataFrame({"y": [y for p in parts for y in p[0]], "sends": [s for p in parts for s in p[1]]})

    def side_by_side(values: pd.Series, starts: pd.Series) -> tuple[list, list]:
        first = starts.to_numpy(bool)
        rows = [np.asarray(v, float)[::-1] if backward else np.asarray(v, float) for v in values]
        width = max((len(x) for x in rows), default=0)
        lead = np.array([x[0] if settled and f else 0.0 for x, f in zip(rows, first)])
        # Shorter rows are padded in front with what their start state stands for (silence, or the
        # constant first value), which changes neither output nor end state: one run for all rows.
        grid = np.repeat(lead[:, None], width, axis=1)
        for i, x in enumerate(rows):
            grid[i, width - len(x):] = x
        out, end = run_sections(grid, sos, lead[:, None] * rest_state[None, :])
        shares = np.empty((len(rows), far, size))
        shares[:, 0] = end
        for k in range(1, far):
            shares[:, k] = shares[:, k - 1] @ transition
        ys = [y[width - len(x):][::-1] if backward else y[width - len(x):] for y, x in zip(out, rows)]
        return ys, list(shares.reshape(len(rows), -1))

    @pieces_udf("array<double>")
    def add_state(y: pd.Series, states: pd.Series) -> pd.Series:
        longest = max((len(v) for v in y), default=0)
        known = responses if longest <= block else state_responses(sos, longest)[0]
        more = (s @ known[:, :len(v)] for v, s in zip(y, states))
        return pd.Series([v + (m[::-1] if backward else m) for v, m in zip(y, more)])

    marked = blocks if "starts" in blocks.columns else blocks.withColumn(
        "starts", F.col("block") == 0)
    ran = marked.select(*keys, "block", *carry, from_rest("values", "starts").alias("r")).select(
        *keys, "block", *carry, "r.y", "r.sends")
    # The block itself and the states it sends ahead travel in one exchange, keyed by the target.
    hop = F.lit(-1 if backward else 1)
    none_y, none_s = F.lit(None).cast("array<double>"), F.lit(None).cast("array<double>")
    own = F.struct(F.col("block").alias("block"), F.col("y").alias("y"), none_s.alias("s"), *carry)
    blank = [F.lit(None).cast(marked.schema[c].dataType).alias(c) for c in carry]
    # A block that is not full ends its record, and block 0 starts it: nothing lies beyond them.
    ahead = F.col("block") if backward else F.when(F.size("y") < block, 0).otherwise(far)
    hops = F.slice(F.sequence(F.lit(1), F.lit(far)), 1, F.least(F.lit(far), ahead).cast("int"))
    sent = F.transform(hops, lambda i: F.struct(
        (F.col("block") + hop * i).cast("long").alias("block"), none_y.alias("y"),
        F.slice("sends", (i - 1) * size + 1, F.lit(size)).alias("s"), *blank))
    spread = ran.select(*keys, F.explode_outer(F.concat(F.array(own), sent)).alias("p")).select(*keys, "p.*")
    sums = [F.coalesce(F.sum(F.get("s", F.lit(k))), F.lit(0.0)).alias(f"__s{k}") for k in range(size)]
    met = spread.groupBy(*keys, "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("y", *carry)], *sums)
    states = F.array(*[F.col(f"__s{k}") for k in range(size)])
    return met.where(F.col("y").isNotNull()).select(*keys, "block", *carry, add_state("y", states).alias("values"))


def low_pass(blocks, block, fs, cutoff, order=2, keys=KEYS):
    """Causal low-pass; the cutoff is divided by ``fs``."""
    return run(blocks, D.butterworth(order, cutoff / fs, "low"), block, keys)


def high_pass(blocks, block, fs, cutoff, order=2, keys=KEYS):
    """Causal high-pass; the cutoff is divided by ``fs``."""
    return run(blocks, D.butterworth(order, cutoff / fs, "high"), block, keys)


def band(blocks: DataFrame, block: int, fs: float, low: float, high: float, order: int = 2,
         keys: Sequence[str] = KEYS) -> DataFrame:
    """Causal band: low-pass at ``high``, then high-pass at ``low``, as one cascade."""
    return run(blocks, D.band_sections(low, high, fs, order), block, keys)


def zero_phase(blocks: DataFrame, sos: np.ndarray, block: int, edge: int | None = None,
               keys: Sequence[str] = KEYS) -> DataFrame:
    """Forward and backward filtering of a record that is continued oddly at both ends.

    The first and last block carry ``edge`` extra samples through both passes; a block's length and
    whether it ends the record go with it, so the input is read once. Records must be longer than
    ``edge`` samples, and ``edge`` at most ``block - 1``.
    """
    sos = np.asarray(sos, float)
    edge = D.edge_length(sos) if edge is None else edge
    if edge >= block:
        raise ValueError(f"blocks of {block} samples are too short for an extension of {edge}")
    keys = list(keys)
    joined = with_halo(blocks, edge + 1, edge + 1, keys)
    is_first, is_last = F.size("before") == 0, F.size("after") == 0
    v = F.col("values")
    empty = F.array().cast("array<double>")
    # The first block may be short of ``edge`` samples of its own only when it is also near the end.
    ahead = F.slice(F.concat(v, F.col("after")), 2, edge)
    head = F.when(is_first, F.transform(F.reverse(ahead), lambda x: 2 * F.get(v, F.lit(0)) - x)).otherwise(empty)
    behind = F.concat(F.col("before"), v)
    back = F.slice(behind, F.greatest(F.size(behind) - edge, F.lit(1)), F.least(F.lit(edge), F.size(behind) - 1))
    tail = F.when(is_last, F.transform(F.reverse(back), lambda x: 2 * F.element_at(v, -1) - x)).otherwise(empty)
    extended = joined.select(*keys, "block", F.concat(head, v, tail).alias("values"), is_first.alias("starts"),
                             is_first.alias("__first"), is_last.alias("__last"), F.size(v).alias("__n"))
    there = run(extended, sos, block, keys, settled=True, carry=("__first", "__last", "__n"))
    back_again = run(there.withColumn("starts", F.col("__last")), sos, block, keys, backward=True, settled=True,
                     carry=("__first", "__n"))
    return back_again.select(*keys, "block", F.slice(
        "values", F.when(F.col("__first"), edge + 1).otherwise(1), F.col("__n")).alias("values"))


def butter_zero_phase(blocks, block, fs, edges, kind, order=4, keys=KEYS):
    """Zero-phase Butterworth ``low``/``high``/``band``/``stop``; edges in Hz over ``fs / 2``."""
    edges = [e / (fs / 2) for e in np.atleast_1d(edges)]
    return zero_phase(blocks, D.butterworth(order, edges, kind), block, keys=keys)


def notch(blocks, block, fs, freq, q=30.0, keys=KEYS):
    """Zero-phase notch at ``freq`` Hz."""
    return zero_phase(blocks, D.notch(freq / (fs / 2), q), block, edge=9, keys=keys)


def notch_chain(blocks, block, fs, freqs, q=55.0, keys=KEYS):
    """Notches in sequence; frequencies at or above the Nyquist rate are skipped.

    The signal is written between notches: the plan of a chain is that of one notch, whatever their number.
    """
    below = [f for f in freqs if f < fs / 2]
    for i, freq in enumerate(below):
        blocks = notch(blocks if i == 0 else cut_lineage(blocks, "notched"), block, fs, freq, q, keys)
    return blocks


def log_smooth(envelopes: DataFrame, block: int, fs: float, cutoff: float = 8.0, order: int = 6,
               keys: Sequence[str] = KEYS) -> DataFrame:
    """Homomorphic smoothing of an envelope: log, zero-phase low-pass, exp."""
    if cutoff >= fs / 2:
        raise ValueError(f"a cutoff of {cutoff} Hz is not below half of fs={fs}")
    eps = float(np.finfo(float).eps)
    logs = map_values(envelopes, lambda x: F.log(F.greatest(x, F.lit(eps))), keys)
    return map_values(butter_zero_phase(logs, block, fs, cutoff, "low", order, keys), F.exp, keys)
