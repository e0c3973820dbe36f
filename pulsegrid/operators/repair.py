"""Gap filling and spike removal on long records."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from pulsegrid.functions.pieces import pieces_udf
from pulsegrid.operators.blocks import KEYS
from pulsegrid.operators.ranking import carry_ends, rank_median, split_rank
from pulsegrid.session import cut_lineage

FLOOR = 1e-4  # value a removed spike is set to


def fill_gaps(blocks: DataFrame, block: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Linear interpolation over null or NaN samples; the ends hold the nearest valid sample.

    The nearest valid samples of earlier and later blocks are carried over summaries with one row
    per block. Records without any valid sample stay as they are.
    """
    keys = list(keys)
    base = F.col("block") * block
    points = F.filter(F.transform("values", lambda x, i: F.struct((base + i).alias("i"), x.alias("x"))),
                      lambda p: p.x.isNotNull() & ~F.isnan(p.x))
    tips = blocks.withColumn("__pts", points).select(
        *keys, "block", F.try_element_at("__pts", F.lit(-1)).alias("__last"),
        F.try_element_at("__pts", F.lit(1)).alias("__first"))
    ends = carry_ends(tips, keys, "block", "__last", "__first").select(
        *keys, "block", F.col("prev.i").alias("pi"), F.col("prev.x").alias("px"),
        F.col("next.i").alias("ni"), F.col("next.x").alias("nx"))

    @pieces_udf("array<double>")
    def fill(number: pd.Series, values: pd.Series, pi: pd.Series, px: pd.Series, ni: pd.Series,
             nx: pd.Series) -> pd.Series:
        out = []
        for n, v, a, ax, b, bx in zip(number, values, pi, px, ni, nx):
            v = np.array(v, dtype=float)
            bad = np.isnan(v)
            if bad.any():
                at = np.flatnonzero(~bad)
                know = [(a - n * block, ax)] if not np.isnan(ax) else []
                know += list(zip(at, v[at]))
                know += [(b - n * block, bx)] if not np.isnan(bx) else []
                if know:
                    v[bad] = np.interp(np.flatnonzero(bad), *zip(*know))
            out.append(v)
        return pd.Series(out)

    return blocks.join(ends, [*keys, "block"]).select(
        *keys, "block", fill("block", "values", "pi", "px", "ni", "nx").alias("values"))


def window_peaks(windows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Largest magnitude per analysis window (``values`` of block form)."""
    return windows.select(*keys, "block", F.array_max(F.transform("values", F.abs)).alias("maa"))


def peak_medians(windows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Median over a record's windows of the largest magnitude per window."""
    return rank_median(window_peaks(windows, keys), keys, "maa", out="median_maa")


def sign_changes(samples: DataFrame, win: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Positions inside each analysis window after which the sign flips."""
    w = Window.partitionBy(*keys, "win").orderBy("idx")
    cut = samples.withColumn("win", F.expr(f"idx div {win}"))
    flip = F.abs(F.signum(F.lead("value").over(w)) - F.signum("value")) > 1
    return (cut.withColumn("crossing", F.coalesce(flip, F.lit(False)))
            .withColumn("pos", F.expr(f"idx % {win}")))


def spike_bounds(samples: DataFrame, win: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per analysis window: peak position, and the ``[start, stop)`` range of the spike around it."""
    cut = sign_changes(samples, win, keys)
    group = Window.partitionBy(*keys, "win")
    peak = F.max(F.struct(F.abs("value").alias("a"), (-F.col("pos")).alias("p"))).over(group)
    at = cut.withColumn("peak", -peak.p)
    hit = F.col("crossing")
    return at.groupBy(*keys, "win", "peak").agg(
        F.coalesce(F.max(F.when(hit & (F.col("pos") < F.col("peak")), F.col("pos") + 1)),
                   F.lit(0)).alias("start"),
        F.coalesce(F.min(F.when(hit & (F.col("pos") >= F.col("peak")), F.col("pos"))),
                   F.max("pos")).alias("stop"))


def _flatten_once(w: np.ndarray) -> bool:
    """Flatten the spike around the window's peak in place; False if nothing changed."""
    peak = int(np.argmax(np.abs(w)))
    flips = np.flatnonzero(np.abs(np.diff(np.sign(w))) > 1)
    cut = int(np.searchsorted(flips, peak))
    start = flips[cut - 1] + 1 if cut > 0 else 0
    stop = flips[cut] if cut < len(flips) else len(w) - 1
    changed = stop > start and bool(np.any(w[start:stop] != FLOOR))
    w[start:stop] = FLOOR
    return changed


def _settle(pdf: pd.DataFrame, threshold: float, rounds: int) -> pd.DataFrame:
    """Rounds of flattening over one record's loudest windows.

    The other windows are never touched; they take part only through the median. Rows without
    ``values`` are those around the middle rank; the rows left out lie below or above every median
    that can occur.
    """
    top = pdf[pdf["values"].notna()].sort_values("block")
    total = int(pdf["__n"].iloc[0])
    rest = np.sort(pdf.loc[pdf["values"].isna(), "maa"].to_numpy())
    wins = [np.array(v, dtype=float) for v in top["values"]]
    maa = np.array([np.abs(w).max() for w in wins])
    touched = np.zeros(len(wins), dtype=bool)
    # Windows that are quieter than every row kept here.
    below = total - int(pdf["__rank"].max())
    middle = [(total - 1) // 2, total // 2]
    stuck = False
    for _ in range(rounds):
        known = np.sort(np.concatenate([rest, maa]))
        # Touched windows may fall under the rows left out below; count those that do.
        low = rest[0] if below and len(rest) else -np.inf
        fell = int(np.sum(maa < low))
        median = np.mean([known[fell:][m - below - fell] for m in middle])
        if median == 0 or not maa.max() > threshold * median:
            break
        w = int(np.argmax(maa))
        touched[w] = True
        if not _flatten_once(wins[w]):
            stuck = True  # further rounds would pick the same window again and change nothing
            break
        maa[w] = np.abs(wins[w]).max()
    else:
        stuck = True
    out = top.loc[touched, ["block"]].copy()
    out["__new"] = [wins[i] for i in np.flatnonzero(touched)]
    out["unresolved"] = stuck
    return out


def remove_spikes(windows: DataFrame, win: int, threshold: float = 3.0, rounds: int = 1000,
                  keys: Sequence[str] = KEYS) -> DataFrame:
    """Flatten spikes window by window until none exceeds ``threshold`` x the median peak.

    ``windows`` is block form with ``block == win`` (half a second). At most ``rounds`` windows can
    change, and they are among the ``rounds`` loudest; the median can move by at most ``rounds``
    ranks. So a record contributes at most that many windows and about twice as many bare peaks
    to one task, however long it is. A trailing partial window and records shorter than one window
    stay as they are. ``unresolved`` marks records in which a spike could not be flattened.
    """
    keys = list(keys)
    full = windows.where(F.size("values") == win)
    peaks = window_peaks(full, keys).withColumn("__neg", -F.col("maa"))
    # Sixteen buckets per octave, loudest first.
    loud = F.when(F.col("maa") > 0, -F.floor(F.log2("maa") * 16)).otherwise(F.lit(100000)).cast("long")
    # One row per window, read three times below: written once.
    ranked = cut_lineage(split_rank(peaks, keys, ["__neg", "block"], loud, "__rank", size="__n"), "peaks")
    half = F.col("__n") / 2
    near = F.col("__rank").between(F.floor(half) - rounds - 1, F.floor(half) + rounds + 2)
    loudest = F.col("__rank") <= rounds
    # Records whose loudest window is within bounds need no work at all.
    middle = ranked.where(F.col("__rank").isin(F.floor((F.col("__n") + 1) / 2), F.floor(half) + 1))
    first = middle.groupBy(*keys).agg(F.avg("maa").alias("__median"))
    noisy = (ranked.where(F.col("__rank") == 1).join(first, keys)
             .where((F.col("__median") > 0) & (F.col("maa") > threshold * F.col("__median")))
             .select(*keys))
    kept = ranked.where(loudest | near).join(noisy, keys, "left_semi")
    bodies = full.select(*keys, "block", "values")
    cand = (kept.join(bodies, [*keys, "block"])
            .select(*keys, "block", "maa", "__n", "__rank", F.when(loudest, F.col("values")).alias("values")))
    fields = full.select(*keys, "block").schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)

    def settle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = _settle(pdf, threshold, rounds)
        for name, value in zip(keys, key):
            out[name] = value
        return out[[*keys, "block", "__new", "unresolved"]]

    changed = cand.groupBy(*keys).applyInPandas(
        settle, f"{schema}, __new array<double>, unresolved boolean")
    return (windows.join(changed, [*keys, "block"], "left")
            .select(*keys, "block", F.coalesce("__new", "values").alias("values"),
                    F.coalesce("unresolved", F.lit(False)).alias("unresolved")))
