"""Overlapping fixed-length windows (fragments), cropping and padding."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.functions.arrays import bind
from pulsegrid.functions.keyed import pick
from pulsegrid.operators.blocks import KEYS, attach

# Window length in seconds per dataset; every other dataset uses the default.
PRESET_SECONDS = {"cinc": 4.0, "training-a": 4.0, "vest": 2.0}
DEFAULT_SECONDS = 4.0


@dataclass(frozen=True)
class WindowSpec:
    """Window geometry in seconds; lengths in samples round half to even."""

    window_s: float = DEFAULT_SECONDS
    overlap_s: float = 0.25
    pad_s: float = 0.3

    def samples(self, fs: float) -> tuple[int, int, int]:
        """``(start, window, hop)`` in samples."""
        return (round(self.pad_s * fs), round(self.window_s * fs),
                max(1, round((self.window_s - self.overlap_s) * fs)))


def preset(dataset: str) -> WindowSpec:
    return WindowSpec(PRESET_SECONDS.get(dataset, DEFAULT_SECONDS))


def preset_columns(dataset: Column, fs: Column | int) -> list[Column]:
    """Start, window and hop lengths per row, for tables that mix datasets."""
    fs = fs if isinstance(fs, Column) else F.lit(fs)
    spec = WindowSpec()
    pairs = [x for k, v in PRESET_SECONDS.items() for x in (F.lit(k), F.lit(v))]
    seconds = F.coalesce(F.try_element_at(F.create_map(*pairs), dataset), F.lit(DEFAULT_SECONDS))
    whole = lambda x: F.bround(x, 0).cast("long")
    return [whole(fs * spec.pad_s).alias("start"), whole(seconds * fs).alias("win"),
            F.greatest(F.lit(1), whole((seconds - spec.overlap_s) * fs)).alias("hop")]


def window_count(n: Column, start, win, hop) -> Column:
    """Number of windows of an ``n``-sample signal: none up to the pad, else at least one."""
    c = lambda v: v if isinstance(v, Column) else F.lit(v)
    start, win, hop = c(start), c(win), c(hop)
    return F.when(n <= start, F.lit(0)).otherwise(
        F.floor(F.greatest(F.lit(0), n - win - start) / hop) + 1).cast("long")


def fit_length(values: Column, length: int) -> Column:
    """Crop, or pad with zeros, to exactly ``length`` samples."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0), F.lit(length))), 1, length)


def valid_length(values: Column, length: int) -> Column:
    return F.least(F.size(values), F.lit(length))


def windows(blocks: DataFrame, block: int, start: int, win: int, hop: int,
            keys: Sequence[str] = KEYS) -> DataFrame:
    """Windows of long records: ``win_no, start_idx, valid_len, waveform``.

    Each block sends the slices it holds to the windows that cover it; a group is one window.
    """
    sizes = blocks.groupBy(*keys).agg(F.sum(F.size("values")).alias("__n"),
                                      (F.max("block") + 1).alias("__blocks"))
    lo = F.col("block") * block
    hi = lo + F.size("values")
    first = F.greatest(F.lit(0), F.ceil((lo - start - win + 1) / hop))
    last = F.least(F.floor((hi - 1 - start) / hop), window_count(F.col("__n"), start, win, hop) - 1)
    hit = attach(blocks, sizes, keys).where(first <= last).select(
        *keys, "block", "values", F.explode(F.sequence(first, last)).alias("win_no"))
    at = F.lit(start) + F.col("win_no") * hop
    begin = F.greatest(lo, at)
    end = F.least(hi, at + win)
    pieces = hit.select(*keys, "win_no", F.struct(
        begin.alias("b"), F.slice("values", (begin - lo + 1).cast("int"), (end - begin).cast("int"))
        .alias("v")).alias("p"))
    body = F.flatten(F.array_sort(F.collect_list("p")).v)
    return pieces.groupBy(*keys, "win_no").agg(body.alias("__w")).select(
        *keys, "win_no", (F.lit(start) + F.col("win_no") * hop).alias("start_idx"),
        valid_length(F.col("__w"), win).alias("valid_len"),
        fit_length(F.col("__w"), win).alias("waveform"))


def array_windows(rows: DataFrame, values: str, start: int, win: int, hop: int) -> DataFrame:
    """Windows of rows that hold a whole short signal each; no shuffle."""
    n = F.size(values)
    count = window_count(n, start, win, hop)
    numbered = rows.where(count > 0).withColumn(
        "win_no", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    at = F.lit(start) + F.col("win_no") * hop
    chunk = F.slice(values, at + 1, F.lit(win))
    return (numbered.withColumn("start_idx", at).withColumn("valid_len", valid_length(chunk, win))
            .withColumn("waveform", fit_length(chunk, win)))


def random_crop(values: Column, length: int, *key) -> Column:
    """A ``length``-sample piece at a hashed position; shorter signals stay whole."""
    at = pick(F.size(values) - length + 1, *key) + 1
    return F.when(F.size(values) <= length, values).otherwise(
        F.slice(values, at.cast("int"), F.lit(length)))


def pad_batch(rows: DataFrame, batch: str, values: str) -> DataFrame:
    """Zero-pad each signal to the longest of its batch; batches are small by construction."""
    longest = F.max(F.size(values)).over(Window.partitionBy(batch))
    padded = F.concat(F.col(values), F.array_repeat(F.lit(0.0), F.col("__max") - F.size(values)))
    return rows.withColumn("__max", longest).withColumn(values, padded).drop("__max")


def fade(values: Column, n: int = 128) -> Column:
    """Linear fade-in and fade-out over ``n`` samples; signals under ``2n`` stay as they are."""
    top = F.lit(float(n - 1))

    def faded(v):
        gain = lambda i: F.least(F.lit(1.0), i / top, (F.size(v) - 1 - i) / top)
        return F.when(F.size(v) < 2 * n, v).otherwise(F.transform(v, lambda x, i: x * gain(i)))

    return bind(values, faded)
