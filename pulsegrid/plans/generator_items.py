"""Generator training items: normalised (or cycle-rearranged) crops and their log-mel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.operators import cycles as Y
from pulsegrid.operators.blocks import KEYS, attach
from pulsegrid.operators.normalise import abs_max
from pulsegrid.operators.spectra import MelSpec, log_mel
from pulsegrid.operators.windows import fade, fit_length
from pulsegrid.session import cut_lineage


def record_lengths(blocks: DataFrame) -> DataFrame:
    """Samples per record: its shortest channel."""
    per = blocks.groupBy(*KEYS).agg(F.sum(F.size("values")).alias("n"))
    return per.groupBy("record_id").agg(F.min("n").alias("n"))


def plain_heads(blocks: DataFrame, block: int, crop: int, ramp: int) -> DataFrame:
    """First ``crop`` samples per signal, with the fades of the whole signal applied."""
    sizes = blocks.groupBy(*KEYS).agg(F.sum(F.size("values")).alias("__n"),
                                      (F.max("block") + 1).alias("__blocks"))
    near = attach(blocks.where(F.col("block") * block < crop), sizes)
    top = F.lit(float(ramp - 1))
    at = lambda i: F.col("block") * block + i
    gain = lambda i: F.when(F.col("__n") < 2 * ramp, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), at(i) / top, (F.col("__n") - 1 - at(i)) / top))
    faded = near.select(*KEYS, F.struct("block", F.transform(
        "values", lambda x, i: x * gain(i)).alias("v")).alias("p"))
    return faded.groupBy(*KEYS).agg(F.flatten(F.array_sort(F.collect_list("p")).v).alias("values"))


def items(blocks: DataFrame, block: int, cuts: DataFrame, mel: MelSpec, frames: int, seed=0,
          prob_contiguous: float = 0.0, fade_samples: int = 40, ramp: int = 128) -> DataFrame:
    """``(record_id, channel, values, rebuilt, mel, chirp)`` with ``frames * hop`` samples each.

    Records with at least two cycles are rebuilt from rearranged cycles, all channels in the same
    order; the others keep their own start.
    """
    crop = frames * mel.hop
    normal = abs_max(blocks)
    # One row per cycle, read several times below: written once.
    cycles = cut_lineage(Y.split_cycles(cuts, record_lengths(blocks)), "cycles")
    ordered = cut_lineage(Y.rearrange(cycles.where(F.col("cycles") >= 2), seed, prob_contiguous), "order")
    bodies = Y.cycle_bodies(Y.needed_cycles(ordered, crop, fade_samples), normal, block, crop + fade_samples + ramp)
    made = Y.rebuild(bodies, crop, fade_samples).withColumn("values", fade(F.col("values"), ramp))
    rest = plain_heads(normal, block, crop, ramp).join(
        ordered.select("record_id").distinct(), "record_id", "left_anti")
    both = (made.withColumn("rebuilt", F.lit(True))
            .unionByName(rest.withColumn("rebuilt", F.lit(False))))
    fitted = both.withColumn("values", fit_length(F.col("values"), crop))
    return (fitted.withColumn("mel", log_mel(F.col("values"), mel, frames))
            .withColumn("chirp", A.chirp(F.col("values"), float(mel.fs))))
