"""Cycles between cut points: cutting, rearranging, and cross-faded rebuilding."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pulsegrid.functions.keyed import digest, pick, unit
from pulsegrid.functions.numeric import half_even
from pulsegrid.functions.pieces import pieces_udf
from pulsegrid.operators.blocks import KEYS, salted_join
from pulsegrid.operators.ranking import carry_ends, hash_bucket, split_cumsum, split_rank

CYCLE_SCHEMA = "record_id STRING, segments ARRAY<ARRAY<BIGINT>>, last_index BIGINT, fs DOUBLE"

FLAT = 1e-5  # fixed value: ends with less variance fade linearly


def read_cycles(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Segmentation files; without a ``record_id`` field the file name gives the record."""
    rows = spark.read.schema(CYCLE_SCHEMA).option("multiLine", multiline).json(path)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return rows.withColumn("record_id", F.coalesce("record_id", stem))


def cut_points(cycles: DataFrame, fs_out: float) -> DataFrame:
    """Distinct first indices above 0 of all groups, rescaled to ``fs_out``."""
    first = cycles.select("record_id", "fs", F.explode_outer("segments").alias("g")).select(
        "record_id", "fs", F.get("g", F.lit(0)).alias("cut"))
    rows = first.where(F.col("cut") > 0).distinct()
    scaled = F.when(F.col("fs") == fs_out, F.col("cut")).otherwise(
        half_even(F.col("cut") * F.lit(float(fs_out)) / F.col("fs")))
    return rows.select("record_id", scaled.alias("cut"))


def split_cycles(cuts: DataFrame, lengths: DataFrame, span: int = 1_000_000) -> DataFrame:
    """``(record_id, cycle_no, start_idx, end_idx)`` between consecutive cut points inside a record.

    Cut points are grouped in slices of ``span`` samples: the next cut of a slice's last one is
    carried over from the following slice.
    """
    inside = (salted_join(cuts, lengths, "record_id", F.col("cut")).where((F.col("cut") > 0) & (F.col("cut") < F.col("n")))
              .select("record_id", "cut").distinct()
              .withColumn("slice", F.expr(f"cut div {span}")))
    w = Window.partitionBy("record_id", "slice").orderBy("cut")
    firsts = inside.groupBy("record_id", "slice").agg(F.min("cut").alias("first"))
    after = carry_ends(firsts, ["record_id"], "slice", "first", "first").select("record_id", "slice", "next")
    pairs = (inside.withColumn("__lead", F.lead("cut").over(w)).join(after, ["record_id", "slice"])
             .select("record_id", F.col("cut").alias("start_idx"),
                     F.coalesce("__lead", "next").alias("end_idx"))
             .where(F.col("end_idx") > F.col("start_idx")))
    numbered = split_rank(pairs, ["record_id"], ["start_idx"], F.expr(f"start_idx div {span}"),
                          "cycle_no", size="cycles")
    return numbered.withColumn("cycle_no", F.col("cycle_no") - 1)


def dropped_samples(cycles: DataFrame, lengths: DataFrame) -> DataFrame:
    """Samples per record that belong to no cycle (before the first and after the last cut)."""
    kept = cycles.groupBy("record_id").agg(F.sum(F.col("end_idx") - F.col("start_idx")).alias("kept"))
    return lengths.join(kept, "record_id", "left").select(
        "record_id", (F.col("n") - F.coalesce("kept", F.lit(0))).alias("dropped"))


def rearrange(cycles: DataFrame, seed, prob_contiguous: float = 0.0, random_start: bool = True
              ) -> DataFrame:
    """New position ``pos`` of every cycle of a record: rotated, or in shuffled groups of cycles.

    The order depends on the record only, so all signals of a record stay aligned. Groups have one
    cycle each, or follow a drawn pattern of five sizes from 1 to 4. A cycle's group follows from
    its number by arithmetic.
    """
    rec, no = F.col("record_id"), F.col("cycle_no")
    sizes = [pick(4, seed, "size", j, rec) + 1 for j in range(5)]
    ends = [sum(sizes[1:j + 1], sizes[0]) for j in range(5)]
    lap, rest = F.floor(no / ends[4]), no % ends[4]
    slot = F.when(rest < ends[0], 0)
    for j in range(1, 5):
        slot = slot.when(rest < ends[j], j)
    single = unit(seed, "single", rec) < 0.5
    grouped = cycles.withColumn("grp", F.when(single, no).otherwise(lap * 5 + slot).cast("long"))
    hashed = grouped.withColumn("__h", digest(seed, "group", rec, F.col("grp")))
    ranked = split_rank(hashed, ["record_id"], ["__h", "cycle_no"], hash_bucket(F.col("__h")), "__r")
    start = pick(F.col("cycles"), seed, "start", rec) if random_start else F.lit(0)
    rotated = F.pmod(no - start, F.col("cycles"))
    pos = (F.when(F.col("cycles") < 2, no)
           .when(unit(seed, "contiguous", rec) <= prob_contiguous, rotated)
           .otherwise(F.col("__r") - 1))
    return ranked.withColumn("pos", pos.cast("long")).drop("__h", "__r", "grp")


def cycle_bodies(cycles: DataFrame, blocks: DataFrame, block: int, limit: int | None = None,
                 keys: Sequence[str] = KEYS) -> DataFrame:
    """Samples of each cycle, joined block by block: all of them, or the first ``limit`` where a caller
    can't use more (a signal of ``target`` samples never reaches beyond ``target + fade`` of a cycle)."""
    stop = F.col("end_idx") if limit is None else F.least("end_idx", F.col("start_idx") + limit)
    wanted = cycles.withColumn("__stop", stop).withColumn("block", F.explode(F.sequence(
        F.expr(f"start_idx div {block}"), F.expr(f"(__stop - 1) div {block}"))))
    base = F.col("block") * block
    begin, end = F.greatest("start_idx", base), F.least(F.col("__stop"), base + block)
    joined = wanted.join(blocks, ["record_id", "block"])
    piece = F.struct("block", F.slice("values", (begin - base + 1).cast("int"),
                                      (end - begin).cast("int")).alias("v"))
    extra = [c for c in cycles.columns if c != "record_id"]
    return joined.withColumn("__p", piece).groupBy(*keys, *extra).agg(
        F.flatten(F.array_sort(F.collect_list("__p")).v).alias("values"))


def fade_in(n: int, likeness: float) -> np.ndarray:
    """Weights of the incoming signal over ``n`` overlapping samples.

    The odd part is a smooth step from -1/2 to 1/2. The even part makes the two weights' power constant
    for signals that correlate by ``likeness``: 1/2 for equal signals, more the less they are alike.
    """
    phase = np.linspace(-0.5, 0.5, n) * np.pi
    odd = 9 / 16 * np.sin(phase) + np.sin(3 * phase) / 16
    power = (0.5 - (1 - likeness) * odd * odd) / (1 + likeness)
    return np.clip(odd + np.sqrt(np.maximum(power, 0)), 0, 1)


def layout(sizes: Sequence[int], target: int, fade: int) -> tuple[list[tuple[int, int, int]], int]:
    """Where cycles lie when laid end to end, over again from the first, until ``target`` samples are reached.

    Gives ``(cycle, start, overlap)`` and the length of all. A cycle overlaps what is there by ``fade`` samples
    if both are that long, else it follows without overlap. After ten laps it ends in any case.
    """
    places, length = [(0, 0, 0)], sizes[0]
    for k in range(1, 10 * len(sizes) + 6):
        if length >= target:
            break
        size = sizes[k % len(sizes)]
        overlap = fade if 1 < fade <= min(length, size) else 0
        places.append((k % len(sizes), length - overlap, overlap))
        length += size - overlap
    return places, length


def chain(parts: Sequence[np.ndarray], target: int, fade: int) -> np.ndarray:
    """Cycles in their layout in one buffer; overlaps move from what is there to the incoming cycle."""
    places, length = layout([len(p) for p in parts], target, fade)
    buffer = np.empty(length)
    for cycle, start, overlap in places:
        part, seam = parts[cycle], slice(start, start + overlap)
        if overlap:
            there, new = buffer[seam], part[:overlap]
            if min(there.var(), new.var()) < FLAT:
                weight = np.arange(overlap) / (overlap - 1)
            else:
                weight = fade_in(overlap, min(1.0, abs(np.mean((there - there.mean()) * (new - new.mean())) / (there.std() * new.std()))))
            buffer[seam] += weight * (new - there)
        buffer[start + overlap:start + len(part)] = part[overlap:]
    return buffer


def needed_cycles(ordered: DataFrame, target: int, fade: int, span: int = 10_000) -> DataFrame:
    """The cycles in ``pos`` order that can still add to the first ``target`` samples.

    A cycle adds at least its length less the overlap (all of it when it is shorter than the
    overlap). Only cycles before which this guaranteed sum is below the target are kept, so the
    samples of all others need not be read. A record that falls short keeps every cycle.
    """
    size = F.col("end_idx") - F.col("start_idx")
    adds = F.when(size < fade, size).otherwise(size - fade)
    counted = split_cumsum(ordered.withColumn("__adds", adds), ["record_id"], "pos", "__adds", span, "__before")
    return counted.where(F.col("__before") < target + fade).drop("__adds", "__before")


def rebuild(bodies: DataFrame, target: int, fade: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """One signal per record of at least ``target`` samples from its needed cycles in ``pos`` order.

    ``bodies`` holds the needed cycles only, each cut to a bounded length, so a group is a little
    over ``target`` samples whatever the record's length.
    """
    @pieces_udf("array<double>")
    def join(parts: pd.Series) -> pd.Series:
        return pd.Series([chain([np.asarray(v, float) for v in p], target, fade) for p in parts])

    ordered = F.array_sort(F.collect_list(F.struct("pos", "values")))
    # Marked so that the optimizer does not copy the call into every use of its result.
    once = join.asNondeterministic()
    return bodies.groupBy(*keys).agg(ordered["values"].alias("__parts")).select(
        *keys, once("__parts").alias("values"))
