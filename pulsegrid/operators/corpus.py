"""Recorded noise from a corpus kept in blocks: a signal draws its place first, and only the blocks under it move."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.functions.keyed import between, digest, pick, unit
from pulsegrid.operators.blocks import attach, recut
from pulsegrid.operators.kernels import resample_mixed
from pulsegrid.operators.repair import fill_gaps
from pulsegrid.operators.ranking import hash_bucket, split_rank
from pulsegrid.session import cut_lineage

# Scale ranges of the auxiliary heart-sound channels and of the three ECG noises.
HEART_PARTS = {"aux1": (0.0, 0.05), "aux2": (0.0, 0.05)}
ECG_PARTS = {"em": (0.0, 0.25), "bw": (0.0, 0.5), "ma": (0.0, 0.25)}


@dataclass(frozen=True)
class Corpus:
    """``sizes(k, noise_id, part, size, longest)`` with positions ``k`` from 0, and ``blocks(k, part, block, values)`` of ``block`` samples."""

    sizes: DataFrame
    blocks: DataFrame
    count: int
    block: int


def build_corpus(recordings: DataFrame, parts: Sequence[str], block: int, fs_out: int) -> Corpus:
    """Noise ``recordings(noise_id, part, fs, block, values)`` resampled once to ``fs_out`` and numbered by keyed hash.

    Gaps are filled. Recordings that lack one of the ``parts`` are of no use and are left out (``unusable`` lists them); without any usable
    one the corpus is empty and all noise is silence. Both tables are written, so every job of a session reads them as they are.
    """
    keys = ["noise_id", "part"]
    wanted = recordings.where(F.col("part").isin(*parts) & F.col("noise_id").isNotNull())
    whole = wanted.groupBy("noise_id").agg(F.count_distinct("part").alias("n")).where(F.col("n") == len(parts)).select("noise_id")
    hashed = whole.withColumn("__h", digest("corpus", F.col("noise_id")))
    numbered = split_rank(hashed, [], ["__h", "noise_id"], hash_bucket(F.col("__h")), "k").select("noise_id", (F.col("k") - 1).alias("k"))
    filled = fill_gaps(wanted.join(whole, "noise_id", "left_semi"), block, [*keys, "fs"])
    made = resample_mixed(filled, block, fs_out, "fs", keys)
    stored = cut_lineage(made.join(numbered, "noise_id").select("noise_id", "k", "part", "block", "values"), "noise-corpus")
    sizes = stored.groupBy("k", "noise_id", "part").agg(F.sum(F.size("values")).cast("long").alias("size"))
    # A window sees the parts of one recording.
    sizes = cut_lineage(sizes.withColumn("longest", F.max("size").over(Window.partitionBy("k"))), "noise-sizes")
    top = sizes.agg(F.max("k")).first()[0]
    return Corpus(sizes, stored.drop("noise_id"), 0 if top is None else top + 1, block)


def unusable(recordings: DataFrame, parts: Sequence[str]) -> DataFrame:
    """``noise_id, missing`` of recordings that lack parts."""
    held = recordings.groupBy("noise_id").agg(F.collect_set("part").alias("__p"))
    return held.select("noise_id", F.array_except(F.array(*map(F.lit, parts)), "__p").alias("missing")).where(F.size("missing") > 0)


def _figures(rows: DataFrame, keys: Sequence[str], values: Column, *more: Column) -> DataFrame:
    """Sum, count and ends of ``values`` over the rows of a key; nothing is exploded."""
    return rows.groupBy(*keys).agg(F.sum(A.total(values)).alias("__s"), F.sum(F.size(values)).alias("__n"),
                                   F.min(F.array_min(values)).alias("__lo"), F.max(F.array_max(values)).alias("__hi"), *more)


def _normal(x: Column) -> Column:
    """A sample by its signal's figures: zero mean, peak 1; a constant signal becomes 0."""
    mean = F.col("__s") / F.col("__n")
    peak = F.greatest(F.col("__hi") - mean, mean - F.col("__lo"))
    return F.when(peak > 0, A.clip((x - mean) / peak)).otherwise(x - mean)


def noise_blocks(signals: DataFrame, corpus: Corpus, keys: Sequence[str], parts: Mapping[str, tuple[float, float]], seed,
                 key: Sequence[Column], normalise: bool, salts: int = 16) -> DataFrame:
    """``keys, block, noise`` for ``signals(keys, n)``: one row per signal whose gate is open, with its length in samples.

    A signal draws one recording, and for each part silence or a gain and a place, all by its key. The pieces under those places are
    joined by equality on (recording, part, block, salt): a noise block moves at most twice for each of the signal's blocks, silent parts and
    closed gates move nothing. Crops are normalised over the whole signal by partial sums, scaled and added up; with
    ``normalise`` the sum is normalised again where it isn't silent. A crop shorter than the signal is silence behind its end; blocks without
    any noise are not returned.
    """
    keys = list(keys)
    if not corpus.count:
        return signals.select(*keys, F.lit(0).cast("long").alias("block"), F.array().cast("array<double>").alias("noise")).where(F.lit(False))
    salt = pick(salts, seed, "salt", *key).cast("int")
    asked = signals.withColumn("k", pick(corpus.count, seed, "noise", *key))
    draws = [F.struct(F.lit(name).alias("part"), (unit(seed, name, "on", *key) >= 0.5).alias("on"),
                      between(lo, hi, seed, name, "gain", *key).alias("gain"), unit(seed, name, "at", *key).alias("u"))
             for name, (lo, hi) in parts.items()]
    drawn = (asked.withColumn("__salt", salt).select(*keys, "n", "k", "__salt", F.explode(F.array(*draws)).alias("d"))
             .select(*keys, "n", "k", "__salt", "d.*").where("on").drop("on"))
    sized = _salted(drawn, corpus.sizes.select("k", "part", "size", "longest"), ["k", "part"], salts)
    at = F.floor(F.col("u") * F.greatest(F.col("size") - F.col("n") + 1, F.lit(1))).cast("long")
    placed = (sized.withColumn("at", at).withColumn("end", F.least(F.col("at") + F.col("n"), F.col("size")))
              .withColumn("n", F.least("n", "longest")))
    b = corpus.block
    asked_blocks = placed.withColumn("__nb", F.explode(F.sequence(F.expr(f"at div {b}"), F.expr(f"(end - 1) div {b}")))).repartition(*keys, "__nb")
    met = _salted(asked_blocks, corpus.blocks.withColumnRenamed("block", "__nb"), ["k", "part", "__nb"], salts)
    first = F.greatest(F.col("at"), F.col("__nb") * b)
    cut = F.slice("values", (first - F.col("__nb") * b + 1).cast("int"), (F.least(F.col("end"), (F.col("__nb") + 1) * b) - first).cast("int"))
    pieces = cut_lineage(met.select(*keys, "part", "gain", "n", (first - F.col("at")).alias("first"), cut.alias("values")), "noise-pieces")
    own = [*keys, "part"]
    blocks_of = lambda n: F.expr(f"({n} + {b - 1}) div {b}").alias("__blocks")
    figures = _figures(pieces, own, F.col("values"), F.max("gain").alias("gain")).withColumn("__blocks", blocks_of("__n"))
    laid = attach(recut(pieces.select(*own, "first", "values"), "first", "values", b, own), figures, own).select(
        *own, "block", F.transform("values", lambda x: F.col("gain") * _normal(x)).alias("values"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("part", "values"))).values, F.array().cast("array<double>"),
                        lambda s, v: F.zip_with(s, v, lambda p, q: zero(p) + zero(q)))
    summed = laid.groupBy(*keys, "block").agg(total.alias("noise"))
    if not normalise:
        return summed
    summed = cut_lineage(summed, "noise-sum")
    length = pieces.groupBy(*keys).agg(F.max("n").alias("n"))
    figures = _figures(summed, keys, F.col("noise")).join(length, keys)
    # Where the longest part is the silent one, its samples count as zeros.
    short = F.col("__n") < F.col("n")
    figures = figures.select(*keys, "__s", F.col("n").alias("__n"), *[
        F.when(short, end(F.col(c), F.lit(0.0))).otherwise(F.col(c)).alias(c) for c, end in (("__lo", F.least), ("__hi", F.greatest))],
        blocks_of("n")).where((F.col("__lo") != 0) | (F.col("__hi") != 0))
    each = figures.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)))
    dense = each.join(summed, [*keys, "block"], "left").withColumn("noise", F.coalesce("noise", F.array().cast("array<double>")))
    size = F.least(F.lit(b), F.col("__n") - F.col("block") * b).cast("int")
    full = F.concat("noise", F.array_repeat(F.lit(0.0), size - F.size("noise")))
    return dense.select(*keys, "block", F.transform(full, _normal).alias("noise"))


def _salted(rows: DataFrame, side: DataFrame, on: Sequence[str], salts: int) -> DataFrame:
    """Join on ``on`` and the row's salt; each row of the side appears once per salt."""
    return rows.join(side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*on, "__salt"])


def add_noise(blocks: DataFrame, noise: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``blocks(keys, block, values)`` plus the noise of their places; without any, samples stay as they are."""
    both = blocks.join(noise, [*keys, "block"], "left")
    mixed = F.transform("values", lambda v, i: v + F.coalesce(F.get("noise", i), F.lit(0.0)))
    return both.withColumn("values", F.when(F.col("noise").isNotNull(), mixed).otherwise(F.col("values"))).drop("noise")
