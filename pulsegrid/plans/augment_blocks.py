"""Augmentation of whole recordings in blocks, before they are cut to windows.

The steps and their draws are those of ``augment`` on arrays, and so are the results, whatever the block length. Steps that work sample by
sample run inside the blocks; time scaling sends each output sample's place to the block that holds it; random filters pass
states on; recorded noise moves the blocks under its place. A step's result is written once and its whole-record figures are taken
from there, so a chain of steps is no deeper a plan than one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.functions.keyed import between, chance
from pulsegrid.functions.numeric import half_even
from pulsegrid.functions.pieces import pieces_udf
from pulsegrid.operators import corpus as N
from pulsegrid.operators.balance import class_counts
from pulsegrid.operators.blocks import KEYS, attach, recut, salted_join, with_halo
from pulsegrid.operators.equaliser import band_draws, coloured_blocks
from pulsegrid.plans.augment import ECG_EQ, PAIR_RATES, PCG_EQ, PCG_RATES, Odds
from pulsegrid.session import cut_lineage


def time_scaled(blocks: DataFrame, block: int, rate: Column, keys: Sequence[str]) -> DataFrame:
    """Linear interpolation at ``i * rate`` with a rate per signal: each block makes the outputs that lie in it, then blocks are re-cut.

    The last block is the one without a neighbour behind it; its last sample is read on where a place lies beyond it.
    """
    keys = list(keys)

    @pieces_udf("struct<first: bigint, values: array<double>>")
    def apply(number: pd.Series, values: pd.Series, after: pd.Series, rate: pd.Series) -> pd.DataFrame:
        firsts, outs = [], []
        for n, v, a, r in zip(number, values, after, rate):
            base, x = n * block, np.append(v, a[0] if len(a) else v[-1])
            m = np.arange(max(0, int(base / r) - 1), int((base + len(v)) / r) + 2)
            if not len(a):
                m = m[m <= np.floor((base + len(v) - 1) / r)]
            t = m * r
            k = np.floor(t).astype(np.int64)
            held = (k >= base) & (k < base + len(v))
            m, t, k = m[held], t[held], k[held] - base
            firsts.append(int(m[0]) if len(m) else 0)
            outs.append(x[k] + (t - (k + base)) * (x[k + 1] - x[k]))
        return pd.DataFrame({"first": firsts, "values": outs})

    made = with_halo(blocks, 0, 1, keys).select(*keys, apply("block", "values", "after", rate).alias("r"))
    return recut(made.select(*keys, F.col("r.first").alias("__f"), F.col("r.values").alias("__v")), "__f", "__v", block, keys)


@dataclass(frozen=True)
class BlockSteps:
    """Gated steps on ``keys, block, values``. ``key`` names the columns that draws go by, ``keys`` those that tell signals apart."""

    block: int
    fs: float
    seed: object
    key: Sequence[str]
    keys: Sequence[str]

    def _key(self) -> list[Column]:
        return [F.col(c) for c in self.key]

    def _on(self, name: str, p: float) -> Column:
        return chance(p, self.seed, "gate", name, *self._key())

    def _first(self) -> Column:
        return F.col("block") * self.block

    def _figures(self, blocks: DataFrame, *columns: str) -> DataFrame:
        cells = [c for v in columns for c in (
            F.sum(A.total(F.col(v))).alias(f"__s_{v}"), F.min(F.array_min(v)).alias(f"__lo_{v}"), F.max(F.array_max(v)).alias(f"__hi_{v}"))]
        return blocks.groupBy(*self.keys).agg(*cells, F.sum(F.size(columns[0])).alias("__n"), (F.max("block") + 1).alias("__blocks"))

    @staticmethod
    def _normal(v: str):
        mean, lo, hi = F.col(f"__s_{v}") / F.col("__n"), F.col(f"__lo_{v}"), F.col(f"__hi_{v}")
        peak = F.greatest(hi - mean, mean - lo)
        return lambda x: F.when(peak > 0, A.clip((x - mean) / peak)).otherwise(x - mean)

    def normalised(self, blocks: DataFrame, on: Column | None = None, name: str = "normalised") -> DataFrame:
        """Zero mean and peak 1 per signal, where ``on``."""
        held = cut_lineage(blocks.select(*self.keys, "block", "values"), name)
        scaled = F.transform("values", self._normal("values"))
        return attach(held, self._figures(held, "values"), self.keys).select(
            *self.keys, "block", (scaled if on is None else F.when(on, scaled).otherwise(F.col("values"))).alias("values"))

    def min_max(self, blocks: DataFrame) -> DataFrame:
        held = cut_lineage(blocks.select(*self.keys, "block", "values"), "records")
        lo, hi = F.col("__lo_values"), F.col("__hi_values")
        scale = lambda x: F.when(hi <= lo, F.lit(0.0)).otherwise((x - lo) / (hi - lo) * 2.0 - 1.0)
        return attach(held, self._figures(held, "values"), self.keys).select(*self.keys, "block", F.transform("values", scale).alias("values"))

    def _samplewise(self, blocks: DataFrame, name: str, p: float, made: Column) -> DataFrame:
        on = self._on(name, p)
        return self.normalised(blocks.withColumn("values", F.when(on, made).otherwise(F.col("values"))), on, name)

    def noise(self, blocks, name, p):
        return self._samplewise(blocks, name, p, A.raw_noise(F.col("values"), self.seed, name, *self._key(), first=self._first()))

    def volume(self, blocks, name, p):
        return self._samplewise(blocks, name, p, A.slow_gain(F.col("values"), self.fs, self.seed, name, *self._key(), first=self._first()))

    def wander(self, blocks, name, p):
        return self._samplewise(blocks, name, p, A.drift(F.col("values"), self.fs, self.seed, name, *self._key(), first=self._first()))

    def stretch(self, blocks, name, p, rates):
        """Only the signals whose gate is open move."""
        on, held = self._on(name, p), cut_lineage(blocks, f"before-{name}")
        rate = between(*rates, self.seed, name, "rate", *self._key())
        scaled = time_scaled(held.where(on), self.block, rate, self.keys)
        return self.normalised(scaled, name=name).unionByName(held.where(~on))

    def eq(self, blocks, name, p, band):
        """A fiftieth of a randomly coloured copy blended into the normalised signal."""
        on, held = self._on(name, p), cut_lineage(blocks, f"before-{name}")
        open_ = held.where(on)
        sizes = open_.groupBy(*self.keys).agg((F.max("block") + 1).alias("__blocks")).withColumn("__all", F.col("__blocks"))
        left = attach(open_, sizes, self.keys).withColumn("__left", F.col("__all") - 1 - F.col("block"))
        draws = band_draws(self.seed, name, *self._key())
        tinted = cut_lineage(coloured_blocks(left, self.block, draws, self.fs, *band, self.keys, "__left"), f"tinted-{name}")
        both = attach(tinted, self._figures(tinted, "tinted", "values"), self.keys)
        mixed = F.zip_with(F.transform("tinted", self._normal("tinted")), F.transform("values", self._normal("values")), lambda c, x: c / 50.0 + x)
        return self.normalised(both.select(*self.keys, "block", mixed.alias("values")), name=name).unionByName(held.where(~on))

    def recorded(self, blocks, name, p, corpus: N.Corpus | None, parts, normalise: bool):
        if corpus is None:
            return blocks
        held = cut_lineage(blocks, f"before-{name}")
        signals = held.where(self._on(name, p)).groupBy(*self.keys).agg(F.sum(F.size("values")).cast("long").alias("n"))
        return N.add_noise(held, N.noise_blocks(signals, corpus, self.keys, parts, self.seed, self._key(), normalise), self.keys)


def augment_pcg_blocks(blocks: DataFrame, steps: BlockSteps, odds: Odds = Odds(), corpus: N.Corpus | None = None) -> DataFrame:
    """Heart-sound augmentation of whole recordings: noise, micro-stretch, volume, noise, equaliser, recorded noise."""
    x = steps.min_max(blocks)
    x = steps.noise(x, "noise1", odds.noise / 4)
    x = steps.stretch(x, "stretch", odds.stretch, PCG_RATES)
    x = steps.volume(x, "volume", odds.volume)
    x = steps.noise(x, "noise2", odds.noise / 4)
    x = steps.eq(x, "eq", odds.eq, PCG_EQ)
    x = steps.recorded(x, "recorded", odds.recorded, corpus, N.HEART_PARTS, True)
    return steps.normalised(x)


def augment_ecg_blocks(blocks: DataFrame, steps: BlockSteps, odds: Odds = Odds(), corpus: N.Corpus | None = None) -> DataFrame:
    """ECG augmentation of whole recordings: noise, baseline wander, stretch, noise, equaliser, recorded noise."""
    x = steps.min_max(blocks)
    x = steps.noise(x, "noise1", odds.noise / 4)
    x = steps.wander(x, "wander", odds.wander)
    x = steps.stretch(x, "stretch", odds.stretch, PAIR_RATES)
    x = steps.noise(x, "noise2", odds.noise / 4)
    x = steps.eq(x, "eq", odds.eq, ECG_EQ)
    x = steps.recorded(x, "recorded", odds.recorded, corpus, N.ECG_PARTS, False)
    return steps.normalised(x)


def augment_pair_blocks(pcg: DataFrame, ecg: DataFrame, steps: BlockSteps, odds: Odds = Odds(),
                        pcg_corpus: N.Corpus | None = None, ecg_corpus: N.Corpus | None = None) -> tuple[DataFrame, DataFrame]:
    """A synchronised pair of whole recordings with the same keys: one stretch rate for both, everything else per signal; cut to one length."""
    p, e = steps.min_max(pcg), steps.min_max(ecg)
    p = steps.noise(p, "p_noise1", odds.noise / 4)
    e = steps.wander(steps.noise(e, "e_noise1", odds.noise / 4), "e_wander", odds.wander)
    e, p = (steps.stretch(x, "stretch", odds.stretch, PAIR_RATES) for x in (e, p))
    p = steps.noise(steps.volume(p, "p_volume", odds.volume), "p_noise2", odds.noise / 4)
    e = steps.noise(e, "e_noise2", odds.noise / 4)
    p, e = steps.eq(p, "p_eq", odds.eq, PCG_EQ), steps.eq(e, "e_eq", odds.eq, ECG_EQ)
    e = steps.normalised(steps.recorded(e, "e_recorded", odds.recorded, ecg_corpus, N.ECG_PARTS, False))
    p = steps.normalised(steps.recorded(p, "p_recorded", odds.recorded, pcg_corpus, N.HEART_PARTS, True))
    size = F.sum(F.size("values")).alias("n")
    lengths = [x.groupBy(*steps.keys).agg(size, (F.max("block") + 1).alias("__blocks")) for x in (p, e)]
    least = lengths[0].unionByName(lengths[1]).groupBy(*steps.keys).agg(F.min("n").alias("__least"), F.max("__blocks").alias("__blocks"))
    room = F.greatest(F.lit(0), F.col("__least") - F.col("block") * steps.block).cast("int")
    cut = lambda x: attach(x, least, steps.keys).where(room > 0).select(*steps.keys, "block", F.slice("values", F.lit(1), room).alias("values"))
    return cut(p), cut(e)


def record_copies(blocks: DataFrame, splits: DataFrame, augment_num: int, balance: bool = True) -> DataFrame:
    """Blocks of the copies of each training recording, numbered from 1 in ``copy_no``, balanced by the classes of ``splits(record_id, label, subset)``.

    Counts are of training recordings, one row each: ``round(augment_num * largest / own)`` copies. A long recording's blocks meet
    its row on several tasks. Recordings without a label have no copies.
    """
    train = splits.where("subset = 'train' AND label IS NOT NULL").select("record_id", "label")
    own = half_even(F.lit(augment_num) * F.col("max_n") / F.col("n")) if balance else F.lit(augment_num)
    per_class = class_counts(train).agg(F.map_from_entries(F.collect_list(F.struct(F.col("label").cast("string"), own.cast("int"))))).scalar()
    each = train.withColumn("__copies", F.try_element_at(per_class, F.col("label").cast("string"))).where(F.col("__copies") > 0).drop("label")
    met = salted_join(blocks, each, "record_id", F.col("block"))
    return met.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copies")


def with_record_copies(blocks: DataFrame, splits: DataFrame, augment_num: int, block: int, fs: float, seed, kind: str = "pcg",
                       odds: Odds = Odds(), corpus: N.Corpus | None = None) -> DataFrame:
    """Clean recordings (``copy_no`` 0) and the augmented copies of those to train on, ready for ``windows`` with ``copy_no`` among the keys.

    Each copy is augmented as a whole recording and normalised over its whole length; its windows are cut afterwards, as its
    original's are. Draws go by recording, channel and copy.
    """
    keys = [*KEYS, "copy_no"]
    steps = BlockSteps(block, fs, seed, keys, keys)
    augment = {"pcg": augment_pcg_blocks, "ecg": augment_ecg_blocks}[kind]
    made = augment(record_copies(blocks.select(*KEYS, "block", "values"), splits, augment_num), steps, odds, corpus)
    return blocks.select(*KEYS, F.lit(0).alias("copy_no"), "block", "values").unionByName(made.select(*keys, "block", "values"))
