"""Ordered, gated augmentation of fragment rows (copies), with keyed draws."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.functions.keyed import between, chance
from pulsegrid.operators.equaliser import equalise
from pulsegrid.operators.noise import padded_add

# Time-scaling ranges.
PCG_RATES = (1.004, 1.006)
PAIR_RATES = (0.8, 1.2)
MULTI_RATES = (0.7, 1.3)
PCG_EQ = (2.0, 500.0)
ECG_EQ = (0.25, 100.0)


@dataclass(frozen=True)
class Odds:
    """Gate probabilities; ``noise`` is split over four places."""

    noise: float = 0.30
    stretch: float = 0.25
    volume: float = 0.75
    eq: float = 0.25
    wander: float = 0.30
    recorded: float = 0.5


MULTI_ODDS = Odds(noise=0.30, stretch=0.35, volume=0.75, recorded=0.25)


class Gates:
    """Applies steps to a column of a frame, each behind a keyed Bernoulli gate."""

    def __init__(self, seed, key: Sequence[Column], fs: float):
        self.seed, self.key, self.fs = seed, list(key), fs

    def on(self, name: str, p: float) -> Column:
        return chance(p, self.seed, "gate", name, *self.key)

    def step(self, df: DataFrame, col: str, name: str, p: float, fn) -> DataFrame:
        """``fn`` takes the samples (null where the gate is shut) and returns new samples."""
        on = self.on(name, p)
        made = fn(F.when(on, F.col(col)))
        return df.withColumn(col, F.when(on, made).otherwise(F.col(col)))

    def noise(self, df, col, name, p):
        return self.step(df, col, name, p, lambda v: A.white_noise(v, self.seed, name, *self.key))

    def volume(self, df, col, name, p):
        return self.step(df, col, name, p, lambda v: A.volume(v, self.fs, self.seed, name, *self.key))

    def wander(self, df, col, name, p):
        return self.step(df, col, name, p, lambda v: A.wander(v, self.fs, self.seed, name, *self.key))

    def rate(self, name, rates) -> Column:
        return between(*rates, self.seed, name, "rate", *self.key)

    def stretch(self, df, col, name, p, rates):
        return self.step(df, col, name, p, lambda v: A.abs_max(A.stretch(v, self.rate(name, rates))))

    def eq(self, df, col, name, p, band):
        return self.step(df, col, name, p, lambda v: equalise(v, self.fs, *band, self.seed, name, *self.key))

    def recorded(self, df, col, name, p, noise: str | None):
        if noise is None:
            return df
        return self.step(df, col, name, p, lambda v: padded_add(v, F.col(noise)))


def augment_pcg(df: DataFrame, col: str, fs: float, seed, key: Sequence[Column],
                odds: Odds = Odds(), noise: str | None = None) -> DataFrame:
    """Heart-sound augmentation: noise, micro-stretch, volume, noise, equaliser, recorded noise."""
    g = Gates(seed, key, fs)
    df = df.withColumn(col, A.min_max(F.col(col)))
    df = g.noise(df, col, "noise1", odds.noise / 4)
    df = g.stretch(df, col, "stretch", odds.stretch, PCG_RATES)
    df = g.volume(df, col, "volume", odds.volume)
    df = g.noise(df, col, "noise2", odds.noise / 4)
    df = g.eq(df, col, "eq", odds.eq, PCG_EQ)
    df = g.recorded(df, col, "recorded", odds.recorded, noise)
    return df.withColumn(col, A.abs_max(F.col(col)))


def augment_ecg(df: DataFrame, col: str, fs: float, seed, key: Sequence[Column],
                odds: Odds = Odds(), noise: str | None = None) -> DataFrame:
    """ECG augmentation: noise, baseline wander, stretch, noise, equaliser, recorded noise."""
    g = Gates(seed, key, fs)
    df = df.withColumn(col, A.min_max(F.col(col)))
    df = g.noise(df, col, "noise1", odds.noise / 4)
    df = g.wander(df, col, "wander", odds.wander)
    df = g.stretch(df, col, "stretch", odds.stretch, PAIR_RATES)
    df = g.noise(df, col, "noise2", odds.noise / 4)
    df = g.eq(df, col, "eq", odds.eq, ECG_EQ)
    df = g.recorded(df, col, "recorded", odds.recorded, noise)
    return df.withColumn(col, A.abs_max(F.col(col)))


def augment_pair(df: DataFrame, pcg: str, ecg: str, fs: float, seed, key: Sequence[Column],
                 odds: Odds = Odds(), pcg_noise: str | None = None, ecg_noise: str | None = None
                 ) -> DataFrame:
    """Synchronised pair: one stretch rate for both, everything else per signal; cut to one length."""
    g = Gates(seed, key, fs)
    df = df.withColumn(pcg, A.min_max(F.col(pcg))).withColumn(ecg, A.min_max(F.col(ecg)))
    df = g.noise(df, pcg, "p_noise1", odds.noise / 4)
    df = g.noise(df, ecg, "e_noise1", odds.noise / 4)
    df = g.wander(df, ecg, "e_wander", odds.wander)
    for c in (ecg, pcg):
        df = g.stretch(df, c, "stretch", odds.stretch, PAIR_RATES)
    df = g.volume(df, pcg, "p_volume", odds.volume)
    df = g.noise(df, pcg, "p_noise2", odds.noise / 4)
    df = g.noise(df, ecg, "e_noise2", odds.noise / 4)
    df = g.eq(df, pcg, "p_eq", odds.eq, PCG_EQ)
    df = g.eq(df, ecg, "e_eq", odds.eq, ECG_EQ)
    df = g.recorded(df, ecg, "e_recorded", odds.recorded, ecg_noise)
    df = g.recorded(df, pcg, "p_recorded", odds.recorded, pcg_noise)
    both = A.align(F.array(A.abs_max(F.col(pcg)), A.abs_max(F.col(ecg))))
    return (df.withColumn("__both", both).withColumn(pcg, F.col("__both")[0])
            .withColumn(ecg, F.col("__both")[1]).drop("__both"))


def augment_multi(df: DataFrame, col: str, fs: float, seed, key: Sequence[Column],
                  odds: Odds = MULTI_ODDS, noise: str | None = None) -> DataFrame:
    """All channels alike (``ARRAY<ARRAY<DOUBLE>>``); only white noise differs per channel."""
    g = Gates(seed, key, fs)
    each = lambda fn: lambda cs: F.transform(cs, fn)
    noisy = lambda name: each(lambda c, ch: A.white_noise(c, seed, name, *key, ch))
    df = df.withColumn(col, F.transform(F.col(col), A.abs_max))
    df = g.step(df, col, "noise1", odds.noise / 4, noisy("noise1"))
    rate = g.rate("stretch", MULTI_RATES)
    df = g.step(df, col, "stretch", odds.stretch, lambda cs: A.bind(rate, lambda r: F.transform(
        cs, lambda c: A.abs_max(A.stretch(c, r, keep_length=True)))))
    df = g.step(df, col, "volume", odds.volume,
                each(lambda c: A.volume(c, fs, seed, "volume", *key)))
    df = g.step(df, col, "noise2", odds.noise / 4, noisy("noise2"))
    if noise is not None:
        df = g.step(df, col, "recorded", odds.recorded,
                    each(lambda c: A.abs_max(padded_add(c, F.col(noise)))))
    return df.withColumn(col, A.align(F.col(col)))


def augment_batch(df: DataFrame, col: str, fs: float, seed, key: Sequence[Column],
                  odds: Odds = Odds()) -> DataFrame:
    """The four-step subset for training batches: every step renormalises every row."""
    g = Gates(seed, key, fs)
    df = df.withColumn(col, A.abs_max(F.col(col)))
    again = lambda d: d.withColumn(col, A.abs_max(F.col(col)))
    df = again(g.noise(df, col, "noise1", odds.noise / 4))
    df = again(g.volume(df, col, "volume", odds.volume))
    df = again(g.eq(df, col, "eq", odds.eq, PCG_EQ))
    return again(g.noise(df, col, "noise2", odds.noise / 4))
