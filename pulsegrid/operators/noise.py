"""Mixing recorded noise into signals: pick a recording, crop at random, scale, add."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.functions.keyed import between, digest, pick, unit
from pulsegrid.operators.ranking import hash_bucket, split_rank


def number_corpus(corpus: DataFrame, noise_id: str) -> DataFrame:
    """Recordings with a position ``__k`` 0..n-1 and the count ``__size``."""
    hashed = corpus.withColumn("__h", digest("corpus", F.col(noise_id)))
    ranked = split_rank(hashed, [], ["__h", noise_id], hash_bucket(F.col("__h")), "__k", "__size")
    return ranked.withColumn("__k", F.col("__k") - 1).drop("__h")


def scaled_crop(noise: Column, length: Column, lo: float, hi: float, seed, part: str, key) -> Column:
    """Either silence or a normalised random crop scaled by U(lo, hi), at even odds."""
    size = F.size(noise)
    at = pick(F.greatest(size - length + 1, F.lit(1)), seed, part, "at", *key) + 1
    crop = F.slice(noise, at.cast("int"), F.least(length, size))
    gain = F.when(unit(seed, part, "on", *key) < 0.5, F.lit(0.0)).otherwise(
        between(lo, hi, seed, part, "gain", *key))
    return A.bind(gain, lambda g: F.transform(A.abs_max(crop), lambda x: g * x))


def padded_add(x: Column, noise: Column) -> Column:
    """Sum over the samples of ``x``; a missing or shorter noise counts as silence."""
    return A.bind(noise, lambda z: F.transform(
        x, lambda v, i: v + F.coalesce(F.get(z, i), F.lit(0.0))))


def pick_noise(rows: DataFrame, corpus: DataFrame, noise_id: str, parts: Sequence[str], seed,
               key: Sequence[Column], salts: int = 16) -> DataFrame:
    """Joins one hashed recording (its ``parts`` columns) to every row.

    A corpus of few recordings would put a large share of the rows on one join key, so the key is
    salted: each recording appears once per salt, each row has one salt from its own hash.
    """
    numbered = number_corpus(corpus, noise_id)
    size = numbered.agg(F.max("__size")).scalar()
    salted = numbered.select("__k", *parts, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__s"))
    asked = (rows.withColumn("__k", pick(size, seed, "noise", *key))
             .withColumn("__s", pick(salts, seed, "salt", *key).cast("int")))
    return asked.join(salted, ["__k", "__s"], "left").drop("__k", "__s")


def heart_noise(aux1: Column, aux2: Column, length: Column, seed, key) -> Column:
    """Two scaled auxiliary crops summed and normalised; all silence when both are off."""
    both = F.zip_with(scaled_crop(aux1, length, 0.0, 0.05, seed, "aux1", key),
                      scaled_crop(aux2, length, 0.0, 0.05, seed, "aux2", key),
                      lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
    return A.bind(both, lambda c: F.when(
        F.exists(c, lambda x: x != 0), A.abs_max(c)).otherwise(c))


# Scale ranges of the three ECG noise recordings.
ECG_NOISE = {"em": (0.0, 0.25), "bw": (0.0, 0.5), "ma": (0.0, 0.25)}


def ecg_noise(recordings: dict[str, Column], length: Column, seed, key) -> Column:
    """Sum of the three scaled ECG noise crops."""
    parts = [scaled_crop(recordings[n], length, lo, hi, seed, n, key) for n, (lo, hi) in ECG_NOISE.items()]
    out = parts[0]
    for p in parts[1:]:
        out = F.zip_with(out, p, lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
    return out
