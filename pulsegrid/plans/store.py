"""Features of recordings in a store keyed by content and settings: what has been extracted once is read from then on."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.keyed import digest
from pulsegrid.functions.pieces import pieces_udf
from pulsegrid.operators.blocks import KEYS
from pulsegrid.operators.spectra import MelSpec, _frames
from pulsegrid.operators.windows import WindowSpec, windows
from pulsegrid.plans.preprocess import by_kind_blocks
from pulsegrid.session import cut_lineage, path_exists

STORED = ("content STRING, channel STRING, win_no BIGINT, start_idx BIGINT, valid_len INT, features ARRAY<DOUBLE>")


@dataclass(frozen=True)
class Extraction:
    """All that the features of a recording depend on besides its samples and, without ``fs_in``, its rate in the column ``fs``.
    ``version`` names the code: raise it when results change."""

    fs_in: int | None
    fs_out: int
    mel: MelSpec
    window: WindowSpec = field(default_factory=WindowSpec)
    block: int = 4096
    version: int = 1

    def name(self, spark) -> str:
        return spark.range(1).select(digest("extraction", self)).first()[0]


def contents(blocks: DataFrame) -> DataFrame:
    """``(record_id, content)``: a digest of a recording's channels, samples and rates (where there is a column ``fs``) that its id plays no part in.

    Blocks are hashed where they lie and their hashes are summed, in any order, so a recording of any length is a few partial sums.
    """
    rate = [F.col("fs")] if "fs" in blocks.columns else []
    one, two = (F.xxhash64(F.lit(i), F.col("channel"), F.col("block"), F.col("values"), *rate) for i in (1, 2))
    parts = [F.sum(one.cast("decimal(20,0)")), F.expr("bit_xor(__two)"), F.count(F.lit(1)), F.sum(F.size("values"))]
    sums = blocks.withColumn("__two", two).groupBy("record_id").agg(*[p.cast("string").alias(f"__{i}") for i, p in enumerate(parts)])
    return sums.select("record_id", digest(*[F.col(f"__{i}") for i in range(len(parts))]).alias("content"))


def pooled_log_mel(values: Column, valid: Column, spec: MelSpec) -> Column:
    """Mean and spread of each log-mel band over the frames of the samples that are no padding: ``2 * n_mels`` numbers."""
    window, bank = spec.window(), spec.filterbank()

    @pieces_udf("array<double>")
    def apply(xs: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for x, n in zip(xs, sizes):
            # A frame centred behind the last sample would see padding only.
            frames = _frames(np.asarray(x, float), spec.n_fft, spec.hop)[:max(1, -(-int(n) // spec.hop))]
            mel = np.abs(np.fft.rfft(frames * window)) @ bank
            scaled = np.clip((20.0 * np.log10(np.maximum(mel, 1e-5)) + 80.0) / 100.0, 0.0, 1.0)
            out.append(np.concatenate([scaled.mean(axis=0), scaled.std(axis=0)]))
        return pd.Series(out, dtype=object)

    return apply(values, valid)


def extract(blocks: DataFrame, how: Extraction) -> DataFrame:
    """``record_id, channel, win_no, start_idx, valid_len, features`` of recordings with named channels: clean, cut, pool."""
    start, win, hop = how.window.samples(how.fs_out)
    cut = windows(by_kind_blocks(blocks, how.block, how.fs_in, how.fs_out), how.block, start, win, hop, KEYS)
    return cut.select("record_id", "channel", "win_no", "start_idx", "valid_len",
                      pooled_log_mel(F.col("waveform"), F.col("valid_len"), how.mel).alias("features"))


def _read(spark, path: str) -> DataFrame:
    """What the store holds; two runs that extracted the same recording at the same time have stored it twice."""
    rows = spark.read.schema(STORED).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], STORED)
    return rows.dropDuplicates(["content", "channel", "win_no"])


def stored_features(blocks: DataFrame, how: Extraction, store: str) -> tuple[DataFrame, DataFrame]:
    """Features of all recordings in ``blocks``, and ``(content, record_id)`` of those that had to be extracted now.

    Recordings are known by content: copies under several ids are extracted once, and other runs' work is used as long as the
    settings agree. Don't put results of two calls into one plan: the store's files of two moments look alike to Spark. Of equal recordings the smallest id's is extracted. A recording without a window is entered too, so it isn't tried
    again. The store is one folder per settings; a run adds files and never changes any, and a run that is broken off leaves none.
    """
    spark = blocks.sparkSession
    path = f"{store.rstrip('/')}/{how.name(spark)}"
    wanted = cut_lineage(contents(blocks), "contents")
    known = _read(spark, path).where(F.col("win_no").isNull()).select("content")
    fresh = cut_lineage(wanted.join(known, "content", "left_anti").groupBy("content").agg(F.min("record_id").alias("record_id")), "fresh")
    if not fresh.isEmpty():
        made = extract(blocks.join(fresh.select("record_id"), "record_id", "left_semi"), how).join(fresh, "record_id").drop("record_id")
        marks = fresh.select("content", *[F.lit(None).cast(f.dataType).alias(f.name) for f in _read(spark, path).schema.fields[1:]])
        made.select(marks.columns).unionByName(marks).write.mode("append").parquet(path)
    held = _read(spark, path).where(F.col("win_no").isNotNull())
    return wanted.join(held, "content"), fresh


def fused(features: DataFrame, channels: Sequence[str], size: int) -> DataFrame:
    """One row per record and window: ``x``, the channels' features one after another, and ``present``, the names of those there.

    A channel that a recording lacks counts as ``size`` zeros, so all rows have one length; windows without any of the channels are left out.
    """
    met = features.where(F.col("channel").isin(*channels)).groupBy("record_id", "win_no").agg(
        F.map_from_entries(F.collect_list(F.struct("channel", "features"))).alias("__f"))
    zeros = F.array_repeat(F.lit(0.0), size)
    return met.select("record_id", "win_no", F.flatten(F.array(*[F.coalesce(F.try_element_at("__f", F.lit(c)), zeros) for c in channels])).alias("x"),
                      F.filter(F.array(*map(F.lit, channels)), lambda c: F.array_contains(F.map_keys("__f"), c)).alias("present"))


def experiment_rows(blocks: DataFrame, splits: DataFrame, how: Extraction, store: str, channels: Sequence[str]) -> DataFrame:
    """From recordings and ``splits(record_id, patient, label, subset)`` to the rows that experiments read, with ``row_id``.

    Only recordings in the table are looked at. A recording's windows meet its row once, on a unique key.
    """
    wanted = blocks.join(splits.select("record_id"), "record_id", "left_semi").where(F.col("channel").isin(*channels))
    features, _ = stored_features(wanted, how, store)
    rows = fused(features, channels, 2 * how.mel.n_mels).join(splits, "record_id")
    return rows.withColumn("row_id", F.concat_ws("#", F.col("record_id").cast("string"), F.col("win_no").cast("string")))
