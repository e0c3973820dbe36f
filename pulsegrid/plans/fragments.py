"""From recordings and a split table to the fragments that experiments read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pulsegrid.operators.blocks import KEYS, salted_join
from pulsegrid.operators.windows import WindowSpec, windows
from pulsegrid.plans.preprocess import CHANNEL_COLUMNS, by_kind_blocks


def named_channels(blocks: DataFrame, columns: dict[str, int] = CHANNEL_COLUMNS) -> DataFrame:
    """Blocks whose ``channel`` is a column number, as ingest writes them, under the channels' names; columns
    without a name are left out."""
    names = F.create_map(*[F.lit(x) for name, at in columns.items() for x in (at, name)])
    return blocks.withColumn("channel", F.try_element_at(names, F.col("channel").cast("int"))).where(F.col("channel").isNotNull())


def fragments(splits: DataFrame, blocks: DataFrame, block: int, fs_in: int | None, fs_out: int, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """Fragments of the recordings in ``splits(record_id, patient, label, subset)``, which has one row a record (one fold).

    ``blocks`` are recordings with channel names, all of rate ``fs_in``, or without it each of the rate in its ``fs`` column. Each channel goes through the chain of its kind and is
    windowed: ``record_id, channel, win_no, start_idx, valid_len, waveform`` and the columns of ``splits``. Recordings that are
    not in the table are left out before any work; a long record's fragments meet its row on several tasks.
    """
    start, win, hop = spec.samples(fs_out)
    wanted = blocks.join(splits.select("record_id"), "record_id", "left_semi")
    clean = by_kind_blocks(wanted, block, fs_in, fs_out)
    cut = windows(clean, block, start, win, hop, KEYS)
    return salted_join(cut, splits, "record_id", F.col("win_no"))


def stacked(rows: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One row per record and window with ``waveforms``, an array per channel that is there, in the order given, and their names in
    ``present``.

    Windows without any of the channels are left out (``lacking`` lists what is missing); a group is one window's channels.
    """
    place = F.array_position(F.array(*map(F.lit, channels)), F.col("channel"))
    own = [c for c in rows.columns if c not in ("channel", "waveform", "valid_len")]
    met = rows.where(F.col("channel").isin(*channels)).groupBy(*own).agg(
        F.array_sort(F.collect_list(F.struct(place.alias("at"), "channel", "waveform"))).alias("__w"), F.min("valid_len").alias("valid_len"))
    return met.select(*own, "valid_len", F.col("__w.waveform").alias("waveforms"), F.col("__w.channel").alias("present"))


def lacking(blocks: DataFrame, channels: Sequence[str]) -> DataFrame:
    """``record_id, missing``: the channels that each recording with named channels doesn't have; whole recordings aren't listed."""
    held = blocks.groupBy("record_id").agg(F.collect_set("channel").alias("__held"))
    return held.select("record_id", F.array_except(F.array(*map(F.lit, channels)), "__held").alias("missing")).where(F.size("missing") > 0)
