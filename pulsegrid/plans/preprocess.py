"""Cleaning chains per signal kind: fill gaps, resample, remove spikes, band, normalise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pulsegrid.operators.blocks import KEYS, resize, to_blocks
from pulsegrid.operators.kernels import four_bands, resample, resample_mixed
from pulsegrid.operators.normalise import abs_max
from pulsegrid.operators.recursive import band
from pulsegrid.operators.repair import fill_gaps, remove_spikes
from pulsegrid.session import cut_lineage

# Pass bands in Hz (see filter_design.band_sections for the cutoff convention).
BANDS = {"pcg": (25.0, 450.0), "ecg": (2.0, 40.0)}
ECG_CHANNELS = ("E", "E2")
# Channel name to column of a multichannel recording.
CHANNEL_COLUMNS = {"1": 0, "2": 1, "3": 2, "4": 3, "5": 4, "6": 5, "7": 6, "E": 7, "E2": 8}


def _filled(samples, block, fs_in, fs_out, keys):
    return _filled_blocks(to_blocks(samples, block, keys), block, fs_in, fs_out, keys)


def _filled_blocks(blocks, block, fs_in, fs_out, keys):
    if fs_in is None:
        return resample_mixed(fill_gaps(blocks, block, (*keys, "fs")), block, fs_out, "fs", keys)
    return resample(fill_gaps(blocks, block, keys), block, fs_in, fs_out, keys)


def _despiked(x, block, fs_out, keys):
    win = round(fs_out / 2)
    flat = remove_spikes(resize(x, block, win, keys), win, keys=keys).drop("unresolved")
    return resize(flat, win, block, keys)


def pcg(samples: DataFrame, block: int, fs_in: int, fs_out: int, keys: Sequence[str] = KEYS,
        despike: bool = True, band_hz: tuple[float, float] = BANDS["pcg"]) -> DataFrame:
    """Heart-sound chain on long-form samples; returns blocks at ``fs_out``.

    The resampled signal is read several times by the spike removal, so it is written once.
    """
    x = _filled(samples, block, fs_in, fs_out, keys)
    if despike:
        x = _despiked(cut_lineage(x, "resampled"), block, fs_out, keys)
    return abs_max(band(x, block, fs_out, *band_hz, keys=keys), keys)


def ecg(samples: DataFrame, block: int, fs_in: int, fs_out: int, keys: Sequence[str] = KEYS
        ) -> DataFrame:
    """ECG chain: as ``pcg`` without spike removal and with the ECG band."""
    x = _filled(samples, block, fs_in, fs_out, keys)
    return abs_max(band(x, block, fs_out, *BANDS["ecg"], keys=keys), keys)


def by_kind(samples: DataFrame, block: int, fs_in: int, fs_out: int, keys: Sequence[str] = KEYS
            ) -> DataFrame:
    """Each channel through the chain of its kind, by channel name; shared steps run once."""
    return by_kind_blocks(to_blocks(samples, block, keys), block, fs_in, fs_out, keys)


def by_kind_blocks(blocks: DataFrame, block: int, fs_in: int | None, fs_out: int, keys: Sequence[str] = KEYS
                   ) -> DataFrame:
    """``by_kind`` for recordings that are blocks of ``block`` samples already.

    Without ``fs_in``, each recording is resampled from its own rate, in the column ``fs`` as ingest writes it.
    """
    whole = cut_lineage(_filled_blocks(blocks, block, fs_in, fs_out, keys), "resampled")
    is_ecg = F.col("channel").isin(*ECG_CHANNELS)
    banded = band(whole.where(is_ecg), block, fs_out, *BANDS["ecg"], keys=keys).unionByName(
        band(_despiked(whole.where(~is_ecg), block, fs_out, keys), block, fs_out, *BANDS["pcg"], keys=keys))
    return abs_max(banded, keys)


def bands4(samples: DataFrame, block: int, fs: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Four-band split of a heart-sound signal."""
    return four_bands(to_blocks(samples, block, keys), fs, keys)
