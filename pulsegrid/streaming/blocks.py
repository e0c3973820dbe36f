"""Overlapping sample windows out of a stream of blocks, whatever order the blocks come in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOWS = "record_id STRING, channel STRING, win_no BIGINT, start_idx BIGINT, valid_len INT, waveform ARRAY<DOUBLE>"
#: Of a signal: the next block in order, the sample that the tail begins with, the tail, the next window, and blocks that came too early.
STATE = ("next BIGINT, first BIGINT, tail ARRAY<DOUBLE>, win_no BIGINT, early ARRAY<BIGINT>, sizes ARRAY<INT>, samples ARRAY<DOUBLE>")


class Tail:
    """The part of a signal that windows still to come need, and the blocks that wait for one before them."""

    def __init__(self, start: int, win: int, hop: int, state: tuple | None = None):
        self.start, self.win, self.hop = start, win, hop
        self.next, self.first, tail, self.win_no, early, sizes, samples = state or (0, 0, [], 0, [], [], [])
        self.tail = np.array(tail, float)
        ends = np.cumsum(np.array(sizes, int)) if len(sizes) else np.zeros(0, int)
        values = np.array(samples, float)
        self.early = {int(b): values[e - s:e] for b, s, e in zip(early, sizes, ends)}

    def state(self) -> tuple:
        order = sorted(self.early)
        flat = np.concatenate([self.early[b] for b in order]) if order else np.zeros(0)
        return (self.next, self.first, self.tail.tolist(), self.win_no, order, [len(self.early[b]) for b in order], flat.tolist())

    def add(self, blocks: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """Windows that the blocks complete or, for a signal still shorter than a window, amend. A block that was there before is passed over."""
        for number, values in blocks:
            if number >= self.next:
                self.early.setdefault(number, values)
        parts = [self.tail]
        while self.next in self.early:
            parts.append(self.early.pop(self.next))
            self.next += 1
        if len(parts) == 1:
            return
        self.tail = np.concatenate(parts)
        size = self.first + len(self.tail)
        while True:
            at = self.start + self.win_no * self.hop
            if size >= at + self.win:
                yield self.win_no, at, self.win, self.tail[at - self.first:at - self.first + self.win]
                self.win_no += 1
                # Samples before the next window are of no more use.
                drop = min(self.start + self.win_no * self.hop - self.first, len(self.tail))
                self.first, self.tail = self.first + drop, self.tail[drop:]
                continue
            if self.win_no == 0 and size > at:
                held = self.tail[at - self.first:]
                yield 0, at, len(held), np.pad(held, (0, self.win - len(held)))
            return


def block_windows(stream: DataFrame, start: int, win: int, hop: int) -> DataFrame:
    """``operators.windows.windows`` for a stream of ``record_id, channel, block, values``: ``win_no, start_idx, valid_len, waveform``.

    Between batches a signal keeps the samples from its next window on, and the blocks whose predecessors have not come yet. A
    window is put out in the batch that completes it; a signal shorter than a window has one, padded, that later blocks amend. So the last row of
    each window (``write_updates`` and ``latest_updates``) equals the batch result for any order of blocks and batches, and repeated
    blocks change nothing. A signal's blocks of one batch are one group. Rows without a record, channel, block or values are left out.
    """
    keys = ["record_id", "channel"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        signal = Tail(start, win, hop, state.get if state.exists else None)
        blocks = [(int(b), np.array(v, float)) for pdf in batches for b, v in zip(pdf["block"], pdf["values"])]
        rows = [(*key, k, at, n, w.tolist()) for k, at, n, w in signal.add(sorted(blocks, key=lambda b: b[0]))]
        if rows:
            yield pd.DataFrame(rows, columns=[*keys, "win_no", "start_idx", "valid_len", "waveform"])
        state.update(signal.state())

    whole = stream.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col("block").cast("long").alias("block"),
                          F.col("values").cast("array<double>").alias("values")).dropna()
    return whole.groupBy(*keys).applyInPandasWithState(run, WINDOWS, STATE, "update", GroupStateTimeout.NoTimeout)
