"""Packing documents into sequences by patterns of lengths.

Only the histogram of piece lengths, at most as many numbers as a sequence has places, reaches the driver. There,
patterns of a few lengths that fill a sequence exactly are enumerated, non-negative least squares fits how often each is
to be used to the histogram, the counts are rounded, and what is left over is packed longest first with the best fit,
again as patterns. Pieces of one length are interchangeable, so each piece finds its sequence and its place from its
length and its number among the pieces of that length.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulsegrid.llm import tokenizers
from pulsegrid.llm.common import slices, texts_of, without

CAPACITY, SWEEPS, PATTERNS, NUMBERED = 4096, 60, 6000, 1000

#: Lengths of a pattern with how many of each, longest first.
Pattern = tuple[tuple[int, int], ...]


def pieces(docs: DataFrame, path: str, end: int = 1, most: int = CAPACITY, text: str = "text") -> DataFrame:
    """Documents as token pieces: the other columns of ``docs`` plus ``piece`` (from 0), ``start`` (ids of the document
    before it), ``length`` and ``ids`` (little-endian, 32 bits each).

    A document is its ids and the id ``end``; null text counts as empty, so every document has a piece. Only documents of
    more than ``most`` ids are cut. No shuffle; rows are independent, so repeats and null ids are rows like others. Columns of the names
    that are added are replaced.
    """
    docs = without(docs, ["piece", "start", "length", "ids"], [text])
    own = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*own, T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizers.load(path, words=True)
        for batch in batches:
            for part in slices(batch, text):
                flat, n = model.chunks.encode(texts_of(part, text))
                flat = np.insert(flat, np.cumsum(n), end).astype("<i4")
                n = n + 1
                cuts = -(-n // most)
                row = np.repeat(np.arange(len(n)), cuts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * most
                length = np.minimum(most, n[row] - start)
                offsets = np.concatenate([[0], np.cumsum(length * 4)]).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])
                kept = [part.column(c).take(pa.array(row)) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), ids], names=arrow.names)
                del kept, ids
                pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, schema)


def enumerate_patterns(lengths: Sequence[int], capacity: int, most: int = PATTERNS) -> list[Pattern]:
    """Multisets of two to four of the lengths that fill ``capacity`` exactly, at most ``most`` of them.

    All pairs come first. Triples and fours begin with lengths spread evenly over those there are, their number set by
    ``most``. Which are left out changes only how much the rest has to pack.
    """
    there, found = set(lengths), dict.fromkeys(())
    ordered = sorted(there, reverse=True)

    def add(*parts: int) -> None:
        found[tuple((n, parts.count(n)) for n in sorted(set(parts), reverse=True))] = None

    for a in ordered:
        if capacity - a in there and 2 * a >= capacity:
            add(a, capacity - a)
    step = max(1, round(len(ordered) / max(1, (most / 2) ** 0.5)))
    for a in ordered[::step]:
        for b in ordered[step // 2::step]:
            if b <= a and capacity - a - b in there and capacity - a - b <= b:
                add(a, b, capacity - a - b)
    step = max(1, round(len(ordered) / max(1, (2 * most) ** (1 / 3))))
    some = ordered[step // 3::step]
    for a in some:
        for b in some:
            for c in some:
                if a >= b >= c >= capacity - a - b - c and capacity - a - b - c in there:
                    add(a, b, c, capacity - a - b - c)
    return list(found)[:most]


def fit_counts(patterns: Sequence[Pattern], histogram: dict[int, int], sweeps: int = SWEEPS) -> np.ndarray:
    """Non-negative repeat counts whose sum of patterns is nearest to the histogram, by cyclic coordinate descent."""
    left, x = {n: float(c) for n, c in histogram.items()}, np.zeros(len(patterns))
    norms = [sum(m * m for _, m in p) for p in patterns]
    for _ in range(sweeps):
        moved = 0.0
        for j, p in enumerate(patterns):
            change = max(-x[j], sum(left[n] * m for n, m in p) / norms[j])
            if change:
                x[j] += change
                for n, m in p:
                    left[n] -= m * change
                moved = max(moved, abs(change))
        if moved < 0.01:
            break
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY, fitted: bool = True) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is packed; together exactly the histogram. ``fitted=False`` leaves all to the residual step."""
    left, chosen = dict(histogram), []

    def use(pattern: Pattern, times: int) -> None:
        if times > 0:
            chosen.append((pattern, times))
            for n, m in pattern:
                left[n] -= m * times

    if capacity in left:
        use(((capacity, 1),), left[capacity])
    open_ = {n: c for n, c in left.items() if c and n < capacity}
    if fitted and open_:
        patterns = enumerate_patterns(list(open_), capacity)
        x = fit_counts(patterns, open_)
        for j in np.argsort(-x, kind="stable").tolist():
            use(patterns[j], min(int(x[j]), *(left[n] // m for n, m in patterns[j])))
    rest = sorted(n for n, c in left.items() if c)
    while rest:
        room, pattern = capacity, []
        below = len(rest)
        while below:
            n = rest[below - 1]
            m = min(room // n, left[n])
            if m:
                pattern.append((n, m))
                room -= n * m
            below = min(below - 1, bisect_right(rest, room))
        use(tuple(pattern), min(left[n] // m for n, m in pattern))
        rest = [n for n in rest if left[n]]
    return chosen


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """The plan with fewer sequences of the fitted one and the one that packs all by best fit; the fitted one if equal.

    Only for comparison: ``place`` always takes the fitted one.
    """
    plans = [plan(histogram, capacity), plan(histogram, capacity, fitted=False)]
    return min(plans, key=lambda p: sum(times for _, times in p))


def place(rows: DataFrame, keys: Sequence[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``rows`` plus ``sequence_id`` and ``offset``: gapless sequences of at most ``capacity``.

    Lengths must be from 1 to ``capacity``. ``rows`` is read three times: give a written table. ``keys`` tell rows apart; rows
    alike in them are interchangeable. Rows are numbered within slices of a length (hash of the keys, about
    ``NUMBERED`` rows each), so a length that very many pieces share is no hot task. Columns named ``sequence_id`` or ``offset`` are replaced.
    """
    rows = without(rows, ["sequence_id", "offset"], [length, *keys])
    counts = {int(n): int(c) for n, c in rows.groupBy(length).count().collect()}  # at most ``capacity`` rows
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    slots, base, taken = [], 0, dict.fromkeys(counts, 0)
    for pattern, times in plan(counts, capacity):
        at = 0
        for n, m in pattern:
            slots.append((n, taken[n], m, base, at))
            taken[n] += m * times
            at += n * m
        base += times
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 5)
    spark = rows.sparkSession
    # One row a length, so at most ``capacity`` rows: broadcast.
    spread = spark.createDataFrame([(n, -(-c // NUMBERED)) for n, c in counts.items()], f"`{length}` long, __slices long")
    cut = (rows.join(F.broadcast(spread), length)
           .withColumn("__hash", F.xxhash64(*keys)).withColumn("__slice", F.pmod("__hash", "__slices")))
    sums = cut.groupBy(length, "__slice").count().select(length, "__slice", (F.sum("count").over(
        Window.partitionBy(length).orderBy("__slice")) - F.col("count")).alias("__before"))
    inside = Window.partitionBy(length, "__slice").orderBy("__hash", *keys)
    numbered = (cut.withColumn("__number", F.row_number().over(inside)).join(sums, [length, "__slice"])
                .select(*rows.columns, (F.col("__number") - 1 + F.col("__before")).alias("__number")))
    own = list(rows.columns)
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.int64(1) << 40
        starts = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            if batch.num_rows:
                n, number = (batch.column(c).to_numpy().astype(np.int64) for c in (length, "__number"))
                slot = table[np.searchsorted(starts, n * wide + number, side="right") - 1]
                local = number - slot[:, 1]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(slot[:, 3] + local // slot[:, 2]),
                                                  pa.array(slot[:, 4] + local % slot[:, 2] * n)], names=[*own, "sequence_id", "offset"])

    return numbered.mapInArrow(run, schema)
