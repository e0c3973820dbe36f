"""SimHash fingerprints, and all pairs within a radius by covering locality-sensitive hashing.

A fingerprint has 64 bits. Every bit position gets a vector of ``radius + 1`` bits that isn't zero, and every
such vector ``v`` is a table whose mask keeps the positions with an odd inner product with ``v``. The
positions in which two fingerprints differ, at most ``radius``, span less than the whole space, so some
``v`` is orthogonal to all of them: in that table the two fall in one bucket, always, not only likely.

Only distinct fingerprints are hashed. A bucket's rows come sorted to one task, which checks them pairwise
and hands on a spanning forest instead of all links. A bucket of more than ``DENSE`` distinct fingerprints
goes another exact way: two of them are linked if and only if some value lies within half the radius of both,
so each is sent to all such values and every value links what it gets, in linear time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from pulsegrid.llm.common import free_name, spread_join, with_text_columns
from pulsegrid.llm.components import components
from pulsegrid.session import cut_lineage

BITS, SEED, DENSE = 64, 42, 1024
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
FINGERPRINT = "fingerprint"


def fingerprint(text: bytes, words: int = 4) -> int:
    """The SimHash of a text as a signed 64-bit number.

    A-Z are lower-cased, words stand between ASCII whitespace; a shingle is ``words`` words joined by
    spaces, repeats count, a shorter text is one shingle. A bit is set if it is set in over half of the
    shingles' XXH64. No word: zero.
    """
    found = text.translate(LOWER).split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= words:
        shingles = [line]
    else:
        n = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(n + 1) - 1
        shingles = [line[a:b] for a, b in zip((ends - n)[:1 - words].tolist(), ends[words - 1:].tolist(), strict=True)]
    raw = b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED)))
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
    over = np.add.reduce(bits, axis=0, dtype=np.int64) * 2 > len(shingles)
    return int.from_bytes(np.packbits(over).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", out: str = FINGERPRINT, words: int = 4, keep: bool = False) -> DataFrame:
    """``docs`` plus the fingerprint of each whole text, without a shuffle; null texts count as empty.
    ``keep=False`` drops the text."""
    def make():
        return lambda texts: [[fingerprint(t, words) for t in texts.cast(pa.binary()).to_pylist()]]

    return with_text_columns(docs, text, [T.StructField(out, T.LongType())], make, keep)


def covering_masks(radius: int) -> list[int]:
    """One mask per vector of ``radius + 1`` bits but zero, as signed numbers."""
    tables = 2 ** (radius + 1) - 1
    masks = []
    for v in range(1, tables + 1):
        mask = sum(1 << i for i in range(BITS) if ((1 + i % tables) & v).bit_count() % 2)
        masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return masks


def _forest(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is connected within the radius in one bucket."""
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    new, links = np.ones(len(x), bool), []
    for start in range(len(x)):
        if new[start]:
            new[start], queue = False, [start]
            while queue:
                i = queue.pop()
                for j in np.flatnonzero(near[i] & new).tolist():
                    new[j] = False
                    queue.append(j)
                    links.append((i, j))
    return links


def _bucket_links(radius: int):
    """Rows ``(table, bucket, fp)`` in that order to ``(table, a, b)``: a link, or with ``b`` null a
    fingerprint of a bucket that is too large for pairs."""
    names = ["table", "a", "b"]

    def emit(table, a, b, dense=False):
        return pa.RecordBatch.from_arrays([
            pa.array(table, pa.int32()), pa.array(a, pa.int64()),
            pa.nulls(len(a), pa.int64()) if dense else pa.array(b, pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, dense = None, None  # rows of the bucket that may go on; the large bucket that is open
        for batch in batches:
            rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns]) if batch.num_rows else None
            if rows is None:
                continue
            if dense is not None:
                other = np.flatnonzero((rows[0] != dense[0]) | (rows[1] != dense[1]))
                n = int(other[0]) if len(other) else rows.shape[1]
                if n:
                    yield emit(rows[0, :n], rows[2, :n], None, True)
                rows, dense = rows[:, n:], dense if n == rows.shape[1] else None
                if not rows.shape[1]:
                    continue
            if held is not None:
                rows = np.concatenate([held, rows], axis=1)
            cuts = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            yield from finished(rows[:, :last], np.concatenate([[0], cuts]))
            held = rows[:, last:]
            if held.shape[1] > DENSE:
                yield emit(held[0], held[2], None, True)
                held, dense = None, (held[0, 0], held[1, 0])
        if held is not None and held.shape[1]:
            yield from finished(held, np.array([0, held.shape[1]]))

    def finished(rows: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        table, fp = rows[0], np.ascontiguousarray(rows[2]).view(np.uint64)
        sizes = np.diff(bounds)
        two = bounds[:-1][sizes == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        if len(two):
            yield emit(table[two], rows[2][two], rows[2][two + 1])
        for i in np.flatnonzero(sizes > 2).tolist():
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a > DENSE:
                yield emit(table[a:b], rows[2][a:b], None, True)
            elif links := _forest(fp[a:b], radius):
                x = np.array(links) + a
                yield emit(table[x[:, 0]], rows[2][x[:, 0]], rows[2][x[:, 1]])

    return run


def _midpoint_links():
    """Rows ``(table, point, fp)`` in that order to links ``(a, b)`` from each fingerprint to its point's first."""
    def run(batches):
        point = first = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t, z, fp = (c.to_numpy().astype(np.int64) for c in batch.columns)
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (z[1:] != z[:-1])
            if point == (t[0], z[0]):
                new[0] = False
            heads = np.where(new, np.arange(len(t)), -1)
            heads = np.maximum.accumulate(heads)
            lead = np.where(heads >= 0, fp[heads], first if first is not None else 0)
            point, first = (t[-1], z[-1]), lead[-1]
            differs = lead != fp
            yield pa.RecordBatch.from_arrays([pa.array(lead[differs]), pa.array(fp[differs])], names=["a", "b"])

    return run


def _midpoints(radius: int, masks: list[int]):
    """Dense rows ``(table, fp)`` to all values within half the radius in the bits that the table leaves free."""
    flips = []
    for mask in masks:
        free = [i for i in range(BITS) if not mask >> i & 1]
        half = [0] + [sum(1 << i for i in c) for k in range(1, (radius + 1) // 2 + 1) for c in combinations(free, k)]
        flips.append(np.array(half, np.uint64))

    def run(batches):
        for batch in batches:
            for t, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                z = (np.uint64(fp & 0xFFFFFFFFFFFFFFFF) ^ flips[t]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(z), t, np.int32)), pa.array(z), pa.array(np.full(len(z), fp, np.int64))],
                                                 names=["table", "point", "fp"])

    return run


def links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the distinct values of column ``fp`` within ``radius`` bits.

    The radius must be even: half of it decides the midpoints. Null values link with nothing.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = covering_masks(radius)
    posted = prints.where("fp is not null").select("fp").distinct().select("fp", F.posexplode(F.array(*[
        F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("table", "bucket"))
    found = cut_lineage(
        posted.select("table", "bucket", "fp").repartition("table", "bucket").sortWithinPartitions("table", "bucket", "fp")
        .mapInArrow(_bucket_links(radius), "table int, a long, b long"), "bucket-links")
    pairs = found.where("b is not null").select("a", "b").distinct()
    dense = found.where("b is null").select("table", F.col("a").alias("fp"))
    if dense.isEmpty():
        return pairs
    points = dense.mapInArrow(_midpoints(radius, masks), "table int, point long, fp long")
    return pairs.union(points.repartition("table", "point").sortWithinPartitions("table", "point", "fp")
                       .mapInArrow(_midpoint_links(), "a long, b long").distinct())


def groups(prints: DataFrame, id: str = "doc_id", fp: str = FINGERPRINT, radius: int = 4) -> DataFrame:
    """One row ``(id, fp, component_id)`` per row of ``prints``: the smallest id among the rows reachable by
    links of at most ``radius`` differing bits, itself included.

    Equal fingerprints are one class, so copies cost one row. Repeated rows each keep their row; a null id
    is never smallest (a group of null ids only has component null); an empty table gives an empty one.
    """
    prints = prints.select(id, fp)
    classes = cut_lineage(prints.groupBy(F.col(fp).alias("fp")).agg(F.min(id).alias("least")), "classes")
    roots = components(links(classes, radius).select("a", "b"), "simhash-components")
    rooted = classes.join(roots, F.col("fp") == F.col("node")).select("fp", "least", "root")
    linked = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    alone = classes.join(linked, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    side = linked.union(alone).withColumnRenamed("fp", fp)
    return spread_join(prints, side, fp, F.col(id)).select(id, fp, "component_id")


def hexed(column: str):
    """A fingerprint as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """Rows of ``docs`` with one document left of each group of near duplicates, the one with the smallest id.

    Rows of one id are told apart by their texts: equal ones and near copies leave one row, others stay. Rows without an id
    can't be told apart and all stay.
    """
    mark = free_name(docs, "__mark")
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    prints = cut_lineage(fingerprints(marked.select(id, mark, text).where(F.col(id).isNotNull()), text), "fingerprints")
    keyed = prints.select(F.struct(id, mark).alias("key"), FINGERPRINT)
    chosen = (groups(keyed, "key", radius=radius).where(F.col("key") == F.col("component_id"))
              .select(F.col(f"key.{id}").alias(f"__{id}"), F.col(f"key.{mark}").alias(f"_{mark}")).distinct())
    joined = marked.join(chosen, (F.col(id) == F.col(f"__{id}")) & (F.col(mark) == F.col(f"_{mark}")), "left_semi").dropDuplicates([id, mark]).drop(mark)
    return joined.unionByName(docs.where(F.col(id).isNull()))
