"""Exact clustering around centroids, with bounds that spare most distances.

Every vector carries an upper bound of the distance to its own centroid and a lower bound of the distance to any
other. When centroids move, the upper bound grows by its centroid's drift. The lower bound is loosened by less than
the largest drift: all vectors of a cluster lie in a sphere around its old centroid, and how much nearer another
centroid can have come to a point of that sphere is a question in one plane, that of the sphere's centre and the
other centroid's old and new place. Only vectors whose bounds then overlap are compared with all centroids, exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulsegrid.llm.common import delete_path
from pulsegrid.llm.vectors import matrix
from pulsegrid.session import scratch_path

#: Integer components up to this size have exact squared distances in double precision (64 places).
EXACT = 2.0 ** 22
#: Pieces into which a quarter of a sphere's outline is cut to bound how near a centroid may have come.
PIECES = 64
#: Bounds must differ by this share of their size before a comparison is spared.
SLACK = 1e-9

STATE = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("cluster", T.IntegerType()),
    T.StructField("upper", T.DoubleType()), T.StructField("lower", T.DoubleType()), T.StructField("distance", T.DecimalType(38, 0)),
    # One more row per task and cluster holds what the next round needs; all other columns of it are null.
    T.StructField("of_cluster", T.IntegerType()), T.StructField("moved", T.ArrayType(T.DecimalType(38, 0))),
    T.StructField("radius", T.DoubleType()), T.StructField("scanned", T.LongType())])


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer-valued rows to integer-valued centroids; Python integers where doubles don't suffice."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT / max(1, np.sqrt(x.shape[1] / 64)):
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
    whole = lambda m: np.array([[int(y) for y in row] for row in m], dtype=object).reshape(m.shape)
    a, b = whole(x), whole(c)
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1)


def nearer_by(centre: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> float:
    """An upper bound of ``|x - old| - |x - new|`` over the sphere, at most the drift ``|new - old|``.

    In the plane of the three points, with t along the drift from ``old`` and y across: the difference grows with t, and
    with y it falls where t is beyond the middle of the drift and grows before it. So over a box it is greatest in one
    corner, and the sphere's outline towards growing t is covered by small boxes.
    """
    step = new - old
    drift = float(np.linalg.norm(step))
    if drift == 0 or not np.isfinite(radius):
        return drift
    along = float((centre - old) @ step) / drift
    across = float(np.sqrt(max(0.0, float((centre - old) @ (centre - old)) - along * along)))
    angle = np.linspace(0, np.pi / 2, PIECES + 1)
    t = along + radius * np.cos(angle[:-1])
    near, far = np.maximum(0, across - radius * np.sin(angle[1:])), across + radius
    y = np.where(t >= drift / 2, near, far)
    most = float((np.hypot(t, y) - np.hypot(t - drift, y)).max())
    return min(drift, most + SLACK * (1 + radius + abs(along) + across + drift))


@dataclass
class Round:
    """What a task needs to know of a round: centroids, their drifts, and by how much each cluster's lower bounds loosen."""

    centroids: np.ndarray
    drift: np.ndarray
    loosening: np.ndarray
    last: bool = False

    @staticmethod
    def after(old: np.ndarray, new: np.ndarray, radius: np.ndarray, last: bool) -> Round:
        k = len(new)
        loose = [max([nearer_by(old[i], radius[i], old[j], new[j]) for j in range(k) if j != i], default=0.0) for i in range(k)]
        return Round(new, np.linalg.norm(new - old, axis=1), np.array(loose), last)


@dataclass
class _Sums:
    """What a task sends on: changes of counts and sums, radii, and how many vectors were scanned."""

    k: int
    places: int
    moved: list = field(init=False)
    radius: np.ndarray = field(init=False)
    scanned: np.ndarray = field(init=False)

    def __post_init__(self):
        self.moved = [[0] * (self.places + 1) for _ in range(self.k)]
        self.radius, self.scanned = np.full(self.k, -1.0), np.zeros(self.k, np.int64)

    def add(self, x: np.ndarray, was: np.ndarray, now: np.ndarray) -> None:
        changed = np.flatnonzero(was != now)
        for c in range(self.k):
            for rows, sign in ((changed[now[changed] == c], 1), (changed[was[changed] == c], -1)):
                if len(rows):
                    part = x[rows]
                    exact = np.abs(part).max() * len(rows) < 2.0 ** 53
                    total = part.sum(axis=0) if exact else np.array([[int(v) for v in r] for r in part], dtype=object).sum(axis=0)
                    self.moved[c] = [a + sign * int(b) for a, b in zip(self.moved[c], [len(rows), *total.tolist()], strict=True)]

    def batch(self) -> pa.RecordBatch:
        some = [c for c in range(self.k) if self.radius[c] >= 0 or any(self.moved[c])]
        arrow = to_arrow_schema(STATE)
        held = {"of_cluster": some, "moved": [[Decimal(v) for v in self.moved[c]] for c in some],
                "radius": [float(self.radius[c]) for c in some], "scanned": [int(self.scanned[c]) for c in some]}
        return pa.RecordBatch.from_arrays([pa.array(held.get(f.name, [None] * len(some)), f.type) for f in arrow], schema=arrow)


def _assign(x: np.ndarray, was: np.ndarray, upper: np.ndarray, lower: np.ndarray, now: Round) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """New clusters, bounds, and which vectors were compared with all centroids."""
    cluster, known = was.copy(), was >= 0
    upper = np.where(known, upper + now.drift[np.maximum(was, 0)], np.inf)
    lower = np.where(known, lower - now.loosening[np.maximum(was, 0)], -np.inf)
    clear = lambda u, l: u + SLACK * (1 + u) < l
    close = np.flatnonzero(~clear(upper, lower) & known)
    for c in np.unique(cluster[close]):
        rows = close[cluster[close] == c]
        upper[rows] = np.sqrt(squared(x[rows], now.centroids[c:c + 1])[:, 0].astype(np.float64)) * (1 + 1e-15)
    scan = np.flatnonzero(~clear(upper, lower))
    if len(scan):
        d = squared(x[scan], now.centroids)
        cluster[scan] = d.argmin(axis=1)  # of equal ones the smaller number
        d = np.sqrt(np.sort(d, axis=1)[:, :2].astype(np.float64))
        upper[scan] = d[:, 0] * (1 + 1e-15)
        lower[scan] = d[:, 1] * (1 - 1e-15) if d.shape[1] > 1 else np.inf
    return cluster, upper, lower, scan


def _pass(now: Round, places: int):
    arrow = to_arrow_schema(STATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(len(now.centroids), places)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"))
            was, upper, lower = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("cluster", "upper", "lower"))
            cluster, upper, lower, scan = _assign(x, was, upper, lower, now)
            sums.add(x, was, cluster)
            np.maximum.at(sums.radius, cluster, upper)
            np.add.at(sums.scanned, cluster[scan], 1)
            distance = [None] * len(x)
            if now.last:
                for c in np.unique(cluster):
                    rows = np.flatnonzero(cluster == c)
                    for i, d in zip(rows.tolist(), squared(x[rows], now.centroids[c:c + 1])[:, 0].tolist(), strict=True):
                        distance[i] = Decimal(int(d)) if d < 10 ** 38 else None
            own = {"id": batch.column("id"), "v": batch.column("v"), "cluster": cluster, "upper": upper, "lower": lower, "distance": distance}
            arrays = [pa.array(own[f.name], f.type) if isinstance(own.get(f.name), (np.ndarray, list)) else own.get(f.name, pa.nulls(len(x), f.type))
                      for f in arrow]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow, strict=True)], schema=arrow)
        yield sums.batch()

    return run


def integer_vectors(table: DataFrame, id: str, vector: str, places: int, scale: int) -> DataFrame:
    """``(id, v)`` with ``v`` the floors of ``scale`` times each component, for vectors of ``places`` finite components."""
    v, y = F.col("v"), lambda x: x * F.lit(float(scale))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(y(x)) < float("inf")))
    floor = F.transform("v", lambda x: F.when(F.abs(y(x)) < 2.0 ** 53, F.floor(y(x)).cast("double")).otherwise(y(x)))
    return (table.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
            .where(v.isNotNull() & (F.size(v) == places) & finite).select("id", floor.alias("v")))


@dataclass
class Clustering:
    """The last state (``id, v, cluster, distance``), the final centroids, and how many vectors each pass compared with all centroids."""

    vectors: DataFrame
    centroids: list[list[int]]
    scanned: list[int]


def fit(table: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, places: int = 64,
        scale: int = 1024, seed: str = "3:") -> Clustering:
    """Exact rounds of assignment and replacement by floors of means, then one more assignment.

    The first centroids are the ``k`` vectors whose ids hash lowest (SHA-256 of ``seed`` and the id); of equal hashes
    the one with the smaller components. Null ids come last as such. Repeated rows each count. With fewer than ``k`` vectors
    there are as many centroids; without any, no rows. Vectors that are null, of another length than ``places``, or
    with null or non-finite components (also after scaling) take no part.

    Each pass is narrow and is written with its bounds to the shared folder; the table before it is then deleted. The
    driver holds centroids, sums and radii only.
    """
    spark = table.sparkSession
    start = integer_vectors(table, id, vector, places, scale)
    key = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    first = [r["v"] for r in start.orderBy(key.asc_nulls_last(), "v").limit(k).collect()]
    state = start.select("id", "v", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    if not first:
        return Clustering(state.withColumn("distance", F.lit(None).cast("decimal(38,0)")), [], [])
    whole = [[int(x) for x in c] for c in first]
    now, scanned, before = Round(np.array(first), np.zeros(len(first)), np.zeros(len(first))), [], None
    counts, sums = [0] * len(first), [[0] * places for _ in first]
    for r in range(rounds + 1):
        now.last = r == rounds
        path = scratch_path(spark, f"centroids-{r}")
        state.select("id", "v", "cluster", "upper", "lower").mapInArrow(_pass(now, places), STATE).write.parquet(path)
        written = spark.read.schema(STATE).parquet(path)
        state = written.where(F.col("of_cluster").isNull())
        if before:
            delete_path(spark, before)
        before = path
        parts = written.where(F.col("of_cluster").isNotNull())
        scanned.append(parts.agg(F.sum("scanned")).first()[0])
        if now.last:
            break
        radius = np.zeros(len(whole))
        for c, far in parts.groupBy("of_cluster").agg(F.max("radius")).collect():
            radius[c] = max(0.0, far)
        changes = parts.select("of_cluster", F.posexplode("moved").alias("place", "m")).groupBy("of_cluster", "place").agg(F.sum("m")).collect()
        for c, place, m in changes:
            if place:
                sums[c][place - 1] += int(m)
            else:
                counts[c] += int(m)
        whole = [[s // n for s in total] if n else old for total, n, old in zip(sums, counts, whole, strict=True)]
        now = Round.after(now.centroids, np.array(whole, dtype=np.float64), radius, False)
    return Clustering(state, whole, scanned)


def clusters(table: DataFrame, **options) -> DataFrame:
    """One row per vector that takes part: its cluster, its squared distance, the cluster's and all clusters' sum of distances,
    and the digest of its final centroid. Sums that no long can hold are null. See ``fit`` for the options."""
    done = fit(table, **options)
    id = options.get("id", "vec_id")
    fits = lambda c: F.when(c <= F.lit(2 ** 63 - 1), c).cast("long")
    totals = {r[0]: r[1] for r in done.vectors.groupBy("cluster").agg(F.sum("distance")).collect()}  # one row a cluster
    everything = None if None in totals.values() else sum(totals.values(), Decimal(0))
    digest = {c: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for c, v in enumerate(done.centroids)}
    by_cluster = lambda values, kind: _map(values, kind)[F.col("cluster")] if values else F.lit(None).cast(kind)
    return done.vectors.select(
        F.col("id").alias(id), "cluster", fits(F.col("distance")).alias("distance"),
        fits(by_cluster(totals, "decimal(38,0)")).alias("cluster_inertia"), fits(F.lit(everything).cast("decimal(38,0)")).alias("inertia"),
        by_cluster(digest, "string").alias("centroid_sha256"))


def _map(values: dict, kind: str) -> Column:
    return F.create_map(*[x for c, v in values.items() for x in (F.lit(c), F.lit(v).cast(kind))])
