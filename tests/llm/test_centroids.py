"""Exact clustering against plain rounds, and the bounds against sampled points."""

import hashlib

import numpy as np
import pytest

from pulsegrid.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string"


def frame(spark, vectors, ids=None, kind=SCHEMA):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "clash") for i, v in zip(ids, vectors, strict=True)], kind)


def plain(ids, vectors, k=8, rounds=10):
    """Python integers throughout; ids and vectors that take part."""
    x = [[int(np.floor(1024 * np.float64(c))) for c in v] for v in vectors]
    key = lambda i: (ids[i] is None, hashlib.sha256(f"3:{ids[i]}".encode()).hexdigest() if ids[i] is not None else "", x[i])
    centres = [x[i] for i in sorted(range(len(x)), key=key)[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    assign = lambda: [min(range(len(centres)), key=lambda c: (far(v, centres[c]), c)) for v in x]
    for _ in range(rounds):
        at = assign()
        for c in range(len(centres)):
            own = [v for v, a in zip(x, at, strict=True) if a == c]
            if own:
                centres[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    at = assign()
    d = [far(v, centres[a]) for v, a in zip(x, at, strict=True)]
    inertia = {c: sum(e for e, a in zip(d, at, strict=True) if a == c) for c in set(at)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(map(str, [(i, a, e, inertia[a], sum(d), digest[a]) for i, a, e in zip(ids, at, d, strict=True)]))


def grouped(n, d, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((12, d))
    return (middle[rng.integers(0, 12, n)] + spread * rng.standard_normal((n, d))).astype(np.float32)


@pytest.mark.parametrize("seed,spread", [(1, 0.1), (2, 1.0)])
def test_against_plain_rounds(spark, seed, spread):
    x = grouped(300, 64, seed, spread)
    got = [tuple(r) for r in centroids.clusters(frame(spark, x)).collect()]
    assert sorted(map(str, got)) == plain(list(range(300)), x)


def test_what_takes_no_part_repeats_ties_and_large_values(spark):
    x = [list(v) for v in grouped(40, 64, 3, 0.5)]
    x[5] = x[4]
    x[6] = [-v for v in x[6]]
    x[7] = [3e9] + [0.25] * 63
    out = [None, [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [float("nan")] * 64, [float("inf")] * 64, []]
    ids = [*range(40), *range(100, 107)]
    ids[9], ids[10] = 8, None
    got = [tuple(r) for r in centroids.clusters(frame(spark, x + out, ids).repartition(5)).collect()]
    want = plain(ids[:40], np.array(x, dtype=np.float32))
    limit = lambda n: n if n is None or n < 2 ** 63 else None
    clean = sorted(str(tuple(limit(c) if isinstance(c, int) else c for c in eval(r))) for r in want)  # noqa: S307
    assert sorted(map(str, got)) == clean


def test_few_vectors_and_none(spark):
    one = [[0.5] * 64]
    assert sorted(tuple(r)[:4] for r in centroids.clusters(frame(spark, one * 3)).collect()) == [(i, 0, 0, 0) for i in range(3)]
    assert sorted(map(str, [tuple(r) for r in centroids.clusters(frame(spark, grouped(5, 64, 4))).collect()])) == plain(list(range(5)), grouped(5, 64, 4))
    for rows in (frame(spark, one).limit(0), frame(spark, [None, [1.0]])):
        empty = centroids.clusters(rows)
        assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_sphere_bound_holds_and_is_tighter_than_the_drift():
    rng = np.random.default_rng(5)
    tighter = 0
    for _ in range(300):
        d = int(rng.integers(2, 9))
        centre, old = rng.standard_normal(d) * 3, rng.standard_normal(d) * 3
        new, radius = old + rng.standard_normal(d) * rng.choice([0.01, 0.5, 4]), float(rng.choice([0.0, 0.1, 1, 5]))
        ray = rng.standard_normal((4000, d))
        x = centre + ray / np.linalg.norm(ray, axis=1)[:, None] * radius * rng.random((4000, 1)) ** 0.2
        most = (np.linalg.norm(x - old, axis=1) - np.linalg.norm(x - new, axis=1)).max()
        bound = centroids.nearer_by(centre, radius, old, new)
        drift = np.linalg.norm(new - old)
        assert most <= bound <= drift + 1e-12
        tighter += bound < 0.9 * drift
    assert tighter > 100


def test_bounds_spare_comparisons_and_spare_more_than_the_drift(spark, monkeypatch):
    x = grouped(2000, 64, 6, 0.2)
    table = frame(spark, x)
    scanned = sum(centroids.fit(table).scanned[1:])
    assert scanned < 0.5 * 10 * len(x)
    monkeypatch.setattr(centroids, "nearer_by", lambda centre, radius, old, new: float(np.linalg.norm(new - old)))
    assert scanned <= sum(centroids.fit(table).scanned[1:])
