"""Vector operators against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import ann, components, embdedup
from pulsegrid.llm.common import spread_join


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "clash") for i, v in zip(ids, vectors, strict=True)],
                                 "vec_id long, embedding array<float>, label int, score string")


def random_vectors(n, d, seed, scale=0.0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return (x * np.exp(scale * rng.standard_normal(n))[:, None]).astype(np.float32).astype(np.float64)


@pytest.mark.parametrize("d,scale", [(24, 0.0), (17, 0.5)])
def test_search_recall_and_scores(spark, d, scale):
    x = random_vectors(3000, d, 3, scale)
    rows = ann.nearest(frame(spark, x), F.col("id") % 20 == 0).collect()
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 3000, 20))
    recall = []
    for q, got in found.items():
        s = x @ x[q]
        s[q] = -np.inf
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21)) and q not in [g[1] for g in got]
        assert got == sorted(got, key=lambda g: (-g[2], g[1]))
        assert np.allclose([g[2] for g in got], s[[g[1] for g in got]], atol=1e-12)
        recall.append(len({g[1] for g in got} & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.9


def test_search_with_what_takes_no_part(spark):
    x = [[1, 0], None, [0, 0], [1, None], [float("nan"), 1], [2, 0], [1, 0], [0, 1], [1, 2, 3], []]
    got = {}
    for r in ann.nearest(frame(spark, x, [0, 1, 2, 3, 4, 20, 6, 7, 8, 9]), F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(v) for q, v in got.items()} == {0: [(1, 20, 2.0), (2, 6, 1.0), (3, 7, 0.0)], 20: [(1, 0, 2.0), (2, 6, 2.0), (3, 7, 0.0)]}
    assert ann.nearest(frame(spark, x).limit(0), F.col("id") % 20 == 0).count() == 0
    assert ann.nearest(frame(spark, x), F.col("id") < 0).count() == 0


def brute(x, least=0.9):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(x))])
        if (new == label).all():
            return near.sum(axis=1).tolist(), label.tolist()
        label = new


def near_copies(sizes, d, noise, seed):
    rng = np.random.default_rng(seed)
    parts = []
    for n, s in zip(sizes, noise, strict=True):
        c = rng.standard_normal(d)
        parts.append(c / np.linalg.norm(c) + s * rng.standard_normal((n, d)) / np.sqrt(d))
    return np.concatenate(parts).astype(np.float32).astype(np.float64)


# Tight groups, groups as wide as the radius of a ball, and groups that chain beyond the similarity.
@pytest.mark.parametrize("noise", [0.02, 0.12, 0.25, 0.33])
def test_links_are_those_of_all_pairs(spark, noise):
    x = np.concatenate([near_copies([400, 30, 2, 2, 3], 32, [noise] * 5, 4), random_vectors(300, 32, 5)])
    order = np.random.default_rng(6).permutation(len(x))
    x = x[order]
    links, label = brute(x)
    rows = sorted(embdedup.near_duplicates(frame(spark, x)).collect(), key=lambda r: r["vec_id"])
    assert sum(r["n_links"] for r in rows) >= 0.998 * sum(links) and all(r["n_links"] <= n for r, n in zip(rows, links, strict=True))
    assert np.mean([r["component_id"] == c for r, c in zip(rows, label, strict=True)]) >= 0.995
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)


def test_wide_balls_meet_although_their_centres_are_far_apart(spark):
    rng = np.random.default_rng(12)
    x, y = (embdedup.unit(rng.standard_normal((400, 64))) for _ in range(2))
    y = embdedup.unit(y - (x * y).sum(axis=1)[:, None] * x)
    y = x * np.cos(np.radians(45)) + y * np.sin(np.radians(45))
    rows = [(i, v.tolist(), 10.0, 2, i) for i, v in enumerate(np.concatenate([x, y]))]
    balls = spark.createDataFrame(rows, "ball long, centre array<float>, radius double, n long, least long")
    pairs = {(r["a"], r["b"]) for r in embdedup.candidate_pairs(balls, 25.84).collect()}
    assert sum((i, i + 400) in pairs for i in range(400)) >= 396


def test_vectors_that_link_with_nothing(spark):
    x = [[1, 0, 0], [2, 0, 0], None, [0, 0, 0], [1, None, 0], [float("inf"), 1, 0], [1, 0, 0], [0, 1, 0]]
    rows = embdedup.near_duplicates(frame(spark, [*x, [1, 0, 0], [1, 0, 0]], [5, 1, 2, 3, 4, 6, 7, 8, 7, None])).collect()
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in rows)
    assert got == sorted([("5", 2, 1, False), ("1", 2, 1, True), ("2", 0, 2, True), ("3", 0, 3, True), ("4", 0, 4, True), ("6", 0, 6, True),
                          ("7", 2, 1, False), ("7", 2, 1, False), ("8", 0, 8, True), ("None", 0, None, False)])
    assert embdedup.near_duplicates(frame(spark, x).limit(0)).count() == 0


def test_lengths_apart_and_repeated_ids_as_in_the_sql(spark, tmp_path):
    import duckdb

    from pulsegrid.llm.queries import QUERIES, SQL

    x = [[1, 0], [2, 0], [0, 1], [1, 0, 0], [1, 0.1, 0], [0, 3, 0], [0, 2.9, 0.1], [1, 0, 0, 0], [5], [-5], [2]]
    frame(spark, x).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(SQL["op7_cross_polytope"])
    columns = [c[0] for c in want.description]
    got = QUERIES["op7_cross_polytope"](spark, str(tmp_path)).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and dict((r["vec_id"], r["n_links"]) for r in got)[3] == 1
    # Of an id's vectors the smallest stands for it, however the rows are dealt out.
    rows = frame(spark, [[1, 0], [0, 1], [0, 1], [0, 2, 0]], [1, 1, 2, 3])
    for n in (1, 3, 7):
        assert sorted((r["vec_id"], r["n_links"]) for r in embdedup.near_duplicates(rows.repartition(n)).collect()) == [(1, 1), (1, 1), (2, 1), (3, 0)]


def test_search_by_length_with_repeated_ids_and_ties_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 5)
    x, y = random_vectors(300, 16, 8), random_vectors(120, 9, 9)
    x[100:140] = x[0]
    ids = [*range(300), *range(300, 420), 40, 7]
    rows = frame(spark, [*x, *y, x[40] + 1, x[7] - 9], ids).repartition(5)
    held = {i: v for i, v in zip(ids, [*x, *y], strict=False)}
    held[7] = min(x[7].tolist(), np.float32(x[7] - 9).astype(float).tolist())
    held[40] = min(x[40].tolist(), np.float32(x[40] + 1).astype(float).tolist())
    found, hits = {}, []
    for r in ann.nearest(rows, F.col("id") % 20 == 0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 420, 20))
    for q, got in found.items():
        score = {i: float(np.dot(held[q], v)) for i, v in held.items() if i != q and len(v) == len(held[q])}
        best = sorted(score, key=lambda i: (-round(score[i], 9), i))[:20]
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21)) and all(abs(g[2] - score[g[1]]) < 1e-9 for g in got)
        hits.append(len({g[1] for g in got} & set(best)) / 20)
    assert np.mean(hits) >= 0.9
    tied = [g[1] for g in sorted(found[0]) if 100 <= g[1] < 140]
    assert tied == list(range(100, 100 + len(tied))) and len(tied) > 10


def test_balls_are_as_wide_as_few_tables_allow():
    limit = float(embdedup.angles(np.array([0.9]))[0])
    for size in (64, 384, 768):
        widest = embdedup.ball_angle(size, limit)
        assert embdedup.tables_needed(size, limit + 2 * widest) <= embdedup.WORTH
    assert embdedup.ball_angle(64, limit) >= embdedup.ball_angle(768, limit)


def test_links_of_long_vectors(spark):
    x = np.concatenate([near_copies([60, 20, 5], 768, [0.1, 0.3, 0.4], 14), random_vectors(100, 768, 15)])
    links, label = brute(x)
    rows = sorted(embdedup.near_duplicates(frame(spark, x)).collect(), key=lambda r: r["vec_id"])
    assert [r["component_id"] for r in rows] == label and sum(r["n_links"] for r in rows) >= 0.998 * sum(links)


def test_large_buckets_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embdedup, "MEET", 8)
    monkeypatch.setattr(embdedup, "MEMBERS", 16)
    x = near_copies([150, 40], 16, [0.3, 0.2], 9)
    links, label = brute(x)
    rows = sorted(embdedup.near_duplicates(frame(spark, x)).collect(), key=lambda r: r["vec_id"])
    assert sum(r["n_links"] for r in rows) >= 0.998 * sum(links) and all(r["n_links"] <= n for r, n in zip(rows, links, strict=True))


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1200, (90, 2))]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    used = {n for a, b in edges if a != b for n in (a, b)}
    got = components.components(spark.createDataFrame([*edges, (7, 7), (None, 3), edges[0]], "a long, b long"))
    assert {(r["node"], r["root"]) for r in got.collect()} == {(n, find(n)) for n in used} and got.count() == len(used)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_keys_are_spread_and_nothing_is_lost(spark):
    rows = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.lit("hot")).otherwise(F.concat(F.lit("k"), "id")).alias("key"))
    side = rows.select("key").distinct().withColumn("value", F.coalesce("key", F.lit("none")))
    got = spread_join(rows, side, "key", F.col("id"))
    assert got.columns == ["id", "key", "value"] and got.count() == 9000
    assert got.where(~F.coalesce("key", F.lit("none")).eqNullSafe(F.col("value"))).count() == 0
