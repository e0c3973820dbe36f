"""Fitted models: separable sets, epoch selection, the kernel probe against an exact solver, and runs along a schedule."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.plans import experiment as E
from pulsegrid.plans import models as M
from pulsegrid.plans import staged as P
from pulsegrid.sources import schedule as S


def rows(spark, n=120, seed=0, far=3.0, **more):
    """Two clouds in four dimensions; every fifth row is for the test, every fifth for selection."""
    rng = np.random.default_rng(seed)
    data = []
    for i in range(n):
        label = i % 2
        x = rng.normal(size=4) + (far if label else -far)
        data.append((i, f"p{i // 2 % 30}_{label}", label, {0: "test", 1: "valid"}.get(i // 2 % 5, "train"), "ab"[i % 2], [float(v) for v in x]))
    return spark.createDataFrame(data, "row_id long, patient string, label int, subset string, source_db string, x array<double>")


def noisy(df):
    return df.withColumn("x", F.transform("x", lambda v, i: v + F.col("copy_no") * 0.001))


def test_head_learns_what_can_be_separated_and_keeps_its_first_best_epoch(spark):
    data = M.as_vectors(rows(spark))
    train, valid = data.where("subset = 'train'"), data.where("subset = 'valid'")
    model, log = M.fit_head(train, valid, [4, 4, 2], M.TrainingArgs(4, step=15))
    assert [e for e, _ in log] == [0, 1, 2, 3] and max(m for _, m in log) == 1.0
    first = next(e for e, m in log if m == 1.0)
    again, _ = M.fit_head(train, valid, [4, 4, 2], M.TrainingArgs(first + 1, step=15))
    assert np.array_equal(model.weights.toArray(), again.weights.toArray())
    report = {r["level"]: r for r in M.patient_report(model, data.where("subset = 'test'"), order="row_id").collect()}
    assert report["fragment"]["mcc"] == 1.0 and report["patient"]["accuracy"] == 1.0


def test_stages_go_on_from_the_weights_before(spark):
    data = M.as_vectors(rows(spark))
    train, valid = data.where("subset = 'train'"), data.where("subset = 'valid'")
    one, _ = M.fit_head(train, valid, [4, 3, 2], M.TrainingArgs(1, step=5))
    two, _ = M.fit_head(train, valid, [4, 3, 2], M.TrainingArgs(1, step=5), one)
    both, log = M.fit_stages([(train, 1), (train, 1)], valid, [4, 3, 2], M.TrainingArgs(step=5))
    assert np.allclose(both.weights.toArray(), two.weights.toArray()) and [r[:2] for r in log] == [(0, 0), (1, 0)]


def test_experiments_on_a_separable_set(spark, tmp_path):
    data, regime = rows(spark), E.Regime(epochs=2, augment_num=2)
    fold = E.run_fold(data, [4, 4, 2], regime, "row_id", noisy, step=15, results=str(tmp_path / "log")).first()
    assert fold["fragment"]["mcc"] == 1.0 and fold["train_epochs"] == 2 and fold["augment_num"] == 2
    assert spark.read.json(str(tmp_path / "log")).count() == 1
    half = E.run_fold(data, [4, 4, 2], E.Regime(epochs=4, augment_num=2, halved=True), "row_id", noisy, step=15).first()
    assert half["train_epochs"] == 2 and half["halved"] and half["patient"]["mcc"] == 1.0
    multi = E.run_multichannel(data, [4, 4, 2], regime, "row_id", 3, noisy, step=15).first()
    assert multi["mlp"]["fragment"]["mcc"] == 1.0 and multi["svm"]["accuracy"] == 1.0
    fused = data.select("*", F.slice("x", 1, 2).alias("a"), F.slice("x", 3, 2).alias("b"))
    levels = {r["level"]: r["mcc"] for r in E.run_fusion(fused, ["a", "b"], 4, [4], regime, "row_id", step=15).collect()}
    assert levels == {"fragment": 1.0, "patient": 1.0}


def test_holdout_tests_the_source_left_out(spark):
    data = rows(spark).withColumn("source_db", F.concat(F.lit("db"), (F.col("row_id") % 3).cast("string")))
    out = E.run_holdout(data, "db1", [4, 4, 2], E.Regime(epochs=1, augment=False), "row_id", step=30).first()
    assert out["leave_out"] == "db1" and out["fragment"]["accuracy"] == 1.0


def exact_machine(x, y, gamma, cost, rounds=3000):
    """Dual ascent on pairs (the multipliers' sum stays balanced): decision values of a Gaussian-kernel machine."""
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    a, g = np.zeros(len(x)), -np.ones(len(x))
    for _ in range(rounds):
        up, down = ((y > 0) & (a < cost)) | ((y < 0) & (a > 0)), ((y > 0) & (a > 0)) | ((y < 0) & (a < cost))
        v = -y * g
        i, j = np.where(up, v, -np.inf).argmax(), np.where(down, v, np.inf).argmin()
        if v[i] - v[j] < 1e-6:
            break
        step = (v[i] - v[j]) / max(1e-12, k[i, i] + k[j, j] - 2 * k[i, j])
        step = min(step, cost - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else cost - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
        g += y * (k[:, i] - k[:, j]) * step
    bias = (v[i] + v[j]) / 2
    return lambda z: np.exp(-gamma * ((z[:, None] - x[None]) ** 2).sum(-1)) @ (a * y) + bias


def test_kernel_probe_separates_a_ring_and_agrees_with_an_exact_solver(spark):
    rng = np.random.default_rng(7)
    angle, label = rng.uniform(0, 2 * np.pi, 600), np.arange(600) % 2
    radius = np.where(label, 2.0, 0.6) + 0.25 * rng.normal(size=600)
    x = np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1)
    data = M.as_vectors(spark.createDataFrame([(i, int(label[i]), x[i].tolist()) for i in range(600)], "row_id long, label int, x array<double>"))
    train, test = data.where("row_id < 400"), data.where("row_id >= 400")
    probe = M.fit_kernel_probe(train.select("features", "label"), k_best=80)
    got = np.array([r["prediction"] for r in probe.transform(test).orderBy("row_id").collect()])
    exact = exact_machine(x[:400], np.where(label[:400], 1.0, -1.0), 1 / (2 * x[:400].var()), 1.0)(x[400:]) > 0
    assert (got == exact).mean() >= 0.97 and (got == label[400:]).mean() >= 0.95
    line = M.fit_svm(train, 2).transform(test).where("prediction = label").count() / 200
    assert line < 0.75


def test_kernel_features_approach_the_kernel(spark):
    data = M.as_vectors(rows(spark, 40, far=0.2))
    probe = M.fit_kernel_probe(data, dims=4096, gamma=0.1, iterations=1)
    got = probe.mapped(data).orderBy("row_id").collect()
    z, x = np.stack([r["kernel_features"].toArray() for r in got]), np.stack([r["selected"].toArray() for r in got])
    assert np.abs(z @ z.T - np.exp(-0.1 * ((x[:, None] - x[None]) ** 2).sum(-1))).max() < 0.08


SCHEDULE = {"test_set": {"data": "/a", "split": "s", "segment": "g"}, "valid_set": {"data": "/a", "split": "s", "segment": "g"},
            "datasets": {"real": {"path": "/a", "split": "s", "segment": "g", "gen_data": False, "augment_num": 1, "proportion": 0.1},
                         "made": {"path": "/b", "split": "s", "segment": "g", "gen_data": True, "augment_num": 0, "proportion": 0.3}},
            "combined_datasets": {"both": {"base_sets": ["real", "made"], "proportion": [0.5, 1.0]}},
            "schedule": [{"key": "made", "epochs": 1}, {"key": "real", "epochs": 2}, {"key": "both", "epochs": 1}]}


@pytest.fixture
def schedule(spark, tmp_path):
    def write(name="one", **changes):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(SCHEDULE | changes))
        return S.read_schedule(spark, str(path))

    return write


def set_rows(spark):
    real = rows(spark).withColumn("path", F.lit("/a"))
    made = rows(spark, 50, 1).withColumns({"path": F.lit("/b"), "subset": F.lit(None).cast("string"), "row_id": F.col("row_id") + 1000})
    other = rows(spark, 10, 2).withColumns({"path": F.lit("/c"), "row_id": F.col("row_id") + 2000})
    odd = rows(spark, 2, 3).withColumns({"path": F.lit("/b"), "subset": F.lit(None).cast("string"), "row_id": F.lit(None).cast("long")})
    return real.unionByName(made).unionByName(other).unionByName(odd)


def test_rows_learn_their_stages(spark, schedule):
    data = set_rows(spark)
    got = P.tagged(data, P.stage_plan(schedule()), "row_id")
    assert got.columns == [*data.columns, "stages"] and got.count() == data.count()
    by = {}
    for r in got.collect():
        for s in r["stages"]:
            by.setdefault((s["stage"], s["base_set"]), set()).add(r["row_id"])
            assert r["path"] == {"real": "/a", "made": "/b"}[s["base_set"]] and r["subset"] in ("train", None) and r["row_id"] is not None
    train = {r["row_id"] for r in data.where("path = '/a' AND subset = 'train'").collect()}
    assert by[1, "real"] == train and len(by[2, "real"]) == len(train) // 2 and len(by[0, "made"]) == 15 and len(by[2, "made"]) == 50
    assert by[0, "made"] < by[2, "made"] and by[2, "real"] < by[1, "real"]
    again = P.tagged(data.repartition(7), P.stage_plan(schedule("two")), "row_id")
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))


def test_sampling_goes_by_recording(spark, schedule):
    data = set_rows(spark).where("path = '/b' AND row_id IS NOT NULL").withColumn("record", F.expr("concat('r', row_id div 5)"))
    got = P.stage_rows(P.tagged(data, P.stage_plan(schedule()), "record"), 0)
    per = got.groupBy("record").count().collect()
    assert len(per) == 3 and all(r["count"] == 5 for r in per)


def test_a_broken_run_goes_on_where_it_ended(spark, schedule, tmp_path):
    args = dict(record="row_id", row_id="row_id", layers=[4, 3, 2], augment=noisy, args=M.TrainingArgs(step=5))
    data = set_rows(spark).where("row_id IS NOT NULL")
    whole = P.run_schedule(schedule(), data, log=str(tmp_path / "a"), **args).first()
    assert P.run_schedule(schedule(), data, log=str(tmp_path / "b"), until=1, **args) is None
    resumed = P.run_schedule(schedule(), data, log=str(tmp_path / "b"), results=str(tmp_path / "r"), **args).first()
    assert resumed == whole and whole["stages"] == 3
    log = {r["stage"]: r for r in P.read_log(spark, str(tmp_path / "b")).collect()}
    assert len(log) == 3 and log[0]["attempt"] != log[1]["attempt"] == log[2]["attempt"] and log[1]["epochs"] == 2
    done = P.run_schedule(schedule(), data, log=str(tmp_path / "b"), **args).first()
    assert done == whole and P.read_log(spark, str(tmp_path / "b")).count() == 3
    other = schedule("other", schedule=[{"key": "real", "epochs": 1}])
    assert P.run_schedule(other, data, log=str(tmp_path / "b"), **args).first()["run"] != whole["run"]


def test_invalid_schedules_are_refused(spark, schedule, tmp_path):
    with pytest.raises(ValueError, match="unknown dataset"):
        P.run_schedule(schedule("bad", schedule=[{"key": "nothing", "epochs": 1}]), set_rows(spark), "row_id", "row_id", [4, 2], str(tmp_path))
    two = schedule("x").unionByName(schedule("y"))
    with pytest.raises(ValueError, match="one schedule"):
        P.run_schedule(two, set_rows(spark), "row_id", "row_id", [4, 2], str(tmp_path))
    with pytest.raises(ValueError, match="no stages"):
        P.run_schedule(schedule("none", schedule=[]), set_rows(spark), "row_id", "row_id", [4, 2], str(tmp_path))
