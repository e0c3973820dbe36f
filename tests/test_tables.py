import json

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.functions.keyed import digest, gaussian, unit
from pulsegrid.functions.numeric import half_even
from pulsegrid.operators import balance as B
from pulsegrid.operators import metrics as M
from pulsegrid.operators import quality as Q
from pulsegrid.operators import splits as S
from pulsegrid.operators import windows as W
from pulsegrid.operators.lookup import diffuse_at
from pulsegrid.operators.ranking import carry_ends, hash_bucket, rank_median, split_cumsum, split_rank
from pulsegrid.plans import report as R
from pulsegrid.plans.augment import augment_batch, augment_multi, augment_pcg
from pulsegrid.plans.experiment import Regime
from pulsegrid.sources import tables as T


def test_half_even(spark):
    got = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (2.4,)], "x DOUBLE").select(
        half_even(F.col("x")).alias("r")).collect()
    assert [r.r for r in got] == [0, 2, 2, 0, 2]


def test_keyed_draws_look_uniform_and_normal(spark):
    got = spark.range(20000).select(unit(1, F.col("id")).alias("u"), gaussian(1, F.col("id")).alias("g")).toPandas()
    assert abs(got.u.mean() - 0.5) < 0.01 and 0 <= got.u.min() and got.u.max() < 1
    assert abs(got.g.mean()) < 0.03 and abs(got.g.std() - 1) < 0.03


def test_split_rank_with_a_hot_key(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"), "id",
        digest("x", F.col("id")).alias("h"))
    got = split_rank(rows, ["k"], ["h", "id"], hash_bucket(F.col("h")), "r", "n")
    want = rows.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("h", "id")).cast("long")).withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy("k")))
    key = lambda df: sorted((r.k, r.id, r.r, r.n) for r in df.collect())
    assert key(got) == key(want)


def test_running_sums_medians_and_carries(spark):
    rows = spark.range(200).select((F.col("id") % 2).alias("k"), F.expr("id div 2").alias("pos"),
                                   (F.col("id") * 7 % 31).alias("v"))
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    want = {(r.k, r.pos): r.b for r in rows.withColumn("b", F.coalesce(F.sum("v").over(w), F.lit(0))).collect()}
    got = {(r.k, r.pos): r.before for r in split_cumsum(rows, ["k"], "pos", "v", 7).collect()}
    assert got == want
    vals = {"odd": [3.0, 1.0, 2.0], "even": [4.0, 1.0, 3.0, 2.0], "zero": [0.0, 0.0, 5.0, 0.0], "neg": [-1.0, -5.0, 2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in vals.items() for v in vs], "k STRING, v DOUBLE")
    got = {r.k: r.median for r in rank_median(df, ["k"], "v").collect()}
    assert got == {k: float(np.median(v)) for k, v in vals.items()}
    ends = spark.createDataFrame([("a", b, b * 1.0 if b in (1, 5, 8) else None) for b in range(10)],
                                 "k STRING, block BIGINT, v DOUBLE")
    out = {r.block: (r.prev, r.next) for r in carry_ends(ends, ["k"], "block", "v", "v", fan=3).collect()}
    assert out[0] == (None, 1.0) and out[1] == (None, 5.0) and out[4] == (1.0, 5.0) and out[9] == (8.0, None)


def test_folds(spark):
    labels = spark.createDataFrame([(f"a{i:04d}", 1 if i % 2 else -1) for i in range(100)], "record_id STRING, label INT")
    folds = S.stratified_folds(labels, 5).cache()
    sizes = {(r.fold, r.subset): r["count"] for r in folds.groupBy("fold", "subset").count().collect()}
    assert all(sizes[f, "train"] == 60 and sizes[f, "valid"] == 20 and sizes[f, "test"] == 20 for f in range(1, 6))
    assert folds.groupBy("fold", "subset").agg(F.countDistinct("label").alias("c")).where("c < 2").count() == 0
    again = S.stratified_folds(labels.repartition(7), 5)
    assert folds.exceptAll(again).count() == 0
    assert S.leakage(folds).count() == 0
    with pytest.raises(ValueError):
        S.Ratios(0.5, 0.2, 0.2)


def test_patients_stay_together_and_single_classes_work(spark):
    labels = spark.createDataFrame([(f"r{i}", 1) for i in range(30)], "record_id STRING, label INT")
    folds = S.stratified_folds(labels, 2, patient=F.expr("concat('p', substring(record_id, 2, 1))"))
    assert S.leakage(folds).count() == 0
    assert {r.subset for r in folds.select("subset").distinct().collect()} == {"train", "valid", "test"}


def test_label_list(spark, tmp_path):
    (tmp_path / "REFERENCE.csv").write_text("a0001,1\n a0002 ,-1\na0003,1\nbad\n")
    got = {r.record_id: r.label for r in T.read_labels(spark, str(tmp_path / "REFERENCE.csv")).collect()}
    assert got == {"a0001": 1, "a0002": -1, "a0003": 1}
    (tmp_path / "empty.csv").write_text("x\n")
    with pytest.raises(ValueError):
        T.read_labels(spark, str(tmp_path / "empty.csv"))


def test_split_file_with_comments(spark, tmp_path):
    (tmp_path / "s.csv").write_text("# made by hand\npatient,abnormality,split,split2\na,1,train,test\nb,-1,test,train\n")
    path = str(tmp_path / "s.csv")
    assert [r.patient for r in T.read_split(spark, path, "train", 2).collect()] == ["b"]
    assert T.read_split(spark, path, "all").count() == 2
    got = {r.patient: r.label for r in T.with_binary_label(T.read_split(spark, path)).collect()}
    assert got == {"a": 1, "b": 0}
    with pytest.raises(KeyError):
        S.label_column(spark.createDataFrame([(1,)], "x INT"))


def test_metrics(spark):
    df = spark.createDataFrame(list(zip([0, 1, 1, 0, 1], [0, 1, 0, 0, 1])), "y_true INT, y_pred INT")
    m = M.metrics(M.confusion(df)).first()
    assert m.accuracy == pytest.approx(0.8) and -1 <= m.mcc <= 1 and 0 <= m.f1 <= 1
    odd = spark.createDataFrame([(2, 2), (None, 1), (1, 3)], "y_true INT, y_pred INT")
    c = M.confusion(odd).first()
    assert (c.tp, c.tn, c.fp, c.fn) == (0, 0, 0, 3)
    none = M.metrics(M.confusion(df.limit(0))).first()
    assert none.mcc == 0 and none.f1 == 0 and none.accuracy == 0


def test_votes_and_selection(spark):
    rows = [("a", 1, 0, [2.0, 1.0]), ("a", 2, 1, [0.0, 3.0]), ("b", 1, 1, [1.0, 1.0]), ("c", 1, 2, [0.0, 1.0, 1.5])]
    df = spark.createDataFrame(rows, "patient STRING, fragment_id INT, y_true INT, logits ARRAY<DOUBLE>")
    got = {r.patient: (r.y_true, r.y_pred) for r in M.patient_votes(df, ["patient"], 2).collect()}
    assert got == {"a": (1, 1), "b": (1, 0), "c": (2, 1)}
    log = spark.createDataFrame([("r", 0, 0, .5), ("r", 0, 1, .7), ("r", 0, 2, .7), ("r", 1, 0, .1)],
                                "run STRING, stage INT, epoch INT, mcc DOUBLE")
    assert {(r.stage, r.epoch) for r in M.best_rows(log, ["run", "stage"]).collect()} == {(0, 1), (1, 0)}


def test_results_and_report(spark, tmp_path):
    recs = [{"run_label": "a", "fragment": {"mcc": 0.5}, "patient": {"mcc": 0.8, "accuracy": 0.9}},
            {"run_label": "a", "fragment": {"mcc": 0.7}, "patient": {"mcc": 0.88, "accuracy": 0.9}},
            {"run_label": "b", "mlp": {"patient": {"uar": 0.25}}, "svm": {"mcc": 0.1}, "note": {"mcc": "text"}}]
    (tmp_path / "r.json").write_text(json.dumps(recs))
    rows = R.load_results(spark, str(tmp_path / "r.json"), multiline=True)
    assert set(R.metric_paths(rows.schema)) == {"fragment.mcc", "patient.mcc", "patient.accuracy",
                                                "mlp.patient.uar", "svm.mcc"}
    s = {(r.condition, r.path): r for r in R.summarize(rows).collect()}
    cell = s["run_label=a", "patient.mcc"]
    assert cell["mean"] == pytest.approx(0.84) and cell["n"] == 2 and cell["std"] > 0
    lines = [r.line for r in R.markdown(R.summarize(rows), R.metric_paths(rows.schema), ["mcc"]).orderBy("line_no").collect()]
    assert lines[0] == "| condition | n | fragment.mcc | patient.mcc | svm.mcc |"
    assert lines[2] == "| run_label=a | 2 | 0.6000±0.1000 | 0.8400±0.0400 | - |"
    assert lines[3].endswith("| - | - | 0.1000±0.0000 |")
    assert R.summarize(rows, ["absent"]).select("condition").distinct().first().condition == "all"
    path = R.append_results(rows.where("run_label = 'a'").select("run_label", "patient"), str(tmp_path / "log"))
    R.append_results(rows.where("run_label = 'a'").select("run_label", "patient"), path)
    assert R.load_results(spark, path).count() == 4


def test_balanced_copies_and_chunks(spark):
    rows = spark.createDataFrame([(i, 0 if i < 4 else 1) for i in range(6)], "id INT, label INT")
    got = B.with_copies(rows, 3, "id").groupBy("label", "copy_no").count().collect()
    assert {(r.label, r.copy_no): r["count"] for r in got} == {
        **{(0, c): 4 for c in range(4)}, **{(1, c): 2 for c in range(7)}}
    small = B.with_copies(rows, 50, "id", chunk=7)
    assert small.count() == 4 * 51 + 2 * 101
    assert small.select("id", "copy_no").distinct().count() == small.count()
    assert B.with_copies(rows, 3, "id", balance=False).count() == 24


def test_resampling_is_class_even(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    got = B.balanced_resample(rows, "id")
    share = got.agg(F.avg("label").alias("s"), F.count(F.lit(1)).alias("n")).first()
    assert share.n == 3000 and abs(share.s - 0.5) < 0.04


def test_proportions(spark):
    rows = spark.range(101).select("id", F.lit("a").alias("k"))
    for frac, n in ((0.0, 0), (0.3, 30), (0.5, 50), (1.0, 101)):
        assert T.proportion_sample(rows, ["k"], "id", frac).count() == n


def test_vocabularies(spark):
    assert len(B.vocabulary("ticking-heart-extended")) == 60 and len(B.vocabulary("training-a-extended")) == 5
    with pytest.raises(NotImplementedError):
        B.vocabulary("nope")
    rows = spark.createDataFrame([("training-a", "1"), ("training-a", "7")], "vocab STRING, label STRING")
    assert {r.label: (r.idx, r.known) for r in B.encode_labels(rows).collect()} == {"1": (1, True), "7": (None, False)}


def test_contrastive_prefers_separated_classes(spark):
    apart = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0], i % 2, 0) for i in range(4)]
    mixed = [(i, [1.0, 0.0] if i < 2 else [0.0, 1.0], i % 2, 0) for i in range(4)]
    score = lambda rows: Q.contrastive(spark.createDataFrame(rows, "id INT, x ARRAY<DOUBLE>, label INT, batch INT"),
                                       "id", "x").agg(F.avg("mean_log_prob")).first()[0]
    assert score(apart) > score(mixed)
    lone = [(0, [1.0, 0.0], 0, 0), (1, [0.0, 1.0], 1, 0)]
    assert score(lone) is None


def test_regime():
    assert Regime(epochs=20, augment_num=15, halved=True).train_epochs == 10
    assert Regime(epochs=1, halved=True).train_epochs == 1
    assert Regime(augment_num=15, halved=True).valid_copies == 7
    assert Regime(augment_num=15).valid_copies == 0 and Regime(augment=False).train_copies == 0


def test_augmented_arrays_are_bounded_and_repeatable(spark):
    rows = spark.range(40).select("id", F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.sin(
        i * 0.1 + F.col("id")) + F.when(i == 7, 0.5).otherwise(0.0)).alias("x"))
    key = [F.col("id")]
    for make in (lambda d: augment_pcg(d, "x", 4125.0, 3, key), lambda d: augment_batch(d, "x", 4125.0, 3, key)):
        a = {r.id: r.x for r in make(rows).collect()}
        b = {r.id: r.x for r in make(rows.repartition(5)).collect()}
        assert a == b
        for x in a.values():
            assert np.isfinite(x).all() and np.abs(x).max() <= 1 + 1e-9
    multi = augment_multi(rows.withColumn("x", F.array("x", F.reverse("x"))), "x", 4125.0, 3, key)
    for r in multi.collect():
        assert len(r.x) == 2 and len(r.x[0]) == len(r.x[1]) <= 200


def test_array_helpers(spark):
    df = spark.createDataFrame([([3.0, 3.0],), ([1.0, 5.0, 2.0],), ([],)], "x ARRAY<DOUBLE>")
    got = [r.y for r in df.select(A.abs_max(F.col("x")).alias("y")).collect()]
    assert got[0] == [0.0, 0.0] and got[2] == [] and max(np.abs(got[1])) == 1.0
    got = df.select(W.fit_length(F.col("x"), 2).alias("y"), W.valid_length(F.col("x"), 2).alias("n")).collect()
    assert [(r.y, r.n) for r in got] == [([3.0, 3.0], 2), ([1.0, 5.0], 2), ([0.0, 0.0], 0)]


def test_every_original_stays_among_copies(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "elsewhere"), (4, "a"), (5, "b")], "id INT, label STRING")
    listed = rows.where("label in ('a', 'b')")
    got = B.with_copies(rows, 2, "id", counts_from=listed)
    assert sorted(r.id for r in got.where("copy_no = 0").collect()) == [1, 2, 3, 4, 5]
    assert {r.id: r.n for r in got.where("copy_no > 0").groupBy("id").agg(F.count("*").alias("n")).collect()} == {1: 2, 4: 2, 5: 4}
    assert sorted(r.id for r in B.uncounted(rows, listed).collect()) == [2, 3]


def test_gaps_are_filled_before_the_peak(spark):
    nan = float("nan")
    cases = [[nan, 1.0, nan, nan, 4.0, nan], [1.0, nan, 3.0], [nan, nan], [2.0, 2.0], [None, 1.0, 2.0], []]
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i INT, x ARRAY<DOUBLE>")
    got = [r[0] for r in frame.orderBy("i").select(A.abs_max(F.col("x"))).collect()]

    def plain(c):
        x = np.array([nan if v is None else v for v in c], float)
        bad = np.isnan(x)
        if len(x) and not bad.all():
            x[bad] = np.interp(np.flatnonzero(bad), np.flatnonzero(~bad), x[~bad])
            x = x - x.mean()
            x = x / np.abs(x).max() if np.abs(x).max() > 0 else x
        return x

    for g, c in zip(got, cases, strict=True):
        np.testing.assert_allclose(np.array(g, float), plain(c), atol=1e-12)


def test_last_listed_label_goes_by_file_and_row(spark, tmp_path):
    (tmp_path / "a.csv").write_text("r1,1\nr2,1\nr2,-1\n")
    (tmp_path / "b.csv").write_text("r1,-1\n" + "".join(f"x{i},1\n" for i in range(400)))
    got = {r.record_id: r.label for r in T.union_labels([T.read_labels(spark, str(tmp_path))]).collect()}
    assert got["r1"] == -1 and got["r2"] == -1


def test_f_scores_keep_their_digits(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 2)) + np.repeat([[0.0, 0.0], [0.3, 0.0], [0.9, 0.1]], 30, axis=0)
    y = np.repeat([0, 1, 2], 30)

    def scores(offset):
        rows = [(int(k), [float(v) + offset for v in r]) for k, r in zip(y, x, strict=True)]
        return [r.f for r in Q.f_scores(spark.createDataFrame(rows, "label INT, x ARRAY<DOUBLE>"), "x").orderBy("feature").collect()]

    means = np.array([x[y == k].mean(axis=0) for k in range(3)])
    within = sum(((x[y == k] - means[k]) ** 2).sum(axis=0) for k in range(3)) / 87
    want = 30 * ((means - x.mean(axis=0)) ** 2).sum(axis=0) / 2 / within
    np.testing.assert_allclose(scores(0.0), want, rtol=1e-9)
    np.testing.assert_allclose(scores(1e7), want, rtol=1e-5)


def test_noise_mixing_of_null_and_empty_signals_and_extreme_levels(spark):
    rows = spark.createDataFrame([(1, None, 0.5), (2, [], 0.5), (3, [1.0, 2.0], 1.0), (4, [1.0, 2.0], 0.0)], "id long, x array<double>, l double")
    got = {r["id"]: r["x"] for r in diffuse_at(rows, "l", "x", 1, "e", [F.col("id")]).collect()}
    assert got[1] is None and got[2] == [] and got[3] == [1.0, 2.0]
    assert len(got[4]) == 2 and got[4] != [1.0, 2.0]
