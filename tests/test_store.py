"""The feature store: contents, what is extracted when, and what the rows hold."""

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.operators.blocks import cut_arrays
from pulsegrid.operators.spectra import MelSpec
from pulsegrid.operators.windows import WindowSpec
from pulsegrid.plans import store as K

HOW = K.Extraction(1000, 1000, MelSpec(1000, 32, 8, n_mels=5, f_max=400.0), WindowSpec(0.2, 0.05, 0.03), block=128)


def recordings(spark, rows, block=128):
    frame = spark.createDataFrame([(r, c, [float(v) for v in x]) for r, c, x in rows], "record_id string, channel string, x array<double>")
    return cut_arrays(frame, "x", block)


def waves(n, size=600, seed=0):
    rng = np.random.default_rng(seed)
    return [np.sin(np.arange(size) / (3 + i)) + 0.1 * rng.normal(size=size) for i in range(n)]


def test_contents_know_samples_and_not_ids_or_order(spark):
    a, b, c = waves(3)
    blocks = recordings(spark, [("r1", "1", a), ("r1", "E", b), ("r2", "1", a), ("r2", "E", b), ("r3", "1", b), ("r3", "E", a), ("r4", "1", a), ("r5", "1", c)])
    got = {r["record_id"]: r["content"] for r in K.contents(blocks.repartition(9)).collect()}
    assert got["r1"] == got["r2"] and len(set(got.values())) == 4
    assert got == {r["record_id"]: r["content"] for r in K.contents(blocks.coalesce(1)).collect()}


def test_each_content_is_extracted_once_per_setting(spark, tmp_path):
    a, b, c = waves(3)
    store = str(tmp_path)
    first, fresh = K.stored_features(recordings(spark, [("r1", "1", a), ("r2", "1", a), ("r3", "1", b), ("short", "1", a[:20])]), HOW, store)
    assert sorted(r["record_id"] for r in fresh.collect()) == ["r1", "r3", "short"]
    rows = {(r["record_id"], r["win_no"]): r["features"] for r in first.collect()}
    assert {k[0] for k in rows} == {"r1", "r2", "r3"} and all(len(v) == 10 for v in rows.values())
    assert all(rows["r1", w] == rows["r2", w] for r, w in rows if r == "r1")
    again, fresh = K.stored_features(recordings(spark, [("other", "1", b), ("short", "1", a[:20])]), HOW, store)
    assert fresh.isEmpty()
    assert {r["win_no"]: r["features"] for r in again.collect()} == {w: v for (r, w), v in rows.items() if r == "r3"}
    _, fresh = K.stored_features(recordings(spark, [("r9", "1", c), ("r3", "1", b)]), HOW, store)
    assert [r["record_id"] for r in fresh.collect()] == ["r9"]
    louder = K.Extraction(**{**HOW.__dict__, "version": 2})
    _, fresh = K.stored_features(recordings(spark, [("r3", "1", b)]), louder, store)
    assert fresh.count() == 1


def test_what_two_runs_have_stored_at_once_counts_once(spark, tmp_path):
    blocks = recordings(spark, [("r1", "1", waves(1)[0])])
    features, _ = K.stored_features(blocks, HOW, str(tmp_path))
    n, path = features.count(), f"{tmp_path}/{HOW.name(spark)}"
    copies = [tuple(r) for r in spark.read.schema(K.STORED).parquet(path).collect()]
    spark.createDataFrame(copies, K.STORED).write.mode("append").parquet(path)
    assert K.stored_features(blocks, HOW, str(tmp_path))[0].count() == n


def test_pooled_bands_see_no_padding(spark):
    x = waves(1, 200)[0]
    rows = spark.createDataFrame([(1, [float(v) for v in x], 200), (2, [float(v) for v in x] + [0.0] * 400, 200)], "k int, x array<double>, n int")
    got = {r["k"]: r["f"] for r in rows.select("k", K.pooled_log_mel(F.col("x"), F.col("n"), HOW.mel).alias("f")).collect()}
    assert np.allclose(got[1][:5], got[2][:5], atol=0.02) and len(got[1]) == 10


def test_experiment_rows_keep_recordings_that_lack_a_channel(spark, tmp_path):
    a, b, _ = waves(3)
    blocks = recordings(spark, [("r1", "1", a), ("r1", "E", b), ("r2", "E", b), ("r3", "7", a), ("out", "1", a)])
    splits = spark.createDataFrame([(r, f"p{r}", 1, "train") for r in ("r1", "r2", "r3", "gone")], "record_id string, patient string, label int, subset string")
    rows = K.experiment_rows(blocks, splits, HOW, str(tmp_path), ["1", "E"]).collect()
    assert {(r["record_id"], tuple(r["present"])) for r in rows} == {("r1", ("1", "E")), ("r2", ("E",))}
    for r in rows:
        assert len(r["x"]) == 20 and r["row_id"] == f"{r['record_id']}#{r['win_no']}" and (r["record_id"] == "r1" or r["x"][:10] == [0.0] * 10)
