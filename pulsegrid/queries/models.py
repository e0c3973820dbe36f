"""Model jobs. Stand-in: embeddings as features, folds by a patient of four rows each."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.functions.numeric import tidy
from pulsegrid.operators.metrics import METRICS
from pulsegrid.operators.splits import stratified_folds, subset_rows
from pulsegrid.plans import experiment as E
from pulsegrid.plans import models as M
from pulsegrid.plans.report import flatten, load_results
from pulsegrid.queries import query
from pulsegrid.queries.fragments import vectors
from pulsegrid.session import cut_lineage, scratch_path

SMALL = E.Regime(epochs=2, augment_num=1)


def features(spark, d):
    rows = vectors(spark, d).withColumn("label", F.col("label") % 2)
    labels = rows.select(F.col("vec_id").cast("string").alias("record_id"), "label")
    folds = stratified_folds(labels, 1, patient=F.expr("concat('p', cast(cast(record_id AS bigint) div 4 AS string))"))
    parts = subset_rows(folds, "all").select(F.col("record_id").cast("long").alias("vec_id"), "patient", "subset")
    out = rows.join(parts, "vec_id").withColumn("source_db", F.concat(F.lit("db"), (F.col("vec_id") % 4).cast("string")))
    return cut_lineage(out, "features")


def noisy(rows):
    return rows.withColumn("x", A.white_noise(F.col("x"), 1, "copy", F.col("vec_id"), F.col("copy_no")))


def tidied(df, *keys):
    return df.select(*keys, *[tidy(F.col(m), 4).alias(m) for m in METRICS])


def leaves(record, *keep):
    return flatten(record, [F.col(k) for k in keep]).withColumn("value", tidy(F.col("value"), 4))


@query("M1")
def head_metrics(spark, d):
    rows = M.as_vectors(features(spark, d))
    model, _ = M.fit_head(rows.where("subset = 'train'"), rows.where("subset = 'valid'"),
                          M.head_layers("custom", 64, [8]), M.TrainingArgs(2, step=5))
    return tidied(M.patient_report(model, rows.where("subset = 'test'"), order="vec_id"), "level")


@query("M2")
def svm_metrics(spark, d):
    rows = M.as_vectors(features(spark, d))
    probe = M.fit_svm(rows.where("subset = 'train'"), 20, 5)
    return probe.transform(rows.where("subset = 'test'")).select(
        "vec_id", F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))


@query("M2")
def kernel_probe_metrics(spark, d):
    rows = M.as_vectors(features(spark, d))
    probe = M.fit_kernel_probe(rows.where("subset = 'train'"), 20, dims=256, iterations=20)
    return probe.transform(rows.where("subset = 'test'")).select(
        "vec_id", F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))


@query("M3")
def fusion_metrics(spark, d):
    rows = features(spark, d).withColumn("pcg", F.slice("x", 1, 40)).withColumn("ecg", F.slice("x", 41, 24))
    return tidied(E.run_fusion(rows, ["pcg", "ecg"], 64, [8], SMALL, "vec_id"), "level")


@query("M4")
def staged_training(spark, d):
    rows = features(spark, d)
    made = noisy(rows.where("subset = 'train'").withColumn("copy_no", F.lit(9))).drop("copy_no")
    stages = [("real", 2, 0, 1.0), ("synthetic", 1, 0, 0.5), ("real", 1, 1, 1.0)]
    return leaves(E.run_stages(rows, made, stages, [64, 8, 2], "vec_id", noisy), "stages")


@query("M5", "S9")
def fold_experiment(spark, d):
    log = scratch_path(spark, "fold-results")
    E.run_fold(features(spark, d), [64, 8, 2], SMALL, "vec_id", noisy, results=log)
    return leaves(load_results(spark, log), "fold", "train_epochs")


@query("M6")
def holdout_experiment(spark, d):
    return leaves(E.run_holdout(features(spark, d), "db1", [64, 8, 2], SMALL, "vec_id"), "leave_out")


@query("M7")
def multichannel_experiment(spark, d):
    return leaves(E.run_multichannel(features(spark, d), [64, 8, 2], SMALL, "vec_id", 20, noisy), "epochs", "k_best")


@query("M8")
def halved_regime(spark, d):
    regime = E.Regime(epochs=3, augment_num=2, halved=True)
    record = E.run_fold(features(spark, d), [64, 8, 2], regime, "vec_id", noisy)
    return leaves(record, "epochs", "train_epochs", "augment_num")
