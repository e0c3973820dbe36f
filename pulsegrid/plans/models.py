"""Classifier heads on feature tables, with per-stage selection by validation MCC."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import (LinearSVC, LinearSVCModel, MultilayerPerceptronClassificationModel,
                                       MultilayerPerceptronClassifier)
from pyspark.ml.feature import UnivariateFeatureSelector, UnivariateFeatureSelectorModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions.pieces import piece_rows, pieces_udf
from pulsegrid.operators.metrics import argmax, confusion, grouped_metrics, metrics
from pulsegrid.session import cut_lineage

# Hidden layers of the head per setting.
HEADS = {"cinc": (512, 512, 512), "training-a": (512,), "training-a-ecg": (128,), "vest": (256,)}


@dataclass(frozen=True)
class TrainingArgs:
    epochs: int = 20
    batch_size: int = 64
    seed: int = 0
    step: int = 2  # optimiser iterations per epoch


def head_layers(setting: str, dims: int, hidden: Sequence[int] | None = None) -> list[int]:
    """Layer sizes from features to two classes; ``hidden`` overrides the setting's preset."""
    return [dims, *(HEADS.get(setting, ()) if hidden is None else hidden), 2]


def as_vectors(rows: DataFrame, features: str = "x") -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col(features)))


def score(model, rows: DataFrame) -> DataFrame:
    """``logits`` per row from the model's raw output."""
    return model.transform(rows).withColumn("logits", vector_to_array("rawPrediction"))


def valid_mcc(model, rows: DataFrame) -> float:
    pairs = score(model, rows).select(F.col("label").cast("int").alias("y_true"),
                                      argmax(F.col("logits")).alias("y_pred"))
    return metrics(confusion(pairs)).first()["mcc"]


def fit_head(train: DataFrame, valid: DataFrame, layers: Sequence[int], args: TrainingArgs,
             start: MultilayerPerceptronClassificationModel | None = None):
    """Fit epoch by epoch, each from the last weights; keep the first epoch with the best MCC.

    Every epoch is a distributed fit of a few iterations; only the weights pass through the driver.
    Returns the best model and the per-epoch log.
    """
    train, valid = train.select("features", "label").cache(), valid.select("features", "label").cache()
    try:
        weights, best, log = start.weights if start else None, None, []
        for epoch in range(args.epochs):
            learner = MultilayerPerceptronClassifier(layers=list(layers), maxIter=args.step, seed=args.seed,
                                                     blockSize=args.batch_size)
            if weights is not None:
                learner = learner.setInitialWeights(weights)
            model = learner.fit(train)
            weights = model.weights
            mcc = valid_mcc(model, valid)
            log.append((epoch, mcc))
            if best is None or mcc > best[0]:
                best = (mcc, model)
        return best[1], log
    finally:
        train.unpersist()
        valid.unpersist()


def fit_stages(stages: Sequence[tuple[DataFrame, int]], valid: DataFrame, layers: Sequence[int],
               args: TrainingArgs):
    """Stages in order on the same weights; selection starts afresh in every stage."""
    model, logs = None, []
    for number, (train, epochs) in enumerate(stages):
        model, log = fit_head(train, valid, layers, TrainingArgs(epochs, args.batch_size, args.seed, args.step),
                              model)
        logs += [(number, e, m) for e, m in log]
    return model, logs


def fit_svm(train: DataFrame, k_best: int = 80, iterations: int = 20):
    """Linear support-vector probe on the k features with the best F score."""
    select = UnivariateFeatureSelector(featuresCol="features", outputCol="selected", labelCol="label",
                                       selectionMode="numTopFeatures")
    select.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k_best)
    svm = LinearSVC(featuresCol="selected", labelCol="label", maxIter=iterations)
    return Pipeline(stages=[select, svm]).fit(train)


@dataclass(frozen=True)
class KernelProbe:
    """A support-vector machine with a Gaussian kernel: selected features, their random Fourier features, a linear machine on these."""

    selector: UnivariateFeatureSelectorModel
    frequencies: np.ndarray  # [selected features, random features]
    phases: np.ndarray
    machine: LinearSVCModel | None = None

    def mapped(self, rows: DataFrame, features: str = "features") -> DataFrame:
        """``rows`` plus ``kernel_features``; their inner products approach the kernel as the random features grow in number."""
        w, b = self.frequencies, self.phases

        @pieces_udf("array<double>", piece_rows(len(b)))
        def project(xs: pd.Series) -> pd.Series:
            if not len(xs):
                return pd.Series([], dtype=object)
            made = np.stack(xs.to_numpy()) @ w  # in place from here on: the piece is laid out once
            made += b
            np.cos(made, out=made)
            made *= np.sqrt(2.0 / len(b))
            return pd.Series(list(made))

        chosen = self.selector.setFeaturesCol(features).transform(rows)
        # Marked so that the optimizer doesn't try to work the call out itself on rows that it has at hand.
        return chosen.withColumn("kernel_features", array_to_vector(project.asNondeterministic()(vector_to_array("selected"))))

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.machine.transform(self.mapped(rows))


def fit_kernel_probe(train: DataFrame, k_best: int = 80, dims: int = 1024, cost: float = 1.0, iterations: int = 100, seed: int = 0,
                     gamma: float | None = None) -> KernelProbe:
    """Gaussian-kernel support-vector probe on the ``k_best`` features with the best F score (all of them, if there are fewer).

    ``gamma`` defaults to one over the number of features times the variance of all their values, as such probes are usually set.
    ``dims`` random Fourier features stand for the kernel (error about one over the root of ``dims``), so a fit is one linear fit whatever the
    number of rows: no kernel matrix is formed. Frequencies and phases follow from ``seed`` alone. ``cost`` weighs each row's hinge loss.
    """
    select = UnivariateFeatureSelector(featuresCol="features", outputCol="selected", labelCol="label", selectionMode="numTopFeatures")
    size = len(train.select(vector_to_array("features").alias("f")).first()["f"])
    select.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(min(k_best, size))
    selector = select.fit(train)
    used = len(selector.selectedFeatures)
    values = selector.transform(train).select(F.explode(vector_to_array("selected")).alias("v"))
    n, spread = train.count(), values.agg(F.var_pop("v")).first()[0]
    if gamma is None:
        gamma = 1.0 / (used * spread) if spread else 1.0
    rng = np.random.default_rng(seed)
    probe = KernelProbe(selector, rng.normal(0.0, np.sqrt(2.0 * gamma), (used, dims)), rng.uniform(0.0, 2.0 * np.pi, dims))
    learner = LinearSVC(featuresCol="kernel_features", labelCol="label", maxIter=iterations, regParam=1.0 / (cost * n), standardization=False)
    return replace(probe, machine=learner.fit(cut_lineage(probe.mapped(train).select("kernel_features", "label"), "kernel-features")))


def fuse(rows: DataFrame, parts: Sequence[str], out: str = "features") -> DataFrame:
    """Concatenate per-channel feature vectors."""
    return VectorAssembler(inputCols=list(parts), outputCol=out).transform(rows)


def patient_report(model, rows: DataFrame, keys: Sequence[str] = (), order: str = "fragment_id"
                   ) -> DataFrame:
    """Metrics at fragment and patient level of a scored table."""
    scored = score(model, rows).select(*keys, "patient", F.col(order).alias("fragment_id"),
                                       F.col("label").cast("int").alias("y_true"), "logits")
    return grouped_metrics(scored, list(keys))
