"""Fold, hold-out, staged and multichannel experiments over feature tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from pulsegrid.operators.balance import balanced_resample, with_copies
from pulsegrid.operators.metrics import METRICS, confusion, metrics
from pulsegrid.operators.splits import leave_one_source_out
from pulsegrid.plans import models as M
from pulsegrid.plans.report import append_results
from pulsegrid.sources.tables import proportion_sample


@dataclass(frozen=True)
class Regime:
    """Run parameters. The halved regime trains half the epochs and augments
    the validation set with half the copies."""

    epochs: int = 20
    augment_num: int = 15
    augment: bool = True
    halved: bool = False

    @property
    def train_epochs(self) -> int:
        return max(1, self.epochs // 2) if self.halved else self.epochs

    @property
    def train_copies(self) -> int:
        return self.augment_num if self.augment else 0

    @property
    def valid_copies(self) -> int:
        return self.train_copies // 2 if self.halved else 0


def copies(rows: DataFrame, n: int, row_id: str, augment) -> DataFrame:
    """Rows with ``n`` class-balanced copies each, passed through ``augment`` (DataFrame -> DataFrame)."""
    originals = rows.withColumn("copy_no", F.lit(0))
    if n == 0 or augment is None:
        return originals
    return originals.unionByName(augment(with_copies(rows, n, row_id).where("copy_no > 0")))


def drawn(rows: DataFrame, row_id: str, seed: int = 0) -> DataFrame:
    """As many rows as there are, drawn with replacement so that every class is equally likely, as training sets are read."""
    keyed = rows.withColumn("__row", F.concat_ws("#", F.col(row_id).cast("string"), F.col("copy_no").cast("string")))
    return balanced_resample(keyed.select("__row", "label"), "__row", seed=seed).select("__row").join(keyed, "__row").drop("__row")


def _nest(report: DataFrame) -> DataFrame:
    """Fragment and patient metric rows as one record of nested structs."""
    cell = F.struct(*METRICS)
    return report.agg(*[F.max(F.when(F.col("level") == lvl, cell)).alias(lvl)
                        for lvl in ("fragment", "patient")])


def _log(report: DataFrame, config: dict, results: str | None) -> DataFrame:
    record = _nest(report).select(*[F.lit(v).alias(k) for k, v in config.items()], "*")
    if results:
        append_results(record, results)
    return record


def run_fold(rows: DataFrame, layers: Sequence[int], regime: Regime, row_id: str, augment=None,
             fold: int = 1, step: int = 2, results: str | None = None) -> DataFrame:
    """``rows(subset, label, patient, x)`` of one fold: fit on train, select on valid, report test."""
    part = lambda s: rows.where(F.col("subset") == s)
    train = M.as_vectors(drawn(copies(part("train"), regime.train_copies, row_id, augment), row_id))
    valid = M.as_vectors(copies(part("valid"), regime.valid_copies, row_id, augment))
    model, _ = M.fit_head(train, valid, layers, M.TrainingArgs(regime.train_epochs, step=step))
    report = M.patient_report(model, M.as_vectors(part("test")), order=row_id)
    return _log(report, {"fold": fold, "epochs": regime.epochs, "train_epochs": regime.train_epochs,
                         "augment": regime.augment, "augment_num": regime.train_copies,
                         "halved": regime.halved}, results)


def run_holdout(rows: DataFrame, holdout: str, layers: Sequence[int], regime: Regime, row_id: str,
                augment=None, step: int = 2, results: str | None = None) -> DataFrame:
    """Train on all sources but one, test on all rows of the held-out one."""
    parts = leave_one_source_out(rows, [holdout]).drop("subset").withColumnRenamed("part", "subset")
    record = run_fold(parts, layers, regime, row_id, augment, step=step)
    out = record.withColumn("leave_out", F.lit(holdout))
    if results:
        append_results(out, results)
    return out


def run_stages(real: DataFrame, synthetic: DataFrame, stages: Sequence[tuple[str, int, int, float]],
               layers: Sequence[int], row_id: str, augment=None, step: int = 2,
               results: str | None = None) -> DataFrame:
    """Staged training: ``(real|synthetic, epochs, copies, proportion)`` per stage, in order."""
    sets = []
    for kind, epochs, n, share in stages:
        rows = real.where("subset = 'train'") if kind == "real" else synthetic
        if kind != "real" and share < 1.0:
            rows = proportion_sample(rows, [], row_id, share)
        sets.append((M.as_vectors(drawn(copies(rows, n, row_id, augment), row_id, len(sets))), epochs))
    model, _ = M.fit_stages(sets, M.as_vectors(real.where("subset = 'valid'")), layers,
                            M.TrainingArgs(step=step))
    report = M.patient_report(model, M.as_vectors(real.where("subset = 'test'")), order=row_id)
    return _log(report, {"stages": len(sets)}, results)


def run_multichannel(rows: DataFrame, layers: Sequence[int], regime: Regime, row_id: str,
                     k_best: int = 80, augment=None, step: int = 2, results: str | None = None
                     ) -> DataFrame:
    """Head and support-vector probe side by side, nested under ``mlp`` and ``svm``."""
    part = lambda s: M.as_vectors(rows.where(F.col("subset") == s))
    every = copies(rows.where("subset = 'train'"), regime.train_copies, row_id, augment)
    train = M.as_vectors(every)
    model, _ = M.fit_head(M.as_vectors(drawn(every, row_id)), part("valid"), layers, M.TrainingArgs(regime.train_epochs, step=step))
    mlp = _nest(M.patient_report(model, part("test"), order=row_id))
    probe = M.fit_kernel_probe(train.select("features", "label"), k_best)
    pairs = probe.transform(part("test")).select(
        F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))
    svm = metrics(confusion(pairs)).select(F.struct(*METRICS).alias("svm"))
    config = {"epochs": regime.epochs, "augment_num": regime.train_copies, "halved": regime.halved, "k_best": k_best}
    record = mlp.select(*[F.lit(v).alias(k) for k, v in config.items()], F.struct("fragment", "patient").alias("mlp"),
                        svm.scalar().alias("svm"))
    if results:
        append_results(record, results)
    return record


def run_fusion(rows: DataFrame, parts: Sequence[str], dims: int, hidden: Sequence[int], regime: Regime,
               row_id: str, step: int = 2) -> DataFrame:
    """Two or more branches: per-channel features concatenated, one head on top."""
    for p in parts:
        rows = rows.withColumn(p, M.array_to_vector(F.col(p)))
    fused = M.fuse(rows, parts)
    part = lambda s: fused.where(F.col("subset") == s)
    model, _ = M.fit_head(part("train"), part("valid"), [dims, *hidden, 2],
                          M.TrainingArgs(regime.train_epochs, step=step))
    return M.patient_report(model, part("test"), order=row_id)
