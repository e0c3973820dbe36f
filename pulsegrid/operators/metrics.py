"""Confusion counts, derived metrics, patient votes and model selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.numeric import ratio

# Names of the reported metrics.
METRICS = ("accuracy", "uar", "sensitivity", "specificity", "npv", "precision", "f1", "mcc")


CELLS = ("tp", "tn", "fp", "fn")


def cell_counts(truth: Column, pred: Column) -> list[Column]:
    """Aggregates for tp, tn, fp, fn; any pair that is none of the first three counts as fn."""
    tp, tn, fp = (truth == 1) & (pred == 1), (truth == 0) & (pred == 0), (truth == 0) & (pred == 1)
    rest = ~F.coalesce(tp | tn | fp, F.lit(False))
    return [F.count_if(c).alias(n) for c, n in zip((tp, tn, fp, rest), CELLS)]


def confusion(df: DataFrame, keys: Sequence[str] = (), truth: str = "y_true",
              pred: str = "y_pred") -> DataFrame:
    """Confusion counts per key."""
    return df.groupBy(*keys).agg(*cell_counts(F.col(truth), F.col(pred)))


def metric_columns() -> list[Column]:
    """The eight metrics over columns tp, tn, fp, fn; 0 wherever a denominator is 0."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    sens, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    prec, npv = ratio(tp, tp + fp), ratio(tn, tn + fn)
    scale = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return [ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
            ((sens + spec) * 0.5).alias("uar"),
            sens.alias("sensitivity"), spec.alias("specificity"), npv.alias("npv"),
            prec.alias("precision"), ratio(prec * sens * 2, prec + sens).alias("f1"),
            ratio(tp * tn - fp * fn, scale).alias("mcc")]


def metrics(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return counts.select(*keys, *metric_columns())


def metric_line() -> Column:
    """One-line rendering of the metric columns."""
    return F.format_string("acc=%.4f uar=%.4f sens=%.4f spec=%.4f mcc=%.4f",
                           "accuracy", "uar", "sensitivity", "specificity", "mcc")


def argmax(scores: Column) -> Column:
    """0-based position of the largest element, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def _votes(predictions: DataFrame, keys: Sequence[str], classes: int, order: str, extra=()) -> DataFrame:
    means = [F.avg(F.get("logits", F.lit(c))).alias(f"__m{c}") for c in range(classes)]
    voted = predictions.groupBy(*keys).agg(F.max_by("y_true", order).alias("y_true"), *means, *extra)
    logits = F.array(*[F.col(f"__m{c}") for c in range(classes)])
    return voted.withColumn("y_pred", argmax(logits)).drop(*[f"__m{c}" for c in range(classes)])


def patient_votes(predictions: DataFrame, keys: Sequence[str], classes: int,
                  order: str = "fragment_id") -> DataFrame:
    """Per patient: the class with the largest mean logit, and the truth of its last fragment.

    The per-class sums are plain columns, so the shuffle carries one partial row per patient and
    task, whatever a patient's share of the fragments.
    """
    return _votes(predictions, keys, classes, order)


def grouped_metrics(predictions: DataFrame, keys: Sequence[str], classes: int = 2,
                    order: str = "fragment_id") -> DataFrame:
    """Metrics per key at fragment and at patient level, in one pass over the predictions.

    Fragment counts are made per patient beside the vote; the second aggregate adds them up and
    counts the votes.
    """
    single = [c.alias(f"__{n}") for c, n in zip(cell_counts(F.col("y_true"), argmax(F.col("logits"))), CELLS)]
    votes = _votes(predictions, [*keys, "patient"], classes, order, single)
    sums = [F.coalesce(F.sum(f"__{n}"), F.lit(0)).alias(f"__{n}") for n in CELLS]
    both = votes.groupBy(*keys).agg(*sums, *cell_counts(F.col("y_true"), F.col("y_pred")))
    level = lambda name, prefix: F.struct(F.lit(name).alias("level"), *[
        F.col(prefix + n).alias(n) for n in CELLS])
    rows = both.select(*keys, F.explode(F.array(level("fragment", "__"), level("patient", ""))).alias("r"))
    return metrics(rows.select(*keys, "r.*"), [*keys, "level"])


def best_rows(log: DataFrame, keys: Sequence[str], score: str = "mcc", epoch: str = "epoch"
              ) -> DataFrame:
    """The row with the highest score per key, the earliest epoch on ties; one partial aggregate."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(epoch))).alias("__b"))
    return best.select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest])


def epoch_means(log: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean of each logged value per run and epoch."""
    return log.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values],
                                  F.count(F.lit(1)).alias("n"))
