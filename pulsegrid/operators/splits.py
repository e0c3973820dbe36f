"""Patient-level stratified folds, their reports, and leave-one-source-out sets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.keyed import digest
from pulsegrid.functions.numeric import half_even
from pulsegrid.operators.joins import measured_join
from pulsegrid.operators.ranking import hash_bucket, split_rank

# Accepted label column names, in order of preference.
LABEL_COLUMNS = ("abnormality", "label", "diagnosis")


@dataclass(frozen=True)
class Ratios:
    train: float = 0.6
    valid: float = 0.2
    test: float = 0.2

    def __post_init__(self):
        if abs(self.train + self.valid + self.test - 1.0) > 1e-6:
            raise ValueError(f"the three shares must add up to 1: {self}")


def label_column(df: DataFrame) -> str:
    """The first of the accepted label column names that the table has."""
    for name in LABEL_COLUMNS:
        if name in df.columns:
            return name
    raise KeyError(f"none of {LABEL_COLUMNS} in {df.columns}")


def patient_labels(records: DataFrame) -> DataFrame:
    """One label per patient: that of its first record in id order."""
    return records.groupBy("patient").agg(F.min_by("label", "record_id").alias("label"))


def stratified_folds(labels: DataFrame, folds: int = 5, ratios: Ratios | None = None,
                     seed: int = 42, patient: Column | None = None) -> DataFrame:
    """``labels(record_id, label)`` to ``(record_id, patient, label, fold, subset)``.

    Patients are ordered by a keyed hash inside each fold and class; the first share becomes
    ``test``, the next ``valid``, the rest ``train``. A class may hold any part of the patients:
    ranks come from hash slices, not from one task per class.
    """
    ratios = ratios or Ratios()
    records = labels.withColumn("patient", F.col("record_id") if patient is None else patient)
    every = (patient_labels(records)
             .withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
             .withColumn("__h", digest(seed, "fold", F.col("fold"), F.col("patient"))))
    ranked = split_rank(every, ["fold", "label"], ["__h", "patient"], hash_bucket(F.col("__h")),
                        "__rank", size="__n")
    n_test = half_even(F.col("__n") * F.lit(ratios.test))
    n_valid = half_even(F.col("__n") * F.lit(ratios.valid))
    subset = (F.when(F.col("__rank") <= n_test, "test")
              .when(F.col("__rank") <= n_test + n_valid, "valid").otherwise("train"))
    assigned = ranked.select("patient", "fold", subset.alias("subset"))
    # Unless every record is a patient of its own, one patient may hold most of the records.
    met = records.join(assigned, "patient") if patient is None else measured_join(records, assigned, ["patient"], F.col("record_id"))
    return met.select("record_id", "patient", "label", "fold", "subset")


def fold_column(fold: int) -> str:
    return "split" if fold == 1 else f"split{fold}"


def widen(splits: DataFrame, folds: int) -> DataFrame:
    """One row per record, one column per fold."""
    wide = (splits.groupBy("record_id", "label").pivot("fold", list(range(1, folds + 1)))
            .agg(F.first("subset")))
    return wide.select("record_id", "label",
                       *[F.col(str(f)).alias(fold_column(f)) for f in range(1, folds + 1)])


def narrow(wide: DataFrame) -> DataFrame:
    """Fold columns back to ``fold, subset`` rows."""
    names = [c for c in wide.columns if c == "split" or c[:5] == "split" and c[5:].isdigit()]
    keep = [c for c in wide.columns if c not in names]
    long = wide.unpivot(keep, names, "__fold", "subset")
    number = F.when(F.col("__fold") == "split", F.lit(1)).otherwise(
        F.expr("cast(substring(__fold, 6) AS int)"))
    return long.withColumn("fold", number).drop("__fold")


def subset_rows(splits: DataFrame, subset: str, fold: int = 1) -> DataFrame:
    """Rows of one subset of one fold; ``all`` keeps every row of the fold."""
    rows = splits.where(F.col("fold") == fold)
    return rows if subset == "all" else rows.where(F.col("subset") == subset)


def split_sizes(splits: DataFrame) -> DataFrame:
    """Records per fold and subset, with a total per fold and over all."""
    return (splits.rollup("fold", "subset").agg(F.count(F.lit(1)).alias("n"))
            .select(F.coalesce("fold", F.lit(0)).alias("fold"),
                    F.coalesce("subset", F.lit("all")).alias("subset"), "n"))


def leakage(splits: DataFrame, group: str = "patient") -> DataFrame:
    """Groups that appear in more than one subset of a fold."""
    # Distinct first: at most three rows per group and fold reach the final count.
    return (splits.select("fold", group, "subset").distinct()
            .groupBy("fold", group).agg(F.count(F.lit(1)).alias("n_subsets"))
            .where(F.col("n_subsets") > 1))


def leave_one_source_out(records: DataFrame, holdouts: Sequence[str] | None = None) -> DataFrame:
    """Train/valid rows of all sources but one, every row of the held-out one as test.

    ``records`` has ``source_db`` and ``subset``. The held-out names are an array literal when
    given, otherwise one array of the distinct sources, so each row is expanded in place.
    """
    if holdouts is not None:
        names = F.array(*[F.lit(h) for h in holdouts])
        wide = records.withColumn("holdout", F.explode(names))
    else:
        sources = records.select("source_db").distinct().agg(
            F.sort_array(F.collect_set("source_db")).alias("s"))
        wide = records.withColumn("holdout", F.explode(sources.scalar()))
    held = F.col("source_db") == F.col("holdout")
    return (wide.where(held | F.col("subset").isin("train", "valid"))
            .withColumn("part", F.when(held, "test").otherwise(F.col("subset"))))
