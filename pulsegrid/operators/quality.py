"""Feature-quality measures: class centres, contrastive score, univariate F scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.functions.keyed import digest
from pulsegrid.operators.ranking import hash_bucket, split_rank


def mean_pool(rows: DataFrame, keys: Sequence[str], features: str) -> DataFrame:
    """Element-wise mean vector per key; one partial vector per key and task is shuffled."""
    pooled = rows.groupBy(*keys).agg(
        Summarizer.mean(array_to_vector(F.col(features))).alias("centre"))
    return pooled.withColumn("centre", vector_to_array("centre"))


def centre_distance(rows: DataFrame, features: str, label: str = "label") -> DataFrame:
    """Squared distance of each row to the mean vector of its class.

    The centres, one vector per class, reach the rows as one map value: no shuffle by class.
    """
    centres = mean_pool(rows, [label], features).agg(F.map_from_entries(
        F.collect_list(F.struct(F.col(label), F.col("centre")))).alias("m")).scalar()
    diff = F.zip_with(features, "__c", lambda x, c: (x - c) * (x - c))
    return (rows.withColumn("__c", F.element_at(centres, F.col(label)))
            .withColumn("centre_distance", A.total(diff)).drop("__c"))


def batches(rows: DataFrame, row_id: str, size: int, seed: int = 0) -> DataFrame:
    """Batches of exactly ``size`` rows (the last may be smaller) in keyed hash order."""
    hashed = rows.withColumn("__h", digest(seed, "batch", F.col(row_id)))
    ranked = split_rank(hashed, [], ["__h", row_id], hash_bucket(F.col("__h")), "__r")
    return ranked.withColumn("batch", F.expr(f"(__r - 1) div {size}")).drop("__h", "__r")


def contrastive(batched: DataFrame, row_id: str, features: str, label: str = "label",
                batch: str = "batch", temperature: float = 0.7) -> DataFrame:
    """Mean log-probability of a row's same-class partners in its batch, by cosine similarity.

    A batch is a small fixed number of rows, so its similarity matrix is one numpy product in one
    group; no pair rows are produced. Rows without a partner get null.
    """
    kinds = {f.name: f.dataType.simpleString() for f in batched.schema.fields}

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = np.array(pdf[features].tolist(), dtype=float)
        vectors /= np.maximum(np.sqrt(np.square(vectors).sum(axis=1)), 1e-12)[:, None]
        kind, members = np.unique(pdf[label].to_numpy(), return_inverse=True)
        # Partners enter by the sum of their class, less the row itself: no mask of pairs.
        sums = np.zeros((len(kind), vectors.shape[1]))
        np.add.at(sums, members, vectors)
        partners = np.bincount(members)[members] - 1
        toward = np.einsum("ij,ij->i", vectors, sums[members] - vectors) / temperature
        # All others enter by the normaliser, taken relative to the largest similarity.
        similar = vectors @ vectors.T / temperature
        largest = similar.max(axis=1)
        np.fill_diagonal(similar, -np.inf)
        normaliser = largest + np.log(np.exp(similar - largest[:, None]).sum(axis=1) + 1e-8)
        mean = pd.Series(toward / np.maximum(partners, 1) - normaliser, index=pdf.index)
        return pd.DataFrame({batch: pdf[batch], row_id: pdf[row_id], "partners": partners,
                             "mean_log_prob": mean.where(partners > 0)})

    return batched.select(batch, row_id, features, label).groupBy(batch).applyInPandas(
        score, f"{batch} {kinds[batch]}, {row_id} {kinds[row_id]}, partners long, mean_log_prob double")


def cross_entropy(logits: Column, label: Column) -> Column:
    """Negative log-softmax of the true class."""
    top = F.array_max(logits)
    spread = A.bind(top, lambda m: m + F.log(A.total(F.transform(logits, lambda z: F.exp(z - m)))))
    return spread - F.get(logits, label)


def objective(batched: DataFrame, row_id: str, features: str, logits: str,
              label: str = "label", alpha: float = 0.5, beta: float = 0.2, centre: float = 0.01,
              temperature: float = 0.7) -> DataFrame:
    """Per batch: contrastive, cross-entropy and centre terms, and their weighted sum."""
    con = contrastive(batched, row_id, features, label, temperature=temperature).groupBy("batch").agg(
        F.coalesce(-F.avg("mean_log_prob"), F.lit(0.0)).alias("contrastive"))
    rest = (centre_distance(batched, features, label)
            .withColumn("__ce", cross_entropy(F.col(logits), F.col(label)))
            .groupBy("batch").agg(F.avg("__ce").alias("classification"),
                                  F.avg("centre_distance").alias("centre")))
    return con.join(rest, "batch").withColumn(
        "total", beta * F.col("contrastive") + alpha * F.col("classification") + centre * F.col("centre"))


def f_scores(rows: DataFrame, features: str, label: str = "label") -> DataFrame:
    """One-way analysis-of-variance F per feature, from each class's count, mean and variance.

    Only deviations are squared, so a feature with a large mean keeps its digits. A feature has one group a class,
    of which there are few; classes without a value of the feature don't count.
    """
    long = rows.select(label, F.posexplode_outer(features).alias("feature", "x"))
    classes = long.groupBy("feature", label).agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var")).where("n > 0")
    whole = classes.groupBy("feature").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("var")).alias("within"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("centre"),
        F.array_sort(F.collect_list(F.struct("mean", F.col("n").alias("size")))).alias("classes"))
    between = F.aggregate("classes", F.lit(0.0), lambda s, c: s + c["size"] * (c["mean"] - F.col("centre")) * (c["mean"] - F.col("centre")))
    return whole.select("feature", (between / (F.col("k") - 1) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f"))


def best_features(rows: DataFrame, features: str, k: int = 80, label: str = "label") -> DataFrame:
    """The k features with the largest F score (all of them when there are fewer)."""
    return f_scores(rows, features, label).orderBy(F.col("f").desc(), "feature").limit(k)
