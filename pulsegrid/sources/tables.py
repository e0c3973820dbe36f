"""Label lists, split tables, manifests: CSV scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.functions.numeric import half_even, binary_label
from pulsegrid.functions.keyed import digest
from pulsegrid.operators.ranking import hash_bucket, split_rank
from pulsegrid.operators.splits import fold_column, label_column


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``record,label`` rows; ids are trimmed, short rows skipped, none left is an error."""
    raw = spark.read.schema("record_id STRING, label STRING").csv(path)
    rows = (raw.where((F.col("record_id") != "") & F.col("label").isNotNull())
            .select(F.trim("record_id").alias("record_id"),
                    F.trim("label").cast("int").alias("label")))
    if rows.isEmpty():
        raise ValueError(f"no labels in {path}")
    return rows


def union_labels(parts: Sequence[DataFrame]) -> DataFrame:
    """Union in order; a record listed more than once keeps the last listed label.

    Files of one part go by path, whatever order they are scanned in; a row's place in its file is that of its
    split and then of the row, which a task reads in order.
    """
    numbered = [_placed(p).select("record_id", "label", F.lit(i).alias("__part"), "__file", "__split",
                                  F.monotonically_increasing_id().alias("__row"))
                for i, p in enumerate(parts)]
    rows = numbered[0]
    for p in numbered[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("record_id").agg(
        F.max_by("label", F.struct("__part", "__file", "__split", "__row")).alias("label"))


def _placed(rows: DataFrame) -> DataFrame:
    """With the file and split that each row comes from; without, where ``rows`` is no file scan."""
    try:
        return rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__split"))
    except AnalysisException:
        return rows.withColumn("__file", F.lit("")).withColumn("__split", F.lit(0).cast("long"))


def read_split(spark: SparkSession, path: str, subset: str = "all", fold: int = 1) -> DataFrame:
    """Split table with ``#`` comments, restricted to one subset of one fold unless ``all``."""
    rows = spark.read.option("header", True).option("comment", "#").csv(path)
    if subset != "all":
        rows = rows.where(F.col(fold_column(fold)) == subset)
    return rows


def with_binary_label(rows: DataFrame) -> DataFrame:
    """Resolve the label column and encode it as 0/1 in ``label``."""
    return rows.withColumn("label", binary_label(F.col(label_column(rows))))


def write_splits(wide: DataFrame, path: str) -> str:
    """Split table as CSV; the id column keeps the file format's name ``patient``."""
    wide.withColumnRenamed("record_id", "patient").write.option("header", True).csv(path)
    return path


def proportion_sample(rows: DataFrame, keys: Sequence[str], row_id: str, frac, seed: int = 0
                      ) -> DataFrame:
    """Exactly round(frac * n) rows of each key, without replacement, by keyed hash order."""
    frac = F.lit(frac) if isinstance(frac, (int, float)) else frac
    hashed = rows.withColumn("__h", digest(seed, "sample", F.col(row_id)))
    ranked = split_rank(hashed, keys, ["__h", row_id], hash_bucket(F.col("__h")), "__r", "__n")
    return ranked.where(F.col("__r") <= half_even(F.col("__n") * frac)).select(*rows.columns)


def read_manifest(spark: SparkSession, path: str, listing: DataFrame) -> DataFrame:
    """Manifest rows ``patient,label,file`` whose file is in ``listing(file)``; binary labels."""
    rows = spark.read.schema("patient STRING, label STRING, file STRING").option(
        "header", True).csv(path)
    return rows.join(listing.select("file"), "file", "left_semi").select(
        "patient", binary_label(F.col("label")).alias("label"), "file")


def load_report(listed: DataFrame, present: DataFrame, key: str, group: str) -> DataFrame:
    """Records per group that are listed, present, and missing."""
    gone = listed.join(present.select(key), key, "left_anti").groupBy(group).agg(
        F.count(F.lit(1)).alias("missing"))
    return (listed.groupBy(group).agg(F.count(F.lit(1)).alias("listed"))
            .join(gone, group, "left")
            .select(group, "listed", F.coalesce("missing", F.lit(0)).alias("missing")))


def write_waveforms(rows: DataFrame, path: str) -> str:
    """Synthetic set: waveforms by label, and a manifest named ``<patient>_<idx>_<copy>``."""
    named = rows.withColumn("file", F.concat_ws("_", "patient", "idx", "copy_no"))
    named.write.partitionBy("label").parquet(f"{path}/waveforms")
    named.select("patient", "label", "file").write.option("header", True).csv(f"{path}/manifest")
    return path
