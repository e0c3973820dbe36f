"""Result log to mean/std condition tables and Markdown lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from pulsegrid.functions.keyed import digest
from pulsegrid.operators.metrics import METRICS


def append_results(rows: DataFrame, path: str) -> str:
    """Append result records as JSON lines; concurrent writers add files and never rewrite any."""
    rows.write.mode("append").json(path)
    return path


def commit_results(records: DataFrame, log: str, run: str, group_by: Sequence[str] = ("run_label",)) -> str:
    """Store one run's records, and the moments of their metrics, under the run's digest (see ``run_key``).

    A run that is stored again, by a repeated batch or after a broken job, overwrites its own folder, so the log never holds it twice. The
    moments (one row per condition and metric) are written last: what ``committed_summary`` counts is whole. One writer at a time stores a run; different
    runs may be stored at once.
    """
    home = log.rstrip("/")
    records.write.mode("overwrite").json(f"{home}/records/commit={run}")
    kept = load_results(records.sparkSession, f"{home}/records/commit={run}")
    leaves = flatten(kept, [group_label(kept.schema, group_by).alias("condition")])
    moments(leaves).coalesce(1).write.mode("overwrite").parquet(f"{home}/moments/commit={run}")
    return home


def run_key(spark: SparkSession, *settings) -> str:
    """Digest of a run's settings; a stream adds its batch's number."""
    return spark.range(1).select(digest("run", *settings)).first()[0]


def moments(leaves: DataFrame) -> DataFrame:
    """``condition, path, n, mean, m2``: count, mean and sum of squared deviations, which merge without the values."""
    n = F.count("value")
    return leaves.groupBy("condition", "path").agg(n.alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * n).alias("m2"))


def merged(parts: DataFrame) -> DataFrame:
    """Moments of several runs as those of all their values; deviations are taken from the common mean, so nothing cancels."""
    by = Window.partitionBy("condition", "path")
    total = F.sum("n").over(by)
    mean = F.sum(F.col("n") * F.col("mean")).over(by) / total
    spread = F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("__mean")) * (F.col("mean") - F.col("__mean")))
    return (parts.where("n > 0").withColumn("__mean", mean).groupBy("condition", "path")
            .agg(F.sum("n").alias("n"), F.max("__mean").alias("mean"), spread.alias("m2")))


def committed_summary(spark: SparkSession, log: str) -> DataFrame:
    """``summarize`` of all runs stored by ``commit_results``; it reads their moments and no record."""
    held = spark.read.schema("condition STRING, path STRING, n BIGINT, mean DOUBLE, m2 DOUBLE").parquet(f"{log.rstrip('/')}/moments")
    cells = merged(held).select("condition", "path", "mean", F.sqrt(F.col("m2") / F.col("n")).alias("std"), "n")
    return cells.withColumn("group_n", F.max("n").over(Window.partitionBy("condition")))


def load_results(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Result records from JSON lines, or from one JSON list or object with ``multiline``."""
    return spark.read.option("multiLine", multiline).json(path)


def metric_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted paths of the numeric metric leaves of a nested record schema, at any depth."""
    out = []
    for field in schema.fields:
        path = f"{prefix}{field.name}"
        if isinstance(field.dataType, T.StructType):
            out += metric_paths(field.dataType, f"{path}.")
        elif field.name in METRICS and isinstance(field.dataType, (T.NumericType, T.BooleanType)):
            out.append(path)
    return out


def group_label(schema: T.StructType, fields: Sequence[str]) -> Column:
    """``field=value`` parts joined by commas; absent, null and nested fields are left out."""
    kinds = {f.name: f.dataType for f in schema.fields}
    parts = [F.when(F.col(f).isNotNull(),
                    F.concat(F.lit(f"{f}="), F.col(f).cast("string")))
             for f in fields if f in kinds and not isinstance(kinds[f], T.StructType)]
    return F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit("all"))


def flatten(records: DataFrame, keep: Sequence[Column] = ()) -> DataFrame:
    """One ``(path, value)`` row per metric leaf of each record."""
    leaves = [F.struct(F.lit(p).alias("path"), F.col(p).cast("double").alias("value"))
              for p in metric_paths(records.schema)]
    leaf = F.explode_outer(F.array(*leaves)).alias("leaf")
    return (records.select(*keep, leaf).where(F.col("leaf.value").isNotNull())
            .select("*", "leaf.*").drop("leaf"))


def summarize(records: DataFrame, group_by: Sequence[str] = ("run_label",)) -> DataFrame:
    """``(condition, path, mean, std, n, group_n)``; std is over the population."""
    leaves = flatten(records, [group_label(records.schema, group_by).alias("condition")])
    return summarize_leaves(leaves)


def summarize_leaves(leaves: DataFrame) -> DataFrame:
    cells = leaves.groupBy("condition", "path").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.count("value").alias("n"))
    # One row per condition and metric path is left here, so this window is small.
    return cells.withColumn("group_n", F.max("n").over(Window.partitionBy("condition")))


def select_metrics(paths: Sequence[str], wanted: Sequence[str] | None) -> list[str]:
    """Sorted paths, restricted to those equal to or ending with a wanted name."""
    if not wanted:
        return sorted(paths)
    return sorted(p for p in paths if any(p == w or p.endswith("." + w) for w in wanted))


def markdown(summary: DataFrame, paths: Sequence[str], wanted: Sequence[str] | None = None
             ) -> DataFrame:
    """Report lines ``(line_no, line)``: header, rule, then one line per condition in order."""
    cols = select_metrics(paths, wanted)
    cell = F.format_string("%.4f±%.4f", "mean", "std")
    wide = (summary.withColumn("cell", cell).groupBy("condition", "group_n")
            .pivot("path", cols).agg(F.first("cell")))
    cells = [F.coalesce(F.col(f"`{c}`"), F.lit("-")) for c in cols]
    # group_n may differ only through paths outside ``cols``; it is constant per condition.
    body = wide.select(
        (F.row_number().over(Window.orderBy("condition")) + 2).cast("long").alias("line_no"),
        F.concat(F.lit("| "), F.concat_ws(" | ", F.col("condition"), F.col("group_n").cast("string"),
                                          *cells), F.lit(" |")).alias("line"))
    head = summary.sparkSession.createDataFrame(
        [(1, "| condition | n | " + " | ".join(cols) + " |"),
         (2, "|" + "---|" * (len(cols) + 2))], "line_no BIGINT, line STRING")
    return head.unionByName(body)
