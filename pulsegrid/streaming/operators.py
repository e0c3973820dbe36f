"""Structured Streaming forms of windowing, running metrics and result ingestion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.operators.metrics import confusion, metric_columns
from pulsegrid.plans.report import commit_results, run_key


def sliding_windows(stream: DataFrame, time: str, keys: Sequence[str], length: str, hop: str,
                    delay: str, value: str = "value") -> DataFrame:
    """Overlapping event-time windows per key.

    A row that comes after its window's end has passed by more than ``delay`` is left out of that window (``write_late``
    keeps such rows). ``write_append`` stores closed windows only; where the input ends, ``write_updates`` and
    ``latest_updates`` give the open ones as well.
    """
    return (stream.withWatermark(time, delay)
            .groupBy(F.window(time, length, hop), *keys)
            .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"),
                 F.max(F.abs(value)).alias("peak"))
            .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"),
                    *keys, "n", "total", "peak"))


def running_confusion(stream: DataFrame, time: str, keys: Sequence[str], length: str, delay: str
                      ) -> DataFrame:
    """Confusion counts and metrics per event-time window and key, updated as rows arrive."""
    timed = (stream.withWatermark(time, delay)
             .withColumn("window", F.window(time, length)))
    counts = confusion(timed, ["window", *keys])
    return counts.select(F.col("window.start").alias("start"), *keys, "tp", "tn", "fp", "fn",
                         *metric_columns())


def write_late(stream: DataFrame, time: str, delay: str, path: str, checkpoint: str) -> StreamingQuery:
    """Rows that come more than ``delay`` after the latest time of earlier batches, below ``path/late``: those that windows
    with this delay may leave out. A repeated batch overwrites its own folders."""

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.agg(F.max(time).alias("latest")).write.mode("overwrite").parquet(f"{path}/marks/batch={batch_id}")
        mark = spark.read.parquet(f"{path}/marks").where(F.col("batch") < batch_id).agg(F.max("latest")).scalar()
        batch.where(F.col(time) < mark - F.expr(f"INTERVAL {delay}")).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")

    return (stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def write_append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process all available input into a Parquet table, exactly once."""
    return (df.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path))


def write_updates(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch's changed rows under ``batch=<id>``; a repeated batch overwrites its own folder."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (df.writeStream.outputMode("update").foreachBatch(store)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last state of every key from the stored updates."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s"))
    return last.select(*keys, "s.*")


def ingest_results(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Result records from a file stream, appended under ``batch=<id>`` so repeats do not double."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def commit_result_stream(stream: DataFrame, log: str, checkpoint: str, run: str, group_by: Sequence[str] = ("run_label",)) -> StreamingQuery:
    """Result records from a stream into a log that ``committed_summary`` reads; each batch is a commit of its own, so a repeat changes nothing."""

    def store(batch: DataFrame, batch_id: int) -> None:
        commit_results(batch, log, run_key(batch.sparkSession, run, batch_id), group_by)

    return (stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
