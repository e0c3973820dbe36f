"""Training along a schedule table: every row learns its stages in one pass, and a log lets a broken run go on."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.functions.keyed import digest
from pulsegrid.functions.numeric import half_even
from pulsegrid.operators.metrics import METRICS
from pulsegrid.operators.ranking import hash_bucket, split_rank
from pulsegrid.plans import experiment as E
from pulsegrid.plans import models as M
from pulsegrid.plans.report import append_results
from pulsegrid.session import cut_lineage, path_exists
from pulsegrid.sources import schedule as S

LOG = "digest STRING, attempt STRING, stage INT, key STRING, epochs INT, n BIGINT, drawn BIGINT, best_epoch INT, best_mcc DOUBLE, model STRING"


def stage_plan(schedule: DataFrame) -> DataFrame:
    """``stage, key, epochs, base_set, path, gen_data, augment_num, share`` of one schedule.

    ``share`` is the part of a set's recordings that a stage reads: the proportion of generated sets and of the base sets of
    combined ones; real sets on their own are read whole.
    """
    part = F.when(F.col("gen_data") | (F.col("key") != F.col("base_set")), F.col("proportion")).otherwise(F.lit(1.0))
    return S.resolved_stages(schedule).select(
        "stage", "key", "epochs", "base_set", "path", "gen_data", "augment_num", part.alias("share"))


def tagged(rows: DataFrame, plan: DataFrame, record: str, seed: int = 0) -> DataFrame:
    """``rows(path, subset, record, ..)`` plus ``stages``, an array of ``(stage, base_set, augment_num)``, empty for rows that no stage reads.

    Stages read training rows and rows without a subset (generated sets have none). Of a set of which a stage reads a share,
    the recordings with the lowest keyed hashes are taken, exactly ``round(share * n)``, so smaller shares lie within larger ones and one
    ranking serves all stages. Hash slices are ranked, not whole sets: a set may hold any part of the recordings. The plan is of a
    schedule file's size and reaches the rows as one map value. Rows without a record id are in no stage.
    """
    open_to_stages = F.col("subset").isNull() | (F.col("subset") == "train")
    by_path = plan.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("stage", "base_set", "augment_num", "share"))).alias("s"))
    whole = by_path.agg(F.map_from_entries(F.collect_list(F.struct("path", "s")))).scalar()
    known = rows.where(F.col("path").isNotNull() & F.col(record).isNotNull() & open_to_stages).select("path", record).distinct()
    hashed = known.withColumn("__h", digest(seed, "sample", F.col(record))).withColumn("__s", F.try_element_at(whole, F.col("path")))
    ranked = split_rank(hashed, ["path"], ["__h", record], hash_bucket(F.col("__h")), "__r", "__n")
    read = F.filter("__s", lambda s: F.col("__r") <= half_even(F.col("__n") * s["share"]))
    kept = F.transform(read, lambda s: F.struct(s["stage"].alias("stage"), s["base_set"].alias("base_set"), s["augment_num"].alias("augment_num")))
    marks = ranked.select(F.col("path").alias("__path"), F.col(record).alias("__record"), kept.alias("stages"))
    none = F.array().cast("array<struct<stage:int,base_set:string,augment_num:int>>")
    met = rows.withColumn("__open", open_to_stages).join(
        marks, (F.col("path") == F.col("__path")) & (F.col(record) == F.col("__record")) & F.col("__open"), "left")
    return met.select(*rows.columns, F.coalesce("stages", none).alias("stages"))


def stage_rows(marked: DataFrame, stage: int) -> DataFrame:
    return marked.where(F.exists("stages", lambda s: s["stage"] == stage)).drop("stages")


def stage_sets(marked: DataFrame, label: str = "label") -> DataFrame:
    """``stage, base_set, label, n, copies``: what every stage reads, and the copies that balance its classes."""
    each = marked.select(label, F.explode("stages").alias("s")).groupBy("s.stage", "s.base_set", "s.augment_num", label).agg(F.count(F.lit(1)).alias("n"))
    # One row per stage, set and class is left here.
    own = F.sum("n").over(Window.partitionBy("stage", label))
    sized = each.withColumn("__own", own).withColumn("__most", F.max("__own").over(Window.partitionBy("stage")))
    copies = half_even(F.col("augment_num") * F.col("__most") / F.col("__own"))
    return sized.select("stage", "base_set", label, "n", F.when(F.col(label).isNotNull(), copies).otherwise(0).alias("copies"))


def run_digest(schedule: DataFrame, *settings) -> str:
    """Digest of a schedule's content and the settings of a run; where the file lies plays no part."""
    content = schedule.drop("file").select(F.to_json(F.struct("*")).alias("j")).collect()
    if len(content) != 1:
        raise ValueError(f"a run follows one schedule, not {len(content)}")
    return schedule.sparkSession.range(1).select(digest(content[0]["j"], *settings)).first()[0]


def read_log(spark, log: str) -> DataFrame:
    path = f"{log.rstrip('/')}/stages"
    return spark.read.schema(LOG).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], LOG)


def run_schedule(schedule: DataFrame, rows: DataFrame, record: str, row_id: str, layers: Sequence[int], log: str, augment=None,
                 args: M.TrainingArgs = M.TrainingArgs(), until: int | None = None, results: str | None = None, run_label: str = "") -> DataFrame | None:
    """Train through the stages of one schedule and report on its test set, as one result record.

    ``rows(path, subset, record, row_id, patient, label, x)`` are the fragments of all sets: of real ones with their subsets, of
    generated ones without. ``valid_set.data`` and ``test_set.data`` name the paths that select and test. Each stage starts from
    the weights of the one before and keeps its best epoch by validation MCC; its training rows are drawn with classes equally likely,
    copies included.

    ``log`` is a folder that every executor can reach. A stage is entered there once its model is stored, under a digest of the
    schedule's content and the settings; a run with the same digest takes up after the last stage entered. ``until`` ends
    a run before that stage (the result is None then).
    """
    S.check(schedule)
    spark, home = rows.sparkSession, log.rstrip("/")
    key = run_digest(schedule, list(layers), args, run_label)
    attempt = uuid.uuid4().hex
    plan = stage_plan(schedule)
    steps = plan.groupBy("stage", "key", "epochs").agg(F.max("augment_num").alias("augment_num")).orderBy("stage").collect()  # a schedule file's size
    ends = {r["part"]: r["data"] for r in S.eval_sets(schedule).collect()}
    done = {r["stage"]: r for r in read_log(spark, log).where(F.col("digest") == key).collect()}
    marked = cut_lineage(tagged(rows, plan, record, args.seed), "staged-rows")
    part = lambda end, subset: M.as_vectors(marked.where((F.col("path") == ends[end]) & (F.col("subset") == subset)).drop("stages"))
    model = None
    for step in steps:
        number = step["stage"]
        if until is not None and number >= until:
            return None
        if number in done:
            model = MultilayerPerceptronClassificationModel.load(done[number]["model"])
            continue
        own = stage_rows(marked, number)
        every = E.copies(own, step["augment_num"], row_id, augment)
        train = cut_lineage(E.drawn(every, row_id, number), f"stage-{number}")
        model, epochs = M.fit_head(M.as_vectors(train), part("valid_set", "valid"), layers,
                                   M.TrainingArgs(step["epochs"], args.batch_size, args.seed, args.step), model)
        best = max(epochs, key=lambda e: (e[1], -e[0]))
        path = f"{home}/models/{key}-{number}-{uuid.uuid4().hex}"
        model.save(path)
        entry = (key, attempt, number, step["key"], step["epochs"], own.count(), train.count(), best[0], float(best[1]), path)
        spark.createDataFrame([entry], LOG).coalesce(1).write.mode("append").parquet(f"{home}/stages")
    if model is None:
        raise ValueError("the schedule has no stages")
    report = M.patient_report(model, part("test_set", "test"), order=row_id)
    cell: Column = F.struct(*METRICS)
    record_of = report.agg(*[F.max(F.when(F.col("level") == level, cell)).alias(level) for level in ("fragment", "patient")])
    out = record_of.select(F.lit(key).alias("run"), F.lit(run_label).alias("run_label"), F.lit(len(steps)).alias("stages"), "*")
    if results:
        append_results(out, results)
    return out
