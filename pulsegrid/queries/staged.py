"""Schedule-driven training. Stand-in: one set per language, generated ones without subsets, and one of all sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.functions.numeric import tidy
from pulsegrid.plans import models as M
from pulsegrid.plans import staged as P
from pulsegrid.plans.report import flatten
from pulsegrid.queries import query, table
from pulsegrid.queries.models import noisy
from pulsegrid.session import scratch_path
from pulsegrid.sources import schedule as S

REAL = ("de", "en")
SETS_SQL = """
src AS (SELECT lang AS key, count(*) AS n FROM documents GROUP BY lang),
sets AS (SELECT key, key NOT IN ('de', 'en') AS gen_data, (n % 3)::integer AS augment_num, CASE WHEN n % 2 = 0 THEN 0.5 ELSE 1.0 END::double AS proportion FROM src),
stages AS (SELECT (row_number() OVER (ORDER BY key) - 1)::integer AS stage, key FROM (SELECT key FROM src UNION ALL SELECT 'all')),
plan AS (
  SELECT stage, key, key AS base_set, augment_num, CASE WHEN gen_data THEN proportion ELSE 1.0 END::double AS share FROM stages JOIN sets USING (key)
  UNION ALL
  SELECT stage, 'all', sets.key, min(augment_num) OVER (), (row_number() OVER (ORDER BY sets.key) / 8.0)::double FROM sets, stages WHERE stages.key = 'all'),
pool AS (
  SELECT vec_id, label % 2 AS label, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('0:sample:' || vec_id), vec_id) AS r, count(*) OVER (PARTITION BY lang) AS n
  FROM embeddings JOIN documents ON doc_id = vec_id WHERE lang NOT IN ('de', 'en') OR vec_id % 5 >= 2),
counts AS (
  SELECT stage, key, base_set, label, augment_num, count(*) AS n FROM pool JOIN plan ON base_set = lang
  WHERE r <= round_even(pool.n * share, 0) GROUP BY ALL),
owned AS (SELECT *, sum(n) OVER (PARTITION BY stage, label) AS own FROM counts),
stage_sets AS (
  SELECT stage, key, base_set, label, n, round_even(augment_num * max(own) OVER (PARTITION BY stage) / own, 0)::bigint AS copies FROM owned)"""


def written(spark, d):
    """A schedule file from the languages of the documents."""
    src = table(spark, d, "documents").groupBy(F.col("lang").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    path = F.concat(F.lit("/data/"), "key")
    spec = F.struct(path.alias("path"), F.concat(F.lit("/split/"), "key").alias("split"), F.concat(F.lit("/seg/"), "key").alias("segment"),
                    (~F.col("key").isin(*REAL)).alias("gen_data"), (F.col("n") % 3).cast("int").alias("augment_num"),
                    F.when(F.col("n") % 2 == 0, F.lit(0.5)).alias("proportion"))
    keys = F.array_sort(F.collect_list("key"))
    mixed = F.struct(keys.alias("base_sets"), F.transform(keys, lambda k, i: (i + 1) / F.lit(8.0)).alias("proportion"))
    steps = F.transform(F.array_sort(F.concat(F.collect_list("key"), F.array(F.lit("all")))), lambda k: F.struct(k.alias("key"), F.lit(1).alias("epochs")))
    end = F.struct(F.lit("/data/en").alias("data"), F.lit("/split/en").alias("split"), F.lit("/seg/en").alias("segment"))
    out = scratch_path(spark, "schedule")
    src.agg(end.alias("test_set"), end.alias("valid_set"), F.map_from_entries(F.collect_list(F.struct("key", spec))).alias("datasets"),
            F.create_map(F.lit("all"), mixed).alias("combined_datasets"), steps.alias("schedule")).write.json(out)
    return S.read_schedule(spark, out)


def rows(spark, d):
    of = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    subset = F.when(F.col("lang").isin(*REAL), F.when(F.col("vec_id") % 5 == 0, "test").when(F.col("vec_id") % 5 == 1, "valid").otherwise("train"))
    return table(spark, d, "embeddings").join(of, "vec_id").select(
        "vec_id", F.concat(F.lit("/data/"), "lang").alias("path"), subset.alias("subset"), (F.col("label") % 2).alias("label"),
        F.expr("concat('p', vec_id div 4)").alias("patient"), A.as_doubles("embedding").alias("x"))


@query("M4", "J3", "J4", "U5", sql=f"WITH {SETS_SQL} SELECT stage, base_set, label, n, copies FROM stage_sets")
def schedule_stage_sets(spark, d):
    return P.stage_sets(P.tagged(rows(spark, d), P.stage_plan(written(spark, d)), "vec_id"))


def _run(spark, d, log, until=None):
    return P.run_schedule(written(spark, d), rows(spark, d), "vec_id", "vec_id", [64, 4, 2], log, noisy, M.TrainingArgs(step=1), until)


@query("M4", "J3", "J4", sql=f"""WITH {SETS_SQL}
    SELECT stage, key, 1 AS epochs, sum(n)::bigint AS n, sum(n * (1 + copies))::bigint AS drawn, CASE WHEN stage < 2 THEN 1 ELSE 2 END AS attempt
    FROM stage_sets GROUP BY stage, key""")
def schedule_stage_log(spark, d):
    """A run that ends before its third stage, and a second one that takes it up."""
    log = scratch_path(spark, "schedule-log")
    _run(spark, d, log, until=2)
    _run(spark, d, log)
    entries = P.read_log(spark, log)
    first = entries.where("stage = 0").select("attempt").scalar()
    return entries.select("stage", "key", "epochs", "n", "drawn", F.when(F.col("attempt") == first, 1).otherwise(2).alias("attempt"))


@query("M4", "M8")
def schedule_metrics(spark, d):
    record = _run(spark, d, scratch_path(spark, "schedule-log"))
    return flatten(record, [F.col("stages")]).withColumn("value", tidy(F.col("value"), 4))
