"""Metrics, votes, result logs and reports. Predictions stand-in: order lines of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.numeric import tidy
from pulsegrid.operators import metrics as M
from pulsegrid.plans import report as R
from pulsegrid.queries import query, table
from pulsegrid.session import scratch_path

PRED_SQL = """
pred AS (SELECT l_linestatus AS condition, l_orderkey AS patient,
           l_linenumber * 100000000000000 + l_partkey * 1000000 + l_suppkey AS fragment_id,
           CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
           l_quantity AS z0, round(l_discount * 500) AS z1,
           CASE WHEN round(l_discount * 500) > l_quantity THEN 1 ELSE 0 END AS y_pred
         FROM lineitem),
votes AS (SELECT condition, patient, arg_max(y_true, fragment_id) AS y_true,
            CASE WHEN avg(z1) > avg(z0) THEN 1 ELSE 0 END AS y_pred
          FROM pred GROUP BY condition, patient)
"""

COUNTS_SQL = """count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp,
    count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn,
    count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
    count(*) FILTER (NOT (y_true = 1 AND y_pred = 1) AND y_true <> 0) AS fn"""


def metrics_sql(keys: str, counts: str, places: int | None = 6) -> str:
    r = (lambda e: f"round({e}, {places}) + 0.0") if places else (lambda e: e)
    d = lambda a, b: f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a})::double / ({b}) END)"
    sens, spec, prec, npv = d("tp", "tp + fn"), d("tn", "tn + fp"), d("tp", "tp + fp"), d("tn", "tn + fn")
    root = "sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn))"
    cells = {"accuracy": d("tp + tn", "tp + tn + fp + fn"), "uar": f"0.5 * ({sens} + {spec})",
             "sensitivity": sens, "specificity": spec, "npv": npv, "precision": prec,
             "f1": d(f"2 * {prec} * {sens}", f"{prec} + {sens}"),
             "mcc": d("tp::double * tn - fp::double * fn", root)}
    return (f"SELECT {keys}, " + ", ".join(f"{r(e)} AS {n}" for n, e in cells.items())
            + f" FROM ({counts})")


def predictions(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("condition"), F.col("l_orderkey").alias("patient"),
        (F.col("l_linenumber").cast("long") * 100000000000000 + F.col("l_partkey") * 1000000
         + F.col("l_suppkey")).alias("fragment_id"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y_true"),
        F.array("l_quantity", F.round(F.col("l_discount") * 500)).alias("logits"))


def single(spark, d):
    return predictions(spark, d).withColumn("y_pred", M.argmax(F.col("logits")))


def tidied(df, keys):
    return df.select(*keys, *[tidy(F.col(c)).alias(c) for c in M.METRICS])


@query("A3", sql=f"WITH {PRED_SQL} SELECT condition, {COUNTS_SQL} FROM pred GROUP BY condition")
def confusion_counts(spark, d):
    return M.confusion(single(spark, d), ["condition"])


@query("A3", "A4", sql=metrics_sql("lang", f"""
    SELECT lang, {COUNTS_SQL} FROM (SELECT lang, quality AS y_true, 1 - toxic AS y_pred
    FROM labels JOIN documents USING (doc_id)) GROUP BY lang"""))
def label_metrics(spark, d):
    rows = table(spark, d, "labels").join(
        table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    pairs = rows.select("lang", F.col("quality").alias("y_true"),
                        (1 - F.col("toxic")).alias("y_pred"))
    return tidied(M.metrics(M.confusion(pairs, ["lang"]), ["lang"]), ["lang"])


@query("A4", sql=f"""WITH {PRED_SQL}, c AS (SELECT condition, {COUNTS_SQL} FROM pred GROUP BY condition),
    m AS ({metrics_sql("condition", "FROM c", None)})
    SELECT condition, printf('acc=%.4f uar=%.4f sens=%.4f spec=%.4f mcc=%.4f',
      accuracy, uar, sensitivity, specificity, mcc) AS line FROM m""")
def metric_lines(spark, d):
    m = M.metrics(M.confusion(single(spark, d), ["condition"]), ["condition"])
    return m.select("condition", M.metric_line().alias("line"))


@query("A6", "T11", sql=f"WITH {PRED_SQL} SELECT condition, patient, y_true, y_pred FROM votes")
def patient_votes(spark, d):
    return M.patient_votes(predictions(spark, d), ["condition", "patient"], 2)


LEVELS_SQL = f"""
    SELECT condition, 'fragment' AS level, {COUNTS_SQL} FROM pred GROUP BY condition
    UNION ALL
    SELECT condition, 'patient' AS level, {COUNTS_SQL} FROM votes GROUP BY condition"""


@query("A5", sql=f"WITH {PRED_SQL} " + metrics_sql("condition, level", LEVELS_SQL))
def grouped_metrics(spark, d):
    return tidied(M.grouped_metrics(predictions(spark, d), ["condition"]), ["condition", "level"])


LOG_SQL = """
epochs AS (SELECT l_returnflag AS run, l_linestatus AS stage,
             cast(month(l_shipdate) AS integer) AS epoch,
             round(sum(l_quantity) / count(*), 1) AS mcc, avg(l_quantity) AS loss, count(*) AS n
           FROM lineitem GROUP BY ALL)
"""


def training_log(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("run"), F.col("l_linestatus").alias("stage"),
        F.month("l_shipdate").alias("epoch"), F.col("l_quantity").alias("loss"))
    return M.epoch_means(rows, ["run", "stage", "epoch"], ["loss"])


@query("A14", sql=f"""WITH {LOG_SQL}
    SELECT run, stage, epoch, round(loss, 6) + 0.0 AS loss, n FROM epochs""")
def epoch_log_means(spark, d):
    return training_log(spark, d).withColumn("loss", tidy(F.col("loss")))


@query("K2", "T17", sql=f"""WITH {LOG_SQL}
    SELECT run, stage, epoch, mcc, n FROM epochs
    QUALIFY row_number() OVER (PARTITION BY run, stage ORDER BY mcc DESC, epoch) = 1""")
def best_epochs(spark, d):
    log = training_log(spark, d).select(
        "run", "stage", "epoch", F.round("loss", 1).alias("mcc"), "n")
    return M.best_rows(log, ["run", "stage"])


def records(spark, d):
    """One nested result record per condition and fold (ship month), as the runners log them."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("run_label"), F.month("l_shipdate").alias("fold"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y_true"),
        F.when(F.round(F.col("l_discount") * 500) > F.col("l_quantity"), 1).otherwise(0).alias("y_pred"),
        F.when(F.col("l_tax") * 500 > F.col("l_quantity"), 1).otherwise(0).alias("y_other"))
    keys = ["run_label", "fold"]
    a = M.metrics(M.confusion(rows, keys), keys)
    b = M.metrics(M.confusion(rows, keys, pred="y_other"), keys)
    nest = lambda df, name: df.select(*keys, F.struct(*M.METRICS).alias(name))
    return nest(a, "fragment").join(nest(b, "patient"), keys)


RECORDS_SQL = f"""
rows AS (SELECT l_linestatus AS run_label, month(l_shipdate) AS fold,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
    CASE WHEN round(l_discount * 500) > l_quantity THEN 1 ELSE 0 END AS pa,
    CASE WHEN l_tax * 500 > l_quantity THEN 1 ELSE 0 END AS pb FROM lineitem),
wide AS (
    {metrics_sql("run_label, fold, 'fragment' AS part", f'''SELECT run_label, fold, {COUNTS_SQL}
        FROM (SELECT *, pa AS y_pred FROM rows) GROUP BY ALL''', None)}
    UNION ALL
    {metrics_sql("run_label, fold, 'patient' AS part", f'''SELECT run_label, fold, {COUNTS_SQL}
        FROM (SELECT *, pb AS y_pred FROM rows) GROUP BY ALL''', None)}),
leaves AS (SELECT 'run_label=' || run_label AS condition, cast(fold AS integer) AS fold,
    part || '.' || m AS path, value
    FROM (UNPIVOT wide ON accuracy, uar, sensitivity, specificity, npv, precision, f1, mcc
          INTO NAME m VALUE value)),
cells AS (SELECT condition, path, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n
    FROM leaves GROUP BY ALL)
"""


def logged(spark, d):
    return R.load_results(spark, R.append_results(records(spark, d), scratch_path(spark, "results")))


@query("S9", "S10", "A7", "A8", "T18", sql=f"""WITH {RECORDS_SQL}
    SELECT condition, fold, path, round(value, 6) + 0.0 AS value FROM leaves""")
def flat_metrics(spark, d):
    recs = logged(spark, d)
    leaves = R.flatten(recs, [R.group_label(recs.schema, ["run_label", "absent", "fragment"])
                              .alias("condition"), F.col("fold").cast("int").alias("fold")])
    return leaves.withColumn("value", tidy(F.col("value")))


@query("A9", "T2", sql=f"""WITH {RECORDS_SQL}
    SELECT condition, path, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, n,
           max(n) OVER (PARTITION BY condition) AS group_n FROM cells""")
def condition_summary(spark, d):
    s = R.summarize(records(spark, d), ["run_label"])
    return s.withColumn("mean", tidy(F.col("mean"))).withColumn("std", tidy(F.col("std")))


@query("S9", "X3", "A9", sql=f"""WITH {RECORDS_SQL}
    SELECT condition, path, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, n,
           max(n) OVER (PARTITION BY condition) AS group_n FROM cells""")
def committed_condition_summary(spark, d):
    """The same summary from moments of three runs, one of which is stored twice."""
    recs, log = records(spark, d), scratch_path(spark, "result-log")
    for part in (0, 1, 1, 2):
        R.commit_results(recs.where(F.pmod(F.xxhash64(F.to_json(F.struct("*"))), F.lit(3)) == part), log, R.run_key(spark, "summary", part), ["run_label"])
    s = R.committed_summary(spark, log)
    return s.withColumn("mean", tidy(F.col("mean"))).withColumn("std", tidy(F.col("std")))


@query("A9", sql="""
    SELECT 'flag=' || l_returnflag || ', status=' || l_linestatus AS condition, path,
           round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS std,
           count(*) AS n, count(*) AS group_n
    FROM (UNPIVOT (SELECT l_returnflag, l_linestatus, l_discount AS accuracy, l_tax AS mcc FROM lineitem)
          ON accuracy, mcc INTO NAME path VALUE value) GROUP BY ALL""")
def line_condition_summary(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.col("l_discount").alias("accuracy"), F.col("l_tax").alias("mcc"))
    s = R.summarize(rows, ["flag", "status"])
    return s.withColumn("mean", tidy(F.col("mean"))).withColumn("std", tidy(F.col("std")))


@query("S13", "K4", sql=f"""WITH {RECORDS_SQL},
    body AS (SELECT condition, max(n) AS n, string_agg(printf('%.4f±%.4f', mean, std), ' | ' ORDER BY path)
             FILTER (path LIKE '%.mcc' OR path LIKE '%.uar') AS line FROM cells GROUP BY condition)
    SELECT 1::bigint AS line_no, '| condition | n | fragment.mcc | fragment.uar | patient.mcc | patient.uar |' AS line
    UNION ALL SELECT 2, '|---|---|---|---|---|---|'
    UNION ALL SELECT 2 + row_number() OVER (ORDER BY condition),
                     '| ' || condition || ' | ' || n || ' | ' || line || ' |' FROM body""")
def markdown_report(spark, d):
    recs = records(spark, d)
    return R.markdown(R.summarize(recs), R.metric_paths(recs.schema), ["mcc", "uar"])
