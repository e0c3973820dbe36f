"""Labels, folds and split tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.numeric import binary_label
from pulsegrid.operators import splits as S
from pulsegrid.queries import query, table
from pulsegrid.session import scratch_path
from pulsegrid.sources import tables as T

FOLDS = 3

FOLDS_SQL = """
rec AS (SELECT cast(doc_id AS varchar) AS record_id, 'p' || (doc_id // 4) AS patient,
               quality AS label FROM labels),
pat AS (SELECT patient, arg_min(label, record_id) AS label FROM rec GROUP BY patient),
ranked AS (SELECT patient, fold,
             row_number() OVER (PARTITION BY fold, label
                                ORDER BY md5('42:fold:' || fold || ':' || patient), patient) AS r,
             count(*) OVER (PARTITION BY fold, label) AS n
           FROM pat, range(1, 4) AS f(fold)),
folds AS (SELECT rec.record_id, rec.patient, rec.label, cast(fold AS integer) AS fold,
            CASE WHEN r <= round_even(n * 0.2, 0) THEN 'test'
                 WHEN r <= round_even(n * 0.2, 0) + round_even(n * 0.2, 0) THEN 'valid'
                 ELSE 'train' END AS subset
          FROM rec JOIN ranked USING (patient))
"""


def subjects(spark, d):
    return table(spark, d, "labels").select(
        F.col("doc_id").cast("string").alias("record_id"), F.col("quality").alias("label"))


def patient_of(record="record_id"):
    return F.expr(f"concat('p', cast(cast({record} AS bigint) div 4 AS string))")


def folds(spark, d):
    return S.stratified_folds(subjects(spark, d), FOLDS, patient=patient_of())


def _write_labels(spark, rows, name):
    path = scratch_path(spark, name)
    rows.write.csv(path)
    return path


@query("S2", sql="""SELECT cast(doc_id AS varchar) AS record_id,
    CASE WHEN quality = 1 THEN 1 ELSE -1 END AS label FROM labels""")
def label_list_scan(spark, d):
    rows = subjects(spark, d).select(
        F.concat(F.lit(" "), "record_id", F.lit(" ")),
        F.when(F.col("label") == 1, 1).otherwise(-1))
    return T.read_labels(spark, _write_labels(spark, rows, "labels"))


@query("S3", "T19", sql="""
    SELECT cast(d.doc_id AS varchar) AS record_id,
           coalesce(CASE WHEN l.quality = 1 THEN 1 WHEN l.quality = 0 THEN -1 END,
                    CASE WHEN d.n_chars > 1000 THEN 1 ELSE -1 END) AS label
    FROM documents d LEFT JOIN labels l USING (doc_id)""")
def label_union_last_wins(spark, d):
    first = table(spark, d, "documents").select(
        F.col("doc_id"), F.when(F.col("n_chars") > 1000, 1).otherwise(-1))
    second = subjects(spark, d).select(
        "record_id", F.when(F.col("label") == 1, 1).otherwise(-1))
    return T.union_labels([T.read_labels(spark, _write_labels(spark, first, "labels-a")),
                           T.read_labels(spark, _write_labels(spark, second, "labels-b"))])


@query("W3", "H2", "T14", "T23", sql=f"WITH {FOLDS_SQL} SELECT * FROM folds")
def stratified_folds(spark, d):
    return folds(spark, d)


@query("P10", "T23", sql=f"WITH {FOLDS_SQL} SELECT patient, label FROM pat")
def patient_labels(spark, d):
    return S.patient_labels(subjects(spark, d).withColumn("patient", patient_of()))


@query("S8", sql=f"""WITH {FOLDS_SQL}
    SELECT record_id AS patient, cast(label AS varchar) AS label,
           max(subset) FILTER (fold = 1) AS split, max(subset) FILTER (fold = 2) AS split2,
           max(subset) FILTER (fold = 3) AS split3
    FROM folds GROUP BY ALL""")
def split_table_sink(spark, d):
    path = T.write_splits(S.widen(folds(spark, d), FOLDS), scratch_path(spark, "splits"))
    return T.read_split(spark, path)


@query("S1", "P4", sql=f"""WITH {FOLDS_SQL}
    SELECT record_id AS patient, label FROM folds WHERE fold = 2 AND subset = 'train'""")
def split_scan(spark, d):
    path = T.write_splits(S.widen(folds(spark, d), FOLDS), scratch_path(spark, "splits"))
    return T.with_binary_label(T.read_split(spark, path, "train", 2)).select("patient", "label")


@query("S1", sql=f"""WITH {FOLDS_SQL} SELECT record_id AS patient, fold, subset FROM folds""")
def split_table_narrow(spark, d):
    path = T.write_splits(S.widen(folds(spark, d), FOLDS), scratch_path(spark, "splits"))
    return S.narrow(T.read_split(spark, path)).select("patient", "fold", "subset")


@query("P1", sql="SELECT doc_id, quality AS label FROM labels")
def resolved_label_column(spark, d):
    rows = table(spark, d, "labels").withColumnRenamed("quality", "diagnosis")
    return rows.select("doc_id", F.col(S.label_column(rows)).alias("label"))


@query("P2", "T4", sql="""SELECT vec_id, CASE WHEN label = 1 THEN 1 ELSE 0 END AS label
    FROM embeddings""")
def binary_labels(spark, d):
    return table(spark, d, "embeddings").select("vec_id", binary_label(F.col("label")).alias("label"))


@query("A11", sql=f"""WITH {FOLDS_SQL}
    SELECT coalesce(fold, 0)::integer AS fold, coalesce(subset, 'all') AS subset, count(*) AS n
    FROM folds GROUP BY ROLLUP (fold, subset)""")
def split_sizes(spark, d):
    return S.split_sizes(folds(spark, d))


@query("U8", sql=f"""WITH {FOLDS_SQL}
    SELECT fold, source, count(DISTINCT subset) AS n_subsets
    FROM folds JOIN documents ON doc_id = cast(record_id AS bigint)
    GROUP BY fold, source HAVING count(DISTINCT subset) > 1""")
def split_leakage(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("record_id"), "source")
    return S.leakage(folds(spark, d).join(docs, "record_id"), "source")


@query("J7", "U3", sql=f"""WITH {FOLDS_SQL},
    recs AS (SELECT record_id, source AS source_db, subset
             FROM folds JOIN documents ON doc_id = cast(record_id AS bigint) WHERE fold = 1),
    held AS (SELECT DISTINCT source_db AS holdout FROM recs)
    SELECT holdout, record_id, source_db,
           CASE WHEN source_db = holdout THEN 'test' ELSE subset END AS part
    FROM recs, held WHERE source_db = holdout OR subset IN ('train', 'valid')""")
def leave_one_source_out(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("record_id"), F.col("source").alias("source_db"))
    recs = S.subset_rows(folds(spark, d), "all", 1).join(docs, "record_id")
    return S.leave_one_source_out(recs).select("holdout", "record_id", "source_db", "part")


@query("J1", "S14", sql=f"""WITH {FOLDS_SQL}, docs AS (SELECT doc_id, lang FROM documents)
    SELECT lang AS grp, count(*) AS listed, count(*) - count(l.doc_id) AS missing
    FROM docs LEFT JOIN labels l USING (doc_id) GROUP BY lang""")
def load_report(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("grp"))
    return T.load_report(docs, table(spark, d, "labels"), "doc_id", "grp")


@query("J1", "P4", sql=f"""WITH {FOLDS_SQL}
    SELECT record_id, patient, subset, source, n_chars
    FROM folds JOIN documents ON doc_id = cast(record_id AS bigint)
    WHERE fold = 1 AND subset = 'train'""")
def split_records(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("record_id"), "source", "n_chars")
    return (S.subset_rows(folds(spark, d), "train", 1).join(docs, "record_id")
            .select("record_id", "patient", "subset", "source", "n_chars"))
