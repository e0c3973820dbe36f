"""Balance, copies, resampling, vocabularies, hash draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import keyed
from pulsegrid.functions.numeric import tidy
from pulsegrid.operators import balance as B
from pulsegrid.operators.joins import measured_join
from pulsegrid.operators.ranking import exact_median
from pulsegrid.queries import query, table
from pulsegrid.queries.splits import subjects
from pulsegrid.session import cut_lineage
from pulsegrid.sources import tables as T


def u_sql(key: str, slot: int = 0) -> str:
    """Uniform draw of a key expression, as SQL."""
    return f"(('0x' || substr(md5({key}), {1 + 8 * slot}, 8))::BIGINT / 4294967296.0)"


def gauss_sql(key: str) -> str:
    return f"(sqrt(-2.0 * ln(1.0 - {u_sql(key)})) * cos(2.0 * pi() * {u_sql(key, 1)}))"


COUNTS_SQL = """
rows AS (SELECT cast(doc_id AS varchar) AS record_id, quality AS label FROM labels),
counts AS (SELECT label, count(*) AS n, max(count(*)) OVER () AS max_n FROM rows GROUP BY label)
"""


@query("A1", "U4", sql=f"WITH {COUNTS_SQL} SELECT * FROM counts")
def class_counts(spark, d):
    return B.class_counts(subjects(spark, d))


@query("A2", "T1", sql=f"""WITH {COUNTS_SQL}
    SELECT label, n, round_even(15 * max_n / n, 0)::bigint AS copies FROM counts""")
def balanced_copy_counts(spark, d):
    return B.copy_counts(subjects(spark, d), 15)


@query("U1", "T13", "A2", sql=f"""WITH {COUNTS_SQL}
    SELECT record_id, label, c::integer AS copy_no,
           record_id || CASE WHEN c > 0 THEN '#aug' || c ELSE '' END AS patient
    FROM rows JOIN counts USING (label), range(0, round_even(3 * max_n / n, 0)::bigint + 1) AS r(c)""")
def augmented_rows(spark, d):
    return B.with_copies(subjects(spark, d), 3, "record_id").select(
        "record_id", "label", "copy_no", B.copy_patient("record_id").alias("patient"))


@query("T12", "A2", sql="""
    WITH rows AS (SELECT doc_id, lang AS label FROM documents),
    present AS (SELECT rows.* FROM rows SEMI JOIN labels USING (doc_id)),
    counts AS (SELECT label, count(*) AS n, max(count(*)) OVER () AS max_n FROM rows GROUP BY label)
    SELECT doc_id, label, c::integer AS copy_no
    FROM present JOIN counts USING (label), range(0, round_even(2 * max_n / n, 0)::bigint + 1) AS r(c)""")
def copies_balanced_by_listed_records(spark, d):
    listed = table(spark, d, "documents").select("doc_id", F.col("lang").alias("label"))
    present = listed.join(table(spark, d, "labels"), "doc_id", "left_semi")
    return B.with_copies(present, 2, "doc_id", counts_from=listed).select("doc_id", "label", "copy_no")


@query("G14", sql=f"""WITH {COUNTS_SQL}
    SELECT record_id, c::integer AS copy_no,
           round({u_sql("'9:cached:' || record_id || ':' || c")}, 6) + 0.0 AS draw
    FROM rows JOIN counts USING (label), range(0, round_even(2 * max_n / n, 0)::bigint + 1) AS r(c)""")
def cached_copies(spark, d):
    rows = B.with_copies(subjects(spark, d), 2, "record_id").select(
        "record_id", "copy_no",
        tidy(keyed.unit(9, "cached", F.col("record_id"), F.col("copy_no"))).alias("draw"))
    return cut_lineage(rows, "copies")


@query("U5", sql="""
    SELECT doc_id, source FROM documents
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('0:sample:' || doc_id), doc_id)
            <= round_even(count(*) OVER (PARTITION BY source) * 0.3, 0)""")
def proportion_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return T.proportion_sample(docs, ["source"], "doc_id", 0.3)


@query("U6", sql=f"""
    WITH ranked AS (SELECT doc_id, quality AS label, count(*) OVER (PARTITION BY quality) AS n,
        row_number() OVER (PARTITION BY quality ORDER BY md5('0:rank:' || doc_id), doc_id) AS r FROM labels),
    classes AS (SELECT label, any_value(n) AS n, row_number() OVER (ORDER BY label) - 1 AS i,
        count(*) OVER () AS k FROM ranked GROUP BY label),
    draws AS (SELECT doc_id AS draw_id, {u_sql("'0:class:' || doc_id")} AS uc,
        {u_sql("'0:row:' || doc_id")} AS ur FROM labels)
    SELECT draw_id, ranked.doc_id, ranked.label FROM draws
    JOIN classes ON i = floor(uc * k) JOIN ranked ON ranked.label = classes.label
     AND r = floor(ur * classes.n) + 1""")
def balanced_resample(spark, d):
    rows = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return B.balanced_resample(rows, "doc_id")


@query("U2", "U3", sql="""
    SELECT 'real' AS source, doc_id AS id, quality AS label FROM labels
    UNION ALL SELECT 'synthetic', vec_id, CASE WHEN label = 1 THEN 1 ELSE 0 END FROM embeddings""")
def real_and_synthetic(spark, d):
    real = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    made = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.when(F.col("label") == 1, 1).otherwise(0).alias("label"))
    return B.union_sources([("real", real), ("synthetic", made)])


@query("P3", "H4", sql="""
    SELECT vec_id, label AS idx, ['2N','2A','3N','3A','4N','4A','5N','5A','6N','6A'][label + 1] AS label,
           label AS again, true AS known FROM embeddings""")
def vocabulary_round_trip(spark, d):
    rows = table(spark, d, "embeddings").select(
        "vec_id", F.lit("cinc-channels").alias("vocab"), F.col("label").alias("idx"))
    decoded = B.decode_labels(rows).drop("known")
    return B.encode_labels(decoded, out="again").select("vec_id", "idx", "label", "again", "known")


@query("P3", sql="""
    SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'absent' ELSE 'multichannel-mixed' END AS vocab,
           cast(quality * 3 AS varchar) AS label,
           CASE WHEN doc_id % 3 <> 2 AND quality = 0 THEN 0 END AS idx,
           doc_id % 3 <> 2 AND quality = 0 AS known FROM labels""")
def unknown_vocabulary_labels(spark, d):
    rows = table(spark, d, "labels").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 2, "absent").otherwise("multichannel-mixed").alias("vocab"),
        (F.col("quality") * 3).cast("string").alias("label"))
    return B.encode_labels(rows)


@query("T21", sql=f"""
    SELECT event_id, round({u_sql("'1:42:' || event_id")}, 6) + 0.0 AS u,
           round({gauss_sql("'1:g:' || event_id")}, 6) + 0.0 AS g,
           floor({u_sql("'1:p:' || event_id")} * 7)::bigint AS k FROM events""")
def keyed_draws(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select(
        "event_id", tidy(keyed.unit(1, 42, e)).alias("u"), tidy(keyed.gaussian(1, "g", e)).alias("g"),
        keyed.pick(7, 1, "p", e).alias("k"))


@query("K5", sql="""SELECT (label // 4)::integer AS part, count(*) AS n, least(ceil(count(*) / 64.0), 3)::bigint AS batches,
    least(count(*), 64 * 3) AS used FROM embeddings GROUP BY ALL""")
def batch_limit(spark, d):
    """Of how many rows a training pass of at most three batches makes use, by part of the table: the limit is on
    the pass, the counts are over all rows."""
    batch, max_batches = 64, 3
    parts = table(spark, d, "embeddings").groupBy(F.floor(F.col("label") / 4).cast("int").alias("part"))
    return parts.agg(F.count(F.lit(1)).alias("n")).select(
        "part", "n", F.least(F.ceil(F.col("n") / batch), F.lit(max_batches)).cast("long").alias("batches"),
        F.least("n", F.lit(batch * max_batches)).alias("used"))


@query("J1", "W3", sql="""SELECT doc_id, source, n, most FROM documents
    JOIN (SELECT source, count(*) AS n, max(n_chars) AS most FROM documents GROUP BY source) USING (source)""")
def measured_source_join(spark, d):
    """A fifth of the documents and more are of one source: its rows go to as many tasks as their count asks for."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    per = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("most"))
    return measured_join(docs, per, ["source"], F.col("doc_id")).select("doc_id", "source", "n", "most")


@query("A12", sql="SELECT event_type, round(median(round(value, 1)), 6) + 0.0 AS median FROM events GROUP BY event_type")
def radix_medians(spark, d):
    """Few groups of very many values, most of them repeated."""
    rows = table(spark, d, "events").select("event_type", F.round("value", 1).alias("value"))
    return exact_median(rows, ["event_type"], "value").withColumn("median", tidy(F.col("median")))
