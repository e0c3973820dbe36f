"""Schedules. Stand-in: one written from the sources and languages of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.queries import query, table
from pulsegrid.session import scratch_path
from pulsegrid.sources import schedule as S

# Per source: number of documents n, and of English ones e.
SRC_SQL = """
src AS (SELECT source AS key, count(*) AS n, count(*) FILTER (lang = 'en') AS e, '/data/' || source AS path,
          CASE WHEN n_en > 0 THEN true END AS x FROM (SELECT *, 1 AS n_en FROM documents) GROUP BY ALL),
sets AS (SELECT key, path, '/split/' || key || '.csv' AS split, '/seg/' || key AS segment, e % 2 = 1 AS gen_data,
          (e - n // 3)::integer AS augment_num, CASE WHEN e % 3 > 0 THEN round(e::double / (n // 2), 6) ELSE 1.0 END AS proportion
         FROM src),
mix AS (SELECT DISTINCT lang AS key, source AS base_set FROM documents),
comb AS (SELECT key, base_set, row_number() OVER (PARTITION BY key ORDER BY base_set) - 1 AS pos FROM mix),
combined AS (SELECT key, pos::integer AS pos, base_set, (pos + 1) / 20.0::double AS proportion,
          min(s.augment_num) OVER (PARTITION BY comb.key)::integer AS augment_num, s.path, s.split, s.segment, s.gen_data
          FROM (SELECT key AS base_set, augment_num, path, split, segment, gen_data FROM sets) s JOIN comb USING (base_set)),
held AS (SELECT 'test_set' AS part, min(source) AS s FROM documents UNION ALL SELECT 'valid_set', max(source) FROM documents),
names AS (SELECT key, n FROM src UNION ALL SELECT DISTINCT lang, 7 FROM documents UNION ALL SELECT 'src' || max(n_chars), 3 FROM documents),
stages AS (SELECT (row_number() OVER (ORDER BY key) - 1)::integer AS stage, key, (1 + n % 5)::integer AS epochs, n % 2 = 0 AS letskip FROM names)
"""


def written(spark, d):
    """Schedule JSON derived from the documents: a small config with one entry per source."""
    docs = table(spark, d, "documents")
    src = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "en").alias("e"))
    spec = F.struct(
        F.concat(F.lit("/data/"), "source").alias("path"),
        F.concat(F.lit("/split/"), "source", F.lit(".csv")).alias("split"),
        F.concat(F.lit("/seg/"), "source").alias("segment"), (F.col("e") % 2 == 1).alias("gen_data"),
        F.expr("cast(e - n div 3 AS int)").alias("augment_num"),
        F.when(F.col("e") % 3 > 0, F.round(F.col("e") / F.expr("n div 2"), 6)).alias("proportion"))
    sets = src.agg(F.map_from_entries(F.collect_list(F.struct("source", spec))).alias("m"))
    mixed = docs.groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("base_sets"))
    parts = mixed.agg(F.map_from_entries(F.collect_list(F.struct("lang", F.struct(
        "base_sets", F.transform("base_sets", lambda b, i: (i + 1) / F.lit(20.0)).alias("proportion"))))).alias("m"))
    names = (src.select(F.col("source").alias("key"), "n")
             .unionByName(mixed.select(F.col("lang").alias("key"), F.lit(7).cast("long").alias("n")))
             .unionByName(docs.agg(F.max("n_chars").alias("c")).select(
                 F.concat(F.lit("src"), F.col("c").cast("string")).alias("key"), F.lit(3).cast("long").alias("n"))))
    steps = names.agg(F.array_sort(F.collect_list(F.struct(
        "key", (1 + F.col("n") % 5).cast("int").alias("epochs"), (F.col("n") % 2 == 0).alias("letskip")))).alias("s"))
    # The first source by name is held out for the test, the last for validation.
    held = lambda pick: src.agg(F.struct(*[F.concat(F.lit(a), pick("source"), F.lit(b)).alias(c) for a, b, c in (
        ("/data/", "", "data"), ("/split/", ".csv", "split"), ("/seg/", "", "segment"))])).scalar()
    one = spark.range(1).select(
        held(F.min).alias("test_set"), held(F.max).alias("valid_set"), sets.scalar().alias("datasets"),
        parts.scalar().alias("combined_datasets"), steps.scalar().alias("schedule"))
    path = scratch_path(spark, "schedule")
    one.write.json(path)
    return S.read_schedule(spark, path)


@query("S11", sql=f"""WITH {SRC_SQL}
    SELECT key, path, split, segment, gen_data, augment_num, proportion FROM sets""")
def schedule_datasets(spark, d):
    return S.datasets(written(spark, d)).drop("file")


@query("S11", sql=f"""WITH {SRC_SQL}, p AS (SELECT key, path AS data, split, segment FROM sets
    UNION ALL SELECT part, '/data/' || s, '/split/' || s || '.csv', '/seg/' || s FROM held)
    SELECT key, kind, path FROM (UNPIVOT p ON data, split, segment INTO NAME kind VALUE path)""")
def schedule_paths(spark, d):
    return S.paths(written(spark, d)).drop("file")


@query("J4", "T16", sql=f"""WITH {SRC_SQL}
    SELECT key, pos, base_set, proportion, augment_num FROM combined""")
def combined_datasets(spark, d):
    return S.combined(written(spark, d)).select("key", "pos", "base_set", "proportion", "augment_num")


@query("J3", sql=f"""WITH {SRC_SQL}, every AS (SELECT key, key AS base_set, path, augment_num, proportion FROM sets
    UNION ALL SELECT key, base_set, path, augment_num, proportion FROM combined)
    SELECT stage, key, epochs, letskip, base_set, path, augment_num, proportion FROM stages JOIN every USING (key)""")
def resolved_stages(spark, d):
    return S.resolved_stages(written(spark, d)).select(
        "stage", "key", "epochs", "letskip", "base_set", "path", "augment_num", "proportion")


@query("J5", sql=f"""WITH {SRC_SQL}
    SELECT key, 'augment_num must not be negative' AS problem FROM sets WHERE augment_num < 0
    UNION ALL SELECT key, 'proportion must be in [0, 1]' FROM sets WHERE proportion < 0 OR proportion > 1
    UNION ALL SELECT DISTINCT key, 'proportion must be in [0, 1]' FROM combined WHERE proportion > 1
    UNION ALL SELECT key, 'unknown dataset in a stage' FROM stages
      WHERE key NOT IN (SELECT key FROM sets) AND key NOT IN (SELECT key FROM combined)""")
def schedule_violations(spark, d):
    return S.violations(written(spark, d)).drop("file")


@query("S11", "T16", sql=f"""WITH {SRC_SQL} SELECT 'letskip' AS field, count(*) AS n FROM stages""")
def schedule_unused_fields(spark, d):
    return S.unused_fields(written(spark, d)).drop("file")


@query("S11", sql=f"""WITH {SRC_SQL} SELECT part, '/data/' || s AS data, '/split/' || s || '.csv' AS split,
    '/seg/' || s AS segment, 0::integer AS augment_num FROM held""")
def schedule_eval_sets(spark, d):
    return S.eval_sets(written(spark, d)).drop("file")
