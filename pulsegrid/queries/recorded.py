"""From recordings and a split table to metrics. Stand-in: two-channel recordings of 32 samples, one per embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.numeric import tidy
from pulsegrid.operators.spectra import MelSpec
from pulsegrid.plans import experiment as E
from pulsegrid.plans import store as K
from pulsegrid.plans.augment_blocks import record_copies
from pulsegrid.plans.fragments import lacking, named_channels
from pulsegrid.plans.report import flatten
from pulsegrid.queries import query, table
from pulsegrid.queries.filters import CHAIN_BLOCK, RECORDED, _HOP, _SPEC, _START, _WIN
from pulsegrid.queries.ingest import wav_files
from pulsegrid.session import cut_lineage, scratch_path
from pulsegrid.sources import wav as W

MEL = MelSpec(1500, 16, 4, n_mels=6, f_max=500.0)
HOW = K.Extraction(1000, 1500, MEL, _SPEC, CHAIN_BLOCK)


def recordings(spark, d):
    """Blocks of recordings with named channels; every ninth recording has no microphone."""
    ids = F.regexp_extract("path", r"v(\d+)\.wav$", 1).cast("long")
    blocks = named_channels(W.decode(wav_files(spark, d), CHAIN_BLOCK).withColumn("record_id", ids), RECORDED)
    return blocks.where((F.col("record_id") % 9 != 0) | (F.col("channel") == "E"))


def splits(spark, d):
    subset = F.when(F.col("vec_id") % 5 == 0, "test").when(F.col("vec_id") % 5 == 1, "valid").otherwise("train")
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("record_id"), F.expr("concat('p', vec_id div 4)").alias("patient"), (F.col("label") % 2).alias("label"), subset.alias("subset"))


@query("M5", "S3", "G14", sql=f"""WITH r AS (
        SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN 1 ELSE 2 END AS channels,
            list_transform(embedding[:CASE WHEN vec_id % 9 = 0 THEN 32 ELSE 64 END], lambda x: round(greatest(-1.0, least(1.0, x)) * 32767)) AS v FROM embeddings),
    c AS (SELECT v, min(vec_id % 7 = 0) AS late, any_value(channels) AS channels FROM r GROUP BY v),
    runs AS (SELECT * FROM (VALUES (1, false), (2, NULL), (3, true)) AS t(run, late))
    SELECT run, count(c.v) AS extracted, coalesce(sum(c.channels), 0)::bigint * (greatest(0, 48 - {_WIN} - {_START}) // {_HOP} + 1) AS windows
    FROM runs LEFT JOIN c ON c.late = runs.late GROUP BY run""")
def extraction_runs(spark, d):
    """New recordings per run: six of seven, the same ones again, and then all."""
    store, blocks, out = scratch_path(spark, "features"), recordings(spark, d), None
    for run, part in enumerate((blocks.where("record_id % 7 <> 0"), blocks.where("record_id % 7 <> 0"), blocks), 1):
        features, fresh = K.stored_features(part, HOW, store)
        every = features.join(fresh.withColumnRenamed("record_id", "of"), "content").where("record_id = of")
        row = fresh.agg(F.lit(run).alias("run"), F.count(F.lit(1)).alias("extracted")).join(every.agg(F.count(F.lit(1)).alias("windows")))
        # Written at once: one plan must not hold the store's files of two moments, which Spark takes for the same scan.
        row = cut_lineage(row, "extraction-run")
        out = row if out is None else out.unionByName(row)
    return out


@query("P6", "S3", sql="""SELECT vec_id AS record_id, '1' AS missing FROM embeddings WHERE vec_id % 9 = 0""")
def lacking_channels(spark, d):
    return lacking(recordings(spark, d), ["1", "E"]).select("record_id", F.explode("missing").alias("missing"))


@query("M5", "P6", "W1", sql=f"""SELECT CASE WHEN vec_id % 5 = 0 THEN 'test' WHEN vec_id % 5 = 1 THEN 'valid' ELSE 'train' END AS subset, label % 2 AS label,
    CASE WHEN vec_id % 9 = 0 THEN 1 ELSE 2 END AS channels, count(*) * (greatest(0, 48 - {_WIN} - {_START}) // {_HOP} + 1) AS n
    FROM embeddings GROUP BY ALL""")
def experiment_fragments(spark, d):
    rows = K.experiment_rows(recordings(spark, d), splits(spark, d), HOW, scratch_path(spark, "features"), ["1", "E"])
    return rows.groupBy("subset", "label", F.size("present").alias("channels")).agg(F.count(F.lit(1)).alias("n"))


@query("M5", "M7", "S9")
def recording_experiment(spark, d):
    """Recordings and a split table in, metrics out; the second experiment reads what the first has extracted."""
    store, small = scratch_path(spark, "features"), E.Regime(epochs=1, augment=False)
    rows = lambda: K.experiment_rows(recordings(spark, d), splits(spark, d), HOW, store, ["1", "E"])
    fold = flatten(E.run_fold(rows(), [24, 4, 2], small, "row_id"), [F.lit("fold").alias("experiment")])
    multi = flatten(E.run_multichannel(rows(), [24, 4, 2], small, "row_id", 12), [F.lit("multichannel").alias("experiment")])
    return fold.unionByName(multi).withColumn("value", tidy(F.col("value"), 4))


@query("U1", "A1", sql="""WITH s AS (SELECT vec_id, label % 2 AS label FROM embeddings WHERE vec_id % 5 > 1),
    n AS (SELECT label, count(*) AS n, max(count(*)) OVER () AS most FROM s GROUP BY label)
    SELECT vec_id AS record_id, c.c AS copy_no, CASE WHEN vec_id % 9 = 0 THEN 1 ELSE 2 END::bigint AS channels
    FROM s JOIN n USING (label), range(1, 9) AS c(c) WHERE c.c <= round_even(3 * most / n, 0)""")
def recording_copies(spark, d):
    """Copies of whole recordings, balanced by record."""
    copies = record_copies(recordings(spark, d), splits(spark, d), 3)
    return copies.groupBy("record_id", F.col("copy_no").cast("long").alias("copy_no")).agg(F.count_distinct("channel").alias("channels"))
