"""Fragment rows: channels, lengths, batches, crops, fades. Stand-in: embeddings, in pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.functions.numeric import tidy
from pulsegrid.operators import windows as W
from pulsegrid.queries import query, table

VEC_SQL = """v AS (SELECT vec_id, label, p.p AS idx, embedding[p.p + 1]::double AS x
    FROM embeddings, range(0, 64) AS p(p))"""
# Ragged signals: 40 to 64 samples.
RAG_SQL = VEC_SQL + ", r AS (SELECT * FROM v WHERE idx < 40 + vec_id % 25)"


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", A.as_doubles("embedding").alias("x"))


def ragged(spark, d):
    return vectors(spark, d).withColumn(
        "x", F.slice("x", F.lit(1), (40 + F.col("vec_id") % 25).cast("int")))


def channels(spark, d):
    part = lambda name, kind, at, n: F.struct(
        F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.slice("x", at, n).alias("samples"))
    return vectors(spark, d).select("vec_id", F.array(
        part("1", "pcg", 1, 32), part("2", "pcg", 10, 40), part("E", "ecg", 33, 28)).alias("channels"))


def long(df, *keys, col="x"):
    return df.select(*keys, F.posexplode_outer(col).alias("idx", "value")).withColumn(
        "value", tidy(F.col("value")))


@query("P5", sql=f"""WITH {VEC_SQL}
    SELECT vec_id, 0 AS pos, 'E' AS name, 'ecg' AS kind, 28 AS n, round(sum(x), 6) + 0.0 AS mass
    FROM v WHERE idx BETWEEN 32 AND 59 GROUP BY vec_id
    UNION ALL SELECT vec_id, 1, '1', 'pcg', 32, round(sum(x), 6) + 0.0 FROM v WHERE idx < 32 GROUP BY vec_id""")
def selected_channels(spark, d):
    rows = channels(spark, d).select("vec_id", F.posexplode_outer(
        A.select_channels(F.col("channels"), ["E", "7", "1"])).alias("pos", "c"))
    return rows.select("vec_id", "pos", "c.name", "c.kind", F.size("c.samples").alias("n"),
                       tidy(A.total(F.col("c.samples"))).alias("mass"))


@query("P6", "P7", sql="""SELECT vec_id, p.p::integer AS idx,
    round((embedding[p.p + 1]::double + embedding[p.p + 10]::double + embedding[p.p + 33]::double) / 3, 6) + 0.0 AS value
    FROM embeddings, range(0, 28) AS p(p)""")
def mixed_down_channels(spark, d):
    rows = channels(spark, d).withColumn(
        "c", A.align(F.transform("channels", lambda c: c["samples"])))
    return long(rows.withColumn("x", A.mix_down(F.col("c"))), "vec_id")


@query("P8", sql=f"""WITH {RAG_SQL}
    SELECT g.vec_id, p.p::integer AS idx, least(52, 40 + g.vec_id % 25)::integer AS valid_len,
           round(coalesce(r.x, 0.0), 6) + 0.0 AS value
    FROM embeddings g CROSS JOIN range(0, 52) AS p(p) LEFT JOIN r ON r.vec_id = g.vec_id AND r.idx = p.p""")
def fitted_lengths(spark, d):
    rows = ragged(spark, d).select("vec_id", W.valid_length(F.col("x"), 52).alias("valid_len"),
                                   W.fit_length(F.col("x"), 52).alias("x"))
    return long(rows, "vec_id", "valid_len")


@query("P9", sql=f"""WITH {RAG_SQL}, b AS (SELECT vec_id, vec_id // 16 AS batch,
        max(40 + vec_id % 25) OVER (PARTITION BY vec_id // 16) AS n FROM embeddings)
    SELECT batch, b.vec_id, p.p::integer AS idx, round(coalesce(x, 0.0), 6) + 0.0 AS value
    FROM b JOIN range(0, 64) AS p(p) ON p.p < n LEFT JOIN r ON r.vec_id = b.vec_id AND r.idx = p.p""")
def padded_batches(spark, d):
    rows = ragged(spark, d).withColumn("batch", F.expr("vec_id div 16"))
    return long(W.pad_batch(rows, "batch", "x"), "batch", "vec_id")


@query("U7", sql=f"""WITH {RAG_SQL}, cut AS (SELECT vec_id, n, CASE WHEN n <= 48 THEN 0 ELSE
        floor((('0x' || substr(md5('3:crop:' || vec_id), 1, 8))::BIGINT / 4294967296.0) * (n - 48 + 1)) END AS s
        FROM (SELECT vec_id, 40 + vec_id % 25 AS n FROM embeddings))
    SELECT r.vec_id, (idx - s)::integer AS idx, round(x, 6) + 0.0 AS value FROM r JOIN cut USING (vec_id)
    WHERE n <= 48 OR idx BETWEEN s AND s + 47""")
def random_crops(spark, d):
    return long(ragged(spark, d).withColumn(
        "x", W.random_crop(F.col("x"), 48, 3, "crop", F.col("vec_id"))), "vec_id")


@query("F14", sql=f"""WITH {RAG_SQL}, n AS (SELECT vec_id, count(*) AS n FROM r GROUP BY vec_id)
    SELECT r.vec_id, idx::integer AS idx, round(CASE WHEN n < 52 THEN x
        ELSE x * least(1.0, idx / 25.0, (n - 1 - idx) / 25.0) END, 6) + 0.0 AS value FROM r JOIN n USING (vec_id)""")
def faded(spark, d):
    return long(ragged(spark, d).withColumn("x", W.fade(F.col("x"), 26)), "vec_id")


@query("F15", sql=f"""WITH {RAG_SQL},
    w AS (SELECT vec_id, idx, x, cos(2 * pi() * 1000.0 * (idx / 4000.0) * (idx / 4000.0)
            / ((count(*) OVER (PARTITION BY vec_id) - 1) / 4000.0)) AS w FROM r),
    g AS (SELECT vec_id, greatest(0.5, max(abs(x))) / max(abs(w)) AS g FROM w GROUP BY vec_id)
    SELECT w.vec_id, idx::integer AS idx, round(x + g * w, 6) + 0.0 AS value FROM w JOIN g USING (vec_id)""")
def chirped(spark, d):
    return long(ragged(spark, d).withColumn("x", A.chirp(F.col("x"), 4000.0)), "vec_id")


@query("F2", sql=f"""WITH {RAG_SQL}, m AS (SELECT vec_id, min(x) AS a, max(x) AS b FROM r GROUP BY vec_id)
    SELECT vec_id, idx::integer AS idx, round((x - a) / (b - a) * 2 - 1, 6) + 0.0 AS value
    FROM r JOIN m USING (vec_id)""")
def fragment_min_max(spark, d):
    return long(ragged(spark, d).withColumn("x", A.min_max(F.col("x"))), "vec_id")


@query("F3", sql=f"""WITH {RAG_SQL}
    SELECT vec_id, idx::integer AS idx, round((x - avg(x) OVER (PARTITION BY vec_id))
        / (stddev_pop(x) OVER (PARTITION BY vec_id) + 1e-8), 6) + 0.0 AS value FROM r""")
def fragment_z_scores(spark, d):
    return long(ragged(spark, d).withColumn("x", A.z_score(F.col("x"))), "vec_id")


@query("F4", "K1", sql=f"""WITH {RAG_SQL},
    k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x) AS a,
                 row_number() OVER (PARTITION BY vec_id ORDER BY x DESC) AS b FROM r),
    e AS (SELECT *, avg(x) FILTER (a <= 5) OVER (PARTITION BY vec_id) AS lo, avg(x) FILTER (b <= 5) OVER (PARTITION BY vec_id) AS hi FROM k)
    SELECT vec_id, idx::integer AS idx, round(-1 + (x - lo) / (hi - lo) * 2, 6) + 0.0 AS value FROM e""")
def fragment_k_peak(spark, d):
    return long(ragged(spark, d).withColumn("x", A.k_peak(F.col("x"), 5)), "vec_id")


@query("W1", sql=f"""WITH {RAG_SQL},
    n AS (SELECT vec_id, 40 + vec_id % 25 AS n FROM embeddings),
    w AS (SELECT vec_id, n, k AS win_no, 3 + k * 12 AS start_idx FROM n, unnest(range(0, greatest(0, n - 16 - 3) // 12 + 1)) AS q(k))
    SELECT w.vec_id, win_no::integer AS win_no, p.p::integer AS idx, round(coalesce(x, 0.0), 6) + 0.0 AS value
    FROM w CROSS JOIN range(0, 16) AS p(p) LEFT JOIN r ON r.vec_id = w.vec_id AND r.idx = start_idx + p.p""")
def fragment_windows(spark, d):
    return long(W.array_windows(ragged(spark, d), "x", 3, 16, 12), "vec_id", "win_no", col="waveform")
