"""Recording files, headers, manifests. Files are made by Spark from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.functions.numeric import tidy
from pulsegrid.operators.windows import array_windows
from pulsegrid.queries import query, table
from pulsegrid.queries.fragments import VEC_SQL, vectors
from pulsegrid.session import scratch_path
from pulsegrid.sources import tables as T
from pulsegrid.sources import wav as W


def _le(value, size: int):
    """Little-endian hex of an integer column."""
    big = F.lpad(F.hex(F.pmod(value.cast("long"), F.lit(256 ** size))), 2 * size, "0")
    return F.concat(*[F.substring(big, 2 * (size - i) - 1, 2) for i in range(size)])


def wav_files(spark, d):
    """Each embedding as a two-channel 16-bit recording of 32 samples."""
    lit = lambda v, n: _le(F.lit(v), n)
    text = lambda s: F.lit(s.encode().hex())
    head = F.concat(text("RIFF"), lit(36 + 128, 4), text("WAVEfmt "), lit(16, 4), lit(1, 2), lit(2, 2),
                    lit(4125, 4), lit(4125 * 4, 4), lit(4, 2), lit(16, 2), text("data"), lit(128, 4))
    pcm = lambda x: _le(F.round(A.clip(x) * 32767), 2)
    body = A.bind(F.col("x"), lambda x: F.array_join(F.transform(
        F.sequence(F.lit(0), F.lit(31)), lambda t: F.concat(pcm(F.get(x, t)), pcm(F.get(x, t + 32)))), ""))
    return vectors(spark, d).select(
        F.concat(F.lit("/rec/v"), F.col("vec_id").cast("string"), F.lit(".wav")).alias("path"),
        F.unhex(F.concat(head, body)).alias("content"))


@query("S4", sql=f"""WITH {VEC_SQL}
    SELECT '/rec/v' || vec_id || '.wav' AS path, 4125 AS fs, (idx // 32)::integer AS channel, (idx % 32)::bigint AS idx,
        round(round(greatest(-1.0, least(1.0, x)) * 32767) / 32767, 6) + 0.0 AS value FROM v""")
def decoded_wavs(spark, d):
    b = W.decode(wav_files(spark, d), 20)
    return b.select("path", "fs", "channel", "block", F.posexplode_outer("values").alias("p", "v")).select(
        "path", "fs", "channel", (F.col("block") * 20 + F.col("p")).alias("idx"), tidy(F.col("v")).alias("value"))


@query("S5", sql="""SELECT 'r' || doc_id AS record_id, 2 AS n_channels, 2000.0::double AS fs, n_chars AS n_samples,
    'PCG+' || upper(lang) AS names FROM documents""")
def header_catalogue(spark, d):
    docs = table(spark, d, "documents").select(
        F.concat(F.lit("/rec/r"), F.col("doc_id").cast("string"), F.lit(".hea")).alias("path"),
        F.format_string("r%d 2 2000 %d\nr%d.wav 16 1000/mV 16 0 5 12 0 PCG\nr%d.wav 16 1000/mV 16 0 5 12 0 %s\n# <age>: 40\n",
                        "doc_id", "n_chars", "doc_id", "doc_id", F.upper("lang")).alias("value"))
    out = W.parse_headers(docs)
    return out.withColumn("names", F.array_join("channels", "+")).drop("channels")


@query("S6", sql="""SELECT 'p' || (vec_id % 50) AS patient, CASE WHEN label = 1 THEN 1 ELSE 0 END AS label,
    'v' || vec_id || '.wav' AS file FROM embeddings SEMI JOIN labels ON doc_id = vec_id""")
def manifest_scan(spark, d):
    rows = table(spark, d, "embeddings").select(
        F.concat(F.lit("p"), (F.col("vec_id") % 50).cast("string")).alias("patient"), "label",
        F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit(".wav")).alias("file"))
    path = scratch_path(spark, "manifest")
    rows.write.option("header", True).csv(path)
    listing = table(spark, d, "labels").select(
        F.concat(F.lit("v"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("file"))
    return T.read_manifest(spark, path, listing)


@query("S7", "U2", sql="""SELECT 'p' || vec_id AS patient, label, 'p' || vec_id || '_' || (vec_id % 7) || '_' || c AS file,
    64 AS n FROM embeddings, range(0, 2) AS r(c)""")
def synthetic_set_sink(spark, d):
    rows = vectors(spark, d).select(
        F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("patient"), (F.col("vec_id") % 7).alias("idx"),
        F.explode(F.sequence(F.lit(0), F.lit(1))).alias("copy_no"), "label", F.col("x").alias("waveform"))
    path = T.write_waveforms(rows, scratch_path(spark, "synthetic"))
    waves = spark.read.parquet(f"{path}/waveforms").select("file", F.size("waveform").alias("n"))
    manifest = spark.read.schema("patient STRING, label INT, file STRING").option("header", True).csv(f"{path}/manifest")
    return manifest.join(waves, "file").select("patient", "label", "file", "n")


@query("S6", "U5", sql="""SELECT vec_id, label FROM embeddings
    QUALIFY row_number() OVER (ORDER BY md5('0:sample:' || vec_id), vec_id) <= round_even(count(*) OVER () * 0.5, 0)""")
def synthetic_proportion(spark, d):
    return T.proportion_sample(vectors(spark, d).select("vec_id", "label"), [], "vec_id", 0.5)


@query("J2", "T15", sql="""SELECT cast(doc_id AS varchar) AS patient, url AS file FROM labels JOIN pages
    ON contains(url, cast(doc_id AS varchar))""")
def patient_files(spark, d):
    patients = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("patient"))
    return W.match_files(patients, table(spark, d, "pages").select(F.col("url").alias("file")))


@query("J2", "T15", sql="""SELECT url AS file, count(*) AS patients, min(cast(doc_id AS varchar)) AS first_patient
    FROM labels JOIN pages ON contains(url, cast(doc_id AS varchar)) GROUP BY url HAVING count(*) > 1""")
def ambiguous_files(spark, d):
    return W.ambiguous_files(patient_files(spark, d))


@query("S7", "W1", sql="""SELECT vec_id, count(*) AS windows FROM embeddings, range(0, 4) AS r(k)
    WHERE k <= (64 - 16 - 3) // 12 GROUP BY vec_id""")
def stored_windows(spark, d):
    path = scratch_path(spark, "windows")
    array_windows(vectors(spark, d), "x", 3, 16, 12).select("vec_id", "win_no", "waveform").write.parquet(path)
    return spark.read.parquet(path).groupBy("vec_id").agg(F.count(F.lit(1)).alias("windows"))
