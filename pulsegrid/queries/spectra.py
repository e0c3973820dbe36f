"""Spectral features of fragments. Stand-in: embeddings as 64-sample fragments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.functions.numeric import tidy
from pulsegrid.operators import spectra as S
from pulsegrid.queries import query
from pulsegrid.queries.filters import num, values_sql
from pulsegrid.queries.fragments import VEC_SQL, long, vectors
from pulsegrid.queries.sampling import u_sql

SPEC = S.MelSpec(fs=1000, n_fft=16, hop=4, n_mels=4, f_min=0.125, f_max=500.0)
_FULL = np.ones(16)


def mags_sql(window) -> str:
    """Magnitudes of the centred frames as relation ``mags(vec_id, frame, bin, mag)``."""
    return f"""{VEC_SQL}, {values_sql('win', window)},
    fr AS (SELECT v.vec_id, f.f AS frame, k AS j, h * x AS y FROM range(0, 17) AS f(f), win
        JOIN v ON v.idx = CASE WHEN f.f * 4 + k - 8 < 0 THEN 8 - f.f * 4 - k
                               WHEN f.f * 4 + k - 8 > 63 THEN 126 - (f.f * 4 + k - 8) ELSE f.f * 4 + k - 8 END),
    mags AS (SELECT vec_id, frame, b.b AS bin, sqrt(sum(y * cos(2 * pi() * b.b * j / 16)) ** 2
                + sum(y * sin(2 * pi() * b.b * j / 16)) ** 2) AS mag
        FROM fr, range(0, 9) AS b(b) GROUP BY ALL)"""


_BANK = ", ".join(f"({b}, {m}, {num(SPEC.filterbank()[b, m])})" for b in range(9) for m in range(4))


@query("F13", sql=f"""WITH {mags_sql(SPEC.window())}, bank(bin, mel, w) AS (VALUES {_BANK}),
    m AS (SELECT vec_id, frame, mel, sum(mag * w) AS y FROM mags JOIN bank USING (bin) GROUP BY ALL)
    SELECT vec_id, frame::integer AS frame, mel::integer AS mel,
        round(greatest(0.0, least(1.0, (20 * log10(greatest(y, 1e-5)) - 20 + 100) / 100)), 6) + 0.0 AS value
    FROM m WHERE frame < 16""")
def log_mel_features(spark, d):
    rows = vectors(spark, d).select("vec_id", S.log_mel(F.col("x"), SPEC, 16).alias("m"))
    frames = rows.select("vec_id", F.posexplode_outer("m").alias("frame", "row"))
    return frames.select("vec_id", "frame", F.posexplode_outer("row").alias("mel", "value")).withColumn(
        "value", tidy(F.col("value")))


@query("F12", sql=f"""WITH {VEC_SQL},
    f AS (SELECT vec_id, k.k AS k, sum(x * cos(2 * pi() * k.k * idx / 64)) AS re, -sum(x * sin(2 * pi() * k.k * idx / 64)) AS im
        FROM v, range(0, 33) AS k(k) GROUP BY ALL),
    z AS (SELECT vec_id, n.n AS n,
        sum((CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) * (re * cos(2 * pi() * k * n.n / 64) - im * sin(2 * pi() * k * n.n / 64))) / 64 AS re,
        sum((CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) * (re * sin(2 * pi() * k * n.n / 64) + im * cos(2 * pi() * k * n.n / 64))) / 64 AS im
        FROM f, range(0, 64) AS n(n) GROUP BY ALL)
    SELECT vec_id, n::integer AS idx, round(sqrt(re * re + im * im), 6) + 0.0 AS value FROM z""")
def analytic_envelopes(spark, d):
    return long(vectors(spark, d).withColumn("x", S.analytic_envelope(F.col("x"))), "vec_id")


_MASKS = f"""WITH {mags_sql(_FULL)},
    h AS (SELECT m.vec_id, m.frame, m.bin, any_value(m.mag) AS mag, median(z.mag) AS h FROM mags m, range(-2, 3) AS o(o)
        JOIN mags z ON z.vec_id = m.vec_id AND z.bin = m.bin AND z.frame = CASE WHEN m.frame + o.o < 0
            THEN -(m.frame + o.o) - 1 WHEN m.frame + o.o > 16 THEN 33 - (m.frame + o.o) ELSE m.frame + o.o END
        GROUP BY m.vec_id, m.frame, m.bin),
    p AS (SELECT m.vec_id, m.frame, m.bin, median(z.mag) AS p FROM mags m, range(-1, 2) AS o(o)
        JOIN mags z ON z.vec_id = m.vec_id AND z.frame = m.frame AND z.bin = CASE WHEN m.bin + o.o < 0
            THEN -(m.bin + o.o) - 1 WHEN m.bin + o.o > 8 THEN 17 - (m.bin + o.o) ELSE m.bin + o.o END
        GROUP BY m.vec_id, m.frame, m.bin),
    a AS (SELECT vec_id, frame::integer AS frame, bin::integer AS bin, mag, h * h / (h * h + (p * 1.5) ** 2) AS harmonic,
        p * p / (p * p + (h * 1.25) ** 2) AS percussive FROM h JOIN p USING (vec_id, frame, bin))"""


def masks(spark, d):
    table = S.spectra_table(vectors(spark, d), ["vec_id"], "x", 16, 4, _FULL)
    return S.soft_masks(table, ["vec_id"], F.lit(5), F.lit(3), (F.lit(1.5), F.lit(1.25)))


@query("W12", sql=_MASKS + """ SELECT vec_id, frame, bin, round(mag, 6) + 0.0 AS mag,
    round(harmonic, 6) + 0.0 AS harmonic, round(percussive, 6) + 0.0 AS percussive FROM a""")
def harmonic_percussive_masks(spark, d):
    m = masks(spark, d)
    return m.select("vec_id", "frame", "bin", *[tidy(F.col(c)).alias(c) for c in ("mag", "harmonic", "percussive")])


def _w(i):
    return f"({num(0.01)} + {u_sql(f"'4:weight:{i}:' || vec_id")} * {num(9.99)})"


@query("G8", sql=_MASKS + f""" SELECT vec_id, frame, bin, round(mag * ({_w(0)} * harmonic
    + {_w(1)} * percussive + {_w(2)} * (1 - harmonic - percussive)), 5) + 0.0 AS value FROM a""")
def reweighted_spectra(spark, d):
    out = S.reweight(masks(spark, d), 4, [F.col("vec_id")])
    return out.select("vec_id", "frame", "bin", tidy(F.col("reweighted"), 5).alias("value"))


def _size_sql(name: str) -> str:
    return f"(floor({u_sql(f"'4:size:{name}:' || vec_id")} * 26) + 5)::bigint"


def _margin_sql(name: str) -> str:
    return f"(1.0 + {u_sql(f"'4:margin:{name}:' || vec_id")})"


def _median_sql(n: int, at: str, along: str, size: str) -> str:
    """Upper middle of ``size`` neighbours in a list of ``n`` with mirrored ends."""
    place = f"(({at} + o - {size} // 2) % {2 * n} + {2 * n}) % {2 * n}"
    return (f"list_sort(list_transform(range(0, {size}), lambda o: {along}[least({place}, {2 * n - 1} - {place}) + 1]))"
            f"[{size} // 2 + 1]")


@query("G8", sql=f"""WITH {mags_sql(_FULL)},
    t AS (SELECT vec_id, bin, list(mag ORDER BY frame) AS col FROM mags GROUP BY ALL),
    f AS (SELECT vec_id, frame, list(mag ORDER BY bin) AS line FROM mags GROUP BY ALL),
    s AS (SELECT vec_id, {_size_sql("time")} AS nt, {_size_sql("freq")} AS nf, {_margin_sql("h")} AS mh, {_margin_sql("p")} AS mp FROM embeddings),
    m AS (SELECT vec_id, frame, bin, mh, mp, {_median_sql(17, "frame", "col", "nt")} AS h, {_median_sql(9, "bin", "line", "nf")} AS p
        FROM mags JOIN t USING (vec_id, bin) JOIN f USING (vec_id, frame) JOIN s USING (vec_id))
    SELECT vec_id, frame::integer AS frame, bin::integer AS bin, round(h * h / (h * h + (p * mh) ** 2), 6) + 0.0 AS harmonic FROM m""")
def randomly_sized_masks(spark, d):
    key = [F.col("vec_id")]
    table = S.spectra_table(vectors(spark, d), ["vec_id"], "x", 16, 4, _FULL)
    m = S.soft_masks(table, ["vec_id"], *S.drawn_sizes(4, key), S.drawn_margins(4, key))
    return m.select("vec_id", "frame", "bin", tidy(F.col("harmonic")).alias("harmonic"))
