"""Kernel and recursive filters, resampling, preprocessing chains."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.functions import filter_design as D
from pulsegrid.functions.numeric import tidy
from pulsegrid.operators import kernels as C
from pulsegrid.operators import lookup as L
from pulsegrid.operators import recursive as I
from pulsegrid.operators.blocks import to_samples
from pulsegrid.operators.windows import WindowSpec
from pulsegrid.plans import fragments as B
from pulsegrid.plans import preprocess as P
from pulsegrid.queries import query, table
from pulsegrid.queries.ingest import wav_files
from pulsegrid.queries.signals import BLOCK, KEY, SIG_SQL, blocks, despike_sql, flat, out_sql, samples
from pulsegrid.sources import wav as W


def num(v) -> str:
    """Exact double literal (plain decimals would be read as fixed-point)."""
    return f"{float(v):.17e}"


def values_sql(name: str, kernel) -> str:
    rows = ", ".join(f"({k}, {num(h)})" for k, h in enumerate(kernel))
    return f"{name}(k, h) AS (VALUES {rows})"


def odd_sql(name: str, src: str, reach: int) -> str:
    """Odd continuation of every record by ``reach`` samples at both ends."""
    return f"""{name}_n AS (SELECT record_id, count(*) AS n, arg_min(x, idx) AS x0, arg_max(x, idx) AS x1
        FROM {src} GROUP BY record_id),
    {name} AS (SELECT record_id, idx, x FROM {src}
        UNION ALL SELECT record_id, -idx, 2 * x0 - x FROM {src} JOIN {name}_n USING (record_id)
                  WHERE idx BETWEEN 1 AND {reach}
        UNION ALL SELECT record_id, 2 * (n - 1) - idx, 2 * x1 - x FROM {src} JOIN {name}_n USING (record_id)
                  WHERE idx BETWEEN n - 1 - {reach} AND n - 2)"""


def iir_sql(name: str, src: str, sos, settled: bool = False) -> str:
    """Cascade of sections as a recursion over ``idx`` (starting at each record's first sample)."""
    zi = D.steady_state(np.asarray(sos)) if settled else np.zeros(2 * len(sos))

    def step(x, state):
        cols, prev = [], x
        for s, (b0, b1, b2, _, a1, a2) in enumerate(sos):
            cols += [f"{num(b0)} * {prev} + {state(2 * s)} AS o{s}",
                     f"{num(b1)} * {prev} - {num(a1)} * o{s} + {state(2 * s + 1)} AS u{2 * s}",
                     f"{num(b2)} * {prev} - {num(a2)} * o{s} AS u{2 * s + 1}"]
            prev = f"o{s}"
        return ", ".join(cols)

    names = "record_id, idx, " + ", ".join(
        f"y{s}, p{2 * s}, p{2 * s + 1}" for s in range(len(sos)))
    first = step("z.x", lambda j: f"({num(zi[j])} * z.x)")
    then = step("z.x", lambda j: f"f.p{j}")
    last = len(sos) - 1
    return f"""{name}_0 AS (SELECT record_id, min(idx) AS i0 FROM {src} GROUP BY record_id),
    {name}_r({names}) AS (
        SELECT z.record_id, z.idx, {first} FROM {src} z JOIN {name}_0 m ON m.record_id = z.record_id AND z.idx = m.i0
        UNION ALL
        SELECT z.record_id, z.idx, {then} FROM {name}_r f JOIN {src} z
          ON z.record_id = f.record_id AND z.idx = f.idx + 1),
    {name} AS (SELECT record_id, idx, y{last} AS x FROM {name}_r)"""


def zero_phase_sql(name: str, src: str, sos, edge: int) -> str:
    return f"""{odd_sql(name + '_e', src, edge)},
    {iir_sql(name + '_f', name + '_e', sos, True)},
    {name}_v AS (SELECT record_id, -idx AS idx, x FROM {name}_f),
    {iir_sql(name + '_b', name + '_v', sos, True)},
    {name} AS (SELECT record_id, -b.idx AS idx, b.x FROM {name}_b b JOIN {name}_e_n USING (record_id)
               WHERE -b.idx BETWEEN 0 AND n - 1)"""


def absmax_sql(name: str, src: str) -> str:
    return f"""{name}_c AS (SELECT record_id, idx, x - avg(x) OVER (PARTITION BY record_id) AS x FROM {src}),
    {name}_p AS (SELECT record_id, max(abs(x)) AS peak FROM {name}_c GROUP BY record_id),
    {name} AS (SELECT record_id, idx, greatest(-1.0, least(1.0, CASE WHEN peak > 0 THEN x / peak ELSE x END)) AS x
               FROM {name}_c JOIN {name}_p USING (record_id))"""


def resample_sql(name: str, src: str, fs_in: int, fs_out: int) -> str:
    up, down, taps = D.resample_kernel(fs_in, fs_out)
    half = len(taps) // 2
    return f"""{values_sql(name + '_k', taps)},
    {name}_n AS (SELECT record_id, count(*) AS n FROM {src} GROUP BY record_id),
    {name}_m AS (SELECT record_id, m FROM {name}_n, unnest(range(0, (n * {up} - 1) // {down} + 1)) AS r(m)),
    {name} AS (SELECT o.record_id, m AS idx, sum(h * x) AS x
      FROM {name}_m o JOIN {src} z ON z.record_id = o.record_id
        AND z.idx * {up} BETWEEN m * {down} - {half} AND m * {down} + {half}
      JOIN {name}_k ON k = m * {down} - z.idx * {up} + {half} GROUP BY ALL)"""


SMOOTH = np.array([1.0, 2, 3, 4, 5, 4, 3, 2, 1]) / 25
CHAIN_BLOCK = 256  # the low ECG edge has a long memory; shorter blocks would only add traffic
RECURSIVE_PLACES = 4  # recursions amplify the rounding of sums taken in another order
RATE = 1000.0  # nominal sampling rate of the stand-in records


@query("J10", sql=f"""WITH {SIG_SQL}, {values_sql("ker", SMOOTH)}
    SELECT o.record_id, o.idx, round(sum(h * z.x), 6) + 0.0 AS value
    FROM sig o JOIN ker ON true JOIN sig z ON z.record_id = o.record_id AND z.idx = o.idx + 4 - k
    GROUP BY ALL""")
def kernel_convolution(spark, d):
    return flat(C.convolve(blocks(spark, d), SMOOTH, "zero", KEY))


_BANDS = [D.zero_phase_kernel(h) for h in D.four_bands(RATE, 15)]


@query("F7", sql=f"""WITH {SIG_SQL}, {odd_sql("ext", "sig", 14)},
    ker(band, k, h) AS (VALUES {", ".join(f"({b}, {k}, {num(h)})" for b, hs in enumerate(_BANDS) for k, h in enumerate(hs))})
    SELECT o.record_id, band, o.idx, round(sum(h * z.x), 6) + 0.0 AS value
    FROM sig o JOIN ker ON true JOIN ext z ON z.record_id = o.record_id AND z.idx = o.idx + 14 - k
    GROUP BY ALL""")
def four_band_split(spark, d):
    out = C.four_bands(blocks(spark, d), RATE, KEY, taps=15)
    return out.select("record_id", "band", (F.col("block") * BLOCK).alias("b"),
                      F.posexplode_outer("values").alias("p", "v")).select(
        "record_id", "band", (F.col("b") + F.col("p")).alias("idx"), tidy(F.col("v")).alias("value"))


@query("F8", sql=f"WITH {SIG_SQL}, {resample_sql('res', 'sig', 1000, 1500)} " + out_sql("x", "res"))
def resampled_up(spark, d):
    return flat(C.resample(blocks(spark, d), BLOCK, 1000, 1500, KEY))


@query("F8", sql=f"WITH {SIG_SQL}, {resample_sql('res', 'sig', 2000, 1500)} " + out_sql("x", "res"))
def resampled_down(spark, d):
    return flat(C.resample(blocks(spark, d, 64), 64, 2000, 1500, KEY), 64)


RATES = (1000, 1500, 2000, 4125)  # rates of the stand-in recordings, by the last two bits of their ids


def mixed_sql(name: str, src: str, fs_out: int) -> str:
    """Every recording from its own rate: one resampling per rate, put together."""
    each = [f"{name}_s{i} AS (SELECT * FROM {src} WHERE cast(record_id AS integer) % {len(RATES)} = {i})" for i in range(len(RATES))]
    each += [resample_sql(f"{name}_r{i}", f"{name}_s{i}", r, fs_out) if r != fs_out else f"{name}_r{i} AS (SELECT record_id, idx, x FROM {name}_s{i})"
             for i, r in enumerate(RATES)]
    return ", ".join(each) + f", {name} AS (" + " UNION ALL ".join(f"SELECT * FROM {name}_r{i}" for i in range(len(RATES))) + ")"


@query("F8", "S4", sql=f"WITH {SIG_SQL}, {mixed_sql('res', 'sig', 1500)} " + out_sql("x", "res"))
def resampled_mixed(spark, d):
    rate = F.get(F.array(*map(F.lit, RATES)), F.col("record_id").cast("int") % len(RATES))
    return flat(C.resample_mixed(blocks(spark, d, 64).withColumn("fs", rate), 64, 1500, "fs", KEY), 64)


_CAUSAL = D.band_sections(25.0, 450.0, RATE)


@query("F5", "T5", sql=f"WITH RECURSIVE {SIG_SQL}, {iir_sql('flt', 'sig', _CAUSAL)} " + out_sql("x", "flt", RECURSIVE_PLACES))
def band_passed(spark, d):
    return flat(I.band(blocks(spark, d), BLOCK, RATE, 25.0, 450.0, keys=KEY), places=RECURSIVE_PLACES)


_LOW = D.butterworth(4, [0.3], "low")


@query("F6", sql=f"WITH RECURSIVE {SIG_SQL}, {zero_phase_sql('flt', 'sig', _LOW, 15)} " + out_sql("x", "flt", RECURSIVE_PLACES))
def zero_phase_low(spark, d):
    return flat(I.butter_zero_phase(blocks(spark, d), BLOCK, RATE, 150.0, "low", keys=KEY), places=RECURSIVE_PLACES)


_STOP = D.butterworth(2, [0.3, 0.5], "stop")


@query("F6", sql=f"WITH RECURSIVE {SIG_SQL}, {zero_phase_sql('flt', 'sig', _STOP, 15)} " + out_sql("x", "flt", RECURSIVE_PLACES))
def zero_phase_band_stop(spark, d):
    return flat(I.butter_zero_phase(blocks(spark, d), BLOCK, RATE, [150.0, 250.0], "stop", 2, KEY), places=RECURSIVE_PLACES)


@query("F6", sql=f"""WITH RECURSIVE {SIG_SQL},
    {zero_phase_sql('n1', 'sig', D.notch(0.2, 2.0), 9)}, {zero_phase_sql('n2', 'n1', D.notch(0.4, 2.0), 9)}
    """ + out_sql("x", "n2", RECURSIVE_PLACES))
def notched(spark, d):
    return flat(I.notch_chain(blocks(spark, d), BLOCK, RATE, [100.0, 200.0, 500.0], 2.0, KEY), places=RECURSIVE_PLACES)


@query("F10", sql=f"""WITH RECURSIVE {SIG_SQL}, {resample_sql('res', 'sig', 1000, 1500)},
    {iir_sql('flt', 'res', D.band_sections(2.0, 40.0, 1500.0))}, {absmax_sql('nrm', 'flt')}
    """ + out_sql("x", "nrm", RECURSIVE_PLACES))
def ecg_chain(spark, d):
    rows = samples(spark, d).select("record_id", "idx", "value")
    return flat(P.ecg(rows, CHAIN_BLOCK, 1000, 1500, KEY), CHAIN_BLOCK, RECURSIVE_PLACES)


@query("F9", sql=f"""WITH RECURSIVE {SIG_SQL}, {resample_sql('res', 'sig', 16, 32)}, {despike_sql('flat', 'res', 16)},
    {iir_sql('flt', 'flat', D.band_sections(0.5, 9.0, 32.0))}, {absmax_sql('nrm', 'flt')}
    """ + out_sql("x", "nrm", RECURSIVE_PLACES))
def pcg_chain(spark, d):
    rows = samples(spark, d).select("record_id", "idx", "value")
    return flat(P.pcg(rows, CHAIN_BLOCK, 16, 32, KEY, band_hz=(0.5, 9.0)), CHAIN_BLOCK, RECURSIVE_PLACES)


@query("F11", "P5", sql=f"""WITH RECURSIVE {SIG_SQL}, {resample_sql('res', 'sig', 1000, 1500)},
    e AS (SELECT * FROM res WHERE record_id::bigint % 2 = 0), p AS (SELECT * FROM res WHERE record_id::bigint % 2 = 1),
    {iir_sql('fe', 'e', D.band_sections(*P.BANDS["ecg"], 1500.0))}, {absmax_sql('ne', 'fe')}, {despike_sql('pd', 'p', 750)},
    {iir_sql('fp', 'pd', D.band_sections(*P.BANDS["pcg"], 1500.0))}, {absmax_sql('np', 'fp')},
    b AS (SELECT *, 'E' AS channel FROM ne UNION ALL SELECT *, '1' FROM np)
    SELECT record_id, channel, idx, round(x, {RECURSIVE_PLACES}) + 0.0 AS value FROM b""")
def chains_by_channel_kind(spark, d):
    rows = samples(spark, d, "event_type").select(
        "record_id", "idx", "value", F.when(F.col("record_id").cast("long") % 2 == 0, "E")
        .otherwise("1").alias("channel"))
    out = to_samples(P.by_kind(rows, CHAIN_BLOCK, 1000, 1500), CHAIN_BLOCK)
    return out.withColumn("value", tidy(F.col("value"), RECURSIVE_PLACES))


@query("F12", sql=f"""WITH RECURSIVE {SIG_SQL}, {values_sql("ker", C.hilbert_kernel(31))},
    env AS (SELECT o.record_id, o.idx, ln(greatest(sqrt(any_value(o.x) ** 2 + sum(h * z.x) ** 2), {num(np.finfo(float).eps)})) AS x
      FROM sig o JOIN ker ON true JOIN sig z ON z.record_id = o.record_id AND z.idx = o.idx + 15 - k GROUP BY o.record_id, o.idx),
    {zero_phase_sql('flt', 'env', D.butterworth(4, [8.0 / 50.0], "low"), 15)}
    """ + out_sql("exp(x)", "flt", RECURSIVE_PLACES))
def homomorphic_envelopes(spark, d):
    env = C.envelope(blocks(spark, d, 64), 31, KEY)
    return flat(I.log_smooth(env, 64, 100.0, 8.0, 4, KEY), 64, RECURSIVE_PLACES)


@query("F12", sql=f"""WITH {SIG_SQL}, {values_sql("ker", C.hilbert_kernel(31))}
    SELECT o.record_id, o.idx,
      round(sqrt(any_value(o.x) ** 2 + sum(h * z.x) ** 2), 6) + 0.0 AS value
    FROM sig o JOIN ker ON true JOIN sig z ON z.record_id = o.record_id AND z.idx = o.idx + 15 - k
    GROUP BY o.record_id, o.idx""")
def hilbert_envelopes(spark, d):
    return flat(C.envelope(blocks(spark, d), 31, KEY))


@query("A13", sql=f"""
    WITH v AS (SELECT vec_id, m.m AS mic, p.p AS idx, embedding[m.m * 32 + p.p + 1]::double AS x
               FROM embeddings, range(0, 2) AS m(m), range(0, 32) AS p(p)),
    dl AS (SELECT *, least(abs(x) * 4, 2.0) AS delay FROM v),
    w AS (SELECT vec_id, mic, idx, t.t AS t, (0.54 - 0.46 * cos(2 * pi() * (t.t + 20) / 40.0))
            * CASE WHEN t.t = delay THEN 1.0 ELSE sin(pi() * (t.t - delay)) / (pi() * (t.t - delay)) END AS h
          FROM dl, range(-20, 21) AS t(t)),
    y AS (SELECT w.vec_id, w.mic, w.idx, sum(h * v.x) / sum(h) AS y FROM w JOIN v
            ON v.vec_id = w.vec_id AND v.mic = w.mic
           AND v.idx = CASE WHEN w.idx + t < 0 THEN -(w.idx + t) WHEN w.idx + t > 31 THEN 62 - (w.idx + t)
                       ELSE w.idx + t END GROUP BY ALL)
    SELECT vec_id, cast(idx AS integer) AS idx, round(sum(y * y), 6) + 0.0 AS value FROM y GROUP BY ALL""")
def beam_energy(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, d, "embeddings").select(
        "vec_id", F.posexplode_outer(F.array(F.slice(v, 1, 32), F.slice(v, 33, 32))).alias("mic", "values"))
    rows = rows.withColumn("delays", F.transform("values", lambda x: F.least(F.abs(x) * 4, F.lit(2.0))))
    return C.beam(rows, ["vec_id"]).withColumn("value", tidy(F.col("value")))


# Two-channel recordings of 32 samples: column 0 is the ECG E, column 1 the microphone 1.
RECORDED = {"E": 0, "1": 1}
_SPEC = WindowSpec(window_s=0.016, overlap_s=0.004, pad_s=0.003)
_START, _WIN, _HOP = _SPEC.samples(1500)


def recorded_fragments(spark, d):
    ids = F.regexp_extract("path", r"v(\d+)\.wav$", 1).cast("long")
    recordings = W.decode(wav_files(spark, d), CHAIN_BLOCK).withColumn("record_id", ids)
    split = table(spark, d, "embeddings").where("vec_id % 7 <> 0").select(
        F.col("vec_id").alias("record_id"), F.expr("vec_id div 4").alias("patient"), F.col("label"),
        F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train").alias("subset"))
    return B.fragments(split, B.named_channels(recordings, RECORDED), CHAIN_BLOCK, 1000, 1500, _SPEC)


@query("P6", "W1", "J2", "S4", sql=f"""WITH RECURSIVE v AS (SELECT vec_id, p.p AS idx, embedding[p.p + 1]::double AS x FROM embeddings, range(0, 64) AS p(p)
        WHERE vec_id % 7 <> 0),
    raw AS (SELECT vec_id * 2 + (idx // 32) AS record_id, idx % 32 AS idx, round(greatest(-1.0, least(1.0, x)) * 32767) / 32767 AS x FROM v),
    {resample_sql('res', 'raw', 1000, 1500)},
    e AS (SELECT * FROM res WHERE record_id % 2 = 0), p AS (SELECT * FROM res WHERE record_id % 2 = 1),
    {iir_sql('fe', 'e', D.band_sections(*P.BANDS["ecg"], 1500.0))}, {absmax_sql('ne', 'fe')},
    {iir_sql('fp', 'p', D.band_sections(*P.BANDS["pcg"], 1500.0))}, {absmax_sql('np', 'fp')},
    b AS (SELECT * FROM ne UNION ALL SELECT * FROM np), n AS (SELECT record_id, count(*) AS n FROM b GROUP BY record_id),
    w AS (SELECT record_id, n, k AS win_no, {_START} + k * {_HOP} AS t0
        FROM n, unnest(range(0, greatest(0, n - {_WIN} - {_START}) // {_HOP} + 1)) AS r(k) WHERE n > {_START}),
    cells AS (SELECT w.*, p.p AS pos, coalesce(x, 0.0) AS x FROM w CROSS JOIN range(0, {_WIN}) AS p(p)
        LEFT JOIN b ON b.record_id = w.record_id AND b.idx = t0 + p.p)
    SELECT c.record_id // 2 AS record_id, c.win_no, c.pos::integer AS pos, (c.record_id // 2) // 4 AS patient, label,
        CASE WHEN (c.record_id // 2) % 5 = 0 THEN 'test' ELSE 'train' END AS subset, least({_WIN}, c.n - c.t0)::integer AS valid_len,
        round(c.x, {RECURSIVE_PLACES}) + 0.0 AS microphone, round(e.x, {RECURSIVE_PLACES}) + 0.0 AS ecg
    FROM cells c JOIN cells e ON e.record_id = c.record_id - 1 AND e.win_no = c.win_no AND e.pos = c.pos
    JOIN embeddings ON vec_id = c.record_id // 2 WHERE c.record_id % 2 = 1""")
def built_fragments(spark, d):
    rows = B.stacked(recorded_fragments(spark, d), ["1", "E"]).withColumn("w", F.arrays_zip(
        F.get("waveforms", F.lit(0)).alias("m"), F.get("waveforms", F.lit(1)).alias("e")))
    own = ["record_id", "win_no", "patient", "label", "subset", "valid_len"]
    return rows.select(*own, F.posexplode_outer("w").alias("pos", "z")).select(
        *own, "pos", tidy(F.col("z.m"), RECURSIVE_PLACES).alias("microphone"), tidy(F.col("z.e"), RECURSIVE_PLACES).alias("ecg"))


_GRID = np.cumprod(1 - L.linear_betas(1e-4, 0.05, 50))


@query("J11", sql=f"""WITH {values_sql("grid", _GRID)},
    v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1 - l_discount * 5 AS v FROM lineitem),
    iv AS (SELECT k, h AS hi, lead(h) OVER (ORDER BY k) AS lo FROM grid)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           round(k + (sqrt(hi) - sqrt(v)) / (sqrt(hi) - sqrt(lo)), 6) + 0.0 AS step
    FROM v LEFT JOIN iv ON v <= hi AND v > lo""")
def fractional_steps(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (1 - F.col("l_discount") * 5).alias("v"))
    return rows.withColumn("step", tidy(L.fractional_step(F.col("v"), _GRID))).drop("v")


@query("W11", sql="""SELECT o_custkey, o_orderkey,
    round(exp(sum(ln(1 - (o_orderkey % 97) * 0.000777e0)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)), 6) + 0.0 AS kept
    FROM orders""")
def running_products(spark, d):
    rows = table(spark, d, "orders").select(
        "o_custkey", "o_orderkey", ((F.col("o_orderkey") % 97) * 0.000777).alias("rate"))
    out = L.running_product(rows, ["o_custkey"], "o_orderkey", "rate", "kept", span=1000)
    return out.select("o_custkey", "o_orderkey", tidy(F.col("kept")).alias("kept"))
