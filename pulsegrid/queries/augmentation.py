"""Augmentation of fragments. Stand-in: each embedding is one 64-sample fragment."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.functions.keyed import between, pick, unit
from pulsegrid.functions.numeric import tidy
from pulsegrid.operators import equaliser as E
from pulsegrid.operators.blocks import cut_arrays
from pulsegrid.operators import lookup as L
from pulsegrid.operators import corpus as N
from pulsegrid.operators import noise as Z
from pulsegrid.plans import augment as G
from pulsegrid.plans import augment_blocks as R
from pulsegrid.queries import query, table
from pulsegrid.queries.filters import num, values_sql
from pulsegrid.queries.sampling import gauss_sql, u_sql

SEED = 5
FS = 4125.0
COPY = 2  # copies per fragment


# --- SQL side: every step is a function of a long-form relation (k, idx, x) -------------------

def src_sql(name: str, lo: int = 0, n: int = 64, copies: int = COPY) -> str:
    return f"""{name} AS (SELECT vec_id || ':' || c.c AS k, p.p AS idx, embedding[{lo} + p.p + 1]::double AS x
        FROM embeddings, range(1, {copies + 1}) AS c(c), range(0, {n}) AS p(p))"""


def absmax(name: str, src: str) -> str:
    return f"""{name}_c AS (SELECT k, idx, x - avg(x) OVER (PARTITION BY k) AS x FROM {src}),
    {name}_p AS (SELECT k, max(abs(x)) AS peak FROM {name}_c GROUP BY k),
    {name} AS (SELECT k, idx, CASE WHEN peak > 0 THEN greatest(-1.0, least(1.0, x / peak)) ELSE x END AS x
               FROM {name}_c JOIN {name}_p USING (k))"""


def minmax(name: str, src: str) -> str:
    return f"""{name}_r AS (SELECT k, min(x) AS a, max(x) AS b FROM {src} GROUP BY k),
    {name} AS (SELECT k, idx, CASE WHEN b <= a THEN 0.0 ELSE (x - a) / (b - a) * 2.0 - 1.0 END AS x
               FROM {src} JOIN {name}_r USING (k))"""


def key(*parts: str, k: str = "k", tail: str = "") -> str:
    return "'" + ":".join([str(SEED), *parts]) + f":' || {k}{tail}"


def noise(name: str, src: str, step: str, k: str = "k") -> str:
    level = (f"[1e-4, 1e-3, 1e-2][floor({u_sql(key(step, 'std', k=k))} * 3)::int + 1]"
             f" * ({u_sql(key(step, 'scale', k=k))} * {num(0.1)})")
    tail = " || ':' || idx"
    return f"""{name}_l AS (SELECT *, {level} AS lvl FROM {src}),
    {name}_y AS (SELECT k, idx, x + lvl * {gauss_sql(key(step, k=k, tail=tail))} AS x FROM {name}_l),
    {absmax(name, name + '_y')}"""


def wave_sql(step: str, amp, fs: float = FS, k: str = "k") -> str:
    terms = []
    for n, (lo, hi) in enumerate(A.SLOW_AND_FAST):
        kk = key(step, str(n), k=k)
        terms.append(f"({num(amp[0])} + {u_sql(kk)} * {num(amp[1] - amp[0])}) * sin(2 * pi() * "
                     f"(({num(lo)} + {u_sql(kk, 1)} * {num(hi - lo)}) * (idx / {num(fs)}) + {u_sql(kk, 2)}))")
    return "(" + " + ".join(terms) + ")"


def volume(name: str, src: str, step: str, k: str = "k") -> str:
    return f"""{name}_y AS (SELECT k, idx, x * (1.0 + {wave_sql(step, (0.01, 0.25), k=k)}) AS x FROM {src}),
    {absmax(name, name + '_y')}"""


def wander(name: str, src: str, step: str) -> str:
    return f"""{name}_y AS (SELECT k, idx, x + {wave_sql(step, (0.01, 0.2))} AS x FROM {src}),
    {absmax(name, name + '_y')}"""


def stretch(name: str, src: str, step: str, rates, keep: bool = False, k: str = "k",
            normal: bool = True) -> str:
    rate = f"({num(rates[0])} + {u_sql(key(step, 'rate', k=k))} * {num(rates[1] - rates[0])})"
    out = name + ("_y" if normal else "")
    return f"""{name}_n AS (SELECT k, count(*) AS n, {rate} AS rate FROM {src} GROUP BY k),
    {name}_t AS (SELECT k, n, i AS idx, i * rate AS t, floor(i * rate)::bigint AS j
        FROM {name}_n, unnest(range(0, floor((n - 1) / rate)::bigint + 1)) AS r(i) {'WHERE i < n' if keep else ''}),
    {out} AS (SELECT t.k, t.idx, a.x + (t.t - t.j) * (b.x - a.x) AS x FROM {name}_t t
        JOIN {src} a ON a.k = t.k AND a.idx = t.j JOIN {src} b ON b.k = t.k AND b.idx = least(t.j + 1, n - 1))
    """ + ("," + absmax(name, out) if normal else "")


def eq(name: str, src: str, step: str, band, fs: float = FS, n: int = 5) -> str:
    low, high = band
    cols = []
    for b in range(n):
        kk = key(step, str(b))
        lo = f"({num(low)} + {u_sql(kk)} * {num(0.95 * high - low)})"
        fl = f"({lo} + {num(0.05 * (high - low))})"
        hi = (f"CASE WHEN {u_sql(kk, 1)} < 0.5 THEN {fl} + {u_sql(kk, 2)} * ({num(high)} - {fl}) "
              f"ELSE {lo} + {num((high - low) / n)} END")
        cols.append(f"tan({lo} * (pi() / {num(fs)})) AS l{b}, tan(({hi}) * (pi() / {num(fs)})) AS h{b}")
    ratio = ", ".join(f"(h{b} - l{b}) / (1 + (h{b} - l{b}) + h{b} * l{b}) AS g{b}, "
                      f"2 * (h{b} * l{b} - 1) / (1 + (h{b} - l{b}) + h{b} * l{b}) AS c{b}, "
                      f"(1 - (h{b} - l{b}) + h{b} * l{b}) / (1 + (h{b} - l{b}) + h{b} * l{b}) AS d{b}"
                      for b in range(n))

    def step_sql(state):
        out, prev = [], "z.x"
        for b in range(n):
            out += [f"q.g{b} * {prev} + {state(2 * b)} AS o{b}",
                    f"{state(2 * b + 1)} - q.c{b} * o{b} AS u{2 * b}",
                    f"- q.g{b} * {prev} - q.d{b} * o{b} AS u{2 * b + 1}"]
            prev = f"o{b}"
        return ", ".join(out)

    names = ", ".join(f"y{b}, p{2 * b}, p{2 * b + 1}" for b in range(n))
    return f"""{name}_k AS (SELECT k, {", ".join(cols)} FROM (SELECT DISTINCT k FROM {src})),
    {name}_q AS (SELECT k, {ratio} FROM {name}_k),
    {name}_r(k, idx, {names}) AS (
        SELECT z.k, z.idx, {step_sql(lambda j: "0.0::double")} FROM {src} z JOIN {name}_q q ON q.k = z.k WHERE z.idx = 0
        UNION ALL SELECT z.k, z.idx, {step_sql(lambda j: f"f.p{j}")} FROM {name}_r f
        JOIN {src} z ON z.k = f.k AND z.idx = f.idx + 1 JOIN {name}_q q ON q.k = z.k),
    {name}_f AS (SELECT k, idx, y{n - 1} AS x FROM {name}_r), {absmax(name + '_a', name + '_f')},
    {absmax(name + '_b', src)},
    {name}_y AS (SELECT a.k, a.idx, a.x / 50.0::double + b.x AS x FROM {name}_a a JOIN {name}_b b USING (k, idx)),
    {absmax(name, name + '_y')}"""


def gated(name: str, src: str, step: str, p: float, made: str, k: str = "k") -> str:
    """``made`` defines relation ``{name}_g``; keys whose gate is shut keep their samples."""
    on = f"{u_sql(key('gate', step, k=k))} < {num(p)}"
    return f"""{made}, {name} AS (SELECT k, idx, x FROM {name}_g WHERE {on}
        UNION ALL SELECT k, idx, x FROM {src} WHERE NOT ({on}))"""


def done(src: str, extra: str = "") -> str:
    return f"""SELECT split_part(k, ':', 1)::bigint AS vec_id, split_part(k, ':', 2)::integer AS copy_no,
        cast(idx AS integer) AS idx, round(x, 6) + 0.0 AS value{extra} FROM {src}"""


# --- Spark side --------------------------------------------------------------------------------

def fragments(spark, d, copies: int = COPY):
    return table(spark, d, "embeddings").select(
        "vec_id", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy_no"),
        A.as_doubles("embedding").alias("x"))


def key_cols():
    return [F.col("vec_id"), F.col("copy_no")]


def long(df, col="x"):
    return df.select("vec_id", "copy_no", F.posexplode_outer(col).alias("idx", "value")).withColumn(
        "value", tidy(F.col("value")))


@query("F1", "H1", sql=f"WITH {src_sql('s')}, {absmax('o', 's')} {done('o')}")
def fragment_abs_max(spark, d):
    return long(fragments(spark, d).transform(lambda f: f.withColumn("x", A.abs_max(F.col("x")))))


@query("G1", sql=f"WITH {src_sql('s')}, {noise('o', 's', 'noise')} {done('o')}")
def white_noise(spark, d):
    return long(fragments(spark, d).withColumn("x", A.white_noise(F.col("x"), SEED, "noise", *key_cols())))


@query("G2", sql=f"WITH {src_sql('s')}, {volume('o', 's', 'volume')} {done('o')}")
def sinusoidal_gain(spark, d):
    return long(fragments(spark, d).withColumn("x", A.volume(F.col("x"), FS, SEED, "volume", *key_cols())))


@query("G3", sql=f"WITH {src_sql('s')}, {wander('o', 's', 'wander')} {done('o')}")
def baseline_wander(spark, d):
    return long(fragments(spark, d).withColumn("x", A.wander(F.col("x"), FS, SEED, "wander", *key_cols())))


_POINTS = ", ".join(f"({n}, {num(0.7)} + {u_sql(key('warp', str(n)))} * {num(1.3 - 0.7)})" for n in range(12))


@query("G4", sql=f"""WITH {src_sql('s')},
    ctl AS (SELECT k, v.n AS n, v.a AS a FROM (SELECT DISTINCT k FROM s) q, LATERAL (VALUES {_POINTS}) AS v(n, a)),
    cur AS (SELECT lo.k, t, lo.a + (coalesce(hi.a, 0) - lo.a) * (t * 11 / 64.0::double - n0) AS h
        FROM (SELECT t, least(floor(t * 11 / 64.0::double), 10)::int AS n0 FROM range(0, 65) AS r(t)) g
        JOIN ctl lo ON lo.n = n0 JOIN ctl hi ON hi.k = lo.k AND hi.n = n0 + 1),
    nrm AS (SELECT k, t, h / sum(h) OVER (PARTITION BY k) AS h FROM cur),
    o AS (SELECT a.k, a.i AS idx, sum(h * z.x) AS x FROM (SELECT k, idx AS i FROM s) a JOIN nrm ON nrm.k = a.k
        JOIN s z ON z.k = a.k AND z.idx = CASE WHEN i + t - 32 < 0 THEN 32 - i - t
            WHEN i + t - 32 > 63 THEN 126 - (i + t - 32) ELSE i + t - 32 END GROUP BY ALL) {done('o')}""")
def amplitude_warp(spark, d):
    return long(fragments(spark, d).withColumn("x", E.warp(F.col("x"), SEED, "warp", *key_cols())))


@query("G5", sql=f"WITH RECURSIVE {src_sql('s')}, {eq('o', 's', 'eq', G.PCG_EQ)} {done('o')}")
def parametric_equaliser(spark, d):
    return long(fragments(spark, d).withColumn(
        "x", E.equalise(F.col("x"), FS, *G.PCG_EQ, SEED, "eq", *key_cols())))


@query("G6", sql=f"WITH {src_sql('s')}, {stretch('o', 's', 'stretch', G.PAIR_RATES, normal=False)} {done('o')}")
def time_scaling(spark, d):
    rate = between(*G.PAIR_RATES, SEED, "stretch", "rate", *key_cols())
    return long(fragments(spark, d).withColumn("x", A.stretch(F.col("x"), rate)))


def _crop(name, lo, step, top=0.05):
    at = f"floor({u_sql(key(step, 'at'))} * 9)::bigint"
    gain = f"CASE WHEN {u_sql(key(step, 'on'))} < 0.5 THEN 0.0 ELSE {u_sql(key(step, 'gain'))} * {num(top)} END"
    return f"""{name}_w AS (SELECT k, nk, {at} AS at, {gain} AS gain FROM asked),
    {name}_x AS (SELECT w.k, p.p AS idx, embedding[{lo} + w.at + p.p + 1]::double AS x
        FROM {name}_w w JOIN corpus ON corpus.nk = w.nk, range(0, 40) AS p(p)),
    {absmax(name + '_m', name + '_x')},
    {name} AS (SELECT k, idx, gain * x AS x FROM {name}_m JOIN {name}_w USING (k))"""


@query("J12", "G7", sql=f"""WITH {src_sql('s', 0, 40)},
    corpus AS (SELECT embedding, row_number() OVER (ORDER BY md5('corpus:' || vec_id), vec_id) - 1 AS nk FROM embeddings),
    asked AS (SELECT k, floor({u_sql(key('noise'))} * (SELECT count(*) FROM corpus))::bigint AS nk
              FROM (SELECT DISTINCT k FROM s)),
    {_crop('a1', 0, 'aux1')}, {_crop('a2', 16, 'aux2')},
    both_ AS (SELECT a1.k, a1.idx, a1.x + a2.x AS x FROM a1 JOIN a2 USING (k, idx)),
    {absmax('nn', 'both_')},
    o AS (SELECT s.k, s.idx, s.x + nn.x AS x FROM s JOIN nn USING (k, idx)) {done('o')}""")
def recorded_noise(spark, d):
    rows = fragments(spark, d).withColumn("x", F.slice("x", 1, 40))
    v = A.as_doubles("embedding")
    corpus = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("noise_id"), F.slice(v, 1, 48).alias("aux1"), F.slice(v, 17, 48).alias("aux2"))
    with_noise = Z.pick_noise(rows, corpus, "noise_id", ["aux1", "aux2"], SEED, key_cols())
    heart = Z.heart_noise(F.col("aux1"), F.col("aux2"), F.size("x"), SEED, key_cols())
    return long(with_noise.withColumn("noise", heart).withColumn(
        "x", Z.padded_add(F.col("x"), F.col("noise"))))


@query("J12", "G7")
def recorded_ecg_noise(spark, d):
    """Three recordings serve every row: the join key is salted."""
    rows = fragments(spark, d)
    v = table(spark, d, "embeddings")
    three = v.agg(F.min("vec_id").alias("noise_id"), *[
        F.max_by(A.as_doubles("embedding"), F.when(F.col("label") == i, F.col("vec_id"))).alias(n)
        for i, n in enumerate(Z.ECG_NOISE)])
    got = Z.pick_noise(rows, three, "noise_id", list(Z.ECG_NOISE), SEED, key_cols())
    made = Z.ecg_noise({n: F.col(n) for n in Z.ECG_NOISE}, F.size("x"), SEED, key_cols())
    return long(got.withColumn("noise", made).withColumn("x", Z.padded_add(F.col("x"), F.col("noise"))))


def noise_corpus(spark, d, parts, at, block):
    """Each embedding as a noise recording whose parts are 48 of its samples, in blocks."""
    v = A.as_doubles("embedding")
    part = lambda name, lo: F.struct(F.lit(name).alias("part"), F.slice(v, lo + 1, 48).alias("x"))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("noise_id"), F.explode(F.array(*[part(*p) for p in zip(parts, at)])).alias("p"))
    rows = rows.select("noise_id", "p.part", F.lit(int(FS)).alias("fs"), F.col("p.x").alias("x"))
    return N.build_corpus(cut_arrays(rows, "x", block, ["noise_id", "part", "fs"]), list(parts), block, int(FS))


def noise_added(spark, d, parts, at, normalise, block=40):
    rows = fragments(spark, d).withColumn("x", F.slice("x", 1, 40))
    keys = ["vec_id", "copy_no"]
    signals = rows.select(*keys, F.size("x").cast("long").alias("n"))
    noise = N.noise_blocks(signals, noise_corpus(spark, d, parts, at, block), keys, parts, SEED, key_cols(), normalise)
    done = N.add_noise(cut_arrays(rows, "x", block, keys), noise, keys)
    return done.select(*keys, F.posexplode_outer("values").alias("p", "value")).select(
        *keys, (F.col("p") + F.lit(0)).cast("int").alias("idx"), tidy(F.col("value")).alias("value"))


_RECORDED = f"""WITH {src_sql('s', 0, 40)},
    corpus AS (SELECT embedding, row_number() OVER (ORDER BY md5('corpus:' || vec_id), vec_id) - 1 AS nk FROM embeddings),
    asked AS (SELECT k, floor({u_sql(key('noise'))} * (SELECT count(*) FROM corpus))::bigint AS nk
              FROM (SELECT DISTINCT k FROM s)),"""


@query("J12", "G7", sql=_RECORDED + f"""
    {_crop('a1', 0, 'aux1')}, {_crop('a2', 16, 'aux2')},
    both_ AS (SELECT a1.k, a1.idx, a1.x + a2.x AS x FROM a1 JOIN a2 USING (k, idx)),
    {absmax('nn', 'both_')},
    o AS (SELECT s.k, s.idx, s.x + nn.x AS x FROM s JOIN nn USING (k, idx)) {done('o')}""")
def heart_noise_from_blocks(spark, d):
    return noise_added(spark, d, N.HEART_PARTS, (0, 16), True)


@query("J12", "G7", sql=_RECORDED + f"""
    {_crop('e1', 0, 'em', 0.25)}, {_crop('e2', 8, 'bw', 0.5)}, {_crop('e3', 16, 'ma', 0.25)},
    o AS (SELECT s.k, s.idx, s.x + e1.x + e2.x + e3.x AS x FROM s JOIN e1 USING (k, idx) JOIN e2 USING (k, idx) JOIN e3 USING (k, idx)) {done('o')}""")
def ecg_noise_from_blocks(spark, d):
    return noise_added(spark, d, N.ECG_PARTS, (0, 8, 16), False)


_PCG_SQL = ", ".join([
    src_sql("s", copies=1), minmax("a", "s"),
    gated("b", "a", "noise1", 0.3 / 4, noise("b_g", "a", "noise1")),
    gated("c", "b", "stretch", 0.25, stretch("c_g", "b", "stretch", G.PCG_RATES)),
    gated("e", "c", "volume", 0.75, volume("e_g", "c", "volume")),
    gated("f", "e", "noise2", 0.3 / 4, noise("f_g", "e", "noise2")),
    gated("g", "f", "eq", 0.25, eq("g_g", "f", "eq", G.PCG_EQ)), absmax("o", "g")])


@query("G9", sql=f"WITH RECURSIVE {_PCG_SQL} {done('o')}")
def augmented_pcg(spark, d):
    return long(G.augment_pcg(fragments(spark, d, 1), "x", FS, SEED, key_cols()))


_ECG_SQL = ", ".join([
    src_sql("s", copies=1), minmax("a", "s"),
    gated("b", "a", "noise1", 0.3 / 4, noise("b_g", "a", "noise1")),
    gated("c", "b", "wander", 0.3, wander("c_g", "b", "wander")),
    gated("e", "c", "stretch", 0.25, stretch("e_g", "c", "stretch", G.PAIR_RATES)),
    gated("f", "e", "noise2", 0.3 / 4, noise("f_g", "e", "noise2")),
    gated("g", "f", "eq", 0.25, eq("g_g", "f", "eq", G.ECG_EQ)), absmax("o", "g")])


@query("G10", sql=f"WITH RECURSIVE {_ECG_SQL} {done('o')}")
def augmented_ecg(spark, d):
    return long(G.augment_ecg(fragments(spark, d, 1), "x", FS, SEED, key_cols()))


_PAIR_SQL = ", ".join([
    src_sql("s1", 0, 32, 1), src_sql("s2", 32, 32, 1), minmax("p0", "s1"), minmax("e0", "s2"),
    gated("p1", "p0", "p_noise1", 0.3 / 4, noise("p1_g", "p0", "p_noise1")),
    gated("e1", "e0", "e_noise1", 0.3 / 4, noise("e1_g", "e0", "e_noise1")),
    gated("e2", "e1", "e_wander", 0.3, wander("e2_g", "e1", "e_wander")),
    gated("e3", "e2", "stretch", 0.25, stretch("e3_g", "e2", "stretch", G.PAIR_RATES)),
    gated("p3", "p1", "stretch", 0.25, stretch("p3_g", "p1", "stretch", G.PAIR_RATES)),
    gated("p4", "p3", "p_volume", 0.75, volume("p4_g", "p3", "p_volume")),
    gated("p5", "p4", "p_noise2", 0.3 / 4, noise("p5_g", "p4", "p_noise2")),
    gated("e5", "e3", "e_noise2", 0.3 / 4, noise("e5_g", "e3", "e_noise2")),
    gated("p6", "p5", "p_eq", 0.25, eq("p6_g", "p5", "p_eq", G.PCG_EQ)),
    gated("e6", "e5", "e_eq", 0.25, eq("e6_g", "e5", "e_eq", G.ECG_EQ)),
    absmax("po", "p6"), absmax("eo", "e6")])


@query("G11", sql=f"""WITH RECURSIVE {_PAIR_SQL}, o AS (SELECT k, idx, p.x AS x, e.x AS ex
    FROM po p JOIN eo e USING (k, idx)) {done('o', ', round(ex, 6) + 0.0 AS ecg')}""")
def augmented_pair(spark, d):
    rows = fragments(spark, d, 1).select("vec_id", "copy_no", F.slice("x", 1, 32).alias("pcg"),
                                         F.slice("x", 33, 32).alias("ecg"))
    out = G.augment_pair(rows, "pcg", "ecg", FS, SEED, key_cols())
    both = out.select("vec_id", "copy_no", F.posexplode_outer(F.arrays_zip("pcg", "ecg")).alias("idx", "z"))
    return both.select("vec_id", "copy_no", "idx", tidy(F.col("z.pcg")).alias("value"),
                       tidy(F.col("z.ecg")).alias("ecg"))


# The same steps on whole recordings in blocks of 20 samples; the copies' number is part of the key.
_STEPS = R.BlockSteps(20, FS, SEED, ["vec_id", "copy_no"], ["vec_id", "copy_no"])


def in_blocks(spark, d, lo=1, n=64):
    return cut_arrays(fragments(spark, d, 1).withColumn("x", F.slice("x", lo, n)), "x", _STEPS.block, _STEPS.keys)


def long_blocks(blocks, name="value"):
    return blocks.select(*_STEPS.keys, "block", F.posexplode_outer("values").alias("p", "v")).select(
        *_STEPS.keys, (F.col("block") * _STEPS.block + F.col("p")).cast("int").alias("idx"), tidy(F.col("v")).alias(name))


@query("U1", "G9", sql=f"WITH RECURSIVE {_PCG_SQL} {done('o')}")
def augmented_pcg_records(spark, d):
    return long_blocks(R.augment_pcg_blocks(in_blocks(spark, d), _STEPS))


@query("U1", "G10", sql=f"WITH RECURSIVE {_ECG_SQL} {done('o')}")
def augmented_ecg_records(spark, d):
    return long_blocks(R.augment_ecg_blocks(in_blocks(spark, d), _STEPS))


@query("U1", "G11", sql=f"""WITH RECURSIVE {_PAIR_SQL}, o AS (SELECT k, idx, p.x AS x, e.x AS ex
    FROM po p JOIN eo e USING (k, idx)) {done('o', ', round(ex, 6) + 0.0 AS ecg')}""")
def augmented_pair_records(spark, d):
    p, e = R.augment_pair_blocks(in_blocks(spark, d, 1, 32), in_blocks(spark, d, 33, 32), _STEPS)
    return long_blocks(p).join(long_blocks(e, "ecg"), [*_STEPS.keys, "idx"])


def _multi_sql():
    # k carries the channel as a third part; shared draws use the first two parts only.
    own = "split_part(k, ':', 1) || ':' || split_part(k, ':', 2)"
    src = """s AS (SELECT vec_id || ':1:' || c.c AS k, p.p AS idx, embedding[c.c * 32 + p.p + 1]::double AS x
        FROM embeddings, range(0, 2) AS c(c), range(0, 32) AS p(p))"""

    sql = ", ".join([
        src, absmax("a", "s"),
        gated("b", "a", "noise1", 0.3 / 4, noise("b_g", "a", "noise1"), own),
        gated("c", "b", "stretch", 0.35, stretch("c_g", "b", "stretch", G.MULTI_RATES, True, own), own),
        gated("e", "c", "volume", 0.75, volume("e_g", "c", "volume", own), own),
        gated("f", "e", "noise2", 0.3 / 4, noise("f_g", "e", "noise2"), own)])
    # Each step is read several times by the next one: worked out once.
    return re.sub(r"\b([sabce]) AS \(", r"\1 AS MATERIALIZED (", sql)


@query("G12", "T21", sql=f"""WITH {_multi_sql()}
    {done('f', ", split_part(k, ':', 3)::integer AS channel")}""")
def augmented_multichannel(spark, d):
    rows = fragments(spark, d, 1).select(
        "vec_id", "copy_no", F.array(F.slice("x", 1, 32), F.slice("x", 33, 32)).alias("x"))
    out = G.augment_multi(rows, "x", FS, SEED, key_cols())
    each = out.select("vec_id", "copy_no", F.posexplode_outer("x").alias("channel", "c"))
    return each.select("vec_id", "copy_no", "channel", F.posexplode_outer("c").alias("idx", "value")).withColumn(
        "value", tidy(F.col("value")))


_BATCH_SQL = ", ".join([
    src_sql("s"), absmax("a", "s"),
    gated("b", "a", "noise1", 0.3 / 4, noise("b_g", "a", "noise1")), absmax("b1", "b"),
    gated("c", "b1", "volume", 0.75, volume("c_g", "b1", "volume")), absmax("c1", "c"),
    gated("e", "c1", "eq", 0.25, eq("e_g", "c1", "eq", G.PCG_EQ)), absmax("e1", "e"),
    gated("f", "e1", "noise2", 0.3 / 4, noise("f_g", "e1", "noise2")), absmax("o", "f")])


@query("G13", "H3", sql=f"WITH RECURSIVE {_BATCH_SQL} {done('o')}")
def augmented_batch(spark, d):
    return long(G.augment_batch(fragments(spark, d), "x", FS, SEED, key_cols()))


_LEVELS = L.np.cumprod(1 - L.linear_betas(1e-4, 0.05, 50))


@query("F17", sql=f"""WITH {values_sql("sched", _LEVELS)}, {src_sql('s')},
    lv(step, h) AS (SELECT * FROM sched), o AS (SELECT s.k, idx, sqrt(h) * x + sqrt(1 - h) * {gauss_sql(key('eps', k='s.k', tail=" || ':' || idx"))} AS x
          FROM s JOIN lv ON step = floor({u_sql(key('level', k='s.k'))} * 50)) {done('o')}""")
def noise_level_mixing(spark, d):
    sched = L.noise_levels(L.schedule_table(spark, L.linear_betas(1e-4, 0.05, 50)))
    rows = fragments(spark, d).withColumn("step", pick(50, SEED, "level", *key_cols()).cast("int"))
    out = L.diffuse(rows, sched, "x", SEED, "eps", key_cols())
    return long(out)


@query("F17", sql=f"""WITH {src_sql('s')}, l AS (SELECT *, {u_sql(key('level'))} AS l FROM s),
    o AS (SELECT k, idx, l * x + sqrt(1 - l * l) * {gauss_sql(key('eps', tail=" || ':' || idx"))} AS x FROM l) {done('o')}""")
def continuous_level_mixing(spark, d):
    rows = fragments(spark, d).withColumn("level", unit(SEED, "level", *key_cols()))
    return long(L.diffuse_at(rows, "level", "x", SEED, "eps", key_cols()))
