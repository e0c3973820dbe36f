"""Long records. Stand-in: the events of a user in time order are the samples of one record."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.numeric import tidy
from pulsegrid.operators import blocks as K
from pulsegrid.operators import normalise as N
from pulsegrid.operators import repair as R
from pulsegrid.operators import windows as W
from pulsegrid.operators.ranking import sample_index
from pulsegrid.queries import query, table

# The stand-in records have 49-99 samples, so blocks are short here to have several per record.
BLOCK = 32
KEY = ["record_id"]

SIG_SQL = """
sig AS (SELECT cast(user_id AS varchar) AS record_id,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
               value AS x, event_id, event_type
        FROM events)
"""


def samples(spark, d, *extra):
    rows = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("record_id"), "ts", "event_id", "value", *extra)
    return sample_index(rows, "record_id", "ts", "event_id").drop("ts")


def blocks(spark, d, block=BLOCK):
    return K.to_blocks(samples(spark, d), block, KEY)


def flat(block_rows, block=BLOCK, places=6):
    return K.to_samples(block_rows, block, KEY).withColumn("value", tidy(F.col("value"), places))


def out_sql(expr: str, src: str, places: int = 6) -> str:
    return f"SELECT record_id, idx, round({expr}, {places}) + 0.0 AS value FROM {src}"


@query("T13", sql=f"WITH {SIG_SQL} SELECT record_id, idx, event_id, x AS value FROM sig")
def sample_positions(spark, d):
    return samples(spark, d).select("record_id", "idx", "event_id", "value")


@query("W4", "T7", sql=f"""WITH {SIG_SQL},
    gap AS (SELECT record_id, idx, CASE WHEN event_id % 10 <> 0 THEN x END AS x FROM sig),
    near AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN idx END IGNORE NULLS) OVER p AS ia,
        last_value(x IGNORE NULLS) OVER p AS xa,
        first_value(CASE WHEN x IS NOT NULL THEN idx END IGNORE NULLS) OVER f AS ib,
        first_value(x IGNORE NULLS) OVER f AS xb FROM gap
        WINDOW p AS (PARTITION BY record_id ORDER BY idx),
               f AS (PARTITION BY record_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    """ + out_sql("""CASE WHEN x IS NOT NULL THEN x WHEN xa IS NULL THEN xb WHEN xb IS NULL THEN xa
        ELSE xa + (xb - xa) * (idx - ia) / (ib - ia) END""", "near"))
def filled_gaps(spark, d):
    gap = samples(spark, d).select(
        "record_id", "idx", F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("value"))
    return flat(R.fill_gaps(K.to_blocks(gap, 16, KEY), 16, KEY), 16)


@query("F1", sql=f"""WITH {SIG_SQL},
    c AS (SELECT *, x - avg(x) OVER (PARTITION BY record_id) AS y FROM sig),
    p AS (SELECT *, max(abs(y)) OVER (PARTITION BY record_id) AS peak FROM c)
    """ + out_sql("CASE WHEN peak > 0 THEN y / peak ELSE y END", "p"))
def abs_max_normalised(spark, d):
    return flat(N.abs_max(blocks(spark, d), KEY))


@query("F2", sql=f"""WITH {SIG_SQL}, r AS (SELECT *, min(x) OVER w AS lo, max(x) OVER w AS hi FROM sig
    WINDOW w AS (PARTITION BY record_id))
    """ + out_sql("CASE WHEN hi <= lo THEN 0.0 ELSE (x - lo) / (hi - lo) * 2 - 1 END", "r"))
def min_max_normalised(spark, d):
    return flat(N.min_max(blocks(spark, d), keys=KEY))


@query("F3", "T2", sql=f"""WITH {SIG_SQL}
    """ + out_sql("""(x - avg(x) OVER (PARTITION BY record_id))
        / (stddev_pop(x) OVER (PARTITION BY record_id) + 1e-8)""", "sig"))
def z_scores(spark, d):
    return flat(N.z_score(blocks(spark, d), KEY))


@query("K1", "F4", "T22", sql=f"""WITH {SIG_SQL},
    k AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY x) AS a,
                 row_number() OVER (PARTITION BY record_id ORDER BY x DESC) AS b FROM sig),
    r AS (SELECT record_id, avg(x) FILTER (a <= 3) AS lo, avg(x) FILTER (b <= 3) AS hi
          FROM k GROUP BY record_id)
    """ + out_sql("CASE WHEN hi <= lo THEN 0.0 ELSE -1 + (x - lo) / (hi - lo) * 2 END",
                  "sig JOIN r USING (record_id)"))
def k_peak_normalised(spark, d):
    return flat(N.k_peak(blocks(spark, d), 3, keys=KEY))


@query("W1", "T8", "T9", sql=f"""WITH {SIG_SQL},
    n AS (SELECT record_id, count(*) AS n FROM sig GROUP BY record_id),
    w AS (SELECT record_id, n, k AS win_no, 3 + k * 12 AS start_idx
          FROM n, unnest(range(0, greatest(0, n - 16 - 3) // 12 + 1)) AS r(k) WHERE n > 3)
    SELECT w.record_id, win_no, start_idx, pos, coalesce(x, 0.0) AS value,
           cast(least(16, n - start_idx) AS integer) AS valid_len
    FROM w CROSS JOIN range(0, 16) AS p(pos)
    LEFT JOIN sig ON sig.record_id = w.record_id AND sig.idx = start_idx + pos""")
def overlapping_windows(spark, d):
    w = W.windows(blocks(spark, d), BLOCK, start=3, win=16, hop=12, keys=KEY)
    return w.select("record_id", "win_no", "start_idx", "valid_len",
                    F.posexplode_outer("waveform").alias("pos", "value"))


@query("W2", "W1", sql="""
    WITH p AS (SELECT doc_id, n_chars AS n, round_even(0.3 * 125, 0)::bigint AS start,
        round_even(CASE WHEN lang = 'de' THEN 2.0 ELSE 4.0 END * 125, 0)::bigint AS win,
        round_even((CASE WHEN lang = 'de' THEN 2.0 ELSE 4.0 END - 0.25) * 125, 0)::bigint AS hop
        FROM documents)
    SELECT doc_id, start, win, hop, CASE WHEN n <= start THEN 0
        ELSE 1 + greatest(0, n - win - start) // hop END AS n_windows FROM p""")
def preset_window_counts(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", "n_chars", F.when(F.col("lang") == "de", "vest").when(F.col("lang") == "en", "cinc")
        .otherwise(F.col("lang")).alias("dataset"))
    rows = docs.select("doc_id", "n_chars", *W.preset_columns(F.col("dataset"), 125))
    return rows.select("doc_id", "start", "win", "hop", W.window_count(
        F.col("n_chars"), F.col("start"), F.col("win"), F.col("hop")).alias("n_windows"))


CENTRED_SQL = f"""{SIG_SQL},
    cen AS (SELECT record_id, idx, x - 10 AS x, idx // 16 AS win, idx % 16 AS pos FROM sig),
    crs AS (SELECT *, coalesce(abs(sign(lead(x) OVER (PARTITION BY record_id, win ORDER BY idx)) - sign(x)) > 1,
                               false) AS crossing FROM cen)"""


def centred(spark, d):
    return samples(spark, d).select("record_id", "idx", (F.col("value") - 10).alias("value"))


@query("W5", sql=f"WITH {CENTRED_SQL} SELECT record_id, win, pos FROM crs WHERE crossing")
def sign_changes(spark, d):
    return R.sign_changes(centred(spark, d), 16, KEY).where("crossing").select("record_id", "win", "pos")


@query("W6", sql=f"""WITH {CENTRED_SQL},
    pk AS (SELECT *, first_value(pos) OVER (PARTITION BY record_id, win ORDER BY abs(x) DESC, pos) AS peak FROM crs)
    SELECT record_id, win, peak,
        coalesce(max(pos + 1) FILTER (crossing AND pos < peak), 0) AS start,
        coalesce(min(pos) FILTER (crossing AND pos >= peak), max(pos)) AS stop
    FROM pk GROUP BY record_id, win, peak""")
def spike_bounds(spark, d):
    return R.spike_bounds(centred(spark, d), 16, KEY)


@query("A12", "T6", sql=f"""WITH {CENTRED_SQL},
    m AS (SELECT record_id, win, max(abs(x)) AS maa FROM cen GROUP BY ALL)
    SELECT record_id, round(median(maa), 6) + 0.0 AS median_maa FROM m GROUP BY record_id""")
def window_peak_medians(spark, d):
    w = K.to_blocks(centred(spark, d), 16, KEY)
    m = R.peak_medians(w, KEY)
    return m.select("record_id", tidy(F.col("median_maa")).alias("median_maa"))


def despike_sql(name: str, src: str, win: int, threshold: float = 3.0, rounds: int = 1000, key: str = "record_id") -> str:
    """Rounds of flattening as a recursion over the full windows of a record: ``{name}_end(w, stuck)`` and the signal ``{name}``."""
    return f"""{name}_n AS (SELECT {key}, count(*) AS n FROM {src} GROUP BY {key}),
    {name}_w AS (SELECT {key}, idx // {win} AS win, list(x ORDER BY idx) AS v FROM {src} JOIN {name}_n USING ({key})
        WHERE idx < n // {win} * {win} GROUP BY ALL),
    {name}_st({key}, r, w, going, stuck) AS (
        SELECT {key}, 0, list(v ORDER BY win), true, false FROM {name}_w GROUP BY {key}
        UNION ALL
        SELECT {key}, r + 1, CASE WHEN loud THEN list_transform(w, lambda y, i: CASE WHEN i = k THEN new ELSE y END) ELSE w END,
            loud AND new <> x AND r + 1 < {rounds}, loud AND (new = x OR r + 1 = {rounds})
        FROM (SELECT *, list_transform(x, lambda y, j: CASE WHEN j - 1 >= low AND j - 1 < high THEN 1e-4 ELSE y END) AS new
          FROM (SELECT *, coalesce(list_max(list_filter(flips, lambda f: f < peak)) + 1, 0) AS low,
                coalesce(list_min(list_filter(flips, lambda f: f >= peak)), len(x) - 1) AS high
            FROM (SELECT *, list_position(list_transform(x, lambda y: abs(y)), top) - 1 AS peak,
                  list_filter(range(0, len(x) - 1), lambda f: abs(sign(x[f + 2]) - sign(x[f + 1])) > 1) AS flips
              FROM (SELECT *, w[k] AS x FROM (
                SELECT *, list_max(maa) AS top, list_position(maa, list_max(maa)) AS k,
                    list_median(maa) <> 0 AND list_max(maa) > {threshold} * list_median(maa) AS loud
                FROM (SELECT *, list_transform(w, lambda y: list_max(list_transform(y, lambda z: abs(z)))) AS maa
                  FROM {name}_st WHERE going))))))),
    {name}_end AS (SELECT {key}, arg_max(w, r) AS w, arg_max(stuck, r) AS stuck FROM {name}_st GROUP BY {key}),
    {name} AS (SELECT s.{key}, idx, CASE WHEN idx < n // {win} * {win} THEN e.w[idx // {win} + 1][idx % {win} + 1] ELSE s.x END AS x
        FROM {src} s JOIN {name}_n USING ({key}) LEFT JOIN {name}_end e USING ({key}))"""


@query("W7", "T10", sql=f"""WITH RECURSIVE {CENTRED_SQL}, {despike_sql("flat", "cen", 8)}
    SELECT record_id, idx // 8 AS block, coalesce(any_value(changed AND stuck), false) AS unresolved, round(sum(abs(x)), 6) + 0.0 AS mass
    FROM (SELECT f.*, e.stuck, coalesce(e.w[idx // 8 + 1] <> o.w[idx // 8 + 1], false) OR coalesce(e.stuck AND idx // 8 + 1 = list_position(
              list_transform(e.w, lambda y: list_max(list_transform(y, lambda z: abs(z)))),
              list_max(list_transform(e.w, lambda y: list_max(list_transform(y, lambda z: abs(z)))))), false) AS changed
          FROM flat f LEFT JOIN flat_end e USING (record_id)
          LEFT JOIN (SELECT record_id, w FROM flat_st WHERE r = 0) o USING (record_id))
    GROUP BY record_id, idx // 8""")
def spikes_removed(spark, d):
    win = 8
    w = K.to_blocks(centred(spark, d), win, KEY)
    out = R.remove_spikes(w, win, keys=KEY)
    return out.select("record_id", "block", "unresolved",
                      tidy(F.aggregate("values", F.lit(0.0), lambda a, x: a + F.abs(x))).alias("mass"))
