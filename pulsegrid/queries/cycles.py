"""Cycles. Stand-in: the clicks of a user are the cut points of the record."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.functions.numeric import tidy
from pulsegrid.operators import blocks as K
from pulsegrid.operators import cycles as Y
from pulsegrid.operators.spectra import MelSpec
from pulsegrid.plans import generator_items as P
from pulsegrid.queries import query
from pulsegrid.queries.sampling import u_sql
from pulsegrid.queries.signals import BLOCK, SIG_SQL, samples
from pulsegrid.session import cut_lineage, scratch_path

CUT_SQL = f"""{SIG_SQL},
len AS (SELECT record_id, count(*) AS n FROM sig GROUP BY record_id),
cuts AS (SELECT record_id, idx AS cut FROM sig WHERE event_type = 'click' AND idx > 0),
cyc AS (SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY cut) - 1 AS cycle_no, cut AS start_idx,
    lead(cut) OVER (PARTITION BY record_id ORDER BY cut) AS end_idx FROM cuts),
cycles AS (SELECT *, count(*) OVER (PARTITION BY record_id) AS cycles FROM cyc WHERE end_idx IS NOT NULL)
"""


def files(spark, d):
    """Segmentation files, several per record, each with the clicks of one day."""
    rows = samples(spark, d, "event_type", F.date_trunc("day", "ts").alias("day"))
    path = scratch_path(spark, "cycles")
    rows.groupBy("record_id", "day").agg(
        F.collect_list(F.when(F.col("event_type") == "click", F.array("idx", F.col("idx") + 1))).alias("segments"),
        F.max("idx").alias("last_index"), F.lit(1000.0).alias("fs")).drop("day").write.json(path)
    return Y.read_cycles(spark, path)


def indexed(spark, d):
    """The stand-in records, numbered once for the several uses below."""
    return cut_lineage(samples(spark, d, "event_type"), "samples")


def signals(rows):
    return K.to_blocks(rows.withColumn("channel", F.lit("pcg")), BLOCK)


def found(rows):
    cuts = rows.where((F.col("event_type") == "click") & (F.col("idx") > 0)).select(
        "record_id", F.col("idx").alias("cut"))
    lengths = rows.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))
    return cuts, lengths, Y.split_cycles(cuts, lengths, span=16)


@query("S12", "U4", sql=f"WITH {CUT_SQL} SELECT record_id, round_even(cut * 1500.0 / 1000, 0)::bigint AS cut FROM cuts")
def cycle_cut_points(spark, d):
    return Y.cut_points(files(spark, d), 1500.0)


@query("J6", sql=f"""WITH {CUT_SQL}
    SELECT record_id, n, count(cut) AS n_cuts FROM len LEFT JOIN
      (SELECT * FROM cuts WHERE cut > 40) USING (record_id) GROUP BY ALL""")
def records_with_cycles(spark, d):
    cuts, lengths, _ = found(indexed(spark, d))
    per = cuts.where(F.col("cut") > 40).groupBy("record_id").agg(F.count(F.lit(1)).alias("n_cuts"))
    return lengths.join(per, "record_id", "left").withColumn("n_cuts", F.coalesce("n_cuts", F.lit(0)))


@query("W8", "T20", sql=f"WITH {CUT_SQL} SELECT record_id, cycle_no, start_idx, end_idx, cycles FROM cycles")
def cycle_intervals(spark, d):
    return found(indexed(spark, d))[2]


@query("T20", "W8", sql=f"""WITH {CUT_SQL}
    SELECT record_id, n - coalesce(sum(end_idx - start_idx), 0)::bigint AS dropped
    FROM len LEFT JOIN cycles USING (record_id) GROUP BY record_id, n""")
def dropped_samples(spark, d):
    _, lengths, cycles = found(indexed(spark, d))
    return Y.dropped_samples(cycles, lengths)


@query("W8", sql=f"""WITH {CUT_SQL}
    SELECT record_id, cycle_no, count(*) AS n, round(sum(x), 6) + 0.0 AS mass
    FROM cycles JOIN sig USING (record_id) WHERE idx >= start_idx AND idx < end_idx GROUP BY ALL""")
def cycle_samples(spark, d):
    rows = indexed(spark, d)
    bodies = Y.cycle_bodies(found(rows)[2], signals(rows), BLOCK)
    return bodies.select("record_id", "cycle_no", F.size("values").cast("long").alias("n"),
                         tidy(A.total(F.col("values"))).alias("mass"))


_SIZES = [f"(floor({u_sql(f'''{chr(39)}6:size:{j}:{chr(39)} || record_id''')} * 4) + 1)::bigint" for j in range(5)]


@query("W9", sql=f"""WITH {CUT_SQL},
    sz AS (SELECT record_id, {_SIZES[0]} AS e0, {_SIZES[0]} + {_SIZES[1]} AS e1, {_SIZES[0]} + {_SIZES[1]} + {_SIZES[2]} AS e2,
        {_SIZES[0]} + {_SIZES[1]} + {_SIZES[2]} + {_SIZES[3]} AS e3, {' + '.join(_SIZES)} AS e4 FROM len),
    g AS (SELECT c.*, CASE WHEN {u_sql("'6:single:' || record_id")} < 0.5 THEN cycle_no ELSE cycle_no // e4 * 5 +
        CASE WHEN cycle_no % e4 < e0 THEN 0 WHEN cycle_no % e4 < e1 THEN 1 WHEN cycle_no % e4 < e2 THEN 2
             WHEN cycle_no % e4 < e3 THEN 3 ELSE 4 END END AS grp FROM cycles c JOIN sz USING (record_id))
    SELECT record_id, cycle_no, CASE WHEN cycles < 2 THEN cycle_no
        WHEN {u_sql("'6:contiguous:' || record_id")} <= 0.4
        THEN (cycle_no - floor({u_sql("'6:start:' || record_id")} * cycles)::bigint + cycles) % cycles
        ELSE row_number() OVER (PARTITION BY record_id ORDER BY md5('6:group:' || record_id || ':' || grp), cycle_no) - 1
        END AS pos FROM g""")
def rearranged_cycles(spark, d):
    return Y.rearrange(found(indexed(spark, d))[2], 6, 0.4).select("record_id", "cycle_no", "pos")


@query("W10")
def rebuilt_signals(spark, d):
    rows = indexed(spark, d)
    order = cut_lineage(Y.rearrange(found(rows)[2], 6, 0.4), "order")
    bodies = Y.cycle_bodies(Y.needed_cycles(order, 48, 2), signals(rows), BLOCK)
    out = Y.rebuild(bodies, 48, 2)
    return out.select("record_id", F.size("values").alias("n"), tidy(A.total(F.col("values"))).alias("mass"))


@query("F16")
def generator_items(spark, d):
    rows = indexed(spark, d)
    cuts, _, _ = found(rows)
    mel = MelSpec(fs=1000, n_fft=16, hop=4, n_mels=4)
    out = P.items(signals(rows), BLOCK, cuts, mel, frames=12, seed=6, fade_samples=2, ramp=8)
    return out.select("record_id", "channel", "rebuilt", F.size("values").alias("n"), F.size("mel").alias("frames"),
                      tidy(A.total(F.col("values"))).alias("mass"), tidy(A.total(F.flatten("mel"))).alias("mel_mass"),
                      tidy(A.total(F.col("chirp"))).alias("chirp_mass"))
