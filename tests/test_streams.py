import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from pulsegrid.queries import load_all
from pulsegrid.session import scratch_path
from pulsegrid.streaming import operators as X

SCHEMA = "ts TIMESTAMP, k STRING, value DOUBLE, y_true INT, y_pred INT"
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def put(spark, path, rows):
    data = [(T0 + dt.timedelta(minutes=m), k, v, int(v > 0), 1) for m, k, v in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_windows_over_several_batches_and_late_rows(spark):
    src, out, state = (scratch_path(spark, n) for n in ("src", "out", "state"))
    make = lambda: X.sliding_windows(source(spark, src), "ts", ["k"], "20 minutes", "15 minutes", "5 minutes")
    put(spark, src, [(1, "a", 1.0), (16, "a", -4.0), (70, "a", 2.0)])
    X.write_append(make(), out, state).awaitTermination()
    put(spark, src, [(2, "a", 100.0), (120, "a", 3.0)])  # the first row is far behind the watermark
    X.write_append(make(), out, state).awaitTermination()
    got = {int((r.start - dt.datetime(2024, 1, 1)).total_seconds() // 60): (r.n, r.total, r.peak)
           for r in spark.read.parquet(out).collect()}
    assert got[0] == (2, -3.0, 4.0) and got[15] == (1, -4.0, 4.0) and got[60] == (1, 2.0, 2.0)
    assert all(total < 50 for _, total, _ in got.values())


def test_open_windows_come_whatever_the_order_of_files_and_late_rows_are_kept(spark):
    src, out, late = (scratch_path(spark, n) for n in ("src", "out", "late"))
    rows = [(1, "a", 1.0), (16, "a", -4.0), (70, "a", 2.0), (2, "a", 8.0), (120, "b", 3.0), (18, "a", 5.0)]
    for i in (2, 0, 1):
        put(spark, src, rows[2 * i:2 * i + 2])
    make = lambda df: X.sliding_windows(df, "ts", ["k"], "20 minutes", "15 minutes", "1 day")
    X.write_updates(make(source(spark, src)), out, scratch_path(spark, "state")).awaitTermination()
    key = lambda r: (r.start, r.k, r.n, r.total, r.peak)
    got = sorted(map(key, X.latest_updates(spark, out, ["start", "k"]).collect()))
    assert got == sorted(map(key, make(spark.read.schema(SCHEMA).parquet(src)).collect())) and len(got) > 3
    X.write_late(source(spark, src), "ts", "5 minutes", late, scratch_path(spark, "state")).awaitTermination()
    # The files come as they were written: minutes 120 and 18, then 1 and 16, then 70 and 2.
    assert sorted(r.value for r in spark.read.parquet(f"{late}/late").collect()) == [-4.0, 1.0, 2.0, 8.0]


def test_running_confusion_keeps_the_last_state(spark):
    src, out, state = (scratch_path(spark, n) for n in ("src", "out", "state"))
    make = lambda: X.running_confusion(source(spark, src), "ts", ["k"], "1 day", "1 hour")
    for rows in ([(1, "a", 1.0), (2, "a", -1.0)], [(3, "a", 1.0), (4, "b", -1.0)]):
        put(spark, src, rows)
        X.write_updates(make(), out, state).awaitTermination()
    got = {r.k: (r.tp, r.fp, r.accuracy) for r in X.latest_updates(spark, out, ["start", "k"]).collect()}
    assert got["a"] == (2, 1, pytest.approx(2 / 3)) and got["b"] == (0, 1, 0.0)


def test_results_are_ingested_once(spark):
    src, out, state = (scratch_path(spark, n) for n in ("src", "out", "state"))
    for i in range(2):
        spark.range(3).select((F.col("id") + i * 3).alias("run")).write.mode("append").json(src)
        stream = spark.readStream.schema("run BIGINT").json(src)
        X.ingest_results(stream, out, state).awaitTermination()
    assert sorted(r.run for r in spark.read.json(out).collect()) == list(range(6))


@pytest.mark.parametrize("name", ["streamed_windows", "streamed_metrics"])
def test_times_within_half_a_second_of_a_period_count_as_in_the_sql(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute("""CREATE TABLE events AS SELECT row_number() OVER () AS event_id, TIMESTAMP '2024-01-01' + to_hours(h) + to_microseconds(m) AS ts,
        h + m % 2 AS user_id, 'a' AS event_type, 5.0 + h AS value FROM range(0, 49, 4) AS h(h),
        unnest([-1500000, -500001, -500000, -499999, -1, 0, 400000, 500000, 500001]) AS m(m)""")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    query = load_all()[name]
    got = query.run(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({query.sql})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 3
