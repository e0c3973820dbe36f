"""Hot keys, equal values and repeated appends: results, and the rows that the largest task gets."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators.joins import measured_join, measured_salts
from pulsegrid.operators.ranking import exact_median, key_value, order_key, rank_median, select_ranks
from pulsegrid.operators.splits import stratified_folds
from pulsegrid.plans import report as R
from pulsegrid.streaming.operators import commit_result_stream


@pytest.fixture
def many_parts(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_key_with_most_rows_is_dealt_to_many_tasks(spark, many_parts):
    rows = spark.range(40000).select("id", F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 997)).alias("patient"))
    side = rows.select("patient").distinct().withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(2))))
    met = measured_join(rows, side, ["patient"], F.col("id"))
    assert met.columns == ["patient", "id", "fold"] and met.count() == 80000 and met.distinct().count() == 80000
    tasks = [r["count"] for r in met.groupBy(F.spark_partition_id().alias("t")).count().collect()]
    assert max(tasks) < 2 * np.median(tasks)
    plain = [r["count"] for r in rows.join(side, "patient").groupBy(F.spark_partition_id().alias("t")).count().collect()]
    assert max(plain) > 10 * np.median(plain)


def test_measured_join_equals_a_plain_one(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else f"k{i % 3}", i % 2) for i in range(200)], "id int, k string, v int")
    side = spark.createDataFrame([("k0", 0, "a"), ("k0", 0, "b"), ("k1", 1, "c"), (None, 0, "d"), ("k9", 1, "e")], "k string, v int, w string")
    for how in ("inner", "left"):
        for on in (["k"], ["k", "v"]):
            other = side if "v" in on else side.drop("v")
            want = rows.join(other, on, how)
            got = measured_join(rows, other, on, F.col("id"), how, parts=5)
            assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert measured_join(rows.limit(0), side, ["k"], F.col("id")).count() == 0
    assert sum(measured_salts(rows, ["k"], 6).values()) <= 16 * 6 + 3
    with pytest.raises(ValueError):
        measured_join(rows, side, ["k"], F.col("id"), "full")


def test_folds_of_one_patient_with_most_records(spark, many_parts):
    labels = spark.range(3000).select(F.concat(F.lit("r"), "id").alias("record_id"), (F.col("id") % 2).cast("int").alias("label"), "id")
    patient = F.when(F.col("id") % 10 > 0, F.lit("one")).otherwise(F.concat(F.lit("p"), "id"))
    got = stratified_folds(labels, 3, patient=patient)
    assert got.count() == 9000 and got.groupBy("patient", "fold").agg(F.count_distinct("subset").alias("n")).where("n > 1").isEmpty()


VALUES = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 1e308, -1e308, float("inf"), float("-inf"), 0.1, -0.1, 2.0 ** 53, math.pi]


def test_order_keys_keep_the_order_and_the_value(spark):
    rows = spark.createDataFrame([(v,) for v in [*VALUES, None, float("nan")]], "v double")
    got = [(r["v"], r["k"]) for r in rows.select("v", order_key(F.col("v")).alias("k")).collect()]
    assert [k for v, k in got if v is None or math.isnan(v)] == [None, None]
    known = [(v, k) for v, k in got if k is not None]
    assert sorted(known, key=lambda p: p[0]) == sorted(known, key=lambda p: (p[0], p[1])) and len({k for _, k in known}) == len(set(VALUES))
    assert sorted(known)[0][0] == float("-inf") and [v for v, _ in sorted(known, key=lambda p: p[1])] == sorted(VALUES)
    assert all(key_value(k) == v for v, k in known)


def test_ranks_are_those_of_sorted_values(spark):
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(size=501).tolist(), "same": [2.5] * 400, "few": [3.0], "two": [1.0, -4.0], "odd": [*VALUES, float("nan")],
            "close": (1.0 + 1e-12 * rng.integers(0, 50, 333)).tolist()}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("none", None), ("a", None)], "k string, v double")
    ranks = {"first": F.lit(1), "third": F.floor(F.col("n") / 3) + 1, "last": F.col("n")}
    for digit in (16, 8):
        got = {(r["k"], r["which"]): r["value"] for r in select_ranks(rows, ["k"], "v", ranks, digit).collect()}
        for k, vs in data.items():
            s = sorted(v for v in vs if not math.isnan(v))
            assert [got[k, w] for w in ranks] == [s[0], s[len(s) // 3], s[-1]]
        assert len(got) == 3 * len(data)
    finite = rows.where("k <> 'odd' AND v IS NOT NULL")
    plain = {r["k"]: r["median"] for r in rank_median(finite, ["k"], "v").collect()}
    assert {r["k"]: r["median"] for r in exact_median(finite, ["k"], "v").collect()} == plain == {k: float(np.median(v)) for k, v in data.items() if k != "odd"}


def test_equal_values_are_no_hot_task(spark, many_parts):
    rows = spark.range(30000).select(F.lit("r").alias("k"), F.when(F.col("id") % 10 > 0, 1.0).otherwise(F.col("id") / 7.0).alias("v"))
    assert exact_median(rows, ["k"], "v").first()["median"] == 1.0


def result_records(spark, n=40, seed=2):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(f"c{i % 3}", i, {"mcc": float(rng.normal()) + 1e6, "accuracy": None if i % 5 == 0 else float(rng.random())}) for i in range(n)],
                                 "run_label string, fold int, fragment struct<mcc double, accuracy double>")


def cells(df):
    return {(r["condition"], r["path"]): (r["n"], r["group_n"], r["mean"], r["std"]) for r in df.collect()}


def test_a_repeated_commit_changes_nothing(spark, tmp_path):
    recs, log = result_records(spark), str(tmp_path)
    for part in (0, 1, 2, 3, 1, 1):
        R.commit_results(recs.where(F.col("fold") % 4 == part), log, R.run_key(spark, "run", part))
    got, want = cells(R.committed_summary(spark, log)), cells(R.summarize(recs))
    assert set(got) == set(want)
    for k, (n, group, mean, std) in want.items():
        assert got[k][:2] == (n, group) and got[k][2] == pytest.approx(mean, rel=1e-12) and got[k][3] == pytest.approx(std, rel=1e-6)
    assert R.run_key(spark, "run", 1) == R.run_key(spark, "run", 1) != R.run_key(spark, "run", 2)


def test_a_replayed_stream_batch_changes_nothing(spark, tmp_path):
    recs, source = result_records(spark), str(tmp_path / "in")
    recs.repartition(3).write.json(source)
    read = lambda: spark.readStream.schema(recs.schema).option("maxFilesPerTrigger", 1).json(source)
    commit_result_stream(read(), str(tmp_path / "log"), str(tmp_path / "c1"), "run").awaitTermination()
    first = cells(R.committed_summary(spark, str(tmp_path / "log")))
    # Another checkpoint: every batch comes again under its number.
    commit_result_stream(read(), str(tmp_path / "log"), str(tmp_path / "c2"), "run").awaitTermination()
    again = cells(R.committed_summary(spark, str(tmp_path / "log")))
    assert first == again and sum(c[0] for k, c in first.items() if k[1] == "fragment.mcc") == 40
