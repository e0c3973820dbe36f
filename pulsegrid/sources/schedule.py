"""Training schedules: JSON config with datasets, combined datasets and ordered stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

EVAL = "STRUCT<data: STRING, split: STRING, segment: STRING, augment_num: INT>"
SCHEMA = f"""test_set {EVAL}, valid_set {EVAL},
    datasets MAP<STRING, STRUCT<path: STRING, split: STRING, segment: STRING, gen_data: BOOLEAN,
                                augment_num: INT, proportion: DOUBLE>>,
    combined_datasets MAP<STRING, STRUCT<base_sets: ARRAY<STRING>, proportion: ARRAY<DOUBLE>, augment_num: INT>>,
    schedule ARRAY<STRUCT<key: STRING, epochs: INT, letskip: BOOLEAN, is_cinc: BOOLEAN>>"""


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    """One row per schedule file, with its path in ``file``."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn(
        "file", F.input_file_name())


def datasets(schedule: DataFrame) -> DataFrame:
    """Plain datasets: ``file, key, path, split, segment, gen_data, augment_num, proportion``."""
    rows = schedule.select("file", F.explode("datasets").alias("key", "d")).select("file", "key", "d.*")
    return rows.withColumn("proportion", F.coalesce("proportion", F.lit(1.0)))


def combined(schedule: DataFrame) -> DataFrame:
    """Base sets of combined datasets with their proportions; copies default to the least of the bases."""
    rows = schedule.select("file", F.explode("combined_datasets").alias("key", "c"))
    each = rows.select("file", "key", F.col("c.augment_num").alias("__own"), F.posexplode(
        F.arrays_zip(F.col("c.base_sets").alias("base"), F.col("c.proportion").alias("p"))).alias("pos", "z"))
    base = datasets(schedule).withColumnRenamed("key", "base_set").drop("proportion")
    joined = each.select("file", "key", "pos", "__own", F.col("z.base").alias("base_set"),
                         F.col("z.p").alias("proportion")).join(base, ["file", "base_set"], "left")
    least = joined.groupBy("file", "key").agg(F.min("augment_num").alias("__least"))
    return (joined.drop("augment_num").join(least, ["file", "key"])
            .withColumn("augment_num", F.coalesce("__own", "__least")).drop("__own", "__least"))


def stages(schedule: DataFrame) -> DataFrame:
    rows = schedule.select("file", F.posexplode("schedule").alias("stage", "s"))
    return rows.select("file", "stage", "s.key", "s.epochs",
                       F.coalesce("s.letskip", F.lit(False)).alias("letskip"))


def resolved_stages(schedule: DataFrame) -> DataFrame:
    """Stages in order with the sets they draw from: one row per base set for combined sets."""
    cols = ["file", "key", "base_set", "path", "split", "segment", "gen_data", "augment_num", "proportion"]
    plain = datasets(schedule).withColumn("base_set", F.col("key"))
    sets = plain.select(*cols).unionByName(combined(schedule).select(*cols))
    return stages(schedule).join(sets, ["file", "key"])


def paths(schedule: DataFrame) -> DataFrame:
    """All data, split and segment paths of the evaluation sets and plain datasets."""
    ends = [schedule.select("file", F.lit(s).alias("key"), f"{s}.data", f"{s}.split", f"{s}.segment")
            for s in ("test_set", "valid_set")]
    plain = datasets(schedule).select("file", "key", F.col("path").alias("data"), "split", "segment")
    rows = reduce(DataFrame.unionByName, [*ends, plain])
    return rows.unpivot(["file", "key"], ["data", "split", "segment"], "kind", "path")


def eval_sets(schedule: DataFrame) -> DataFrame:
    parts = [schedule.select("file", F.lit(s).alias("part"), f"{s}.*") for s in ("test_set", "valid_set")]
    return parts[0].unionByName(parts[1]).withColumn("augment_num", F.coalesce("augment_num", F.lit(0)))


def violations(schedule: DataFrame) -> DataFrame:
    """Everything that makes a schedule invalid, as ``file, key, problem``."""
    plain = datasets(schedule)
    mixed = schedule.select("file", F.explode("combined_datasets").alias("key", "c"))
    bases = mixed.select("file", "key", F.explode("c.base_sets").alias("base"))
    shares = mixed.select("file", "key", F.explode("c.proportion").alias("proportion"))
    named = plain.select("file", F.col("key").alias("base"))
    all_keys = plain.select("file", "key").unionByName(mixed.select("file", "key"))
    off = (F.col("proportion") < 0) | (F.col("proportion") > 1)
    say = lambda df, problem: df.select("file", "key", F.lit(problem).alias("problem")).distinct()
    return reduce(DataFrame.unionByName, [
        say(plain.where(F.col("augment_num") < 0), "augment_num must not be negative"),
        say(mixed.where(F.col("c.augment_num") < 0), "augment_num must not be negative"),
        say(plain.where(off), "proportion must be in [0, 1]"),
        say(shares.where(off), "proportion must be in [0, 1]"),
        say(bases.join(named, ["file", "base"], "left_anti"), "unknown base set"),
        say(stages(schedule).join(all_keys, ["file", "key"], "left_anti"), "unknown dataset in a stage")])


def unused_fields(schedule: DataFrame) -> DataFrame:
    """Fields that are set but have no effect on a run: per stage, and copies of the validation set."""
    rows = schedule.select("file", F.explode("schedule").alias("s"))
    say = lambda df, name: df.select("file", F.lit(name).alias("field"))
    return reduce(DataFrame.unionByName, [
        say(rows.where(F.col("s.letskip").isNotNull()), "letskip"),
        say(rows.where(F.col("s.is_cinc").isNotNull()), "is_cinc"),
        say(schedule.where(F.col("valid_set.augment_num").isNotNull()), "valid_set.augment_num"),
    ]).groupBy("file", "field").agg(F.count(F.lit(1)).alias("n"))


def check(schedule: DataFrame) -> DataFrame:
    """The schedule itself; raises with all problems (the rows of ``violations``) if there are any."""
    found = violations(schedule).orderBy("file", "key", "problem").collect()
    if found:
        raise ValueError("invalid schedule: " + "; ".join(f"{r.key}: {r.problem}" for r in found))
    return schedule
