"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "pulsegrid", **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; cluster settings win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # A block row holds up to 4096 doubles: 512 rows are about 16 MB per Arrow batch.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session without the setting gets a folder of its own; elsewhere a missing
    setting is an error, because a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_SETTING, None) or getattr(context, "_pulsegrid_scratch", None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_SETTING} must name a shared folder on a cluster")
        root = context._pulsegrid_scratch = tempfile.mkdtemp(prefix="pulsegrid-")
        context.setCheckpointDir(root)
    return root


def _own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder: other jobs that share it are never touched."""
    return f"{scratch_root(spark).rstrip('/')}/pulsegrid/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused path below this application's part of the shared scratch folder."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def shared_path(spark: SparkSession, name: str) -> str:
    """The path of this name in the shared folder, the same in every session; ``clear_scratch`` leaves it."""
    return f"{scratch_root(spark).rstrip('/')}/pulsegrid-{name}"


def _file(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, wherever Spark can reach it."""
    system, place = _file(spark, path)
    return bool(system.exists(place))


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has written as scratch; for the end of a job, once its results are stored."""
    system, place = _file(spark, _own_folder(spark))
    system.delete(place, True)


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: survives the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_pulsegrid_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="pulsegrid-pkg-"), "pulsegrid")
    context.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(home), "pulsegrid"))
    context._pulsegrid_shipped = True
