"""Session defaults and lineage cuts."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; `conf` keys use `_` for `.`."""
    builder = SparkSession.builder.appName("scorelake")
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize `df` in the reliable checkpoint folder of the cluster.

    The folder is `spark.checkpoint.dir`. Only a local session may go without it and gets a private one; elsewhere
    executors could not share that, so it is an error. Reliable checkpoints survive the loss of executors.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or _private_folder(spark, "checkpoint"))
    return df.checkpoint(eager=True)


def _private_folder(spark: SparkSession, name: str) -> str:
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"spark-{name}-")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once, for the few operators that run Python in tasks."""
    context = spark.sparkContext
    if getattr(context, "_scorelake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.parent.is_dir():
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="spark-package-")) / "scorelake"), "zip", root.parent, root.name)
        context.addPyFile(archive)
    context._scorelake_shipped = True


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder every executor can reach: under `spark.checkpoint.dir`, or local where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return _private_folder(spark, name)
