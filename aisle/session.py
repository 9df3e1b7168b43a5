"""Session defaults used by the library's own tests, bench and smoke run."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session; on a cluster the submitted configuration is used instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("aisle")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster, or a scratch one where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        local = spark.sparkContext.master.startswith("local")
        # a relative path lies in the shared default file system of a cluster
        current = tempfile.mkdtemp(prefix="aisle-checkpoint-") if local else "aisle-checkpoint"
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables, shared between executors on a cluster."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/aisle-{name}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Materialise a frame once in the shared checkpoint folder so later steps do not recompute it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep_columns(df, name: str):
    """Write a frame once as compressed columns to the shared checkpoint folder and read it from there.

    For frames of many or wide rows: later steps read only the columns that they use. Order and layout of the
    rows are not kept, as ``cut_lineage`` does.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deliver_package(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once per application."""
    context = spark.sparkContext
    if getattr(context, "_aisle_delivered", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    archive = os.path.join(tempfile.mkdtemp(prefix="aisle-package-"), "aisle.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)
    context._aisle_delivered = True
