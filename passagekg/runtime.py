"""Session helpers: the shared folder, written (lineage-cutting) tables, table readers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent, one is made and registered in local mode (tests, single machine), in which every task shares the
    machine; on a cluster that is an error, as no other folder is known to be shared.
    """
    path = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    if path:
        return path
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{_CHECKPOINT_KEY} is not set: intermediate tables need a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="passagekg-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/passagekg/{name}-{uuid.uuid4().hex}"
    application = spark.sparkContext.applicationId
    if application not in _WRITTEN:  # registered after the session's own handlers, so it runs before them
        atexit.register(_release_at_exit, spark)
    _WRITTEN.setdefault(application, []).append(path)
    return path


def stage_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives executor loss.

    The table is needed as long as a result that reads it; :func:`release` removes all of them, at the latest when the application ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: dict[str, list[str]] = {}  # application -> folders


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables of this application; results that have not been read yet must not be read afterwards."""
    context = spark.sparkContext
    paths = _WRITTEN.pop(context.applicationId, [])
    for path in paths:
        file = context._jvm.org.apache.hadoop.fs.Path(path)
        file.getFileSystem(context._jsc.hadoopConfiguration()).delete(file, True)
    return len(paths)


def _release_at_exit(spark: SparkSession) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            release(spark)
    except Exception:  # the application is gone already
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    context = spark.sparkContext
    if getattr(context, "_passagekg_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="passagekg-")) / "passagekg.zip"  # on the driver only; Spark serves it
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted([*root.rglob("*.py"), *root.rglob("*.txt")]):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._passagekg_shipped = True


def shipped(query: Callable) -> Callable:
    """A query that first makes sure of :func:`ship`."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
