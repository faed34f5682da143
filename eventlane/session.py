"""Session settings the library relies on."""

from __future__ import annotations

import importlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# JSON objects with repeated keys keep the last value instead of failing, and
# all epoch arithmetic is done in UTC.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


# The keyed streams need this state store; changed only from Spark's default.
_STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)

# Methods above 8000 bytes are never compiled by the JVM; such stages run faster
# on split, compilable projections. Changed only where it is at its default.
_METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "65535", "8000")

# Spark cuts a ranking of the first N rows of a group before the shuffle only up
# to this N; the cut is as right for any other. Changed only from Spark's default.
_GROUP_LIMIT = ("spark.sql.optimizer.windowGroupLimitThreshold", "1000", str((1 << 31) - 1))

_shipped: set[tuple[str, str]] = set()


def prepare(spark: SparkSession, *packages: str) -> SparkSession:
    """Apply the required settings and make the packages importable in tasks."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, default, better in (_METHOD_LIMIT, _STATE_STORE, _GROUP_LIMIT):
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, better)
    for package in ("eventlane", *packages):
        ship(spark, package)
        _expose(spark, package)
    return spark


def _expose(spark: SparkSession, package: str) -> None:
    """Put a package on the path of the Python processes that the driver starts for streams."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(importlib.import_module(package).__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def ship(spark: SparkSession, package: str) -> None:
    """Send a package to the executors as a zip, once per application."""
    mark = (spark.sparkContext.applicationId, package)
    if mark in _shipped:
        return
    root = os.path.dirname(os.path.abspath(importlib.import_module(package).__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), f"{package}.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join(package, os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(mark)


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for staged tables and reliable checkpoints.

    A cluster names a folder that all executors share in
    ``spark.checkpoint.dir``. Only a local session, where all tasks run on this
    machine, gets a temporary folder if none is named.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    named = named or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="eventlane-ckpt-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged folder that is no longer read."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there, in whichever file system the path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly in a folder; none where it is missing."""
    if not exists(spark, path):
        return []
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return [f.getPath().getName() for f in found if f.isDirectory()]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    For a narrow result that several later steps read: it is computed once,
    the steps read only the columns they need, and a lost executor costs a
    re-read instead of a recomputation.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
