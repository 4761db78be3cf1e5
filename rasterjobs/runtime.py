"""Where jobs keep intermediate tables, and how executors find this package."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Workspaces by application.
_WORKSPACES: dict[str, str] = {}
_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Let Python workers on the same file system import this package.

    On a cluster the package comes with ``--py-files`` or an installed wheel; the path is then harmless.
    """
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, _ROOT])


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. In local mode a temporary one is set where the session names none; a cluster must name it."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="rasterjobs-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def workspace(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it goes when the driver's JVM ends, with all tables that jobs left in it."""
    app = spark.sparkContext.applicationId
    if app not in _WORKSPACES:
        path = f"{shared_dir(spark)}/rasterjobs-{app}-{uuid.uuid4().hex[:8]}"
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _WORKSPACES[app] = path
    return _WORKSPACES[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def snapshot(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._snapshot_path = path  # for drop()
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the files of snapshots that no later step reads."""
    for df in frames:
        path = getattr(df, "_snapshot_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
            df._snapshot_path = None
