"""Folders that driver and executors share, and files there through the store's own interface."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new path below spark.checkpoint.dir, deleted when the driver's Python ends; only in local mode, where none may be set, below a local one."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="granary-")
        sc.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/granary-{kind}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(lambda: [delete(*x) for x in ((s, p) for p, s in list(_made.items()))])
    _made[path] = spark
    return path


def file_system(spark: SparkSession, path: str):
    """The store of a path, and the path as its interface takes it."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its store's scheme, as Spark names files, special characters encoded."""
    fs, p = file_system(spark, path)
    return fs.makeQualified(p).toUri().toString()


def delete(spark: SparkSession, path: str) -> None:
    try:
        fs, p = file_system(spark, path)
        fs.delete(p, True)
    except Exception:  # the session may be gone; the folder then goes with the cluster's shared folder
        return
    _made.pop(path, None)


def written(df: DataFrame, kind: str) -> DataFrame:
    """df as a Parquet table in the shared folder: what reads it doesn't plan or run df again."""
    path = shared_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
