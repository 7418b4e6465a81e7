"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "plumbline", **conf: str) -> SparkSession:
    """A session for tests and local benches; on a cluster pass in the cluster's own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.streaming.stopTimeout", "60s")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` when the cluster names one.

    Only a local master without that setting gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    # local-cluster has executors of its own, like any cluster
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of our own, on whatever store it lies; nothing happens if it is gone."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder of our own; none if it isn't there."""
    files, target = _file_system(spark, folder)
    return sorted(f.getPath().getName() for f in files.listStatus(target)) if files.exists(target) else []


def read_small(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    files, target = _file_system(spark, path)
    stream = files.open(target)
    try:
        return bytearray(stream.readAllBytes()).decode()
    finally:
        stream.close()


def commit_small(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole or not at all: under another name first, then renamed. False if it is there already."""
    files, target = _file_system(spark, path)
    if files.exists(target):
        return False
    files, draft = _file_system(spark, f"{path}.{uuid.uuid4().hex}.draft")
    stream = files.create(draft)
    stream.write(bytearray(text.encode()))
    stream.close()
    if files.rename(draft, target):
        return True
    files.delete(draft, False)
    return False


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file of our own; folders above the target are made."""
    files, to = _file_system(spark, target)
    files.mkdirs(to.getParent())
    if not files.rename(_file_system(spark, source)[1], to):
        raise OSError(f"{source} could not be renamed to {target}")


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so a lost executor costs no recompute."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Cut points that go when the work that needed them is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame, label: str = "stage") -> DataFrame:
        """As ``cut_lineage``, remembered."""
        path = scratch_path(self.spark, label)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        while self.paths:
            remove(self.spark, self.paths.pop())
