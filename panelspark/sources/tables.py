"""Tables in the folder that driver and executors share (spark.checkpoint.dir): what is read more than once is written
once, which also cuts the lineage and survives lost executors."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def application_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder. On one machine, as in tests, one is made where none is set."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="panelspark-shared-")
        sc.setCheckpointDir(root)
    root = re.sub("^(file:)?/+", "file:///", root.rstrip("/"))  # local paths as URIs that pyarrow reads, too
    return f"{root}/panelspark-{sc.applicationId}"


def shared_folder(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{application_folder(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = f"{folder}/{uuid.uuid4().hex}" if folder else shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def remove_tables(spark: SparkSession) -> None:
    """Removes all tables that were written for this application. Results that are not yet written out are read from
    them: call it when the results of all queries are."""
    remove_folder(spark, application_folder(spark))


def cached(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that folder holds under key, which is made and written where there is none. A writer that was lost
    leaves no mark of success, and its table is made anew."""
    path = f"{folder.rstrip('/')}/{key}"
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def file_state(spark: SparkSession, *paths: str) -> str:
    """A key of files or folders as they are now: 16 hex digits of their paths, sizes, numbers of files and times."""
    said = []
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        sizes = fs.getContentSummary(at)
        said.append(f"{fs.makeQualified(at)}:{sizes.getLength()}:{sizes.getFileCount()}:{fs.getFileStatus(at).getModificationTime()}")
    return hashlib.sha256("\n".join(said).encode()).hexdigest()[:16]


def settings_key(settings: dict) -> str:
    """16 hex digits of the settings' JSON, keys in order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


class Scratch:
    """Tables that only the steps up to a written result need; remove() removes them all."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, shared_folder(spark)

    def written(self, df: DataFrame) -> DataFrame:
        return written(df, self.folder)

    def remove(self) -> None:
        remove_folder(self.spark, self.folder)
