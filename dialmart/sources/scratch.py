"""Folders for what a query writes and reads back, where all executors see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_BASE: dict[str, str] = {}


def _own_folder(spark: SparkSession) -> str:
    """This application's part of the session's spark.checkpoint.dir; only a local master may do without that setting."""
    base, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not base:
        if app not in _LOCAL_BASE:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            _LOCAL_BASE[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        base = _LOCAL_BASE[app]
    return f"{base.rstrip('/')}/dialmart-exchange/{app}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A new, unused path."""
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df written once and read again, which cuts its lineage and fixes what a second run might draw anew."""
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def clear(spark: SparkSession) -> None:
    """Delete what this application's queries wrote.  Results are lazy and read it, so first write these elsewhere."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(_own_folder(spark))
    if system.get_file_info(root).type == fs.FileType.Directory:
        system.delete_dir(root)
