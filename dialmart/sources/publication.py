"""Tables that are published as a whole: rows first, in a folder of their own, then a manifest that names it.

Readers follow manifests only.  A writer that dies before its manifest leaves rows that nobody reads; two writers write two
folders and two manifests, and neither sees half of the other.  A manifest is one file of one row, moved into place
by the writer's commit, so it is there or it is not.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "artifact string, run string, published_at timestamp, folder string, rows long, versions map<string,string>"


def publish(df: DataFrame, root: str, artifact: str, run: str, versions: Mapping[str, str] | None = None) -> str:
    """Write df below root and then its manifest; the folder of the rows.

    versions says what made the rows (code, rubric, prompt, model).
    """
    folder = f"{root}/rows/{artifact}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    _announce(df.sparkSession, root, artifact, run, folder, versions or {})
    return folder


def _announce(spark: SparkSession, root: str, artifact: str, run: str, folder: str, versions: Mapping[str, str]) -> None:
    rows = spark.read.parquet(folder).count()
    one = spark.range(1).select(
        F.lit(artifact).alias("artifact"), F.lit(run).alias("run"), F.current_timestamp().alias("published_at"), F.lit(folder).alias("folder"), F.lit(rows).cast("long").alias("rows"),
        F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in versions.items()]).cast("array<struct<k:string,v:string>>")).alias("versions"),
    )
    one.coalesce(1).write.mode("append").json(f"{root}/manifests")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """All manifests below root; none, and no error, where nothing was published yet."""
    try:
        return spark.read.schema(MANIFEST).json(f"{root}/manifests")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def _folders(spark: SparkSession, root: str, artifact: str) -> list[tuple[str, str]]:
    """(run, folder) of an artifact's manifests, oldest first; a few for each run."""
    rows = manifests(spark, root).where(F.col("artifact") == artifact).orderBy("published_at", "run", "folder")
    return [(r.run, r.folder) for r in rows.select("run", "folder").collect()]


def newest(spark: SparkSession, root: str, artifact: str) -> DataFrame | None:
    """The rows that were published last, or None."""
    found = _folders(spark, root, artifact)
    return spark.read.parquet(found[-1][1]) if found else None


def every_row(spark: SparkSession, root: str, artifact: str) -> DataFrame | None:
    """The rows of all manifests with _run and _order (of its manifest, from 0), or None."""
    found = _folders(spark, root, artifact)
    if not found:
        return None
    rows = spark.read.option("mergeSchema", True).parquet(*[folder for _, folder in found])
    named = spark.createDataFrame([(folder.rstrip("/").rpartition("/")[2], run, k) for k, (run, folder) in enumerate(found)], "_folder string, _run string, _order int")
    own = F.regexp_extract(F.col("_metadata.file_path"), r"/rows/([^/]+)/", 1)
    return rows.withColumn("_folder", own).join(F.broadcast(named), "_folder").drop("_folder")  # a row for each manifest


def by_key(spark: SparkSession, root: str, artifact: str, key: Sequence[str], last: bool = True) -> DataFrame | None:
    """One row for each key with the run that it is of: the row published last, or first."""
    rows = every_row(spark, root, artifact)
    if rows is None:
        return None
    order = F.desc("_order") if last else F.asc("_order")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place", "_order").withColumnRenamed("_run", "run")
