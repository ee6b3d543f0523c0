"""Shared-folder tables and small column helpers used by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL_BASE: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see.

    It is the session's spark.checkpoint.dir.  Only a local master may run without that
    setting; it then gets a temporary folder, as in the tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_BASE:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _LOCAL_BASE[app] = "file://" + tempfile.mkdtemp(prefix="dialmart-")
    return _LOCAL_BASE[app]


def new_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below this application's part of the shared folder."""
    return f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/dialmart/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    This cuts the lineage: a lost executor costs the tasks of the next stage, not the whole
    chain, and a table that is read several times is computed once.
    """
    spark = df.sparkSession
    path = new_dir(spark, label)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def named(column: str) -> F.Column:
    """A column by its whole name, whatever signs that holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def carried(df: DataFrame) -> F.Column:
    """All columns of df as one struct, so that no name of theirs meets one of an operator's own."""
    return F.struct(*[named(c) for c in df.columns])


def returned(df: DataFrame, columns: list[str], new: dict[str, F.Column] | None = None, row: str = "row") -> DataFrame:
    """The columns carried in the struct `row`, in their order, and then the new ones.

    A new column takes the place of a carried one of the same name, in whatever case.
    """
    new = new or {}
    taken = {c.lower(): c for c in new}
    old = {c.lower() for c in columns}
    out = [new[taken[c.lower()]].alias(c) if c.lower() in taken else F.col(row).getField(c).alias(c) for c in columns]
    return df.select(*out, *[v.alias(k) for k, v in new.items() if k.lower() not in old])


def line_up(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """rows with rank, a long that counts the rows of the same group before it in the given order.

    group has no nulls.  Rows are dealt by ranges of group and order and numbered within their range; the numbers of
    rows in the ranges before come from a table of a row for each range and group in it.  With an order that tells
    all rows apart no group is too large for a task.
    """
    n = n_partitions(rows.sparkSession)
    dealt = rows.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    dealt = materialize(dealt.withColumn("_number", F.monotonically_increasing_id()), label)
    span = F.shiftright("_number", 33).alias("_range")
    counts = dealt.groupBy(F.col(group).alias("_group"), span).agg(F.count("*").alias("_n"), F.min("_number").alias("_least"))
    earlier = F.sum("_n").over(Window.partitionBy("_group").orderBy("_range")) - F.col("_n")
    before = counts.select("_group", "_range", (earlier - F.col("_least")).alias("_shift"))
    own = (F.col(group) == F.col("_group")) & (F.shiftright("_number", 33) == F.col("_range"))
    return dealt.join(before, own).withColumn("rank", F.col("_number") + F.col("_shift")).drop("_number", "_group", "_range", "_shift")


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables that the operators of this application left in the shared folder.

    Results are lazy and read them, so call this only when all results have been written elsewhere.
    """
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(_own_dir(spark))
    if system.get_file_info(root).type == fs.FileType.Directory:
        system.delete_dir(root)
