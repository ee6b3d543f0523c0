from __future__ import annotations

import random

from pyarrow import fs
from pyspark.sql import functions as F

from dialmart.llm import common


def test_tables_in_the_shared_folder_can_be_cleared(spark):
    df = common.materialize(spark.range(5).withColumnRenamed("id", "x"), "probe")
    assert df.count() == 5 and df.columns == ["x"]
    system, root = fs.FileSystem.from_uri(f"{common.shared_dir(spark)}/dialmart")
    other = f"{root}/another-application/table"
    system.create_dir(other, recursive=True)
    common.clear_scratch(spark)
    common.clear_scratch(spark)
    own = f"{root}/{spark.sparkContext.applicationId}"
    assert system.get_file_info(own).type == fs.FileType.NotFound
    assert system.get_file_info(other).type == fs.FileType.Directory


def test_empty_tables_keep_their_schema(spark):
    df = common.materialize(spark.range(0), "empty")
    assert df.count() == 0 and df.columns == ["id"]


def test_lining_up_numbers_each_group_and_splits_a_hot_one(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(40)}", rng.randrange(9), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x int, id long").repartition(7)
    got = common.line_up(df, "g", ["x", "id"], "line")
    assert got.columns == ["g", "x", "id", "rank"]
    want, seen = {}, {}
    for g, _, i in sorted(rows):
        want[i] = seen.setdefault(g, 0)
        seen[g] += 1
    assert {r.id: r["rank"] for r in got.collect()} == want
    assert common.line_up(df.limit(0), "g", ["x", "id"], "line").count() == 0


def test_rows_are_carried_whatever_their_columns_are_called(spark):
    df = spark.createDataFrame([(1, 2, 3)], "row int, `a.b` int, Spans int")
    held = df.select(common.carried(df).alias("row"), F.lit(7).alias("spans"))
    out = common.returned(held, df.columns, {"spans": F.col("spans"), "new": F.lit(8)})
    assert out.columns == ["row", "a.b", "Spans", "new"]
    assert tuple(out.first()) == (1, 2, 7, 8)
