"""Stage artifacts, recordings and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import csv_cell
from . import delimited, publication


def stage_json(spark: SparkSession, folder: str, schema: str | StructType) -> DataFrame:
    """One row for each readable JSON file whose call_id is its name's stem; others are skipped."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    rows = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(schema).json(folder)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)\.", 1)
    return rows.withColumn("_stem", stem).where("call_id = _stem").drop("_stem")


def published(cards: DataFrame, results: DataFrame) -> DataFrame:
    """Cards of calls that ended well; a call without a result counts as such."""
    status = results.select("call_id", "status")
    return cards.join(status, "call_id", "left").where(F.coalesce("status", F.lit("success")) == "success").drop("status")


def gated_calls(results: DataFrame, cards: DataFrame, meta: DataFrame, features: DataFrame, redacted: DataFrame) -> DataFrame:
    """Every call that has a result or a card, with what else is known of it.

    Text may be shown only where redaction says that it was on.
    """
    wide = results.join(cards, "call_id", "full").join(meta, "call_id", "left").join(features, "call_id", "left")
    shown = redacted.select("call_id", F.coalesce(F.col("enabled"), F.lit(False)).alias("text_shown"))
    return wide.join(shown, "call_id", "left").withColumn("text_shown", F.coalesce("text_shown", F.lit(False)))


def audio_index(spark: SparkSession, folder: str) -> DataFrame:
    """name (lower case, with and without ending) and path of recordings; the first path of a name wins."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    both = files.select("path", "length", F.explode(F.array_distinct(F.array(name, F.regexp_replace(name, r"\.[^.]*$", "")))).alias("name"))
    return both.groupBy("name").agg(F.min(F.struct("path", "length")).alias("f")).select("name", "f.*")


def probe_wav(spark: SparkSession, folder: str) -> DataFrame:
    """path, channels, rate, seconds and loudness of wave files; error where one can't be read or is empty."""

    @F.pandas_udf("channels int, rate int, seconds double, loudness double, error string")
    def probe(contents):
        import io
        import wave

        import numpy as np
        import pandas as pd

        rows = []
        for raw in contents:
            try:
                with wave.open(io.BytesIO(bytes(raw))) as w:
                    n, rate = w.getnframes(), w.getframerate()
                    data = np.frombuffer(w.readframes(n), "<i2") if w.getsampwidth() == 2 else np.zeros(0)
                    rms = float(np.sqrt(np.mean((data / 32768.0) ** 2))) if len(data) else 0.0
                    rows.append((w.getnchannels(), rate, n / rate, rms, None if n else "empty"))
            except (wave.Error, EOFError) as error:
                rows.append((None, None, None, None, str(error) or "unreadable"))
        return pd.DataFrame(rows, columns=["channels", "rate", "seconds", "loudness", "error"])

    files = spark.read.format("binaryFile").load(folder)
    return files.select("path", probe("content").alias("p")).select("path", "p.*")


def reference_turns(spark: SparkSession, path: str) -> DataFrame:
    """call, start, end and speaker of RTTM lines."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.col("value").startswith("SPEAKER "))
    start, length = p[3].cast("double"), p[4].cast("double")
    return rows.select(p[1].alias("call"), start.alias("start"), (start + length).alias("end"), p[7].alias("speaker"))


def reference_turns_csv(spark: SparkSession, path: str) -> DataFrame:
    """call (the file's name without its ending), start, end and speaker of CSV files with these columns."""
    rows = delimited.typed(delimited.read_any(spark, path), {c: [c] for c in ("start", "end", "speaker")})
    call = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return rows.select(call.alias("call"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.coalesce("speaker", F.lit("")).alias("speaker"))


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with CRLF line ends, no cell of which a spreadsheet takes for a formula."""
    safe = df.select(*[csv_cell(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    safe.write.option("header", True).option("lineSep", "\r\n").csv(path)


def append_history(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Append rows to a folder of JSON lines; a batch that has a name is written once however often it is tried."""
    if batch is None:
        df.write.mode("append").json(path)
    else:
        df.write.mode("overwrite").json(f"{path}/batch={batch}")


def checked_reviews(reviews: DataFrame, dims: list[str]) -> tuple[DataFrame, DataFrame]:
    """Reviews (call_id, rater_id and a text for each dimension) with whole scores, and those refused with their reason.

    Of reviews of one call by one rater the first by their text counts.
    """
    whole = [F.col(d).rlike("^[1-5]$") for d in dims]
    blank = F.coalesce(F.trim("call_id"), F.lit("")).eqNullSafe("") | F.coalesce(F.trim("rater_id"), F.lit("")).eqNullSafe("")
    missing = F.array_join(F.filter(F.array(*[F.when(F.col(d).isNull(), F.lit(d)) for d in dims]), lambda d: d.isNotNull()), ", ")
    wrong = F.array_join(F.filter(F.array(*[F.when(~w, F.lit(d)) for d, w in zip(dims, whole, strict=True)]), lambda d: d.isNotNull()), ", ")
    place = F.row_number().over(Window.partitionBy("call_id", "rater_id").orderBy(F.struct(*dims)))
    reason = (
        F.when(blank, "call_id and rater_id are required")
        .when(missing != "", F.concat(F.lit("missing scores for: "), missing))
        .when(wrong != "", F.concat(F.lit("not an integer 1..5: "), wrong))
        .when(place > 1, "reviewed already")
    )
    marked = reviews.withColumn("reason", reason)
    good = marked.where("reason is null").drop("reason")
    return good.select("call_id", "rater_id", *[F.col(d).cast("int").alias(d) for d in dims]), marked.where("reason is not null")


def append_reviews(spark: SparkSession, new: DataFrame, path: str) -> None:
    """Append ratings (call_id, rater_id, ...) that aren't there yet.

    Two writers at once may both append the same rating; reviews() gives one of them.
    """
    known = publication.every_row(spark, path, "reviews")
    if known is not None:
        new = new.join(known.select("call_id", "rater_id"), ["call_id", "rater_id"], "left_anti")
    publication.publish(new, path, "reviews", "append")


def reviews(spark: SparkSession, path: str) -> DataFrame | None:
    """One rating of each rater for each call, that which was appended first; None where there is none."""
    found = publication.by_key(spark, path, "reviews", ["call_id", "rater_id"], last=False)
    return found if found is None else found.drop("run")


def expired_files(spark: SparkSession, folder: str, before: str) -> DataFrame:
    """path and modificationTime of files last written before a time; deleting them is left to the caller."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "modificationTime", "length").where(F.col("modificationTime") < F.lit(before).cast("timestamp"))


def not_reproduced(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """key and the columns in which two runs differ, or missing where only one has the row."""
    columns = [c for c in first.columns if c != key]
    a = first.select(key, F.struct(*columns).alias("_a"))
    b = second.select(key, F.struct(*columns).alias("_b"))
    both = a.join(b, key, "full")
    differ = [F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in columns]
    named = F.filter(F.array(*differ), lambda c: c.isNotNull())
    missing = F.col("_a").isNull() | F.col("_b").isNull()
    found = both.select(key, F.when(missing, F.array(F.lit("missing"))).otherwise(named).alias("differs"))
    return found.where(F.size("differs") > 0)


def run_manifest(calls: DataFrame, run: str, rate: float) -> DataFrame:
    """run, succeeded, failed, held, gpu_hours and estimated cost of runs of calls (status, seconds)."""
    of = lambda s: F.count_if(F.col("status") == s)
    hours = F.sum("seconds") / 3600
    return calls.groupBy(run).agg(
        of("success").alias("succeeded"),
        of("failed").alias("failed"),
        of("needs_human_review").alias("held"),
        hours.alias("gpu_hours"),
        (hours * rate).alias("estimated"),
    )
