"""Readers of labelled-sequence files: every line a row, malformed ones left out or returned on their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.functions import tokens as T


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", "true").text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.split(F.trim("value"), r"\s+").alias("f"))


def chord_segments(spark: SparkSession, path: str) -> DataFrame:
    """path, t0, t1, label and its parts from ``t0 t1 label`` lines; lines of another form and unknown chords (X) go."""
    d = _lines(spark, path).select("path", F.get("f", F.lit(0)).try_cast("double").alias("t0"), F.get("f", F.lit(1)).try_cast("double").alias("t1"), F.get("f", F.lit(2)).alias("label"))
    h = T.harte(F.col("label"))
    return d.withColumns({"root": h["root"], "quality": h["quality"]}).filter("t0 is not null and t1 is not null and root is not null")


def beats(spark: SparkSession, path: str) -> DataFrame:
    """path, t, half and down from ``t half down`` lines; flags of 0.5 and more are set, missing ones are not."""
    flag = lambda i: F.coalesce(F.get("f", F.lit(i)).try_cast("double") >= 0.5, F.lit(False))
    return _lines(spark, path).select("path", F.get("f", F.lit(0)).try_cast("double").alias("t"), flag(1).alias("half"), flag(2).alias("down")).filter("t is not null")


def key_segments(spark: SparkSession, path: str) -> DataFrame:
    """path, t0, t1, tonic and mode from ``t0 t1 key`` lines; keys that don't begin with a note go."""
    d = _lines(spark, path).select("path", F.get("f", F.lit(0)).try_cast("double").alias("t0"), F.get("f", F.lit(1)).try_cast("double").alias("t1"), T.parse_key(F.get("f", F.lit(2))).alias("k"))
    return d.select("path", "t0", "t1", "k.*").filter("t0 is not null and t1 is not null and tonic is not null")


def json_records(spark: SparkSession, path: str, schema: str, required: list[str], lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of JSON files: records hold every ``required`` field; rejected ones come as path
    and text. One file is one object, or every line is one with ``lines``; blank lines are nothing then."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=not lines)
    if lines:
        raw = raw.filter(F.trim("value") != "")
    raw = raw.select(F.col("_metadata.file_path").alias("path"), "value")
    parsed = raw.withColumn("r", F.from_json("value", schema))
    good = F.col("r").isNotNull()
    for c in required:
        good = good & F.col(f"r.{c}").isNotNull()
    return parsed.filter(good).select("path", "r.*"), parsed.filter(~F.coalesce(good, F.lit(False))).select("path", F.col("value").alias("text"))
