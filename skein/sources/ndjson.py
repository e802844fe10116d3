"""Newline-delimited JSON as a table of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_ndjson(spark: SparkSession, path: str | list[str], numbered: bool = False) -> DataFrame:
    """value: each line that isn't empty, cut at \\n alone, so that a \\r stays. numbered adds file and an id that rises
    with the line's place in its file."""
    lines = spark.read.text(path, lineSep="\n")
    if numbered:
        lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_id"))
    return lines.where(F.length("value") > 0)


def stream_ndjson(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path, lineSep="\n").where(F.length("value") > 0)


def lines_of(df: DataFrame, buffer: str, *keep: str | Column) -> DataFrame:
    """line_no (from 0, empty lines don't count) and value of each line of a string or binary column."""
    lines = F.filter(F.split(F.col(buffer).cast("string"), "\n"), lambda x: x != "")
    return df.select(*keep, F.posexplode(lines).alias("line_no", "value"))
