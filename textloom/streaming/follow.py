"""Delimited text as it arrives: the plain-line reader over files that are added to a folder.

The dialect itself has bounded streams only (see Engine.register_stream); this
is for users who want the same columns from a folder that keeps growing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.options import ReadOptions
from textloom.sources.delimited import split_lines
from textloom.sources.infer import Schema


def follow(spark: SparkSession, folder: str, schema: Schema, options: ReadOptions | None = None, files_per_trigger: int = 100) -> DataFrame:
    """A streaming frame of the schema's columns; records are lines without quotes, headers can't be told apart and must be absent."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder).withColumnRenamed("value", "line")
    return split_lines(lines, (options or ReadOptions()).checked(), schema)


def windowed_counts(rows: DataFrame, time_col: str, key_col: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and key; rows later than `late` are dropped, so state stays bounded."""
    return rows.withWatermark(time_col, late).groupBy(F.window(time_col, window), key_col).count()
