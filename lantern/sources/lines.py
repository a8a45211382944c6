"""Numbered lines of text files that may be cut into several splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the text files under ``path``: ``_path``, ``_mtime``, ``line_no`` (from 0
    within its file), ``line`` and the folders' partition columns.

    A file is read in as many splits as Spark cuts it into. A line's number is its place in
    its split plus the lines of the file's splits before it: the splits' line counts are
    summed by start offset, one small row per split, so no file is ever one value or one
    task. A file's place in its task is numbered with ``monotonically_increasing_id`` and
    counted from the split's first line. Empty files have no lines."""
    raw = spark.read.option("lineSep", "\n").text(path)
    at = raw.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"),
                    F.col("_metadata.file_modification_time").alias("_mtime"), F.monotonically_increasing_id().alias("_at"))
    splits = at.groupBy("_path", "_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("_path", "_start", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return at.join(offsets, ["_path", "_start"]).select(
        "_path", "_mtime", *[c for c in raw.columns if c != "value"],
        (F.col("_at") + F.col("_shift")).alias("line_no"), F.regexp_replace("value", "\r$", "").alias("line"))
