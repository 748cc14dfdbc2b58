"""Source trees and text as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_sources(spark: SparkSession, path: str, statuses: DataFrame | None = None) -> DataFrame:
    """All files under ``path`` as (file, status, content); ``removed`` files are left out.

    ``statuses`` is an optional (file, status) change list; files without one are ``added``.
    """
    files = (
        spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
    )
    if statuses is None:
        return files.select("file", F.lit("added").alias("status"), "content")
    return drop_removed(
        files.join(statuses, "file", "left")
        .select("file", F.coalesce("status", F.lit("added")).alias("status"), "content")
    )


def drop_removed(changes: DataFrame) -> DataFrame:
    return changes.filter(~F.col("status").eqNullSafe("removed"))


def explode_lines(df: DataFrame, content: str = "content") -> DataFrame:
    """One row per line with a 1-based ``line_no``; trailing empty lines are kept."""
    keep = [c for c in df.columns if c != content]
    return df.select(*keep, F.posexplode(F.split(content, "\n", -1)).alias("_p", "line")).select(
        *keep, (F.col("_p") + 1).cast("bigint").alias("line_no"), "line"
    )


def file_ext(file: Column) -> Column:
    """Text after the last dot (the whole name if there is none)."""
    return F.substring_index(file, ".", -1)
