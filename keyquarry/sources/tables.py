"""Typed table readers and append-only sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keyquarry.schemas import TABLES, conform


def read_table(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """One of the thirteen tables from ``folder/name``, with its fixed schema (no inference)."""
    return spark.read.schema(TABLES[name].schema).parquet(f"{folder.rstrip('/')}/{name}")


def write_table(df: DataFrame, name: str, folder: str, mode: str = "error") -> None:
    conform(df, name).write.mode(mode).parquet(f"{folder.rstrip('/')}/{name}")


def _dated(df: DataFrame, name: str) -> DataFrame:
    return conform(df, name).withColumn("date", F.to_date("timestamp"))


def append_audit(df: DataFrame, path: str) -> None:
    """Append audit rows, one folder per day."""
    _append(df, "audit_logs", path)


def append_usage(df: DataFrame, path: str) -> None:
    """Append usage rows, one folder per day."""
    _append(df, "usage_events", path)


def _append(df: DataFrame, name: str, path: str) -> None:
    """Rows are rebalanced by day: small days share a task and a day with most of the rows
    is split, so that files have about the advisory partition size."""
    _dated(df, name).hint("rebalance", "date").write.mode("append").partitionBy("date").parquet(path)


def stream_append(df: DataFrame, name: str, path: str, checkpoint: str, once: bool = True):
    """Streaming twin of the append sinks (exactly-once file sink)."""
    writer = (
        _dated(df, name).writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).partitionBy("date").outputMode("append")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
