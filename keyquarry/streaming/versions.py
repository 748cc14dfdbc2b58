"""State of streams by micro-batch, in a shared folder."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keyquarry.functions.access import micros


class Versions:
    """Numbered versions under a folder.  A version counts once its commit is written; a batch that runs again before that overwrites its files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        path, fs = self._fs(f"{self.folder}/commits/*/_SUCCESS")
        return sorted(int(s.getPath().getParent().getName()) for s in fs.globStatus(path) or [])

    def last(self) -> int | None:
        return max(self.committed(), default=None)

    def path(self, version: int, part: str) -> str:
        return f"{self.folder}/v={version}/{part}"

    def info(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/commits/{version}").first()[0])

    def commit(self, version: int, info: dict) -> None:
        self.spark.createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/commits/{version}")

    def drop(self, path: str) -> None:
        """Removes files of the stream's own state."""
        if not path.startswith(f"{self.folder}/"):
            raise ValueError(f"{path} is not under {self.folder}")
        p, fs = self._fs(path)
        fs.delete(p, True)


#: (released rows, rows that came too late, state so far, time up to which rows are released) -> (result, new state)
Step = Callable[[DataFrame, DataFrame, DataFrame | None, int | None], tuple[DataFrame, DataFrame]]


def run_in_order(stream: DataFrame, ts: str, delay: str, folder: str, checkpoint: str, step: Step, close: bool = True) -> DataFrame:
    """Runs a stream over what is available now, its rows released in event time, and reads all results.

    A micro-batch is written once.  Rows wait there until the watermark (the newest event
    time less ``delay``) has passed them; then ``step`` gets them with the state, both plain tables,
    and what it returns is written and committed under the batch's number.  So a batch may hold any number of rows of a
    key, and one that is repeated gives the same files or, after its commit, nothing.  A row
    whose time the watermark had passed before it came is late; one without a time is
    released at once.  ``close`` decides also what still waits, for a bounded input; a
    later run takes that back and goes on from the last batch.
    """
    spark = stream.sparkSession
    wait = spark.range(1).select(micros(F.lit("1970-01-01").cast("timestamp_ntz") + F.expr(f"INTERVAL {delay}"))).first()[0]
    schema = stream.select("*", F.lit(0).cast("bigint").alias("_event_micros")).schema

    def arrived(versions: Versions, numbers: list[int]) -> DataFrame:
        paths = [versions.path(n, "in") for n in numbers]
        return versions.spark.read.schema(schema).parquet(*paths) if paths else versions.spark.createDataFrame([], schema)

    def between(low: int | None, high: int | None) -> Column:
        c = F.col("_event_micros").isNotNull()
        c = c if low is None else c & (F.col("_event_micros") > low)
        return c if high is None else c & (F.col("_event_micros") <= high)

    def apply(batch: DataFrame, number: int) -> None:
        versions = Versions(batch.sparkSession, folder)
        done = versions.committed()
        if number in done:
            return
        before = versions.info(done[-1]) if done else {"watermark": None, "waiting": []}
        batch.withColumn("_event_micros", micros(F.col(ts))).write.mode("overwrite").parquet(versions.path(number, "in"))
        came = arrived(versions, [number])
        newest = came.agg(F.max("_event_micros")).first()[0]
        low, high = before["watermark"], before["watermark"]
        if newest is not None:
            high = max(newest - wait, newest - wait if low is None else low)
        waiting = [w for w in before["waiting"] if high is None or low is None or w["newest"] > low]
        passed = came.filter(F.col("_event_micros").isNull())
        if high is not None and high != low:
            passed = passed.unionByName(arrived(versions, [w["number"] for w in waiting] + [number]).filter(between(low, high)))
        late = came.filter(F.lit(False) if low is None else F.col("_event_micros") <= low)
        state = versions.spark.read.parquet(versions.path(done[-1], "state")) if done else None
        result, state = step(passed, late, state, high)
        result.write.mode("overwrite").parquet(versions.path(number, "out"))
        state.write.mode("overwrite").parquet(versions.path(number, "state"))
        waiting = [w for w in [*waiting, {"number": number, "newest": newest}] if w["newest"] is not None and (high is None or w["newest"] > high)]
        versions.commit(number, {"watermark": high, "waiting": waiting})
        # what only the version before last needed
        if done:
            needed = {w["number"] for w in waiting} | {w["number"] for w in before["waiting"]} | {number}
            for n in done:
                if n not in needed:
                    versions.drop(versions.path(n, "in"))
                if n != done[-1]:
                    versions.drop(versions.path(n, "state"))

    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    versions = Versions(spark, folder)
    last = versions.last()
    if last is None:            # the stream had no rows yet
        empty = spark.createDataFrame([], schema)
        return step(empty, empty, None, None)[0]
    out = [versions.path(n, "out") for n in versions.committed()]
    if close:
        info = versions.info(last)
        rest = arrived(versions, [w["number"] for w in info["waiting"]]).filter(between(info["watermark"], None))
        state = spark.read.parquet(versions.path(last, "state"))
        result, _ = step(rest, rest.limit(0), state, None)
        result.write.mode("overwrite").parquet(f"{versions.folder}/closing-{last}")
        out.append(f"{versions.folder}/closing-{last}")
    return spark.read.parquet(*out)
