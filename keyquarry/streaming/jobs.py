"""Structured Streaming forms of the operators.

Functions take a streaming DataFrame and return one; those that need rows in event time or a
table as state run it by ``foreachBatch`` and give the results as a table.  The batch
operators are the reference for their results.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from keyquarry.functions.access import micros
from keyquarry.operators.ordered import running_count
from keyquarry.operators.ratelimit import rate_limit
from keyquarry.operators.secrets import scan_texts
from keyquarry.operators.usage import apply_subscription_events
from keyquarry.session import materialize
from keyquarry.streaming.versions import Versions, run_in_order


def rate_limit_stream(
    requests: DataFrame,
    key: Column,
    window_seconds: float,
    limit: int | Column,
    folder: str,
    checkpoint: str,
    ts: str = "ts",
    order: str = "request_id",
    uncounted: Column | None = None,
    delay: str = "1 day",
    close: bool = True,
) -> DataFrame:
    """Decision per request (``order``, key, decision: ``allowed``, ``denied`` or ``late``) of what is available now.

    ``limit`` may be a column that is the same for all rows of a key; ``uncounted`` marks rows that are
    taken off the count again.  Released rows are decided by the batch limiter, so a key with most of a micro-batch is
    spread over tasks.  Its carry is the admitted requests of the last window before
    the watermark, at most ``limit`` for each key: they are put before the released ones, which admits
    them once more.  Only rows that come more than ``delay`` behind the newest one are ``late``; they are not counted.
    """
    window = int(window_seconds * 1_000_000)
    counted = F.lit(True) if uncounted is None else ~F.coalesce(uncounted, F.lit(False))
    rows = requests.select(
        F.col(order), key.cast("string").alias("key"), F.col(ts).alias("_ts"), counted.alias("_counts"),
        (F.lit(limit) if isinstance(limit, int) else limit).cast("bigint").alias("_most"))

    def step(ready: DataFrame, late: DataFrame, held: DataFrame | None, upto: int | None) -> tuple[DataFrame, DataFrame]:
        new = ready.withColumn("_old", F.lit(False))
        if held is not None:
            new = new.unionByName(held)
        decided = materialize(rate_limit(new, F.col("key"), window_seconds, F.col("_most"), ts="_ts", order=order, uncounted=~F.col("_counts")), "decisions")
        live = F.col("allowed") & F.col("_counts") & F.col("_event_micros").isNotNull() & F.col("_most").isNotNull()
        if upto is not None:
            live = live & (F.col("_event_micros") > upto - window)
        shown = decided.filter(~F.col("_old")).select(order, "key", F.when(F.col("allowed"), F.lit("allowed")).otherwise(F.lit("denied")).alias("decision"))
        result = shown.unionByName(late.select(order, "key", F.lit("late").alias("decision")))
        return result, decided.filter(live).select(*ready.columns, F.lit(True).alias("_old"))

    return run_in_order(rows, "_ts", delay, folder, checkpoint, step, close)


def windowed_counts(
    events: DataFrame, keys: list[str], ts: str = "timestamp", kind: str = "tumbling",
    size: str = "1 day", slide: str | None = None, gap: str | None = None, delay: str | None = None,
) -> DataFrame:
    """Counts per key in tumbling, sliding or session windows, for a stream or a table."""
    # Watermarks need an instant; zoneless times are read in the session's zone (UTC).
    zoneless = dict(events.dtypes)[ts] == "timestamp_ntz"
    df = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay) if delay else events
    if kind == "tumbling":
        w = F.window(ts, size)
    elif kind == "sliding":
        w = F.window(ts, size, slide or size)
    elif kind == "session":
        w = F.session_window(ts, gap or size)
    else:
        raise ValueError(f"unknown window kind {kind!r}")
    counts = df.groupBy(*keys, w.alias("_w")).agg(F.count("*").alias("events"))
    bounds = [F.col(f"_w.{b}").cast("timestamp_ntz") if zoneless else F.col(f"_w.{b}") for b in ("start", "end")]
    return counts.select(*keys, bounds[0].alias("window_start"), bounds[1].alias("window_end"), "events")


def closed_windows(
    events: DataFrame, keys: list[str], path: str, checkpoint: str, ts: str = "timestamp", delay: str = "1 hour", **options
) -> DataFrame:
    """Windowed counts of a bounded input as a stream, with the windows that are still open at its end.

    After the stream has taken what is available, a closing run of the same query gets one
    row far behind all others (in time), from a source beside the input.  It moves the watermark past every
    window; its own window stays open and is never written.
    """
    spark = events.sparkSession
    end = f"{path}-end"
    spark.createDataFrame([], events.schema).write.mode("ignore").parquet(end)
    both = events.unionByName(spark.readStream.schema(events.schema).parquet(end))
    counts = windowed_counts(both, keys, ts, delay=delay, **options)
    run_to_table(counts, path, checkpoint)
    kind = events.schema[ts].dataType.simpleString()
    last = F.lit("9999-01-01 00:00:00").cast("timestamp_ntz").cast(kind)
    spark.range(1).select(*[(last if c == ts else F.lit(None).cast(events.schema[c].dataType)).alias(c) for c in events.columns]).write.mode("append").parquet(end)
    return run_to_table(counts, path, checkpoint)


def pair_requests_stream(
    requests: DataFrame, responses: DataFrame, timeout: str = "30 seconds", delay: str = "1 minute"
) -> DataFrame:
    """Stream-stream join of requests with the response that follows within ``timeout``."""
    left = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    right = responses.select(
        F.col("request_id").alias("_rid"), F.col("ts").cast("timestamp").alias("response_ts"), "status"
    ).withWatermark("response_ts", delay)
    condition = F.expr(
        f"request_id = _rid AND response_ts >= ts AND response_ts <= ts + INTERVAL {timeout}"
    )
    return left.join(right, condition).drop("_rid").withColumn(
        "duration_ms", (micros(F.col("response_ts")) - micros(F.col("ts"))) / 1000
    )


def error_alerts_stream(
    errors: DataFrame, folder: str, checkpoint: str, by: str = "error_type", ts: str = "ts", order: str = "event_id",
    threshold: int = 10, delay: str = "1 hour", close: bool = True,
) -> DataFrame:
    """Occurrence number and level of each error of what is available now, in (``ts``, ``order``).

    Two levels of offsets: inside the rows that a micro-batch releases, slices of time are numbered apart and
    offset by the counts of the slices before (``running_count``); the batch is offset by
    the stored count of its type.  The state is one row for each type.  An error that comes more than ``delay``
    behind the newest one is not lost: it is numbered with the batch that brings it.
    """
    rows = errors.select(F.col(by).cast("string").alias("error_type"), F.col(order), F.col(ts).alias("_ts"))

    def step(ready: DataFrame, late: DataFrame, seen: DataFrame | None, upto: int | None) -> tuple[DataFrame, DataFrame]:
        new = ready.unionByName(late)
        numbered = running_count(new, ["error_type"], "_ts", order)
        counts = new.groupBy("error_type").agg(F.count("*").alias("seen"))
        if seen is not None:
            before = seen.select(F.col("error_type").alias("_type"), F.col("seen").alias("_seen"))
            numbered = numbered.join(before, F.col("error_type").eqNullSafe(F.col("_type")), "left").withColumn(
                "nth", F.col("nth") + F.coalesce("_seen", F.lit(0)))
            counts = counts.unionByName(seen).groupBy("error_type").agg(F.sum("seen").alias("seen"))
        level = F.when(F.col("nth") >= threshold, F.lit("FATAL")).otherwise(F.lit("ERROR"))
        return numbered.select(order, "error_type", "nth", level.alias("level")), counts

    return run_in_order(rows, "_ts", delay, folder, checkpoint, step, close)


def scan_stream(files: DataFrame, **options) -> DataFrame:
    """Findings of newly arrived (file, content) rows; stateless, append mode."""
    return scan_texts(files, **options)


_EVENT = ("_event_ts", "_event_id")     # the last subscription event of a user, kept in the snapshot


def keep_users_current(events: DataFrame, snapshot: str, first: DataFrame, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Maintain a users snapshot from billing events; read it with ``current_users``.

    The snapshot lies in buckets by customer.  A micro-batch reads and writes only the buckets of its
    customers, as files of a new version; its commit names the version of every bucket, so
    the others keep their files, and a batch that is run again gives the same.  Files that
    neither the new nor the previous commit names are removed after it.  A user remembers the
    time and id of the last event applied: an older event that comes later changes nothing.
    """
    spark = events.sparkSession

    def bucket(customer: Column) -> Column:
        return F.pmod(F.xxhash64(customer), F.lit(buckets)).cast("int")

    def write(users: DataFrame, versions: Versions, number: int) -> list[int]:
        spread = users.withColumn("bucket", bucket(F.coalesce(F.col("stripe_customer_id"), F.col("id").cast("string"))))
        spread.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(versions.path(number, "users"))
        path, fs = versions._fs(versions.path(number, "users") + "/bucket=*")
        return [int(s.getPath().getName().split("=")[1]) for s in fs.globStatus(path) or []]

    versions = Versions(spark, snapshot)
    if versions.last() is None:
        kinds = dict(events.dtypes)
        start = first
        for c, t in (("stripe_subscription_id", "string"), ("updated_at", "timestamp_ntz"), (_EVENT[0], kinds["ts"]), (_EVENT[1], kinds["event_id"])):
            start = start if c in start.columns else start.withColumn(c, F.lit(None).cast(t))
        held = write(start, versions, -1)
        versions.commit(-1, {"buckets": {b: -1 for b in held}, "schema": start.schema.json()})

    def apply(batch: DataFrame, number: int) -> None:
        versions = Versions(batch.sparkSession, snapshot)
        done = versions.committed()
        if number in done:
            return
        info = versions.info(done[-1])
        news = batch.filter(F.col("customer").isNotNull()).select(bucket(F.col("customer")).alias("_bucket"))
        touched = {str(r[0]) for r in news.distinct().collect()} & set(info["buckets"])     # at most ``buckets`` numbers
        if touched:
            users = _users(versions, {b: info["buckets"][b] for b in touched}, info["schema"])
            write(apply_subscription_events(users, batch, _EVENT), versions, number)
        now = info["buckets"] | {b: number for b in touched}
        versions.commit(number, info | {"buckets": now})
        if len(done) > 1:
            for b, v in versions.info(done[-2])["buckets"].items():
                if v not in (info["buckets"].get(b), now.get(b)):
                    versions.drop(versions.path(v, f"users/bucket={b}"))

    return (
        events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _users(versions: Versions, buckets: dict[str, int], schema: str) -> DataFrame:
    kind = T.StructType.fromJson(json.loads(schema))
    paths = [versions.path(v, f"users/bucket={b}") for b, v in buckets.items()]
    return versions.spark.read.schema(kind).parquet(*paths) if paths else versions.spark.createDataFrame([], kind)


def current_users(spark: SparkSession, snapshot: str) -> DataFrame:
    """The snapshot of the last commit."""
    versions = Versions(spark, snapshot)
    info = versions.info(versions.last())
    return _users(versions, info["buckets"], info["schema"]).drop(*_EVENT)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available now into a written table and read it back."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
