"""Queries: streaming forms, run over the supplied tables as file sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyquarry import rules
from keyquarry.functions.access import rate_key, tier_limiter_key, tier_max
from keyquarry.plans.access import LIMIT, WINDOW_DAYS, _admission_sql
from keyquarry.plans.registry import query
from keyquarry.plans.scanning import TOKEN, _DOC_LINES, _scan_sql
from keyquarry.plans.usage import SUBSCRIBED, SUBSCRIBED_SELECT
from keyquarry.session import new_path
from keyquarry.sources.fixtures import cte, frame, table
from keyquarry.sources.tables import stream_append
from keyquarry.streaming import jobs


def _stream(spark, sf, name):
    """A supplied table as a file stream."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}*.parquet")


def _run(stream, name):
    spark = stream.sparkSession
    return jobs.run_to_table(stream, new_path(spark, name), new_path(spark, f"{name}-progress"))


def _arriving(spark, df, name, hours, run, parts=4):
    """Runs ``run(stream)`` after each of ``parts`` appends to a folder; rows come up to ``hours`` after their time, in no order."""
    folder = new_path(spark, name)
    late = F.pmod(F.xxhash64("event_id"), F.lit(3600 * hours)).cast("long")
    came = df.withColumn("_came", F.unix_micros(F.col("ts").cast("timestamp")) + late * 1_000_000)
    cuts = came.approxQuantile("_came", [i / parts for i in range(1, parts)], 0.01)
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = came if low is None else came.filter(F.col("_came") >= low)
        part = part if high is None else part.filter(F.col("_came") < high)
        part.drop("_came").write.mode("append").parquet(folder)
        out = run(spark.readStream.schema(df.schema).parquet(folder))
    return out


def _decide(spark, name, requests, key, seconds, limit, **kw):
    return jobs.rate_limit_stream(requests, key, seconds, limit, new_path(spark, name), new_path(spark, f"{name}-progress"), **kw)


def _decisions(key, counted, limit, days=WINDOW_DAYS):
    return "SELECT request_id, key, CASE WHEN allowed THEN 'allowed' ELSE 'denied' END AS decision FROM (" + _admission_sql(key, counted, limit, days) + ")"


@query("k1_rate_limit_stream", _decisions("user_id", "true", LIMIT))
def k1(spark, sf):
    requests = _stream(spark, sf, "events").select(F.col("event_id").alias("request_id"), "ts", F.col("user_id").cast("string").alias("user_id"))
    return _decide(spark, "k1", requests, F.col("user_id"), WINDOW_DAYS * 86400, LIMIT)


@query("k1_rate_limit_stream_by_tier", _decisions(
    "'tier-rl:' || tier || ':user:' || user_id", "true", "CASE tier WHEN 'free' THEN 10 WHEN 'pro' THEN 100 WHEN 'team' THEN 500 ELSE 5000 END", 20))
def k1_tier(spark, sf):
    tier = F.element_at(F.array(*[F.lit(t) for t in rules.TIERS]), (F.col("user_id") % 4 + 1).cast("int"))
    requests = _stream(spark, sf, "events").select(F.col("event_id").alias("request_id"), "ts", "user_id", tier.alias("tier"))
    key = tier_limiter_key(F.col("tier"), F.concat(F.lit("user:"), F.col("user_id").cast("string")))
    return _decide(spark, "k1-tier", requests, key, 20 * 86400, tier_max(F.col("tier")))


def _shuffled(spark, sf, name, key, seconds, limit, **kw):
    """Decisions of events that come in four parts, up to two days late and in no order."""
    folder, progress = new_path(spark, name), new_path(spark, f"{name}-progress")
    return _arriving(spark, table(spark, sf, "events"), f"{name}-in", 48, lambda stream: jobs.rate_limit_stream(
        stream.withColumnRenamed("event_id", "request_id"), key, seconds, limit, folder, progress, delay="2 days", **kw))


@query("k1_rate_limit_stream_shuffled", _decisions("user_id", "true", LIMIT))
def k1_shuffled(spark, sf):
    return _shuffled(spark, sf, "k1-shuffled", F.col("user_id").cast("string"), WINDOW_DAYS * 86400, LIMIT)


# One endpoint has half of all requests and is over its limit all the time; failed requests are not counted.
_ENDPOINT = "'endpoint-rl:' || CASE WHEN CAST(user_id AS BIGINT) % 2 = 0 THEN 'create-secret' ELSE path END || ':all'"


@query("k1_rate_limit_stream_hot_endpoint", _decisions(_ENDPOINT, "status < 400", 7, 1))
def k1_endpoint(spark, sf):
    endpoint = F.when(F.col("user_id") % 2 == 0, F.lit("create-secret")).otherwise(F.concat(F.lit("/api/"), "event_type"))
    return _shuffled(spark, sf, "k1-endpoint", rate_key("endpoint-rl", endpoint, F.lit("all")), 86400, 7, uncounted=F.col("event_type") == "error")


def _windows_query(kind: str, check: str, **args) -> None:
    @query(f"k2_{kind}_counts", cte("usage_events") + check)
    def run(spark, sf):
        return jobs.windowed_counts(frame(spark, sf, "usage_events"), ["event_type"], kind=kind, **args)


_windows_query("tumbling", """SELECT event_type, date_trunc('day', timestamp) AS window_start, date_trunc('day', timestamp) + INTERVAL 1 DAY AS window_end, count(*) AS events
FROM usage_events GROUP BY ALL""", size="1 day")
_windows_query("sliding", """SELECT event_type, s AS window_start, s + INTERVAL 2 DAY AS window_end, count(*) AS events
FROM (SELECT event_type, date_trunc('day', timestamp) - to_days(CAST(d AS INT)) AS s FROM usage_events, (SELECT unnest([0, 1]) AS d)) GROUP BY ALL""", size="2 days", slide="1 day")


@query("k2_session_counts", cte("usage_events") + """SELECT user_id, min(timestamp) AS window_start, max(timestamp) + INTERVAL 6 HOUR AS window_end, count(*) AS events
FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY timestamp, id) AS s FROM (SELECT *,
 CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY user_id ORDER BY timestamp, id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM usage_events)) GROUP BY user_id, s""")
def k2_session(spark, sf):
    return jobs.windowed_counts(frame(spark, sf, "usage_events"), ["user_id"], kind="session", gap="6 hours")


# A window is written once the watermark (the newest time less an hour) has passed its end.
@query("k2_tumbling_stream", """SELECT * FROM (SELECT event_type, date_trunc('day', ts) AS window_start,
 date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, count(*) AS events FROM events GROUP BY ALL)
WHERE window_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def k2_stream(spark, sf):
    usage = _stream(spark, sf, "events").select("event_type", F.col("ts").alias("timestamp"))
    return _run(jobs.windowed_counts(usage, ["event_type"], size="1 day", delay="1 hour"), "k2")


# The same with all windows: a closing run moves the watermark past the last ones.
def _closed_query(kind: str, check: str, keys: list[str], **args) -> None:
    @query(f"k2_{kind}_stream_closed", check)
    def run(spark, sf):
        usage = _stream(spark, sf, "events").select(*keys, F.col("ts").alias("timestamp"))
        return jobs.closed_windows(usage, keys, new_path(spark, f"k2-{kind}"), new_path(spark, f"k2-{kind}-progress"), kind=kind, **args)


_closed_query("tumbling", """SELECT event_type, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, count(*) AS events
FROM events GROUP BY ALL""", ["event_type"], size="1 day")
_closed_query("sliding", """SELECT event_type, s AS window_start, s + INTERVAL 2 DAY AS window_end, count(*) AS events
FROM (SELECT event_type, date_trunc('day', ts) - to_days(CAST(d AS INT)) AS s FROM events, (SELECT unnest([0, 1]) AS d)) GROUP BY ALL""",
              ["event_type"], size="2 days", slide="1 day")
_closed_query("session", """SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, count(*) AS events
FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *,
 CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""",
              ["user_id"], gap="6 hours")


@query("k3_pair_requests_stream", """SELECT event_id AS request_id, event_type AS method, CAST(CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS INT) AS status,
 CAST(2000 AS DOUBLE) AS duration_ms FROM events WHERE event_id % 10 <> 0""")
def k3(spark, sf):
    e = _stream(spark, sf, "events")
    left = e.select(F.col("event_id").alias("request_id"), "ts", F.col("event_type").alias("method"))
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    right = _stream(spark, sf, "events").filter(F.col("event_id") % 10 != 0).select(
        F.col("event_id").alias("request_id"), (F.col("ts") + F.expr("INTERVAL 2 SECONDS")).alias("ts"), status.alias("status"))
    return _run(jobs.pair_requests_stream(left, right), "k3").select("request_id", "method", "status", "duration_ms")


@query("k4_error_alerts_stream", """SELECT event_id, event_type AS error_type, n AS nth, CASE WHEN n >= 10 THEN 'FATAL' ELSE 'ERROR' END AS level
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events)""")
def k4(spark, sf):
    folder, progress = new_path(spark, "k4"), new_path(spark, "k4-progress")
    return _arriving(spark, table(spark, sf, "events"), "k4-in", 6, lambda stream: jobs.error_alerts_stream(
        stream.withColumnRenamed("event_type", "error_type"), folder, progress, delay="6 hours"))


@query("k5_scan_stream", "WITH " + _DOC_LINES + " SELECT CAST(doc_id AS VARCHAR) AS file, line_no, type, service, value FROM ("
       + _scan_sql("doc_lines", rules.SECRET_PATTERNS + [TOKEN], "doc_id, line_no", None) + ")")
def k5(spark, sf):
    docs = _stream(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("content"))
    out = _run(jobs.scan_stream(docs, patterns=rules.SECRET_PATTERNS + [TOKEN]), "k5")
    return out.select("file", "line_no", "type", "service", "value")


@query("k6_users_snapshot_stream", cte("billing_events", "users", extra=SUBSCRIBED) + SUBSCRIBED_SELECT)
def k6(spark, sf):
    n = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in (
        "customer.subscription.updated", "customer.subscription.deleted", "invoice.payment_succeeded", "invoice.payment_failed")]), (n % 4 + 1).cast("int"))
    price = F.element_at(F.array(F.lit("price_pro_monthly"), F.lit("price_team_yearly"), F.lit("price_x")), (n % 3 + 1).cast("int"))
    events = _stream(spark, sf, "orders").select(
        n.alias("event_id"), F.concat(F.lit("cus_"), "o_custkey").alias("customer"), F.col("o_orderdate").alias("ts"),
        kind.alias("type"), price.alias("price_id"))
    first = frame(spark, sf, "users").withColumn("stripe_subscription_id", F.lit(None).cast("string")).withColumn(
        "updated_at", F.lit(None).cast("timestamp_ntz"))
    snapshot = new_path(spark, "k6")
    jobs.keep_users_current(events, snapshot, first, new_path(spark, "k6-progress")).awaitTermination()
    return jobs.current_users(spark, snapshot).select("id", "email", "tier", "stripe_subscription_id", "updated_at")


@query("a7_stream_append_usage", cte("usage_events") + "SELECT id, user_id, event_type, timestamp, CAST(timestamp AS DATE) AS date FROM usage_events")
def a7_stream(spark, sf):
    kind = F.when(F.col("event_type") == "signup", F.lit("secret_created")).when(F.col("event_type") == "purchase", F.lit("secret_rotated")).when(
        F.col("event_type") == "error", F.lit("ai_request")).otherwise(F.lit("api_call"))
    usage = _stream(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("user_id"), kind.alias("event_type"), F.col("ts").alias("timestamp"))
    path = new_path(spark, "usage-stream")
    stream_append(usage, "usage_events", path, new_path(spark, "usage-stream-progress")).awaitTermination()
    return spark.read.parquet(path).select("id", "user_id", "event_type", "timestamp", "date")
