"""Queries: quotas, usage, latency, errors, billing, health, compliance."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyquarry import rules
from keyquarry.operators import ordered, usage
from keyquarry.operators.services import detect_services, missing_keys
from keyquarry.plans.access import ORDERS_AT, at, _PLAN_VALUES
from keyquarry.plans.registry import ORACLES, query
from keyquarry.plans.scanning import _CI_RULES
from keyquarry.session import materialize
from keyquarry.sources.fixtures import cte, frame, table


@query("d1_secret_quota", cte("secrets", "users") + """SELECT u.id AS user_id, u.tier, coalesce(n, 0) AS used, CASE u.tier WHEN 'free' THEN 10 ELSE -1 END AS quota,
 u.tier = 'free' AND coalesce(n, 0) >= 10 AS blocked
FROM users u LEFT JOIN (SELECT user_id, count(*) AS n FROM secrets WHERE is_active = 1 GROUP BY user_id) s ON s.user_id = u.id""")
def d1(spark, sf):
    return usage.secret_quota(frame(spark, sf, "secrets"), frame(spark, sf, "users"))


def _rank(p: float, v: str) -> str:
    return f"list_sort(list({v}))[CAST(floor(count(*) * CAST({p} AS DOUBLE)) AS BIGINT) + 1]"


_STATS = "count(*) AS count, round(avg({v}), 6) AS avg, min({v}) AS min, max({v}) AS max"
_RANKS = ", ".join(f"{_rank(p, '{v}')} AS {n}" for n, p in usage.PERCENTILES.items())


@query("d2_operation_stats", cte("op_timings") + f"SELECT operation, {_STATS.format(v='duration_ms')}, {_RANKS.format(v='duration_ms')} FROM op_timings GROUP BY operation")
def d2(spark, sf):
    return usage.operation_stats(frame(spark, sf, "op_timings")).withColumn("avg", F.round("avg", 6))


# Approximate percentiles pass if their ranks are off by at most half a percent; the groups are those of the exact form.
@query("d2_operation_stats_approx", cte("op_timings") + """SELECT operation, count(duration_ms) AS count, round(avg(duration_ms), 6) AS avg, min(duration_ms) AS min, max(duration_ms) AS max,
 true AS p50_near, true AS p95_near, true AS p99_near FROM op_timings GROUP BY operation""")
def d2_approx(spark, sf):
    return _near(usage.operation_stats(frame(spark, sf, "op_timings"), approx=True), frame(spark, sf, "op_timings"))


def _near(stats, timings):
    errors = usage.rank_errors(stats, timings).withColumnRenamed("operation", "_operation")
    near = [(F.col(f"{p}_error") <= 0.005).alias(f"{p}_near") for p in usage.PERCENTILES]
    return stats.join(errors, F.col("operation").eqNullSafe(F.col("_operation"))).select(
        "operation", "count", F.round("avg", 6).alias("avg"), "min", "max", *near)


@query("d2_merged_daily_sketches", ORACLES["d2_operation_stats_approx"])
def d2_merged(spark, sf):
    timings = frame(spark, sf, "op_timings")
    days = materialize(usage.daily_sketches(timings), "daily-sketches")
    return _near(usage.merged_stats(days), timings)


_SPARSE = """(SELECT CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_suppkey END AS supplier, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_extendedprice END AS price FROM lineitem)"""


@query("e4_groups_without_key_or_value", "SELECT supplier, " + ", ".join(
    f"list_sort(list(price) FILTER (price IS NOT NULL))[CAST(floor(count(price) * CAST({p} AS DOUBLE)) AS BIGINT) + 1] AS {n}"
    for n, p in usage.PERCENTILES.items()) + f" FROM {_SPARSE} GROUP BY supplier")
def e4_sparse(spark, sf):
    key = F.when(F.col("l_suppkey") % 4 != 0, F.col("l_suppkey")).alias("supplier")
    price = F.when(F.col("l_suppkey") % 3 != 0, F.col("l_extendedprice")).alias("price")
    return ordered.exact_rank_percentiles(table(spark, sf, "lineitem").select(key, price), ["supplier"], "price", usage.PERCENTILES)


@query("e4_exact_rank_percentile", f"SELECT l_suppkey, {_RANKS.format(v='l_extendedprice')} FROM lineitem GROUP BY l_suppkey")
def e4(spark, sf):
    return ordered.exact_rank_percentiles(table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", usage.PERCENTILES)


@query("d3_metrics_scalars", cte("metrics") + """SELECT name, kind, round(CASE kind WHEN 'counter' THEN sum(coalesce(value, 1)) ELSE any_value(last) END, 6) AS value
FROM (SELECT *, first_value(value) OVER (PARTITION BY name, kind ORDER BY ts DESC, id DESC) AS last FROM metrics WHERE kind <> 'histogram') GROUP BY name, kind""")
def d3(spark, sf):
    scalars, _ = usage.metrics_rollup(frame(spark, sf, "metrics"))
    return scalars.withColumn("value", F.round("value", 6))


@query("d3_metrics_histograms", cte("metrics") + f"""SELECT name, {_STATS.format(v='value')}, round(sum(value), 6) AS sum, {_RANKS.format(v='value')}
FROM metrics WHERE kind = 'histogram' AND value IS NOT NULL GROUP BY name""")
def d3_hist(spark, sf):
    _, hist = usage.metrics_rollup(frame(spark, sf, "metrics"))
    return hist.withColumn("avg", F.round("avg", 6)).withColumn("sum", F.round("sum", 6))


def _errors(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("error_type"), "ts", "event_id")


@query("d4_error_counts", "SELECT event_type AS error_type, count(*) AS errors FROM events GROUP BY event_type")
def d4(spark, sf):
    return usage.error_counts(_errors(spark, sf))


@query("e1_running_error_alerts", """SELECT event_type AS error_type, ts, event_id, n AS nth, CASE WHEN n >= 10 THEN 'FATAL' ELSE 'ERROR' END AS level
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events)""")
def e1(spark, sf):
    return usage.running_error_alerts(_errors(spark, sf))


@query("e5_latest_per_key", "SELECT user_id, ts, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def e5(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return ordered.latest_per_key(e, ["user_id"], ["ts", "event_id"])


def _period_query(period: str) -> None:
    @query(f"d5_usage_by_{period}", cte("usage_events") + f"""SELECT user_id, event_type, CAST(date_trunc('{period}', timestamp) AS DATE) AS period, count(*) AS events
FROM usage_events WHERE timestamp >= TIMESTAMP '2024-01-03 00:00:00' GROUP BY ALL""")
    def run(spark, sf):
        return usage.usage_by_period(frame(spark, sf, "usage_events"), at("2024-01-03 00:00:00"), None, period)


for _p in ("day", "week", "month"):
    _period_query(_p)


@query("d6_plan_usage_report", cte("usage_events", "users", extra=_PLAN_VALUES) + """SELECT user_id, month, u.tier, n.secrets, n.rotations, n.api_calls,
 p.secrets AS secrets_limit, p.rotations AS rotations_limit, p.api_calls AS api_calls_limit,
 coalesce(p.secrets <> -1 AND n.secrets > p.secrets, false) OR coalesce(p.rotations <> -1 AND n.rotations > p.rotations, false) OR coalesce(p.api_calls <> -1 AND n.api_calls > p.api_calls, false) AS over_limit
FROM (SELECT user_id, CAST(date_trunc('month', timestamp) AS DATE) AS month, count(*) FILTER (event_type = 'secret_created') AS secrets,
 count(*) FILTER (event_type = 'secret_rotated') AS rotations, count(*) FILTER (event_type = 'api_call') AS api_calls FROM usage_events GROUP BY ALL) n
JOIN users u ON u.id = n.user_id LEFT JOIN plans p ON p.tier = u.tier AND p.interval = 'month'""")
def d6(spark, sf):
    return usage.plan_usage_report(frame(spark, sf, "usage_events"), frame(spark, sf, "users"))


@query("d8_distinct_services", cte("secrets") + "SELECT DISTINCT service FROM secrets")
def d8(spark, sf):
    return usage.distinct_services(frame(spark, sf, "secrets"))


@query("c3_missing_keys", cte("dep_names", "secrets", extra=_CI_RULES) + """SELECT DISTINCT d.project AS user_id, r.service FROM dep_names d JOIN rules r ON contains(lower(d.dep), r.pattern)
WHERE NOT EXISTS (SELECT 1 FROM secrets s WHERE s.is_active = 1 AND s.user_id = d.project AND s.service = r.service)""")
def c3(spark, sf):
    found = detect_services(frame(spark, sf, "dep_names")).withColumnRenamed("project", "user_id")
    return missing_keys(found, frame(spark, sf, "secrets"))


@query("g2_missing_keys_except", cte("dep_names", "secrets", extra=_CI_RULES) + """SELECT d.project AS user_id, r.service FROM dep_names d JOIN rules r ON contains(lower(d.dep), r.pattern)
EXCEPT SELECT user_id, service FROM secrets WHERE is_active = 1""")
def g2(spark, sf):
    found = detect_services(frame(spark, sf, "dep_names")).select(F.col("project").alias("user_id"), "service")
    return found.subtract(frame(spark, sf, "secrets").filter(F.col("is_active") == 1).select("user_id", "service"))


@query("c4_payments_to_usage", cte("billing_events", "users") + """SELECT u.id AS user_id, CASE type WHEN 'invoice.payment_succeeded' THEN 'payment_succeeded' ELSE 'payment_failed' END AS event_type,
 CASE WHEN type = 'invoice.payment_succeeded' THEN round(amount_paid / 100, 2) END AS amount, CAST(event_id AS VARCHAR) AS invoice, ts AS timestamp
FROM billing_events b JOIN users u ON u.stripe_customer_id = b.customer WHERE type IN ('invoice.payment_succeeded', 'invoice.payment_failed')""")
def c4(spark, sf):
    out = usage.payments_to_usage(frame(spark, sf, "billing_events"), frame(spark, sf, "users"))
    m = F.from_json("metadata", "amount double, invoiceId string")
    return out.select("user_id", "event_type", F.round(m["amount"], 2).alias("amount"), m["invoiceId"].alias("invoice"), "timestamp")


SUBSCRIBED = """last AS (SELECT * FROM billing_events WHERE type IN ('customer.subscription.created', 'customer.subscription.updated', 'customer.subscription.deleted')
QUALIFY row_number() OVER (PARTITION BY customer ORDER BY ts DESC, event_id DESC) = 1)"""
SUBSCRIBED_SELECT = """SELECT u.id, u.email, CASE WHEN l.customer IS NULL THEN u.tier WHEN l.type = 'customer.subscription.deleted' THEN 'free'
 WHEN contains(l.price_id, 'pro') THEN 'pro' WHEN contains(l.price_id, 'team') THEN 'team' WHEN contains(l.price_id, 'enterprise') THEN 'enterprise' ELSE 'free' END AS tier,
 CASE WHEN l.type <> 'customer.subscription.deleted' THEN CAST(l.event_id AS VARCHAR) END AS stripe_subscription_id, l.ts AS updated_at
FROM users u LEFT JOIN last l ON l.customer = u.stripe_customer_id"""


@query("c5_apply_subscription_events", cte("billing_events", "users", extra=SUBSCRIBED) + SUBSCRIBED_SELECT)
def c5(spark, sf):
    users = frame(spark, sf, "users").withColumn("stripe_subscription_id", F.lit(None).cast("string")).withColumn(
        "updated_at", F.lit(None).cast("timestamp_ntz"))
    out = usage.apply_subscription_events(users, frame(spark, sf, "billing_events"))
    return out.select("id", "email", "tier", "stripe_subscription_id", "updated_at")


@query("d12_health_report", """SELECT unnest(['has rows', 'ids unique', 'values positive', 'no errors']) AS name,
 unnest([CASE WHEN a THEN 'pass' ELSE 'fail' END, CASE WHEN b THEN 'pass' ELSE 'fail' END, CASE WHEN c THEN 'pass' ELSE 'fail' END, CASE WHEN d THEN 'pass' ELSE 'fail' END]) AS status,
 CASE WHEN a AND b AND c AND d THEN 'healthy' ELSE 'unhealthy' END AS overall
FROM (SELECT count(*) > 0 AS a, max(event_id) - min(event_id) + 1 = count(*) AS b, min(value) > 0 AS c, count(*) FILTER (event_type = 'error') = 0 AS d FROM events)""")
def d12(spark, sf):
    return usage.health_report(table(spark, sf, "events"), {
        "has rows": F.count("*") > 0,
        "ids unique": F.max("event_id") - F.min("event_id") + 1 == F.count("*"),
        "values positive": F.min("value") > 0,
        "no errors": F.count_if(F.col("event_type") == "error") == 0,
    })


_DAYS = f"floor((epoch_us(TIMESTAMP '{ORDERS_AT}') - epoch_us(coalesce(last_rotated_at, created_at))) / 86400000000)"


@query("d13_compliance_report", cte("secrets", "vault", "audit_logs") + f"""SELECT s.id AS secret_id, 'SOC2' AS framework, v.value_encrypted IS NOT NULL AS encryption_at_rest,
 a.secret_id IS NOT NULL AS access_logging, {_DAYS} < 90 AS key_rotation_policy,
 v.value_encrypted IS NOT NULL AND a.secret_id IS NOT NULL AND {_DAYS} < 90 AS compliant
FROM (SELECT id, created_at, last_rotated_at FROM secrets) s JOIN (SELECT id, value_encrypted FROM vault) v USING (id) LEFT JOIN (SELECT DISTINCT secret_id FROM audit_logs) a ON a.secret_id = s.id""")
def d13(spark, sf):
    secrets = frame(spark, sf, "secrets").join(frame(spark, sf, "vault").select("id", "value_encrypted"), "id")
    return usage.compliance_report(secrets, frame(spark, sf, "audit_logs"), "SOC2", at(ORDERS_AT))


@query("d13_compliance_compat", cte("secrets") + """SELECT id AS secret_id, 'GDPR' AS framework, true AS encryption_at_rest, true AS access_logging,
 true AS key_rotation_policy, true AS compliant FROM secrets""")
def d13_compat(spark, sf):
    return usage.compliance_report(frame(spark, sf, "secrets"), frame(spark, sf, "audit_logs"), "GDPR", at(ORDERS_AT), compat=True)


@query("d14_compliance_history", cte("validations") + """SELECT id, secret_id, framework, is_compliant, validated_at FROM validations
QUALIFY row_number() OVER (PARTITION BY secret_id, framework ORDER BY validated_at DESC, id DESC) = 1""")
def d14(spark, sf):
    return usage.compliance_history(frame(spark, sf, "validations"))
