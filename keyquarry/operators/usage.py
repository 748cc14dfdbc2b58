"""Quotas, usage, latency, error, health and compliance reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keyquarry import rules
from keyquarry.functions.access import is_rotation_overdue, tier_from_price
from keyquarry.operators.ordered import exact_rank_percentiles, latest_per_key, running_count

PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def secret_quota(secrets: DataFrame, users: DataFrame) -> DataFrame:
    """Active secrets of every user against the tier's limit (-1 is unlimited)."""
    used = secrets.filter(F.col("is_active") == 1).groupBy("user_id").agg(F.count("*").alias("used"))
    limit = F.lit(rules.DEFAULT_SECRET_LIMIT)
    for tier, n in rules.TIER_SECRET_LIMIT.items():
        limit = F.when(F.col("tier") == tier, F.lit(n)).otherwise(limit)
    people = users.select(F.col("id").alias("user_id"), "tier")
    return people.join(used, "user_id", "left").select(
        "user_id", "tier",
        F.coalesce("used", F.lit(0)).alias("used"),
        limit.alias("quota"),
    ).withColumn("blocked", (F.col("quota") != -1) & (F.col("used") >= F.col("quota")))


def _number(value: str) -> Column:
    """A value, NaN as missing."""
    return F.when(~F.isnan(F.col(value).cast("double")), F.col(value))


def operation_stats(
    timings: DataFrame, by: str = "operation", value: str = "duration_ms", approx: bool = False, with_sum: bool = False
) -> DataFrame:
    """count, avg, min, max and p50/p95/p99 of the values per operation; an operation without values counts 0.

    ``approx=True`` reads the percentiles from sketches of one pass and says so in the names; the groups are the same.
    """
    v = _number(value)
    aggs = [F.count(v).alias("count"), F.avg(v).alias("avg"), F.min(v).alias("min"), F.max(v).alias("max")]
    if with_sum:
        aggs.append(F.sum(v).alias("sum"))
    if approx:
        return _percentiles_of(timings.groupBy(by).agg(*aggs, F.kll_sketch_agg_double(v.cast("double"), F.lit(_SKETCH)).alias("_sketch")))
    return exact_rank_percentiles(timings, [by], value, PERCENTILES, extra=aggs)


#: Size of a quantile sketch: ranks are off by about a thousandth.
_SKETCH = 4000


def _percentiles_of(sketched: DataFrame) -> DataFrame:
    ps = {f"{name}_approx": F.when(F.col("count") > 0, F.kll_sketch_get_quantile_double("_sketch", F.lit(p))) for name, p in PERCENTILES.items()}
    return sketched.withColumns(ps).drop("_sketch")


def daily_sketches(timings: DataFrame, by: str = "operation", value: str = "duration_ms", ts: str = "ts") -> DataFrame:
    """(``by``, day, count, total, min, max, sketch): what is stored of a day, small and mergeable, so that no report reads its rows again."""
    v = _number(value).cast("double")
    return timings.groupBy(F.col(by), F.col(ts).cast("date").alias("day")).agg(
        F.count(v).alias("count"), F.sum(v).alias("total"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.kll_sketch_agg_double(v, F.lit(_SKETCH)).alias("sketch"))


def merged_stats(days: DataFrame, by: str = "operation") -> DataFrame:
    """``operation_stats(approx=True)`` over any stored days."""
    merged = days.groupBy(by).agg(
        F.sum("count").alias("count"), (F.sum("total") / F.sum("count")).alias("avg"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.kll_merge_agg_double("sketch", F.lit(_SKETCH)).alias("_sketch"))
    return _percentiles_of(merged.withColumn("avg", F.when(F.col("count") > 0, F.col("avg"))))


def rank_errors(approx: DataFrame, timings: DataFrame, by: str = "operation", value: str = "duration_ms") -> DataFrame:
    """For each group and approximate percentile how far its rank is off, as a share of the group's values: (``by``, p50_error, …); null without values."""
    names = [f"{n}_approx" for n in PERCENTILES]
    marks = approx.select(F.col(by).alias("_by"), *names)
    v = _number(value).cast("double")
    joined = timings.withColumn("_v", v).join(marks, F.col(by).eqNullSafe(F.col("_by")))
    n = F.count("_v")
    out = []
    for name, p in PERCENTILES.items():
        a = F.col(f"{name}_approx")
        less, upto = F.count(F.when(F.col("_v") < a, 1)) / n, F.count(F.when(F.col("_v") <= a, 1)) / n
        # the value stands for all ranks between the two shares
        out.append(F.when(n > 0, F.greatest(less - p, p - upto, F.lit(0.0))).alias(f"{name}_error"))
    return joined.groupBy(by).agg(*out)


def metrics_rollup(metrics: DataFrame, order: str = "id") -> tuple[DataFrame, DataFrame]:
    """(counters and gauges, histograms) of (name, kind, value, ts, order) rows.

    A counter without value counts 1; a gauge is its last value.
    """
    simple = metrics.filter(F.col("kind").isin("counter", "gauge")).groupBy("name", "kind").agg(
        F.sum(F.coalesce("value", F.lit(1.0))).alias("_sum"),
        F.max_by("value", F.struct("ts", order)).alias("_last"),
    )
    scalars = simple.select(
        "name", "kind", F.when(F.col("kind") == "counter", F.col("_sum")).otherwise(F.col("_last")).alias("value")
    )
    hist = metrics.filter(F.col("kind") == "histogram")
    return scalars, operation_stats(hist, "name", "value", with_sum=True)


def error_counts(errors: DataFrame, by: str = "error_type") -> DataFrame:
    return errors.groupBy(by).agg(F.count("*").alias("errors"))


def running_error_alerts(
    errors: DataFrame, by: str = "error_type", ts: str = "ts", order: str = "event_id", threshold: int = 10
) -> DataFrame:
    """Occurrence number of each error within its type; ``fatal`` from the threshold on."""
    return running_count(errors, [by], ts, order, "nth").withColumn(
        "level", F.when(F.col("nth") >= threshold, F.lit("FATAL")).otherwise(F.lit("ERROR"))
    )


def usage_by_period(usage: DataFrame, start=None, end=None, group_by: str = "day") -> DataFrame:
    """Events per user, type and day, ISO week or month."""
    if group_by not in ("day", "week", "month"):
        raise ValueError("group_by must be day, week or month")
    df = usage
    if start is not None:
        df = df.filter(F.col("timestamp") >= F.lit(start))
    if end is not None:
        df = df.filter(F.col("timestamp") <= F.lit(end))
    return df.groupBy(
        "user_id", "event_type", F.date_trunc(group_by, "timestamp").cast("date").alias("period")
    ).agg(F.count("*").alias("events"))


def plan_usage_report(usage: DataFrame, users: DataFrame) -> DataFrame:
    """Secrets, rotations and API calls per user and month against the monthly plan."""
    used = usage.groupBy("user_id", F.date_trunc("month", "timestamp").cast("date").alias("month")).agg(
        *[F.count_if(F.col("event_type") == e).alias(n) for e, n in
          [("secret_created", "secrets"), ("secret_rotated", "rotations"), ("api_call", "api_calls")]]
    )
    plans = rules.plans_df(usage.sparkSession).filter(F.col("interval") == "month").select(
        "tier", *[F.col(c).alias(f"{c}_limit") for c in ("secrets", "rotations", "api_calls")]
    )
    people = users.select(F.col("id").alias("user_id"), "tier").join(F.broadcast(plans), "tier", "left")
    over = F.lit(False)
    for c in ("secrets", "rotations", "api_calls"):
        limit = F.coalesce(F.col(f"{c}_limit"), F.lit(-1))
        over = over | ((limit != -1) & (F.col(c) > limit))
    return used.join(people, "user_id").withColumn("over_limit", over)


def distinct_services(secrets: DataFrame) -> DataFrame:
    return secrets.select("service").distinct()


def payments_to_usage(invoices: DataFrame, users: DataFrame) -> DataFrame:
    """Usage rows of invoice events; customers without a user yield nothing."""
    paid = F.col("type") == "invoice.payment_succeeded"
    events = invoices.filter(F.col("type").isin("invoice.payment_succeeded", "invoice.payment_failed"))
    people = users.select(F.col("id").alias("user_id"), F.col("stripe_customer_id").alias("customer"))
    amount = F.when(paid, F.col("amount_paid") / 100)
    invoice = F.col("event_id").cast("string").alias("invoiceId")
    return events.join(people, "customer").select(
        "user_id",
        F.when(paid, F.lit("payment_succeeded")).otherwise(F.lit("payment_failed")).alias("event_type"),
        F.to_json(F.struct(amount.alias("amount"), invoice)).alias("metadata"),
        F.col("ts").alias("timestamp"),
    )


def apply_subscription_events(users: DataFrame, events: DataFrame, applied: tuple[str, str] | None = None) -> DataFrame:
    """New users snapshot after subscription events; the last event per customer decides.

    ``applied`` names two columns of ``users`` with the time and id of the last event that was
    applied; an event before that one changes nothing, and the columns follow the events.
    """
    subs = events.filter(
        F.col("type").isin(*[f"customer.subscription.{s}" for s in ("created", "updated", "deleted")])
    )
    last = latest_per_key(
        subs.select("customer", "ts", "event_id", "type", "price_id"), ["customer"], ["ts", "event_id"]
    ).select(
        F.col("customer").alias("stripe_customer_id"),
        F.lit(1).alias("_hit"),
        F.col("ts").alias("_ts"),
        F.col("event_id").alias("_id"),
        (F.col("type") == "customer.subscription.deleted").alias("_gone"),
        tier_from_price(F.col("price_id")).alias("_tier"),
        F.col("event_id").cast("string").alias("_sub"),
    )
    old = users
    for c, t in (("stripe_subscription_id", "string"), ("updated_at", "timestamp_ntz")):
        if c not in old.columns:
            old = old.withColumn(c, F.lit(None).cast(t))
    joined = old.join(last, "stripe_customer_id", "left")
    hit = F.col("_hit").isNotNull()
    if applied:
        at, of = (F.col(c) for c in applied)
        hit = hit & (at.isNull() | (F.col("_ts") > at) | ((F.col("_ts") == at) & (F.col("_id") >= of)))
    changed = {
        "tier": F.when(hit & F.col("_gone"), F.lit("free")).when(hit, F.col("_tier")).otherwise(F.col("tier")),
        "stripe_subscription_id": F.when(hit & ~F.col("_gone"), F.col("_sub")).when(~hit, F.col("stripe_subscription_id")),
        "updated_at": F.when(hit, F.col("_ts")).otherwise(F.col("updated_at")),
    }
    if applied:
        changed |= {applied[0]: F.when(hit, F.col("_ts")).otherwise(at), applied[1]: F.when(hit, F.col("_id")).otherwise(of)}
    return joined.withColumns(changed).select(*old.columns)


def health_report(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(name, status, overall) of boolean aggregate expressions, all from one pass.

    A check that is null (an empty table, a failed ``try_`` expression) fails.
    """
    names = list(checks)
    flat = df.agg(*[F.coalesce(checks[n], F.lit(False)).alias(f"_{i}") for i, n in enumerate(names)])
    all_ok = F.lit(True)
    for i in range(len(names)):
        all_ok = all_ok & F.col(f"_{i}")
    rows = F.array(*[
        F.struct(F.lit(n).alias("name"), F.when(F.col(f"_{i}"), F.lit("pass")).otherwise(F.lit("fail")).alias("status"))
        for i, n in enumerate(names)
    ])
    overall = F.when(all_ok, F.lit("healthy")).otherwise(F.lit("unhealthy"))
    return flat.select(overall.alias("overall"), F.explode(rows).alias("_r")).select("_r.name", "_r.status", "overall")


def compliance_report(
    secrets: DataFrame,
    audit: DataFrame,
    framework: str,
    at: Column,
    policy_days: int = rules.DEFAULT_ROTATION_DAYS,
    compat: bool = False,
) -> DataFrame:
    """Three checks and the verdict per secret.  ``compat=True`` passes everything."""
    if framework not in rules.FRAMEWORKS:
        raise ValueError(f"unknown framework {framework!r}")
    logged = audit.select(F.col("secret_id").alias("id")).distinct().withColumn("_logged", F.lit(True))
    value = F.col("value_encrypted") if "value_encrypted" in secrets.columns else F.lit(None)
    since = F.coalesce("last_rotated_at", "created_at")
    overdue = is_rotation_overdue(since, policy_days, at)

    def passed(c: Column) -> Column:
        return F.lit(True) if compat else F.coalesce(c, F.lit(False))

    out = secrets.join(logged, "id", "left").select(
        F.col("id").alias("secret_id"),
        F.lit(framework).alias("framework"),
        passed(value.isNotNull()).alias("encryption_at_rest"),
        passed(F.col("_logged")).alias("access_logging"),
        passed(~overdue).alias("key_rotation_policy"),
    )
    ok = F.col("encryption_at_rest") & F.col("access_logging") & F.col("key_rotation_policy")
    return out.withColumn("compliant", ok)


def validation_rows(report: DataFrame, at: Column) -> DataFrame:
    """A compliance report as rows of the validation history."""
    def check(name, col):
        return F.struct(F.lit(name).alias("name"), F.col(col).alias("passed"), F.lit(None).cast("string").alias("message"))

    checks = F.array(
        check("Encryption at rest", "encryption_at_rest"),
        check("Access logging", "access_logging"),
        check("Key rotation policy", "key_rotation_policy"),
    )
    return report.select(
        "secret_id", "framework", F.col("compliant").cast("int").alias("is_compliant"),
        F.struct(checks.alias("checks")).alias("validation_results"), at.alias("validated_at"),
    )


def compliance_history(validations: DataFrame) -> DataFrame:
    """Latest validation per secret and framework."""
    order = ["validated_at", "id"] if "id" in validations.columns else ["validated_at"]
    return latest_per_key(validations, ["secret_id", "framework"], order)
