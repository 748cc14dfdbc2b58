"""Listings, lookups, authentication and ownership over request tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keyquarry import rules
from keyquarry.functions.text import json_array, sha256_base64


def list_secrets(secrets: DataFrame, user_id: str | None = None, environment: str | None = None) -> DataFrame:
    """Active secrets, newest first; both filters reach the scan."""
    df = secrets.filter(F.col("is_active") == 1)
    if user_id is not None:
        df = df.filter(F.col("user_id") == user_id)
    if environment is not None:
        df = df.filter(F.col("environment") == environment)
    if dict(df.dtypes).get("scopes") == "string":
        df = df.withColumn("scopes", json_array(F.col("scopes")))
    return df.orderBy(F.desc("created_at"), "id")


def list_vault(
    secrets: DataFrame, project: str | None = None, environment: str | None = None, tags: list[str] | None = None
) -> DataFrame:
    """Vault rows by project, environment and any of ``tags`` (whole tag names), without values."""
    df = secrets
    if project is not None:
        df = df.filter(F.col("project") == project)
    if environment is not None:
        df = df.filter(F.col("environment") == environment)
    if tags:
        have = json_array(F.col("tags")) if dict(df.dtypes)["tags"] == "string" else F.col("tags")
        df = df.filter(F.arrays_overlap(have, F.array(*[F.lit(t) for t in tags])))
    return df.drop("value_encrypted")


def group_by_environment(secrets: DataFrame) -> DataFrame:
    """Listing ordered by environment, then name; values are never selected.

    One row per secret: the grouping is the order, so no environment is gathered into one row.
    """
    cols = [c for c in ("environment", "name", "id", "tags", "updated_at") if c in secrets.columns]
    return secrets.select(*cols).orderBy(*[c for c in ("environment", "name", "id") if c in cols])


def environment_counts(secrets: DataFrame) -> DataFrame:
    """Number of secrets per environment."""
    return secrets.groupBy("environment").agg(F.count("*").alias("secrets"))


def lookup(keys: DataFrame, secrets: DataFrame, on: str | list[str] = "id") -> DataFrame:
    """Left join of a batch of keys; missing ones keep null columns."""
    return keys.join(secrets, on, "left")


def lookup_by_name(keys: DataFrame, secrets: DataFrame) -> DataFrame:
    return lookup(keys, secrets, ["name", "project", "environment"])


def list_api_keys(api_keys: DataFrame, user_id: str | None = None) -> DataFrame:
    """Keys of a user, newest first, without the hash."""
    df = api_keys if user_id is None else api_keys.filter(F.col("user_id") == user_id)
    order = [F.desc("created_at")] if "created_at" in df.columns else []
    return df.drop("key_hash").orderBy(*order, "id")


def query_audit(
    audit: DataFrame,
    start=None,
    end=None,
    action: str | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """One page of audit rows, newest first (the page size is at most 100)."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    df = audit
    if start is not None:
        df = df.filter(F.col("timestamp") >= F.lit(start))
    if end is not None:
        df = df.filter(F.col("timestamp") <= F.lit(end))
    if action is not None:
        df = df.filter(F.col("action") == action)
    return page(df, [F.desc("timestamp"), F.col("id")], limit, offset)


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def gate_by_tier(df: DataFrame, allowed: list[str], user: str = "user_id", tier: str = "tier") -> DataFrame:
    """Adds ``http_status``: 401 without user, 403 for another tier, else 200."""
    ok = F.coalesce(F.col(tier).isin(allowed), F.lit(False))
    return df.withColumn("http_status", F.when(F.col(user).isNull(), 401).when(~ok, 403).otherwise(200))


def level_value(level: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, n in rules.LOG_LEVELS.items():
        out = F.when(level == name, F.lit(n)).otherwise(out)
    return out


def filter_logs(logs: DataFrame, min_level: str = "INFO", context: str | None = None) -> DataFrame:
    """Rows at or above a level; null entries of the context map are dropped."""
    df = logs.filter(level_value(F.col("level")) >= rules.LOG_LEVELS[min_level])
    if context:
        df = df.withColumn(context, F.map_filter(context, lambda k, v: v.isNotNull()))
    return df


def merge_context(base: Column, child: Column) -> Column:
    """Union of two maps; the child's entries win."""
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(child, k))
    return F.map_concat(kept, child)


def slow_operations(timings: DataFrame, limit_ms: float = 1000) -> DataFrame:
    return timings.filter(F.col("duration_ms") > limit_ms)


def _valid_keys(api_keys: DataFrame, users: DataFrame) -> DataFrame:
    """Keys that are not revoked, with their user and the time until which they are valid (``_until``)."""
    extra = [c for c in ("email", "organization_id") if c in users.columns]
    live = api_keys.filter(F.col("revoked") == 0).select(
        F.col("key_hash").alias("_hash"), F.col("user_id").alias("_uid"), F.col("expires_at").alias("_until"))
    people = users.select(F.col("id").alias("_uid"), "tier", *extra)
    return live.join(people, "_uid").withColumnRenamed("_uid", "user_id")


def _opens(at: Column) -> Column:
    """Join condition: the request's key, not expired at ``at``, which may be a column of the request."""
    return (F.col("_asked") == F.col("_hash")) & (F.col("_until").isNull() | (F.col("_until") > at))


def authenticate(requests: DataFrame, api_keys: DataFrame, users: DataFrame, at: Column, key: str = "api_key") -> DataFrame:
    """Requests whose key is valid at ``at`` (such as the request's time), with user and tier (the rest would get 401)."""
    candidates = requests.filter(F.startswith(F.col(key), F.lit(rules.API_KEY_PREFIX)))
    hashed = candidates.withColumn("_asked", sha256_base64(F.col(key)))
    return hashed.join(_valid_keys(api_keys, users), _opens(at)).drop("_asked", "_hash", "_until")


def optional_authenticate(
    requests: DataFrame, api_keys: DataFrame, users: DataFrame, at: Column, key: str = "api_key"
) -> DataFrame:
    """As ``authenticate`` but every request is kept; user columns are null without a valid key.

    Requests without a usable key take part in the join under a text that no digest equals,
    made of the whole row, so they are spread over the tasks.
    """
    usable = F.startswith(F.col(key), F.lit(rules.API_KEY_PREFIX))
    alone = F.concat(F.lit("-"), F.xxhash64(*[F.col(f"`{c}`") for c in requests.columns]))
    hashed = requests.withColumn("_asked", F.when(usable, sha256_base64(F.col(key))).otherwise(alone))
    return hashed.join(_valid_keys(api_keys, users), _opens(at), "left").drop("_asked", "_hash", "_until")


def check_ownership(requests: DataFrame, secrets: DataFrame) -> DataFrame:
    """Adds ``http_status`` to (secret_id, user_id) requests: 404 unknown, 403 not the owner, 200."""
    owners = secrets.select(F.col("id").alias("secret_id"), F.col("user_id").alias("_owner"))
    # A secret always has an owner in the API tables; a null one owns nothing.
    owners = owners.withColumn("_known", F.lit(1))
    status = (
        F.when(F.col("_known").isNull(), 404)
        .when(~F.col("_owner").eqNullSafe(F.col("user_id")), 403)
        .otherwise(200)
    )
    return requests.join(owners, "secret_id", "left").withColumn("http_status", status).drop("_owner", "_known")


def pair_requests(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with their response on request_id: status and duration in milliseconds."""
    from keyquarry.functions.access import micros

    resp = responses.select("request_id", F.col("ts").alias("response_ts"), "status")
    return requests.join(resp, "request_id").withColumn(
        "duration_ms", (micros(F.col("response_ts")) - micros(F.col("ts"))) / 1000
    )


def plan_for(users: DataFrame, interval: str = "month") -> DataFrame:
    """Plan of each user's tier: ``free`` has one plan, ``enterprise`` none."""
    plans = F.broadcast(
        rules.plans_df(users.sparkSession).select(
            F.col("key").alias("plan_key"), "price_id", "price", "secrets", "rotations", "api_calls", "team_members"
        )
    )
    key = F.when(F.col("tier") == "free", F.lit("free")).otherwise(F.concat("tier", F.lit(f"_{interval}ly")))
    return users.join(plans, key == F.col("plan_key"), "left")
