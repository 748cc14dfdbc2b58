"""Queries: listings, lookups, authentication, joins, admission, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyquarry import rules
from keyquarry.functions import access as fx, text as tx
from keyquarry.operators import access, ratelimit, vault
from keyquarry.plans.checks import lit, values
from keyquarry.plans.registry import query
from keyquarry.schemas import canonical_environment
from keyquarry.session import new_path
from keyquarry.sources.fixtures import cte, frame, sql, table
from keyquarry.sources.tables import append_audit, append_usage, read_table, write_table

EVENTS_AT = "2024-01-10 00:00:00"
ORDERS_AT = "1999-01-01 00:00:00"
_WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '"


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


# ---------------------------------------------------------------- sources and sinks

@query("a1_read_table", cte("vault") + """SELECT id, name, project, environment, array_to_string(CAST(tags AS JSON)::VARCHAR[], ',') AS tags,
 value_encrypted, created_at, updated_at, CAST(NULL AS VARCHAR) AS service FROM vault""")
def a1(spark, sf):
    folder = new_path(spark, "tables")
    write_table(frame(spark, sf, "vault"), "secrets", folder)
    out = read_table(spark, "secrets", folder)
    return out.select("id", "name", "project", "environment", F.array_join("tags", ",").alias("tags"),
                      "value_encrypted", "created_at", "updated_at", "service")


@query("a7_append_audit", cte("audit_logs") + "SELECT id, secret_id, user_id, action, timestamp, CAST(timestamp AS DATE) AS date FROM audit_logs")
def a7_audit(spark, sf):
    path = new_path(spark, "audit")
    append_audit(frame(spark, sf, "audit_logs"), path)
    return spark.read.parquet(path).select("id", "secret_id", "user_id", "action", "timestamp", "date")


@query("a7_append_usage", cte("usage_events") + "SELECT id, user_id, event_type, timestamp, CAST(timestamp AS DATE) AS date FROM usage_events")
def a7_usage(spark, sf):
    path = new_path(spark, "usage")
    append_usage(frame(spark, sf, "usage_events"), path)
    return spark.read.parquet(path).select("id", "user_id", "event_type", "timestamp", "date")


_QUOTED = "CASE WHEN regexp_matches(value, '[\\s#]') THEN '\"' || replace(replace(value, '\\', '\\\\'), '\"', '\\\"') || '\"' ELSE value END"
_PAIRS = """SELECT concat('KEY_', CAST(p_partkey AS VARCHAR(20))) AS name,
 CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN p_name WHEN 1 THEN p_type WHEN 2 THEN p_brand WHEN 3 THEN concat('a"b', chr(92), p_type) ELSE concat('x"y', chr(92), p_name) END AS value FROM part"""


def _export_query(fmt: str, line: str) -> None:
    @query(f"a5_export_{fmt}", f"SELECT name, {line} AS line FROM ({_PAIRS}) ORDER BY name")
    def run(spark, sf):
        return vault.export_pairs(sql(spark, sf, _PAIRS), fmt)


_export_query("env", f"name || '=' || {_QUOTED}")
_export_query("yaml", "name || ': \"' || replace(replace(value, '\\', '\\\\'), '\"', '\\\"') || '\"'")
_export_query("json", "to_json(map([name], [value]))::VARCHAR")


@query("a6_overlay_config", cte("env_lines", "env_overrides", extra=f"""parsed AS (SELECT project, line_no, trim(split_part(t, '=', 1), {_WS}) AS name,
 CASE WHEN contains(t, '=') THEN substr(t, instr(t, '=') + 1) ELSE '' END AS value
 FROM (SELECT project, line_no, trim(line, {_WS}) AS t FROM env_lines) WHERE t <> '' AND NOT starts_with(t, '#') AND split_part(t, '=', 1) <> ''),
base AS (SELECT project, name, min(line_no) AS place, arg_max(value, line_no) AS value FROM parsed GROUP BY ALL),
over_ AS (SELECT project, name, min(position) AS position, arg_max(value, position) AS value FROM env_overrides GROUP BY ALL)""") + f"""
SELECT project, name, value, name || '=' || {_QUOTED} AS line, appended, place FROM (
 SELECT coalesce(b.project, o.project) AS project, coalesce(b.name, o.name) AS name, coalesce(o.value, b.value) AS value,
  b.name IS NULL AS appended, coalesce(b.place, o.position) AS place
 FROM base b FULL OUTER JOIN over_ o ON b.project = o.project AND b.name = o.name)""")
def a6(spark, sf):
    out = vault.overlay_config(frame(spark, sf, "env_lines"), frame(spark, sf, "env_overrides"), ["project"])
    return out.select("project", "name", "value", "line", "sort.appended", "sort.place")


_PLAN_VALUES = values([(lit(p.key), lit(p.tier), lit(p.name), str(p.price), lit(p.interval), str(p.secrets), str(p.rotations), str(p.api_calls))
                       for p in rules.PLANS], "plans", ["key", "tier", "name", "price", "interval", "secrets", "rotations", "api_calls"])


@query("a8_plans", cte("users", extra=_PLAN_VALUES) + """SELECT p.key, p.name, p.price, p.interval, count(u.id) AS users
FROM plans p LEFT JOIN users u ON u.tier = p.tier GROUP BY ALL""")
def a8_plans(spark, sf):
    people = frame(spark, sf, "users").groupBy("tier").agg(F.count("*").alias("users"))
    plans = rules.plans_df(spark).select("key", "name", "price", "interval", "tier")
    return plans.join(people, "tier", "left").fillna(0, ["users"]).drop("tier")


_TIER_VALUES = values([(lit(t), str(rules.TIER_REQUESTS_PER_MINUTE[t]), str(rules.TIER_SECRET_LIMIT[t])) for t in rules.TIERS],
                      "tiers", ["tier", "requests_per_minute", "secret_limit"])


@query("a8_tiers", cte("requests", extra=_TIER_VALUES) + """SELECT t.tier, requests_per_minute, secret_limit, count(r.request_id) AS requests
FROM tiers t LEFT JOIN requests r USING (tier) GROUP BY ALL""")
def a8_tiers(spark, sf):
    n = frame(spark, sf, "requests").groupBy("tier").agg(F.count("*").alias("requests"))
    return rules.tiers_df(spark).join(n, "tier", "left").fillna(0, ["requests"])


# ---------------------------------------------------------------- listings

_SCOPED_SECRETS = "(SELECT *, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN NULL WHEN CAST(id AS BIGINT) % 3 = 1 THEN '[\"read\",\"write\"]' ELSE '' END AS scopes FROM secrets)"


def _scoped_secrets(spark, sf):
    n = F.col("id").cast("bigint") % 3
    return frame(spark, sf, "secrets").withColumn(
        "scopes", F.when(n == 1, F.lit('["read","write"]')).when(n == 2, F.lit("")))


@query("b1_list_secrets", cte("secrets") + f"""SELECT id, user_id, service, environment, created_at,
 array_to_string(CAST(coalesce(nullif(scopes, ''), '[]') AS JSON)::VARCHAR[], ',') AS scopes FROM {_SCOPED_SECRETS} WHERE is_active = 1 ORDER BY created_at DESC, id""")
def b1(spark, sf):
    out = access.list_secrets(_scoped_secrets(spark, sf))
    return out.select("id", "user_id", "service", "environment", "created_at", F.array_join("scopes", ",").alias("scopes"))


@query("b1_list_secrets_of_user", cte("secrets") + """SELECT id, service, created_at FROM secrets
WHERE is_active = 1 AND user_id = '7' AND environment = 'dev' ORDER BY created_at DESC, id""")
def b1_user(spark, sf):
    return access.list_secrets(frame(spark, sf, "secrets"), "7", "dev").select("id", "service", "created_at")


@query("b2_list_vault", cte("vault") + """SELECT id, name, project, environment, tags FROM vault
WHERE environment = 'dev' AND (list_contains(CAST(tags AS JSON)::VARCHAR[], 'critical') OR list_contains(CAST(tags AS JSON)::VARCHAR[], 'database'))""")
def b2(spark, sf):
    return access.list_vault(frame(spark, sf, "vault"), None, "dev", ["critical", "database"]).select("id", "name", "project", "environment", "tags")


@query("b3_group_by_environment", cte("vault") + "SELECT environment, name, id, tags, updated_at FROM vault ORDER BY environment, name, id")
def b3(spark, sf):
    return access.group_by_environment(frame(spark, sf, "vault"))


@query("b3_environment_counts", cte("vault") + "SELECT environment, count(*) AS secrets FROM vault GROUP BY environment")
def b3_counts(spark, sf):
    return access.environment_counts(frame(spark, sf, "vault"))


@query("b4_lookup", cte("secrets") + """SELECT k.id, s.user_id, s.service, s.environment
FROM (SELECT DISTINCT CAST(l_partkey * 11 AS VARCHAR(20)) AS id FROM lineitem) k LEFT JOIN secrets s ON s.id = k.id""")
def b4(spark, sf):
    keys = table(spark, sf, "lineitem").select((F.col("l_partkey") * 11).cast("string").alias("id")).distinct()
    return access.lookup(keys, frame(spark, sf, "secrets").select("id", "user_id", "service", "environment"))


@query("b4_lookup_by_name", cte("vault", "vault_changes") + """SELECT k.name, k.project, k.environment, v.id, v.value_encrypted
FROM (SELECT DISTINCT name, project, environment FROM vault_changes) k LEFT JOIN vault v USING (name, project, environment)""")
def b4_name(spark, sf):
    keys = frame(spark, sf, "vault_changes").select("name", "project", "environment").distinct()
    return access.lookup_by_name(keys, frame(spark, sf, "vault").select("name", "project", "environment", "id", "value_encrypted"))


def _api_keys(spark, sf, fixture="api_keys"):
    return frame(spark, sf, fixture).select(
        "id", "user_id", F.base64(F.unhex("key_hash_hex")).alias("key_hash"), "revoked", "expires_at")


@query("b5_list_api_keys", cte("api_keys") + "SELECT id, user_id, revoked, expires_at FROM api_keys ORDER BY id")
def b5(spark, sf):
    return access.list_api_keys(_api_keys(spark, sf))


@query("b6_query_audit", cte("audit_logs") + """SELECT id, secret_id, user_id, action, timestamp FROM audit_logs
WHERE timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp <= TIMESTAMP '2024-01-20 00:00:00' AND action = 'retrieved'
ORDER BY timestamp DESC, id LIMIT 50 OFFSET 20""")
def b6(spark, sf):
    return access.query_audit(frame(spark, sf, "audit_logs"), at("2024-01-05 00:00:00"), at("2024-01-20 00:00:00"), "retrieved", 50, 20)


@query("f5_page", cte("secrets") + "SELECT id, user_id, created_at FROM secrets ORDER BY created_at DESC, id LIMIT 25 OFFSET 75")
def f5(spark, sf):
    return access.page(frame(spark, sf, "secrets").select("id", "user_id", "created_at"), [F.desc("created_at"), F.col("id")], 25, 75)


@query("f1_newest_first", cte("secrets") + "SELECT id, user_id, service, created_at FROM secrets WHERE is_active = 1 AND environment = 'prod' ORDER BY created_at DESC, id")
def f1(spark, sf):
    return access.list_secrets(frame(spark, sf, "secrets"), environment="prod").select("id", "user_id", "service", "created_at")


@query("b7_gate_by_tier", cte("requests") + """SELECT request_id, user_id, tier, CASE WHEN user_id IS NULL THEN 401
 WHEN tier IN ('pro', 'team', 'enterprise') THEN 200 ELSE 403 END AS http_status
FROM (SELECT request_id, CASE WHEN request_id % 10 = 0 THEN NULL ELSE user_id END AS user_id, tier FROM requests)""")
def b7(spark, sf):
    df = frame(spark, sf, "requests").select("request_id", F.when(F.col("request_id") % 10 != 0, F.col("user_id")).alias("user_id"), "tier")
    return access.gate_by_tier(df, ["pro", "team", "enterprise"])


_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'FATAL' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END"
_LOGS = f"SELECT event_id, {_LEVEL} AS level, map_from_arrays(array('user', 'extra'), array(CAST(user_id AS STRING), CASE WHEN value > 5 THEN event_type END)) AS context FROM events"


@query("b8_filter_logs", f"""SELECT event_id, level, CASE WHEN value > 5 THEN 'extra,user' ELSE 'user' END AS keys
FROM (SELECT *, {_LEVEL} AS level FROM events) WHERE level IN ('WARN', 'ERROR', 'FATAL')""")
def b8(spark, sf):
    out = access.filter_logs(sql(spark, sf, _LOGS), "WARN", "context")
    return out.select("event_id", "level", F.array_join(F.array_sort(F.map_keys("context")), ",").alias("keys"))


@query("b9_merge_context", """SELECT event_id, CAST(user_id AS VARCHAR) AS user, event_type AS op, CASE WHEN event_id % 2 = 0 THEN 'child' ELSE 'base' END AS origin FROM events""")
def b9(spark, sf):
    e = table(spark, sf, "events")
    base = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("origin"), F.lit("base"))
    own = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("op"), F.col("event_type"), F.lit("origin"), F.lit("child"))).otherwise(
        F.create_map(F.lit("op"), F.col("event_type")))
    m = e.select("event_id", access.merge_context(base, own).alias("m"))
    return m.select("event_id", *[F.col("m")[k].alias(k) for k in ("user", "op", "origin")])


@query("b10_slow_operations", cte("op_timings") + "SELECT operation, duration_ms, event_id FROM op_timings WHERE duration_ms > 1000")
def b10(spark, sf):
    return access.slow_operations(frame(spark, sf, "op_timings")).select("operation", "duration_ms", "event_id")


# ---------------------------------------------------------------- joins

_LIVE = f"""live AS (SELECT k.user_id, k.key_hash_hex, u.tier, u.email FROM api_keys k JOIN users u ON u.id = k.user_id
WHERE revoked = 0 AND (expires_at IS NULL OR expires_at > TIMESTAMP '{EVENTS_AT}'))"""


@query("c1_authenticate", cte("keyed_requests", "api_keys", "users", extra=_LIVE) + """SELECT request_id, user_id, tier, email
FROM keyed_requests r JOIN live ON sha256(r.api_key) = key_hash_hex WHERE starts_with(api_key, 'sf_')""")
def c1(spark, sf):
    out = access.authenticate(frame(spark, sf, "keyed_requests"), _api_keys(spark, sf), frame(spark, sf, "users"), at(EVENTS_AT))
    return out.select("request_id", "user_id", "tier", "email")


@query("c2_optional_authenticate", cte("keyed_requests", "api_keys", "users", extra=_LIVE) + """SELECT request_id, user_id, tier
FROM keyed_requests r LEFT JOIN live ON sha256(r.api_key) = key_hash_hex AND starts_with(api_key, 'sf_')""")
def c2(spark, sf):
    out = access.optional_authenticate(frame(spark, sf, "keyed_requests"), _api_keys(spark, sf), frame(spark, sf, "users"), at(EVENTS_AT))
    return out.select("request_id", "user_id", "tier")


# Keys that end inside the log, judged at the time of each request.
_AS_OF = """owned AS (SELECT key_hash_hex, users.id AS user_id, tier, expires_at FROM api_keys JOIN users ON users.id = api_keys.user_id WHERE revoked = 0)"""


@query("c1_authenticate_as_of", cte("keyed_requests", "ending_keys", "users", extra=_AS_OF.replace("api_keys", "ending_keys")) + """SELECT request_id, user_id, tier
FROM keyed_requests r JOIN owned ON sha256(r.api_key) = key_hash_hex AND (expires_at IS NULL OR expires_at > r.ts) WHERE starts_with(api_key, 'sf_')""")
def c1_as_of(spark, sf):
    out = access.authenticate(frame(spark, sf, "keyed_requests"), _api_keys(spark, sf, "ending_keys"), frame(spark, sf, "users"), F.col("ts"))
    return out.select("request_id", "user_id", "tier")


@query("c2_optional_as_of", cte("keyed_requests", "ending_keys", "users", extra=_AS_OF.replace("api_keys", "ending_keys")) + """SELECT request_id, user_id, tier
FROM keyed_requests r LEFT JOIN owned ON sha256(r.api_key) = key_hash_hex AND starts_with(api_key, 'sf_') AND (expires_at IS NULL OR expires_at > r.ts)""")
def c2_as_of(spark, sf):
    out = access.optional_authenticate(frame(spark, sf, "keyed_requests"), _api_keys(spark, sf, "ending_keys"), frame(spark, sf, "users"), F.col("ts"))
    return out.select("request_id", "user_id", "tier")


_OWN_REQUESTS = "SELECT l_orderkey * 10 + l_linenumber AS request_id, CAST(l_orderkey + CASE WHEN l_partkey % 9 = 0 THEN 100000000 ELSE 0 END AS VARCHAR(20)) AS secret_id, " \
                "CAST(CASE WHEN l_suppkey % 4 = 0 THEN l_suppkey ELSE o_custkey END AS VARCHAR(20)) AS user_id, l_shipdate AS asked_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query("c6_check_ownership", cte("secrets", extra=f"asked AS ({_OWN_REQUESTS})") + """SELECT a.request_id, a.secret_id, a.user_id,
 CASE WHEN s.id IS NULL THEN 404 WHEN s.user_id <> a.user_id THEN 403 ELSE 200 END AS http_status FROM asked a LEFT JOIN secrets s ON s.id = a.secret_id""")
def c6(spark, sf):
    out = access.check_ownership(sql(spark, sf, _OWN_REQUESTS), frame(spark, sf, "secrets"))
    return out.select("request_id", "secret_id", "user_id", "http_status")


@query("c7_pair_requests", cte("request_log", "response_log") + """SELECT q.request_id, q.method, p.status,
 (epoch_us(p.ts) - epoch_us(q.ts)) / 1000 AS duration_ms FROM request_log q JOIN response_log p USING (request_id)""")
def c7(spark, sf):
    out = access.pair_requests(frame(spark, sf, "request_log"), frame(spark, sf, "response_log"))
    return out.select("request_id", "method", "status", "duration_ms")


def _plan_query(interval: str) -> None:
    @query(f"c11_plan_for_{interval}", cte("users", extra=_PLAN_VALUES) + f"""SELECT u.id, u.tier, p.key AS plan_key, p.price
FROM users u LEFT JOIN plans p ON p.key = CASE WHEN u.tier = 'free' THEN 'free' ELSE u.tier || '_{interval}ly' END""")
    def run(spark, sf):
        return access.plan_for(frame(spark, sf, "users"), interval).select("id", "tier", "plan_key", "price")


_plan_query("month")
_plan_query("year")

# ---------------------------------------------------------------- admission

WINDOW_DAYS, LIMIT = 1, 2


def _admission_sql(key: str, rows: str, limit, days: int = WINDOW_DAYS) -> str:
    w = days * 86_400_000_000
    return cte("requests").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""",
r AS (SELECT request_id, {key} AS key, epoch_us(ts) AS t, row_number() OVER (PARTITION BY {key} ORDER BY ts, request_id) AS rn, {rows} AS counted, {limit} AS lim FROM requests),
s AS (SELECT request_id, key, t, rn, true AS allowed, lim - 1 AS remaining, t + {w} AS reset, CASE WHEN counted THEN [t] ELSE []::BIGINT[] END AS kept FROM r WHERE rn = 1
UNION ALL
SELECT request_id, key, t, rn, len(live) < lim, CASE WHEN len(live) < lim THEN lim - len(live) - 1 ELSE 0 END,
 CASE WHEN len(live) < lim THEN t + {w} ELSE list_min(live) + {w} END, CASE WHEN len(live) < lim AND counted THEN list_append(live, t) ELSE live END
FROM (SELECT r.request_id, r.key, r.t, r.rn, r.counted, r.lim, list_filter(s.kept, lambda k: k > r.t - {w}) AS live FROM s JOIN r ON r.key = s.key AND r.rn = s.rn + 1))
SELECT request_id, key, allowed, CAST(remaining AS BIGINT) AS remaining, make_timestamp(reset) AS reset_at,
 CASE WHEN NOT allowed THEN CAST(ceil((reset - t) / 1000000) AS BIGINT) END AS retry_after FROM s"""


_DECIDED = ["request_id", "key", "allowed", "remaining", "reset_at", "retry_after"]


def _requests(spark, sf, key):
    return frame(spark, sf, "requests").withColumn("key", key)


@query("e2_rate_limit", _admission_sql("user_id", "true", LIMIT))
def e2(spark, sf):
    df = _requests(spark, sf, F.col("user_id"))
    return ratelimit.rate_limit(df.select("request_id", "ts", "key"), F.col("key"), WINDOW_DAYS * 86400, LIMIT).select(_DECIDED)


@query("e2_rate_limit_by_tier", _admission_sql(
    "'tier-rl:' || tier || ':user:' || user_id", "true", "CASE tier WHEN 'free' THEN 10 WHEN 'pro' THEN 100 WHEN 'team' THEN 500 ELSE 5000 END", 20))
def e2_tier(spark, sf):
    none = F.lit(None).cast("string")
    identity = fx.limiter_key(F.col("user_id"), none, none, none, none)
    df = _requests(spark, sf, fx.tier_limiter_key(F.col("tier"), identity))
    return ratelimit.tier_rate_limit(df, identity, window_seconds=20 * 86400).select(_DECIDED)


@query("e2_rate_limit_by_endpoint", _admission_sql("'endpoint-rl:' || path || ':user:' || user_id", "true", 3, 5))
def e2_endpoint(spark, sf):
    identity = F.concat(F.lit("user:"), "user_id")
    df = _requests(spark, sf, fx.rate_key("endpoint-rl", F.col("path"), identity))
    return ratelimit.endpoint_rate_limit(df, F.col("path"), identity, 5 * 86400, 3).select(_DECIDED)


@query("e2_rate_limit_hot_endpoint", _admission_sql("'ip-rl:' || path", "true", 40))
def e2_hot(spark, sf):
    # Five keys for all requests: every key spans several tasks.
    df = _requests(spark, sf, fx.rate_key("ip-rl", F.col("path")))
    return ratelimit.ip_rate_limit(df, F.col("path"), WINDOW_DAYS * 86400, 40).select(_DECIDED)


@query("e2_rate_limit_skip_failed", _admission_sql("user_id", "status < 400", LIMIT))
def e2_skip_failed(spark, sf):
    df = _requests(spark, sf, F.col("user_id"))
    return ratelimit.rate_limit(df, F.col("key"), WINDOW_DAYS * 86400, LIMIT, uncounted=F.col("status") >= 400).select(_DECIDED)


@query("e2_rate_limit_skip_successful", _admission_sql("user_id", "status >= 400", LIMIT))
def e2_skip_successful(spark, sf):
    df = _requests(spark, sf, F.col("user_id"))
    return ratelimit.rate_limit(df, F.col("key"), WINDOW_DAYS * 86400, LIMIT, uncounted=F.col("status") < 400).select(_DECIDED)


# ---------------------------------------------------------------- scalar functions

@query("x1_mask_secret", """SELECT c_custkey, CASE WHEN length(s) <= 8 THEN repeat('*', length(s))
 ELSE left(s, 4) || repeat('*', length(s) - 8) || right(s, 4) END AS masked FROM (SELECT c_custkey, substr(c_name, 1, CAST(c_custkey % 20 AS INT)) AS s FROM customer)""")
def x1(spark, sf):
    s = F.substr("c_name", F.lit(1), (F.col("c_custkey") % 20).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", tx.mask_secret(s).alias("masked"))


_LEFT_DAYS = f"greatest(0, 90 - CAST(floor((epoch_us(TIMESTAMP '{ORDERS_AT}') - epoch_us(o_orderdate)) / 86400000000) AS BIGINT))"


@query("x2_days_until_rotation", f"SELECT o_orderkey, {_LEFT_DAYS} AS days_left FROM orders")
def x2(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", fx.days_until_rotation(F.col("o_orderdate"), 90, at(ORDERS_AT)).alias("days_left"))


@query("x3_is_rotation_overdue", f"SELECT o_orderkey, {_LEFT_DAYS} = 0 AS overdue FROM orders")
def x3(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", fx.is_rotation_overdue(F.col("o_orderdate"), 90, at(ORDERS_AT)).alias("overdue"))


@query("x4_format_timestamp", "SELECT event_id, strftime(ts, '%b %-d, %Y, %I:%M %p') AS shown FROM events")
def x4(spark, sf):
    return table(spark, sf, "events").select("event_id", fx.format_timestamp(F.col("ts")).alias("shown"))


@query("x5_sanitize", f"SELECT page_id, left(translate(trim(html, {_WS}||chr(160)), '<>', ''), 1000) AS clean FROM pages")
def x5(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.sanitize(F.col("html")).alias("clean"))


@query("x6_is_valid_environment", """SELECT o_orderkey, e IN ('dev', 'staging', 'prod') AS valid,
 CASE e WHEN 'development' THEN 'dev' WHEN 'production' THEN 'prod' ELSE e END AS canonical
FROM (SELECT o_orderkey, CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'dev' WHEN 1 THEN 'staging' WHEN 2 THEN 'prod' WHEN 3 THEN 'production' ELSE 'development' END AS e FROM orders)""")
def x6(spark, sf):
    n = (F.col("o_orderkey") % 5).cast("int")
    e = F.element_at(F.array(*[F.lit(x) for x in ("dev", "staging", "prod", "production", "development")]), n + 1)
    df = table(spark, sf, "orders").select("o_orderkey", e.alias("e"))
    return df.select("o_orderkey", tx.is_valid_environment(F.col("e")).alias("valid"), canonical_environment(F.col("e")).alias("canonical"))


_KEYS = """SELECT p_partkey, CASE CAST(p_partkey % 8 AS INT) WHEN 0 THEN concat('sk-ant-', p_name) WHEN 1 THEN concat('sk-', p_name) WHEN 2 THEN concat('sk_live_', p_name)
 WHEN 3 THEN concat('ghp_', p_name) WHEN 4 THEN concat('AKIA', p_name) WHEN 5 THEN concat('sbp_', p_name) WHEN 6 THEN p_name ELSE '' END AS k FROM part"""


@query("x7_classify_key_prefix", f"""SELECT p_partkey, CASE WHEN starts_with(k, 'sk-ant-') THEN 'anthropic' WHEN starts_with(k, 'sk-') THEN 'openai'
 WHEN starts_with(k, 'sk_') THEN 'stripe' WHEN starts_with(k, 'ghp_') THEN 'github' WHEN starts_with(k, 'AKIA') THEN 'aws' WHEN starts_with(k, 'sbp_') THEN 'supabase' END AS service FROM ({_KEYS})""")
def x7(spark, sf):
    return sql(spark, sf, _KEYS).select("p_partkey", tx.classify_key_prefix(F.col("k")).alias("service"))


_ERRORS = """SELECT event_id, CASE CAST(event_id % 8 AS INT) WHEN 1 THEN 'ZodError' ELSE 'Error' END AS name,
 CASE CAST(event_id % 8 AS INT) WHEN 0 THEN CASE CAST(user_id % 5 AS INT) WHEN 0 THEN 404 WHEN 1 THEN 429 WHEN 2 THEN 418 WHEN 3 THEN 401 ELSE 503 END END AS status,
 CASE CAST(event_id % 8 AS INT) WHEN 2 THEN 'D1_ERROR: locked' WHEN 3 THEN 'the database failed to decrypt' WHEN 4 THEN 'could not encrypt' WHEN 5 THEN 'OpenAI timeout'
  WHEN 6 THEN 'bad API answer' ELSE concat('odd ', event_type) END AS message FROM events"""
_HTTP = "CASE status " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in rules.HTTP_CODE_NAMES.items()) + " ELSE 'UNKNOWN_ERROR' END"


@query("x8_classify_error", f"""SELECT event_id, CASE WHEN status IS NOT NULL THEN {_HTTP} WHEN name = 'ZodError' THEN 'VALIDATION_ERROR'
 WHEN contains(message, 'D1_ERROR') OR contains(message, 'database') THEN 'DATABASE_ERROR' WHEN contains(message, 'encrypt') OR contains(message, 'decrypt') THEN 'ENCRYPTION_ERROR'
 WHEN contains(message, 'OpenAI') OR contains(message, 'API') THEN 'EXTERNAL_SERVICE_ERROR' ELSE 'INTERNAL_SERVER_ERROR' END AS code,
 CASE WHEN status IS NOT NULL THEN status WHEN name = 'ZodError' THEN 400 WHEN contains(message, 'D1_ERROR') OR contains(message, 'database') OR contains(message, 'encrypt') OR contains(message, 'decrypt') THEN 500
 WHEN contains(message, 'OpenAI') OR contains(message, 'API') THEN 503 ELSE 500 END AS http_status FROM ({_ERRORS})""")
def x8(spark, sf):
    e = sql(spark, sf, _ERRORS)
    return e.select("event_id", fx.classify_error(F.col("name"), F.col("status"), F.col("message")).alias("r")).select("event_id", "r.*")


@query("x9_http_code_name", f"SELECT event_id, status, {_HTTP} AS name FROM (SELECT event_id, CAST(400 + event_id % 110 AS INT) AS status FROM events)")
def x9(spark, sf):
    e = table(spark, sf, "events").select("event_id", (400 + F.col("event_id") % 110).cast("int").alias("status"))
    return e.withColumn("name", fx.http_code_name(F.col("status")))


@query("x10_tier_from_price", cte("billing_events") + """SELECT event_id, price_id, CASE WHEN contains(price_id, 'pro') THEN 'pro' WHEN contains(price_id, 'team') THEN 'team'
 WHEN contains(price_id, 'enterprise') THEN 'enterprise' ELSE 'free' END AS tier FROM billing_events""")
def x10(spark, sf):
    return frame(spark, sf, "billing_events").select("event_id", "price_id", fx.tier_from_price(F.col("price_id")).alias("tier"))


@query("x11_parse_env_line", cte("env_lines") + f"""SELECT line_no, CASE WHEN ok THEN trim(split_part(t, '=', 1), {_WS}) END AS key, CASE WHEN ok THEN substr(t, instr(t, '=') + 1) END AS value
FROM (SELECT line_no, trim(line, {_WS}) AS t, trim(line, {_WS}) <> '' AND NOT starts_with(trim(line, {_WS}), '#') AS ok FROM env_lines)""")
def x11(spark, sf):
    e = frame(spark, sf, "env_lines").select("line_no", tx.parse_env_line(F.col("line")).alias("kv"))
    return e.select("line_no", "kv.key", "kv.value")


@query("x12_parse_tags", """SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags
FROM (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE concat(' ', p_name, ' , ,', p_brand, ',') END AS t FROM part)""")
def x12(spark, sf):
    t = F.when(F.col("p_partkey") % 6 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" , ,"), "p_brand", F.lit(",")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(tx.parse_tags(t), "|").alias("tags"))


_CALLERS = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR(20)) WHEN event_id % 3 = 1 THEN '' END AS uid,
 CASE WHEN event_id % 4 < 2 THEN concat('sf_', md5(event_type)) WHEN event_id % 4 = 2 THEN '' END AS k,
 CASE WHEN event_id % 5 = 0 THEN '10.0.0.1' WHEN event_id % 5 = 1 THEN '' END AS cf, CASE WHEN event_id % 7 < 3 THEN '10.0.0.2' END AS xff, CASE WHEN event_id % 11 < 4 THEN '10.0.0.3' END AS rip FROM events"""


@query("x13_limiter_key", f"""SELECT event_id, CASE WHEN nullif(uid, '') IS NOT NULL THEN 'user:' || uid WHEN nullif(k, '') IS NOT NULL THEN 'apikey:' || left(k, 16)
 ELSE 'ip:' || coalesce(nullif(cf, ''), nullif(xff, ''), nullif(rip, ''), 'unknown') END AS key FROM ({_CALLERS})""")
def x13(spark, sf):
    return sql(spark, sf, _CALLERS).select("event_id", fx.limiter_key(*[F.col(c) for c in ("uid", "k", "cf", "xff", "rip")]).alias("key"))


@query("x14_key_expiry", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate + to_days(CAST(o_orderkey % 400 AS INT)) END AS expires_at
FROM orders WHERE o_orderkey % 400 > 0 OR o_orderkey % 4 = 0""")
def x14(spark, sf):
    days = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") % 400)
    return table(spark, sf, "orders").select("o_orderkey", fx.key_expiry(F.col("o_orderdate"), days).alias("expires_at"))


@query("x15_sha256_base64", "SELECT c_custkey, to_base64(unhex(sha256(c_name))) AS hash FROM customer")
def x15(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", tx.sha256_base64(F.col("c_name")).alias("hash"))


_HEADERS = """SELECT event_id, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN concat('v1=', md5(event_type), ',t=', CAST(1704880000 - event_id AS VARCHAR(20))) WHEN 1 THEN 'v0=x'
 ELSE concat('t=', CAST(1704880000 - event_id AS VARCHAR(20)), ',v1=', md5(event_type), ',v1=other') END AS h FROM events"""


@query("x16_webhook_signature", f"""SELECT event_id, CASE WHEN event_id % 4 <> 1 THEN CAST(1704880000 - event_id AS VARCHAR) END AS t, CASE WHEN event_id % 4 <> 1 THEN regexp_extract(h, 'v1=([0-9a-f]+)', 1) END AS v1,
 CASE WHEN event_id % 4 <> 1 THEN event_id > 300 END AS stale FROM ({_HEADERS})""")
def x16(spark, sf):
    s = sql(spark, sf, _HEADERS).select("event_id", fx.webhook_signature(F.col("h")).alias("s"))
    t = F.col("s.timestamp")
    return s.select("event_id", t.alias("t"), F.col("s.signature").alias("v1"),
                    fx.webhook_is_stale(t.try_cast("bigint"), F.lit(1704880000)).alias("stale"))
