"""Queries: snapshot changes, encryption, contracts, constraints."""

from __future__ import annotations

import base64

from pyspark.sql import functions as F

from keyquarry.operators import crypto, quality, vault
from keyquarry.plans.access import ORDERS_AT, _OWN_REQUESTS, at
from keyquarry.plans.checks import lit, values
from keyquarry.plans.registry import query
from keyquarry.sources.fixtures import cte, frame, sql, table

# ---------------------------------------------------------------- snapshots


def _vault(spark, sf):
    from keyquarry.functions.text import json_array

    return frame(spark, sf, "vault").withColumn("tags", json_array(F.col("tags")))


@query("u1_upsert_secrets", cte("vault", "vault_changes", extra="""new AS (SELECT * FROM vault_changes
QUALIFY row_number() OVER (PARTITION BY name, project, environment ORDER BY changed_at DESC, id DESC) = 1)""") + """
SELECT coalesce(v.id, n.id) AS id, coalesce(v.name, n.name) AS name, coalesce(v.project, n.project) AS project, coalesce(v.environment, n.environment) AS environment,
 CASE WHEN v.id IS NULL THEN '' ELSE array_to_string(CAST(v.tags AS JSON)::VARCHAR[], ',') END AS tags,
 CASE WHEN n.id IS NULL THEN v.value_encrypted ELSE n.value_encrypted END AS value_encrypted, coalesce(v.created_at, n.changed_at) AS created_at,
 CASE WHEN n.id IS NULL THEN v.updated_at ELSE n.changed_at END AS updated_at
FROM vault v FULL OUTER JOIN new n ON v.name = n.name AND v.project = n.project AND v.environment = n.environment""")
def u1(spark, sf):
    changes = frame(spark, sf, "vault_changes").withColumnRenamed("changed_at", "at").withColumn("tags", F.lit(None).cast("array<string>"))
    return vault.upsert_secrets(_vault(spark, sf), changes).withColumn("tags", F.array_join("tags", ","))


_ASKED = f"asked AS ({_OWN_REQUESTS})"
_OK = """ok AS (SELECT a.* FROM asked a JOIN secrets s ON s.id = a.secret_id AND s.user_id = a.user_id WHERE s.is_active = 1)"""


def _asked(spark, sf):
    return sql(spark, sf, _OWN_REQUESTS).withColumnRenamed("asked_at", "at")


@query("u2_rotate_snapshot", cte("secrets", extra=f"{_ASKED}, {_OK}") + """SELECT s.id, s.user_id, s.service, s.environment, s.created_at,
 coalesce(n.rotated, s.last_rotated_at) AS last_rotated_at, s.is_active FROM secrets s LEFT JOIN (SELECT secret_id, max(asked_at) AS rotated FROM ok GROUP BY secret_id) n ON n.secret_id = s.id""")
def u2(spark, sf):
    return vault.rotate_secrets(frame(spark, sf, "secrets"), _asked(spark, sf))["snapshot"]


@query("u2_rotate_audit", cte("secrets", extra=f"{_ASKED}, {_OK}") + "SELECT secret_id, user_id, 'rotated' AS action, asked_at AS timestamp FROM ok")
def u2_audit(spark, sf):
    return vault.rotate_secrets(frame(spark, sf, "secrets"), _asked(spark, sf))["audit"]


@query("u2_rotate_usage", cte("secrets", extra=f"{_ASKED}, {_OK}") + "SELECT user_id, 'secret_rotated' AS event_type, asked_at AS timestamp FROM ok")
def u2_usage(spark, sf):
    return vault.rotate_secrets(frame(spark, sf, "secrets"), _asked(spark, sf))["usage"]


@query("u2_rotate_status", cte("secrets", extra=_ASKED) + """SELECT request_id, secret_id, CASE WHEN s.id IS NULL THEN 404 WHEN s.user_id <> a.user_id THEN 403 ELSE 200 END AS http_status
FROM asked a LEFT JOIN (SELECT * FROM secrets WHERE is_active = 1) s ON s.id = a.secret_id""")
def u2_status(spark, sf):
    out = vault.rotate_secrets(frame(spark, sf, "secrets"), _asked(spark, sf))["status"]
    return out.select("request_id", "secret_id", "http_status")


# Rotation to new values: versions with validity intervals, and uses judged against them.
_ROTATED = cte("secrets", "rotations", "first_versions", "value_uses", extra="""judged AS (
 SELECT r.*, coalesce(grace_hours, 24) AS hours, CASE WHEN coalesce(grace_hours, 24) > 168 THEN 400 WHEN s.id IS NULL THEN 404 WHEN s.user_id <> r.user_id THEN 403
  WHEN r.asked_at < f.valid_from THEN 409 ELSE 200 END AS http_status
 FROM rotations r LEFT JOIN (SELECT * FROM secrets WHERE is_active = 1) s ON s.id = r.secret_id LEFT JOIN first_versions f ON f.secret_id = r.secret_id),
chain AS (SELECT secret_id, version, valid_from, value_hash, 0 AS hours FROM first_versions
 UNION ALL SELECT secret_id, 1 + row_number() OVER (PARTITION BY secret_id ORDER BY asked_at, request_id), asked_at, value_hash, hours FROM judged WHERE http_status = 200),
versions AS (SELECT secret_id, version, value_hash, valid_from, lead(valid_from) OVER w AS superseded_at, lead(valid_from) OVER w + lead(hours) OVER w * INTERVAL 1 HOUR AS valid_to
 FROM chain WINDOW w AS (PARTITION BY secret_id ORDER BY version))""")


def _rotated(spark, sf, only):
    never = F.lit(None).cast("timestamp_ntz")
    first = frame(spark, sf, "first_versions").withColumns({"version": F.col("version").cast("bigint"), "superseded_at": never, "valid_to": never})
    return vault.rotate_values(first, frame(spark, sf, "secrets"), frame(spark, sf, "rotations").withColumnRenamed("asked_at", "at"), only=only)[only]


@query("u2_value_versions", _ROTATED + "SELECT secret_id, version, value_hash, valid_from, superseded_at, valid_to FROM versions")
def u2_versions(spark, sf):
    return _rotated(spark, sf, "versions")


@query("u2_value_audit", _ROTATED + "SELECT secret_id, user_id, 'rotated' AS action, ip_address, user_agent, asked_at AS timestamp FROM judged WHERE http_status = 200")
def u2_value_audit(spark, sf):
    return _rotated(spark, sf, "audit")


@query("u2_value_requests", _ROTATED + "SELECT request_id, secret_id, http_status FROM judged")
def u2_value_requests(spark, sf):
    return _rotated(spark, sf, "status").select("request_id", "secret_id", "http_status")


@query("u2_valid_versions", _ROTATED + f"""SELECT secret_id, version, coalesce(superseded_at <= TIMESTAMP '{ORDERS_AT}', false) AS in_grace
FROM versions WHERE valid_from <= TIMESTAMP '{ORDERS_AT}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{ORDERS_AT}')""")
def u2_valid(spark, sf):
    return vault.valid_versions(_rotated(spark, sf, "versions"), at(ORDERS_AT)).select("secret_id", "version", "in_grace")


@query("u2_value_uses", _ROTATED + """, found AS (SELECT u.use_id, u.ts, v.version, coalesce(v.superseded_at, TIMESTAMP '9999-12-31') AS newer, coalesce(v.valid_to, TIMESTAMP '9999-12-31') AS until
 FROM value_uses u LEFT JOIN versions v ON v.secret_id = u.secret_id AND v.value_hash = u.value_hash AND v.valid_from <= u.ts)
SELECT use_id, CASE WHEN max(version) IS NULL THEN 'unknown' WHEN max(newer) > ts THEN 'current' WHEN max(until) > ts THEN 'grace' ELSE 'expired' END AS value_status,
 max(CASE WHEN version IS NOT NULL THEN {'until': until, 'version': version} END).version AS version FROM found GROUP BY use_id, ts""")
def u2_uses(spark, sf):
    out = vault.value_status(frame(spark, sf, "value_uses"), _rotated(spark, sf, "versions"))
    return out.select("use_id", "value_status", "version")


@query("u3_soft_delete", cte("secrets", extra=f"{_ASKED}, {_OK}") + """SELECT id, user_id, service, CASE WHEN id IN (SELECT secret_id FROM ok) THEN 0 ELSE is_active END AS is_active FROM secrets""")
def u3(spark, sf):
    out = vault.soft_delete(frame(spark, sf, "secrets"), _asked(spark, sf))["snapshot"]
    return out.select("id", "user_id", "service", "is_active")


@query("u3_soft_delete_audit", cte("secrets", extra=f"{_ASKED}, {_OK}") + "SELECT secret_id, user_id, 'deleted' AS action, min(asked_at) AS timestamp FROM ok GROUP BY secret_id, user_id")
def u3_audit(spark, sf):
    return vault.soft_delete(frame(spark, sf, "secrets"), _asked(spark, sf))["audit"]


@query("u4_hard_delete", cte("secrets") + "SELECT id, user_id, service FROM secrets WHERE id NOT IN (SELECT CAST(l_partkey * 3 AS VARCHAR) FROM lineitem)")
def u4(spark, sf):
    ids = table(spark, sf, "lineitem").select((F.col("l_partkey") * 3).cast("string").alias("id"))
    return vault.hard_delete(frame(spark, sf, "secrets"), ids).select("id", "user_id", "service")


_REVOKES = "SELECT CAST(c_custkey AS VARCHAR(20)) AS key_id, CAST(CASE WHEN c_nationkey % 3 = 0 THEN c_custkey + 1 ELSE c_custkey END AS VARCHAR(20)) AS user_id FROM customer"


@query("u5_revoke_api_keys", cte("api_keys", extra=f"asked AS ({_REVOKES})") + """SELECT k.id, k.user_id, CASE WHEN a.key_id IS NULL THEN k.revoked ELSE 1 END AS revoked
FROM api_keys k LEFT JOIN asked a ON a.key_id = k.id AND a.user_id = k.user_id""")
def u5(spark, sf):
    return vault.revoke_api_keys(frame(spark, sf, "api_keys").select("id", "user_id", "revoked"), sql(spark, sf, _REVOKES))


@query("u6_touch_last_used", cte("api_keys") + """SELECT k.id, greatest(k.expires_at, max(e.ts)) AS last_used_at FROM api_keys k LEFT JOIN events e ON CAST(e.user_id AS VARCHAR) = k.id GROUP BY k.id, k.expires_at""")
def u6(spark, sf):
    keys = frame(spark, sf, "api_keys").select("id", F.col("expires_at").alias("last_used_at"))
    uses = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("id"), "ts")
    return vault.touch_last_used(keys, uses)


@query("u7_due_rotations", cte("schedules") + f"SELECT id, secret_id, scheduled_for FROM schedules WHERE status = 'pending' AND scheduled_for <= TIMESTAMP '{ORDERS_AT}'")
def u7(spark, sf):
    return vault.due_rotations(frame(spark, sf, "schedules"), at(ORDERS_AT)).select("id", "secret_id", "scheduled_for")


_LEFT = f"greatest(0, 90 - CAST(floor((epoch_us(TIMESTAMP '{ORDERS_AT}') - epoch_us(coalesce(last_rotated_at, created_at))) / 86400000000) AS BIGINT))"


@query("u8_rotation_status", cte("secrets") + f"SELECT id, user_id, {_LEFT} AS days_left, {_LEFT} = 0 AS overdue FROM secrets")
def u8(spark, sf):
    return vault.rotation_status(frame(spark, sf, "secrets"), at(ORDERS_AT)).select("id", "user_id", "days_left", "overdue")


@query("q4_updated_at", cte("vault") + f"""SELECT id, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN 'prod' ELSE environment END AS environment,
 CASE WHEN CAST(id AS BIGINT) % 4 = 0 AND environment <> 'prod' THEN TIMESTAMP '{ORDERS_AT}' ELSE updated_at END AS updated_at FROM vault""")
def q4(spark, sf):
    old = frame(spark, sf, "vault").select("id", "environment", "updated_at")
    new = old.withColumn("environment", F.when(F.col("id").cast("bigint") % 4 == 0, F.lit("prod")).otherwise(F.col("environment")))
    return vault.touch_updated_at(old, new, at(ORDERS_AT))


# ---------------------------------------------------------------- encryption
# Keys for the checks only, made from a fixed text.
_KEY = base64.b64encode(b"check-key-one-32-bytes-long-0000").decode()
_KEY2 = base64.b64encode(b"check-key-two-32-bytes-long-0000").decode()


def _plain(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("value"))


@query("v1_encrypt_column", "SELECT c_custkey, length(c_name) + 28 AS bytes FROM customer")
def v1(spark, sf):
    out = crypto.encrypt_column(_plain(spark, sf), "value", crypto.raw_key(_KEY), "cipher")
    return out.select("c_custkey", F.octet_length(F.unbase64("cipher")).cast("bigint").alias("bytes"))


@query("v2_decrypt_column", "SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN c_name END AS value FROM customer")
def v2(spark, sf):
    cipher = crypto.encrypt_column(_plain(spark, sf), "value", crypto.raw_key(_KEY))
    damaged = cipher.withColumn("value", F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("AAAA"), "value")).otherwise(F.col("value")))
    return crypto.decrypt_column(damaged, "value", crypto.raw_key(_KEY))


@query("v2_quarantine", "SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0")
def v2_bad(spark, sf):
    cipher = crypto.encrypt_column(_plain(spark, sf), "value", crypto.raw_key(_KEY))
    damaged = cipher.withColumn("value", F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("AAAA"), "value")).otherwise(F.col("value")))
    opened = crypto.decrypt_column(damaged, "value", crypto.raw_key(_KEY), "plain")
    return crypto.quarantine(opened, "value", "plain")[1].select("c_custkey")


@query("v3_import_envelopes", "SELECT c_custkey, c_name AS plain FROM customer")
def v3(spark, sf):
    key, key2 = crypto.raw_key(_KEY), crypto.raw_key(_KEY2)
    df = _plain(spark, sf)
    text = F.unbase64(crypto.encrypted(F.col("value"), key))
    n = F.octet_length("raw")
    as_text = F.to_json(F.struct(
        F.base64(F.substring("raw", 1, 12)).alias("iv"),
        F.base64(F.substr("raw", n - 15, F.lit(16))).alias("authTag"),
        F.base64(F.substr("raw", F.lit(13), n - 28)).alias("data")))

    def ints(b, size):
        return F.transform(F.sequence(F.lit(1), size), lambda i: F.conv(F.hex(F.substr(b, i, F.lit(1))), 16, 10).cast("int"))

    as_ints = F.to_json(F.struct(ints(F.substring("raw2", 1, 12), F.lit(12)).alias("iv"),
                                 ints(F.substr("raw2", F.lit(13), F.octet_length("raw2")), F.octet_length("raw2") - 12).alias("data")))
    env = df.withColumn("raw", text).withColumn("raw2", F.unbase64(crypto.encrypted(F.col("value"), key2)))
    env = env.select("c_custkey", F.base64(F.when(F.col("c_custkey") % 2 == 0, as_text).otherwise(as_ints).cast("binary")).alias("envelope"))
    return crypto.import_envelopes(env, "envelope", key, key2).select("c_custkey", "plain")


@query("v4_rekey", "SELECT c_custkey, c_name AS value, true AS old_key_fails FROM customer")
def v4(spark, sf):
    key, key2 = crypto.raw_key(_KEY), crypto.raw_key(_KEY2)
    moved = crypto.rekey(crypto.encrypt_column(_plain(spark, sf), "value", key), "value", key, key2)
    return moved.select("c_custkey", crypto.decrypted(F.col("value"), key2).alias("value"),
                        crypto.decrypted(F.col("value"), key).isNull().alias("old_key_fails"))


# ---------------------------------------------------------------- contracts

_MAIL_OK = "regexp_matches(email, '^[A-Za-z0-9_''+\\-.]*[A-Za-z0-9_+-]@([A-Za-z0-9][A-Za-z0-9\\-]*\\.)+[A-Za-z]{2,}$') AND NOT starts_with(email, '.') AND NOT contains(email, '..')"


def _reasons(*tests: tuple[str, str]) -> str:
    """(condition that breaks a rule, reason) -> joined reasons."""
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN {lit(r)} END" for c, r in tests) + ")"


_SIGNUPS = """SELECT c_custkey, CASE CAST(c_custkey % 7 AS INT) WHEN 0 THEN NULL WHEN 1 THEN concat(c_name, '@example') WHEN 2 THEN 'a..b@example.com'
 ELSE concat('user', CAST(c_custkey AS VARCHAR(20)), '@example.com') END AS email,
 CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'short1A' WHEN 1 THEN 'alllowercase1' WHEN 2 THEN 'NoDigitsHere' ELSE concat('Passw0rd', c_mktsegment) END AS password,
 CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'gold' WHEN 1 THEN 'pro' END AS tier FROM customer"""


@query("q1_contract_create_user", f"""SELECT c_custkey, coalesce(tier, 'free') AS tier, {_reasons(
    ("email IS NULL", "email: required"), (f"email IS NOT NULL AND NOT ({_MAIL_OK})", "email: email"),
    ("length(password) < 8", "password: min_length"),
    ("NOT regexp_matches(password, '[A-Z]')", "password: pattern [A-Z]"), ("NOT regexp_matches(password, '[a-z]')", "password: pattern [a-z]"),
    ("NOT regexp_matches(password, '[0-9]')", "password: pattern [0-9]"),
    ("tier = 'gold'", "tier: enum"))} AS reasons FROM ({_SIGNUPS})""")
def q1_user(spark, sf):
    # Reasons are listed in rule order: required, then form, then lengths.
    out = quality.check_contract(sql(spark, sf, _SIGNUPS), "create_user")
    order = F.array(*[F.lit(x) for x in (
        "email: required", "email: email", "password: min_length", "password: pattern [A-Z]",
        "password: pattern [a-z]", "password: pattern [0-9]", "tier: enum")])
    return out.select("c_custkey", "tier", F.array_join(F.array_intersect(order, "reasons"), "; ").alias("reasons"))


_SEARCHES = """SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_type END AS service,
 CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN repeat(p_name, 60) ELSE p_name END AS query,
 CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS DOUBLE) END AS "limit" FROM part"""


@query("q1_contract_search", f"""SELECT p_partkey, coalesce("limit", 5) AS "limit", {_reasons(
    ("length(service) < 1", "service: min_length"), ("query IS NULL", "query: required"), ("length(query) > 500", "query: max_length"),
    ('"limit" < 1', "limit: minimum"), ('"limit" > 20', "limit: maximum"))} AS reasons FROM ({_SEARCHES})""")
def q1_search(spark, sf):
    df = sql(spark, sf, _SEARCHES.replace('"limit"', "`limit`"))
    return quality.check_contract(df, "search_docs").select("p_partkey", "limit", F.array_join("reasons", "; ").alias("reasons"))


_POLICIES = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'nope' ELSE concat(substr(md5(o_orderstatus), 1, 8), '-0000-4000-8000-', substr(md5(o_orderstatus), 1, 12)) END AS "secretId",
 CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(o_orderkey % 400 AS DOUBLE) END AS "intervalDays", CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 60 AS DOUBLE) END AS "notifyBefore" FROM orders"""


@query("q1_contract_rotation_policy", f"""SELECT o_orderkey, coalesce("notifyBefore", 24) AS "notifyBefore", {_reasons(
    ('"secretId" = \'nope\'', "secretId: uuid"), ('"intervalDays" IS NULL', "intervalDays: required"),
    ('"intervalDays" < 1', "intervalDays: minimum"), ('"intervalDays" > 365', "intervalDays: maximum"),
    ('"notifyBefore" > 48', "notifyBefore: maximum"))} AS reasons FROM ({_POLICIES})""")
def q1_policy(spark, sf):
    df = sql(spark, sf, _POLICIES.replace('"', "`"))
    return quality.check_contract(df, "create_rotation_policy").select("o_orderkey", "notifyBefore", F.array_join("reasons", "; ").alias("reasons"))


@query("q1_contract_chat_split", """SELECT doc_id, CASE WHEN length(text) > 2000 THEN 'message: max_length' ELSE 'message: min_length' END AS reasons
FROM documents WHERE length(text) > 2000 OR length(text) < 1""")
def q1_chat(spark, sf):
    chats = table(spark, sf, "documents").select("doc_id", F.col("text").alias("message"))
    _, rejected = quality.split_contract(chats, "chat_message")
    return rejected.select("doc_id", F.array_join("reasons", "; ").alias("reasons"))


@query("q1_contract_webhook_payload", """SELECT event_id, concat_ws('; ', CASE WHEN event_id % 3 = 0 THEN 'url: url' END, CASE WHEN event_id % 4 = 1 THEN 'events: enum' WHEN event_id % 4 = 2 THEN 'events: required' END) AS reasons FROM events""")
def q1_webhook(spark, sf):
    e = table(spark, sf, "events")
    url = F.when(F.col("event_id") % 3 == 0, F.lit("not a url")).otherwise(F.concat(F.lit("https://example.com/"), "event_type"))
    events = F.when(F.col("event_id") % 4 == 0, F.array(F.lit("secret.created"), F.lit("secret.rotated"))).when(
        F.col("event_id") % 4 == 1, F.array(F.lit("secret.created"), F.lit("secret.lost"))).when(
        F.col("event_id") % 4 == 3, F.array(F.lit("usage.limit_reached")))
    body = e.select("event_id", F.to_json(F.struct(url.alias("url"), events.alias("events"))).alias("body"))
    out = quality.check_contract(quality.parse_payload(body, "create_webhook", "body"), "create_webhook")
    return out.select("event_id", F.array_join("reasons", "; ").alias("reasons"))


_KEY_REQUESTS = """SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN '' WHEN c_custkey % 6 = 1 THEN NULL ELSE c_name END AS name,
 CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey - 12 AS DOUBLE) END AS "expiresIn" FROM customer"""


@query("q1_contract_api_key", f"""SELECT c_custkey, 'read,write' AS scopes, {_reasons(
    ("name IS NULL", "name: required"), ("length(name) < 1", "name: min_length"), ('"expiresIn" <= 0', "expiresIn: positive"))} AS reasons FROM ({_KEY_REQUESTS})""")
def q1_key(spark, sf):
    df = sql(spark, sf, _KEY_REQUESTS.replace('"', "`"))
    out = quality.check_contract(df, "create_api_key")
    return out.select("c_custkey", F.array_join("scopes", ",").alias("scopes"), F.array_join("reasons", "; ").alias("reasons"))


@query("q1_contract_batch_rotate", f"""SELECT p_partkey, {_reasons(
    ("p_size + 5 > 50", "secretIds: max_items"), ("p_partkey % 7 = 0", "secretIds: uuid"))} AS reasons FROM part""")
def q1_batch(spark, sf):
    h = F.md5(F.col("p_partkey").cast("string"))
    uuid = F.concat(F.left(h, F.lit(8)), F.lit("-0000-4000-8000-"), F.left(h, F.lit(12)))
    bad = (F.col("p_partkey") % 7 == 0)
    ids = F.transform(F.sequence(F.lit(1), F.col("p_size") + 5), lambda i: F.when(bad & (i == 3), F.lit("bad")).otherwise(uuid))
    batches = table(spark, sf, "part").select("p_partkey", ids.alias("secretIds"))
    return quality.check_contract(batches, "batch_rotate_secrets").select("p_partkey", F.array_join("reasons", "; ").alias("reasons"))


# One good and one broken body for each of the thirty contracts; # stands for the event's number.
_ID = '"123e4567-e89b-12d3-a456-426614174000"'
_BODIES = [
    ("create_user", '{"email":"u#@b.co","password":"Passw0rd#"}', ""), ("create_user", '{"email":#,"password":"pass","tier":null}',
     "email: type; tier: type; password: pattern [A-Z]; password: pattern [0-9]; password: min_length"),
    ("login", '{"email":"u#@b.co","password":"#"}', ""), ("login", '[#]', "payload: type"),
    ("create_secret", '{"service":"s#","scopes":["a"],"metadata":{"n":#}}', ""), ("create_secret", '{"scopes":[#],"metadata":"x"}', "scopes: type; metadata: type; service: required"),
    ("update_secret", '{}', ""), ("update_secret", '{"environment":"dev","scopes":"#"}', "scopes: type; environment: enum"),
    ("rotate_secret", '{"gracePeriodHours":24.5,"notifyChannels":["email","slack"]}', ""),
    ("rotate_secret", '{"gracePeriodHours":"#","notifyChannels":["fax"]}', "gracePeriodHours: type; notifyChannels: enum"),
    ("analyze_project", '{"dependencies":{"p#":"1.0"},"language":"go"}', ""), ("analyze_project", '{"dependencies":{"p":#},"packageManager":"cargo"}', "dependencies: type; packageManager: enum"),
    ("validate_compliance", '{"includeRecommendations":false}', ""), ("validate_compliance", '{"framework":"PCI_DSS","includeRecommendations":"no"}', "includeRecommendations: type; framework: enum"),
    ("create_api_key", '{"name":"k#","expiresIn":1}', ""), ("create_api_key", '{"name":"","expiresIn":-#.5}', "name: min_length; expiresIn: positive"),
    ("revoke_api_key", '{"keyId":' + _ID + '}', ""), ("revoke_api_key", '{"keyId":"#"}', "keyId: uuid"),
    ("create_organization", '{"name":"o#"}', ""), ("create_organization", '{"name":["o#"],"tier":"free"}', "name: type; tier: enum"),
    ("invite_member", '{"email":"u#@b.co","role":"viewer"}', ""), ("invite_member", '{"email":"u#..x@b.co","role":7}', "role: type; email: email"),
    ("chat_message", '{"message":"m#","context":{"currentSecrets":["s"],"recentActivity":[1,null]}}', ""),
    ("chat_message", '{"message":"","context":{"projectPath":#,"currentSecrets":[null]}}', "context: projectPath type; context: currentSecrets type; message: min_length"),
    ("create_webhook", '{"url":"https://x.y/#","events":["secret.created"]}', ""), ("create_webhook", '{"url":"x y #","events":"secret.created"}', "events: type; url: url"),
    ("create_rotation_policy", '{"secretId":' + _ID + ',"intervalDays":30}', ""),
    ("create_rotation_policy", '{"secretId":null,"intervalDays":0,"notifyBefore":49}', "secretId: type; intervalDays: minimum; notifyBefore: maximum"),
    ("search_docs", '{"service":"s","query":"q#","limit":20}', ""), ("search_docs", '{"service":"s","limit":true}', "limit: type; query: required"),
    ("get_usage", '{"startDate":"2024-01-01T00:00:00Z"}', ""), ("get_usage", '{"startDate":"#","endDate":#,"groupBy":"year"}', "endDate: type; startDate: datetime; groupBy: enum"),
    ("get_audit_logs", '{"action":"user.login","offset":#}', ""), ("get_audit_logs", '{"action":"x#","limit":0,"offset":-1}', "action: enum; limit: minimum; offset: minimum"),
    ("batch_create_secrets", '{"secrets":[{"service":"s#","metadata":{}}]}', ""),
    ("batch_create_secrets", '{"secrets":[{"service":#},{"scopes":"x"},{"service":"","environment":"prod","value":1}]}',
     "secrets: service type; secrets: service required; secrets: service min_length; secrets: environment enum; secrets: scopes type; secrets: value type"),
    ("batch_rotate_secrets", '{"secretIds":[' + _ID + ']}', ""), ("batch_rotate_secrets", '{"secretIds":[],"gracePeriodHours":169}', "secretIds: min_items; gracePeriodHours: maximum"),
    ("export_secrets", '{"format":"env","includeValues":true}', ""), ("export_secrets", '{"format":"xml","includeValues":#}', "includeValues: type; format: enum"),
    ("shared_environment", '{"environment":"dev"}', ""), ("shared_environment", '{"environment":"development"}', "environment: enum"),
    ("shared_framework", '{"framework":"PCI_DSS"}', ""), ("shared_framework", '{"framework":["SOC2"]}', "framework: type"),
    ("shared_action", '{"action":"rotated"}', ""), ("shared_action", '{}', "action: required"),
    ("shared_create_secret", '{"service":"s#","environment":"prod","userId":"#"}', ""), ("shared_create_secret", '{"service":"s#","userId":#}', "userId: type; environment: required"),
    ("shared_rotate_secret", '{"secretId":' + _ID + '}', ""), ("shared_rotate_secret", '"#"', "payload: type"),
    ("shared_validate_secret", '{"secretId":' + _ID + ',"framework":"GDPR"}', ""), ("shared_validate_secret", '{"secretId":"#","framework":null}', "framework: type; secretId: uuid"),
    ("shared_analyze_project", '{"projectPath":"/p#"}', ""), ("shared_analyze_project", '{"projectPath":"","dependencies":[#]}', "dependencies: type; projectPath: min_length"),
    ("shared_search_documentation", '{"service":"s","query":"q#"}', ""), ("shared_search_documentation", '{"service":#', "payload: type"),
    ("shared_audit_log", '{"secretId":' + _ID + ',"userId":"#","action":"created","ipAddress":"10.0.0.1","metadata":{"a":null}}', ""),
    ("shared_audit_log", '{"secretId":' + _ID + ',"userId":"#","action":"peeked","ipAddress":"host"}', "action: enum; ipAddress: ip"),
    ("shared_user_preferences", '{"userId":"#","autoRotationEnabled":true,"complianceFrameworks":["SOC2"]}', ""),
    ("shared_user_preferences", '{"userId":"#","autoRotationEnabled":"yes","notificationEmail":"#","complianceFrameworks":[{}]}',
     "autoRotationEnabled: type; complianceFrameworks: type; notificationEmail: email"),
]


@query("q1_payloads_of_all_contracts", f"""WITH {values([(str(i), lit(c), lit(r)) for i, (c, _, r) in enumerate(_BODIES)], "bodies", ["i", "contract", "reasons"])}
SELECT event_id, contract, reasons FROM events JOIN bodies ON i = event_id % {len(_BODIES)}""")
def q1_all(spark, sf):
    n = (F.col("event_id") % len(_BODIES) + 1).cast("int")
    pick = [F.element_at(F.array(*[F.lit(b[i]) for b in _BODIES]), n) for i in (0, 1)]
    rows = table(spark, sf, "events").select("event_id", pick[0].alias("contract"), F.replace(pick[1], F.lit("#"), F.col("event_id").cast("string")).alias("body"))
    return quality.check_payloads(rows).select("event_id", "contract", F.array_join("reasons", "; ").alias("reasons"))


# ---------------------------------------------------------------- constraints

_DIRTY = """SELECT event_id AS id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(event_id % 997 AS VARCHAR(20)) END AS secret_id,
 CAST(user_id AS VARCHAR(20)) AS user_id, CASE WHEN event_id % 40 = 1 THEN 'peeked' ELSE 'created' END AS action, ts AS timestamp FROM events
UNION ALL SELECT event_id AS id, '1' AS secret_id, CAST(user_id AS VARCHAR(20)) AS user_id, 'created' AS action, ts AS timestamp FROM events WHERE event_id % 100 = 3"""


@query("q2_table_constraints", f"""WITH d AS ({_DIRTY}) SELECT 'id: not null' AS "constraint", count(*) FILTER (id IS NULL) AS violations FROM d
UNION ALL SELECT 'secret_id: not null', count(*) FILTER (secret_id IS NULL) FROM d UNION ALL SELECT 'user_id: not null', count(*) FILTER (user_id IS NULL) FROM d
UNION ALL SELECT 'action: not null', count(*) FILTER (action IS NULL) FROM d UNION ALL SELECT 'timestamp: not null', count(*) FILTER (timestamp IS NULL) FROM d
UNION ALL SELECT 'action: check', count(*) FILTER (action = 'peeked') FROM d
UNION ALL SELECT 'id: unique', count(*) FROM (SELECT id FROM d GROUP BY id HAVING count(*) > 1)""")
def q2(spark, sf):
    return quality.check_table_constraints(sql(spark, sf, _DIRTY), "audit_logs")


@query("q2_row_violations", f"""WITH d AS ({_DIRTY}) SELECT id, secret_id, action, concat_ws('; ', CASE WHEN secret_id IS NULL THEN 'secret_id: not null' END,
 CASE WHEN action = 'peeked' THEN 'action: check' END) AS reasons FROM d WHERE secret_id IS NULL OR action = 'peeked'""")
def q2_rows(spark, sf):
    out = quality.row_violations(sql(spark, sf, _DIRTY), "audit_logs")
    return out.select("id", "secret_id", "action", F.array_join("reasons", "; ").alias("reasons"))


@query("q2_unique_violations", f"WITH d AS ({_DIRTY}) SELECT id, count(*) AS copies FROM d GROUP BY id HAVING count(*) > 1")
def q2_unique(spark, sf):
    return quality.unique_violations(sql(spark, sf, _DIRTY), ["id"])


@query("q3_foreign_keys", cte("users", "secrets", "usage_events", "audit_logs") + """SELECT 'usage_events.user_id -> users' AS reference, count(*) AS violations FROM usage_events u WHERE NOT EXISTS (SELECT 1 FROM users WHERE users.id = u.user_id)
UNION ALL SELECT 'audit_logs.secret_id -> secrets', count(*) FROM audit_logs a WHERE NOT EXISTS (SELECT 1 FROM secrets WHERE secrets.id = a.secret_id AND CAST(secrets.id AS BIGINT) % 2 = 0)""")
def q3(spark, sf):
    tables = {n: frame(spark, sf, n) for n in ("users", "secrets", "usage_events", "audit_logs")}
    tables["secrets"] = tables["secrets"].filter(F.col("id").cast("bigint") % 2 == 0)
    return quality.foreign_key_violations(tables, "usage_events").unionByName(quality.foreign_key_violations(tables, "audit_logs"))


@query("c12_orphans", cte("secrets", "users") + "SELECT s.id, s.user_id FROM secrets s WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.id = s.user_id AND u.tier <> 'free')")
def c12(spark, sf):
    paying = frame(spark, sf, "users").filter(F.col("tier") != "free")
    return quality.orphans(frame(spark, sf, "secrets").select("id", "user_id"), paying, "user_id")


@query("c12_cascade_delete", cte("secrets", "users") + "SELECT s.id, s.user_id FROM secrets s WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.id = s.user_id AND u.tier = 'free')")
def c12_cascade(spark, sf):
    gone = frame(spark, sf, "users").filter(F.col("tier") == "free")
    return quality.cascade_delete(frame(spark, sf, "secrets").select("id", "user_id"), gone, "user_id")
