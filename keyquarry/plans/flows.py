"""Queries: the end-to-end jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyquarry import lifecycle, rules
from keyquarry.plans.access import EVENTS_AT, _LIVE, _api_keys, at
from keyquarry.plans.registry import query
from keyquarry.plans.scanning import (
    TOKEN, _ALL_DEPS, _CHANGES, _CI_RULES, _SCOPE_VALUES, _SCOPED, _scan_sql, _scoped)
from keyquarry.sources.fixtures import cte, frame, sql

_CHANGED_LINES = f"""changed AS (SELECT file, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line
FROM (SELECT file, string_split(content, chr(10)) AS ls FROM ({_CHANGES}) WHERE status IS DISTINCT FROM 'removed'))"""
_ALL = rules.SECRET_PATTERNS + [TOKEN]


@query("flow_scan_change_set", f"WITH {_CHANGED_LINES}, found AS ({_scan_sql('changed', _ALL, 'file, line_no')}) "
       "SELECT file, type, count(*) AS findings FROM found GROUP BY file, type")
def scan_change_set(spark, sf):
    return lifecycle.scan_change_set(sql(spark, sf, _CHANGES), _ALL)["summary"]


@query("flow_missing_keys", f"""WITH {_CI_RULES}, deps AS ({_ALL_DEPS}), secrets AS ({cte('secrets').split('AS (', 1)[1].rstrip()[:-1]})
SELECT DISTINCT CAST(CAST(d.project AS BIGINT) % 100 AS VARCHAR) AS user_id, r.service FROM deps d JOIN rules r ON contains(lower(d.dep), r.pattern)
WHERE NOT EXISTS (SELECT 1 FROM secrets s WHERE s.is_active = 1 AND s.user_id = CAST(CAST(d.project AS BIGINT) % 100 AS VARCHAR) AND s.service = r.service)""")
def missing(spark, sf):
    files = frame(spark, sf, "manifests").withColumn("kind", F.col("file"))
    owners = files.select("project", (F.col("project").cast("bigint") % 100).cast("string").alias("user_id")).distinct()
    return lifecycle.analyze_dependencies(files, owners, frame(spark, sf, "secrets"), "kind")["missing"]


_DAYS = 20
_W = _DAYS * 86_400_000_000
_SERVE = cte("keyed_requests", "api_keys", "users", "secrets", extra=_LIVE).replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""",
asked AS (SELECT request_id, ts, api_key, CAST(request_id % 20000 AS VARCHAR) AS secret_id FROM keyed_requests),
known AS (SELECT a.request_id, a.secret_id, a.ts, l.user_id, CASE l.tier WHEN 'free' THEN 10 WHEN 'pro' THEN 100 WHEN 'team' THEN 500 ELSE 5000 END AS lim,
 row_number() OVER (PARTITION BY l.user_id ORDER BY a.ts, a.request_id) AS rn, epoch_us(a.ts) AS t
 FROM asked a JOIN live l ON sha256(a.api_key) = l.key_hash_hex WHERE starts_with(a.api_key, 'sf_')),
s AS (SELECT request_id, secret_id, ts, user_id, rn, true AS allowed, [t] AS kept FROM known WHERE rn = 1
UNION ALL SELECT request_id, secret_id, ts, user_id, rn, len(kept_now) < lim, CASE WHEN len(kept_now) < lim THEN list_append(kept_now, t) ELSE kept_now END
 FROM (SELECT k.*, list_filter(s.kept, lambda x: x > k.t - {_W}) AS kept_now FROM s JOIN known k ON k.user_id = s.user_id AND k.rn = s.rn + 1)),
decided AS (SELECT s.request_id, s.secret_id, s.user_id, s.ts, CASE WHEN NOT s.allowed THEN 429 WHEN o.id IS NULL THEN 404 WHEN o.user_id <> s.user_id THEN 403 ELSE 200 END AS http_status
 FROM s LEFT JOIN secrets o ON o.id = s.secret_id)
"""


def _served(spark, sf):
    requests = frame(spark, sf, "keyed_requests").withColumn("secret_id", (F.col("request_id") % 20000).cast("string"))
    return lifecycle.serve_requests(
        requests, _api_keys(spark, sf), frame(spark, sf, "users"), frame(spark, sf, "secrets"), at(EVENTS_AT),
        window_seconds=_DAYS * 86400)


@query("flow_request_status", _SERVE + """SELECT a.request_id, d.user_id, coalesce(d.http_status, 401) AS http_status FROM asked a LEFT JOIN decided d USING (request_id)""")
def status(spark, sf):
    return _served(spark, sf)["status"]


@query("flow_request_audit", _SERVE + "SELECT secret_id, user_id, 'retrieved' AS action, ts AS timestamp FROM decided WHERE http_status = 200")
def audit(spark, sf):
    return _served(spark, sf)["audit"]


@query("a8_endpoint_scopes", cte("call_lines", extra=f"{_SCOPE_VALUES}, {_SCOPED}") + """SELECT s.service, s.endpoint, s.scope, count(c.repo) AS calls
FROM scopes s LEFT JOIN scoped c ON c.service = s.service AND c.endpoint = s.endpoint GROUP BY ALL""")
def endpoint_scopes(spark, sf):
    calls = _scoped(spark, sf).groupBy("service", "endpoint").agg(F.count("*").alias("calls"))
    return rules.endpoint_scopes_df(spark).join(calls, ["service", "endpoint"], "left").fillna(0, ["calls"])
