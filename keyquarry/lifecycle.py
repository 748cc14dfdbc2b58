"""End-to-end batch jobs composed of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keyquarry.functions.access import limiter_key
from keyquarry.operators import access, manifests, ratelimit, secrets, services
from keyquarry.operators.vault import CALLER
from keyquarry.rules import SecretPattern
from keyquarry.sources.code import drop_removed


def scan_change_set(changes: DataFrame, patterns: list[SecretPattern] | None = None) -> dict[str, DataFrame]:
    """Leaks in the (file, status, content) rows of change sets: findings, report, plan, summary, verdict.

    Other columns (a repository, a change id) are kept in the findings.
    """
    findings = secrets.scan_texts(drop_removed(changes).drop("status"), patterns=patterns)
    return {
        "findings": findings,
        "report": secrets.finding_report(findings),
        "plan": secrets.remediation_plan(findings),
        "summary": secrets.scan_summary(findings),
        "verdict": secrets.scan_verdict(findings),
    }


def analyze_dependencies(
    files: DataFrame, owners: DataFrame, vault_secrets: DataFrame, file_type: str | None = None
) -> dict[str, DataFrame]:
    """Services of manifests, their scopes and configuration, and the keys their owners lack.

    ``owners`` maps project to user_id.
    """
    dependencies, found, errors = manifests.scan_manifests(files, file_type)
    per_project = services.max_confidence_by_service(found, ["project"])
    detected = per_project.join(owners.select("project", "user_id"), "project")
    return {
        "dependencies": dependencies,
        "services": services.attach_service_config(services.recommended_scopes(per_project)),
        "missing": services.missing_keys(detected, vault_secrets),
        "errors": errors,
    }


def serve_requests(
    requests: DataFrame, api_keys: DataFrame, users: DataFrame, owned_secrets: DataFrame, at: Column,
    action: str = "retrieved", window_seconds: float = 60,
) -> dict[str, DataFrame]:
    """A log of (request_id, ts, api_key, secret_id) requests decided as they were made:
    key check, limit of the user's tier, ownership.  Gives a status per request and the
    audit rows of the granted ones, with the caller's address and agent where the log has them.
    """
    none = F.lit(None).cast("string")
    known = access.authenticate(requests, api_keys, users, at)
    identity = limiter_key(F.col("user_id"), none, none, none, none)
    limited = ratelimit.tier_rate_limit(known, identity, window_seconds=window_seconds)
    owned = access.check_ownership(limited.filter("allowed"), owned_secrets)
    decided = owned.select("request_id", "user_id", "http_status").unionByName(
        limited.filter(~F.col("allowed")).select("request_id", "user_id", F.lit(429).alias("http_status"))
    )
    status = requests.select("request_id").join(decided, "request_id", "left").select(
        "request_id", "user_id", F.coalesce("http_status", F.lit(401)).alias("http_status")
    )
    caller = [c for c in CALLER if c in requests.columns]
    audit = owned.filter(F.col("http_status") == 200).select(
        "secret_id", "user_id", F.lit(action).alias("action"), *caller, F.col("ts").alias("timestamp")
    )
    return {"status": status, "audit": audit}
