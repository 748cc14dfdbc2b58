"""The thirteen metadata tables: columns, constraints and references.

JSON text columns of the relational model are typed here: JSON arrays are
``array<string>``, free-form objects stay JSON text, flags are 0/1 integers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from keyquarry import rules


@dataclass(frozen=True)
class Table:
    ddl: str
    required: list[str]
    key: str = "id"
    enums: dict[str, list[str]] = field(default_factory=dict)
    unique: list[list[str]] = field(default_factory=list)
    references: dict[str, str] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return T._parse_datatype_string(self.ddl)


# Table definitions.
TABLES: dict[str, Table] = {
    "users": Table(
        "id string, email string, password_hash string, tier string, organization_id string, "
        "stripe_customer_id string, stripe_subscription_id string, created_at timestamp_ntz, "
        "updated_at timestamp_ntz, last_login_at timestamp_ntz, is_active int",
        ["id", "email", "password_hash", "tier", "created_at", "updated_at"],
        enums={"tier": rules.TIERS},
        unique=[["id"], ["email"]],
    ),
    "organizations": Table(
        "id string, name string, tier string, stripe_customer_id string, stripe_subscription_id string, "
        "created_at timestamp_ntz, updated_at timestamp_ntz, is_active int",
        ["id", "name", "tier", "created_at", "updated_at"],
        enums={"tier": rules.ORGANIZATION_TIERS},
        unique=[["id"]],
    ),
    "organization_members": Table(
        "id bigint, organization_id string, user_id string, role string, invited_at timestamp_ntz, "
        "joined_at timestamp_ntz",
        ["id", "organization_id", "user_id", "role", "invited_at"],
        enums={"role": rules.ROLES},
        unique=[["id"], ["organization_id", "user_id"]],
        references={"organization_id": "organizations", "user_id": "users"},
    ),
    "api_keys": Table(
        "id string, user_id string, key_hash string, name string, scopes array<string>, "
        "created_at timestamp_ntz, expires_at timestamp_ntz, last_used_at timestamp_ntz, revoked int",
        ["id", "user_id", "key_hash", "name", "created_at"],
        unique=[["id"], ["key_hash"]],
        references={"user_id": "users"},
    ),
    # The vault columns (name … updated_at) and the API columns (service … last_rotated_at).
    "secrets": Table(
        "id string, name string, project string, environment string, tags array<string>, "
        "value_encrypted string, created_at timestamp_ntz, updated_at timestamp_ntz, service string, "
        "user_id string, scopes array<string>, is_active int, last_rotated_at timestamp_ntz",
        ["id", "name", "project", "environment", "tags", "value_encrypted", "created_at", "updated_at"],
        enums={"environment": rules.ENVIRONMENTS},
        unique=[["id"], ["name", "project", "environment"]],
    ),
    "audit_logs": Table(
        "id bigint, secret_id string, user_id string, action string, ip_address string, "
        "user_agent string, metadata string, timestamp timestamp_ntz",
        ["id", "secret_id", "user_id", "action", "timestamp"],
        enums={"action": rules.SECRET_ACTIONS},
        unique=[["id"]],
        references={"secret_id": "secrets"},
    ),
    "service_configs": Table(
        "service string, provider_name string, api_base_url string, auth_type string, "
        "default_scopes array<string>, documentation_url string, rotation_supported int, metadata string",
        ["service", "provider_name"],
        key="service",
        enums={"auth_type": rules.AUTH_TYPES},
        unique=[["service"]],
    ),
    "user_preferences": Table(
        "user_id string, default_environment string, auto_rotation_enabled int, notification_email string, "
        "compliance_frameworks array<string>, created_at timestamp_ntz, updated_at timestamp_ntz",
        ["user_id", "created_at", "updated_at"],
        key="user_id",
        unique=[["user_id"]],
    ),
    "rotation_schedules": Table(
        "id bigint, secret_id string, scheduled_for timestamp_ntz, completed_at timestamp_ntz, "
        "status string, error_message string",
        ["id", "secret_id", "scheduled_for"],
        enums={"status": rules.ROTATION_STATUSES},
        unique=[["id"]],
        references={"secret_id": "secrets"},
    ),
    "compliance_validations": Table(
        "id bigint, secret_id string, framework string, is_compliant int, "
        "validation_results struct<checks:array<struct<name:string,passed:boolean,message:string>>>, "
        "validated_at timestamp_ntz",
        ["id", "secret_id", "framework", "is_compliant", "validation_results", "validated_at"],
        unique=[["id"]],
        references={"secret_id": "secrets"},
    ),
    "usage_events": Table(
        "id bigint, user_id string, event_type string, metadata string, timestamp timestamp_ntz",
        ["id", "user_id", "event_type", "timestamp"],
        enums={"event_type": rules.USAGE_EVENTS + rules.BILLING_EVENTS},
        unique=[["id"]],
        references={"user_id": "users"},
    ),
    "webhooks": Table(
        "id string, user_id string, url string, events array<string>, secret string, is_active int, "
        "created_at timestamp_ntz, last_triggered_at timestamp_ntz",
        ["id", "user_id", "url", "events", "created_at"],
        unique=[["id"]],
        references={"user_id": "users"},
    ),
    "webhook_deliveries": Table(
        "id bigint, webhook_id string, event_type string, payload string, response_status int, "
        "response_body string, delivered_at timestamp_ntz, success int",
        ["id", "webhook_id", "event_type", "payload", "delivered_at", "success"],
        unique=[["id"]],
        references={"webhook_id": "webhooks"},
    ),
}


def _aliased(c: Column, aliases: dict[str, str]) -> Column:
    out = c
    for old, new in aliases.items():
        out = F.when(c == old, F.lit(new)).otherwise(out)
    return out


def canonical_environment(c: Column) -> Column:
    return _aliased(c, rules.ENVIRONMENT_ALIASES)


def canonical_framework(c: Column) -> Column:
    return _aliased(c, rules.FRAMEWORK_ALIASES)


def canonical_action(c: Column) -> Column:
    """``secret.rotated`` -> ``rotated``; ``secret.accessed`` -> ``retrieved``."""
    return F.when(c == "secret.accessed", F.lit("retrieved")).otherwise(F.regexp_replace(c, r"^secret\.", ""))


def conform(df: DataFrame, name: str) -> DataFrame:
    """Cast ``df`` to table ``name``: missing columns and values that do not fit become null, JSON text arrays
    are parsed and old spellings of environments, actions and frameworks replaced."""
    have = dict(df.dtypes)
    fixes = {
        ("secrets", "environment"): canonical_environment,
        ("user_preferences", "default_environment"): canonical_environment,
        ("audit_logs", "action"): canonical_action,
        ("compliance_validations", "framework"): canonical_framework,
    }
    cols = []
    for f in TABLES[name].schema.fields:
        if f.name not in have:
            c = F.lit(None).cast(f.dataType)
        elif have[f.name] == "string" and isinstance(f.dataType, (T.ArrayType, T.StructType)):
            c = F.from_json(F.col(f.name), f.dataType.simpleString())
        else:
            c = F.col(f.name)
            if (name, f.name) in fixes:
                c = fixes[name, f.name](c)
            c = c.try_cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)
