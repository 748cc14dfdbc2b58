"""Scalar functions of requests, keys, errors, tiers and dates.

``at`` is always an argument: no function reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from keyquarry import rules
from keyquarry.functions.text import any_of

_DAY_MICROS = 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp read as UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def days_until_rotation(ts: Column, days: Column | int, at: Column) -> Column:
    """Days left, never negative; only whole elapsed days count."""
    elapsed = F.floor((micros(at) - micros(ts)) / _DAY_MICROS)
    days = F.lit(days) if isinstance(days, int) else days
    return F.greatest(F.lit(0).cast("bigint"), days.cast("bigint") - elapsed)


def is_rotation_overdue(ts: Column, days: Column | int, at: Column) -> Column:
    return days_until_rotation(ts, days, at) == 0


def format_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, yyyy, hh:mm a")


def key_expiry(created: Column, days: Column) -> Column:
    """``created + days``; no days (null or 0) means the key never expires."""
    return F.when(F.coalesce(days, F.lit(0)) != 0, created + F.make_dt_interval(days.cast("int")))


def limiter_key(user_id: Column, api_key: Column, connecting_ip: Column, forwarded: Column, real_ip: Column) -> Column:
    """``user:…``, else ``apikey:`` + 16 characters, else ``ip:…``; empty text counts as missing."""
    def present(c):
        return F.nullif(c, F.lit(""))

    ip = F.coalesce(present(connecting_ip), present(forwarded), present(real_ip), F.lit("unknown"))
    return (
        F.when(present(user_id).isNotNull(), F.concat(F.lit("user:"), user_id))
        .when(present(api_key).isNotNull(), F.concat(F.lit("apikey:"), F.left(api_key, F.lit(16))))
        .otherwise(F.concat(F.lit("ip:"), ip))
    )


def tier_limiter_key(tier: Column, identity: Column) -> Column:
    """The tier is part of the key, so a change of tier starts a new count."""
    return rate_key("tier-rl", tier_or_free(tier), identity)


def tier_or_free(tier: Column) -> Column:
    return F.coalesce(F.nullif(tier, F.lit("")), F.lit("free"))


def tier_max(tier: Column) -> Column:
    """Requests per minute of a tier."""
    out = F.lit(None).cast("int")
    for name, n in rules.TIER_REQUESTS_PER_MINUTE.items():
        out = F.when(tier_or_free(tier) == name, F.lit(n)).otherwise(out)
    return out


def rate_key(kind: str, *parts: Column) -> Column:
    """Counter key ``kind:part:part``."""
    return F.concat_ws(":", F.lit(kind), *parts)


def tier_from_price(price_id: Column) -> Column:
    out = F.lit("free")
    for tier in ["enterprise", "team", "pro"]:
        out = F.when(F.contains(price_id, F.lit(tier)), F.lit(tier)).otherwise(out)
    return out


def http_code_name(status: Column) -> Column:
    out = F.lit("UNKNOWN_ERROR")
    for code, name in rules.HTTP_CODE_NAMES.items():
        out = F.when(status == code, F.lit(name)).otherwise(out)
    return out


def classify_error(name: Column, status: Column, message: Column) -> Column:
    """struct(code, http_status); an explicit HTTP status wins, then the first rule that fits."""
    def result(code, http):
        return F.struct(F.lit(code).alias("code"), F.lit(http).alias("http_status"))

    return (
        F.when(status.isNotNull(), F.struct(http_code_name(status).alias("code"), status.cast("int").alias("http_status")))
        .when(name == "ZodError", result("VALIDATION_ERROR", 400))
        .when(any_of(message, ["D1_ERROR", "database"]), result("DATABASE_ERROR", 500))
        .when(any_of(message, ["encrypt", "decrypt"]), result("ENCRYPTION_ERROR", 500))
        .when(any_of(message, ["OpenAI", "API"]), result("EXTERNAL_SERVICE_ERROR", 503))
        .otherwise(result("INTERNAL_SERVER_ERROR", 500))
    )


def webhook_signature(header: Column) -> Column:
    """struct(timestamp, signature) of ``t=…,v1=…``; parts may come in any order, the first of each counts."""
    parts = F.split(header, ",")

    def value(prefix):
        hits = F.filter(parts, lambda p: F.startswith(p, F.lit(prefix)))
        return F.nullif(F.substr(F.try_element_at(hits, F.lit(1)), F.lit(len(prefix) + 1)), F.lit(""))

    return F.struct(value("t=").alias("timestamp"), value("v1=").alias("signature"))


def webhook_is_stale(t: Column, now: Column, limit: int = 300) -> Column:
    """Is the signed time (seconds) more than ``limit`` seconds before ``now``?"""
    return (now - t) > limit
