"""Snapshot changes: old snapshot + change set -> new snapshot (and log rows).

Nothing is updated in place.  Each change set is reduced to one row per key by partial
aggregation first, so a key named many times costs one row in the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from keyquarry import rules
from keyquarry.functions.access import days_until_rotation
from keyquarry.functions.text import env_quoted, escaped, packed, parse_env_line, unpacked
from keyquarry.operators.access import check_ownership
from keyquarry.operators.ordered import latest_per_key, running_count, running_max
from keyquarry.session import materialize

_NAME = ["name", "project", "environment"]
#: Columns of a request that audit rows take over where the request has them.
CALLER = ("ip_address", "user_agent")
#: Columns of a version beside what is stored of the value.
VERSION = ("secret_id", "version", "valid_from", "superseded_at", "valid_to")


def upsert_secrets(old: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert or update on (name, project, environment).

    ``changes`` has id, name, project, environment, value_encrypted, tags, at.  An update
    replaces value and updated_at and keeps id, tags and created_at.
    """
    new = latest_per_key(changes, _NAME, ["at", "id"]).select(
        *_NAME, *[F.col(c).alias(f"_{c}") for c in ("id", "value_encrypted", "tags", "at")], F.lit(1).alias("_hit")
    )
    j = old.withColumn("_old", F.lit(1)).join(new, _NAME, "full_outer")
    known, hit = F.col("_old").isNotNull(), F.col("_hit").isNotNull()
    empty = F.array().cast("array<string>")
    values = {
        "id": F.coalesce("id", "_id"),
        "tags": F.when(known, F.col("tags")).otherwise(F.coalesce("_tags", empty)),
        "value_encrypted": F.when(hit, F.col("_value_encrypted")).otherwise(F.col("value_encrypted")),
        "created_at": F.when(known, F.col("created_at")).otherwise(F.col("_at")),
        "updated_at": F.when(hit, F.col("_at")).otherwise(F.col("updated_at")),
    }
    if "is_active" in old.columns:
        values["is_active"] = F.when(known, F.col("is_active")).otherwise(F.lit(1))
    return j.withColumns(values).select(*old.columns)


def _decided(secrets: DataFrame, requests: DataFrame) -> DataFrame:
    """Ownership status of (secret_id, user_id, at) requests; deleted secrets are unknown."""
    return check_ownership(requests, secrets.filter(F.col("is_active") == 1).select("id", "user_id"))


def _caller(df: DataFrame) -> list[str]:
    return [c for c in CALLER if c in df.columns]


def _log(decided: DataFrame, action: str) -> DataFrame:
    return decided.filter(F.col("http_status") == 200).select(
        "secret_id", "user_id", F.lit(action).alias("action"), *_caller(decided), F.col("at").alias("timestamp")
    )


def rotate_secrets(secrets: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """New snapshot, audit rows, usage rows and request statuses of a rotation batch."""
    decided = _decided(secrets, requests)
    ok = decided.filter(F.col("http_status") == 200)
    when = ok.groupBy(F.col("secret_id").alias("id")).agg(F.max("at").alias("_at"))
    values = {"last_rotated_at": F.coalesce("_at", "last_rotated_at")}
    if "updated_at" in secrets.columns:
        values["updated_at"] = F.coalesce("_at", "updated_at")
    snapshot = secrets.join(when, "id", "left").withColumns(values).select(*secrets.columns)
    usage = ok.select("user_id", F.lit("secret_rotated").alias("event_type"), F.col("at").alias("timestamp"))
    return {"snapshot": snapshot, "audit": _log(decided, "rotated"), "usage": usage, "status": decided}


def rotate_values(versions: DataFrame, secrets: DataFrame, requests: DataFrame,
                  default_hours: float = rules.DEFAULT_GRACE_HOURS, only: str | None = None) -> dict[str, DataFrame]:
    """Rotation to new values: each granted request makes a version, the one before stays valid for the grace period.

    ``versions`` has secret_id, version (1, 2, … without gaps), valid_from, superseded_at (null
    for the newest), valid_to (null: no end) and what is stored of the value; ``requests`` has
    request_id (unique), secret_id, user_id, at, grace_hours (null: ``default_hours``) and the same columns of the new
    value; address and agent of the caller, if there, go into the audit rows.  A request without a time or with a grace
    period outside 0 to 168 hours gets 400, one for an unknown or deleted secret 404, one of another user 403, one from before the
    newest version 409.  Granted ones count in (at, request_id).  Versions that ended before are
    not touched.  A secret with most of the requests is numbered by slices of time, and as numbers have no
    gaps, the version that ends another is found by an equi-join, not by ordering a secret's versions.

    Gives ``versions`` and ``snapshot`` (the secrets) after the batch, ``audit`` and ``usage`` rows, and the ``status`` of every request.
    With ``only`` just the one named: columns that it does not need are not moved, and nothing is written for the others.
    """
    stored = [c for c in versions.columns if c not in VERSION]
    newest = versions.filter(F.col("superseded_at").isNull())
    hours = F.coalesce(F.col("grace_hours").cast("double"), F.lit(float(default_hours)))
    invalid = F.col("at").isNull() | ~hours.between(0, rules.MAX_GRACE_HOURS)
    short = _texts(stored, versions, requests) if only == "versions" else []
    if only == "versions":      # 400s are not moved
        newest, requests = newest.withColumns({c: packed(F.col(f"`{c}`")) for c in short}), requests.filter(~invalid).withColumns({c: packed(F.col(f"`{c}`")) for c in short})
    asked = _decided(secrets, requests).join(
        newest.select("secret_id", F.col("version").alias("_version"), F.col("valid_from").alias("_since")), "secret_id", "left")
    status = F.when(invalid, 400).when(
        (F.col("http_status") == 200) & (F.col("at") < F.col("_since")), 409).otherwise(F.col("http_status"))
    decided = asked.withColumn("http_status", status).withColumn("_hours", hours)
    if only is None:
        decided = materialize(decided, "rotations")
    elif only == "versions":
        decided = materialize(decided.filter(F.col("http_status") == 200).select("secret_id", "request_id", "at", "http_status", "_version", "_hours", *stored), "rotations")
    granted = decided.filter(F.col("http_status") == 200)
    if only is not None and only != "versions":
        return {only: _outputs(secrets, decided, granted)[only]}
    number = (F.coalesce("_version", F.lit(0)) + F.col("_nth")).cast(versions.schema["version"].dataType)
    never = F.lit(None).cast(versions.schema["valid_from"].dataType)
    made = materialize(running_count(granted, ["secret_id"], "at", "request_id", "_nth").select(
        "secret_id", number.alias("version"), F.col("at").alias("valid_from"), never.alias("superseded_at"), never.alias("valid_to"), *stored, "_hours"), "versions")
    ends = made.select("secret_id", (F.col("version") - 1).alias("version"), F.col("valid_from").alias("_next"), "_hours")
    grace = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("_hours") * 3600).cast("decimal(18,6)"))
    still = newest.unionByName(made.drop("_hours")).join(ends, ["secret_id", "version"], "left")
    after = still.withColumns({"superseded_at": F.col("_next"), "valid_to": F.col("_next") + grace} | {c: unpacked(F.col(f"`{c}`")) for c in short}).select(*versions.columns)
    found = {"versions": versions.filter(F.col("superseded_at").isNotNull()).unionByName(after)}
    return found if only else found | _outputs(secrets, decided, granted)


def _texts(columns: list[str], *of: DataFrame) -> list[str]:
    """Those of the columns that are plain texts in all tables; they are moved in packed form."""
    return [c for c in columns if all(df.schema[c].dataType == StringType() for df in of)]


def _outputs(secrets: DataFrame, decided: DataFrame, granted: DataFrame) -> dict[str, DataFrame]:
    """What ``rotate_values`` gives beside the versions."""
    when = granted.groupBy(F.col("secret_id").alias("id")).agg(F.max("at").alias("_at"))
    snapshot = secrets.join(when, "id", "left").withColumn("last_rotated_at", F.coalesce("_at", "last_rotated_at")).select(*secrets.columns)
    return {
        "snapshot": snapshot,
        "audit": _log(decided, "rotated"),
        "usage": granted.select("user_id", F.lit("secret_rotated").alias("event_type"), F.col("at").alias("timestamp")),
        "status": decided.drop("_version", "_since", "_hours"),
    }


def valid_versions(versions: DataFrame, at: Column) -> DataFrame:
    """The versions whose value opens at ``at``: the newest by then, and those in their grace period (``in_grace``)."""
    begun = versions.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
    return begun.withColumn("in_grace", F.coalesce(F.col("superseded_at") <= at, F.lit(False)))


def value_status(uses: DataFrame, versions: DataFrame, value: str = "value_hash") -> DataFrame:
    """Adds ``value_status`` and ``version`` to uses (secret_id, a value, ts): was the value good when it was used?

    ``current``, ``grace`` (replaced, grace period not over), ``expired``, or ``unknown`` (no such value of the
    secret had begun by then; also without secret, value or time).  A value may come back in a later version: the best status
    counts, and ``version`` is the one that ends last.  An as-of join: uses and beginnings of versions are ordered by time
    within (secret, value), and the latest end so far decides.  Each row is moved once; only a value with very many uses is spread over slices of time.
    """
    far = F.lit("9999-12-31").cast("timestamp").cast(versions.schema["valid_from"].dataType)
    newer, until = F.coalesce("superseded_at", far), F.coalesce("valid_to", far)
    # what the rows are ordered by is moved once
    known_by = {c: k for c, v, k in (("secret_id", "secret_id", "_secret"), (value, value, "_value"), ("ts", "valid_from", "_at")) if uses.schema[c].dataType == versions.schema[v].dataType}
    texts = _texts([value], uses, versions)
    to, back = (packed, unpacked) if texts else (lambda c: c, lambda c: c)
    begun = versions.select(F.col("secret_id").alias("_secret"), to(F.col(value)).alias("_value"), F.col("valid_from").alias("_at"), F.lit(0).alias("_kind"),
                            newer.alias("_newer"), F.struct(until.alias("until"), F.col("version").alias("version")).alias("_until"))
    used = uses.select(F.col("secret_id").alias("_secret"), to(F.col(value)).alias("_value"), F.col("ts").alias("_at"), F.lit(1).alias("_kind"),
                       F.struct(*[F.col(f"`{c}`") for c in uses.columns if c not in known_by], F.lit(1).alias("_use")).alias("_use"))
    rows = running_max(begun.unionByName(used, allowMissingColumns=True), ["_secret", "_value"], "_at", "_kind", {"_best": "_until", "_last": "_newer"})
    known = F.col("_secret").isNotNull() & F.col("_value").isNotNull() & F.col("_at").isNotNull() & F.col("_best").isNotNull()
    status = F.when(~known, "unknown").when(F.col("_last") > F.col("_at"), "current").when(F.col("_best.until") > F.col("_at"), "grace").otherwise("expired")
    return rows.filter("_kind = 1").select(
        *[(back(F.col("_value")) if c == value and c in known_by else F.col(known_by[c] if c in known_by else f"_use.`{c}`")).alias(c) for c in uses.columns], status.alias("value_status"), F.when(known, F.col("_best.version")).alias("version"))


def soft_delete(secrets: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """As ``rotate_secrets`` for deletions: is_active becomes 0, rows stay.

    The first granted request deletes; the secret is unknown to later ones, whoever asks
    (404).  Requests of the same first instant count as one deletion with one audit row,
    which has the caller of the first of them in order of its columns.
    """
    asked = _decided(secrets, requests)
    caller = _caller(asked)
    first = asked.filter(F.col("http_status") == 200).groupBy("secret_id").agg(
        F.min("at").alias("_at"), F.min(F.struct("at", "user_id", *caller)).alias("_by"))
    late = F.coalesce(F.col("at") > F.col("_at"), F.lit(False))
    decided = asked.join(first.drop("_by"), "secret_id", "left").withColumn(
        "http_status", F.when(late, 404).otherwise(F.col("http_status"))).select(*asked.columns)
    gone = first.select(F.col("secret_id").alias("id"), "_at")
    values = {"is_active": F.when(F.col("_at").isNotNull(), 0).otherwise(F.col("is_active"))}
    if "updated_at" in secrets.columns:
        values["updated_at"] = F.coalesce("_at", "updated_at")
    snapshot = secrets.join(gone, "id", "left").withColumns(values).select(*secrets.columns)
    audit = first.select("secret_id", "_by.user_id", F.lit("deleted").alias("action"), *[f"_by.{c}" for c in caller], F.col("_at").alias("timestamp"))
    return {"snapshot": snapshot, "audit": audit, "status": decided}


def hard_delete(secrets: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is not in ``ids``; unknown ids are ignored."""
    return secrets.join(ids.select("id").distinct(), "id", "left_anti")


def revoke_api_keys(api_keys: DataFrame, requests: DataFrame) -> DataFrame:
    """Revoke keys named by (key_id, user_id); only the owner's request counts."""
    owned = requests.select(F.col("key_id").alias("id"), "user_id").distinct().withColumn("_hit", F.lit(1))
    return api_keys.join(owned, ["id", "user_id"], "left").withColumn(
        "revoked", F.when(F.col("_hit").isNotNull(), 1).otherwise(F.col("revoked"))
    ).select(*api_keys.columns)


def touch_last_used(rows: DataFrame, uses: DataFrame, key: str = "id", column: str = "last_used_at", ts: str = "ts") -> DataFrame:
    """Set ``column`` to the newest use of each key (never back in time)."""
    newest = uses.groupBy(key).agg(F.max(ts).alias("_used"))
    return rows.join(newest, key, "left").withColumn(column, F.greatest(column, "_used")).select(*rows.columns)


def due_rotations(schedules: DataFrame, at: Column) -> DataFrame:
    """Pending rotations whose time has come."""
    return schedules.filter((F.col("status") == "pending") & (F.col("scheduled_for") <= at))


def rotation_status(secrets: DataFrame, at: Column, policy_days: int = rules.DEFAULT_ROTATION_DAYS) -> DataFrame:
    """Adds days left and overdue flag, counted from the last rotation or creation."""
    left = days_until_rotation(F.coalesce("last_rotated_at", "created_at"), policy_days, at)
    return secrets.withColumn("days_left", left).withColumn("overdue", F.col("days_left") == 0)


def touch_updated_at(old: DataFrame, new: DataFrame, at: Column, key: str = "id") -> DataFrame:
    """``new`` with updated_at = ``at`` where any other column differs from ``old``."""
    cols = [c for c in new.columns if c not in (key, "updated_at")]
    before = old.select(key, F.struct(*cols).alias("_before"), F.col("updated_at").alias("_was"))
    same = F.struct(*cols).eqNullSafe(F.col("_before"))
    stamp = F.when(F.col("_was").isNull() & F.col("_before").isNull(), F.col("updated_at")).when(
        same, F.col("_was")
    ).otherwise(at)
    return new.join(before, key, "left").withColumn("updated_at", stamp).select(*new.columns)


def export_pairs(df: DataFrame, fmt: str = "env", name: str = "name", value: str = "value") -> DataFrame:
    """One ``line`` per name in env or yaml form, or one JSON object per name (JSON lines).

    One row per pair in name order: ``write.text`` of the result is the export.
    """
    n, v = F.col(name), F.col(value)
    if fmt == "env":
        line = F.concat(n, F.lit("="), env_quoted(v))
    elif fmt == "yaml":
        line = F.concat(n, F.lit(': "'), escaped(v), F.lit('"'))
    elif fmt == "json":
        line = F.to_json(F.create_map(n, v))
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return df.select(n.alias("name"), line.alias("line")).orderBy("name")


def write_export(df: DataFrame, path: str, fmt: str = "env", name: str = "name", value: str = "value",
                 header: str = "# export") -> None:
    """Write an export as text; yaml files start with a comment line."""
    lines = export_pairs(df, fmt, name, value).select(F.col("line").alias("value"))
    if fmt == "yaml":
        head = df.sparkSession.createDataFrame([(header,)], "value string")
        lines = head.unionByName(lines)
    lines.write.text(path)


def overlay_config(base_lines: DataFrame, overrides: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Existing env lines overlaid with (position, name, value) overrides.

    ``base_lines`` has line_no and line.  Overrides win, existing names keep their place,
    new names follow in their own order.  Returns by, name, value, line and a sort key.
    """
    by = by or []
    parsed = base_lines.select(*by, "line_no", parse_env_line(F.col("line")).alias("_kv")).filter(F.col("_kv").isNotNull())
    base = parsed.groupBy(*by, F.col("_kv.key").alias("name")).agg(
        F.min("line_no").alias("_place"), F.max_by("_kv.value", "line_no").alias("_base")
    )
    over = overrides.groupBy(*by, "name").agg(
        F.min("position").alias("_position"), F.max_by("value", "position").alias("_over"), F.lit(1).alias("_hit")
    )
    merged = base.join(over, [*by, "name"], "full_outer")
    value = F.when(F.col("_hit").isNotNull(), F.col("_over")).otherwise(F.col("_base"))
    return merged.select(
        *by, "name", value.alias("value"),
        F.concat("name", F.lit("="), env_quoted(value)).alias("line"),
        F.struct(F.col("_place").isNull().alias("appended"), F.coalesce("_place", "_position").alias("place")).alias("sort"),
    )
