import base64
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from keyquarry.functions import text as tx
from keyquarry.operators import access, crypto, quality, usage, vault
from keyquarry.schemas import TABLES, conform
from keyquarry.sources.tables import read_table, write_table

KEY = base64.b64encode(b"k" * 32).decode()
OTHER = base64.b64encode(b"o" * 32).decode()
AT = "2024-01-10 00:00:00"


def at(text=AT):
    return F.lit(text).cast("timestamp_ntz")


def vault_rows(spark):
    rows = [("1", "API_KEY_1", "project-a", "dev", '["api"]', "e1"), ("2", "API_KEY_2", "project-a", "prod", '["api","critical"]', "e2"),
            ("3", "DB_PASSWORD", "project-b", "dev", '["database"]', "e3")]
    df = spark.createDataFrame(rows, "id string, name string, project string, environment string, tags string, value_encrypted string")
    stamp = at("2024-01-01 00:00:00")
    return conform(df.withColumn("created_at", stamp).withColumn("updated_at", stamp), "secrets")


@pytest.mark.parametrize("args,ids", [
    ({}, ["1", "2", "3"]), ({"project": "project-a"}, ["1", "2"]), ({"environment": "dev"}, ["1", "3"]),
    ({"project": "project-a", "environment": "prod"}, ["2"]), ({"tags": ["critical"]}, ["2"]),
    ({"project": "non-existent"}, []), ({"tags": ["crit"]}, []), ({"tags": ["database", "critical"]}, ["2", "3"]),
])
def test_list_vault(spark, args, ids):
    out = access.list_vault(vault_rows(spark), **args)
    assert sorted(r.id for r in out.collect()) == ids and "value_encrypted" not in out.columns


def test_lookup(spark):
    keys = spark.createDataFrame([("1",), ("no",)], "id string")
    got = {r.id: r.name for r in access.lookup(keys, vault_rows(spark)).collect()}
    assert got == {"1": "API_KEY_1", "no": None}


def changes(spark, rows):
    df = spark.createDataFrame(rows, "id string, name string, project string, environment string, value_encrypted string, at string")
    return df.withColumn("at", F.col("at").cast("timestamp_ntz")).withColumn("tags", F.lit(None).cast("array<string>"))


def test_upsert(spark):
    new = vault.upsert_secrets(vault_rows(spark), changes(spark, [
        ("9", "API_KEY_1", "project-a", "dev", "new", "2024-01-02 00:00:00"),
        ("9", "API_KEY_1", "project-a", "dev", "newer", "2024-01-03 00:00:00"),
        ("10", "API_KEY_1", "project-a", "prod", "other env", "2024-01-02 00:00:00"),
    ]))
    got = {r.id: r for r in new.collect()}
    assert set(got) == {"1", "2", "3", "10"}
    assert got["1"].value_encrypted == "newer" and got["1"].updated_at > got["1"].created_at and got["1"].tags == ["api"]
    assert got["10"].tags == [] and got["10"].created_at == got["10"].updated_at
    assert got["2"].value_encrypted == "e2" and got["2"].updated_at == got["2"].created_at


def test_hard_delete_ignores_unknown(spark):
    ids = spark.createDataFrame([("1",), ("no",)], "id string")
    assert sorted(r.id for r in vault.hard_delete(vault_rows(spark), ids).collect()) == ["2", "3"]


def secrets(spark):
    df = spark.createDataFrame([("a", "u1", 1), ("b", "u2", 1), ("c", "u1", 0)], "id string, user_id string, is_active int")
    return df.withColumn("service", F.lit("stripe")).withColumn("created_at", at("2023-01-01 00:00:00")).withColumn(
        "last_rotated_at", F.lit(None).cast("timestamp_ntz"))


def asked(spark, rows):
    return spark.createDataFrame(rows, "secret_id string, user_id string").withColumn("at", at())


def versions_of(spark, rows):
    return spark.createDataFrame(rows, "secret_id string, version long, value_hash string, valid_from string, superseded_at string, valid_to string").withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("valid_from", "superseded_at", "valid_to")})


def rotations(spark, rows):
    return spark.createDataFrame(
        rows, "request_id string, secret_id string, user_id string, at string, value_hash string, grace_hours double, ip_address string, user_agent string",
    ).withColumn("at", F.col("at").cast("timestamp_ntz"))


def test_rotation_keeps_the_old_value_for_the_grace_period(spark):
    first = versions_of(spark, [("a", 1, "v0", "2023-01-01", "2023-02-01", "2023-02-02"), ("a", 2, "v1", "2023-02-01", None, None), ("b", 1, "w", "2023-01-01", None, None)])
    day = "2024-01-0"
    out = vault.rotate_values(first, secrets(spark), rotations(spark, [
        ("r1", "a", "u1", day + "1", "v2", 1.5, "10.0.0.1", "cli"), ("r3", "a", "u1", day + "3", "v1", 0.0, None, None), ("r2", "a", "u1", day + "2", "v3", None, "10.0.0.2", None),
        ("r4", "a", "u1", day + "4", "x", 168.5, None, None), ("r5", "b", "u1", day + "4", "x", 1.0, None, None), ("r6", "c", "u1", day + "4", "x", 1.0, None, None),
        ("r7", "a", "u1", "2023-01-15", "x", 1.0, None, None), ("r8", "a", "u1", None, "x", 1.0, None, None), ("r9", None, "u1", day + "4", "x", -1.0, None, None)]))
    status = {r.request_id: r.http_status for r in out["status"].collect()}
    assert status == {"r1": 200, "r2": 200, "r3": 200, "r4": 400, "r5": 403, "r6": 404, "r7": 409, "r8": 400, "r9": 400}
    got = [(r.version, r.value_hash, str(r.superseded_at), str(r.valid_to)) for r in out["versions"].filter("secret_id = 'a'").orderBy("version").collect()]
    assert got == [(1, "v0", "2023-02-01 00:00:00", "2023-02-02 00:00:00"), (2, "v1", "2024-01-01 00:00:00", "2024-01-01 01:30:00"),
                   (3, "v2", "2024-01-02 00:00:00", "2024-01-03 00:00:00"), (4, "v3", "2024-01-03 00:00:00", "2024-01-03 00:00:00"), (5, "v1", "None", "None")]
    valid = {(r.version, r.in_grace) for r in vault.valid_versions(out["versions"], at("2024-01-02 12:00:00")).filter("secret_id = 'a'").collect()}
    assert valid == {(3, True), (4, False)}      # both values open during the grace period
    audit = sorted((r.secret_id, str(r.timestamp)[:10], r.ip_address, r.user_agent) for r in out["audit"].collect())
    assert audit == [("a", "2024-01-01", "10.0.0.1", "cli"), ("a", "2024-01-02", "10.0.0.2", None), ("a", "2024-01-03", None, None)]
    uses = [("a", "v1", "2023-01-31", "unknown", None), ("a", "v1", "2024-01-01", "grace", 2), ("a", "v1", "2024-01-02", "expired", 2), ("a", "v1", "2024-01-05", "current", 5),
            ("a", "v3", "2024-01-03", "expired", 4), ("a", "v2", "2024-01-02", "grace", 3), ("b", "v1", "2024-01-05", "unknown", None), (None, "v1", "2024-01-05", "unknown", None),
            ("a", None, "2024-01-05", "unknown", None), ("a", "v1", None, "unknown", None)]
    asked_at = spark.createDataFrame([(i, *u[:3]) for i, u in enumerate(uses)], "`use.id` int, secret_id string, value_hash string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    judged = {r["use.id"]: (r.value_status, r.version) for r in vault.value_status(asked_at, out["versions"]).collect()}
    assert judged == {i: u[3:] for i, u in enumerate(uses)}
    assert vault.value_status(asked_at.limit(0), out["versions"]).count() == 0 and vault.value_status(asked_at, first.limit(0)).filter("value_status <> 'unknown'").count() == 0


def test_one_secret_with_all_rotations_and_uses(spark):
    """Against a loop in order of time, with one secret that holds every row."""
    import random
    rnd = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    stamp = lambda hours: str(start + dt.timedelta(hours=hours))
    asks = sorted((round(rnd.uniform(1, 900), 2), f"r{i:03}", rnd.choice(["p", "q", "s", f"n{i}"]), rnd.choice([0.0, 3.0, 24.0, 168.0])) for i in range(300))
    first = versions_of(spark, [("a", 1, "p", stamp(0), None, None)])
    out = vault.rotate_values(first, secrets(spark), rotations(spark, [(r, "a", "u1", stamp(h), v, g, None, None) for h, r, v, g in asks]))
    begun = [(0.0, "p"), *[(h, v) for h, _, v, _ in asks]]
    ends = [*[(h, h + g) for h, _, _, g in asks], (1e9, 1e9)]
    used = [(i, round(rnd.uniform(-5, 1200), 2) if i % 9 else asks[i // 9][0], rnd.choice(["p", "q", "s"])) for i in range(900)]
    uses = spark.createDataFrame([(i, "a", v, stamp(h)) for i, h, v in used], "use_id int, secret_id string, value_hash string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.use_id: r.value_status for r in vault.value_status(uses, out["versions"]).collect()}
    for i, h, v in used:
        mine = [e for (b, value), e in zip(begun, ends) if value == v and b <= h]
        want = "unknown" if not mine else "current" if any(s > h for s, _ in mine) else "grace" if any(u > h for _, u in mine) else "expired"
        assert got[i] == want, (i, h, v)


def test_one_output_of_a_rotation_equals_all(spark):
    first = versions_of(spark, [("a", 1, "v0", "2023-01-01", None, None), ("b", 1, "w", "2023-01-01", None, None)])
    asks = [("r1", "a", "u1", "2024-01-01", "v1", 1.5, "10.0.0.1", "cli"), ("r2", "a", "u1", "2024-01-02", "v2", None, None, None), ("r3", "b", "u1", "2024-01-02", "x", 1.0, None, None)]
    given = (first, secrets(spark), rotations(spark, asks))
    for name, df in vault.rotate_values(*given).items():
        found = vault.rotate_values(*given, only=name)
        assert list(found) == [name] and found[name].schema.simpleString() == df.schema.simpleString() and sorted(map(repr, found[name].collect())) == sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", ["rotations", "value_uses"])
def test_narrow_fixtures_give_the_same_rows(spark, tmp_path, name):
    """Rows that come twice, and rows without one of the numbers, some of which give one text only."""
    from keyquarry.sources import fixtures
    at = dt.datetime(2024, 1, 1)
    rows = [(k, p, s, n, at) for k in (1, 2, None) for p in (1, 10, 37, None) for s in (4, 5, 260, None) for n in (1, 2, None)] * 2 + [(1, 1, 5, 1, at + dt.timedelta(days=1)), (1, 1, 5, 1, None)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7), (1, 8), (2, 7), (2, 7), (None, 3)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    got, want = fixtures.frame(spark, str(tmp_path), name), fixtures.sql(spark, str(tmp_path), fixtures.SQL[name])
    assert got.schema.simpleString() == want.schema.simpleString() and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert fixtures.SPARK_SQL[name].count("SELECT DISTINCT l_orderkey") == 1


def uses_of_versions(spark):
    """One value with most of the uses, also without secret, value or time; values that are digests and others."""
    import random
    rnd = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    stamp = lambda hours: str(start + dt.timedelta(hours=hours))
    value_of = {"p": "0123456789abcdef" * 2, "q": "0123456789ABCDEF", "s": "abc", "t": "é", "u": ""}
    begun = sorted((round(rnd.uniform(0, 300), 1), rnd.choice("ab"), value_of[rnd.choice("ppppqstu")], rnd.choice([0.0, 5.0, 80.0])) for _ in range(60))
    rows, last = [], {}
    for n, (h, s, v, g) in enumerate(begun):
        after = next((b for b in begun[n + 1:] if b[1] == s), None)
        last[s] = last.get(s, 0) + 1
        rows.append((s, last[s], v, stamp(h), after and stamp(after[0]), after and stamp(after[0] + g)))
    used = [(i, "a" if i % 5 else rnd.choice(["b", "c", None]), value_of["p"] if i % 5 else rnd.choice([*value_of.values(), None]), None if i % 50 == 7 else stamp(rnd.choice([round(rnd.uniform(-5, 400), 1), begun[i % 60][0]])))
            for i in range(1200)]
    versions = versions_of(spark, rows)
    uses = spark.createDataFrame(used, "use_id int, secret_id string, value_hash string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    far = "9999"
    want = {}
    for i, s, v, at_ in used:
        mine = [(e or far, u or far, n) for a, n, b, f, e, u in rows if s is not None and v is not None and at_ is not None and (a, b) == (s, v) and f <= at_]
        end = max((u, n) for _, u, n in mine) if mine else None
        want[i] = ("unknown" if not mine else "current" if max(e for e, _, _ in mine) > at_ else "grace" if end[0] > at_ else "expired", end and end[1])
    return uses, versions, want


@pytest.mark.parametrize("room", [0, 30, 100_000])
def test_uses_in_one_and_two_levels(spark, monkeypatch, room):
    """Values with more uses than there is room for go by slices of time, the others are put in order at once; the results are those of a loop."""
    uses, versions, want = uses_of_versions(spark)
    plain = vault.running_max
    monkeypatch.setattr(vault, "running_max", lambda *given: plain(*given, room=room))
    out = vault.value_status(uses, versions)
    assert {r.use_id: (r.value_status, r.version) for r in out.collect()} == want
    assert sorted(map(repr, out.select(*uses.columns).collect())) == sorted(map(repr, uses.collect())) and {s for s, _ in want.values()} == {"unknown", "current", "grace", "expired"}


def test_uses_are_moved_once(spark):
    """Where no value has very many uses, rows meet by one exchange of packed values; the counts before it and the slices cost none by the row."""
    uses, versions, _ = uses_of_versions(spark)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = vault.value_status(uses, versions)
        out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    ran = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert ran.count("Exchange hashpartitioning(") == 1 and ran.count("Window ") == 1


def test_packed_texts_come_back(spark):
    texts = ["", "00", "0123456789abcdef", "0123456789ABCDEF", "abc", "a", "é", "\x01", "xyz", " 00", "00 ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.packed(F.col("t")).alias("b"))
    got = {r.t: (r.n, r.back) for r in df.select("t", F.length("b").alias("n"), tx.unpacked(F.col("b")).alias("back")).collect()}
    assert {t: back for t, (_, back) in got.items()} == {t: t for t in texts} and df.select("b").distinct().count() == len(texts)
    assert got["0123456789abcdef"][0] == 9 and got["0123456789ABCDEF"][0] == 17 and got[None][0] is None


def test_uses_move_their_key_once(spark, monkeypatch):
    first = versions_of(spark, [("a", 1, "p", "2024-01-01", None, None)])
    uses = spark.createDataFrame([(1, "a", "p", "2024-01-02"), (2, "a", "q", "2024-01-02")], "use_id int, secret_id string, value_hash string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    seen, plain = [], vault.running_max
    monkeypatch.setattr(vault, "running_max", lambda df, *rest: seen.append(df.schema["_use"].dataType.names) or plain(df, *rest))
    out = vault.value_status(uses, first)
    assert out.columns == [*uses.columns, "value_status", "version"] and seen == [["use_id", "_use"]]
    assert {(r.use_id, r.secret_id, r.value_hash, str(r.ts)[:10], r.value_status) for r in out.collect()} == {(1, "a", "p", "2024-01-02", "current"), (2, "a", "q", "2024-01-02", "unknown")}


def test_rotate_and_delete(spark):
    requests = asked(spark, [("a", "u1"), ("b", "u1"), ("c", "u1"), ("x", "u1"), ("a", "u1")])
    out = vault.rotate_secrets(secrets(spark), requests)
    rotated = {r.id: r.last_rotated_at for r in out["snapshot"].collect()}
    assert rotated["a"] is not None and rotated["b"] is None and rotated["c"] is None
    status = sorted((r.secret_id, r.http_status) for r in out["status"].collect())
    # A deleted secret is gone for requests, another owner's is forbidden.
    assert status == [("a", 200), ("a", 200), ("b", 403), ("c", 404), ("x", 404)]
    assert out["audit"].count() == 2 and out["usage"].count() == 2
    gone = vault.soft_delete(secrets(spark), requests)
    assert {r.id: r.is_active for r in gone["snapshot"].collect()} == {"a": 0, "b": 1, "c": 0}
    assert [r.id for r in access.list_secrets(gone["snapshot"]).collect()] == ["b"]


def test_rotation_days(spark):
    df = spark.createDataFrame([("2024-01-09 12:00:00",), ("2024-01-09 00:00:00",), ("2023-01-01 00:00:00",), ("2023-10-12 00:00:01",)], "c string")
    df = df.select(F.col("c").cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("last_rotated_at"))
    got = [(r.days_left, r.overdue) for r in vault.rotation_status(df, at()).collect()]
    # Half a day is no elapsed day; 89 whole days leave one.
    assert got == [(90, False), (89, False), (0, True), (1, False)]


def test_export_and_overlay(spark, tmp_path):
    df = spark.createDataFrame([("A", "plain"), ("B", 'sp ace "q" \\'), ("C", "#x"), ("D", 'no"blank')], "name string, value string")
    env = [r.line for r in vault.export_pairs(df, "env").collect()]
    assert env == ["A=plain", 'B="sp ace \\"q\\" \\\\"', 'C="#x"', 'D=no"blank']
    yaml = [r.line for r in vault.export_pairs(df, "yaml").collect()]
    assert yaml[0] == 'A: "plain"' and yaml[3] == 'D: "no\\"blank"'
    assert [json.loads(r.line) for r in vault.export_pairs(df, "json").collect()][1] == {"B": 'sp ace "q" \\'}
    vault.write_export(df, str(tmp_path / "out"), "yaml")
    text = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert "# export" in text and len(text) == 5
    base = spark.createDataFrame([(1, "# c"), (2, "A=1=2"), (3, " B = x "), (4, ""), (5, "A=3"), (6, "=no")], "line_no bigint, line string")
    over = spark.createDataFrame([(1, "Z", "z z"), (2, "B", "new")], "position bigint, name string, value string")
    got = [(r["name"], r.line) for r in vault.overlay_config(base, over).orderBy("sort").collect()]
    assert got == [("A", "A=3"), ("B", "B=new"), ("Z", 'Z="z z"')]


@pytest.mark.parametrize("text", ["secret", "", "!@#$%^&*()", "日本語 🔐 é", "x" * 10000])
def test_encryption_round_trip(spark, text):
    key, other = crypto.raw_key(KEY), crypto.raw_key(OTHER)
    df = spark.createDataFrame([(text,), (text,)], "v string")
    cipher = crypto.encrypt_column(df, "v", key, "c")
    row = cipher.select(crypto.decrypted(F.col("c"), key).alias("p"), crypto.decrypted(F.col("c"), other).alias("w")).first()
    assert row.p == text and row.w is None
    a, b = [r.c for r in cipher.collect()]
    assert a != b and a != text


def test_damaged_text_is_set_aside(spark):
    key = crypto.raw_key(KEY)
    bad = spark.createDataFrame([(1, "not base64!"), (2, "AAAA"), (3, None)], "id int, c string")
    opened = crypto.decrypt_column(bad, "c", key, "p")
    good, rejected = crypto.quarantine(opened, "c", "p")
    assert [r.id for r in good.collect()] == [3] and sorted(r.id for r in rejected.collect()) == [1, 2]


def test_key_length():
    with pytest.raises(ValueError):
        crypto.raw_key(base64.b64encode(b"short").decode())


# ---------------------------------------------------------------- contracts

UUID = "123e4567-e89b-12d3-a456-426614174000"
GOOD = {
    "create_user": {"email": "a@b.co", "password": "Passw0rd"},
    "login": {"email": "a@b.co", "password": "x"},
    "create_secret": {"service": "stripe"},
    "update_secret": {},
    "rotate_secret": {"gracePeriodHours": 168, "notifyChannels": ["email"]},
    "analyze_project": {"packageManager": "npm", "language": "go"},
    "validate_compliance": {},
    "create_api_key": {"name": "n", "expiresIn": 3},
    "revoke_api_key": {"keyId": UUID},
    "create_organization": {"name": "n"},
    "invite_member": {"email": "a@b.co", "role": "owner"},
    "chat_message": {"message": "x" * 2000},
    "create_webhook": {"url": "https://x.y/z", "events": ["secret.created"]},
    "create_rotation_policy": {"secretId": UUID, "intervalDays": 1},
    "search_docs": {"service": "s", "query": "q", "limit": 20},
    "get_usage": {"startDate": "2024-01-01T00:00:00Z"},
    "get_audit_logs": {"action": "user.login", "limit": 100, "offset": 0},
    "batch_create_secrets": {"secrets": [{"service": "s"}]},
    "batch_rotate_secrets": {"secretIds": [UUID]},
    "export_secrets": {},
}
BAD = [
    ("create_user", {"email": "a@b", "password": "Passw0rd"}, ["email: email"]),
    ("create_user", {"email": "a@b.co", "password": "pass"}, ["password: pattern [A-Z]", "password: pattern [0-9]", "password: min_length"]),
    ("create_user", {"email": "a@b.co", "password": "Passw0rd", "tier": "gold"}, ["tier: enum"]),
    ("login", {"email": "a@b.co", "password": ""}, ["password: min_length"]),
    ("create_secret", {"service": "s", "environment": "dev"}, ["environment: enum"]),
    ("update_secret", {"environment": "dev"}, ["environment: enum"]),
    ("rotate_secret", {"gracePeriodHours": 169}, ["gracePeriodHours: maximum"]),
    ("rotate_secret", {"notifyChannels": ["fax"]}, ["notifyChannels: enum"]),
    ("analyze_project", {"language": "rust"}, ["language: enum"]),
    ("validate_compliance", {"framework": "PCI_DSS"}, ["framework: enum"]),
    ("create_api_key", {"name": "n", "expiresIn": 0}, ["expiresIn: positive"]),
    ("revoke_api_key", {"keyId": "x"}, ["keyId: uuid"]),
    ("create_organization", {"name": "n", "tier": "free"}, ["tier: enum"]),
    ("invite_member", {"email": "a..b@c.de"}, ["email: email"]),
    ("chat_message", {"message": "x" * 2001}, ["message: max_length"]),
    ("chat_message", {}, ["message: required"]),
    ("create_webhook", {"url": "nope", "events": ["x"]}, ["url: url", "events: enum"]),
    ("create_rotation_policy", {"secretId": UUID, "intervalDays": 366}, ["intervalDays: maximum"]),
    ("search_docs", {"service": "s", "query": "q", "limit": 21}, ["limit: maximum"]),
    ("get_usage", {"startDate": "yesterday"}, ["startDate: datetime"]),
    ("get_audit_logs", {"offset": -1}, ["offset: minimum"]),
    ("batch_create_secrets", {"secrets": []}, ["secrets: min_items"]),
    ("batch_create_secrets", {"secrets": [{"service": ""}] * 11}, ["secrets: max_items", "secrets: service min_length"]),
    ("batch_rotate_secrets", {"secretIds": [UUID, "x"]}, ["secretIds: uuid"]),
    ("export_secrets", {"format": "xml"}, ["format: enum"]),
    # wrong types and explicit nulls
    ("rotate_secret", {"gracePeriodHours": "abc"}, ["gracePeriodHours: type"]),
    ("rotate_secret", {"notifyChannels": "email"}, ["notifyChannels: type"]),
    ("rotate_secret", {"gracePeriodHours": None, "notifyChannels": ["email", None]}, ["gracePeriodHours: type", "notifyChannels: type"]),
    ("create_user", {"email": 5, "password": ["Passw0rd"], "tier": None}, ["email: type", "password: type", "tier: type"]),
    ("create_secret", {"service": "s", "scopes": [1], "metadata": ["x"], "value": {}}, ["scopes: type", "metadata: type", "value: type"]),
    ("analyze_project", {"dependencies": {"a": 1}}, ["dependencies: type"]),
    ("validate_compliance", {"includeRecommendations": "true"}, ["includeRecommendations: type"]),
    ("chat_message", {"message": "m", "context": 5}, ["context: type"]),
    ("chat_message", {"message": "m", "context": {"projectPath": 1, "currentSecrets": [2], "recentActivity": "x"}},
     ["context: projectPath type", "context: currentSecrets type", "context: recentActivity type"]),
    ("batch_create_secrets", {"secrets": [{"service": 5}, {"environment": "dev"}, {"service": "", "scopes": "x", "value": 1, "metadata": []}]},
     ["secrets: service type", "secrets: service required", "secrets: service min_length", "secrets: environment enum", "secrets: scopes type",
      "secrets: value type", "secrets: metadata type"]),
    ("batch_create_secrets", {"secrets": ["x"]}, ["secrets: type"]),
    ("batch_create_secrets", {"secrets": [{"service": None}]}, ["secrets: service type"]),
    ("shared_analyze_project", {"projectPath": "p", "dependencies": {"a": None}}, ["dependencies: type"]),
    ("shared_user_preferences", {"userId": "u", "autoRotationEnabled": 1, "complianceFrameworks": ["ISO"]}, ["autoRotationEnabled: type", "complianceFrameworks: enum"]),
    ("login", [1], ["payload: type"]),
    ("login", None, ["payload: type"]),
]


def check(spark, contract, body):
    df = spark.createDataFrame([(json.dumps(body),)], "body string")
    return quality.check_contract(quality.parse_payload(df, contract, "body"), contract).first()


def test_there_are_twenty_request_contracts():
    assert len(quality.CONTRACTS) == 20 and set(GOOD) == set(quality.CONTRACTS) and len(quality.SHARED_CONTRACTS) == 10


@pytest.mark.parametrize("contract", list(GOOD))
def test_contract_accepts(spark, contract):
    assert check(spark, contract, GOOD[contract]).reasons == []


@pytest.mark.parametrize("contract,body,reasons", BAD)
def test_contract_rejects(spark, contract, body, reasons):
    assert sorted(check(spark, contract, body).reasons) == sorted(reasons)


@pytest.mark.parametrize("contract", list(quality.SHARED_CONTRACTS))
def test_shared_contracts_want_their_fields(spark, contract):
    required = [r.name for r in quality.SHARED_CONTRACTS[contract] if not r.optional and r.default is None]
    assert check(spark, contract, {}).reasons == [f"{n}: required" for n in required]


def test_typed_members_inside_payloads(spark):
    r = check(spark, "chat_message", {"message": "m", "context": {"projectPath": "p", "currentSecrets": ["a"], "recentActivity": [1, {"x": None}], "more": 1}})
    assert r.reasons == [] and (r.context.projectPath, r.context.currentSecrets) == ("p", ["a"])
    r = check(spark, "create_secret", {"service": "s", "metadata": {"n": 1, "o": {"p": [1]}}})
    assert r.reasons == [] and r.metadata == {"n": "1", "o": '{"p":[1]}'}
    assert check(spark, "shared_analyze_project", {"projectPath": "p"}).dependencies == {}


def test_payloads_of_all_contracts_in_one_pass(spark):
    cases = [(c, json.dumps(b), []) for c, b in GOOD.items()] + [(c, json.dumps(b), r) for c, b, r in BAD]
    cases += [("nothing", "{}", ["contract: unknown"]), (None, "{}", ["contract: unknown"]), ("login", "{not json", ["payload: type"]), ("login", None, ["payload: type"])]
    df = spark.createDataFrame([(i, c, b) for i, (c, b, _) in enumerate(cases)], "i int, contract string, body string")
    got = {r.i: sorted(r.reasons) for r in quality.check_payloads(df).collect()}
    assert got == {i: sorted(r) for i, (_, _, r) in enumerate(cases)}


def test_defaults(spark):
    r = check(spark, "create_rotation_policy", GOOD["create_rotation_policy"])
    assert (r.autoRotate, r.gracePeriodHours, r.notifyBefore) == (True, 24.0, 24.0)
    assert check(spark, "create_api_key", {"name": "n"}).scopes == ["read", "write"]


# ---------------------------------------------------------------- tables, access, usage

def test_thirteen_tables_round_trip(spark, tmp_path):
    assert len(TABLES) == 13
    df = spark.createDataFrame([("1", "u", "production", '["a"]', "soon")], "id string, name string, environment string, tags string, created_at string")
    write_table(df, "secrets", str(tmp_path))
    r = read_table(spark, "secrets", str(tmp_path)).first()
    assert r.environment == "prod" and r.tags == ["a"] and r.created_at is None


def test_action_names(spark):
    df = spark.createDataFrame([("secret.accessed",), ("secret.rotated",), ("deleted",)], "action string")
    assert [r.action for r in conform(df, "audit_logs").collect()] == ["retrieved", "rotated", "deleted"]


def test_quota(spark):
    s = spark.createDataFrame([(str(i), "u1", 1) for i in range(10)] + [("x", "u2", 1), ("y", "u2", 0)], "id string, user_id string, is_active int")
    u = spark.createDataFrame([("u1", "free"), ("u2", "pro"), ("u3", "odd")], "id string, tier string")
    got = {r.user_id: (r.used, r.quota, r.blocked) for r in usage.secret_quota(s, u).collect()}
    assert got == {"u1": (10, 10, True), "u2": (1, -1, False), "u3": (0, 10, False)}


def test_compliance_compat_and_real(spark):
    s = secrets(spark).withColumn("value_encrypted", F.lit(None).cast("string"))
    audit = spark.createDataFrame([("a",)], "secret_id string")
    real = {r.secret_id: r for r in usage.compliance_report(s, audit, "SOC2", at()).collect()}
    assert (real["a"].encryption_at_rest, real["a"].access_logging, real["a"].key_rotation_policy) == (False, True, False)
    assert all(r.compliant for r in usage.compliance_report(s, audit, "SOC2", at(), compat=True).collect())
    with pytest.raises(ValueError):
        usage.compliance_report(s, audit, "ISO", at())
    v = usage.validation_rows(usage.compliance_report(s, audit, "SOC2", at()), at()).first()
    assert [c.name for c in v.validation_results.checks] == ["Encryption at rest", "Access logging", "Key rotation policy"]


def test_page_bounds(spark):
    with pytest.raises(ValueError):
        access.query_audit(spark.range(1), limit=101)


def test_tier_gate_and_plans(spark):
    df = spark.createDataFrame([("u", "free"), ("u", "pro"), (None, None), ("u", None)], "user_id string, tier string")
    assert [r.http_status for r in access.gate_by_tier(df, ["pro"]).collect()] == [403, 200, 401, 403]
    users = spark.createDataFrame([("1", "free"), ("2", "team"), ("3", "enterprise")], "id string, tier string")
    assert {r.id: r.plan_key for r in access.plan_for(users, "year").collect()} == {"1": "free", "2": "team_yearly", "3": None}


def test_first_delete_wins_and_later_ones_find_nothing(spark):
    rows = [("a", "u1", 3), ("a", "u1", 1), ("a", "u2", 0), ("a", "u2", 5), ("b", "u2", 2)]
    requests = spark.createDataFrame(rows, "secret_id string, user_id string, n int").select(
        "secret_id", "user_id", F.timestamp_micros(F.col("n") * 1_000_000).cast("timestamp_ntz").alias("at"))
    gone = vault.soft_delete(secrets(spark), requests)
    status = [(r.secret_id, r.user_id, r.http_status) for r in gone["status"].orderBy("at").collect()]
    assert status == [("a", "u2", 403), ("a", "u1", 200), ("b", "u2", 200), ("a", "u1", 404), ("a", "u2", 404)]
    assert sorted((r.secret_id, r.user_id, r.timestamp.second) for r in gone["audit"].collect()) == [("a", "u1", 1), ("b", "u2", 2)]


def test_keys_expire_at_the_time_of_each_request(spark):
    from keyquarry import rules
    from keyquarry.functions.text import sha256_base64

    key = rules.API_KEY_PREFIX + "abc"
    when = F.timestamp_micros(F.col("n") * 1_000_000).cast("timestamp_ntz")
    requests = spark.createDataFrame([(1, key), (5, key), (9, key), (2, None)], "n int, api_key string").withColumn("ts", when)
    keys = spark.createDataFrame([(key, "u1", 0, 5)], "k string, user_id string, revoked int, n int").select(
        sha256_base64(F.col("k")).alias("key_hash"), "user_id", "revoked", when.alias("expires_at"))
    users = spark.createDataFrame([("u1", "team")], "id string, tier string")
    assert [r.n for r in access.authenticate(requests, keys, users, F.col("ts")).collect()] == [1]
    every = access.optional_authenticate(requests, keys, users, F.col("ts"))
    assert sorted((r.n, r.tier) for r in every.collect()) == [(1, "team"), (2, None), (5, None), (9, None)]
    assert every.columns == ["n", "api_key", "ts", "user_id", "tier"]
