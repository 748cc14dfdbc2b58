import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keyquarry import rules
from keyquarry.functions.text import shannon_entropy, trim_ws
from keyquarry.operators import calls, intents, secrets, services
from keyquarry.rules import SecretPattern
from keyquarry.sources.code import explode_lines, file_ext, read_sources

H32, H16 = "0123456789abcdef0123456789abcdef", "0123456789abcdef"


def lines(spark, rows):
    return spark.createDataFrame([(f, i + 1, s) for i, (f, s) in enumerate(rows)], "file string, line_no bigint, line string")


def types(df):
    return sorted((r.line_no, r.type) for r in df.collect())


def test_each_pattern(spark):
    samples = {
        "aws": "AKIA" + "A1B2C3D4E5F6G7H8", "stripe": "sk_live_" + H32, "stripe_test": "sk_test_" + H32,
        "openai": "sk-" + H32 + H16, "anthropic": "sk-ant-" + "a-" * 47 + "a", "github": "ghp_" + H32 + "abcd",
        "generic_api_key": f'my_api_key = "{H32}"', "jwt": "eyJa.eyJb.c",
    }
    out = secrets.scan_lines(lines(spark, [("a.ts", s) for s in samples.values()])).collect()
    assert {r.type for r in out} == set(samples)
    by_type = {r.type: r for r in out}
    assert by_type["stripe"].value == "sk_live_0123456789ab..." and by_type["stripe"].confidence == 0.9
    assert by_type["jwt"].service is None and by_type["jwt"].value == "eyJa.eyJb.c..."
    assert by_type["stripe_test"].service == "stripe"


def test_skips_and_first_match_only(spark):
    key = "sk_live_" + H32
    out = secrets.scan_lines(lines(spark, [
        ("a.ts", f"// {key}"), ("a.py", f"  # {key}"), ("x/.env.example", key), (".env.template.txt", key),
        ("a.ts", f"{key} {key}x"), ("a.ts", f" // {key}"), ("a.ts", f'API_KEY = "{H32}"'), ("a.ts", ""),
    ]))
    # Upper-case API_KEY is not matched; two keys in one line are one finding per pattern.
    assert types(out) == [(5, "stripe")]


def test_custom_pattern_and_entropy(spark):
    pattern = SecretPattern("token", r'token = "[0-9a-f]{40}"', None, ("token",))
    rows = [("a", f'token = "{"a" * 40}"'), ("a", f'token = "{H32}{H16[:8]}"')]
    assert types(secrets.scan_lines(lines(spark, rows), [pattern])) == [(1, "token"), (2, "token")]
    assert types(secrets.scan_lines(lines(spark, rows), [pattern], min_entropy=3.0)) == [(2, "token")]
    own = pattern._replace(min_entropy=3.0)
    assert types(secrets.scan_lines(lines(spark, rows), [own])) == [(2, "token")]
    no_needle = pattern._replace(needles=())
    assert types(secrets.scan_lines(lines(spark, rows), [no_needle])) == [(1, "token"), (2, "token")]


def test_whole_text_far_into_the_file(spark):
    text = "\n".join(["x"] * 5000 + ["sk_live_" + H32])
    df = spark.createDataFrame([("big.ts", text)], "file string, content string")
    assert types(secrets.scan_texts(df)) == [(5001, "stripe")]


@pytest.mark.parametrize("s", ["", "a", "aaaa", "abab", "héllo wörld", H32, "a.b*c[d]"])
def test_entropy(spark, s):
    want = -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0
    got = spark.createDataFrame([(s,)], "s string").select(shannon_entropy(F.col("s"))).first()[0]
    assert abs(got - want) < 1e-9


def test_report_and_plan(spark):
    found = secrets.scan_lines(lines(spark, [("a.ts", "sk_live_" + H32), ("a.ts", "eyJa.eyJb.c"), ("a.ts", f'apikey: "{H32}"'), ("b.ts", "sk_live_" + H32)]))
    plan = secrets.remediation_plan(found).collect()
    assert [(r.env_var, r.environment) for r in plan] == [("STRIPE_API_KEY", "production")] * 2
    assert {r.confidence for r in secrets.finding_report(found).collect()} == {"90%"}
    assert secrets.scan_verdict(found).first().asDict() == {"secrets_found": 4, "fail": 1}
    assert secrets.scan_verdict(found.limit(0)).first().asDict() == {"secrets_found": 0, "fail": 0}


def test_read_sources_and_lines(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.ts").write_text("one\ntwo\n")
    (tmp_path / "b.py").write_text("x")
    files = read_sources(spark, str(tmp_path))
    assert files.count() == 2
    names = {r.file.rsplit("/", 1)[1]: r.file for r in files.collect()}
    changes = spark.createDataFrame([(names["b.py"], "removed")], "file string, status string")
    kept = read_sources(spark, str(tmp_path), changes).collect()
    assert [r.file for r in kept] == [names["a.ts"]] and kept[0].status == "added"
    assert [(r.line_no, r.line) for r in explode_lines(files.filter("file like '%.ts'")).orderBy("line_no").collect()] == [
        (1, "one"), (2, "two"), (3, "")]
    exts = spark.createDataFrame([("a.b.ts",), ("Makefile",)], "f string").select(file_ext(F.col("f"))).collect()
    assert [r[0] for r in exts] == ["ts", "Makefile"]


def test_trim_is_unicode_aware(spark):
    df = spark.createDataFrame([(" ﻿ x  \t",)], "s string")
    assert df.select(trim_ws(F.col("s"))).first()[0] == "x"


# ---------------------------------------------------------------- calls

def found(spark, rows, **kw):
    return sorted((r.service, r.endpoint) for r in calls.extract_api_calls(lines(spark, rows), **kw).collect())


def scoped(spark, rows, **kw):
    return sorted((r.service, r.scope) for r in calls.match_scopes(calls.extract_api_calls(lines(spark, rows), **kw)).collect())


def test_calls_by_language(spark):
    assert found(spark, [("a.ts", "stripe.customers.create(); stripe.customers.create()")]) == [("stripe", "customers.create")] * 2
    assert found(spark, [("a.py", "stripe.Charge.list()"), ("a.ts", "stripe.Charge.list()"), ("a.rb", "stripe.charges.list()")]) == [("stripe", "charges.list")]
    assert found(spark, [("a.ts", "// s3.getObject"), ("a.ts", " * s3.getObject"), ("a.py", "# stripe.Charge.list()"), ("a.go", "// charge.New")]) == []
    assert found(spark, [("a.ts", "s3.getObject(); stripe.charges.list()")], services=["aws"]) == [("aws", "s3.getObject")]


def test_quirks_of_unmapped_methods(spark):
    rows = [("a.ts", "openai.chat.completions.create(); lambda.invoke(); sgMail.send()")]
    assert {e for _, e in found(spark, rows)} == {"chat.completions.unknown", "lambda.unknown", "send.unknown"}
    assert scoped(spark, rows) == []
    assert scoped(spark, rows, compat=False) == [
        ("aws", "lambda:InvokeFunction"), ("openai", "chat.completions:write"), ("sendgrid", "mail:send")]
    rows = [("a.ts", "stripe.customers.del(x); stripe.paymentIntents.cancel(y)")]
    assert len(found(spark, rows)) == 2 and scoped(spark, rows) == []
    assert scoped(spark, rows, compat=False) == [("stripe", "customers:write")]
    rows = [("a.go", "customer.New(p); s3Client.PutObject(i)")]
    assert len(found(spark, rows)) == 2 and scoped(spark, rows) == []
    assert scoped(spark, rows, compat=False) == [("aws", "s3:PutObject"), ("stripe", "customers:write")]
    rows = [("a.py", "client.images.generate(p); client.embeddings.create(e)")]
    assert scoped(spark, rows) == [("openai", "embeddings:write")]
    assert scoped(spark, rows, compat=False) == [("openai", "embeddings:write"), ("openai", "images:write")]


def test_project_analysis(spark):
    files = spark.createDataFrame([
        ("r", "a.ts", "stripe.customers.list()\nstripe.charges.list()"), ("r", "b.ts", "s3.putObject(p)"),
    ], "repo string, file string, content string")
    analysis, summary = calls.analyze_projects(files, ["stripe", "aws", "twilio", "nothing"])
    a = {r.service: r for r in analysis.collect()}
    assert a["stripe"].scopes == ["charges:read", "customers:read"] and a["stripe"].calls == 2
    assert abs(a["stripe"].confidence - 0.7) < 1e-9 and a["twilio"].confidence == 0.5
    assert "Consider using a read-only Stripe key for better security." in a["stripe"].suggestions
    assert any("separate IAM roles" in s for s in a["aws"].suggestions)
    assert a["twilio"].suggestions[0] == "No API calls detected for twilio. Consider removing this dependency."
    assert a["nothing"].suggestions == ["No API calls detected for nothing. Consider removing this dependency."]
    s = summary.first()
    unused = sum(len(r.unused_scopes) for r in a.values())
    assert (s.total_services, s.total_scopes) == (4, 3)
    assert abs(s.optimization_potential - unused / (unused + 3) * 100) < 1e-9


def test_confidence_is_capped(spark):
    files = spark.createDataFrame([("r", "a.ts", "\n".join(["s3.putObject(p)"] * 30))], "repo string, file string, content string")
    analysis, _ = calls.analyze_projects(files, ["aws"])
    assert analysis.first().confidence == 0.99


# ---------------------------------------------------------------- intents

@pytest.mark.parametrize("text,intent,field,value", [
    ("Provision a stripe key for production", "provision_secret", "service", "stripe"),
    ("new secret for the staging box", "provision_secret", "environment", "staging"),
    ("rotate 123E4567-e89b-12d3-a456-426614174000 please", "rotate_secret", "secret_id", "123E4567-e89b-12d3-a456-426614174000"),
    ("list dev and prod", "list_secrets", "environment", "production"),
    ("show what the laws say about my device", "list_secrets", "environment", "development"),
    ("renew by the laws", "rotate_secret", "service", "aws"),
    ("scan it", "analyze_project", "service", None),
    ("soc2 or gdpr compliance", "check_compliance", "framework", "SOC2"),
    ("compliance with pci", "check_compliance", "framework", "PCI-DSS"),
    ("?", "help", "service", None),
    ("are we SOC 2 ok under gdpr", "check_compliance", "framework", "SOC2"),
    ("hello", "unknown", "service", None),
])
def test_intents(spark, text, intent, field, value):
    r = intents.classify_intent(spark.createDataFrame([(text,)], "text string")).first()
    assert r.intent == intent and r[field] == value
    assert r.needs_review == (intent == "unknown")


# ---------------------------------------------------------------- rules from a table

def test_rule_table_equals_the_expression(spark):
    deps = spark.createDataFrame([(i, d) for i, d in enumerate(
        ["stripe", "@Stripe/stripe-js", "my-openai-sdk", "aws-sdk", "react", "", None, "é-redis", "pg", "AZURE-x", "stripe"])], "id int, `dep.name` string")
    rows = [(i, r.service, p, r.confidence) for i, r in enumerate(rules.SERVICE_RULES) for p in r.patterns]
    rows += [(900, "short", "pg", 0.5), (901, "none", None, 0.5), (902, "all", "", 0.1), (None, "none", "react", 0.5), (903, "é", "é-R", 0.2), (904, "one", "x", 0.3)]
    listed = [*rules.SERVICE_RULES, *(rules.ServiceRule(s, [p], c) for r, s, p, c in rows[-6:] if r is not None and p is not None)]
    table = spark.createDataFrame(rows, "rule int, service string, pattern string, confidence double")
    for mode in ("substring_ci", "substring_cs", "exact"):
        got = sorted(tuple(r) for r in services.match_rule_table(deps, table, mode, "dep.name").filter("`dep.name` IS NOT NULL").collect())
        want = sorted(tuple(r) for r in services.match_dependency_rules(deps, listed, mode, "dep.name").filter("`dep.name` IS NOT NULL").collect())
        assert got == want
    assert services.match_rule_table(deps, table.limit(0), dep="dep.name").count() == 0 and services.match_rule_table(deps.limit(0), table, dep="dep.name").count() == 0


def test_ten_thousand_rules(spark, capsys):
    import random
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choices("abcdef-/", k=n))
    names = ["@types/" + word(rnd.randint(0, 12)) for _ in range(400)]
    patterns = [(i, f"s{i % 70}", ("@types/" if i % 2 else "") + word(rnd.randint(2, 6))) for i in range(10_000)]
    deps = spark.createDataFrame([(i, d) for i, d in enumerate(names)], "id int, dep string")
    table = spark.createDataFrame([(*p, 0.5) for p in patterns], "rule int, service string, pattern string, confidence double")
    out = services.match_rule_table(deps, table, "substring_cs")
    assert sorted((r.id, r.service) for r in out.collect()) == sorted((i, s) for i, d in enumerate(names) for _, s, p in patterns if p in d)
    out.explain()
    assert "NestedLoop" not in capsys.readouterr().out


def test_rule_table_by_project_and_in_lists(spark, monkeypatch):
    """One name has most of the rows and many rules match it: rows and matches are not lost or doubled, and by project each different row is matched once."""
    monkeypatch.setattr(services, "_LIST", 3)
    deps = spark.createDataFrame([(f"p{i % 5}", i, "stripe-js" if i % 10 else None) for i in range(300)] + [("p9", 900, "pg"), ("p9", 900, "pg"), (None, 901, "pg")], "project string, id int, dep string")
    rules_of = [(i, f"s{i % 4}" if i % 4 else None, "stripe-js"[i % 3:i % 7 + 2], i / 1000) for i in range(400)] + [(1000, "x", "pg", 0.5), (1001, "x", "g", 0.7)]
    table = spark.createDataFrame(rules_of, "rule int, service string, pattern string, confidence double")
    matched = lambda: [(p, i, s, c) for p, i, d in map(tuple, deps.collect()) if d for _, s, w, c in rules_of if w in d]
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted(((r.project, r.id, r.service, r.confidence) for r in services.match_rule_table(deps, table).collect()), key=key)
    assert got == sorted(matched(), key=key)
    best: dict = {}
    for p, _, s, c in matched():
        best[p, s] = max(best.get((p, s), 0), c)
    rows = services.match_rule_table(deps, table, by=["project"])
    assert {(r.project, r.service): r.confidence for r in services.max_confidence_by_service(rows, ["project"]).collect()} == best
    assert rows.columns == ["project", "dep", "service", "confidence"] and rows.count() == len({(p, d, s) for p, _, d in map(tuple, deps.collect()) if d for _, s, w, _ in rules_of if w in d})
