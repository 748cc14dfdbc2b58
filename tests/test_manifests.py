import json

import pytest
from pyspark.sql import functions as F

from keyquarry import rules
from keyquarry.operators import manifests, services


def scan(spark, content, kind=None):
    df = spark.createDataFrame([("p", "f", content, kind)], "project string, file string, content string, kind string")
    deps, found, errors = manifests.scan_manifests(df, "kind" if kind else None)
    return (
        {r.dep: r.version for r in deps.collect()},
        {r.service: r for r in found.collect()},
        [r.error for r in errors.collect()],
        deps.first(),
    )


def test_node(spark):
    deps, found, errors, row = scan(spark, json.dumps({
        "dependencies": {"stripe": "^12.0.0", "openai": "^4.0.0", "@supabase/supabase-js": "^2.0.0"},
        "devDependencies": {"@sendgrid/mail": "^7.0.0"}}))
    assert set(found) == {"stripe", "openai", "supabase", "sendgrid"} and not errors
    assert found["stripe"].confidence > 0.9
    assert (row.language, row.package_manager) == ("javascript", "npm")


@pytest.mark.parametrize("named,manager", [("pnpm@8.0.0", "pnpm"), ("yarn@4", "yarn"), ("bun@1", "npm")])
def test_package_manager(spark, named, manager):
    assert scan(spark, json.dumps({"packageManager": named, "dependencies": {"stripe": "1"}}))[3].package_manager == manager


def test_scoped_aws_and_later_mention_wins(spark):
    deps, found, _, _ = scan(spark, json.dumps({
        "dependencies": {"@aws-sdk/client-s3": "1", "x": "first"}, "devDependencies": {"x": "second"}}))
    assert "aws" in found and deps["x"] == "second"


def test_requirements(spark):
    text = "stripe==5.0.0\nopenai>=1.0.0\npsycopg2-binary\n# Comment line\n\nredis~=4.0.0\nname[extra]==1\nspaced >=1\nnot!=2"
    deps, found, _, row = scan(spark, text, "requirements.txt")
    # '~=', '!=', extras and a blank before the operator are not parsed.
    assert deps == {"stripe": "*", "openai": "*", "psycopg2-binary": "*"}
    assert {"stripe", "openai", "postgresql"} == set(found)
    assert (row.language, row.package_manager) == ("python", "pip")


def test_go_mod(spark):
    text = ("module myapp\n\ngo 1.20\n\nrequire (\n    github.com/stripe/stripe-go v74.0.0\n    github.com/twilio/twilio-go v1.0.0\n)\n\n"
            "require github.com/redis/go-redis v9.0.0\nreplace github.com/a/b v1.0.0\nrequire (\n\tgithub.com/redis/go-redis v9.1.0\n)")
    deps, found, _, row = scan(spark, text)
    assert deps == {"github.com/stripe/stripe-go": "74.0.0", "github.com/twilio/twilio-go": "1.0.0",
                    "github.com/redis/go-redis": "9.1.0"}
    assert {"stripe", "twilio", "redis", "github"} == set(found)
    assert (row.language, row.package_manager) == ("go", "go")


def test_gemfile(spark):
    text = 'source "https://rubygems.org"\n\ngem "stripe", "~> 8.0"\ngem \'redis\', \'~> 4.0\'\n# gem "no"\ngem "pg"'
    deps, found, _, row = scan(spark, text)
    assert deps == {"stripe": "~> 8.0", "redis": "~> 4.0", "pg": "*"}
    assert {"stripe", "redis", "postgresql"} == set(found) and row.package_manager == "bundler"


def test_composer(spark):
    text = json.dumps({"require": {"stripe/stripe-php": "^10.0", "twilio/sdk": "^6.0"}, "require-dev": {"mongodb/mongodb": "^1.0"}})
    deps, found, _, row = scan(spark, text, "composer.json")
    assert set(found) == {"stripe", "twilio", "mongodb"} and (row.language, row.package_manager) == ("php", "composer")


def test_cargo(spark):
    text = ('[package]\nname = "myapp"\nversion = "0.1.0"\n\n[dependencies]\nstripe-rust = "0.1.0"\nredis = "0.23.0"\n'
            'serde = { version = "1" }\n\n[dev-dependencies]\ntokio = "1.0"\n[build-dependencies]\ncc = "1"')
    deps, found, _, row = scan(spark, text)
    assert deps == {"stripe-rust": "0.1.0", "redis": "0.23.0", "tokio": "1.0"}
    assert set(found) == {"stripe", "redis"} and (row.language, row.package_manager) == ("rust", "cargo")


@pytest.mark.parametrize("content,kind", [
    ('{"dependencies": {}}', "package.json"),
    ('{"require": {}, "note": "dependencies"}', "composer.json"),
    ("django >=4\nmongo x", "go.mod"),           # "django " holds "go "
    ("require (\n)", "go.mod"), ("gem 'x'", "Gemfile"), ("[dependencies]", "Cargo.toml"), ("flask", "requirements.txt"),
    ('{"require": {"a/b": "1"}}', "requirements.txt"),   # no "dependencies" in the text
])
def test_detection(spark, content, kind):
    df = spark.createDataFrame([(content,)], "content string")
    assert df.select(manifests.detect_manifest_type(F.col("content"))).first()[0] == kind


@pytest.mark.parametrize("content,error", [
    ("", "Cannot scan empty content"), (" \n\t", "Cannot scan empty content"),
    ('{"dependencies": nope', "Failed to scan dependencies: invalid JSON"),
    ('{"name": "dependencies"}', "Failed to scan dependencies: Unsupported file type"),
])
def test_errors_are_set_aside(spark, content, error):
    deps, found, errors, _ = scan(spark, content)
    assert errors == [error] and not deps and not found


def test_one_bad_manifest_does_not_stop_the_rest(spark):
    df = spark.createDataFrame([("a", "f", '{"dependencies": nope'), ("b", "f", "stripe")], "project string, file string, content string")
    deps, _, errors = manifests.scan_manifests(df)
    assert [r.project for r in deps.collect()] == ["b"] and [r.project for r in errors.collect()] == ["a"]


def detect(spark, names, service_map, mode):
    df = spark.createDataFrame([("p", n) for n in names], "project string, dep string")
    return sorted(r.service for r in services.detect_services(df, service_map, mode).collect())


@pytest.mark.parametrize("names,want", [
    (["stripe"], ["stripe"]),
    (["stripe", "openai", "@supabase/supabase-js"], ["openai", "stripe", "supabase"]),
    (["@aws-sdk/client-s3", "@aws-sdk/client-dynamodb"], ["aws"]),
    (["react", "next"], []), ([], []),
    (["@stripe/stripe-js"], ["stripe"]), (["stripe", "@stripe/stripe-js"], ["stripe"]),
])
def test_api_map(spark, names, want):
    assert detect(spark, names, rules.API_SERVICE_MAP, "substring_cs") == want


@pytest.mark.parametrize("names,want", [
    (["openai"], ["openai"]), (["stripe", "@anthropic-ai/sdk", "@sendgrid/mail"], ["anthropic", "sendgrid", "stripe"]),
    (["react", "next"], []), (["@aws-sdk/client-s3"], ["aws"]),
])
def test_cli_map(spark, names, want):
    assert detect(spark, names, rules.CLI_SERVICE_MAP, "substring_cs") == want


def test_modes(spark):
    assert detect(spark, ["upgrade-lib"], None, "substring_ci") == ["postgresql"]     # "pg" inside a name
    assert detect(spark, ["PyMySQL"], None, "substring_ci") == ["mysql"]
    assert detect(spark, ["Stripe"], rules.SHARED_SERVICE_MAP, "substring_cs") == []
    assert detect(spark, ["@aws-sdk/client-s3"], rules.EXACT_SERVICE_MAP, "exact") == ["aws"]
    assert detect(spark, ["@aws-sdk/client-sqs"], rules.EXACT_SERVICE_MAP, "exact") == []
    with pytest.raises(ValueError):
        detect(spark, ["x"], None, "fuzzy")


def test_scopes_and_names(spark):
    df = spark.createDataFrame([("stripe",), ("aws",), ("unknown-service",)], "service string")
    got = {r.service: r.scopes for r in services.recommended_scopes(df).collect()}
    assert got["unknown-service"] == ["read", "write"] and "s3:read" in got["aws"]
    names = [r.service for r in rules.supported_services(spark).collect()]
    assert len(names) == 30 and names == sorted(names)


def test_preview(spark):
    df = spark.createDataFrame([("p", f"d{i:02}") for i in range(15)], "project string, dep string")
    assert services.preview(df).first().preview == [f"d{i:02}" for i in range(10)]
