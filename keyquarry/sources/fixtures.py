"""The metadata model projected from the supplied tables.

Each text is valid in Spark SQL and in the SQL of the checks, so both sides of a check
read the same rows of the same tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL: dict[str, str] = {
    "code_lines": """
SELECT concat('src/f', CAST(p_partkey % 40 AS VARCHAR(9)), CASE WHEN p_partkey % 40 = 7 THEN '.env.example' WHEN p_partkey % 3 = 0 THEN '.ts' WHEN p_partkey % 3 = 1 THEN '.py' ELSE '.go' END) AS file,
 p_partkey AS line_no,
 CASE CAST(p_partkey % 13 AS INT)
  WHEN 0 THEN concat('const k = "AKIA', upper(substr(md5(p_name), 1, 16)), '";')
  WHEN 1 THEN concat('key: sk_live_', md5(p_name))
  WHEN 2 THEN concat('// sk_test_', md5(p_name))
  WHEN 3 THEN concat('x = sk_test_', md5(p_name))
  WHEN 4 THEN concat('o = sk-', md5(p_name), substr(md5(p_brand), 1, 16))
  WHEN 5 THEN concat('a = sk-ant-', substr(concat(md5(p_name), md5(p_brand), md5(p_type)), 1, 95))
  WHEN 6 THEN concat('g = ghp_', md5(p_name), substr(md5(p_brand), 1, 4))
  WHEN 7 THEN concat('my_api_key = "', md5(p_name), '"')
  WHEN 8 THEN concat('t = eyJ', md5(p_name), '.eyJ', md5(p_brand), '.', md5(p_type))
  WHEN 9 THEN 'c = stripe.customers.create(x); d = stripe.charges.list()'
  WHEN 10 THEN 'r = stripe.Customer.retrieve(i)'
  WHEN 11 THEN 's3.putObject(p); s3.getObject(q)'
  ELSE '' END AS line FROM part""",
    "call_lines": """
SELECT concat('repo', CAST(p_partkey % 25 AS VARCHAR(9))) AS repo,
 concat('src/m', CAST(p_partkey % 60 AS VARCHAR(9)), CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.go' WHEN 3 THEN '.jsx' ELSE '.md' END) AS file,
 p_partkey AS line_no,
 CASE CAST(p_partkey % 16 AS INT)
  WHEN 0 THEN 'c = stripe.customers.create(x); d = stripe.charges.list(); stripe.customers.create(y)'
  WHEN 1 THEN 'r = stripe.Customer.retrieve(i)'
  WHEN 2 THEN 's3.putObject(p); s3.getObject(q)'
  WHEN 3 THEN '  // stripe.charges.create(a)'
  WHEN 4 THEN 'await openai.chat.completions.create(m)'
  WHEN 5 THEN 'client.chat.completions.create(model=m)'
  WHEN 6 THEN 'customer.New(p); s3Client.PutObject(ctx, i); lambdaClient.Invoke(x)'
  WHEN 7 THEN '# stripe.Charge.create(a)'
  WHEN 8 THEN 'stripe.customers.del(x); stripe.paymentIntents.cancel(y)'
  WHEN 9 THEN 'dynamodb.query(q); twilio.messages.list(); sgMail.send(m); sgMail.templates.list()'
  WHEN 10 THEN 'client.images.generate(p); client.embeddings.create(e)'
  WHEN 11 THEN 'x = stripe.Subscription.cancel(s); stripe.Charge.list()'
  WHEN 12 THEN '* stripe.customers.list()'
  WHEN 13 THEN 'stripe.paymentIntents.confirm(i); stripe.subscriptions.update(s)'
  WHEN 14 THEN p_name
  ELSE '' END AS line FROM part""",
    "users": """
SELECT CAST(c_custkey AS VARCHAR(20)) AS id, concat('u', CAST(c_custkey AS VARCHAR(20)), '@example.com') AS email,
 CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'free' WHEN 1 THEN 'pro' WHEN 2 THEN 'team' ELSE 'enterprise' END AS tier,
 concat('cus_', CAST(c_custkey AS VARCHAR(20))) AS stripe_customer_id FROM customer""",
    "secrets": """
SELECT CAST(o_orderkey AS VARCHAR(20)) AS id, CAST(o_custkey AS VARCHAR(20)) AS user_id,
 CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'stripe' WHEN 1 THEN 'openai' WHEN 2 THEN 'aws' WHEN 3 THEN 'twilio' ELSE 'redis' END AS service,
 CASE o_orderstatus WHEN 'F' THEN 'dev' WHEN 'O' THEN 'staging' ELSE 'prod' END AS environment,
 o_orderdate AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + INTERVAL 30 DAY END AS last_rotated_at,
 CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1 END AS is_active FROM orders""",
    "vault": """
SELECT CAST(o_orderkey AS VARCHAR(20)) AS id, concat('KEY_', CAST(o_orderkey AS VARCHAR(20))) AS name,
 concat('p', CAST(o_custkey % 20 AS VARCHAR(9))) AS project,
 CASE o_orderstatus WHEN 'F' THEN 'dev' WHEN 'O' THEN 'staging' ELSE 'prod' END AS environment,
 CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN '["api"]' WHEN 1 THEN '["api","critical"]' WHEN 2 THEN '["database","criticality"]' ELSE '[]' END AS tags,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE md5(CAST(o_orderkey AS VARCHAR(20))) END AS value_encrypted,
 o_orderdate AS created_at, o_orderdate + INTERVAL 1 DAY AS updated_at FROM orders""",
    "vault_changes": """
SELECT concat('c', CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(9)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20))) AS id,
 concat('KEY_', CAST(o_orderkey + CASE WHEN l_linenumber = 1 THEN 0 ELSE 1000000 * l_linenumber END AS VARCHAR(20))) AS name,
 concat('p', CAST(o_custkey % 20 AS VARCHAR(9))) AS project,
 CASE o_orderstatus WHEN 'F' THEN 'dev' WHEN 'O' THEN 'staging' ELSE 'prod' END AS environment,
 md5(concat(CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(9)))) AS value_encrypted, l_shipdate AS changed_at
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "rotations": """
SELECT DISTINCT concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(9)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20))) AS request_id,
 CAST(l_orderkey + CASE WHEN l_partkey % 9 = 0 THEN 100000000 ELSE 0 END AS VARCHAR(20)) AS secret_id,
 CAST(CASE WHEN l_suppkey % 4 = 0 THEN l_suppkey ELSE o_custkey END AS VARCHAR(20)) AS user_id, l_shipdate AS asked_at,
 md5(concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(9)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20)))) AS value_hash,
 CASE CAST(l_partkey % 6 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 24 WHEN 3 THEN 168 WHEN 4 THEN 100 ELSE 169 END AS grace_hours,
 concat('10.0.', CAST(l_suppkey % 256 AS VARCHAR(9)), '.', CAST(l_linenumber AS VARCHAR(9))) AS ip_address,
 CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE concat('agent/', CAST(l_linenumber AS VARCHAR(9))) END AS user_agent
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "first_versions": """
SELECT CAST(o_orderkey AS VARCHAR(20)) AS secret_id, 1 AS version, o_orderdate AS valid_from, md5(CAST(o_orderkey AS VARCHAR(20))) AS value_hash FROM orders""",
    "value_uses": """
SELECT DISTINCT concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(9)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20))) AS use_id, CAST(l_orderkey AS VARCHAR(20)) AS secret_id,
 CASE WHEN l_suppkey % 3 = 0 THEN md5(CAST(l_orderkey AS VARCHAR(20))) ELSE md5(concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(9)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20)))) END AS value_hash,
 l_shipdate + l_linenumber * INTERVAL '30' HOUR AS ts FROM lineitem""",
    "audit_logs": """
SELECT event_id AS id, CAST(event_id % 997 AS VARCHAR(20)) AS secret_id, CAST(user_id AS VARCHAR(20)) AS user_id,
 CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'retrieved' WHEN 'purchase' THEN 'rotated' WHEN 'error' THEN 'deleted' ELSE 'validated' END AS action, ts AS timestamp FROM events""",
    "usage_events": """
SELECT event_id AS id, CAST(user_id AS VARCHAR(20)) AS user_id,
 CASE event_type WHEN 'signup' THEN 'secret_created' WHEN 'purchase' THEN 'secret_rotated' WHEN 'error' THEN 'ai_request' ELSE 'api_call' END AS event_type, ts AS timestamp FROM events""",
    "op_timings": "SELECT event_type AS operation, value * 100 AS duration_ms, ts, event_id FROM events",
    "metrics": """
SELECT event_type AS name, CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'counter' WHEN 1 THEN 'gauge' ELSE 'histogram' END AS kind,
 CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS value, ts, event_id AS id FROM events""",
    "dep_names": """
SELECT CAST(p_partkey % 200 AS VARCHAR(9)) AS project,
 CASE CAST(p_partkey % 11 AS INT) WHEN 0 THEN 'stripe' WHEN 1 THEN '@stripe/stripe-js' WHEN 2 THEN '@aws-sdk/client-s3' WHEN 3 THEN 'psycopg2-binary' WHEN 4 THEN 'github.com/redis/go-redis' WHEN 5 THEN 'upgrade-lib' WHEN 6 THEN 'PyMySQL' WHEN 7 THEN 'react' WHEN 8 THEN '@sendgrid/mail' WHEN 9 THEN 'openai' ELSE 'next' END AS dep FROM part""",
    "manifests": """
SELECT CAST(p_partkey AS VARCHAR(9)) AS project,
 CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'package.json' WHEN 1 THEN 'requirements.txt' WHEN 2 THEN 'go.mod' WHEN 3 THEN 'Gemfile' WHEN 4 THEN 'composer.json' ELSE 'Cargo.toml' END AS file,
 CASE CAST(p_partkey % 6 AS INT)
  WHEN 0 THEN concat('{"packageManager":"pnpm@8","dependencies":{"stripe":"^12.0.', CAST(p_size AS VARCHAR(9)), '","react":"18"},"devDependencies":{"@sendgrid/mail":"^7","stripe":"dev"}}')
  WHEN 1 THEN concat('# c', chr(10), 'stripe==5.0.', CAST(p_size AS VARCHAR(9)), chr(10), 'openai>=1.0.0', chr(10), 'psycopg2-binary', chr(10), 'redis~=4.0.0')
  WHEN 2 THEN concat('module m', chr(10), 'go 1.20', chr(10), 'require (', chr(10), '  github.com/stripe/stripe-go v74.0.', CAST(p_size AS VARCHAR(9)), chr(10), ')', chr(10), 'require github.com/redis/go-redis v9.0.0')
  WHEN 3 THEN concat('source "x"', chr(10), 'gem "stripe", "~> 8.0"', chr(10), '# gem "no"', chr(10), 'gem "pg"')
  WHEN 4 THEN '{"require":{"stripe/stripe-php":"^10.0"},"require-dev":{"mongodb/mongodb":"^1.0"}}'
  ELSE concat('[package]', chr(10), 'name = "m"', chr(10), '[dependencies]', chr(10), 'redis = "0.23.0"', chr(10), 'serde = { version = "1" }', chr(10), '[dev-dependencies]', chr(10), 'tokio = "1.0"') END AS content FROM part""",
    "requests": """
SELECT event_id AS request_id, ts, CAST(user_id AS VARCHAR(20)) AS user_id,
 CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 'free' WHEN 1 THEN 'pro' WHEN 2 THEN 'team' ELSE 'enterprise' END AS tier,
 concat('/api/', event_type) AS path, CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status FROM events""",
    "keyed_requests": """
SELECT event_id AS request_id, ts, CASE CAST(event_id % 9 AS INT) WHEN 7 THEN NULL WHEN 8 THEN concat('xx_', CAST(user_id AS VARCHAR(20))) ELSE concat('sf_', CAST(user_id AS VARCHAR(20))) END AS api_key FROM events""",
    "request_log": "SELECT event_id AS request_id, ts, event_type AS method FROM events",
    "response_log": """
SELECT event_id AS request_id, ts + INTERVAL 2 SECOND AS ts, CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status FROM events WHERE event_id % 10 <> 0""",
    "api_keys": """
SELECT CAST(c_custkey AS VARCHAR(20)) AS id, CAST(c_custkey AS VARCHAR(20)) AS user_id, sha256(concat('sf_', CAST(c_custkey AS VARCHAR(20)))) AS key_hash_hex,
 CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS revoked, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-15 00:00:00' END AS expires_at FROM customer""",
    "ending_keys": """
SELECT CAST(c_custkey AS VARCHAR(20)) AS id, CAST(c_custkey AS VARCHAR(20)) AS user_id, sha256(concat('sf_', CAST(c_custkey AS VARCHAR(20)))) AS key_hash_hex,
 CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS revoked, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-02 00:00:00' + CAST(c_custkey % 28 AS INT) * INTERVAL '24' HOUR END AS expires_at FROM customer""",
    "billing_events": """
SELECT o_orderkey AS event_id, concat('cus_', CAST(o_custkey AS VARCHAR(20))) AS customer, o_orderdate AS ts,
 CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'customer.subscription.updated' WHEN 1 THEN 'customer.subscription.deleted' WHEN 2 THEN 'invoice.payment_succeeded' ELSE 'invoice.payment_failed' END AS type,
 CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'price_pro_monthly' WHEN 1 THEN 'price_team_yearly' ELSE 'price_x' END AS price_id, CAST(floor(o_totalprice) AS BIGINT) AS amount_paid FROM orders""",
    "messages": """
SELECT conv_id, turn, CASE CAST((conv_id + turn) % 7 AS INT) WHEN 0 THEN 'Create a stripe key for prod' WHEN 1 THEN 'rotate 123e4567-e89b-12d3-a456-426614174000' WHEN 2 THEN 'show staging secrets' WHEN 3 THEN 'scan my repo' WHEN 4 THEN 'are we SOC 2 ok under gdpr' WHEN 5 THEN '?' ELSE text END AS text FROM conversations""",
    "validations": """
SELECT event_id AS id, CAST(event_id % 997 AS VARCHAR(20)) AS secret_id,
 CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 'SOC2' WHEN 1 THEN 'GDPR' WHEN 2 THEN 'HIPAA' ELSE 'PCI_DSS' END AS framework,
 CASE WHEN value > 5 THEN 1 ELSE 0 END AS is_compliant, ts AS validated_at FROM events""",
    "schedules": """
SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR(20)) AS secret_id, o_orderdate + INTERVAL 90 DAY AS scheduled_for,
 CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'pending' WHEN 1 THEN 'completed' ELSE 'failed' END AS status FROM orders""",
    "env_lines": """
SELECT CAST(p_partkey % 50 AS VARCHAR(9)) AS project, p_partkey AS line_no,
 CASE CAST(p_partkey % 8 AS INT) WHEN 6 THEN concat('# ', p_name) WHEN 7 THEN '  ' ELSE concat(' KEY_', CAST(p_partkey % 7 AS VARCHAR(9)), '=', p_name, '=', p_brand, ' ') END AS line FROM part""",
    "env_overrides": """
SELECT CAST(p_partkey % 50 AS VARCHAR(9)) AS project, p_partkey AS position,
 concat('KEY_', CAST(p_partkey % 9 AS VARCHAR(9))) AS name, p_type AS value FROM part""",
}

def _narrow(text: str, rows: str, columns: str, of_orders: dict[str, str]) -> str:
    """A fixture that makes rows of ``columns`` distinct, so that numbers are compared instead of the texts made of them.

    Where none of the four numbers of ``request_id`` is null, a text stands for one row of numbers; other rows are made distinct as they are.
    """
    whole = "l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL AND l_partkey IS NOT NULL AND l_suppkey IS NOT NULL"
    plain = text.strip().replace("SELECT DISTINCT", "SELECT", 1).removesuffix(f"FROM {rows}").rstrip()
    made = plain
    for given, name in of_orders.items():
        made = made.replace(given, name)
    return (f"{made} FROM (SELECT DISTINCT {columns} FROM {rows} WHERE {whole}) UNION ALL "
            f"SELECT * FROM (SELECT DISTINCT{plain.removeprefix('SELECT')} FROM {rows} WHERE NOT ({whole}))")


_ASKER = "CASE WHEN l_suppkey % 4 = 0 THEN l_suppkey ELSE o_custkey END"
#: Forms for Spark of fixtures that give the same rows with less to shuffle.
SPARK_SQL = {
    "rotations": _narrow(SQL["rotations"], "lineitem JOIN orders ON l_orderkey = o_orderkey",
                         f"l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, {_ASKER} AS asker", {_ASKER: "asker"}),
    "value_uses": _narrow(SQL["value_uses"], "lineitem", "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate", {}),
}

_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
           "pages benchmark labels conversations").split()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def frame(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Fixture ``name`` (or a supplied table) as a DataFrame."""
    if name in _TABLES:
        return table(spark, sf, name)
    return sql(spark, sf, SPARK_SQL.get(name, SQL[name]))


def sql(spark: SparkSession, sf: str, text: str) -> DataFrame:
    """Run a text over the supplied tables it names."""
    for t in _TABLES:
        if re.search(rf"\b{t}\b", text):
            table(spark, sf, t).createOrReplaceTempView(t)
    text = re.sub(r"sha256\((.*)\) AS", r"sha2(\1, 256) AS", text)
    return spark.sql(text.replace(" TIMESTAMP '", " TIMESTAMP_NTZ '"))


def cte(*names: str, extra: str = "") -> str:
    """``WITH`` clause that defines fixtures for a check query."""
    parts = [f"{n} AS ({SQL[n].strip()})" for n in names]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n"
