"""Rule and seed tables.

The values below are fixed: results depend on them being exactly these.  They are
plain Python constants so that operators can turn them into column expressions
(no join) and reports can turn them into constant-size DataFrames.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_type

# --------------------------------------------------------------------------
# enumerations
# --------------------------------------------------------------------------
ENVIRONMENTS = ["dev", "staging", "prod"]
REQUEST_ENVIRONMENTS = ["development", "staging", "production"]
FRAMEWORKS = ["SOC2", "GDPR", "HIPAA", "PCI_DSS"]
SECRET_ACTIONS = ["created", "retrieved", "rotated", "deleted", "validated"]
ROTATION_STATUSES = ["pending", "completed", "failed"]
TIERS = ["free", "pro", "team", "enterprise"]
ORGANIZATION_TIERS = ["team", "enterprise"]
ROLES = ["owner", "admin", "member", "viewer"]
AUTH_TYPES = ["bearer", "api_key", "oauth2"]
USAGE_EVENTS = ["secret_created", "secret_rotated", "api_call", "ai_request"]
BILLING_EVENTS = ["payment_succeeded", "payment_failed"]
LOG_LEVELS = {"DEBUG": 0, "INFO": 1, "WARN": 2, "ERROR": 3, "FATAL": 4}
DEFAULT_ROTATION_DAYS = 90
DEFAULT_GRACE_HOURS, MAX_GRACE_HOURS = 24, 168
API_KEY_PREFIX = "sf_"

# Environment and framework spellings that are read as the canonical ones.
ENVIRONMENT_ALIASES = {"development": "dev", "production": "prod"}
FRAMEWORK_ALIASES = {"PCI-DSS": "PCI_DSS"}


# --------------------------------------------------------------------------
# Secret patterns
# --------------------------------------------------------------------------
class SecretPattern(NamedTuple):
    """One leak rule; every match contains at least one of ``needles`` (none: always tried)."""

    type: str
    regex: str
    service: str | None
    needles: tuple[str, ...] = ()
    min_entropy: float | None = None


SECRET_PATTERNS = [
    SecretPattern("aws", r"AKIA[0-9A-Z]{16}", "aws", ("AKIA",)),
    SecretPattern("stripe", r"sk_live_[0-9a-zA-Z]{24,}", "stripe", ("sk_live_",)),
    SecretPattern("stripe_test", r"sk_test_[0-9a-zA-Z]{24,}", "stripe", ("sk_test_",)),
    SecretPattern("openai", r"sk-[a-zA-Z0-9]{48}", "openai", ("sk-",)),
    SecretPattern("anthropic", r"sk-ant-[a-zA-Z0-9-]{95}", "anthropic", ("sk-ant-",)),
    SecretPattern("github", r"ghp_[a-zA-Z0-9]{36}", "github", ("ghp_",)),
    SecretPattern(
        "generic_api_key",
        r"""['"]?[a-zA-Z0-9_-]*api[_-]?key['"]?\s*[:=]\s*['"][a-zA-Z0-9_-]{20,}['"]""",
        "unknown",
        ("apikey", "api_key", "api-key"),
    ),
    SecretPattern("jwt", r"eyJ[a-zA-Z0-9_-]*\.eyJ[a-zA-Z0-9_-]*\.[a-zA-Z0-9_-]*", None, ("eyJ",)),
]
SECRET_CONFIDENCE = 0.9
SKIPPED_FILES = [".env.example", ".env.template"]

# Prefix of a key value -> issuing service.
KEY_PREFIXES = {
    "stripe": "sk_",
    "openai": "sk-",
    "anthropic": "sk-ant-",
    "github": "ghp_",
    "aws": "AKIA",
    "supabase": "sbp_",
}


# --------------------------------------------------------------------------
# Dependency name -> service
# --------------------------------------------------------------------------
class ServiceRule(NamedTuple):
    service: str
    patterns: list[str]
    confidence: float = 1.0
    scopes: list[str] | None = None


SERVICE_RULES = [
    ServiceRule("stripe", ["stripe", "@stripe/"], 0.99, ["read", "write"]),
    ServiceRule("paypal", ["paypal", "@paypal/"], 0.99),
    ServiceRule("square", ["square"], 0.95),
    ServiceRule("openai", ["openai"], 0.99, ["api.read", "api.write"]),
    ServiceRule("anthropic", ["@anthropic-ai/sdk", "anthropic"], 0.99),
    ServiceRule("cohere", ["cohere-ai", "cohere"], 0.95),
    ServiceRule("huggingface", ["@huggingface/", "transformers"], 0.9),
    ServiceRule("aws", ["aws-sdk", "@aws-sdk/"], 0.99, ["s3:read", "s3:write", "lambda:invoke"]),
    ServiceRule("google-cloud", ["@google-cloud/", "googleapis"], 0.99),
    ServiceRule("azure", ["@azure/", "azure-"], 0.99),
    ServiceRule("mongodb", ["mongodb", "mongoose"], 0.99),
    ServiceRule("postgresql", ["pg", "postgres", "pg-promise", "psycopg2"], 0.95),
    ServiceRule("mysql", ["mysql", "mysql2", "PyMySQL"], 0.95),
    ServiceRule("redis", ["redis", "ioredis", "redis-py"], 0.95),
    ServiceRule("supabase", ["@supabase/"], 0.99),
    ServiceRule("twilio", ["twilio"], 0.99, ["messaging", "voice"]),
    ServiceRule("sendgrid", ["@sendgrid/", "sendgrid"], 0.99, ["mail.send"]),
    ServiceRule("mailgun", ["mailgun", "mailgun-js"], 0.95),
    ServiceRule("resend", ["resend"], 0.95),
    ServiceRule("auth0", ["auth0", "@auth0/"], 0.99),
    ServiceRule("clerk", ["@clerk/"], 0.99),
    ServiceRule("firebase", ["firebase", "@firebase/"], 0.95),
    ServiceRule("segment", ["@segment/"], 0.95),
    ServiceRule("mixpanel", ["mixpanel"], 0.95),
    ServiceRule("posthog", ["posthog-"], 0.95),
    ServiceRule("github", ["@octokit/", "github"], 0.9),
    ServiceRule("gitlab", ["@gitlab/"], 0.9),
    ServiceRule("shopify", ["@shopify/"], 0.95),
    ServiceRule("vercel", ["@vercel/"], 0.9),
    ServiceRule("cloudflare", ["@cloudflare/", "cloudflare"], 0.9),
]
DEFAULT_SCOPES = ["read", "write"]

# The three case-sensitive substring maps and the exact-name map.
SHARED_SERVICE_MAP = [
    ServiceRule("stripe", ["stripe", "@stripe/stripe-js"]),
    ServiceRule("openai", ["openai", "@openai/api"]),
    ServiceRule("anthropic", ["@anthropic-ai/sdk"]),
    ServiceRule("aws", ["aws-sdk", "@aws-sdk"]),
    ServiceRule("supabase", ["@supabase/supabase-js"]),
    ServiceRule("sendgrid", ["@sendgrid/mail"]),
    ServiceRule("twilio", ["twilio"]),
    ServiceRule("github", ["@octokit/rest", "octokit"]),
    ServiceRule("google", ["googleapis", "@google-cloud"]),
    ServiceRule("azure", ["@azure/identity", "@azure/keyvault-secrets"]),
    ServiceRule("mongodb", ["mongodb"]),
    ServiceRule("redis", ["redis", "ioredis"]),
    ServiceRule("postgres", ["pg", "postgres"]),
]
API_SERVICE_MAP = [
    ServiceRule("stripe", ["stripe", "@stripe/stripe-js"]),
    ServiceRule("openai", ["openai"]),
    ServiceRule("aws", ["aws-sdk", "@aws-sdk"]),
    ServiceRule("supabase", ["@supabase/supabase-js"]),
    ServiceRule("anthropic", ["@anthropic-ai/sdk"]),
    ServiceRule("sendgrid", ["@sendgrid/mail"]),
    ServiceRule("twilio", ["twilio"]),
    ServiceRule("mongodb", ["mongodb", "mongoose"]),
    ServiceRule("postgresql", ["pg", "postgres"]),
    ServiceRule("redis", ["redis", "ioredis"]),
]
CLI_SERVICE_MAP = [
    ServiceRule("stripe", ["stripe", "@stripe/stripe-js"]),
    ServiceRule("openai", ["openai"]),
    ServiceRule("anthropic", ["@anthropic-ai/sdk"]),
    ServiceRule("supabase", ["@supabase/supabase-js"]),
    ServiceRule("aws", ["aws-sdk", "@aws-sdk"]),
    ServiceRule("sendgrid", ["@sendgrid/mail"]),
]
EXACT_SERVICE_MAP = [
    ServiceRule("stripe", ["stripe", "@stripe/stripe-js"]),
    ServiceRule("openai", ["openai", "@openai/api"]),
    ServiceRule("aws", ["aws-sdk", "@aws-sdk/client-s3"]),
    ServiceRule("supabase", ["@supabase/supabase-js"]),
    ServiceRule("anthropic", ["@anthropic-ai/sdk"]),
]

# --------------------------------------------------------------------------
# API endpoint -> required scope
# --------------------------------------------------------------------------
ENDPOINT_SCOPES = {
    "stripe": {
        "customers.create": "customers:write",
        "customers.retrieve": "customers:read",
        "customers.list": "customers:read",
        "customers.update": "customers:write",
        "customers.delete": "customers:write",
        "charges.create": "charges:write",
        "charges.retrieve": "charges:read",
        "charges.list": "charges:read",
        "paymentIntents.create": "payment_intents:write",
        "paymentIntents.retrieve": "payment_intents:read",
        "paymentIntents.confirm": "payment_intents:write",
        "subscriptions.create": "subscriptions:write",
        "subscriptions.retrieve": "subscriptions:read",
        "subscriptions.list": "subscriptions:read",
        "subscriptions.update": "subscriptions:write",
        "subscriptions.cancel": "subscriptions:write",
    },
    "aws": {
        "s3.putObject": "s3:PutObject",
        "s3.getObject": "s3:GetObject",
        "s3.listObjects": "s3:ListBucket",
        "s3.deleteObject": "s3:DeleteObject",
        "lambda.invoke": "lambda:InvokeFunction",
        "lambda.createFunction": "lambda:CreateFunction",
        "dynamodb.putItem": "dynamodb:PutItem",
        "dynamodb.getItem": "dynamodb:GetItem",
        "dynamodb.scan": "dynamodb:Scan",
        "dynamodb.query": "dynamodb:Query",
        "sns.publish": "sns:Publish",
        "sqs.sendMessage": "sqs:SendMessage",
    },
    "openai": {
        "chat.completions.create": "chat.completions:write",
        "embeddings.create": "embeddings:write",
        "images.generate": "images:write",
        "audio.transcriptions.create": "audio:write",
        "files.create": "files:write",
        "files.retrieve": "files:read",
        "fine_tuning.jobs.create": "fine_tuning:write",
    },
    "twilio": {
        "messages.create": "messages:write",
        "messages.list": "messages:read",
        "calls.create": "calls:write",
        "calls.list": "calls:read",
        "verify.services.create": "verify:write",
    },
    "sendgrid": {
        "send": "mail:send",
        "templates.create": "templates:write",
        "templates.list": "templates:read",
        "lists.create": "marketing:write",
    },
}


# --------------------------------------------------------------------------
# Call patterns per language
# --------------------------------------------------------------------------
class CallRule(NamedTuple):
    """Calls written as ``text`` followed by one of ``methods``.

    Without methods the text is the whole call and its method is ``default``; the
    ``fixed`` endpoint replaces ``prefix.default`` when corrected results are asked for.
    """

    lang: str
    service: str
    prefix: str
    text: str
    methods: list[str] = []
    default: str = "unknown"
    fixed: str | None = None

    @property
    def regex(self) -> str:
        choice = f"({'|'.join(self.methods)})" if self.methods else ""
        return self.text.replace(".", "\\.") + choice


CALL_RULES = [
    CallRule("js", "stripe", "customers", "stripe.customers.", ["create", "retrieve", "list", "update", "del"]),
    CallRule("js", "stripe", "charges", "stripe.charges.", ["create", "retrieve", "list"]),
    CallRule("js", "stripe", "paymentIntents", "stripe.paymentIntents.", ["create", "retrieve", "confirm", "cancel"]),
    CallRule("js", "stripe", "subscriptions", "stripe.subscriptions.", ["create", "retrieve", "list", "update", "cancel"]),
    CallRule("js", "openai", "chat.completions", "openai.chat.completions.create", fixed="chat.completions.create"),
    CallRule("js", "openai", "embeddings", "openai.embeddings.create", fixed="embeddings.create"),
    CallRule("js", "openai", "images", "openai.images.generate", fixed="images.generate"),
    CallRule("js", "aws", "s3", "s3.", ["putObject", "getObject", "listObjects", "deleteObject"]),
    CallRule("js", "aws", "lambda", "lambda.invoke", fixed="lambda.invoke"),
    CallRule("js", "aws", "dynamodb", "dynamodb.", ["putItem", "getItem", "scan", "query"]),
    CallRule("js", "twilio", "messages", "twilio.messages.", ["create", "list"]),
    CallRule("js", "twilio", "calls", "twilio.calls.", ["create", "list"]),
    CallRule("js", "sendgrid", "send", "sgMail.send", fixed="send"),
    CallRule("js", "sendgrid", "templates", "sgMail.templates.", ["create", "list"]),
    CallRule("py", "stripe", "customers", "stripe.Customer.", ["create", "retrieve", "list", "update", "delete"]),
    CallRule("py", "stripe", "charges", "stripe.Charge.", ["create", "retrieve", "list"]),
    CallRule("py", "stripe", "subscriptions", "stripe.Subscription.", ["create", "retrieve", "list", "update", "cancel"]),
    CallRule("py", "openai", "chat.completions", "client.chat.completions.create", default="create"),
    CallRule("py", "openai", "embeddings", "client.embeddings.create", default="create"),
    CallRule("py", "openai", "images", "client.images.generate", default="create", fixed="images.generate"),
    CallRule("go", "stripe", "customers", "customer.", ["New", "Get", "List", "Update", "Del"]),
    CallRule("go", "stripe", "charges", "charge.", ["New", "Get", "List"]),
    CallRule("go", "aws", "s3", "s3Client.", ["PutObject", "GetObject", "ListObjects", "DeleteObject"]),
    CallRule("go", "aws", "lambda", "lambdaClient.Invoke", fixed="lambda.invoke"),
]
LANG_OF_EXT = {"js": "js", "ts": "js", "jsx": "js", "tsx": "js", "py": "py", "go": "go"}
LINE_COMMENTS = {"js": ["//", "*"], "py": ["#"], "go": ["//"]}

# Method names used when corrected results are asked for (ours, not fixed values).
METHOD_FIXES = {
    "js": {"del": "delete"},
    "go": {
        "New": "create", "Get": "retrieve", "List": "list", "Update": "update", "Del": "delete",
        "PutObject": "putObject", "GetObject": "getObject",
        "ListObjects": "listObjects", "DeleteObject": "deleteObject",
    },
}


# --------------------------------------------------------------------------
# Plans, tier limits, service seeds
# --------------------------------------------------------------------------
class Plan(NamedTuple):
    """Limits of -1 mean unlimited."""

    key: str
    tier: str
    price_id: str
    name: str
    price: int
    interval: str
    secrets: int
    rotations: int
    api_calls: int
    team_members: int
    features: list[str]


_PRO = ["Unlimited secrets", "AI-powered recommendations", "Automated rotation",
        "Priority email support", "Compliance reports"]
_TEAM = ["Everything in Pro", "Up to 10 team members", "Shared vaults", "Audit logs",
         "Role-based access control", "Slack integration"]
_YEARLY = ["2 months free"]
PLANS = [
    Plan("free", "free", "", "Free", 0, "month", 10, 10, 100, 1,
         ["10 secrets", "Basic encryption", "Community support", "Email notifications"]),
    Plan("pro_monthly", "pro", "price_pro_monthly", "Pro (Monthly)", 9, "month", -1, -1, 10000, 1, _PRO),
    Plan("pro_yearly", "pro", "price_pro_yearly", "Pro (Yearly)", 90, "year", -1, -1, 10000, 1, _PRO + _YEARLY),
    Plan("team_monthly", "team", "price_team_monthly", "Team (Monthly)", 49, "month", -1, -1, 100000, 10, _TEAM),
    Plan("team_yearly", "team", "price_team_yearly", "Team (Yearly)", 490, "year", -1, -1, 100000, 10, _TEAM + _YEARLY),
]
TIER_REQUESTS_PER_MINUTE = {"free": 10, "pro": 100, "team": 500, "enterprise": 5000}
TIER_SECRET_LIMIT = {"free": 10, "pro": -1, "team": -1, "enterprise": -1}
DEFAULT_SECRET_LIMIT = 10

# service, provider, base URL, auth type, default scopes, documentation
SERVICE_CONFIGS = [
    ("stripe", "Stripe", "https://api.stripe.com", "bearer", ["read_write"], "https://stripe.com/docs/api"),
    ("openai", "OpenAI", "https://api.openai.com/v1", "bearer", ["api.read", "api.write"], "https://platform.openai.com/docs"),
    ("anthropic", "Anthropic", "https://api.anthropic.com", "api_key", ["messages.read", "messages.write"], "https://docs.anthropic.com"),
    ("aws", "Amazon Web Services", "https://aws.amazon.com", "api_key", ["s3:read", "s3:write"], "https://docs.aws.amazon.com"),
    ("supabase", "Supabase", "https://supabase.com", "bearer", ["full_access"], "https://supabase.com/docs"),
    ("sendgrid", "SendGrid", "https://api.sendgrid.com", "bearer", ["mail.send"], "https://docs.sendgrid.com"),
    ("twilio", "Twilio", "https://api.twilio.com", "api_key", ["messaging"], "https://www.twilio.com/docs"),
]

# --------------------------------------------------------------------------
# Intent words, status names
# --------------------------------------------------------------------------
INTENT_WORDS = [
    ("provision_secret", ["provision", "create", "new secret", "add key"]),
    ("rotate_secret", ["rotate", "refresh", "renew"]),
    ("list_secrets", ["list", "show", "get all", "what secrets"]),
    ("analyze_project", ["analyze", "scan", "detect"]),
    ("check_compliance", ["compliance", "soc2", "gdpr"]),
    ("help", ["help", "how to", "what can"]),
]
INTENT_SERVICES = ["stripe", "openai", "aws", "anthropic", "twilio", "sendgrid", "supabase",
                   "mongodb", "postgresql", "redis"]
INTENT_ENVIRONMENTS = [
    ("production", ["prod", "production"]),
    ("staging", ["staging", "stage"]),
    ("development", ["dev", "development"]),
]
INTENT_FRAMEWORKS = [
    ("SOC2", ["soc2", "soc 2"]),
    ("GDPR", ["gdpr"]),
    ("HIPAA", ["hipaa"]),
    ("PCI-DSS", ["pci", "pci-dss"]),
]
HTTP_CODE_NAMES = {
    400: "BAD_REQUEST",
    401: "UNAUTHORIZED",
    403: "FORBIDDEN",
    404: "NOT_FOUND",
    409: "CONFLICT",
    429: "RATE_LIMIT_EXCEEDED",
    500: "INTERNAL_SERVER_ERROR",
    503: "SERVICE_UNAVAILABLE",
}


# --------------------------------------------------------------------------
# The same tables as constant-size DataFrames
# --------------------------------------------------------------------------
def _local(spark: SparkSession, rows, ddl: str) -> DataFrame:
    """Rows held in the plan itself, so the optimizer knows how few they are."""
    schema = T._parse_datatype_string(ddl)
    values = list(zip(*rows)) or [()] * len(schema)
    columns = [pa.array(list(c), type=to_arrow_type(f.dataType)) for c, f in zip(values, schema.fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=schema.names), schema)


def plans_df(spark: SparkSession) -> DataFrame:
    return _local(
        spark, PLANS,
        "key string, tier string, price_id string, name string, price int, interval string, "
        "secrets int, rotations int, api_calls int, team_members int, features array<string>",
    )


def tiers_df(spark: SparkSession) -> DataFrame:
    rows = [(t, TIER_REQUESTS_PER_MINUTE[t], TIER_SECRET_LIMIT[t]) for t in TIERS]
    return _local(spark, rows, "tier string, requests_per_minute int, secret_limit int")


def service_configs_df(spark: SparkSession) -> DataFrame:
    return _local(
        spark, SERVICE_CONFIGS,
        "service string, provider_name string, api_base_url string, auth_type string, "
        "default_scopes array<string>, documentation_url string",
    )


def secret_patterns_df(spark: SparkSession) -> DataFrame:
    return _local(
        spark, [(p.type, p.regex, p.service) for p in SECRET_PATTERNS],
        "type string, regex string, service string",
    )


def service_rules_df(spark: SparkSession, rules: list[ServiceRule] | None = None) -> DataFrame:
    """One row per (service, pattern)."""
    rows = [(r.service, p, r.confidence) for r in rules or SERVICE_RULES for p in r.patterns]
    return _local(spark, rows, "service string, pattern string, confidence double")


def endpoint_scopes_df(spark: SparkSession) -> DataFrame:
    rows = [(s, e, sc) for s, m in ENDPOINT_SCOPES.items() for e, sc in m.items()]
    return _local(spark, rows, "service string, endpoint string, scope string")


def service_scopes_df(spark: SparkSession) -> DataFrame:
    """Every scope a service has, once."""
    rows = [(s, sc) for s, m in ENDPOINT_SCOPES.items() for sc in dict.fromkeys(m.values())]
    return _local(spark, rows, "service string, scope string")


def call_texts_df(spark: SparkSession, services: list[str] | None = None, compat: bool = True) -> DataFrame:
    """Every text the call rules match, with the service, method and endpoint it means."""
    rows = []
    for r in CALL_RULES:
        if services is not None and r.service not in services:
            continue
        for m in r.methods:
            method = m if compat else METHOD_FIXES.get(r.lang, {}).get(m, m)
            rows.append((r.lang, r.text + m, r.service, method, f"{r.prefix}.{method}"))
        if not r.methods:
            endpoint = f"{r.prefix}.{r.default}" if compat or not r.fixed else r.fixed
            method = r.default if compat or not r.fixed else r.fixed.split(".")[-1]
            rows.append((r.lang, r.text, r.service, method, endpoint))
    return _local(spark, rows, "lang string, text string, service string, method string, endpoint string")


def supported_services(spark: SparkSession) -> DataFrame:
    return _local(spark, [(r.service,) for r in SERVICE_RULES], "service string").orderBy("service")
