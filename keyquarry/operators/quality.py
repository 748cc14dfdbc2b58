"""Data contracts of request payloads and constraints of the metadata tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from keyquarry import rules
from keyquarry.schemas import TABLES

_UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
_MAIL = r"^[A-Za-z0-9_'+\-.]*[A-Za-z0-9_+-]@([A-Za-z0-9][A-Za-z0-9\-]*\.)+[A-Za-z]{2,}$"
_URL = r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"
_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"
_IP = r"^(\d{1,3}(\.\d{1,3}){3}|[0-9a-fA-F:]*:[0-9a-fA-F:.]*)$"


@dataclass(frozen=True)
class Rule:
    """One field of a payload and what must hold for it."""

    name: str
    type: str = "string"
    optional: bool = False
    default: object = None
    enum: tuple[str, ...] = ()
    form: str | None = None          # email, uuid, url, datetime, ip
    patterns: tuple[str, ...] = ()
    min_length: int | None = None
    max_length: int | None = None
    minimum: float | None = None
    maximum: float | None = None
    positive: bool = False
    min_items: int | None = None
    max_items: int | None = None
    items: tuple["Rule", ...] = ()   # fields of each array element
    fields: tuple["Rule", ...] = ()  # members of a nested object
    any_values: bool = False         # a record of anything, not of texts only


def _texts(name, **kw):
    return Rule(name, "array<string>", optional=True, **kw)


def _env(name="environment", **kw):
    return Rule(name, enum=tuple(rules.REQUEST_ENVIRONMENTS), **kw)


_HOURS = dict(type="double", minimum=0, maximum=168)
_API_FRAMEWORKS = ("SOC2", "GDPR", "HIPAA", "PCI-DSS")
_CREATE_SECRET = (
    Rule("service", min_length=1),
    _env(default="development"),
    _texts("scopes", default=[]),
    Rule("value", optional=True),
    Rule("metadata", "map<string,string>", optional=True, any_values=True),
)

# The request contracts.
CONTRACTS: dict[str, tuple[Rule, ...]] = {
    "create_user": (
        Rule("email", form="email"),
        Rule("password", min_length=8, patterns=("[A-Z]", "[a-z]", "[0-9]")),
        Rule("tier", enum=tuple(rules.TIERS), default="free"),
    ),
    "login": (Rule("email", form="email"), Rule("password", min_length=1)),
    "create_secret": _CREATE_SECRET,
    "update_secret": (
        _texts("scopes"), _env(optional=True), Rule("metadata", "map<string,string>", optional=True, any_values=True),
    ),
    "rotate_secret": (
        Rule("gracePeriodHours", optional=True, **_HOURS),
        _texts("notifyChannels", enum=("email", "slack", "webhook")),
    ),
    "analyze_project": (
        Rule("projectPath", optional=True),
        Rule("dependencies", "map<string,string>", optional=True),
        Rule("packageManager", optional=True, enum=("npm", "yarn", "pnpm", "pip", "go", "bundler", "composer")),
        Rule("language", optional=True, enum=("javascript", "typescript", "python", "go", "ruby", "php")),
    ),
    "validate_compliance": (
        Rule("framework", enum=_API_FRAMEWORKS, default="SOC2"),
        Rule("includeRecommendations", "boolean", default=True),
    ),
    "create_api_key": (
        Rule("name", min_length=1),
        _texts("scopes", default=["read", "write"]),
        Rule("expiresIn", "double", optional=True, positive=True),
    ),
    "revoke_api_key": (Rule("keyId", form="uuid"),),
    "create_organization": (
        Rule("name", min_length=1), Rule("tier", enum=tuple(rules.ORGANIZATION_TIERS), default="team"),
    ),
    "invite_member": (Rule("email", form="email"), Rule("role", enum=tuple(rules.ROLES), default="member")),
    "chat_message": (
        Rule("message", min_length=1, max_length=2000),
        Rule("context", "struct<projectPath:string,currentSecrets:array<string>,recentActivity:array<string>>", optional=True, fields=(
            Rule("projectPath", optional=True), _texts("currentSecrets"), Rule("recentActivity", "array<string>", optional=True, any_values=True))),
    ),
    "create_webhook": (
        Rule("url", form="url"),
        Rule("events", "array<string>", enum=(
            "secret.created", "secret.rotated", "secret.deleted", "secret.accessed",
            "compliance.violation", "usage.limit_reached")),
        Rule("secret", optional=True),
    ),
    "create_rotation_policy": (
        Rule("secretId", form="uuid"),
        Rule("intervalDays", "double", minimum=1, maximum=365),
        Rule("autoRotate", "boolean", default=True),
        Rule("gracePeriodHours", default=24, **_HOURS),
        Rule("notifyBefore", "double", minimum=0, maximum=48, default=24),
    ),
    "search_docs": (
        Rule("service", min_length=1),
        Rule("query", min_length=1, max_length=500),
        Rule("limit", "double", minimum=1, maximum=20, default=5),
    ),
    "get_usage": (
        Rule("startDate", optional=True, form="datetime"),
        Rule("endDate", optional=True, form="datetime"),
        Rule("groupBy", enum=("day", "week", "month"), default="day"),
    ),
    "get_audit_logs": (
        Rule("startDate", optional=True, form="datetime"),
        Rule("endDate", optional=True, form="datetime"),
        Rule("action", optional=True, enum=(
            "secret.created", "secret.accessed", "secret.rotated", "secret.deleted",
            "user.login", "apikey.created", "apikey.revoked")),
        Rule("limit", "double", minimum=1, maximum=100, default=50),
        Rule("offset", "double", minimum=0, default=0),
    ),
    "batch_create_secrets": (
        Rule("secrets", "array<struct<service:string,environment:string,scopes:array<string>,value:string,metadata:map<string,string>>>",
             min_items=1, max_items=10, items=_CREATE_SECRET),
    ),
    "batch_rotate_secrets": (
        Rule("secretIds", "array<string>", form="uuid", min_items=1, max_items=50),
        Rule("gracePeriodHours", optional=True, **_HOURS),
    ),
    "export_secrets": (
        Rule("format", enum=("json", "env", "yaml"), default="json"),
        _env(optional=True),
        Rule("includeValues", "boolean", default=False),
    ),
}

# The contracts of the shared library, with the stored names.
_STORED_ENV = tuple(rules.ENVIRONMENTS)
SHARED_CONTRACTS: dict[str, tuple[Rule, ...]] = {
    "shared_environment": (Rule("environment", enum=_STORED_ENV),),
    "shared_framework": (Rule("framework", enum=tuple(rules.FRAMEWORKS)),),
    "shared_action": (Rule("action", enum=tuple(rules.SECRET_ACTIONS)),),
    "shared_create_secret": (
        Rule("service", min_length=1), Rule("environment", enum=_STORED_ENV),
        _texts("scopes", default=[]), Rule("userId", min_length=1),
    ),
    "shared_rotate_secret": (Rule("secretId", form="uuid"),),
    "shared_validate_secret": (Rule("secretId", form="uuid"), Rule("framework", enum=tuple(rules.FRAMEWORKS))),
    "shared_analyze_project": (
        Rule("projectPath", min_length=1), Rule("dependencies", "map<string,string>", default={}),
    ),
    "shared_search_documentation": (Rule("service", min_length=1), Rule("query", min_length=1)),
    "shared_audit_log": (
        Rule("secretId", form="uuid"), Rule("userId", min_length=1),
        Rule("action", enum=tuple(rules.SECRET_ACTIONS)), Rule("ipAddress", optional=True, form="ip"),
        Rule("userAgent", optional=True), Rule("metadata", "map<string,string>", optional=True, any_values=True),
    ),
    "shared_user_preferences": (
        Rule("userId", min_length=1), Rule("defaultEnvironment", optional=True, enum=_STORED_ENV),
        Rule("autoRotationEnabled", "boolean", optional=True),
        Rule("notificationEmail", optional=True, form="email"),
        _texts("complianceFrameworks", enum=tuple(rules.FRAMEWORKS)),
    ),
}
ALL_CONTRACTS = CONTRACTS | SHARED_CONTRACTS


_NUMBERS = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def _member(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _wrong_type(r: Rule, x: Column) -> Column:
    """Is a present member (a variant) not of the rule's type?  An explicit null is of no type."""
    kind = F.schema_of_variant(x)
    if r.type == "string":
        return kind != "STRING"
    if r.type == "boolean":
        return kind != "BOOLEAN"
    if r.type == "double":
        return ~kind.rlike(_NUMBERS)
    many = F.startswith(kind, F.lit("ARRAY" if r.type.startswith("array") else "OBJECT"))
    if r.any_values or r.fields:
        return ~many
    if r.type.startswith("array"):
        inner = F.try_variant_get(x, "$", "array<variant>")
        of = "OBJECT" if r.items else "STRING"
    else:
        inner = F.map_values(F.try_variant_get(x, "$", "map<string,variant>"))
        of = "STRING"
    return ~many | F.coalesce(F.exists(inner, lambda e: ~F.startswith(F.schema_of_variant(e), F.lit(of))), F.lit(False))


def _inner_reasons(r: Rule, x: Column) -> list[Column]:
    """Broken rules of the members of an object, or of any element of an array of objects."""
    elements = F.try_variant_get(x, "$", "array<variant>") if r.items else F.array(x)

    def any_of(test) -> Column:
        return F.coalesce(F.exists(elements, lambda e: F.coalesce(test(e), F.lit(False))), F.lit(False))

    out = []
    for m in r.items or r.fields:
        tests = [("type", lambda e: _member(e, m.name).isNotNull() & _wrong_type(m, _member(e, m.name)))]
        if not m.optional and m.default is None:
            tests.append(("required", lambda e: _member(e, m.name).isNull()))
        if not m.type.startswith(("array", "map")):
            for i, (what, _) in enumerate(_value_failures(m, F.lit(None).cast(m.type))):
                tests.append((what, _breaks(m, i)))
        # each condition is built here, while ``m`` is this member
        out += [F.when(any_of(test), F.lit(f"{r.name}: {m.name} {what}")) for what, test in tests]
    return out


def _breaks(m: Rule, i: int):
    """Does an object's member, of the right type, break its i-th rule?"""
    return lambda e: ~_wrong_type(m, _member(e, m.name)) & _value_failures(m, _member(e, m.name, m.type))[i][1]


def _typed(r: Rule, x: Column) -> Column:
    """A member as a typed value, null where it is missing or of a wrong type."""
    if r.items:
        def one(e):
            return F.struct(*[F.when(~_wrong_type(m, _member(e, m.name)), _member(e, m.name, m.type)).alias(m.name) for m in r.items])

        value = F.transform(F.try_variant_get(x, "$", "array<variant>"), one)
    elif r.fields:
        value = F.struct(*[F.when(~_wrong_type(m, _member(x, m.name)), _member(x, m.name, m.type)).alias(m.name) for m in r.fields])
    else:
        value = F.try_variant_get(x, "$", r.type)
    return F.when(x.isNotNull() & ~_wrong_type(r, x), value)


def _type_reasons(contract: str, v: Column) -> Column:
    """``field: type`` of every member of a wrong type, and what is broken inside members; one reason if the payload is no object."""
    found = []
    for r in ALL_CONTRACTS[contract]:
        x = _member(v, r.name)
        wrong = x.isNotNull() & _wrong_type(r, x)
        found.append(F.when(wrong, F.lit(f"{r.name}: type")))
        found += [F.when(x.isNotNull() & ~wrong, c) for c in _inner_reasons(r, x)]
    is_object = reduce(lambda a, b: a | b, [_member(v, r.name).isNotNull() for r in ALL_CONTRACTS[contract]])     # only an object has members
    is_object = is_object | F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    return F.when(~is_object, F.array(F.lit("payload: type"))).otherwise(F.array_compact(F.array(*found)))


def parse_payload(df: DataFrame, contract: str, column: str) -> DataFrame:
    """JSON payload text as typed columns, and ``_types``: the reasons that only the JSON itself can show.

    A member of a wrong type, and an explicit null, are null and named in ``_types``; ``check_contract`` takes them up.
    """
    v, rules_ = F.col("_payload"), ALL_CONTRACTS[contract]
    parsed = df.withColumn("_payload", F.try_parse_json(F.col(column)))      # once for all members
    return parsed.select(*[F.col(f"`{c}`") for c in df.columns], *[_typed(r, _member(v, r.name)).alias(r.name) for r in rules_], _type_reasons(contract, v).alias("_types"))


def check_payloads(df: DataFrame, contract: str = "contract", column: str = "body") -> DataFrame:
    """Adds ``reasons`` to JSON payloads of many contracts, each named by its row, in one pass."""
    v = F.col("_payload")
    out = F.lit(None).cast("array<string>")
    for name, rules_ in ALL_CONTRACTS.items():
        own = _reasons(name, {r.name: _typed(r, _member(v, r.name)) for r in rules_}, _type_reasons(name, v))
        out = F.when(F.col(contract) == name, own).otherwise(out)
    parsed = df.withColumn("_payload", F.try_parse_json(F.col(column)))      # once for all members
    return parsed.withColumn("reasons", F.coalesce(out, F.array(F.lit("contract: unknown")))).drop("_payload")


def _form_ok(c: Column, form: str) -> Column:
    if form == "email":
        return ~F.startswith(c, F.lit(".")) & ~F.contains(c, F.lit("..")) & c.rlike(_MAIL)
    return c.rlike({"uuid": _UUID, "url": _URL, "datetime": _TIME, "ip": _IP}[form])


def _value_failures(r: Rule, c: Column) -> list[tuple[str, Column]]:
    """(rule name, condition that breaks it) of one present value."""
    out = []
    if r.enum:
        out.append(("enum", ~c.isin(*r.enum)))
    if r.form:
        out.append((r.form, ~_form_ok(c, r.form)))
    for p in r.patterns:
        out.append((f"pattern {p}", ~c.rlike(p)))
    if r.min_length is not None:
        out.append(("min_length", F.length(c) < r.min_length))
    if r.max_length is not None:
        out.append(("max_length", F.length(c) > r.max_length))
    if r.minimum is not None:
        out.append(("minimum", c < r.minimum))
    if r.maximum is not None:
        out.append(("maximum", c > r.maximum))
    if r.positive:
        out.append(("positive", c <= 0))
    return out


def _size_failures(r: Rule, c: Column) -> list[tuple[str, Column]]:
    out = []
    if r.min_items is not None:
        out.append(("min_items", F.size(c) < r.min_items))
    if r.max_items is not None:
        out.append(("max_items", F.size(c) > r.max_items))
    return out


def _array_failures(r: Rule, c: Column) -> list[tuple[str, Column]]:
    out = _size_failures(r, c)
    for item in r.items:
        if not item.optional and item.default is None:
            out.append((f"{item.name} required", F.exists(c, _item_test(item, None))))
        for i, (what, _) in enumerate(_value_failures(item, F.lit(None).cast("string"))):
            out.append((f"{item.name} {what}", F.exists(c, _item_test(item, i))))
    if not r.items:
        for i, (what, _) in enumerate(_value_failures(r, F.lit(None).cast("string"))):
            out.append((what, F.exists(c, _element_test(r, i))))
    return out


def _item_test(item: Rule, i: int | None):
    """Does an array element's field break its i-th rule (or miss, for None)?"""
    if i is None:
        return lambda x: x[item.name].isNull()
    return lambda x: F.coalesce(_value_failures(item, x[item.name])[i][1], F.lit(False))


def _element_test(r: Rule, i: int):
    """Does an array element break the i-th rule?  A null element does."""
    return lambda x: F.coalesce(_value_failures(r, x)[i][1], F.lit(True))


def _default(r: Rule) -> Column:
    if isinstance(r.default, list):
        return F.array(*[F.lit(x) for x in r.default]).cast(r.type)
    if isinstance(r.default, dict):
        return F.create_map().cast(r.type)
    return F.lit(r.default).cast(r.type)


def _reasons(contract: str, values: dict[str, Column], types: Column | None = None) -> Column:
    """``field: rule`` of every broken rule of typed values; ``types`` are reasons found in the JSON before."""
    failures = []
    for r in ALL_CONTRACTS[contract]:
        c = values.get(r.name)
        c = F.lit(None).cast(r.type) if c is None else c
        if r.items and types is not None:       # the JSON showed what is broken inside
            broken = _size_failures(r, c)
        elif r.type.startswith("array"):
            broken = _array_failures(r, c)
        else:
            broken = _value_failures(r, c)
        if not r.optional and r.default is None:
            missing = c.isNull()
            if types is not None:
                missing = missing & ~F.array_contains(types, f"{r.name}: type")
            failures.append(F.when(missing, F.lit(f"{r.name}: required")))
        for what, condition in broken:
            failures.append(F.when(c.isNotNull() & condition, F.lit(f"{r.name}: {what}")))
    found = F.array_compact(F.array(*failures)) if failures else F.array().cast("array<string>")
    if types is None:
        return found
    return F.when(F.array_contains(types, "payload: type"), types).otherwise(F.concat(types, found))


def check_contract(df: DataFrame, contract: str) -> DataFrame:
    """Adds defaults and ``reasons`` (``field: rule`` of every broken rule; empty means valid)."""
    have = set(df.columns)
    values = {r.name: F.col(r.name) for r in ALL_CONTRACTS[contract] if r.name in have}
    types = F.col("_types") if "_types" in have else None
    defaults = {}
    for r in ALL_CONTRACTS[contract]:
        c = values.get(r.name, F.lit(None).cast(r.type))
        if r.default is not None:
            defaults[r.name] = F.coalesce(c, _default(r))
        elif r.name not in have:
            defaults[r.name] = c
    return df.withColumn("reasons", _reasons(contract, values, types)).withColumns(defaults).drop("_types")


def split_contract(df: DataFrame, contract: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows with defaults, rejected rows with reasons)."""
    checked = check_contract(df, contract)
    return (
        checked.filter(F.size("reasons") == 0).drop("reasons"),
        checked.filter(F.size("reasons") > 0),
    )


def row_violations(df: DataFrame, table: str) -> DataFrame:
    """Rows that break a NOT NULL or CHECK constraint of ``table``, with the reasons."""
    spec = TABLES[table]
    tests = [F.when(F.col(c).isNull(), F.lit(f"{c}: not null")) for c in spec.required]
    tests += [
        F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), F.lit(f"{c}: check"))
        for c, values in spec.enums.items()
    ]
    return df.withColumn("reasons", F.array_compact(F.array(*tests))).filter(F.size("reasons") > 0)


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once (SQL rules: a null never repeats)."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.filter(present).groupBy(*keys).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def check_table_constraints(df: DataFrame, table: str) -> DataFrame:
    """(constraint, violations) of a table; all row checks come from one pass."""
    spec = TABLES[table]
    tests = {f"{c}: not null": F.col(c).isNull() for c in spec.required}
    tests |= {f"{c}: check": F.col(c).isNotNull() & ~F.col(c).isin(*v) for c, v in spec.enums.items()}
    counts = df.agg(*[F.count_if(t).alias(f"_{i}") for i, t in enumerate(tests.values())])
    rows = F.array(*[
        F.struct(F.lit(n).alias("constraint"), F.col(f"_{i}").alias("violations")) for i, n in enumerate(tests)
    ])
    out = counts.select(F.explode(rows).alias("_r")).select("_r.*")
    for keys in spec.unique:
        dup = unique_violations(df, keys).agg(F.count("*").alias("violations"))
        out = out.unionByName(dup.select(F.lit(f"{', '.join(keys)}: unique").alias("constraint"), "violations"))
    return out


def orphans(child: DataFrame, parent: DataFrame, fk: str, parent_key: str = "id") -> DataFrame:
    """Child rows whose reference names no parent (a null reference is allowed)."""
    keys = parent.select(F.col(parent_key).alias(fk)).distinct()
    return child.filter(F.col(fk).isNotNull()).join(keys, fk, "left_anti").select(*child.columns)


def cascade_delete(child: DataFrame, deleted: DataFrame, fk: str, parent_key: str = "id") -> DataFrame:
    """Child rows that stay when the ``deleted`` parents go."""
    keys = deleted.select(F.col(parent_key).alias(fk)).distinct()
    return child.join(keys, fk, "left_anti").select(*child.columns)


def foreign_key_violations(tables: dict[str, DataFrame], table: str) -> DataFrame:
    """(reference, violations) of every reference of ``table`` whose parent is given."""
    out = None
    for fk, parent in TABLES[table].references.items():
        if parent not in tables:
            continue
        n = orphans(tables[table], tables[parent], fk, TABLES[parent].key).agg(F.count("*").alias("violations"))
        n = n.select(F.lit(f"{table}.{fk} -> {parent}").alias("reference"), "violations")
        out = n if out is None else out.unionByName(n)
    return out
