"""Queries: lines, leaks, manifests, services, calls, intents."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyquarry import rules
from keyquarry.functions.text import shannon_entropy
from keyquarry.operators import calls, intents, manifests, secrets, services
from keyquarry.plans.checks import case, contains_any, lit, values
from keyquarry.plans.registry import query
from keyquarry.sources.code import drop_removed, explode_lines, file_ext
from keyquarry.sources.fixtures import cte, frame, sql, table

TOKEN = rules.SecretPattern("planted_token", r'token = "[0-9a-f]{40}"', "unknown", ('token = "',))
_WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '"

# ---------------------------------------------------------------- sources

_CHANGES = """SELECT concat(source, '/', CAST(doc_id AS VARCHAR(20)), '.txt') AS file,
 CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'added' WHEN 1 THEN 'modified' WHEN 2 THEN 'removed' ELSE NULL END AS status,
 text AS content FROM documents"""


@query("a2_read_sources", f"SELECT file, status, length(content) AS chars FROM ({_CHANGES}) WHERE status IS DISTINCT FROM 'removed'")
def a2(spark, sf):
    table(spark, sf, "documents").createOrReplaceTempView("documents")
    return drop_removed(spark.sql(_CHANGES)).select("file", "status", F.length("content").cast("bigint").alias("chars"))


@query("a3_explode_lines", """SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)""")
def a3(spark, sf):
    return explode_lines(table(spark, sf, "documents").select("doc_id", "text"), "text")


@query("a4_file_ext", cte("code_lines") + "SELECT file, line_no, string_split(file, '.')[-1] AS ext FROM code_lines")
def a4(spark, sf):
    return frame(spark, sf, "code_lines").select("file", "line_no", file_ext(F.col("file")).alias("ext"))


# ---------------------------------------------------------------- leaks

def _scan_sql(source: str, patterns, keep: str, file: str | None = "file", min_entropy: float | None = None) -> str:
    skip = "NOT regexp_matches(line, '^\\s*(//|#)')"
    if file:
        skip += f" AND NOT {contains_any(file, rules.SKIPPED_FILES)}"
    parts = [
        f"SELECT {keep}, {lit(p.type)} AS type, CAST({lit(p.service)} AS VARCHAR) AS service, "
        f"regexp_extract(line, {lit(p.regex)}) AS m FROM {source} WHERE {skip} AND regexp_matches(line, {lit(p.regex)})"
        for p in patterns
    ]
    body = " UNION ALL ".join(parts)
    if min_entropy is not None:
        entropy = ("list_sum(list_transform(list_distinct(string_split(m, '')), "
                   "lambda c: -((length(m) - length(replace(m, c, ''))) / length(m)) * log2((length(m) - length(replace(m, c, ''))) / length(m))))")
        body = f"SELECT * FROM ({body}) WHERE {entropy} >= {min_entropy}"
    return (f"SELECT {keep}, type, service, substr(m, 1, 20) || '...' AS value, CAST(0.9 AS DOUBLE) AS confidence "
            f"FROM ({body})")


_FINDINGS = _scan_sql("code_lines", rules.SECRET_PATTERNS, "file, line_no")
_WITH_FINDINGS = cte("code_lines", extra=f"findings AS ({_FINDINGS})")


def _findings(spark, sf):
    return secrets.scan_lines(frame(spark, sf, "code_lines"))


@query("t1_scan_secrets", cte("code_lines") + _FINDINGS)
def t1(spark, sf):
    return _findings(spark, sf)


_DOC_LINES = """doc_lines AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"""


@query("t1_scan_documents", "WITH " + _DOC_LINES + " " + _scan_sql(
    "doc_lines", rules.SECRET_PATTERNS + [TOKEN], "doc_id, line_no", None))
def t1_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return secrets.scan_texts(docs, "text", None, rules.SECRET_PATTERNS + [TOKEN])


@query("t2_scan_custom_entropy", "WITH " + _DOC_LINES + " " + _scan_sql(
    "doc_lines", rules.SECRET_PATTERNS + [TOKEN], "doc_id, line_no", None, 3.0))
def t2(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return secrets.scan_texts(docs, "text", None, rules.SECRET_PATTERNS + [TOKEN], min_entropy=3.0)


_PAGE_LINES = """page_lines AS (SELECT page_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line
FROM (SELECT page_id, string_split(html, chr(10)) AS ls FROM pages))"""


@query("t2_scan_pages", "WITH " + _PAGE_LINES + " " + _scan_sql(
    "page_lines", rules.SECRET_PATTERNS + [TOKEN], "page_id, line_no", None, 3.0))
def t2_pages(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    return secrets.scan_texts(pages, "html", None, rules.SECRET_PATTERNS + [TOKEN], min_entropy=3.0)


@query("t3_shannon_entropy", """SELECT c_custkey, round(list_sum(list_transform(list_distinct(string_split(s, '')),
 lambda c: -((length(s) - length(replace(s, c, ''))) / length(s)) * log2((length(s) - length(replace(s, c, ''))) / length(s)))), 9) AS entropy
FROM (SELECT c_custkey, concat(md5(c_name), c_mktsegment) AS s FROM customer)""")
def t3(spark, sf):
    s = F.concat(F.md5("c_name"), "c_mktsegment")
    return table(spark, sf, "customer").select("c_custkey", F.round(shannon_entropy(s), 9).alias("entropy"))


@query("t4_remediation_plan", _WITH_FINDINGS + """SELECT file, line_no, service, 'production' AS environment,
 upper(service) || '_API_KEY' AS env_var FROM findings WHERE service IS NOT NULL AND service <> 'unknown'""")
def t4(spark, sf):
    return secrets.remediation_plan(_findings(spark, sf))


@query("t5_finding_report", _WITH_FINDINGS + "SELECT file, line_no, type, '90%' AS confidence FROM findings")
def t5(spark, sf):
    return secrets.finding_report(_findings(spark, sf))


@query("d7_scan_summary", _WITH_FINDINGS + "SELECT file, type, count(*) AS findings FROM findings GROUP BY file, type")
def d7(spark, sf):
    return secrets.scan_summary(_findings(spark, sf))


@query("d7_scan_verdict", _WITH_FINDINGS + "SELECT count(*) AS secrets_found, CAST(count(*) > 0 AS INT) AS fail FROM findings")
def d7_verdict(spark, sf):
    return secrets.scan_verdict(_findings(spark, sf))


# ---------------------------------------------------------------- manifests

def _manifest(spark, sf, kind):
    return frame(spark, sf, "manifests").filter(F.col("file") == kind)


def _lines_cte(kind: str) -> str:
    return cte("manifests", extra=f"""lines AS (SELECT project, file, unnest(range(1, len(ls) + 1)) AS line_no, trim(unnest(ls), {_WS}) AS line
FROM (SELECT project, file, string_split(content, chr(10)) AS ls FROM manifests WHERE file = {lit(kind)}))""")


def _last(body: str) -> str:
    return f"SELECT project, file, dep, arg_max(version, pos) AS version FROM ({body}) GROUP BY project, file, dep"


def _json_pairs(kind: str, first: str, second: str) -> str:
    def one(member, rank):
        return (f"SELECT project, file, unnest(json_keys(content, '$.\"{member}\"')) AS dep, {rank} AS pos, content, {lit(member)} AS member "
                f"FROM manifests WHERE file = {lit(kind)}")

    both = one(first, 1) + " UNION ALL " + one(second, 2)
    return _last(f"SELECT project, file, dep, pos, json_extract_string(content, '$.\"' || member || '\".\"' || dep || '\"') AS version FROM ({both})")


_REQ = _last("SELECT project, file, regexp_extract(line, '" + manifests.REQUIREMENT + "', 1) AS dep, '*' AS version, line_no AS pos "
             "FROM lines WHERE line <> '' AND NOT starts_with(line, '#') AND regexp_matches(line, '" + manifests.REQUIREMENT + "')")
_GO = """SELECT project, file, regexp_extract(line, '(?:require )?([\\w.\\-/]+)\\s+v?([\\d.]+)', 1) AS dep,
 regexp_extract(line, '(?:require )?([\\w.\\-/]+)\\s+v?([\\d.]+)', 2) AS version, line_no AS pos
FROM (SELECT *, last_value(CASE WHEN line = 'require (' THEN 1 WHEN line = ')' THEN 0 END IGNORE NULLS)
 OVER (PARTITION BY project, file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS inside FROM lines)
WHERE line NOT IN ('require (', ')') AND (inside = 1 OR starts_with(line, 'require '))
 AND regexp_matches(line, '(?:require )?([\\w.\\-/]+)\\s+v?([\\d.]+)')"""
_GEM = "SELECT project, file, regexp_extract(line, {p}, 1) AS dep, coalesce(nullif(regexp_extract(line, {p}, 2), ''), '*') AS version, line_no AS pos " \
       "FROM lines WHERE line <> '' AND NOT starts_with(line, '#') AND regexp_matches(line, {p})".replace("{p}", lit(manifests.GEM))
_CARGO = """SELECT project, file, regexp_extract(line, '^([\\w-]+)\\s*=\\s*"([^"]+)"', 1) AS dep,
 regexp_extract(line, '^([\\w-]+)\\s*=\\s*"([^"]+)"', 2) AS version, line_no AS pos
FROM (SELECT *, last_value(CASE WHEN line IN ('[dependencies]', '[dev-dependencies]') THEN 1 WHEN starts_with(line, '[') AND suffix(line, ']') THEN 0 END IGNORE NULLS)
 OVER (PARTITION BY project, file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS inside FROM lines)
WHERE inside = 1 AND NOT starts_with(line, '[') AND regexp_matches(line, '^([\\w-]+)\\s*=\\s*"([^"]+)"')"""
_PARSE_SQL = {
    "package.json": cte("manifests") + _json_pairs("package.json", "dependencies", "devDependencies"),
    "requirements.txt": _lines_cte("requirements.txt") + _REQ,
    "go.mod": _lines_cte("go.mod") + _last(_GO),
    "Gemfile": _lines_cte("Gemfile") + _last(_GEM),
    "composer.json": cte("manifests") + _json_pairs("composer.json", "require", "require-dev"),
    "Cargo.toml": _lines_cte("Cargo.toml") + _last(_CARGO),
}


def _parse_query(name: str, kind: str) -> None:
    @query(name, _PARSE_SQL[kind])
    def run(spark, sf):
        return manifests.parse_deps(_manifest(spark, sf, kind), kind)


_parse_query("m1_parse_package_json", "package.json")
_parse_query("m2_parse_requirements", "requirements.txt")
_parse_query("m3_parse_go_mod", "go.mod")
_parse_query("m4_parse_gemfile", "Gemfile")
_parse_query("m5_parse_composer", "composer.json")
_parse_query("m6_parse_cargo", "Cargo.toml")


@query("m1_package_manager", cte("manifests") + """SELECT project, CASE WHEN starts_with(m, 'pnpm') THEN 'pnpm' WHEN starts_with(m, 'yarn') THEN 'yarn' ELSE 'npm' END AS manager
FROM (SELECT project, content ->> '$.packageManager' AS m FROM manifests WHERE file = 'package.json')""")
def m1_manager(spark, sf):
    return _manifest(spark, sf, "package.json").select("project", manifests.package_manager(F.col("content")).alias("manager"))


# Texts of every kind the type ladder tells apart, over all parts.
_LADDER = """ladder AS (SELECT p_partkey AS id, CASE CAST(p_partkey % 12 AS INT)
 WHEN 0 THEN concat('{"dependencies":{"', p_name, '":"1"}}') WHEN 1 THEN '{"require":{"a/b":"1"},"note":"dependencies"}'
 WHEN 2 THEN '{"name":"dependencies"}' WHEN 3 THEN '{"dependencies": broken' WHEN 4 THEN concat('module ', p_name, chr(10), 'go 1.20')
 WHEN 5 THEN 'django >=4' WHEN 6 THEN concat('source "x"', chr(10), 'gem "', p_name, '"') WHEN 7 THEN concat('gem ''', p_name, '''')
 WHEN 8 THEN concat('[package]', chr(10), '[dependencies]') WHEN 9 THEN '   ' WHEN 10 THEN '{"require":{"a/b":"1"}}'
 ELSE concat(p_name, '==1.0') END AS content FROM part)"""
_LADDER_CASE = case([
    (f"trim(content, {_WS}) = ''", "NULL"),
    (f"starts_with(ltrim(content, {_WS}), '{{') AND contains(content, 'dependencies')",
     "CASE WHEN NOT json_valid(content) THEN NULL WHEN json_exists(content, '$.dependencies') OR json_exists(content, '$.devDependencies') THEN 'package.json' "
     "WHEN json_exists(content, '$.require') THEN 'composer.json' END"),
    ("contains(content, 'require (') OR contains(content, 'go ')", "'go.mod'"),
    ("contains(content, 'gem \"') OR contains(content, 'gem ''')", "'Gemfile'"),
    ("contains(content, '[dependencies]')", "'Cargo.toml'"),
], "'requirements.txt'")


def _ladder(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    return spark.sql(f"WITH {_LADDER} SELECT * FROM ladder")


@query("m7_detect_manifest_type", f"WITH {_LADDER} SELECT id, {_LADDER_CASE} AS manifest_type FROM ladder")
def m7(spark, sf):
    from keyquarry.functions.text import trim_ws

    content = F.col("content")
    return _ladder(spark, sf).select(
        "id", F.when(trim_ws(content) != "", manifests.detect_manifest_type(content)).alias("manifest_type"))


_ALL_DEPS = " UNION ALL ".join(
    "SELECT project, file, dep, version FROM (" + _PARSE_SQL[k].replace("WITH manifests AS", "WITH manifests AS", 1) + ")"
    for k in manifests.PARSERS
)
_LANG = case([(f"file = {lit(k)}", lit(v[0])) for k, v in manifests.LANGUAGES.items()])


@query("m8_scan_manifests", f"SELECT project, file, {_LANG} AS language, dep, version FROM ({_ALL_DEPS})")
def m8(spark, sf):
    deps, _, _ = manifests.scan_manifests(frame(spark, sf, "manifests").withColumn("kind", F.col("file")), "kind")
    return deps.select("project", "file", "language", "dep", "version")


def _rule_values(service_rules, fold=str) -> str:
    rows = [(lit(r.service), lit(fold(p)), f"CAST({r.confidence} AS DOUBLE)") for r in service_rules for p in r.patterns]
    return values(rows, "rules", ["service", "pattern", "confidence"])


_CI_RULES = _rule_values(rules.SERVICE_RULES, str.lower)


@query("m8_manifest_services", f"""WITH {_CI_RULES}, deps AS ({_ALL_DEPS})
SELECT project, file, service, max(confidence) AS confidence FROM deps JOIN rules ON contains(lower(dep), pattern) GROUP BY project, file, service""")
def m8_services(spark, sf):
    # Types are detected from the text here; the projected manifests are all of a clear kind
    # except composer files, whose text never says "dependencies", so their name decides.
    _, found, _ = manifests.scan_manifests(frame(spark, sf, "manifests").withColumn("kind", F.col("file")), "kind")
    return found.select("project", "file", "service", "confidence")


@query("m8_manifest_errors", f"""WITH {_LADDER} SELECT CAST(id AS VARCHAR(20)) AS project, manifest_type, CASE
 WHEN trim(content, {_WS}) = '' THEN 'Cannot scan empty content'
 WHEN starts_with(content, '{{') AND contains(content, 'dependencies') AND NOT json_valid(content) THEN 'Failed to scan dependencies: invalid JSON'
 ELSE 'Failed to scan dependencies: Unsupported file type' END AS error
FROM (SELECT id, content, {_LADDER_CASE} AS manifest_type FROM ladder) WHERE manifest_type IS NULL""")
def m8_errors(spark, sf):
    files = _ladder(spark, sf).select(F.col("id").cast("string").alias("project"), F.lit("manifest").alias("file"), "content")
    _, _, errors = manifests.scan_manifests(files)
    return errors.select("project", "manifest_type", "error")


@query("e3_section_carry", _lines_cte("Cargo.toml") + """SELECT project, file, line_no, line,
 last_value(CASE WHEN starts_with(line, '[') AND suffix(line, ']') THEN line END IGNORE NULLS)
 OVER (PARTITION BY project, file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM lines""")
def e3(spark, sf):
    lines = explode_lines(_manifest(spark, sf, "Cargo.toml"))
    marker = F.when(F.startswith("line", F.lit("[")) & F.endswith("line", F.lit("]")), F.col("line"))
    return manifests.section_carry(lines, marker, ["project", "file"]).select("project", "file", "line_no", "line", "section")


@query("g1_dependency_union", _PARSE_SQL["package.json"])
def g1(spark, sf):
    both = _manifest(spark, sf, "package.json").withColumn("j", manifests.package_json(F.col("content")))
    parts = [
        both.select("project", "file", F.explode(F.col("j")[m]).alias("dep", "version")).withColumn("_pos", F.lit(i))
        for i, m in enumerate(["dependencies", "devDependencies"])
    ]
    return manifests.last_mention(parts[0].unionByName(parts[1]), ["project", "file"])


# ---------------------------------------------------------------- services

@query("c8_match_dependency_rules", cte("dep_names", extra=_CI_RULES) + """SELECT project, dep, service, max(confidence) AS confidence
FROM (SELECT row_number() OVER () AS r, * FROM dep_names) JOIN rules ON contains(lower(dep), pattern) GROUP BY r, project, dep, service""")
def c8(spark, sf):
    return services.match_dependency_rules(frame(spark, sf, "dep_names"))


@query("s1_detect_services", cte("dep_names", extra=_CI_RULES) + """SELECT project, service, max(confidence) AS confidence
FROM dep_names JOIN rules ON contains(lower(dep), pattern) GROUP BY project, service""")
def s1(spark, sf):
    return services.detect_services(frame(spark, sf, "dep_names"))


# Rules from a table: thousands of patterns, looked up by their rarest n-gram.
_MANY = """many AS (SELECT p_partkey AS rule, p_brand AS service, upper(substr(md5(p_name), 1 + CAST(p_partkey % 9 AS INT), 2 + CAST(p_partkey % 5 AS INT))) AS pattern,
 CAST((50 + p_partkey % 50) AS DOUBLE) / 100 AS confidence FROM part),
hex_names AS (SELECT CAST(p_partkey % 50 AS VARCHAR(9)) AS project, md5(p_type) AS dep, p_partkey AS id FROM part)"""


def _many(spark, sf):
    rows = lambda name: sql(spark, sf, f"WITH {_MANY} SELECT * FROM {name}")
    return rows("hex_names"), rows("many")


@query("c8_match_rule_table", f"WITH {_MANY} SELECT h.id, m.service, m.confidence FROM hex_names h JOIN many m ON contains(lower(h.dep), lower(m.pattern))")
def c8_table(spark, sf):
    return services.match_rule_table(*_many(spark, sf)).select("id", "service", "confidence")


@query("s1_detect_by_rule_table", f"WITH {_MANY} SELECT project, service, max(confidence) AS confidence FROM hex_names h JOIN many m ON contains(lower(h.dep), lower(m.pattern)) GROUP BY project, service")
def s1_table(spark, sf):
    return services.max_confidence_by_service(services.match_rule_table(*_many(spark, sf), by=["project"]), ["project"])


def _map_query(name: str, service_map, mode: str) -> None:
    on = "dep = pattern" if mode == "exact" else "contains(dep, pattern)"

    @query(name, cte("dep_names", extra=_rule_values(service_map)) + f"SELECT DISTINCT project, service FROM dep_names JOIN rules ON {on}")
    def run(spark, sf):
        return services.detect_services(frame(spark, sf, "dep_names"), service_map, mode).select("project", "service")


_map_query("s1_services_shared_map", rules.SHARED_SERVICE_MAP, "substring_cs")
_map_query("s1_services_api_map", rules.API_SERVICE_MAP, "substring_cs")
_map_query("s1_services_cli_map", rules.CLI_SERVICE_MAP, "substring_cs")
_map_query("s1_services_exact_map", rules.EXACT_SERVICE_MAP, "exact")


@query("d9_max_confidence_by_service", cte("dep_names", extra=_CI_RULES) + """SELECT service, max(confidence) AS confidence, count(DISTINCT project) AS projects
FROM dep_names JOIN rules ON contains(lower(dep), pattern) GROUP BY service""")
def d9(spark, sf):
    per_project = services.detect_services(frame(spark, sf, "dep_names"))
    return per_project.groupBy("service").agg(F.max("confidence").alias("confidence"), F.count("*").alias("projects"))


_SCOPES = case([(f"service = {lit(r.service)}", lit(",".join(r.scopes))) for r in rules.SERVICE_RULES if r.scopes], "'read,write'")


@query("s2_recommended_scopes", cte("dep_names", extra=_CI_RULES) + f"""SELECT DISTINCT project, service, {_SCOPES} AS scopes
FROM dep_names JOIN rules ON contains(lower(dep), pattern)""")
def s2(spark, sf):
    found = services.detect_services(frame(spark, sf, "dep_names")).select("project", "service")
    return services.recommended_scopes(found).withColumn("scopes", F.array_join("scopes", ","))


@query("f4_supported_services", cte("dep_names", extra=_CI_RULES) + """SELECT r.service, count(DISTINCT d.project) AS projects
FROM (SELECT DISTINCT service FROM rules) r LEFT JOIN (SELECT project, service FROM dep_names JOIN rules ON contains(lower(dep), pattern)) d
 ON d.service = r.service GROUP BY r.service ORDER BY r.service""")
def f4(spark, sf):
    found = services.detect_services(frame(spark, sf, "dep_names")).groupBy("service").agg(F.count("*").alias("projects"))
    listed = rules.supported_services(spark)
    return listed.join(found, "service", "left").fillna(0, ["projects"]).orderBy("service")


@query("f3_preview", cte("dep_names") + """SELECT project, string_agg(dep, ',' ORDER BY dep) AS preview
FROM (SELECT project, dep, row_number() OVER (PARTITION BY project ORDER BY dep) AS r FROM (SELECT DISTINCT project, dep FROM dep_names))
WHERE r <= 10 GROUP BY project""")
def f3(spark, sf):
    return services.preview(frame(spark, sf, "dep_names")).withColumn("preview", F.array_join("preview", ","))


_CONFIG_VALUES = values(
    [tuple(lit(x) for x in (s, p, u, a, ",".join(sc), d)) for s, p, u, a, sc, d in rules.SERVICE_CONFIGS],
    "configs", ["service", "provider_name", "api_base_url", "auth_type", "default_scopes", "documentation_url"])


@query("c13_attach_service_config", cte("secrets", extra=_CONFIG_VALUES) + """SELECT s.id, s.service, provider_name, api_base_url, auth_type, default_scopes
FROM secrets s LEFT JOIN configs USING (service)""")
def c13(spark, sf):
    out = services.attach_service_config(frame(spark, sf, "secrets").select("id", "service"))
    return out.select("id", "service", "provider_name", "api_base_url", "auth_type", F.array_join("default_scopes", ",").alias("default_scopes"))


@query("a8_service_configs", cte("secrets", extra=_CONFIG_VALUES) + """SELECT c.service, c.provider_name, c.documentation_url, count(s.id) AS secrets
FROM configs c LEFT JOIN secrets s USING (service) GROUP BY ALL""")
def a8_configs(spark, sf):
    used = frame(spark, sf, "secrets").groupBy("service").agg(F.count("*").alias("secrets"))
    configs = rules.service_configs_df(spark).select("service", "provider_name", "documentation_url")
    return configs.join(used, "service", "left").fillna(0, ["secrets"])


@query("a8_secret_patterns", _WITH_FINDINGS.rstrip() + ", " + values(
    [(lit(p.type), f"CAST({lit(p.service)} AS VARCHAR)") for p in rules.SECRET_PATTERNS], "patterns", ["type", "service"]) +
    " SELECT p.type, p.service, count(f.type) AS findings FROM patterns p LEFT JOIN findings f ON f.type = p.type GROUP BY p.type, p.service")
def a8_patterns(spark, sf):
    hits = _findings(spark, sf).groupBy("type").agg(F.count("*").alias("findings"))
    return rules.secret_patterns_df(spark).select("type", "service").join(hits, "type", "left").fillna(0, ["findings"])


# ---------------------------------------------------------------- calls

_LANG_CASE = "CASE string_split(file, '.')[-1] " + " ".join(
    f"WHEN {lit(e)} THEN {lit(v)}" for e, v in rules.LANG_OF_EXT.items()) + " END"


def _calls_sql(source: str, langs=("js", "py", "go"), compat: bool = True) -> str:
    """One branch per call rule over the lines of its language."""
    parts = []
    for r in rules.CALL_RULES:
        if r.lang not in langs:
            continue
        groups = bool(r.methods)
        m = "m" if groups else lit(r.default)
        endpoint = f"{lit(r.prefix + '.')} || {m}"
        if not compat:
            if groups:
                m = "CASE m " + " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in rules.METHOD_FIXES.get(r.lang, {"": ""}).items()) + " ELSE m END"
                endpoint = f"{lit(r.prefix + '.')} || {m}"
            elif r.fixed:
                m, endpoint = lit(r.fixed.split(".")[-1]), lit(r.fixed)
        marks = " AND ".join(f"NOT starts_with(ltrim(line, {_WS}), {lit(c)})" for c in rules.LINE_COMMENTS[r.lang])
        parts.append(
            f"SELECT repo, file, line_no, {lit(r.service)} AS service, {m} AS method, {endpoint} AS endpoint FROM "
            f"(SELECT repo, file, line_no, unnest(regexp_extract_all(line, {lit(r.regex)}, {1 if groups else 0})) AS m FROM {source} "
            f"WHERE {_LANG_CASE} = {lit(r.lang)} AND {marks})"
        )
    return " UNION ALL ".join(parts)


def _calls_query(name: str, lang: str, ext: list[str]) -> None:
    @query(name, cte("call_lines") + _calls_sql("call_lines", (lang,)))
    def run(spark, sf):
        lines = frame(spark, sf, "call_lines").filter(file_ext(F.col("file")).isin(ext))
        return calls.extract_api_calls(lines)


_calls_query("p1_api_calls_js", "js", ["js", "ts", "jsx", "tsx"])
_calls_query("p2_api_calls_py", "py", ["py"])
_calls_query("p3_api_calls_go", "go", ["go"])


@query("g3_calls_all_languages", cte("call_lines") + _calls_sql("call_lines", compat=False))
def g3(spark, sf):
    return calls.extract_api_calls(frame(spark, sf, "call_lines"), compat=False)


_SCOPE_VALUES = values([(lit(s), lit(e), lit(x)) for s, m in rules.ENDPOINT_SCOPES.items() for e, x in m.items()],
                       "scopes", ["service", "endpoint", "scope"])
_SCOPED = f"calls AS ({_calls_sql('call_lines')}), scoped AS (SELECT c.*, s.scope FROM calls c JOIN scopes s USING (service, endpoint))"
_SERVICES = ["stripe", "aws", "openai", "twilio", "sendgrid", "unknown-service"]
_ANALYSIS = f"""targets AS (SELECT DISTINCT repo, s.service FROM call_lines, (SELECT unnest([{', '.join(lit(s) for s in _SERVICES)}]) AS service) s),
agg AS (SELECT t.repo, t.service, count(c.endpoint) AS calls, list_sort(list(DISTINCT c.endpoint) FILTER (c.endpoint IS NOT NULL)) AS endpoints,
 list_sort(list(DISTINCT c.scope) FILTER (c.scope IS NOT NULL)) AS used FROM targets t LEFT JOIN scoped c USING (repo, service) GROUP BY t.repo, t.service),
every AS (SELECT service, list_sort(list(DISTINCT scope)) AS every_scope FROM scopes GROUP BY service),
analysis AS (SELECT repo, service, calls, coalesce(endpoints, []) AS endpoints, coalesce(used, []) AS used,
 list_filter(coalesce(every_scope, []), lambda x: NOT list_contains(coalesce(used, []), x)) AS unused FROM agg LEFT JOIN every USING (service))"""
_CALLS_CTE = cte("call_lines", extra=f"{_SCOPE_VALUES}, {_SCOPED}")
_ANALYSIS_CTE = cte("call_lines", extra=f"{_SCOPE_VALUES}, {_SCOPED}, {_ANALYSIS}")


def _scoped(spark, sf):
    return calls.match_scopes(calls.extract_api_calls(frame(spark, sf, "call_lines")))


def _analysis(spark, sf):
    lines = frame(spark, sf, "call_lines")
    targets = lines.select("repo").distinct().select("repo", F.explode(F.array(*[F.lit(s) for s in _SERVICES])).alias("service"))
    return calls.scope_analysis(_scoped(spark, sf), targets, ["repo"])


@query("c9_match_scopes", _CALLS_CTE + "SELECT repo, file, line_no, service, endpoint, method, scope FROM scoped")
def c9(spark, sf):
    return _scoped(spark, sf)


@query("c10_unused_scopes", _CALLS_CTE + """SELECT p.repo, p.service, s.scope FROM (SELECT DISTINCT repo, service FROM scoped) p
JOIN (SELECT DISTINCT service, scope FROM scopes) s USING (service)
WHERE NOT EXISTS (SELECT 1 FROM scoped c WHERE c.repo = p.repo AND c.service = p.service AND c.scope = s.scope)""")
def c10(spark, sf):
    return calls.unused_scopes(_scoped(spark, sf), ["repo"])


@query("d11_scope_analysis", _ANALYSIS_CTE + """SELECT repo, service, calls, array_to_string(endpoints, ',') AS endpoints, array_to_string(used, ',') AS scopes,
 array_to_string(unused, ',') AS unused_scopes, round(least(0.5 + calls * 0.1, 0.99), 6)::DOUBLE AS confidence FROM analysis""")
def d11(spark, sf):
    a = _analysis(spark, sf)
    return a.select("repo", "service", "calls", *[F.array_join(c, ",").alias(c) for c in ("endpoints", "scopes", "unused_scopes")],
                    F.round("confidence", 6).alias("confidence"))


@query("d10_scope_summary", _ANALYSIS_CTE + """SELECT repo, count(*) AS total_services, CAST(sum(len(used)) AS BIGINT) AS total_scopes,
 round(CASE WHEN sum(len(used)) + sum(len(unused)) > 0 THEN sum(len(unused)) / (sum(len(used)) + sum(len(unused))) * 100 ELSE 0 END, 6)::DOUBLE AS optimization_potential
FROM analysis GROUP BY repo""")
def d10(spark, sf):
    return calls.scope_summary(_analysis(spark, sf), ["repo"]).withColumn("optimization_potential", F.round("optimization_potential", 6))


@query("p5_scope_suggestions", _ANALYSIS_CTE + """SELECT repo, service, concat_ws('|',
 CASE WHEN len(used) = 0 THEN 'No API calls detected for ' || service || '. Consider removing this dependency.'
  ELSE 'Detected ' || calls || ' API call(s) requiring ' || len(used) || ' scope(s).' END,
 CASE WHEN len(unused) > 0 THEN len(unused) || ' scope(s) can be removed: ' || array_to_string(unused[1:3], ', ') || CASE WHEN len(unused) > 3 THEN '...' ELSE '' END END,
 CASE WHEN service = 'stripe' AND len(list_filter(used, lambda x: contains(x, ':read'))) > 0 AND len(list_filter(used, lambda x: contains(x, ':write'))) = 0
  THEN 'Consider using a read-only Stripe key for better security.' END,
 CASE WHEN service = 'aws' AND (list_contains(used, 's3:PutObject') OR list_contains(used, 's3:DeleteObject'))
  THEN 'Consider using separate IAM roles for read and write operations on S3.' END) AS suggestions FROM analysis""")
def p5(spark, sf):
    return calls.scope_suggestions(_analysis(spark, sf)).select("repo", "service", F.array_join("suggestions", "|").alias("suggestions"))


_FILES = """files AS (SELECT repo, file, string_agg(line, chr(10) ORDER BY line_no) AS content FROM call_lines GROUP BY repo, file)"""


@query("p4_analyze_project", _ANALYSIS_CTE + """SELECT repo, service, calls, len(used) AS used_scopes, len(unused) AS unused_scopes FROM analysis""")
def p4(spark, sf):
    lines = frame(spark, sf, "call_lines")
    files = lines.select("repo", "file", F.col("line").alias("content"))
    analysis, _ = calls.analyze_projects(files, _SERVICES)
    return analysis.select("repo", "service", "calls", F.size("scopes").cast("bigint").alias("used_scopes"),
                           F.size("unused_scopes").cast("bigint").alias("unused_scopes"))


# ---------------------------------------------------------------- intents

_L = "lower(text)"
_INTENT = case([
    (contains_any(_L, words) + (" OR text = '?'" if name == "help" else ""), lit(name)) for name, words in rules.INTENT_WORDS
], "'unknown'")


@query("n1_classify_intent", cte("messages") + f"""SELECT conv_id, turn, intent, confidence,
 CASE WHEN intent IN ('provision_secret', 'rotate_secret') THEN {case([(f"contains({_L}, {lit(s)})", lit(s)) for s in rules.INTENT_SERVICES])} END AS service,
 CASE WHEN intent IN ('provision_secret', 'list_secrets') THEN {case([(contains_any(_L, w), lit(n)) for n, w in rules.INTENT_ENVIRONMENTS])} END AS environment,
 CASE WHEN intent = 'rotate_secret' THEN nullif(regexp_extract(text, '(?i)[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}'), '') END AS secret_id,
 CASE WHEN intent = 'check_compliance' THEN {case([(contains_any(_L, w), lit(n)) for n, w in rules.INTENT_FRAMEWORKS])} END AS framework,
 confidence <= 0.8 AS needs_review
FROM (SELECT *, CAST(CASE intent WHEN 'help' THEN 1.0 WHEN 'unknown' THEN 0.3 ELSE 0.9 END AS DOUBLE) AS confidence
 FROM (SELECT *, {_INTENT} AS intent FROM messages))""")
def n1(spark, sf):
    return intents.classify_intent(frame(spark, sf, "messages")).drop("text")
