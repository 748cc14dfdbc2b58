"""Services behind dependency names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keyquarry import rules
from keyquarry.rules import ServiceRule
from keyquarry.session import materialize


#: Matches of a name that are put to a row together.
_LIST = 1024


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matched_services(dep: str, service_rules: list[ServiceRule], mode: str) -> Column:
    """array<struct<service, confidence>> for the dependency name in column ``dep``.

    A constant rule list is one expression: the substring theta join needs neither a join
    nor a shuffle, and the cost is one pass over the names.
    """
    if mode not in ("substring_ci", "substring_cs", "exact"):
        raise ValueError(f"unknown mode {mode!r}")
    name = f"lower(`{dep}`)" if mode == "substring_ci" else f"`{dep}`"
    found = []
    for r in service_rules:
        words = [_text(p.lower() if mode == "substring_ci" else p) for p in r.patterns]
        if mode == "exact":
            hit = f"{name} IN ({', '.join(words)})"
        else:
            hit = " OR ".join(f"contains({name}, {w})" for w in words)
        found.append(f"CASE WHEN {hit} THEN named_struct('service', {_text(r.service)}, "
                     f"'confidence', CAST({r.confidence} AS DOUBLE)) END")
    return F.expr(f"array_compact(array({', '.join(found)}))")


def match_dependency_rules(
    deps: DataFrame, service_rules: list[ServiceRule] | None = None, mode: str = "substring_ci", dep: str = "dep"
) -> DataFrame:
    """Every (dependency row, service) match: input columns plus service and confidence."""
    found = matched_services(dep, rules.SERVICE_RULES if service_rules is None else service_rules, mode)
    return deps.select("*", F.explode(found).alias("_m")).select(
        *[F.col(f"`{c}`") for c in deps.columns], F.col("_m.service").alias("service"), F.col("_m.confidence").alias("confidence")
    )


def _grams(text: Column, n: int) -> Column:
    """The distinct stretches of ``n`` characters; of none, the empty one."""
    if n == 0:
        return F.array(F.lit(""))
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(n))))


def match_rule_table(deps: DataFrame, rule_table: DataFrame, mode: str = "substring_ci", dep: str = "dep", n: int = 3, by: list[str] | None = None) -> DataFrame:
    """As ``match_dependency_rules`` for rules of a table (rule, service, pattern, confidence), of any number.

    Rows of one ``rule`` are its patterns; a rule matches a row once.  A null name, rule or pattern matches nothing.
    Every distinct name is matched once.  A pattern is looked up by one of its n-grams, the one that fewest
    names have, and only names with that n-gram are compared with it: equi-joins only, and a
    stretch that many patterns or names share is not used while a pattern has a rarer one.  Patterns
    shorter than ``n`` are looked up whole.

    The matches of a name are put to its rows in lists of at most ``_LIST``, and the rows are dealt out evenly before, as a
    few names with many rows and matches give most of the result.  With ``by`` (columns of ``deps``) the result has those, the name, service and confidence,
    once for each different row and service with the highest confidence: all that ``max_confidence_by_service`` needs.
    """
    if mode not in ("substring_ci", "substring_cs", "exact"):
        raise ValueError(f"unknown mode {mode!r}")
    cased = F.lower if mode == "substring_ci" else (lambda c: c)
    names = deps.select(F.col(f"`{dep}`").alias("name")).filter(F.col("name").isNotNull()).distinct().withColumn("text", cased(F.col("name")))
    patterns = rule_table.select("rule", "service", "confidence", cased(F.col("pattern")).alias("pattern")).filter(F.col("rule").isNotNull() & F.col("pattern").isNotNull())
    if mode == "exact":
        found = names.join(patterns, F.col("text") == F.col("pattern"))
    else:
        short = [r[0] for r in patterns.select(F.length("pattern").alias("n")).filter(F.col("n") < n).distinct().collect()]      # at most n numbers
        every = F.array_distinct(F.flatten(F.array(*[_grams(F.col("text"), m) for m in sorted({*short, n})])))
        held = materialize(names.select("name", "text", F.explode(every).alias("gram")), "grams")
        often = held.groupBy("gram").agg(F.count("*").alias("names"))
        own = F.when(F.length("pattern") < n, F.array("pattern")).otherwise(_grams(F.col("pattern"), n))
        # a pattern with an n-gram that no name has matches none and leaves the index
        keyed = patterns.select("pattern").distinct().withColumn("gram", F.explode(own)).join(often, "gram", "left")
        rarest = keyed.groupBy("pattern").agg(F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "gram")).alias("_k"))
        index = materialize(rarest.filter(F.col("_k.names") > 0).select("pattern", F.col("_k.gram").alias("gram")), "index")
        hits = held.join(index, "gram").filter(F.contains("text", "pattern")).select("name", "pattern")
        found = hits.join(patterns, "pattern")
    matches = materialize(found.groupBy("name", "rule").agg(F.first("service").alias("service"), F.max("confidence").alias("confidence")), "matches")
    if by is not None:
        deps, matches = deps.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*by, dep])]).distinct(), max_confidence_by_service(matches, ["name"])
    spread = matches.withColumn("_part", F.pmod(F.xxhash64("service", "confidence"), F.lit(64)))
    listed = spread.withColumn("_place", F.floor(F.row_number().over(Window.partitionBy("name", "_part").orderBy("service", "confidence")) / _LIST))
    by_name = materialize(listed.groupBy(F.col("name").alias("_name"), "_part", "_place").agg(F.collect_list(F.struct("service", "confidence")).alias("_found")), "lists")
    parts = int(deps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = deps.filter(F.col(f"`{dep}`").isNotNull()).repartition(parts).join(by_name, F.col(f"`{dep}`") == F.col("_name"))
    return joined.select(*[F.col(f"`{c}`") for c in deps.columns], F.explode("_found").alias("_m")).select(
        *[F.col(f"`{c}`") for c in deps.columns], F.col("_m.service").alias("service"), F.col("_m.confidence").alias("confidence"))


def max_confidence_by_service(matches: DataFrame, by: list[str]) -> DataFrame:
    """Highest confidence per service; partial maxima are taken before the shuffle."""
    return matches.groupBy(*by, "service").agg(F.max("confidence").alias("confidence"))


def detect_services(
    deps: DataFrame,
    service_rules: list[ServiceRule] | None = None,
    mode: str = "substring_ci",
    by: list[str] | None = None,
    dep: str = "dep",
) -> DataFrame:
    """Services per project with their confidence."""
    return max_confidence_by_service(match_dependency_rules(deps, service_rules, mode, dep), by or ["project"])


def recommended_scopes(services: DataFrame) -> DataFrame:
    """Adds the recommended scopes of each service; unknown services get the default."""
    def arr(values):
        return F.array(*[F.lit(v) for v in values])

    out = arr(rules.DEFAULT_SCOPES)
    for r in rules.SERVICE_RULES:
        if r.scopes:
            out = F.when(F.col("service") == r.service, arr(r.scopes)).otherwise(out)
    return services.withColumn("scopes", out)


def attach_service_config(services: DataFrame) -> DataFrame:
    """Left join of the seven seeded service configurations (constant size)."""
    return services.join(F.broadcast(rules.service_configs_df(services.sparkSession)), "service", "left")


def missing_keys(detected: DataFrame, secrets: DataFrame) -> DataFrame:
    """(user_id, service) detected but without an active secret of that user."""
    owned = secrets.filter(F.col("is_active") == 1).select("user_id", "service").distinct()
    return detected.select("user_id", "service").distinct().join(owned, ["user_id", "service"], "left_anti")


def preview(deps: DataFrame, by: str = "project", dep: str = "dep", n: int = 10) -> DataFrame:
    """The first ``n`` distinct names per project in sorted order.

    A rank filter keeps at most ``n`` rows per project in every task before the shuffle.
    """
    names = deps.select(by, dep).distinct()
    rank = F.row_number().over(Window.partitionBy(by).orderBy(dep))
    top = names.withColumn("_r", rank).filter(F.col("_r") <= n)
    return top.groupBy(by).agg(F.sort_array(F.collect_list(dep)).alias("preview"))
