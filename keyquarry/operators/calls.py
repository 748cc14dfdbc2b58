"""API calls in source lines and the scopes they need."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from keyquarry import rules
from keyquarry.functions.text import WHITESPACE
from keyquarry.sources.code import explode_lines, file_ext


def language_of(file: Column) -> Column:
    """js, py or go by file extension, else null."""
    ext = file_ext(file)
    out = F.lit(None).cast("string")
    for name, lang in rules.LANG_OF_EXT.items():
        out = F.when(ext == name, F.lit(lang)).otherwise(out)
    return out


def extract_api_calls(
    lines: DataFrame, services: list[str] | None = None, compat: bool = True, lang: Column | None = None
) -> DataFrame:
    """Calls found in (…, file, line_no, line) rows: service, method, endpoint per call.

    All rules of a language are one pattern, so a line is searched once; what a matched
    text means is looked up in a constant-size table.  Blank and comment lines are
    skipped.  ``compat=True`` names methods exactly as written; ``compat=False`` also maps
    the spellings that otherwise never reach a scope.
    """
    chosen = [r for r in rules.CALL_RULES if services is None or r.service in services]
    keep = [c for c in lines.columns if c != "line"]
    text = F.ltrim(F.col("line"), F.lit(WHITESPACE))
    found = F.lit(None).cast("array<string>")
    for name in rules.LINE_COMMENTS:
        pattern = "|".join(r.regex.replace("(", "(?:") for r in chosen if r.lang == name)
        if pattern:
            comment = reduce(or_, [F.startswith(text, F.lit(mark)) for mark in rules.LINE_COMMENTS[name]])
            hits = F.regexp_extract_all(F.col("line"), F.lit(pattern), F.lit(0))
            found = F.when((F.col("_lang") == name) & ~comment, hits).otherwise(found)
    meanings = rules.call_texts_df(lines.sparkSession, services, compat).withColumnsRenamed({"lang": "_lang", "text": "_text"})
    return (
        lines.withColumn("_lang", language_of(F.col("file")) if lang is None else lang)
        .filter(F.col("_lang").isNotNull())
        .select(*keep, "_lang", F.explode(found).alias("_text"))
        .join(F.broadcast(meanings), ["_lang", "_text"])
        .select(*keep, "service", "method", "endpoint")
    )


def match_scopes(calls: DataFrame) -> DataFrame:
    """Required scope of each call; calls without one are dropped (constant-size broadcast)."""
    return calls.join(F.broadcast(rules.endpoint_scopes_df(calls.sparkSession)), ["service", "endpoint"])


def scope_analysis(scoped: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """Per (by, service) of ``targets``: endpoints, used scopes, unused scopes, confidence, call count.

    Calls are counted per endpoint first, so what is gathered per service is bounded by
    the number of known endpoints, whatever the number of calls.
    """
    spark = scoped.sparkSession
    keys = [*by, "service"]
    per_endpoint = scoped.groupBy(*keys, "endpoint", "scope").agg(F.count("*").alias("n"))
    used = per_endpoint.groupBy(*keys).agg(
        F.sum("n").alias("calls"),
        F.sort_array(F.collect_set("endpoint")).alias("endpoints"),
        F.sort_array(F.collect_set("scope")).alias("scopes"),
    )
    every = rules.service_scopes_df(spark).groupBy("service").agg(F.sort_array(F.collect_list("scope")).alias("_all"))
    empty = F.array().cast("array<string>")
    return (
        targets.select(*keys).distinct()
        .join(used, keys, "left")
        .join(F.broadcast(every), "service", "left")
        .select(
            *keys,
            F.coalesce("calls", F.lit(0)).alias("calls"),
            F.coalesce("endpoints", empty).alias("endpoints"),
            F.coalesce("scopes", empty).alias("scopes"),
            F.array_except(F.coalesce("_all", empty), F.coalesce("scopes", empty)).alias("unused_scopes"),
            F.least(F.lit(0.5) + F.coalesce("calls", F.lit(0)) * F.lit(0.1), F.lit(0.99)).alias("confidence"),
        )
    )


def unused_scopes(required: DataFrame, by: list[str]) -> DataFrame:
    """Scopes of each (by, service) that no row of ``required`` (by, service, scope) asks for."""
    spark = required.sparkSession
    keys = [*by, "service"]
    pairs = required.select(*keys).distinct().join(F.broadcast(rules.service_scopes_df(spark)), "service")
    return pairs.select(*keys, "scope").join(required.select(*keys, "scope").distinct(), [*keys, "scope"], "left_anti")


def scope_summary(analysis: DataFrame, by: list[str]) -> DataFrame:
    """Per project: services, used scopes and the share of scopes that can be removed."""
    used, unused = F.sum(F.size("scopes")), F.sum(F.size("unused_scopes"))
    return analysis.groupBy(*by).agg(
        F.count("*").alias("total_services"),
        used.alias("total_scopes"),
        F.when(used + unused > 0, unused / (used + unused) * 100).otherwise(0.0).alias("optimization_potential"),
    )


def scope_suggestions(analysis: DataFrame) -> DataFrame:
    """Adds ``suggestions`` (array of messages) to a scope analysis."""
    n_used, n_unused = F.size("scopes"), F.size("unused_scopes")
    listed = F.array_join(F.slice("unused_scopes", 1, 3), ", ")
    more = F.when(n_unused > 3, F.lit("...")).otherwise(F.lit(""))
    service, scopes = F.col("service"), F.col("scopes")

    def some(text):
        return F.exists(scopes, lambda s: F.contains(s, F.lit(text)))

    messages = F.array(
        F.when(n_used == 0, F.concat(F.lit("No API calls detected for "), service, F.lit(". Consider removing this dependency.")))
        .otherwise(F.concat(F.lit("Detected "), F.col("calls").cast("string"), F.lit(" API call(s) requiring "),
                            n_used.cast("string"), F.lit(" scope(s)."))),
        F.when(n_unused > 0, F.concat(n_unused.cast("string"), F.lit(" scope(s) can be removed: "), listed, more)),
        F.when((service == "stripe") & some(":read") & ~some(":write"),
               F.lit("Consider using a read-only Stripe key for better security.")),
        F.when((service == "aws") & F.arrays_overlap(scopes, F.array(F.lit("s3:PutObject"), F.lit("s3:DeleteObject"))),
               F.lit("Consider using separate IAM roles for read and write operations on S3.")),
    )
    return analysis.withColumn("suggestions", F.array_compact(messages))


def analyze_projects(
    files: DataFrame, services: list[str], by: list[str] | None = None, compat: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(per-service analysis with suggestions, per-project summary) of (repo, file, content) rows."""
    by = by or ["repo"]
    spark = files.sparkSession
    calls = match_scopes(extract_api_calls(explode_lines(files), services, compat))
    listed = F.explode(F.array(*[F.lit(s) for s in services])).alias("service")
    targets = files.select(*by).distinct().select(*by, listed)
    analysis = scope_suggestions(scope_analysis(calls, targets, by))
    return analysis, scope_summary(analysis, by)
