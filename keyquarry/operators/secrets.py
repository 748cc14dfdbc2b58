"""Leak scanning of text lines.

Patterns become one array expression, so a line is read once, nothing is joined
and nothing is shuffled.  Each pattern is tried only where its fixed text (the
needle) occurs: a plain substring search inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keyquarry import rules
from keyquarry.functions.text import WHITESPACE, any_of, shannon_entropy
from keyquarry.rules import SecretPattern
from keyquarry.sources.code import explode_lines


def is_scanned(line: Column, file: Column | None = None) -> Column:
    """False for comment lines and for example/template environment files."""
    t = F.ltrim(line, F.lit(WHITESPACE))
    ok = ~(F.startswith(t, F.lit("//")) | F.startswith(t, F.lit("#")))
    return ok if file is None else ok & ~F.coalesce(any_of(file, rules.SKIPPED_FILES), F.lit(False))


def _hits(line: Column, patterns: list[SecretPattern]) -> Column:
    """Array of struct(type, service, match, min_entropy), one per pattern that matches."""
    found = []
    for p in patterns:
        m = F.regexp_extract(line, p.regex, 0)
        guard = any_of(line, list(p.needles)) if p.needles else F.lit(True)
        found.append(
            F.when(
                guard & (m != ""),
                F.struct(
                    F.lit(p.type).alias("type"),
                    F.lit(p.service).cast("string").alias("service"),
                    m.alias("match"),
                    F.lit(p.min_entropy).cast("double").alias("min_entropy"),
                ),
            )
        )
    return F.array_compact(F.array(*found))


def _needles(patterns: list[SecretPattern]) -> list[str]:
    """Texts of which every line with a match holds one; empty if a pattern has no needle."""
    if not all(p.needles for p in patterns):
        return []
    every = {n for p in patterns for n in p.needles}
    return sorted(n for n in every if not any(m != n and m in n for m in every))


def scan_lines(
    lines: DataFrame,
    patterns: list[SecretPattern] | None = None,
    min_entropy: float | None = None,
    line: str = "line",
    file: str | None = "file",
) -> DataFrame:
    """Findings of a lines DataFrame: its other columns plus type, service, value, confidence.

    The first match of each pattern counts once per line; ``value`` is its first 20
    characters and ``...``.  With ``min_entropy`` (or a pattern's own) matches of lower
    Shannon entropy are dropped.
    """
    patterns = rules.SECRET_PATTERNS if patterns is None else patterns
    text = F.col(line)
    keep = [c for c in lines.columns if c != line]
    wanted = is_scanned(text, F.col(file) if file else None)
    needles = _needles(patterns)
    if needles:
        wanted = any_of(text, needles) & wanted
    hits = lines.filter(wanted).select(*keep, F.explode(_hits(text, patterns)).alias("_h"))
    if min_entropy is not None or any(p.min_entropy is not None for p in patterns):
        floor = F.coalesce(F.col("_h.min_entropy"), F.lit(min_entropy).cast("double"))
        hits = hits.filter(floor.isNull() | (shannon_entropy(F.col("_h.match")) >= floor))
    return hits.select(
        *keep,
        F.col("_h.type").alias("type"),
        F.col("_h.service").alias("service"),
        F.concat(F.left(F.col("_h.match"), F.lit(20)), F.lit("...")).alias("value"),
        F.lit(rules.SECRET_CONFIDENCE).alias("confidence"),
    )


def scan_texts(
    df: DataFrame,
    content: str = "content",
    file: str | None = "file",
    patterns: list[SecretPattern] | None = None,
    min_entropy: float | None = None,
) -> DataFrame:
    """Like ``scan_lines`` on whole texts; texts without any needle are never split into lines."""
    patterns = rules.SECRET_PATTERNS if patterns is None else patterns
    needles = _needles(patterns)
    if needles:
        df = df.filter(any_of(F.col(content), needles))
    return scan_lines(explode_lines(df, content), patterns, min_entropy, file=file)


def remediation_plan(findings: DataFrame) -> DataFrame:
    """One row per finding with a known service: the variable that should replace it."""
    return findings.filter(F.col("service").isNotNull() & (F.col("service") != "unknown")).select(
        "file",
        "line_no",
        "service",
        F.lit("production").alias("environment"),
        F.concat(F.upper("service"), F.lit("_API_KEY")).alias("env_var"),
    )


def finding_report(findings: DataFrame) -> DataFrame:
    return findings.select(
        "file",
        "line_no",
        "type",
        F.concat(F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%")).alias("confidence"),
    )


def scan_summary(findings: DataFrame) -> DataFrame:
    """Number of findings per file and type."""
    return findings.groupBy("file", "type").agg(F.count("*").alias("findings"))


def scan_verdict(findings: DataFrame) -> DataFrame:
    """One row: how many secrets were found and whether the check fails."""
    return findings.agg(F.count("*").alias("secrets_found")).withColumn(
        "fail", (F.col("secrets_found") > 0).cast("int")
    )
