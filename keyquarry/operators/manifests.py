"""Dependency manifests of six package ecosystems.

A manifest is one row; each parser is a column expression from its text to
``array<struct<dep, version>>`` in file order, so whole manifests are parsed in the
scan stage.  Only the short (project, file, dep, version) rows are shuffled, to let
a later mention of a name win over an earlier one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keyquarry.functions.text import WHITESPACE, trim_ws
from keyquarry.operators.services import detect_services

# White space other than a line feed, for patterns that must stay on one line.
_WS = "[" + WHITESPACE.replace("\n", "") + "]*"
_LINES = "(?md)"

# Names of the ecosystems per manifest file.
LANGUAGES = {
    "package.json": ("javascript", "npm"),
    "requirements.txt": ("python", "pip"),
    "go.mod": ("go", "go"),
    "Gemfile": ("ruby", "bundler"),
    "composer.json": ("php", "composer"),
    "Cargo.toml": ("rust", "cargo"),
}
# Line patterns.
REQUIREMENT = r"^([a-zA-Z0-9_-]+)(?:[=<>]=?.*)?$"
GO_MODULE = r"(?:require )?([\w.\-/]+)\s+v?([\d.]+)"
GEM = r"""gem\s+['"]([^'"]+)['"]\s*(?:,\s*['"]([^'"]+)['"])?"""
CRATE = r"""^([\w-]+)\s*=\s*"([^"]+)\""""

_PACKAGE = ("packageManager string, dependencies map<string,string>, "
            "devDependencies map<string,string>, _bad string")
_COMPOSER = "require map<string,string>, `require-dev` map<string,string>, _bad string"
_JSON_OPTIONS = {"columnNameOfCorruptRecord": "_bad"}


def _is_object(content: Column) -> Column:
    return F.startswith(F.ltrim(content, F.lit(WHITESPACE)), F.lit("{"))


def package_json(content: Column) -> Column:
    """Parsed only where the text can be a JSON object; null elsewhere."""
    return F.when(_is_object(content), F.from_json(content, _PACKAGE, _JSON_OPTIONS))


def composer_json(content: Column) -> Column:
    return F.when(_is_object(content), F.from_json(content, _COMPOSER, _JSON_OPTIONS))


def _lines(content: Column) -> Column:
    return F.transform(F.split(content, "\n", -1), trim_ws)


def _pairs(lines: Column, pattern: str, has_version: bool = True) -> Column:
    """(dep, version) of each line that matches; group 2 is the version, ``*`` if empty."""
    def pair(line):
        version = F.coalesce(F.nullif(F.regexp_extract(line, pattern, 2), F.lit("")), F.lit("*")) if has_version else F.lit("*")
        return F.struct(F.regexp_extract(line, pattern, 1).alias("dep"), version.alias("version"))

    return F.filter(F.transform(lines, pair), lambda p: p["dep"] != "")


def _entries(*maps: Column) -> Column:
    """Entries of JSON objects one after the other; a missing object has none."""
    none = F.from_json(F.lit("{}"), "map<string,string>")
    return F.concat(*[
        F.transform(
            F.map_entries(F.coalesce(m, none)), lambda e: F.struct(e["key"].alias("dep"), e["value"].alias("version"))
        )
        for m in maps
    ])


def package_manager(content: Column, parsed: Column | None = None) -> Column:
    """pnpm or yarn when the manifest names one, else npm."""
    named = (package_json(content) if parsed is None else parsed)["packageManager"]
    return F.when(F.startswith(named, F.lit("pnpm")), F.lit("pnpm")).when(
        F.startswith(named, F.lit("yarn")), F.lit("yarn")
    ).otherwise(F.lit("npm"))


def package_json_deps(content: Column, parsed: Column | None = None) -> Column:
    j = package_json(content) if parsed is None else parsed
    return _entries(j["dependencies"], j["devDependencies"])


def composer_deps(content: Column) -> Column:
    j = composer_json(content)
    return _entries(j["require"], j["require-dev"])


def requirements_deps(content: Column) -> Column:
    plain = F.filter(_lines(content), lambda s: (s != "") & ~F.startswith(s, F.lit("#")))
    return _pairs(plain, REQUIREMENT, has_version=False)


def gemfile_deps(content: Column) -> Column:
    plain = F.filter(_lines(content), lambda s: (s != "") & ~F.startswith(s, F.lit("#")))
    return _pairs(plain, GEM)


def _section_lines(content: Column, opens: str, closes: str, outside=None) -> Column:
    """Trimmed lines inside sections, in file order, with those outside that pass ``outside``.

    The text is cut at every opening line; what follows, up to the first closing
    line, is inside.
    """
    def others(text):
        return F.filter(_lines(text), outside) if outside else F.array().cast("array<string>")

    def piece(text, i):
        cut = F.split(text, f"{_LINES}^{_WS}{closes}{_WS}$", 2)
        rest = F.coalesce(F.try_element_at(cut, F.lit(2)), F.lit(""))
        return F.when(i > 0, F.concat(_lines(cut[0]), others(rest))).otherwise(others(text))

    return F.flatten(F.transform(F.split(content, f"{_LINES}^{_WS}{opens}{_WS}$", -1), piece))


def go_mod_deps(content: Column) -> Column:
    single = lambda s: F.startswith(s, F.lit("require "))
    return _pairs(_section_lines(content, r"require \(", r"\)", single), GO_MODULE)


def cargo_deps(content: Column) -> Column:
    return _pairs(_section_lines(content, r"\[(?:dev-)?dependencies\]", r"\[.*\]"), CRATE)


PARSERS = {
    "package.json": package_json_deps,
    "requirements.txt": requirements_deps,
    "go.mod": go_mod_deps,
    "Gemfile": gemfile_deps,
    "composer.json": composer_deps,
    "Cargo.toml": cargo_deps,
}


def detect_manifest_type(content: Column, parsed: Column | None = None) -> Column:
    """Type of a manifest from its text; null where no type fits or the JSON is broken."""
    def has(text):
        return F.contains(content, F.lit(text))

    pkg, com = package_json(content) if parsed is None else parsed, composer_json(content)
    as_json = F.when(pkg["_bad"].isNotNull(), F.lit(None).cast("string")).when(
        pkg["dependencies"].isNotNull() | pkg["devDependencies"].isNotNull(), F.lit("package.json")
    ).when(com["require"].isNotNull(), F.lit("composer.json"))
    return (
        F.when(_is_object(content) & has("dependencies"), as_json)
        .when(has("require (") | has("go "), F.lit("go.mod"))
        .when(has('gem "') | has("gem '"), F.lit("Gemfile"))
        .when(has("[dependencies]"), F.lit("Cargo.toml"))
        .otherwise(F.lit("requirements.txt"))
    )


def parse_deps(manifests: DataFrame, kind: str, content: str = "content") -> DataFrame:
    """Dependencies of manifests that are all of one ``kind``; of equal names the last one wins."""
    keep = [c for c in manifests.columns if c != content]
    rows = manifests.select(*keep, F.posexplode(PARSERS[kind](F.col(content))).alias("_pos", "_d"))
    return last_mention(rows.select(*keep, "_pos", "_d.*"), keep)


def last_mention(deps: DataFrame, by: list[str], order: str = "_pos") -> DataFrame:
    """Union with precedence: per (by, dep) the version with the highest ``order``."""
    return deps.groupBy(*by, "dep").agg(F.max_by("version", order).alias("version"))


def _typed(files: DataFrame, file_type: str | None) -> DataFrame:
    """Adds ``manifest_type`` and ``error`` (null when the file can be parsed)."""
    content = F.col("content")
    blank = F.coalesce(trim_ws(content), F.lit("")) == ""
    # JSON is parsed once per manifest and shared by detection, checks and parsing.
    files = files.withColumn("_json", package_json(content))
    kind = F.col(file_type) if file_type else detect_manifest_type(content, F.col("_json"))
    df = files.withColumn("manifest_type", F.when(~blank, kind))
    broken = ~_is_object(content) | F.col("_json._bad").isNotNull()
    expected = F.col("manifest_type").isin("package.json", "composer.json")
    if file_type is None:
        expected = expected | (_is_object(content) & F.contains(content, F.lit("dependencies")))
    bad = expected & broken
    return df.withColumn(
        "error",
        F.when(blank, F.lit("Cannot scan empty content"))
        .when(bad, F.lit("Failed to scan dependencies: invalid JSON"))
        .when(
            F.col("manifest_type").isNull() | ~F.col("manifest_type").isin(list(PARSERS)),
            F.lit("Failed to scan dependencies: Unsupported file type"),
        ),
    )


def scan_manifests(files: DataFrame, file_type: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dependencies, services, errors) of manifests of mixed types.

    The type is read from column ``file_type`` if named, else detected from the text.
    Broken manifests go to ``errors`` and do not stop the scan.
    """
    typed = _typed(files, file_type)
    kind = F.col("manifest_type")
    content = F.col("content")
    deps = None
    language, manager = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, parse in PARSERS.items():
        lang, pm = LANGUAGES[name]
        is_node = name == "package.json"
        parsed = F.when(kind == name, parse(content, F.col("_json")) if is_node else parse(content))
        deps = parsed if deps is None else F.coalesce(deps, parsed)
        language = F.when(kind == name, F.lit(lang)).otherwise(language)
        pm_col = package_manager(content, F.col("_json")) if is_node else F.lit(pm)
        manager = F.when(kind == name, pm_col).otherwise(manager)
    rows = typed.filter(F.col("error").isNull()).select(
        "project", "file", language.alias("language"), manager.alias("package_manager"),
        F.posexplode(deps).alias("_pos", "_d"),
    )
    by = ["project", "file", "language", "package_manager"]
    dependencies = last_mention(rows.select(*by, "_pos", "_d.*"), by)
    services = detect_services(dependencies, by=by)
    errors = typed.filter(F.col("error").isNotNull()).select("project", "file", "manifest_type", "error")
    return dependencies, services, errors


def section_carry(lines: DataFrame, marker: Column, by: list[str], order: str = "line_no") -> DataFrame:
    """Adds ``section``: the last non-null ``marker`` at or before each line of a file.

    A group is the lines of one file, which was one row before it was split.
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(marker, ignorenulls=True).over(w))
