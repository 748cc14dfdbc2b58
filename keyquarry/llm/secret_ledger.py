"""Secret scans with a ledger of what has been scanned, with built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from keyquarry.llm.bitmaps import marked
from keyquarry.llm.spans import places
from keyquarry.session import materialize, new_path

SPAN = "struct<kind:string,start:int,end:int>"
LEDGER = f"blob string, rule string, spans array<{SPAN}>"


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    hint: str            # the text is looked at only if this matches somewhere
    pattern: str
    group: int = 0       # whose length counts
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The kinds in the order in which spans at the same place are listed.
BASE = (
    Rule("assign", 1, "(?i)passw(?:or)?d|secret|token|api_?key",
         r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, "AKIA", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, "[0-9a-f]{16}", r"[0-9a-f]{16,}"),
)
#: Kinds that this operator adds.
MORE = (
    Rule("github", 1, "gh[pousr]_", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, "xox[abprs]-", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", 1, "eyJ", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    # up to the END line of the same block; without one, header lines and what can be of the key
    Rule("key_block", 2, "PRIVATE KEY",
         r"-----BEGIN ([A-Z ]{0,20})PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1PRIVATE KEY-----"
         r"|(?:\r?\n[A-Za-z0-9-]+:[^\r\n]*)*+[A-Za-z0-9+/=\x20\r\n]*)"),
)
RULES = BASE + MORE


def _spans(text: Column, rule: Rule) -> Column:
    found = places(text, F.lit(rule.pattern), rule.group)
    if rule.least > 1:
        found = F.filter(found, lambda m: F.length(m["value"]) >= rule.least)
    spans = F.transform(found, lambda m: F.struct(F.lit(rule.kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    return F.when(text.rlike(rule.hint), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def blob(text: Column) -> Column:
    """The address of a version: the digest of its content; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def update(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> None:
    """Scans what the ledger at this path does not have yet and appends it.

    Every version (row) is addressed by its content, so copies are one blob.  Digests are
    exchanged, texts are not: a blob that has one row and is new is scanned where it lies.  Only texts that may
    have copies, or that the ledger may know, are joined to one within each task and exchanged. A blob is scanned only with the
    rule versions that the ledger lacks for it; what a scan found, also nothing, is recorded
    with the rule version, so a further run over the same history scans nothing.
    """
    spark = versions.sparkSession
    blobs = versions.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("blob", blob(F.col("text")))
    digests = materialize(blobs.groupBy("blob").agg(F.count("*").alias("n")), "digests")
    known = read(spark, ledger)
    wanted = [r.key for r in rules]
    apart = digests.filter("n > 1").select("blob")
    if known is not None:
        seen = known.filter(F.col("rule").isin(wanted)).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        apart = apart.union(digests.join(seen, "blob", "left_semi").select("blob"))
    rows = marked(blobs, F.col("blob"), apart, "moved")
    new = rows.filter("NOT moved").select("blob", "text").withColumn("seen", F.array().cast("array<string>"))
    one = rows.filter("moved").groupBy("blob").agg(F.first("text").alias("text"))
    if known is not None:
        one = one.join(seen, "blob", "left").filter(F.coalesce(F.size("seen"), F.lit(0)) < len(wanted))
    else:
        one = one.withColumn("seen", F.array().cast("array<string>"))

    def scanned(texts: DataFrame) -> DataFrame:
        entries = []
        for r in rules:
            lacking = ~F.coalesce(F.array_contains("seen", r.key), F.lit(False))
            entries.append(F.when(lacking, F.struct(F.lit(r.key).alias("rule"), _spans(F.col("text"), r).alias("spans"))))
        found = texts.select("blob", F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e"))
        return found.select("blob", "e.rule", "e.spans")

    scanned(new).unionByName(scanned(one)).write.mode("append").parquet(ledger)


def read(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger, or None if nothing was written there yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(LEDGER).parquet(ledger)


def hits(spark: SparkSession, ledger: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, s) with a row for every span of the rules; what two runs recorded for a pair of blob and rule counts once."""
    pairs = read(spark, ledger).filter(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0))
    return pairs.groupBy("blob", "rule").agg(F.first("spans").alias("spans")).select("blob", F.explode("spans").alias("s"))


def findings(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: list[str] | None = None,
             name: str = "spans") -> DataFrame:
    """``keep`` columns of every version (path) with the spans of its content, ordered by start, then by the rules' order.

    Only blobs with a finding take part in the join, and of the paths digests and ``keep``; one that very many paths share can be
    split by the planner, since it has one row on the ledger's side.
    """
    keep = ["doc_id"] if keep is None else keep
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    found = hits(versions.sparkSession, ledger, rules).groupBy(F.col("blob").alias(f"{name}_key")).agg(
        F.array_sort(F.collect_list(F.struct("s.start", order[F.col("s.kind")].alias("nth"), "s.end", "s.kind"))).alias(f"{name}_hits"))
    paths = versions.select(*[F.col(f"`{c}`") for c in keep], blob(F.col(f"`{text}`")).alias(f"{name}_blob"))
    joined = paths.join(found, F.col(f"{name}_blob") == F.col(f"{name}_key"), "left")
    spans = F.transform(F.coalesce(f"{name}_hits", F.array().cast("array<struct<start:int,nth:int,end:int,kind:string>>")),
                        lambda h: F.struct(h["kind"].alias("kind"), h["start"].alias("start"), h["end"].alias("end")))
    return joined.select(*[F.col(f"`{c}`") for c in keep], spans.alias(name))


def listed(spans: Column) -> Column:
    """``kind:start:end`` texts, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every whole text.

    Without ``ledger`` a new one is begun in the shared folder.  Null and empty texts have no
    spans (the digest of no bytes); copies and repeated rows get the same spans each; a null
    id is a path like any other; other columns are not read.
    """
    ledger = ledger or new_path(docs.sparkSession, "secret-ledger")
    rows = docs.select("doc_id", "text")
    update(rows, ledger, rules)
    found = findings(rows, ledger, rules)
    kinds = [r.kind for r in base]
    of_base = F.filter("spans", lambda s: s["kind"].isin(kinds))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in kinds]
    return found.select("doc_id", *counts, F.sha2(listed(of_base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


_BLOCK = 4096       # code points of a text that are put together at once


def _merged(spans: DataFrame) -> DataFrame:
    """(blob, cuts): the spans of each blob as intervals that do not overlap, in order; what only touches stays apart."""
    by = Window.partitionBy("blob").orderBy("start", "end")
    upto = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    begun = spans.withColumn("new", F.when(F.col("start") < upto, 0).otherwise(1)).withColumn("nth", F.sum("new").over(by))
    each = begun.groupBy("blob", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return each.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))


def _cut(rows: DataFrame, text: Column, mark: str) -> DataFrame:
    """(_id, _clean) of rows (_id, text, _cuts): every interval replaced by ``mark``.

    Texts are taken apart into blocks, so that no step copies a long text for every span.
    """
    blocks = rows.select("_id", F.posexplode(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))).alias("_nth", "_block"))
    cuts = rows.select("_id", F.explode("_cuts").alias("_c"))
    first, last = (F.floor(c / _BLOCK).cast("int") for c in (F.col("_c.start"), F.col("_c.end") - 1))
    spread = cuts.select("_id", "_c", first.alias("_first"), F.explode(F.sequence(first, last)).alias("_of"))
    local = F.struct(F.greatest(F.col("_c.start") - F.col("_of") * _BLOCK, F.lit(0)).alias("a"),
                     F.least(F.col("_c.end") - F.col("_of") * _BLOCK, F.lit(_BLOCK)).alias("b"), (F.col("_of") == F.col("_first")).alias("head"))
    own = spread.groupBy(F.col("_id").alias("_in"), "_of").agg(F.array_sort(F.collect_list(local)).alias("_pieces"))
    joined = blocks.join(own, (F.col("_id") == F.col("_in")) & (F.col("_nth") == F.col("_of")), "left")
    block = F.col("_block")

    def step(state, x):
        out = F.concat(state["out"], F.substring(block, state["at"] + 1, x["a"] - state["at"]), F.when(x["head"], F.lit(mark)).otherwise(F.lit("")))
        return F.struct(x["b"].alias("at"), out.alias("out"))

    left = F.aggregate("_pieces", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                       lambda s: F.concat(s["out"], F.substring(block, s["at"] + 1, F.lit(_BLOCK))))
    done = joined.select("_id", F.struct("_nth", F.coalesce(left, block).alias("_t")).alias("_p"))
    return done.groupBy("_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_p")), lambda p: p["_t"]), "").alias("_clean"))


def redact(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, mark: str = "[REDACTED]", text: str = "text",
           n_chars: str = "n_chars") -> DataFrame:
    """The rows with all their columns, each secret in ``text`` replaced by ``mark`` (overlapping ones by one); ``n_chars`` follows the text.

    Null and empty texts and texts without a secret pass as they are, and rows with them are
    not moved; copies and repeated rows are cut alike; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ledger = ledger or new_path(spark, "secret-ledger")
    update(docs, ledger, rules, text)
    cuts = materialize(_merged(hits(spark, ledger, rules).select("blob", "s.start", "s.end").distinct()), "secret-cuts")
    name = "_spans" + "_" * max(len(c) for c in docs.columns)   # longer than any column's name
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own = F.col(f"`{text}`")
    rows = marked(docs, blob(own), cuts.select("blob"), name)
    plain = rows.filter(~F.col(name)).select(*columns)
    # the few others are written with a number, then cut
    named = [f"c{i}" for i in range(len(docs.columns))]
    some = rows.filter(F.col(name)).select(*[c.alias(n) for c, n in zip(columns, named)], blob(own).alias("_blob"))
    some = some.join(cuts, F.col("_blob") == F.col("blob"), "left").drop("_blob", "blob").withColumnRenamed("cuts", "_cuts")
    some = materialize(some.withColumn("_id", F.monotonically_increasing_id()), "secret-rows")
    of = F.col(named[docs.columns.index(text)])
    clean = _cut(some.filter(F.col("_cuts").isNotNull()).select("_id", of.alias("_text"), "_cuts"), F.col("_text"), mark).withColumnRenamed("_id", "_of")
    joined = some.join(clean, F.col("_id") == F.col("_of"), "left")
    out = []
    for c, n in zip(docs.columns, named):
        value = F.col(n)
        if c == text:
            value = F.coalesce("_clean", value)
        elif c == n_chars:
            value = F.when(F.col("_clean").isNotNull(), F.length("_clean").cast(docs.schema[c].dataType)).otherwise(value)
        out.append(value.alias(c))
    return plain.unionByName(joined.select(*out))
