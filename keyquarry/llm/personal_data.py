"""Personal data: fixed forms found by pattern, and others found by the contexts that the fixed forms stand in."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from keyquarry.llm.secret_ledger import SPAN, listed
from keyquarry.session import materialize

#: The kinds, in the order in which spans at the same place are listed.
KINDS = ("email", "ip", "card", "phone")
#: What contexts add, by kind.
NEAR = tuple(f"near_{k}" for k in KINDS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")
#: Identifier-like forms that the fixed kinds leave out, each with the kinds it can be.
_AT = re.compile(r"@|\x20?[\[({]at[\])}]\x20?", re.I)
_PLACE = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[({]dot[\])}]\x20?|\.)[A-Za-z0-9-]{1,63}){0,6}", re.I)
_HEX = re.compile(r"(?<![\w:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![\w:])")
_NUMBER = re.compile(r"(?<!\w)(?:[A-Z]{1,4}[\x20-]?)?[0-9]++(?:[\x20./()-]{1,2}[0-9]++)*+")
_WORDS = re.compile(r"[^\W\d_]+|[:=#\n]")
_LEFT, _RIGHT = 80, 40      # signs of context that are looked at

MARK = "struct<kind:int,fits:int,start:int,end:int,value:string,contexts:array<string>>"


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail form, found from each @, so that long runs of letters cost nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        after = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            after = m.end()
        done = after
        at = text.find("@", after)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Four numbers of at most 255 joined by dots; a longer chain is taken four by four."""
    out = []
    if text.count(".") < 3:
        return out
    for m in _CHAIN.finditer(text):
        numbers, at = m[0].split("."), m.start()
        for i in range(0, len(numbers) - 3, 4):
            four = numbers[i:i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(n.lstrip("0")) <= 3 and int(n.lstrip("0") or 0) <= 255 for n in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    twice = "0246813579"
    return (sum(map(int, digits[-1::-2])) + sum(int(twice[int(d)]) for d in digits[-2::-2])) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]


_FINDERS = (emails, addresses, cards, phones)


def _others(text: str) -> list[tuple[int, int, int]]:
    """(start, end, set of kinds as bits) of identifier-like forms."""
    out = []
    for m in _AT.finditer(text):
        start = m.start()
        while start > max(0, m.start() - 64) and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start() and (place := _PLACE.match(text, m.end())):
            out.append((start, place.end(), 1))
    out += [(*m.span(), 2) for m in _HEX.finditer(text)]
    for m in _NUMBER.finditer(text):
        if m.end() < len(text) and (text[m.end()].isalnum() or text[m.end()] == "_"):
            continue
        n = len(_DIGITS.findall(m[0]))
        if fits := 4 * (8 <= n <= 24 or m[0][0].isalpha() and 4 <= n) + 8 * (6 <= n <= 15 and not m[0][0].isalpha()):
            out.append((*m.span(), fits))
    return out


def _value(text: str) -> str:
    """What two writings of one identifier share, as a digest: no personal data is written anywhere."""
    plain = re.sub(r"[^a-z0-9@]", "", text.lower()) if "@" in text else re.sub(r"[^a-z0-9:]", "", text.lower())
    return hashlib.blake2b(plain.encode(), digest_size=8).hexdigest()


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a place: up to three words before it, or the words on both sides."""
    left = _WORDS.findall(text[max(0, start - _LEFT):start].lower())[-3:]
    right = _WORDS.findall(text[end:end + _RIGHT].lower())[:1]
    out = [" ".join(left[-n:]) + " _" for n in range(1, len(left) + 1) if n > 1 or len(left[-1]) > 2]
    return out + ([f"{left[-1]} _ {right[0]}"] if left and right else [])


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple]]:
    """(base spans as (start, kind, end) in order, marks of all identifier-like places with their contexts)."""
    base = sorted((a, k, b) for k, finder in enumerate(_FINDERS) for a, b in finder(text))
    marks = [(k, 0, a, b, _value(text[a:b]), contexts(text, a, b)) for a, k, b in base]
    taken = iter([*base, (len(text) + 1, 0, len(text) + 1)])
    upto, ahead = 0, next(taken)
    last = 0
    for a, b, fits in sorted(_others(text)):
        while ahead[0] < b:                        # base spans that begin before this form ends
            upto, ahead = max(upto, ahead[2]), next(taken)
        if a >= upto and a >= last:
            marks.append((-1, fits, a, b, _value(text[a:b]), contexts(text, a, b)))
            last = b
    return base, marks


def mark(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``_row`` (a number of the row), base spans and marks of every whole text, written to the shared folder."""
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    spans, marks = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.struct([
        ("kind", pa.int32()), ("fits", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("contexts", pa.list_(pa.string()))]))

    def run(batches):
        for batch in batches:
            found = [find(t or "") for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:len(keep)],
                pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in base] for base, _ in found], spans),
                pa.array([[dict(zip(("kind", "fits", "start", "end", "value", "contexts"), m)) for m in marked] for _, marked in found], marks),
            ], [*keep, "_base", "_marks"])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    out = rows.mapInArrow(run, ", ".join([*kinds, f"_base array<{SPAN}>", f"_marks array<{MARK}>"]))
    return materialize(out.withColumn("_row", F.monotonically_increasing_id()), "personal-data")


def bootstrap(marked: DataFrame, rounds: int = 3, least: int = 5, confidence: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(patterns: context, kind, confidence, values; identifiers: value, kind) after some rounds over the graph of contexts and values.

    Seeds (values of a base form) are trusted, other values not at all at first.  Each round scores
    every context by kind: the trust of its distinct values over their number plus one; a context of at least
    ``least`` values that reaches ``confidence`` is a pattern.  A value that is no seed is trusted
    for a kind it can be as 1 - the product of (1 - confidence) over its patterns.  Copies
    of a document do not count, as edges are distinct.  Sums are of integers, so a task that
    runs again gives the same numbers.
    """
    places = marked.select(F.explode("_marks").alias("m")).select("m.kind", "m.fits", "m.value", "m.contexts")
    edges = places.select("value", F.explode("contexts").alias("context")).distinct()
    wide = edges.groupBy("context").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    edges = materialize(edges.join(wide, "context").select("context", "n", "value"), "context-edges")
    seeds = places.groupBy("value").agg(F.max("kind").alias("kind"), F.bit_or("fits").alias("fits"))
    names = [f"t{k}" for k in range(len(KINDS))]
    nodes = materialize(seeds.select("value", "kind", "fits", *[
        F.when(F.col("kind") == k, F.lit(1_000_000)).otherwise(F.lit(0)).cast("bigint").alias(t) for k, t in enumerate(names)]), "values")
    limit = int(confidence * 1_000_000)

    def scored(nodes: DataFrame) -> DataFrame:
        sums = edges.join(nodes, "value").groupBy("context").agg(F.first("n").alias("n"), *[F.sum(t).alias(t) for t in names])
        sure = [F.when(F.floor(F.col(t) / (F.col("n") + 1)) >= limit, F.floor(F.col(t) / (F.col("n") + 1))).otherwise(F.lit(0)).cast("bigint") for t in names]
        out = sums.select("context", "n", *[c.alias(t) for c, t in zip(sure, names)])
        return out.filter(F.greatest(*names) > 0)

    patterns = materialize(scored(nodes), "patterns")
    for _ in range(rounds):
        doubt = [F.sum(F.round(-F.log(1 - F.col(t) / 1_000_000) * 1_000_000).cast("bigint")).alias(f"d{k}") for k, t in enumerate(names)]
        reached = edges.join(patterns.drop("n"), "context").groupBy("value").agg(*doubt)
        trust = [F.when(F.col("kind") >= 0, F.col(t)).when(
            F.col("fits").bitwiseAND(F.lit(1 << k)) > 0, F.round((1 - F.exp(-F.coalesce(f"d{k}", F.lit(0)) / 1_000_000)) * 1_000_000).cast("bigint")
        ).otherwise(F.lit(0).cast("bigint")).alias(t) for k, t in enumerate(names)]
        nodes = materialize(nodes.join(reached, "value", "left").select("value", "kind", "fits", *trust), "values")
        patterns = materialize(scored(nodes), "patterns")
    best = F.greatest(*names)

    def kind_of(top: Column) -> Column:
        return F.coalesce(*[F.when(F.col(t) == top, F.lit(k)) for k, t in enumerate(names)])

    identifiers = nodes.filter(best >= limit).select("value", kind_of(best).alias("kind"))
    return patterns.select("context", kind_of(best).alias("kind"), (best / 1_000_000).alias("confidence"), F.col("n").alias("values")), identifiers


def extract(docs: DataFrame, keep: list[str], text: str = "text", name: str = "spans", **options) -> DataFrame:
    """``keep`` columns, ``base`` spans of the fixed forms and all spans, (kind, start, end) by start, then kind.

    Null counts as empty; empty texts have no spans; repeated rows get the same spans each; an
    empty table gives no rows.  Ids are not looked at, and other columns are not read.
    """
    marked = mark(docs, keep, text)
    identifiers = materialize(bootstrap(marked, **options)[1], "identifiers")
    other = marked.select("_row", F.explode(F.filter("_marks", lambda m: m["kind"] < 0)).alias("_m")).select("_row", "_m.start", "_m.end", "_m.value", "_m.fits")
    near = F.element_at(F.array(*[F.lit(n) for n in NEAR]), F.col("kind") + 1)
    hits = other.join(identifiers, "value").filter(F.expr("shiftright(fits, kind) & 1 = 1")).select("_row", F.struct(near.alias("kind"), "start", "end").alias("_s"))
    more = materialize(hits.groupBy(F.col("_row").alias("_of")).agg(F.collect_list("_s").alias("_more")), "discovered")
    order = F.create_map(*[F.lit(x) for i, k in enumerate((*KINDS, *NEAR)) for x in (k, i)])
    every = F.array_sort(F.transform(F.concat("_base", F.coalesce("_more", F.array().cast(f"array<{SPAN}>"))), lambda s: F.struct(
        s["start"].alias("start"), order[s["kind"]].alias("nth"), s["end"].alias("end"), s["kind"].alias("kind"))))
    every = F.transform(every, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    joined = marked.join(more, F.col("_row") == F.col("_of"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in keep], F.col("_base").alias("base"), every.alias(name))


def scan(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every whole text; odd rows as in ``extract``."""
    found = extract(docs, ["doc_id"], **options)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
