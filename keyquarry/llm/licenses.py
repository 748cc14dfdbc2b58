"""License detection by ordered signature rules, with built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from keyquarry.llm.common import LOWER, UPPER
from keyquarry.llm.spans import places

#: What stands between words once ASCII letters are lower case, what words consist of in any case, and what not.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
LETTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
ANY_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Phrases and labels that are always reported.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: The British spelling is written like the American one before the rules are tried.
LICENCE, LICENSE = "licence", "license"
#: Families as (label, names as word patterns, versions).  A version is part of the label.
FAMILIES = (
    ("mit", ("mit", "expat", "x11"), ()),
    ("apache", ("apache", "apache software", "asl"), ("1 0", "1 1", "2 0", "2")),
    ("gpl", ("gnu general public", "gpl", "gnu gpl"), ("1", "2", "3", "1 0", "2 0", "3 0")),
    ("lgpl", ("gnu lesser general public", "gnu library general public", "lgpl", "gnu lgpl"), ("2", "2 1", "3", "2 0", "3 0")),
    ("agpl", ("gnu affero general public", "agpl", "gnu agpl"), ("1", "3", "3 0")),
    ("gfdl", ("gnu free documentation", "gfdl"), ("1 1", "1 2", "1 3")),
    ("mpl", ("mozilla public", "mpl"), ("1 0", "1 1", "2 0")),
    ("epl", ("eclipse public", "epl"), ("1 0", "2 0")),
    ("cddl", ("common development and distribution", "cddl"), ("1 0", "1 1")),
    ("bsd", ("bsd", "modified bsd", "new bsd", "simplified bsd"), ("2 clause", "3 clause", "4 clause")),
    ("isc", ("isc",), ()),
    ("artistic", ("artistic",), ("1 0", "2 0")),
    ("zlib", ("zlib", "zlib libpng"), ()),
    ("boost", ("boost software", "bsl"), ("1 0",)),
    ("unlicense", ("unlicense",), ()),
    ("wtfpl", ("wtfpl", "do what the fuck you want to public"), ("2",)),
    ("eupl", ("european union public", "eupl"), ("1 0", "1 1", "1 2")),
    ("ms-pl", ("microsoft public", "ms pl"), ()),
    ("python", ("python software foundation", "psf"), ("2",)),
    ("ruby", ("ruby",), ()),
    ("php", ("php",), ("3 0", "3 01")),
    ("openssl", ("openssl",), ()),
    ("ofl", ("sil open font", "open font", "ofl"), ("1 0", "1 1")),
    ("odbl", ("open database", "odbl"), ("1 0",)),
    ("postgresql", ("postgresql",), ()),
)
#: Names that are also ordinary words or other things; a mere mention of these is no evidence.
ORDINARY = ("artistic", "expat", "ruby", "x11")
#: Families that are granted with or without later versions.
LATER = ("gpl", "lgpl", "agpl", "gfdl")
#: Short names that a version is joined to, as in GPLv2.
JOINED = ("agpl", "apache", "asl", "bsl", "cddl", "epl", "eupl", "gfdl", "gpl", "lgpl", "mpl", "odbl", "ofl", "wtfpl")
#: Sentences by which bodies and headers are known, as (label, gate, words).
SENTENCES = (
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("boost", "hereby", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("isc", "hereby", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", "hereby", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("python", "hereby", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", "redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice"),
    ("bsd-3-clause", "endorse", "nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("apache-2.0", "compliance", f"you may not use this file except in compliance with the {LICENSE}"),
    ("mpl-2.0", "mozilla", f"this source code form is subject to the terms of the mozilla public {LICENSE} v 2 0"),
    ("mpl-1.1", "mozilla", f"the contents of this file are subject to the mozilla public {LICENSE} version 1 1"),
    ("zlib", "plainly", "altered source versions must be plainly marked as such"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc0", "waived", "has waived all copyright and related or neighboring rights"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("php", "php", "this product includes php software freely available from"),
    ("gpl", "gnu", f"this program is free software you can redistribute it and or modify it under the terms of the gnu general public {LICENSE}"),
    ("lgpl", "gnu", f"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public {LICENSE}"),
    ("agpl", "gnu", f"this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public {LICENSE}"),
)
#: Forms of the public licences that are named by their conditions, and the versions these have.
CC_FORMS = (("cc-by", "by", "attribution"), ("cc-by-sa", "by sa", "attribution sharealike"), ("cc-by-nd", "by nd", "attribution noderivatives"),
            ("cc-by-nc", "by nc", "attribution noncommercial"), ("cc-by-nc-sa", "by nc sa", "attribution noncommercial sharealike"),
            ("cc-by-nc-nd", "by nc nd", "attribution noncommercial noderivatives"))
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Where the tag, a full grant, a plain mention stand in the order of rules.
TAG, GRANT, MENTION = 3, 2, 1


#: How a grant begins.
UNDER = "(?:licensed|released|distributed|published|available|provided|covered) under (?:the )?(?:terms of )?(?:the )?"
#: How later versions are allowed or not.
LATER_FORMS = (("or-later", "or (?:at your option )?(?:any )?(?:later|newer)(?: version)?"), ("only", "only"))


@dataclass(frozen=True)
class Rule:
    label: str
    gate: str        # a word that every match has
    pattern: str     # over words that are joined by single spaces
    priority: int


def _gate(name: str) -> str:
    return max(name.split(" "), key=len)


def rules() -> list[Rule]:
    """All signatures in order: families and versions as tags, in grants, with later versions, and as mentions; sentences of bodies and headers."""
    out = [Rule(label, gate, words, GRANT) for label, gate, words in SENTENCES]

    def named(label: str, name: str) -> None:
        out.append(Rule(label, "spdx", f"spdx {LICENSE} identifier {name}", TAG))
        out.append(Rule(label, "under", f"{UNDER}{name}(?: public)?(?: {LICENSE})?", GRANT))
        if name not in ORDINARY:
            out.append(Rule(label, LICENSE, f"{name} {LICENSE}", MENTION))

    for label, names, versions in FAMILIES:
        for name in names:
            named(label, name)
            for v in versions:
                if "clause" in v:
                    full = f"{label}-{v.replace(' ', '-')}"
                    out.append(Rule(full, _gate(name), f"(?:{UNDER})?{v} {name}(?: {LICENSE})?", GRANT))
                else:
                    full = f"{label}-{v.replace(' ', '.')}"
                one = f"(?:version |v ?)?{v}"
                out.append(Rule(full, "spdx", f"spdx {LICENSE} identifier {name} {v}", TAG))
                out.append(Rule(full, _gate(name), f"(?:{UNDER})?{name}(?: {LICENSE})? {one}", GRANT))
                if label in LATER:
                    for form, words in LATER_FORMS:
                        out.append(Rule(f"{full}-{form}", "spdx", f"spdx {LICENSE} identifier {name} {v} {form.replace('-', ' ')}", TAG))
                        out.append(Rule(f"{full}-{form}", _gate(name), f"(?:{UNDER})?{name}(?: {LICENSE})?(?: as published by the free software foundation)?(?: either)? {one}(?: of the {LICENSE})? {words}", GRANT))
    for label, short, long in CC_FORMS:
        for form in (f"cc {short}", f"creative commons {long}"):
            named(label, form)
            out.append(Rule(label, form.split(" ")[0], form, MENTION))
            out.extend(Rule(f"{label}-{v.replace(' ', '.')}", form.split(" ")[0], f"{form}(?: {v}| {LICENSE} {v}| international {v}| {v} international)", GRANT) for v in CC_VERSIONS)
    out += [Rule("cc0", "cc0", "cc0(?: 1 0)?", MENTION), Rule("public-domain", "domain", "(?:dedicated to|released into|in) the public domain", GRANT)]
    return out


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _count_words(text: Column) -> Column:
    """How many words the stretches between gaps make; those at an edge are empty where the text has a gap there."""
    pieces = F.split(text, f"{ANY_GAP}+", -1)
    count = lambda p: F.size(p) - F.when(F.get(p, F.lit(0)) == "", 1).otherwise(0) - F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0)
    return F.get(F.transform(F.array(pieces), count), F.lit(0))


def _phrase(words: str) -> str:
    """The phrase in a lower-case text, between borders of words."""
    inside = f"{GAP}+"
    return rf"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F]){inside.join(words.split(' '))}(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"


def _literal(found: list[Rule]) -> Column:
    """The rules as one constant array of structs."""
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    each = ", ".join(f"struct({q(r.label)} AS label, {q(r.gate)} AS gate, {q(f' {r.pattern}(?= )')} AS pattern, {r.priority} AS priority)" for r in found)
    return F.expr(f"array({each})")


def _present(words: Column, found: list[Rule]) -> Column:
    gates = sorted({r.gate for r in found})
    return F.array_distinct(F.regexp_extract_all(words, F.lit(f"(?<= )(?:{'|'.join(gates)})(?= )"), F.lit(0)))


def detections(words: Column, present: Column, found: list[Rule]) -> Column:
    """Detections that stand, as an array of (label, start, end, priority) over a text of words joined and enclosed by single spaces.

    Only rules whose gate is among ``present``, the gate words of the text, are tried, and only where one matches its places are taken.  A detection is dropped if its
    interval lies in that of one with higher priority, or of a longer one with the same; of
    equal ones the first label stays.  This takes one pass over the sorted intervals,
    which keeps the farthest end of each priority.
    """
    def tried(r):
        return F.transform(places(words, r["pattern"]), lambda m: F.struct(
            m["start"].alias("start"), (-m["end"]).alias("end"), (-r["priority"]).alias("priority"), r["label"].alias("label")))

    hits = F.array_sort(F.flatten(F.transform(F.filter(_literal(found), lambda r: F.array_contains(present, r["gate"]) & F.rlike(words, r["pattern"])), tried)))
    levels = (TAG, GRANT, MENTION)
    names = {p: f"to{p}" for p in levels}
    kind = "array<struct<label:string,start:int,end:int,priority:int>>"
    start = F.struct(*[F.lit(-1).alias(names[p]) for p in levels], F.array().cast(kind).alias("kept"))

    def add(s, x):
        end, priority = -x["end"], -x["priority"]
        higher = F.greatest(*[F.when(F.lit(p) >= priority, s[names[p]]).otherwise(F.lit(-1)) for p in levels])
        held = higher >= end
        kept = F.when(held, s["kept"]).otherwise(F.array_append(s["kept"], F.struct(
            x["label"].alias("label"), x["start"].alias("start"), end.alias("end"), priority.alias("priority"))))
        return F.struct(*[F.when(priority == p, F.greatest(s[names[p]], end)).otherwise(s[names[p]]).alias(names[p]) for p in levels], kept.alias("kept"))

    return F.aggregate(hits, start, add, lambda s: s["kept"])


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every whole text.

    The base phrases are found by their words; ``labels`` adds those of the signature rules
    that no stronger detection suppresses.  ``score`` is 0 without a label, and else the share of
    the strongest kind of evidence: 1 for a base phrase or a tag, 2/3 for a grant, 1/3 for a mention.
    A null or empty text has no words and no labels.  Repeated rows give the same result each;
    a null id stays; other columns are not read.  One scan, no exchange: texts without any gate word
    are only counted.
    """
    found = rules()
    gates = "|".join(sorted({r.gate for r in found} | {LICENCE} | {_gate(p) for p, _ in BASE} | {"cc"}))
    low = F.col("low")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("low", F.when(F.col("text").rlike(f"(?i)(?<!{LETTER})(?:{gates})(?:v[0-9]+)?(?!{LETTER})"), _lower(F.col("text"))))
    phrases = []
    for phrase, label in BASE:
        at = places(low, F.lit(_phrase(phrase)), size=lambda c: _count_words(c).cast("int"))
        hit = low.contains(_gate(phrase)) if _gate(phrase) != "under" else low.contains("mit")
        phrases.append(F.when(hit, F.transform(at, _labelled(label))).otherwise(F.array().cast("array<struct<start:int,label:string>>")))
    words = F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), f"{GAP}+", " ")
    words = F.replace(words, F.lit(f" {LICENCE} "), F.lit(f" {LICENSE} "))
    words = F.regexp_replace(words, f"(?<= )({'|'.join(JOINED)})(v[0-9]+)(?= )", "$1 $2")
    rows = rows.select("doc_id", "text", "low", words.alias("words")).withColumn("present", _present(F.col("words"), found))
    kind = "array<struct<label:string,start:int,end:int,priority:int>>"
    rows = rows.select(
        "doc_id", _count_words(F.col("text")).cast("bigint").alias("n_words"), F.concat(*phrases).alias("base"),
        F.when(F.size("present") > 0, detections(F.col("words"), F.col("present"), found)).otherwise(F.array().cast(kind)).alias("more"),
    )
    of_base, of_all = F.transform("base", lambda b: b["label"]), F.transform("more", lambda b: b["label"])
    best = F.greatest(F.coalesce(F.array_max(F.transform("more", lambda b: b["priority"])), F.lit(0)), F.when(F.size("base") > 0, F.lit(TAG)).otherwise(F.lit(0)))

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return rows.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["start"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["start"])).cast("bigint").alias("last_word"),
        joined(of_base).alias("base_labels"), joined(F.concat(of_base, of_all)).alias("labels"), (best / TAG).alias("score"),
    )


def _labelled(label: str):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(label).alias("label"))
