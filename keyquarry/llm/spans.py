"""Where a pattern matches a text, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SLICE = 256
PLACE = "struct<start:int,end:int,value:string>"


def places(text: Column, pattern: Column, group: int = 0, size=F.length) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, value), in order.

    The pieces between the matches and the matches themselves are measured by ``size``
    and summed up.  ``value`` is the given group.  The pattern must not match an empty string.
    """
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(group))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.zip_with(F.slice(between, F.lit(1), F.size(whole)), whole, lambda p, m: F.struct(size(p).alias("gap"), size(m).alias("len"))),
                       values, lambda x, v: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), v.alias("value")))
    # Appending copies an array, so a long one is put together from slices.
    def slices(of: Column) -> Column:
        last = F.floor(F.greatest(F.size(of) - 1, F.lit(0)) / _SLICE).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(of, i * _SLICE + 1, F.lit(_SLICE)))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{PLACE}>").alias("found"))

    def add(state, x):
        a = state["at"] + x["gap"]
        b = a + x["len"]
        return F.struct(b.alias("at"), F.array_append(state["found"], F.struct(a.alias("start"), b.alias("end"), x["value"].alias("value"))).alias("found"))

    ends = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<off:int,found:array<{PLACE}>>>").alias("all"))

    def join(state, part):
        # the slice's places count from its own start
        return F.struct((state["at"] + part["at"]).alias("at"), F.array_append(state["all"], F.struct(state["at"].alias("off"), part["found"].alias("found"))).alias("all"))

    # within an array of one the steps are made once and not for every slice
    cut = F.element_at(F.transform(F.array(steps), slices), 1)
    parts = F.transform(cut, lambda s: F.aggregate(s, start, add))
    placed = F.aggregate(parts, ends, join, lambda s: s["all"])
    return F.flatten(F.transform(placed, lambda p: F.transform(p["found"], lambda m: F.struct(
        (m["start"] + p["off"]).alias("start"), (m["end"] + p["off"]).alias("end"), m["value"].alias("value")))))
