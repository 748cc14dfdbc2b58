"""Ordered computations that stay parallel when one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keyquarry.session import materialize

#: Hashes of keys by which ``running_max`` counts rows; a power of two.
_BUCKETS = 1 << 16


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the highest ``order`` per key, by partial aggregation: a task hands on one row per key (it sorts its own rows for that)."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def running_count(
    df: DataFrame, keys: list[str], ts: str, order: str, name: str = "nth", slice_seconds: int = 60
) -> DataFrame:
    """Adds the 1-based position of each row within its key, in (ts, order).

    Rows are ranked inside (key, time slice), and the slices, counted by partial
    aggregation, are ranked per key: a key with most of the rows is spread over its
    slices.  Only the slice counts of a key meet in one task.
    """
    sliced = df.withColumn("_slice", F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / slice_seconds))
    counts = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(ts, order)
    same = F.lit(True)
    for c in (*keys, "_slice"):     # rows without a key or a time are rows like others
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}"))
    return (
        sliced.withColumn("_rank", F.row_number().over(inside))
        .alias("r").join(offsets.alias("o"), same, "left")
        .select(*[F.col(f"r.{c}") for c in df.columns], (F.col("o._before") + F.col("r._rank")).alias(name))
    )


def running_max(
    df: DataFrame, keys: list[str], ts: str, order: str, values: dict[str, str], slice_seconds: int = 3600, room: int = 100_000,
) -> DataFrame:
    """Adds, for each name, the largest value of the column it stands for among the key's rows up to and with each row, in (ts, order).

    Null is no value.  Rows are counted by ``_BUCKETS`` hashes of their keys first.  A key meets in one task, and its rows are
    moved once, unless its hash has more than ``room`` rows and over four times the mean: such keys go in two levels as in
    ``running_count``, where a key is spread over its slices, and only one row a slice meets the others of its key.
    """
    marked = df.withColumn("_bucket", F.xxhash64(*keys).bitwiseAND(F.lit(_BUCKETS - 1)))
    # all columns are read, so that this shares the exchanges below with the rows themselves
    counts = marked.groupBy("_bucket").agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).alias("_any"))
    over = (F.col("_n") > room) & (F.col("_n") * _BUCKETS > 4 * F.sum("_n").over(Window.partitionBy())) & F.col("_any").isNotNull()
    large = F.broadcast(counts.select("_bucket", over.alias("_large")).filter("_large"))
    upto = Window.partitionBy(*keys).orderBy(ts, order).rowsBetween(Window.unboundedPreceding, 0)
    whole = marked.join(large, "_bucket", "left").filter(F.col("_large").isNull()).select(*df.columns)
    cut = marked.join(large, "_bucket").select(*df.columns)
    return whole.select("*", *[F.max(c).over(upto).alias(n) for n, c in values.items()]).unionByName(_sliced_max(cut, keys, ts, order, values, slice_seconds))


def _sliced_max(df: DataFrame, keys: list[str], ts: str, order: str, values: dict[str, str], slice_seconds: int) -> DataFrame:
    """``running_max`` in two levels, for keys with very many rows."""
    sliced = df.withColumn("_slice", F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / slice_seconds))
    tops = sliced.groupBy(*keys, "_slice").agg(*[F.max(c).alias(f"_top_{n}") for n, c in values.items()])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_slice").alias("_of__slice"),
                          *[F.max(f"_top_{n}").over(before).alias(f"_carry_{n}") for n in values])
    inside = Window.partitionBy(*keys, "_slice").orderBy(ts, order).rowsBetween(Window.unboundedPreceding, 0)
    own = sliced.select("*", *[F.max(c).over(inside).alias(f"_own_{n}") for n, c in values.items()])
    joined = own.join(carried, _same([*keys, "_slice"], [f"_of_{k}" for k in (*keys, "_slice")]), "left")
    return joined.select(*df.columns, *[F.greatest(f"_carry_{n}", f"_own_{n}").alias(n) for n in values])


def _same(left: list[str], right: list[str]) -> Column:
    """Equal keys; a null key is a key like others."""
    same = F.lit(True)
    for a, b in zip(left, right):
        same = same & F.col(a).eqNullSafe(F.col(b))
    return same


def exact_rank_percentiles(
    df: DataFrame, by: list[str], value: str, ps: dict[str, float], accuracy: int = 10000, extra: list[Column] | None = None,
) -> DataFrame:
    """Exact element at 0-based rank ``floor(n * p)`` for each named ``p`` per group.

    Every group stays, also the one without a key; one without values (null and NaN are none) has null ranks.
    No group is sorted or shuffled whole, and the rows are read twice.  First a mergeable
    sketch brackets every wanted rank (and takes the ``extra`` aggregates along).  Then one pass counts
    the rows between the bounds of all brackets and the values inside them, a row giving one
    key whatever the number of ranks.  What is left of a group, about 4 / ``accuracy`` of its rows for
    each rank and no more than its distinct values, is put in order by one task, and the running count gives the elements.
    Where it shows that a rank lies outside its bracket, as the sketch was off, the bracket
    is widened to the whole group and such groups are read again.  Raise ``accuracy`` for groups of over 10**10 rows.
    """
    step, n = 2.0 / accuracy, len(ps)
    wanted = [q for p in ps.values() for q in (max(p - step, 0.0), min(p + step, 1.0))]
    number = F.col(f"`{value}`").cast("double")
    keys = [f"_by{i}" for i in range(len(by))]
    marks = [f"_{k}" for k in keys]
    keyed = df.withColumns({k: F.col(f"`{c}`") for k, c in zip(keys, by)}).withColumn("_v", F.when(~F.isnan(number), number))
    titles = df.agg(*extra).columns if extra else []
    spine = materialize(
        keyed.groupBy(*keys).agg(
            F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
            F.percentile_approx("_v", wanted, accuracy).alias("_q"), *[c.alias(f"_extra{i}") for i, c in enumerate(extra or [])]), "sketch")
    small = F.col("_n") <= 4 * accuracy          # the sketch error is under one rank: take all
    rows = keyed.select(*keys, "_v").filter(F.col("_v").isNotNull())
    brackets = spine.filter(F.col("_n") > 0).select(
        *[F.col(k).alias(m) for k, m in zip(keys, marks)],
        *[c for i, p in enumerate(ps.values()) for c in (
            (F.floor(F.col("_n") * F.lit(float(p))) + 1).alias(f"_k{i}"),
            F.when(small, F.col("_min")).otherwise(F.element_at("_q", 2 * i + 1)).alias(f"_lo{i}"),
            F.when(small, F.col("_max")).otherwise(F.element_at("_q", 2 * i + 2)).alias(f"_hi{i}"))],
        "_min", "_max")
    found = materialize(_ranks(rows, brackets, keys, n), "ranks")
    missed = found.filter("_off").select(*[F.col(k).alias(f"_{m}") for k, m in zip(keys, marks)])
    if not missed.isEmpty():
        wide = [c for i in range(n) for c in (F.col(f"_k{i}"), F.col("_min").alias(f"_lo{i}"), F.col("_max").alias(f"_hi{i}"))]
        again = brackets.join(missed, _same(marks, [f"_{m}" for m in marks])).select(*marks, *wide)
        found = found.filter("NOT _off").unionByName(materialize(_ranks(rows, again, keys, n), "ranks"))
    found = found.select(*[F.col(k).alias(m) for k, m in zip(keys, marks)], *[f"_r{i}" for i in range(n)])
    return spine.join(found, _same(keys, marks), "left").select(
        *[F.col(k).alias(c) for k, c in zip(keys, by)], *[F.col(f"_extra{i}").alias(t) for i, t in enumerate(titles)],
        *[F.col(f"_r{i}").alias(name) for i, name in enumerate(ps)])


def _ranks(rows: DataFrame, brackets: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, _r0, …, _off): the wanted elements, and whether one of them lies outside its bracket.

    A value inside a bracket is an entry by itself; outside, all values between two
    neighbouring bounds are one entry, in place behind the lower one.
    """
    marks, v = [f"_{k}" for k in keys], F.col("_v")
    inside, below = F.lit(False), F.lit(0)
    for i in range(n):
        inside = inside | ((v >= F.col(f"_lo{i}")) & (v <= F.col(f"_hi{i}")))
        below = below + (F.col(f"_lo{i}") < v).cast("int") + (F.col(f"_hi{i}") < v).cast("int")
    joined = rows.join(brackets, _same(keys, marks))
    counts = joined.select(*keys, F.when(inside, v).alias("_x"), F.when(~inside, below).alias("_seg")).groupBy(*keys, "_x", "_seg").agg(F.count("*").alias("_c"))
    bounds = F.array_sort(F.array(*[F.col(f"_{side}{i}") for i in range(n) for side in ("lo", "hi")]))
    at = F.coalesce("_x", F.when(F.col("_seg") > 0, F.element_at(bounds, F.greatest("_seg", F.lit(1)))), F.lit(float("-inf")))
    entries = counts.join(brackets, _same(keys, marks)).select(*keys, "_x", "_c", at.alias("_at"), F.col("_x").isNull().alias("_out"), *[f"_k{i}" for i in range(n)])
    upto = entries.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_at", "_out")))
    first = [F.min(F.when(F.col("_upto") >= F.col(f"_k{i}"), F.struct("_at", "_out", "_x"))) for i in range(n)]
    off = F.lit(False)
    for i in range(n):
        off = off | F.col(f"_f{i}._out")
    return upto.groupBy(*keys).agg(*[f.alias(f"_f{i}") for i, f in enumerate(first)]).select(
        *keys, *[F.col(f"_f{i}._x").alias(f"_r{i}") for i in range(n)], off.alias("_off"))
