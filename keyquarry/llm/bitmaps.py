"""Sets of numbers as bitmaps in rows, with built-in functions only: what marks rows without moving them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keyquarry.session import materialize

#: Numbers that stand for keys: a set of keys takes at most this many bits, whatever the data.
BITS = 1 << 24


def number_of(key: Column) -> Column:
    """A number for a key; different keys may share one."""
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def gathered(numbers: DataFrame, by: list[str], number: str) -> DataFrame:
    """(by, _part, _bits): the numbers (not negative) of each group, a row for every 32,768 that could be; written."""
    n = F.col(number) + 1
    return materialize(numbers.groupBy(*by, F.bitmap_bucket_number(n).alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("_bits")), "bitmaps")


def part_of(number: Column) -> Column:
    return F.bitmap_bucket_number(number + 1)


def holds(bits: Column, number: Column) -> Column:
    """Whether a bitmap (null: none) has the number."""
    at = F.bitmap_bit_position(number + 1)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def marked(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` with a column ``name``: false if ``key`` is surely none of ``keys`` (one column), true if it may be one.

    The set is broadcast: it has at most ``BITS`` bits, 2 MB.  The rows stay where they are.
    """
    number = number_of(key)
    column = keys.columns[0]
    bits = gathered(keys.select(number_of(F.col(f"`{column}`")).alias("_number")), [], "_number").select(F.col("_part").alias(f"{name}_part"), F.col("_bits").alias(f"{name}_bits"))
    joined = rows.join(F.broadcast(bits), part_of(number) == F.col(f"{name}_part"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], holds(F.col(f"{name}_bits"), number).alias(name))
