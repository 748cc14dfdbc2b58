"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from keyquarry import rules

# The characters that count as white space when lines are trimmed.
WHITESPACE = "\t\n\x0b\x0c\r \xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)


def trim_ws(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(WHITESPACE))


def any_of(c: Column, words: list[str]) -> Column:
    """Does ``c`` contain any of ``words``?"""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def first_match(c: Column, table: list[tuple[str, list[str]]]) -> Column:
    """Name of the first entry with a word contained in ``c``; null if none."""
    return F.coalesce(*[F.when(any_of(c, words), F.lit(name)) for name, words in table])


def mask_secret(c: Column, visible: int = 4) -> Column:
    """Keep ``visible`` characters at both ends; short values are masked whole."""
    n = F.length(c)
    middle = F.repeat(F.lit("*"), n - 2 * visible)
    return F.when(n <= 2 * visible, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.left(c, F.lit(visible)), middle, F.right(c, F.lit(visible)))
    )


def sanitize(c: Column, limit: int = 1000) -> Column:
    """Trim, drop angle brackets, keep the first ``limit`` characters."""
    return F.left(F.translate(trim_ws(c), "<>", ""), F.lit(limit))


def is_valid_environment(c: Column) -> Column:
    return c.isin(rules.ENVIRONMENTS)


def classify_key_prefix(c: Column) -> Column:
    """Issuing service of a key value; longer prefixes are tried first."""
    by_length = sorted(rules.KEY_PREFIXES.items(), key=lambda kv: -len(kv[1]))
    return F.coalesce(*[F.when(F.startswith(c, F.lit(p)), F.lit(s)) for s, p in by_length])


def shannon_entropy(c: Column) -> Column:
    """Bits per character of a string."""
    n = F.greatest(F.length(c), F.lit(1))
    counts = F.transform(
        F.array_distinct(F.split(c, "")), lambda ch: (n - F.length(F.replace(c, ch, F.lit("")))) / n
    )
    used = F.filter(counts, lambda p: p > 0)
    return F.aggregate(used, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def parse_env_line(line: Column) -> Column:
    """struct(key, value) of ``KEY=value``; null for blanks, comments and empty keys."""
    t = trim_ws(line)
    key = F.substring_index(t, "=", 1)
    value = F.when(F.contains(t, F.lit("=")), F.substr(t, F.length(key) + 2)).otherwise(F.lit(""))
    usable = (t != "") & ~F.startswith(t, F.lit("#")) & (key != "")
    return F.when(usable, F.struct(trim_ws(key).alias("key"), value.alias("value")))


def parse_tags(c: Column) -> Column:
    """``'a, b,'`` -> ``['a', 'b']``."""
    return F.filter(F.transform(F.split(c, ","), trim_ws), lambda x: x != "")


def json_array(c: Column) -> Column:
    """JSON text array -> array<string>; null or empty text is the empty array."""
    return F.from_json(F.coalesce(F.nullif(c, F.lit("")), F.lit("[]")), "array<string>")


def env_quoted(value: Column) -> Column:
    """Quote a value for an env file iff it has white space or ``#``."""
    needs = F.length(F.translate(value, WHITESPACE + "#", "")) < F.length(value)
    return F.when(needs, F.concat(F.lit('"'), escaped(value), F.lit('"'))).otherwise(value)


def escaped(value: Column) -> Column:
    """Backslashes, then double quotes, escaped with a backslash."""
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def sha256_base64(c: Column) -> Column:
    return F.base64(F.unhex(F.sha2(c, 256)))


def packed(text: Column) -> Column:
    """Bytes that stand for one text each: half as many where it is hexadecimal in lower case, as digests are, else one more."""
    digits = F.unhex(text)
    return F.when(text == F.lower(F.hex(digits)), F.concat(F.lit(b"\x01"), digits)).when(text.isNotNull(), F.concat(F.lit(b"\x00"), text.cast("binary")))


def unpacked(value: Column) -> Column:
    """The text that ``packed`` made the bytes of."""
    rest = F.substr(value, F.lit(2))
    return F.when(F.substr(value, F.lit(1), F.lit(1)) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))
