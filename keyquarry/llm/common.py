"""What the operators on documents share."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Unicode white space, as the splitting patterns of the tokenizers see it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: White space of other tables; a place after one of these is never taken for a border.
DOUBTFUL = WHITE + "\x1c\x1d\x1e\x1f᠎​﻿"
#: Upper and lower case letters of ASCII.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def remainder_is(key: str, divisor: int, remainder: int) -> Column:
    """Whether crc32 of a key as text leaves this remainder; false for a null key."""
    crc = F.crc32(F.col(key).cast("string").cast("binary"))
    return F.coalesce(crc % divisor == remainder, F.lit(False))


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def giving_back(run: Callable) -> Callable:
    """``run`` over a task's batches; behind them Arrow's free memory goes back, as a Python process serves one stage after the other and keeps it otherwise."""
    @functools.wraps(run)
    def whole(*args, **kwargs):
        yield from run(*args, **kwargs)
        pa.default_memory_pool().release_unused()

    return whole


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty."""
    return [b or b"" for b in column.cast("binary").to_pylist()]

#: Marks that often stand behind a word, and the first sign behind the Latin letters that all tables agree on.
_MARKS, _LATIN_END = ".,;:!?", "\u0250"


class Stretches:
    """Ids (packed, four bytes each) of a text from those of its stretches.

    A space after a sign that is no white space always starts a new match of the pattern
    by which byte-level BPE splits a text, so what stands between such places can be
    encoded by itself.  The ids of short stretches are kept in two generations of at most
    ``most``: when the younger is full it becomes the older, and what is met again moves
    back to the younger.
    """

    def __init__(self, encode: Callable[[str], bytes], most: int = 600_000):
        self.encode, self.most = encode, most
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        words = text.split(" ")
        found = [None, *map(self.known.get, words[1:])]
        at, last = 0, len(words) - 1
        while True:
            try:
                at = found.index(None, at)
            except ValueError:
                return b"".join(found)
            end = at
            while end < last and open_end(words[end]) and (end or words[0]):
                found[end] = b""  # white space may go on: it is encoded with what follows
                end += 1
            if at == end and at and len(words[at]) < 64 and not open_end(words[at]):
                found[at] = self._keep(words[at])
            else:
                found[end] = self.encode((" " if at else "") + " ".join(words[at:end + 1]))
            at = end + 1

    def forget(self) -> None:
        """Drops the ids of all stretches."""
        self.known, self.older = {}, {}

    def _keep(self, word: str) -> bytes:
        if (ids := self.older.get(word)) is None:
            if ends_by_letter(word):
                stem = word[:-1]
                if (first := self.known.get(stem)) is None:
                    first = self._keep(stem)
                ids = first + self.mark(word[-1])
            else:
                ids = self.encode(" " + word)
        if len(self.known) >= self.most:
            self.older, self.known = self.known, {}
        self.known[word] = ids
        return ids

    def mark(self, mark: str) -> bytes:
        if (ids := self.marks.get(mark)) is None:
            ids = self.marks[mark] = self.encode(mark)
        return ids


def open_end(word: str) -> bool:
    return not word or word[-1] in DOUBTFUL


def ends_by_letter(word: str) -> bool:
    """Whether a mark stands behind letters: a letter before a mark ends a match, and the mark is one by itself here."""
    return word[-1] in _MARKS and (stem := word[:-1]).isalpha() and max(stem) < _LATIN_END
