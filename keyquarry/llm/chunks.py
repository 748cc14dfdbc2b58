"""Document fingerprints from content-defined chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from keyquarry.llm.common import parts_of

#: Parameters of the chunks, in bytes: no border before LEAST, a strict test up to NORMAL, a loose one to MOST.
LEAST, NORMAL, MOST = 24, 64, 256
#: Of the top STRICT bits of the hash, the strict test wants all to be 0, the loose one the last LOOSE of them.
STRICT, LOOSE = 7, 5
#: How many keys a slice are sampled to cut the rows evenly.
SAMPLED = 100
#: One random number per byte value, from a digest of the value.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


def gear(text: bytes) -> np.ndarray:
    """The rolling hash at each byte, of it and the 31 bytes before: by doubling the window five times."""
    h = GEAR[np.frombuffer(text, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h = wider
    return h


def borders(text: bytes) -> list[int]:
    """Ends of the chunks: where the hash passes the test that holds at this length, or at MOST bytes."""
    n = len(text)
    h = gear(text) >> np.uint32(32 - STRICT)
    loose = np.flatnonzero((h & np.uint32((1 << LOOSE) - 1)) == 0) + 1
    strict = loose[h[loose - 1] == 0].tolist()
    loose = loose.tolist()
    out, at, i, j, ni, nj = [], 0, 0, 0, len(loose), len(strict)
    while at < n:
        low, mid, high = at + LEAST, at + NORMAL, at + MOST
        while j < nj and strict[j] < low:
            j += 1
        if j < nj and strict[j] <= mid:
            end = strict[j]
        else:
            while i < ni and loose[i] <= mid:
                i += 1
            end = loose[i] if i < ni and loose[i] <= high else high
        at = min(end, n)
        out.append(at)
    return out


def fingerprint(text: bytes) -> dict[int, int]:
    """Digest to length in bytes of each distinct chunk."""
    out, at = {}, 0
    for end in borders(text):
        out[xxh64_intdigest(text[at:end]) & 0xFFFFFFFFFF] = end - at
        at = end
    return out


def shown(chunks: dict[int, int]) -> str:
    """``digest:length`` of every chunk, in the order of the digests: the same for equal texts."""
    return ",".join(f"{d:010x}:{n:x}" for d, n in sorted(chunks.items()))


def containment(chunks: dict[int, int], of: dict[int, int]) -> float:
    """The share of ``chunks``, by length, that ``of`` has too; two empty ones are alike."""
    if not chunks:
        return float(not of)
    small, large = (chunks, of) if len(chunks) < len(of) else (of, chunks)
    return sum(chunks[d] for d in small if d in large) / sum(chunks.values())


def edited(text: str, following: str) -> str:
    """The last third of the signs replaced by as many first ones of the following text, or all it has."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def _neighbours(batches) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (slice, order); the first row of the next slice stands at the end of each as a mere neighbour."""
    rows: list[list] = [[] for _ in range(8)]
    before = None  # (doc_id, slice, text, chunks)

    def flush():
        nonlocal rows
        out, rows = rows, [[] for _ in range(8)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_chunks"]
    types = None

    def add(doc, text, chunks, following, theirs):
        other = edited(text, following)
        raw = other.encode()
        changed = fingerprint(raw)
        for column, v in zip(rows, (doc, len(text), hashlib.sha256(raw).hexdigest(), shown(chunks), shown(changed),
                                    containment(chunks, changed), containment(chunks, theirs), len(changed))):
            column.append(v)

    held = 0
    for batch in batches:
        types = types or [batch.schema.field("doc_id").type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64()]
        columns = [batch.column(n).to_pylist() for n in ("slice", "tail", "doc_id", "text")]
        for part, tail, doc, text in zip(*columns):
            text = text or ""
            if tail and (before is None or before[1] != part):
                continue  # the neighbour of the slice's last row has been seen already
            chunks = fingerprint(text.encode())
            if before is not None and before[1] == part:
                add(before[0], before[2], before[3], text, chunks)
                held += len(before[2])
            before = None if tail else (doc, part, text, chunks)
            if held > 8_000_000:
                yield flush()
                held = 0
    if rows[0]:
        yield flush()


def _cuts(keys: DataFrame, n: int, slices: int) -> list:
    """Where slices begin: rows of about even ranks, in falling order, out of some ``SAMPLED`` sampled keys a slice."""
    share = min(1.0, slices * SAMPLED / max(n, 1))
    some = keys if share == 1.0 else keys.filter(F.rand(7) < share)
    found = [r["_by"] for r in some.distinct().orderBy(F.desc("_by")).collect()]
    return [found[i] for i in sorted({len(found) * i // slices for i in range(1, slices)} - {0})]


def compare(docs: DataFrame, slices: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every whole text, null as empty.

    The next document is that of the next smaller id; after the last comes the first.  Rows
    of one id follow each other by a digest of their text (null ids come last), so repeated rows
    are each other's neighbours; a single row is its own.  Ids are of any ordered type.  The rows are cut into slices at (id, digest)
    of about even ranks, so different texts of one id, or without an id, stand in several; every text moves once, to its slice, and the first of a slice also to
    the slice before, where it is only looked at.  A task holds two texts at a time.
    Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    slices = slices or parts_of(spark)
    by = F.struct(F.col("doc_id").isNotNull().alias("has"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("_by", by)
    ends = rows.agg(F.max("_by").alias("first"), F.count("*").alias("n")).first()
    cuts = _cuts(rows.select("_by"), ends["n"], slices)
    kind = docs.schema[doc_id].dataType.simpleString()

    def place(r) -> Column:
        return F.struct(F.lit(r["has"]).alias("has"), F.lit(r["id"]).cast(kind).alias("id"), F.lit(r["h"]).cast("bigint").alias("h"))

    last, row = len(cuts), F.col("_by")
    slice_ = F.lit(0)
    if cuts:
        # a slice begins at each cut, and rows come in falling order: how many cuts are not smaller, by halving
        bounds = F.array(*[place(r) for r in cuts])
        steps = F.array(*[F.lit(1 << b) for b in reversed(range(last.bit_length()))])
        slice_ = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= last) & (F.get(bounds, at + s - 1) >= row), at + s).otherwise(at))
    rows = rows.withColumn("_slice", slice_)
    begins = F.get(bounds, F.col("_slice") - 1) == row if cuts else F.lit(False)
    stands = F.struct(F.col("_slice").alias("slice"), F.lit(False).alias("tail"))
    opens = F.when(begins, F.struct((F.col("_slice") - 1).alias("slice"), F.lit(True).alias("tail")))
    closes = F.when(row == place(ends["first"]), F.struct(F.lit(last).alias("slice"), F.lit(True).alias("tail"))) if ends["n"] else F.lit(None)
    placed = rows.select("doc_id", "text", F.explode(F.filter(F.array(stands, opens, closes), lambda x: x.isNotNull())).alias("_at")).select("doc_id", "text", "_at.*")
    dealt = placed.repartitionById(last + 1, F.col("slice")).sortWithinPartitions(
        "slice", "tail", F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text")))
    return dealt.mapInArrow(_neighbours, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                         "near_edited double, near_next double, edited_chunks bigint")
