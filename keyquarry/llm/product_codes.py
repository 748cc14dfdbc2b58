"""Compression of vectors to one code byte for each part, by codebooks learned over integers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from keyquarry.llm.integers import finite, products, scaled
from keyquarry.session import materialize

_BLOCK = 4096       # rows whose distances to one codebook are held at once


def nearest(x: np.ndarray, book: np.ndarray, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, the lowest of equals, and the squared distance) of every row."""
    at, apart = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    own = (book * book).sum(1)
    for i in range(0, len(x), _BLOCK):
        rows = x[i:i + _BLOCK]
        distance = own - 2 * products(rows, book, width)
        at[i:i + _BLOCK] = best = distance.argmin(1)
        apart[i:i + _BLOCK] = distance[np.arange(len(rows)), best] + (rows * rows).sum(1)
    return at, apart


def _first(rows: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray:
    """The codebooks (part, entry, position) cut from the rows of the ``entries`` smallest ids; empty without rows.

    The ids are found first, by themselves; vectors are read for these ids only.
    """
    usable = rows.filter((F.size("v") > 0) & (F.size("v") % parts == 0))
    ids = usable.select("vec_id").orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()
    if not ids:
        return np.zeros((parts, 0, 0), np.int64)
    if ids[-1][0] is not None:
        usable = usable.filter(F.col("vec_id") <= F.lit(ids[-1][0]))
    found = usable.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toArrow().column("v").combine_chunks()
    found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
    dims = len(found[0])
    entry = scaled(found, dims, scale)[1]
    return entry.reshape(len(entry), parts, dims // parts).transpose(1, 0, 2).copy()


def learn(rows: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> np.ndarray:
    """Codebooks after ``rounds`` of assignment and averaging over all rows (vec_id, label, v).

    A task hands on the sum and number of the parts it assigned to each entry, at most parts *
    entries rows; the driver holds the codebooks, whose size does not depend on the data.
    """
    books = _first(rows, parts, entries, scale)
    _, n, size = books.shape
    if not n:
        return books
    sums = [f"s{i}" for i in range(size)]
    schema = "slot int, n bigint, " + ", ".join(f"{s} bigint" for s in sums)
    for _ in range(rounds):
        def assign(batches, books=books):
            total, count = np.zeros((parts * n, size), np.int64), np.zeros(parts * n, np.int64)
            for batch in batches:
                x = scaled(batch.column(0), parts * size, scale)[1]
                for p in range(parts):
                    own = x[:, p * size:(p + 1) * size]
                    slot = nearest(own, books[p])[0] + p * n
                    np.add.at(total, slot, own)
                    count += np.bincount(slot, minlength=parts * n)
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), *(pa.array(c) for c in total[used].T)], ["slot", "n", *sums])

        met = rows.select("v").mapInArrow(assign, schema).groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums]).collect()
        books = books.copy()
        for r in met:
            books[r["slot"] // n, r["slot"] % n] = [r[s] // r["n"] for s in sums]
    return books


def compress(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
             parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row whose vector holds numbers only.

    Components are floor(scale * x).  Codebooks start as the parts of the ``entries`` (at most
    256) smallest ids, ascending; equal ids follow their vectors, null ids come last.  The length of the first of
    these vectors counts: a vector of another length (or one that cannot be cut into equal
    parts) takes no part in the codebooks and gets a null code and error.  With fewer rows there are fewer entries.  Repeated
    rows are coded each; an empty table gives no rows.  Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index has two hex digits")
    kind = rows.schema[label].dataType
    rows = rows.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows = rows.filter(finite(F.col("v")))
    books = learn(rows, parts, entries, rounds, scale)
    size = books.shape[2]

    def code(batches):
        for batch in batches:
            codes, errors = np.full(batch.num_rows, None, object), np.zeros(batch.num_rows, np.int64)
            at, x = scaled(batch.column(2), parts * size, scale) if size else (np.zeros(0, np.int64), None)
            if len(at):
                index = np.empty((len(at), parts), np.uint8)
                for p in range(parts):
                    index[:, p], apart = nearest(x[:, p * size:(p + 1) * size], books[p])
                    errors[at] += apart
                codes[at] = [i.tobytes().hex() for i in index]
            none = np.equal(codes, None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, mask=none)],
                                             ["vec_id", "label", "code", "error"])

    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {kind.simpleString()}, code string, error bigint"
    coded = materialize(rows.mapInArrow(code, schema), "codes")
    # one row for each label, written so that its size is known before it is joined
    by_label = materialize(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    digest = hashlib.sha256(",".join(str(i) for i in books.ravel().tolist()).encode()).hexdigest()
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
