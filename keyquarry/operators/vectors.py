"""Exact cosine top-k with a metadata filter applied before the ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from keyquarry.session import materialize

MAX_K = 20
#: About how many documents are pivots over all filter values, whatever their number: they go to every task.
PIVOTS = 4096
#: About so many tiles over all filter values, and as many parts of the queries, until one has so many bytes in double precision.
TILES, TILE_BYTES = 16, 64 << 20
#: Queries and documents of one matrix product.
_QUERIES, _DOCS = 512, 8192
_DIGITS = 10
#: Angles near zero are known to about this, in double precision.
_SLACK = 1e-7


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a, b):
    """Cosine similarity of two array<double> columns; null for a zero vector."""
    return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of equal length scaled to length one, in double precision; not a number for a zero row."""
    m = np.asarray(rows, np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        m = m / np.abs(m).max(axis=1, keepdims=True)     # large elements would overflow when squared
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def _best(scores: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties by place in ``order``; rows without a score are left out."""
    usable = np.flatnonzero(~np.isnan(scores))
    if len(usable) > k:
        kth = np.partition(scores[usable], len(usable) - k)[len(usable) - k]
        usable = usable[scores[usable] >= kth]
    return usable[np.lexsort((order[usable], -scores[usable]))[:k]]


def search(
    queries: DataFrame,
    docs: DataFrame,
    k: int = 5,
    filter_column: str | None = None,
    query_id: str = "query_id",
    doc_id: str = "doc_id",
    vector: str = "embedding",
    block: int = 2048,
) -> DataFrame:
    """(query_id, rank, doc_id, score) of the k most similar documents per query.

    Equal scores (to ten digits) are ranked by document id.  Filter values of up to ``block`` documents share
    places of about that many; larger ones are cut into cells around pivots (some of their own documents, about
    ``PIVOTS`` over all values).  In a cut value a query is first scored with a block of its nearest cell; its k-th score
    there is a floor, and then it meets those cells whose best possible cosine, by the angles from query to
    pivot and from pivot to the cell's farthest document, reaches the floor.  So nothing is lost, and what
    is scored falls with the filter and with how well vectors cluster.

    Cells lie one behind the other in tiles.  A query is copied once for a tile that has a cell it needs, not for each cell, and a
    tile once for each ``TILES``-th part of the queries: there are about ``TILES`` of them over all values until one has
    ``TILE_BYTES``, so what is shuffled grows as the rows do.  A task scores part of the queries with a
    tile by matrix products and keeps at most k candidates per query.

    Vectors are compared with those of their own length only; rows without a vector, with a missing element
    or of length zero have no score.
    """
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be between 1 and {MAX_K}")
    kind = "<f4" if all(df.schema[vector].dataType == T.ArrayType(T.FloatType(), df.schema[vector].dataType.containsNull) for df in (queries, docs)) else "<f8"
    asked, found = _usable(queries, query_id, vector, filter_column, kind), _usable(docs, doc_id, vector, filter_column, kind)
    schema = T.StructType([
        T.StructField("query_id", queries.schema[query_id].dataType),
        T.StructField("doc_id", docs.schema[doc_id].dataType),
        T.StructField("score", T.DoubleType()),
    ])
    sizes = materialize(found.groupBy("tag", "size").agg(F.count("*").alias("n")), "groups")
    facts = sizes.agg(F.sum("n").alias("rows"), F.max("n").alias("largest"), F.max("size").alias("size"), F.sum(F.when(F.col("n") <= block, F.col("n"))).alias("small")).first()
    most = max(TILE_BYTES // (8 * (facts["size"] or 1)), 1)
    part = min(max(-(-asked.count() // TILES), block), most)
    buckets = max(-(-(facts["small"] or 0) // block), 1)
    shared = F.concat(F.lit("b"), F.pmod(F.xxhash64("tag", "size"), F.lit(buckets)))
    if (facts["largest"] or 0) <= block:
        return _ranked(_scored(asked.withColumn("home", shared), found.withColumn("home", shared), k, part, schema, kind), k)

    tile = min(max(-(-facts["rows"] // TILES), block), most)
    cut = sizes.filter(F.col("n") > block).withColumn("wanted", F.floor(F.col("n") * F.lit(min(PIVOTS / facts["rows"], 1 / block))))
    pivots = _pivots(found, cut, kind)
    small = sizes.filter(F.col("n") <= block).select("tag", "size")
    near = materialize(_nearest(found.join(cut.select("tag", "size"), ["tag", "size"]), pivots, kind).withColumn("at", F.rand()), "cells")
    counted = near.groupBy("tag", "size", "cell").agg(F.count("*").alias("n"), F.min("near").alias("near"))
    before = Window.partitionBy("tag", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = materialize(counted.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))), "cells")
    placed = near.drop("near").join(cells.drop("near"), ["tag", "size", "cell"]).withColumn("place", F.least(F.floor(F.col("at") * F.col("n")), F.col("n") - 1))
    bounds = {(r["tag"], r["size"], r["cell"]): (r["n"], r["near"], r["start"]) for r in cells.filter("cell >= 0").collect()}
    ours = asked.join(cut.select("tag", "size", F.ceil(F.col("n") / tile).alias("tiles")), ["tag", "size"])
    own = F.concat(F.lit("s"), F.col("cell"), F.lit(":"), F.col("size"), F.lit(":"), F.col("tag").cast("string"))
    seeds = _seeds(ours, pivots, bounds, k, kind).filter("cell >= 0").withColumn("home", own)
    first = placed.filter(F.col("place") < block).withColumn("home", own)
    floors = _ranked(_scored(seeds, first, k, part, schema, kind), k).filter(F.col("rank") == k).select(F.col("query_id").alias("name"), F.col("score").alias("floor"))
    home = F.concat(F.lit("c"), F.col("tile"), F.lit(":"), F.col("size"), F.lit(":"), F.col("tag").cast("string"))
    routed = _routes(ours.join(materialize(floors, "floors"), "name", "left"), pivots, bounds, tile, kind).withColumn("home", home)
    many = placed.withColumn("tile", F.floor((F.col("start") + F.col("place")) / tile)).withColumn("home", home)
    names = ["name", "vector", "tag", "home"]
    others = asked.join(small, ["tag", "size"]).withColumn("home", shared).select(*names, F.lit(None).cast("double").alias("floor"))
    few = found.join(small, ["tag", "size"]).withColumn("home", shared).select(*names, F.lit(-1).cast("bigint").alias("cell"))
    return _ranked(_scored(routed.select(*names, "floor").unionByName(others), many.select(*names, "cell").unionByName(few), k, part, schema, kind, pivots, bounds), k)


def _scored(routed: DataFrame, placed: DataFrame, k: int, most: int, schema: T.StructType, kind: str, pivots: dict | None = None, bounds: dict | None = None) -> DataFrame:
    """Up to k candidates per query and place of the queries sent to ``home`` and the documents that lie there.

    Where more than ``most`` queries meet, documents are copied for each further part of them.  With ``pivots``, queries have a ``floor`` (or null) and
    documents a ``cell``: scores below the floor may be left out, and so may cells that cannot reach it.
    """
    arrow = to_arrow_schema(schema)
    extra = [["floor"], ["cell"]] if pivots is not None else [[], []]
    load = materialize(routed.groupBy("home").agg(F.ceil(F.count("*") / most).alias("parts")), "load")
    left = routed.select("name", "vector", "tag", "home", *extra[0]).join(load, "home").withColumn("part", F.pmod(F.xxhash64("name", "vector"), "parts")).drop("parts")
    copies = load.select(F.col("home").alias("home"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    right = placed.select("name", "vector", "tag", "home", *extra[1]).join(copies, "home")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        places: list[dict] = [{}, {}]
        vectors = [t["vector"].to_pylist() for t in (left, right)]
        for side, t in enumerate((left, right)):
            for at, (tag, v) in enumerate(zip(t["tag"].to_pylist(), vectors[side])):
                places[side].setdefault((tag, len(v)), []).append(at)
        order = np.empty(right.num_rows, np.int64)
        order[pc.sort_indices(right["name"], null_placement="at_start").to_numpy()] = np.arange(right.num_rows)
        found = []
        for (tag, n), at in places[0].items():
            if (tag, n) not in places[1]:
                continue
            key, at, there = (tag, n // int(kind[2])), np.array(at), np.array(places[1][tag, n])
            q, d = (_unit(_matrix([vectors[s][i] for i in p], kind)) for s, p in ((0, at), (1, there)))
            usable = [np.isfinite(m[:, 0]) for m in (q, d)]
            q, d, at, there = q[usable[0]], d[usable[1]], at[usable[0]], there[usable[1]]
            if not len(q) or not len(d):
                continue
            floor, cell = np.full(len(q), -2.0), None
            if pivots is not None:
                floor = pc.fill_null(left["floor"], -2.0).to_numpy()[at]
                if key in pivots:
                    cell = right["cell"].to_numpy()[there]
                    by = np.argsort(cell, kind="stable")
                    cell, d, there = cell[by], d[by], there[by]
            reached = None if cell is None else (pivots[key], np.array([bounds.get((*key, c), (0, -1.0))[1] for c in range(len(pivots[key]))]), cell)
            i, j, score = _top(q, d, order[there], k, floor, reached)
            found.append((at[i], there[j], score))
        i, j, score = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        columns = left["name"].take(pa.array(i)), right["name"].take(pa.array(j)), pa.array(score)
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return left.groupBy("home", "part").cogroup(right.groupBy("home", "part")).applyInArrow(best, schema)


def _top(q: np.ndarray, d: np.ndarray, order: np.ndarray, k: int, floor: np.ndarray, reached: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document, score) of the k best documents per query, both unit rows, ties by ``order``; scores below ``floor`` may be missing.

    ``reached``: pivots, the cosine of the farthest document of each cell with its pivot, and each document's cell (sorted); cells that
    cannot reach a query's floor are not scored.  Products in single precision with room for their error choose
    what is scored in double precision.  The k-th best so far raises the floor.
    """
    q4, d4 = q.astype(np.float32), d.astype(np.float32)
    slack = (q.shape[1] + 8) * 2.0 ** -22
    out = []
    if reached is not None:
        own, first = np.unique(reached[2], return_index=True)
        ends = np.append(first[1:], len(d))
        real = np.maximum(own, 0)
        centres, near = reached[0][real], np.where(own >= 0, reached[1][real], -1.0)
    for a in range(0, len(q), _QUERIES):
        low, n = floor[a:a + _QUERIES].copy(), len(q[a:a + _QUERIES])
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        needed, step = None, _DOCS
        if reached is not None:
            needed = reach(q[a:a + n] @ centres.T, near) >= low[:, None]
            step = _DOCS if needed.mean() > 0.25 else _DOCS // 32
        for b in range(0, len(d), step):
            c, rows = min(b + step, len(d)), np.arange(n)
            if needed is not None:
                rows = np.flatnonzero(needed[:, np.searchsorted(ends, b, "right"):np.searchsorted(first, c)].any(axis=1))
                if not len(rows):
                    continue
            mine = q4[a:a + n] if len(rows) == n else q4[a + rows]
            kept = np.flatnonzero(mine @ d4[b:c].T >= (low[rows] - slack).astype(np.float32)[:, None])
            if not len(kept):
                continue
            if 16 * len(kept) > len(rows) * (c - b):
                scores = np.round(q[a + rows] @ d[b:c].T, _DIGITS)
                tops = [_best(row, order[b:c], k) for row in scores]
                i, j = np.repeat(np.arange(len(rows)), [len(t) for t in tops]), np.concatenate(tops)
                score = scores[i, j]
            else:
                i, j = np.divmod(kept, c - b)
                score = np.concatenate([np.round(np.einsum("ij,ij->i", q[a + rows[i[x:x + _DOCS]]], d[b + j[x:x + _DOCS]]), _DIGITS) for x in range(0, len(i), _DOCS)])
            above = score >= low[rows[i]]
            i, j, score = (np.concatenate((x, y[above])) for x, y in zip(held, (rows[i], b + j, score)))
            by = np.lexsort((order[j], -score, i))
            i, j, score = i[by], j[by], score[by]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            low[i[rank == k - 1]] = score[rank == k - 1]
            held = tuple(x[rank < k] for x in (i, j, score))
        out.append((a + held[0], *held[1:]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _matrix(rows: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _pivots(docs: DataFrame, cut: DataFrame, kind: str) -> dict:
    """(tag, size) to the unit vectors of its pivots, rows that a hash of the name picks; a value that no row is picked of has none."""
    picked = docs.join(cut, ["tag", "size"]).filter(F.pmod(F.xxhash64("name"), "n") < F.col("wanted"))
    out: dict = {}
    for r in picked.groupBy("tag", "size", "name").agg(F.first("vector").alias("vector")).orderBy("tag", "size", "name").collect():
        unit = _unit(_matrix([r["vector"]], kind))[0]
        if np.isfinite(unit).all():
            out.setdefault((r["tag"], r["size"]), []).append(unit)
    return {key: _chained(np.array(rows)) for key, rows in out.items()}


def _chained(rows: np.ndarray) -> np.ndarray:
    """The rows, each followed by the nearest of those that are left, so that near cells share tiles."""
    left, at, chain = np.ones(len(rows), bool), 0, []
    for _ in range(len(rows)):
        chain.append(at)
        left[at] = False
        at = int(np.where(left, rows @ rows[at], -2.0).argmax())
    return rows[chain]


def _by_value(table: pa.RecordBatch) -> dict:
    """Places of the rows of each (tag, size)."""
    places: dict = {}
    for at, key in enumerate(zip(table["tag"].to_pylist(), table["size"].to_pylist())):
        places.setdefault(key, []).append(at)
    return places


def _nearest(docs: DataFrame, pivots: dict, kind: str) -> DataFrame:
    """Adds the nearest pivot of a document (``cell``, -1 where its value has none) and the cosine with it (``near``)."""
    def place(batches):
        for b in batches:
            cell, near = np.full(b.num_rows, -1, np.int64), np.ones(b.num_rows)
            vectors = b["vector"].to_pylist()
            for key, at in _by_value(b).items():
                if key in pivots:
                    cosines = _unit(_matrix([vectors[i] for i in at], kind)) @ pivots[key].T
                    cell[at] = cosines.argmax(axis=1)
                    own = cosines.max(axis=1)
                    near[at] = np.where(np.isnan(own), 1.0, own)      # a row without a direction has no score anywhere
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(near)], [*b.schema.names, "cell", "near"])

    return docs.mapInArrow(place, T.StructType([*docs.schema.fields, T.StructField("cell", T.LongType()), T.StructField("near", T.DoubleType())]))


def reach(cosines: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The best cosine a document can have whose angle to a pivot is at most that of ``near``, for queries with these cosines to the pivot."""
    angle = np.arccos(np.clip(cosines, -1, 1)) - np.arccos(np.clip(near, -1, 1)) - _SLACK
    return np.cos(np.maximum(angle, 0)) + _SLACK


def _limits(pivots: dict, bounds: dict) -> dict:
    """(tag, size) to the number of documents, the cosine of the farthest one and the start of each cell."""
    return {key: tuple(np.array([bounds.get((*key, c), (0, -1.0, 0))[x] for c in range(len(p))]) for x in range(3)) for key, p in pivots.items()}


def _seeds(queries: DataFrame, pivots: dict, bounds: dict, k: int, kind: str) -> DataFrame:
    """Adds the ``cell`` nearest to a query among those of at least k documents; -2 without one."""
    limits = _limits(pivots, bounds)

    def seed(batches):
        for b in batches:
            cell, vectors = np.full(b.num_rows, -2, np.int64), b["vector"].to_pylist()
            for key, at in _by_value(b).items():
                if key not in pivots:
                    continue
                cosines = _unit(_matrix([vectors[i] for i in at], kind)) @ pivots[key].T
                ranked = np.where(limits[key][0] >= k, cosines, -2.0)
                cell[at] = np.where(~np.isnan(cosines[:, 0]) & (ranked.max(axis=1) > -2.0), ranked.argmax(axis=1), -2)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], [*b.schema.names, "cell"])

    return queries.mapInArrow(seed, T.StructType([*queries.schema.fields, T.StructField("cell", T.LongType())]))


def _routes(queries: DataFrame, pivots: dict, bounds: dict, rows: int, kind: str) -> DataFrame:
    """One row per query and ``tile`` (of so many ``rows``) with a cell that can reach its ``floor``; all ``tiles`` where its value has no pivots."""
    limits = _limits(pivots, bounds)

    def route(batches):
        for b in batches:
            tiles = [range(t) for t in b["tiles"].to_pylist()]
            vectors = b["vector"].to_pylist()
            for key, at in _by_value(b).items():
                if key not in pivots:
                    continue
                n, near, start = limits[key]
                cosines = _unit(_matrix([vectors[i] for i in at], kind)) @ pivots[key].T
                floor = pc.fill_null(b["floor"], -2.0).to_numpy(zero_copy_only=False)[at]
                needed = (reach(cosines, near) >= floor[:, None]) & (n > 0)      # nothing for a row without a direction
                held = np.flatnonzero(n > 0)
                first, last = start // rows, (start + n - 1) // rows
                reached = np.zeros((len(at), len(tiles[at[0]])), bool)
                for t in range(reached.shape[1]):
                    reached[:, t] = needed[:, held[(first[held] <= t) & (t <= last[held])]].any(axis=1)
                for i, row in zip(at, reached):
                    tiles[i] = np.flatnonzero(row).tolist()
            again = pa.array(np.repeat(np.arange(b.num_rows), [len(t) for t in tiles]))
            yield pa.RecordBatch.from_arrays([*(c.take(again) for c in b.columns), pa.array([x for t in tiles for x in t], pa.int64())], [*b.schema.names, "tile"])

    return queries.mapInArrow(route, T.StructType([*queries.schema.fields, T.StructField("tile", T.LongType())]))


def _usable(df: DataFrame, key: str, vector: str, tag: str | None, kind: str) -> DataFrame:
    """(name, vector, tag, size) of the rows that can be scored, vectors as bytes of ``kind``."""
    rows = df.select(F.col(key).alias("name"), F.transform(vector, lambda x: x.cast("float" if kind == "<f4" else "double")).alias("vector"),
                     (F.col(tag) if tag else F.lit(0)).alias("tag")).withColumn("size", F.size("vector"))
    whole = F.col("vector").isNotNull() & (F.col("size") > 0) & ~F.exists("vector", lambda x: x.isNull())
    rows = rows.filter(whole & F.col("tag").isNotNull())

    def pack(batches):
        for b in batches:
            data = b["vector"].flatten().to_numpy(zero_copy_only=False).astype(kind)
            ends = np.cumsum([0, *b["size"].to_pylist()]) * data.itemsize
            packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([b["name"], packed, b["tag"], b["size"]], ["name", "vector", "tag", "size"])

    return rows.mapInArrow(pack, T.StructType([f if f.name != "vector" else T.StructField("vector", T.BinaryType()) for f in rows.schema.fields]))


def _ranked(candidates: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return candidates.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "doc_id", "score"
    )
