"""Hard negatives of anchors among all rows, by exact integer scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from keyquarry.llm.integers import finite, packed_products, scaled
from keyquarry.session import materialize, new_path

_STEP = 512          # anchors scored at once against a batch of rows


class Best:
    """The first ``most`` of what was added to each of ``slots``, by score (high first), then id."""

    def __init__(self, slots: int, most: int):
        self.most = most
        self.least = np.full(slots, np.iinfo(np.int64).min)     # what a score must reach
        self.held = (np.zeros(0, np.int64),) * 3

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = (np.concatenate(x) for x in zip(self.held, (slot, score, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        last = place == self.most - 1
        self.least[slot[last]] = score[last]
        self.held = tuple(x[place < self.most] for x in (slot, score, ids))


class Chunk:
    """A bounded number of anchors, with the codes of their labels."""

    def __init__(self, table: pa.Table, dims: int, scale: int):
        table = table.combine_chunks()
        vectors = table.column("v").combine_chunks()
        at, self.x = scaled(vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors, dims, scale)
        self.key, self.id = (table.column(c).to_numpy()[at] for c in ("anchor", "vec_id"))
        labels = table.column("label").to_pylist()
        self.codes: dict = {}
        self.label = np.array([self.codes.setdefault(labels[i], len(self.codes)) for i in at], np.int64)

    def scores(self, batch: pa.RecordBatch, dims: int, scale: int):
        """(first anchor, ids, whether label and anchor's label agree, scores) for steps of anchors against a batch of rows."""
        at, x = scaled(batch.column(2), dims, scale)
        if len(at):
            ids, labels = batch.column(0).to_numpy()[at], batch.column(1).to_pylist()
            label = np.array([self.codes.get(labels[i], -1) for i in at], np.int64)
            for a in range(0, len(self.key), _STEP):
                yield a, ids, self.label[a:a + _STEP, None] == label, packed_products(self.x[a:a + _STEP], x)


def _first(df: DataFrame, by: list[str], most: int) -> DataFrame:
    """The first rows of each group with their ``rank``; tasks hand on no more than that of a group."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def _positives(rows: DataFrame, shared, dims: int, scale: int, most: int) -> DataFrame:
    def run(batches):
        chunk: Chunk = shared.value
        best = [Best(min(_STEP, len(chunk.key) - a), most) for a in range(0, len(chunk.key), _STEP)]
        for batch in batches:
            for a, ids, same, score in chunk.scores(batch, dims, scale):
                own = best[a // _STEP]
                i, j = np.nonzero(same & (score >= own.least[:, None]) & (chunk.id[a:a + _STEP, None] != ids))
                own.add(i, score[i, j], ids[j])
        for n, own in enumerate(best):
            slot, score, ids = own.held
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (slot + n * _STEP, score, ids)], ["at", "score", "id"])

    return _first(rows.mapInArrow(run, "at bigint, score bigint, id bigint"), ["at"], most)


def _negatives(rows: DataFrame, shared, dims: int, scale: int, most: int) -> DataFrame:
    def run(batches):
        chunk, low, high = shared.value         # bounds for each anchor and positive; low is over high where there is none
        n = low.shape[1]
        best = [Best(min(_STEP, len(chunk.key) - a) * n, most) for a in range(0, len(chunk.key), _STEP)]
        for batch in batches:
            for a, ids, same, score in chunk.scores(batch, dims, scale):
                own, top = best[a // _STEP], high[a:a + _STEP]
                floor = np.maximum(low[a:a + _STEP], own.least.reshape(-1, n))
                i, j = np.nonzero(~same & (score >= floor.min(1)[:, None]) & (score <= top.max(1)[:, None]))
                s = score[i, j]
                found = [np.flatnonzero((s >= floor[i, p]) & (s <= top[i, p])) for p in range(n)]
                own.add(np.concatenate([i[f] * n + p for p, f in enumerate(found)]), *(np.concatenate([x[f] for f in found]) for x in (s, ids[j])))
        for k, own in enumerate(best):
            slot, score, ids = own.held
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (slot // n + k * _STEP, slot % n, score, ids)], ["at", "positive", "score", "id"])

    return _first(rows.mapInArrow(run, "at bigint, positive bigint, score bigint, id bigint"), ["at", "positive"], most)


_RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def _chunks(spark: SparkSession, usable: DataFrame, dims: int, room: int) -> tuple[DataFrame | None, int]:
    """The written table of anchors, dealt evenly to chunks of about ``room`` bytes, and the number of chunks."""
    asked = usable.filter("asked").select("vec_id", "label", "v")
    total = asked.count()
    if not total:
        return None, 0
    n = -(-total * dims * 8 // room)
    path = new_path(spark, "anchors")
    dealt = asked.repartition(n).select(F.monotonically_increasing_id().alias("anchor"), "*", F.spark_partition_id().alias("chunk"))
    dealt.write.partitionBy("chunk").parquet(path)
    return spark.read.schema(dealt.schema).parquet(path), n


def mine(rows: DataFrame, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
         positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, room: int = 32 << 20) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is the inner product of components floor(scale * x).  An anchor (a row where
    ``anchors`` holds) has as positives the first ``positives`` rows of its label and another
    id, as negatives of a positive the first ``negatives`` rows of another label whose score
    is ``low`` to ``high`` percent of the positive's; high scores come first, ties by smaller id.

    Anchors are taken in chunks of ``room`` bytes, one after the other: a chunk is sent to all
    tasks, which stay at the rows they read and hand on a few rows for each anchor.  The rows
    are never moved.  Rows without id or label, or with a vector that is null or holds anything but
    numbers, take no part, nor do vectors of another length than that of the smallest id.  A row that repeats counts each time; a repeated anchor gives its rows
    each time.  An empty table or one without anchors gives no rows.  Other columns are not read.
    """
    spark = rows.sparkSession
    usable = rows.select(
        F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"),
        F.coalesce(anchors, F.lit(False)).alias("asked")).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")) & (F.size("v") > 0))
    first = usable.agg(F.min(F.struct("vec_id", F.size("v").alias("dims"))).alias("f")).first()["f"]
    dims = first["dims"] if first else 0
    usable = usable.filter(F.size("v") == dims)
    table, n = _chunks(spark, usable, dims, room) if dims else (None, 0)
    if not n:
        return spark.createDataFrame([], _RESULT)
    out, scanned = new_path(spark, "hard-negatives"), usable.select("vec_id", "label", "v")
    for c in range(n):
        chunk = Chunk(table.filter(F.col("chunk") == c).drop("chunk").toArrow(), dims, scale)
        shared = spark.sparkContext.broadcast(chunk)
        met = _positives(scanned, shared, dims, scale, positives).toArrow()     # at most ``positives`` rows for each anchor of the chunk
        shared.unpersist()
        at, place, score = (met.column(x).to_numpy() for x in ("at", "rank", "score"))
        lowest, highest = np.ones((len(chunk.key), positives), np.int64), np.zeros((len(chunk.key), positives), np.int64)
        lowest[at, place - 1], highest[at, place - 1] = -(-low * score // 100), high * score // 100
        named = pa.table({"_at": at, "_positive": place.astype(np.int64) - 1, "anchor_id": chunk.id[at], "positive_id": met.column("id"), "positive_score": score})
        shared = spark.sparkContext.broadcast((chunk, lowest, highest))
        found = _negatives(scanned, shared, dims, scale, negatives)
        pairs = materialize(spark.createDataFrame(named), "positives")          # the size of a chunk
        found.join(pairs, (F.col("at") == F.col("_at")) & (F.col("positive") == F.col("_positive"))).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")).write.parquet(f"{out}/chunk={c}")
        shared.unpersist()
    return spark.read.schema(_RESULT).parquet(f"{out}/chunk=*")
