"""Queries: cosine top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyquarry.operators import vectors
from keyquarry.plans.registry import query
from keyquarry.sources.fixtures import table

_TOP = """SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
FROM (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 10) AS score
 FROM embeddings d JOIN embeddings q ON {on} )) WHERE rank <= {k}"""


def _sides(spark, sf):
    e = table(spark, sf, "embeddings")
    queries = e.select(F.col("vec_id").alias("query_id"), "embedding", "label")
    return queries, e.select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _shown(df):
    return df.withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("bigint"))


@query("j1_search_filtered", _TOP.format(on="q.label = d.label", k=5))
def j1(spark, sf):
    return _shown(vectors.search(*_sides(spark, sf), k=5, filter_column="label"))


@query("f2_search_all", _TOP.format(on="true", k=20))
def f2(spark, sf):
    return _shown(vectors.search(*_sides(spark, sf), k=20))


@query("j1_search_blocks", _TOP.format(on="q.label = d.label", k=5))
def j1_blocks(spark, sf):
    return _shown(vectors.search(*_sides(spark, sf), k=5, filter_column="label", block=64))


@query("f2_search_pivots", _TOP.format(on="true", k=5))
def f2_pivots(spark, sf):
    return _shown(vectors.search(*_sides(spark, sf), k=5, block=32))


@query("j1_search_pivots", _TOP.format(on="q.label = d.label", k=3))
def j1_pivots(spark, sf):
    return _shown(vectors.search(*_sides(spark, sf), k=3, filter_column="label", block=16))
