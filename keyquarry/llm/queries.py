"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from keyquarry.llm import (
    bpe, chunks, hard_negatives, language_model, languages, licenses, packing, perplexity, personal_data, product_codes, secret_ledger, simhash,
    token_counts,
)
from keyquarry.llm.common import documents, remainder_is
from keyquarry.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(prepare(spark), sf.rstrip("/"))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_language_id")
def op1(spark, sf):
    """Language of every text, from profiles of the documents that are not held out."""
    docs = documents(spark, sf).select("doc_id", "text", "lang").withColumn("held_out", remainder_is("doc_id", 4, 2))
    profiles = languages.learn(docs.filter(~F.col("held_out")))
    return languages.predict(docs, profiles, keep=["doc_id", "held_out"])


@query("op2_byte_bpe")
def op2(spark, sf):
    """Byte-level BPE ids of every text, and back."""
    return bpe.round_trip(documents(spark, sf), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op3_secret_scan")
def op3(spark, sf):
    """Secrets in every text, each content scanned once."""
    return secret_ledger.scan(documents(spark, sf))


@query("op4_simhash")
def op4(spark, sf):
    """Classes of texts whose SimHash fingerprints link."""
    return simhash.near_duplicates(documents(spark, sf))


@query("op5_lm_scores")
def op5(spark, sf):
    """Scores of every text under word counts and a recurrent network of the documents that are not held out."""
    docs = documents(spark, sf).select("doc_id", "text").withColumn("held_out", remainder_is("doc_id", 7, 2))
    model, words = language_model.fit(docs.filter(~F.col("held_out")), "doc_id")
    return language_model.score(docs, model, words, ["doc_id", "held_out"])


@query("op6_fingerprints")
def op6(spark, sf):
    """Chunk fingerprints of every text, against its edited text and the next document."""
    return chunks.compare(documents(spark, sf))


@query("op7_packing")
def op7(spark, sf):
    """Documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_token_counts")
def op8(spark, sf):
    """Tokens of every text."""
    return token_counts.count_tokens(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_license_scan")
def op9(spark, sf):
    """License phrases and signatures of every text."""
    return licenses.scan(documents(spark, sf))


@query("op10_quality_rules")
def op10(spark, sf):
    """Repetition, symbols and perplexity of every text."""
    return perplexity.judge(documents(spark, sf))


@query("op11_personal_data")
def op11(spark, sf):
    """Personal data in every text, by fixed forms and by learned contexts."""
    return personal_data.scan(documents(spark, sf))


_NUMBERS = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _codes_sql(parts: int = 4, rounds: int = 4) -> str:
    """The same codes by joins of all parts with all entries."""
    steps = [f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {_NUMBERS}),
cut AS MATERIALIZED (SELECT vec_id, label, p, list_slice(v, p * (len(v) // {parts}) + 1, (p + 1) * (len(v) // {parts})) AS x FROM kept, range({parts}) t(p)),
book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM cut
 WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256))"""]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (SELECT vec_id, label, p, any_value(x) AS x, min({{'d': CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT), 'e': e}}) AS m
 FROM cut JOIN book{r} USING (p) GROUP BY vec_id, label, p)""")
        if r < rounds:
            steps.append(f"""mean{r} AS MATERIALIZED (SELECT p, e, list(f ORDER BY i) AS c FROM (SELECT p, e, i, floor(sum(y) / count(*)) AS f
 FROM (SELECT p, m.e AS e, unnest(x) AS y, unnest(range(len(x))) AS i FROM near{r}) GROUP BY p, e, i) GROUP BY p, e),
book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} n USING (p, e))""")
    return "WITH " + ",\n".join(steps) + f""",
coded AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(c) AS y, unnest(range(len(c))) AS i FROM book{rounds})) AS codebooks_sha256
FROM coded"""


@query("op12_vector_codes", _codes_sql())
def op12(spark, sf):
    """Vectors as one byte for each of four parts."""
    return product_codes.compress(spark.read.parquet(f"{sf}/embeddings.parquet"))


@query("op13_hard_negatives", f"""WITH used AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
 list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND {_NUMBERS}),
scored AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s
 FROM used a JOIN used b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, id AS positive_id, s AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, id) AS INT) AS rank, id AS negative_id, positive_score, s AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s AND 100 * s <= 95 * positive_score
QUALIFY rank <= 3""")
def op13(spark, sf):
    """Hard negatives of every fiftieth vector among all vectors, with some labels shifted."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("label", label)
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)
