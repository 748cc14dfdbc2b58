"""Scores of whole texts: add-one word counts, and a gated recurrent network over frequent words."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from keyquarry.llm.common import ASCII_LOWER
from keyquarry.llm.gru import Network
from keyquarry.session import materialize

END = b""          # stands behind each text; no word is empty


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, and the end."""
    return [*text.translate(ASCII_LOWER).split(), END]


@dataclass
class Tokens:
    """The tokens of a column of texts (null as empty), as ``tokens`` gives them: places in the list of different words, and where each text begins, with the end."""

    words: pa.Array
    places: np.ndarray
    begin: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Tokens:
        # a space behind the last word gives an empty word there, the end; a text without words is that one alone
        text = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        some = pc.if_else(pc.equal(text, ""), "", pc.binary_join_element_wise(text, "", " "))
        lists = pc.ascii_split_whitespace(some)
        found = lists.flatten().cast(pa.binary()).dictionary_encode()
        begin = lists.offsets.to_numpy().astype(np.int64)
        return cls(found.dictionary, found.indices.to_numpy(), begin - begin[0])


def _counted(batches):
    """The different words of each batch with their counts."""
    for batch in batches:
        found = Tokens.of(batch.column(0))
        yield pa.RecordBatch.from_arrays([found.words, pa.array(np.bincount(found.places, minlength=len(found.words)), pa.int64())], ["word", "c"])


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all whole texts (one column), written to the shared folder."""
    return materialize(texts.mapInArrow(_counted, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")), "words")


@dataclass
class Model:
    """What every task gets, bounded by the number of ``frequent`` words: their counts, and the network over fewer of them."""

    total: int                       # training tokens
    distinct: int
    frequent: dict[bytes, int]       # word to place
    base: np.ndarray                 # log10 of the add-one share of each
    rest: np.ndarray                 # log10 of its share among words outside the network's vocabulary; 0 inside
    number: np.ndarray               # the network's number of each, the unknown one outside
    network: Network | None
    unknown: int
    end: int
    rest_total: int                  # training tokens and distinct words outside that vocabulary
    rest_distinct: int


def _log_share(c, total: int, distinct: int):
    return np.log10((np.asarray(c, float) + 1) / (total + distinct + 1))


def _edges(counts: np.ndarray) -> list[int]:
    """Borders of about root-many classes of even sums of root counts, most frequent words first."""
    share = np.cumsum(np.sqrt(counts + 1.0))
    many = max(int(np.sqrt(len(counts))), 1)
    cut = np.searchsorted(share, share[-1] * np.arange(1, many) / many)
    return [0, *sorted(set((cut + 1).tolist()) - {len(counts)}), len(counts)]


def fit(texts: DataFrame, key: str, frequent: int = 100_000, vocabulary: int | None = None, rounds: int = 2,
        shard_tokens: int = 400_000) -> tuple[Model, DataFrame]:
    """The model, and the table of all word counts, from ``texts`` (key, text).

    Counts and network learn from all whole texts.  The network's vocabulary is the ``vocabulary`` words of highest
    count, by default the root of the number of distinct words (400 at least, ``frequent`` at most).  A hash of the key deals the rows
    to ``rounds``, so each is read in one of them.  In a round every task trains a copy on the rows it reads, about
    ``shard_tokens`` tokens or more, so shards grow with the corpus; then their parameters are averaged by tokens.
    """
    spark = texts.sparkSession
    words = count_words(texts.select("text"))
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = words.orderBy(F.desc("c"), "word").limit(frequent).toArrow()
    order = sorted(zip(top["word"].to_pylist(), top["c"].to_pylist()), key=lambda x: (-x[1], x[0]))
    names, counts = [bytes(w) for w, _ in order], np.array([c for _, c in order], np.int64)
    places = {w: i for i, w in enumerate(names)}
    inside = [w for w in names[:vocabulary or max(400, math.isqrt(sums["v"]))] if w != END]
    members = [END, *inside]
    rest_total = max(sums["n"] - int(sum(counts[places[w]] for w in members if w in places)), 0)
    rest_distinct = max(sums["v"] - sum(w in places for w in members), 0)
    weights = sorted([(int(counts[places[w]]) if w in places else 0, w) for w in members] + [(rest_total, None)], key=lambda x: (-x[0], x[1] is None, x[1] or b""))
    numbers = {w: i for i, (_, w) in enumerate(weights)}
    shares = np.array([c for c, _ in weights], float)
    network = Network(_edges(shares), counts=shares)
    base = _log_share(counts, sums["n"], sums["v"])
    rest = np.array([0.0 if w in numbers else r for w, r in zip(names, _log_share(counts, rest_total, rest_distinct))])
    number = np.array([numbers.get(w, numbers[None]) for w in names], np.int32)
    model = Model(sums["n"], sums["v"], places, base, rest, number, network, numbers[None], numbers[END], rest_total, rest_distinct)
    dealt = F.pmod(F.xxhash64(key, F.lit("fit")), F.lit(rounds))
    for r in range(rounds if sums["n"] else 0):
        part = texts.filter(dealt == r).select("text").coalesce(max(1, -(-sums["n"] // (rounds * shard_tokens))))
        _round(part, model, 0.01 / (1 + r))
    return model, words


def _names(model: Model) -> pa.Array:
    """The frequent words by place."""
    return pa.array(list(model.frequent), pa.binary())


def _frequent(names: pa.Array, found: Tokens) -> np.ndarray:
    """The place among ``names`` of each different word, -1 beyond them."""
    return pc.fill_null(pc.index_in(found.words, value_set=names), -1).to_numpy()


def _numbers(model: Model, found: Tokens, at: np.ndarray) -> list[np.ndarray]:
    """The network's numbers of each text's tokens."""
    numbers = np.where(at < 0, model.unknown, model.number[at]).astype(np.int32)[found.places] if len(model.number) else np.full(len(found.places), model.unknown, np.int32)
    return [numbers[a:b] for a, b in zip(found.begin.tolist(), found.begin[1:].tolist())]


def _read(model: Model, batches):
    """Numbers of one text after the other."""
    names = _names(model)
    for batch in batches:
        found = Tokens.of(batch.column(0))
        yield from _numbers(model, found, _frequent(names, found))


_SHARD = "data binary, tokens bigint"


def _shard(data: np.ndarray, tokens: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([data.tobytes()], pa.binary()), pa.array([tokens], pa.int64())], ["data", "tokens"])


def _averaged(batches):
    """One row of the rows' parameters, weighted by their tokens; holds one sum."""
    held, n = None, 0
    for batch in batches:
        for data, tokens in zip(batch.column(0), batch.column(1).to_pylist()):
            row = np.frombuffer(data.as_py(), np.float32) * float(tokens)
            held, n = row if held is None else held + row, n + tokens
    if n:
        yield _shard((held / n).astype(np.float32), n)


def _round(texts: DataFrame, model: Model, rate: float, fan: int = 16) -> int:
    """Trains a copy in every task on all its texts, puts the mean of their parameters into ``model``, returns the tokens read.

    ``fan`` copies meet in a task, and so on until one is left, so neither a task nor the driver holds many.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        net = Network(m.network.edges.tolist(), m.network.width).load(m.network.flat())
        if n := net.train(_read(m, batches), m.end, rate=rate):
            yield _shard(net.flat(), n)

    rows = materialize(texts.mapInArrow(run, _SHARD), "lm-round")
    while (many := rows.count()) > 1:
        rows = materialize(rows.repartition(-(-many // fan)).mapInArrow(_averaged, _SHARD), "lm-round")
    if one := rows.first():
        model.network.load(np.frombuffer(one["data"], np.float32))
    shared.destroy()
    return one["tokens"] if one else 0


def score(docs: DataFrame, model: Model, words: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, n_tokens, n_known, train_tokens, base_score, score of every whole text (null as empty: the end alone).

    ``base_score`` sums the add-one log10 share of every token.  ``score`` is the network's log10
    probability of the text, where a word outside its vocabulary has the probability of the
    unknown word times its add-one share among all such words.  Words beyond the broadcast
    ones (few of the tokens) are handed on and joined with the table of all counts.
    Repeated rows are scored each; without training texts all words are unknown.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches):
        m = shared.value
        names = _names(m)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            found = Tokens.of(batch.column(len(keep)))
            at = _frequent(names, found)
            logs = m.network.score(_numbers(m, found, at), m.end) / np.log(10)
            n, at = np.diff(found.begin), at[found.places]
            few = at < 0
            beyond = np.concatenate(([0], np.cumsum(few)))[found.begin]       # words that are not frequent, before each text
            edges, seen = (found.begin - beyond).tolist(), at[~few]
            base, other = ([float(shares[a:b].sum()) for a, b in zip(edges, edges[1:])] for shares in (m.base[seen], m.rest[seen]))
            rare = pa.ListArray.from_arrays(pa.array(beyond, pa.int32()), found.words.take(pa.array(found.places[few])))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(np.arange(row, row + len(n))), pa.array(n, pa.int64()), pa.array(np.diff(edges), pa.int64()),
                 pa.array(base, pa.float64()), pa.array(logs + np.array(other), pa.float64()), rare],
                [*keep, "_row", "n_tokens", "_known", "_base", "_score", "_rare"])
            row += len(n)

    rows = materialize(docs.select(*keep, F.col(text).alias("_text")).mapInArrow(
        run, f"{kinds}_row bigint, n_tokens bigint, _known bigint, _base double, _score double, _rare array<binary>"), "scored")
    c = F.coalesce("c", F.lit(0)).cast("double") + 1
    more = (
        rows.select("_row", F.explode("_rare").alias("word")).join(words, "word", "left").groupBy("_row").agg(
            F.count("c").alias("_known2"), F.sum(F.log10(c / (model.total + model.distinct + 1))).alias("_base2"),
            F.sum(F.log10(c / (model.rest_total + model.rest_distinct + 1))).alias("_score2"))
    )
    return rows.drop("_rare").join(more, "_row", "left").select(
        *keep, "n_tokens", (F.col("_known") + F.coalesce("_known2", F.lit(0))).alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_base2", F.lit(0.0))).alias("base_score"), (F.col("_score") + F.coalesce("_score2", F.lit(0.0))).alias("score"))
