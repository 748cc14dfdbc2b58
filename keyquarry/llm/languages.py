"""Language identification by rank-order profiles of letter n-grams."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from keyquarry.llm.common import giving_back
from keyquarry.llm.secret_ledger import blob
from keyquarry.session import materialize

UNKNOWN = "und"
PROFILE = 300
_BITS = 21


@functools.cache
def _letters() -> np.ndarray:
    """Lower-case letter of each code point, 0 where it is no letter."""
    table = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            table[c] = ord(ch.lower()[0])
    return table


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct n-grams (1 to 3 letters, packed; word borders count as a sign) and their counts.

    None if the text is null or has no letter.
    """
    if not text:
        return None
    signs = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    if not signs.any():
        return None
    signs = np.concatenate(([0], signs, [0]))
    s = signs[(signs != 0) | (np.concatenate(([1], signs[:-1])) != 0)]
    two = s[:-1] << _BITS | s[1:]
    three = (two[:-1] << _BITS | s[2:])[s[1:-1] != 0]
    keys = np.concatenate((s[s != 0], two, three))
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def ranked(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by the n-gram."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Rank lists of all languages as one table: distinct n-grams by languages."""

    def __init__(self, lists: dict[str, np.ndarray], size: int = PROFILE):
        self.names, self.size = sorted(lists), size
        self.keys = np.unique(np.concatenate([lists[n] for n in self.names])) if lists else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.keys) + 1, len(self.names)), -1, np.int64)
        for i, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.keys, lists[name]), i] = np.arange(len(lists[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language at the smallest out-of-place distance (ties: first name), and 1 - distance / largest possible."""
        return self.measure(text)[:2]

    def measure(self, text: str | None) -> tuple[str, float, float, int]:
        """As ``predict``, with the lead of the score on the second language's (on 0 if there is one language) and the number of distinct n-grams."""
        counted = grams(text)
        if counted is None or not self.names:
            return UNKNOWN, 0.0, 0.0, 0
        own = ranked(*counted, self.size)
        at = np.searchsorted(self.keys, own)
        at[(at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] != own)] = len(self.keys)
        theirs = self.ranks[at]
        apart = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(own))[:, None])).sum(0)
        best = int(apart.argmin())
        scores = 1 - apart / (self.size * len(own))
        second = np.delete(scores, best).max(initial=0.0)
        return self.names[best], float(scores[best]), float(scores[best] - second), len(counted[0])


@giving_back
def _count(batches):
    for batch in batches:
        held: dict[str, list] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if (counted := grams(text)) is not None:
                held.setdefault(lang, []).append(counted)
        for lang, found in held.items():
            keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            n = np.bincount(where, np.concatenate([c for _, c in found])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "key", "n"])


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = 3000,
          size: int = PROFILE) -> Profiles:
    """Rank-order profiles from labelled rows (null labels and texts are left out).

    The fit reads about ``per_language`` rows of each language, or all if there are fewer,
    chosen by a hash of the key: the number of rows per language is counted first.  What
    reaches the driver are ``size`` n-grams per language.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(doc_id).alias("key")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = {r["lang"]: min(1.0, per_language / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return Profiles({}, size)
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
    chosen = rows.filter(F.pmod(F.xxhash64("key", F.lit("profile")), F.lit(1 << 20)) < share * (1 << 20))
    counts = chosen.select("text", "lang").mapInArrow(_count, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).collect()
    lists: dict[str, list] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        lists.setdefault(r["lang"], []).append(r["key"])
    return Profiles({k: np.array(v, np.int64) for k, v in lists.items()}, size)


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` of every whole text.

    A null text, or one without a letter, gets ``und`` and 0, as does every text if nothing
    was learned.  Repeated rows and ties give the same result each; other columns of the
    input, whatever their names, are not read.
    """
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    @giving_back
    def run(batches):
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{types}, lang_pred string, score double")


def floors(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", low: float = 0.01,
           margin: float = 0.05) -> dict[str, tuple[float, float]]:
    """Least score and least lead for each language, from the labelled rows (null labels and texts are left out).

    Each half of the contents is measured by profiles of the other half, so no text is
    measured by a profile it is part of.  Of the distinct contents whose label is found, the
    quantile ``low`` counts, less its distance to the median or ``margin``, whichever is
    more.  A language that only one half has gets no floor.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(doc_id).alias("key")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("blob", blob(F.col("text")))
    half = F.pmod(F.xxhash64("blob", F.lit("half")), F.lit(2))
    found = None
    for i in (0, 1):
        part = measured(rows.filter(half == 1 - i), learn(rows.filter(half == i), doc_id="key"), keep=["lang", "blob"])
        found = part if found is None else found.unionAll(part)
    right = materialize(found.filter("lang = lang_pred").select("lang", "blob", "score", "lead"), "language-scores")
    single = right.groupBy("lang", "blob").agg(F.first("score").alias("score"), F.first("lead").alias("lead"))
    out: dict[str, list[float]] = {}
    for column in ("score", "lead"):
        steps: dict[str, list] = {}
        for r in single.groupBy("lang", F.floor(F.col(column) * 1000).alias("step")).agg(F.count("*").alias("n")).collect():
            steps.setdefault(r["lang"], []).append((r["step"] / 1000, r["n"]))
        for name, pairs in steps.items():
            least, middle = _quantile(pairs, low), _quantile(pairs, 0.5)
            out.setdefault(name, []).append(max(least - max(middle - least, margin), 0.0))
    return {name: (score, lead) for name, (score, lead) in out.items()}


def _quantile(pairs: list[tuple[float, int]], share: float) -> float:
    wanted, total = share * sum(n for _, n in pairs), 0
    for v, n in sorted(pairs):
        total += n
        if total >= wanted:
            return v
    return 0.0


def measured(docs: DataFrame, profiles: Profiles, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with ``lang_pred``, ``score`` and ``lead`` of every whole text."""
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    @giving_back
    def run(batches):
        for batch in batches:
            found = [shared.value.measure(t) for t in batch.column(len(keep)).to_pylist()]
            arrays = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], *arrays], [*keep, "lang_pred", "score", "lead"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{types}, lang_pred string, score double, lead double")


def keep_known(docs: DataFrame, profiles: Profiles, text: str = "text", least: float = 0.02, least_grams: int = 20,
               allowed: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """The rows, with all their columns, whose text has a language.

    It has ``least_grams`` distinct n-grams, a score of ``least`` and of the language's floor in
    ``allowed`` (see ``floors``), and the lead given there on the second language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    at = docs.columns.index(text)
    bars = allowed or {}

    def known(t: str | None) -> bool:
        lang, score, lead, n = shared.value.measure(t)
        floor, ahead = bars.get(lang, (0.0, 0.0))
        return lang != UNKNOWN and n >= least_grams and score >= max(least, floor) and lead >= ahead

    @giving_back
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([known(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
