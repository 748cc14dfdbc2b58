"""Quality rules: repetition and symbols, and perplexity under a modified Kneser-Ney model."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from keyquarry.llm.bitmaps import gathered, holds, marked, part_of
from keyquarry.llm.common import giving_back
from keyquarry.llm.secret_ledger import blob
from keyquarry.llm.simhash import addressed
from keyquarry.session import materialize

ORDER = 5
_BITS = 12
_SIGNS = 1 << _BITS
_EXACT, _FOLD = 3968, 127     # signs from _EXACT on share 127 classes; 0 stands before the text
_ASCII_WHITE = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
#: What counts as a symbol.
SYMBOLS = b"#*$%&|<>"


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sequences of ORDER signs (lower case, white space as one space, packed in 60 bits) and their counts."""
    signs = np.frombuffer(" ".join((text or "").lower().split()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    signs = np.where(signs < _EXACT, np.maximum(signs, 1), _EXACT + signs % _FOLD)
    signs = np.concatenate((np.zeros(ORDER - 1, np.int64), signs))
    keys = np.zeros(max(len(signs) - ORDER + 1, 0), np.int64)
    for i in range(ORDER):
        keys = keys << _BITS | signs[i:i + len(keys)]
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    keys = np.concatenate([k for k, _ in found])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], np.concatenate([c for _, c in found])[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


@giving_back
def _count(batches, most: int = 400_000):
    """Counts by language of a task's texts.  A language's table is merged when what waits has ``most`` keys, and handed on if it has half as many then."""
    held: dict[str, list] = {}
    waiting: Counter = Counter()

    def rows(lang, keys, n):
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n, pa.int64())], ["lang", "key", "n"])

    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counted = ngrams(text)
            held.setdefault(lang, []).append(counted)
            waiting[lang] += len(counted[0])
            if waiting[lang] >= most:
                table = _merged(held.pop(lang))
                waiting[lang] = len(table[0])
                if 2 * waiting[lang] >= most:
                    yield rows(lang, *table)
                    waiting[lang] = 0
                else:
                    held[lang] = [table]
    for lang, found in held.items():
        yield rows(lang, *_merged(found))


def _lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a sorted table, and which keys are there."""
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


class KneserNey:
    """One language in memory, what ``log_shares`` computes over tables and any text beside: for each order sorted keys with the log10 probability, and sorted contexts with the log10 weight of what is left.

    The highest order has counts, lower ones the number of different signs before.  Three
    discounts for each order come from the numbers of keys that were counted one to four times.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        counts = [(keys, n)]
        for order in range(ORDER - 1, 0, -1):
            below, c = np.unique(counts[0][0] & ((1 << _BITS * order) - 1), return_counts=True)
            counts.insert(0, (below, c))
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for order, (k, c) in enumerate(counts, 1):
            by = [int((c == i).sum()) for i in range(1, 5)]
            y = by[0] / (by[0] + 2 * by[1]) if by[0] else 0.5
            discounts = np.array([0.0, *(min(max(i - (i + 1) * y * by[i] / by[i - 1], 0.1), 0.9 * i) if by[i - 1] else 0.5 * i for i in range(1, 4))])
            off = discounts[np.minimum(c, 3)]
            contexts, where = np.unique(k >> _BITS, return_inverse=True)
            total, taken = np.bincount(where, c), np.bincount(where, off)
            left = np.maximum(taken / total, 1e-12)
            lower = 10.0 ** self._log(k & ((1 << _BITS * (order - 1)) - 1), order - 1)
            self.tables.append((k, np.log10((c - off) / total[where] + left[where] * lower), contexts, np.log10(left)))

    def _log(self, keys: np.ndarray, order: int) -> np.ndarray:
        if order == 0:
            return np.full(len(keys), -np.log10(_SIGNS))
        table, logs, contexts, left = self.tables[order - 1]
        at, known = _lookup(table, keys)
        out = logs[at] if len(table) else np.zeros(len(keys))
        if not known.all():
            rest = keys[~known]
            at, seen = _lookup(contexts, rest >> _BITS)
            weight = np.where(seen, left[at] if len(left) else 0.0, 0.0)
            out[~known] = weight + self._log(rest & ((1 << _BITS * (order - 1)) - 1), order - 1)
        return out

    def bits(self, text: str | None) -> float | None:
        """Log10 perplexity by sign of a text; None if it has no sign."""
        keys, n = ngrams(text)
        return float(-(self._log(keys, ORDER) * n).sum() / n.sum()) if len(keys) else None


def _suffix(order: int):
    """The last ``order`` signs of ``key``."""
    return F.col("key").bitwiseAND(F.lit((1 << _BITS * order) - 1))


def log_shares(counts: DataFrame) -> DataFrame:
    """(lang, key, n, log): the log10 probability of each counted sequence after its context, as ``KneserNey`` has it, for a written table (lang, key, n).

    No language is held by a task: lower orders are counted from the one above, contexts are windows of at most
    4096 rows, and an order is joined to the one below by its suffix.
    """
    levels = [counts]
    for order in range(ORDER - 1, 0, -1):
        levels.insert(0, materialize(levels[0].groupBy("lang", _suffix(order).alias("key")).agg(F.count("*").alias("n")), f"ngrams-{order}"))
    lower = None
    for order, level in enumerate(levels, 1):
        by = [F.count(F.when(F.col("n") == i, 1)) for i in range(1, 5)]
        y = F.when(by[0] > 0, by[0] / (by[0] + 2 * by[1])).otherwise(0.5)
        off = [F.when(by[i - 1] > 0, F.least(F.greatest(i - (i + 1) * y * by[i] / by[i - 1], F.lit(0.1)), F.lit(0.9 * i))).otherwise(0.5 * i).alias(f"off{i}")
               for i in (1, 2, 3)]
        context = Window.partitionBy("lang", F.shiftright("key", _BITS))
        often = [F.count(F.when(c, 1)).over(context).alias(f"n{i}") for i, c in enumerate((F.col("n") == 1, F.col("n") == 2, F.col("n") > 2), 1)]
        rows = level.select("lang", "key", "n", F.sum("n").over(context).alias("total"), *often).join(F.broadcast(level.groupBy("lang").agg(*off)), "lang")
        own = F.when(F.col("n") == 1, F.col("off1")).when(F.col("n") == 2, F.col("off2")).otherwise(F.col("off3"))
        left = F.greatest(sum(F.col(f"off{i}") * F.col(f"n{i}") for i in (1, 2, 3)) / F.col("total"), F.lit(1e-12))
        if lower is None:
            below = F.lit(1 / _SIGNS)
        else:
            rows, below = rows.withColumn("suffix", _suffix(order - 1)).join(lower, ["lang", "suffix"]), F.col("below")
        share = (F.col("n") - own) / F.col("total") + left * below
        lower = rows.select("lang", F.col("key").alias("suffix"), share.alias("below"))
    return rows.select("lang", "key", "n", F.log10(share).alias("log"))


@dataclass(frozen=True)
class Shares:
    """Log10 probabilities of all counted sequences: those of high count by language (sorted keys, logs), the others as a table (lang, key, log) if there are any."""

    frequent: dict[str, tuple[np.ndarray, np.ndarray]]
    rare: DataFrame | None


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = 400_000) -> Shares:
    """A model for each language (null is a language of its own) from the counts of all whole texts, copies counted once.

    Digests are exchanged; of the texts only those that may have copies, and these are joined to one within each task before.  Spark counts, and
    every sequence has its part in the model.  Only what is broadcast reaches the driver: at most ``most`` sequences of a
    language, those of highest count by a histogram of counts.  The others stay a table, and ``measured`` joins them.
    """
    rows = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("")).alias("lang")).filter(F.col("text").isNotNull())
    rows = rows.withColumn("content", F.concat_ws(":", "lang", blob(F.col("text"))))
    copied = materialize(rows.groupBy("content").agg(F.count("*").alias("n")), "contents").filter("n > 1").select("content")
    rows = marked(rows, F.col("content"), copied, "_copied")
    copies = rows.filter("_copied").groupBy("lang", "content").agg(F.first("text").alias("text"))
    parts = [r.select("text", "lang").mapInArrow(_count, "lang string, key bigint, n bigint") for r in (rows.filter("NOT _copied"), copies)]
    counts = materialize(parts[0].unionByName(parts[1]).groupBy("lang", "key").agg(F.sum("n").alias("n")), "ngrams")
    step = F.floor(F.log2("n") * 8)                       # steps grow with the count and are under 512 in number
    histogram = counts.groupBy("lang", step.alias("step")).agg(F.count("*").alias("keys")).collect()
    least: dict[str, int] = {}
    for name in {r["lang"] for r in histogram}:
        total, least[name] = 0, 0
        for r in sorted((r for r in histogram if r["lang"] == name), key=lambda r: -r["step"]):
            total += r["keys"]
            if total > most:
                least[name] = r["step"] + 1
                break
    if not least:
        return Shares({}, None)
    logs = materialize(log_shares(counts), "ngram-logs")
    often = step >= F.create_map(*[F.lit(x) for pair in least.items() for x in pair])[F.col("lang")]
    held = logs.filter(often).select("lang", "key", "log").toArrow()
    names, keys, values = held["lang"].to_numpy(), held["key"].to_numpy(), held["log"].to_numpy()
    out = {}
    for name in least:
        own = np.flatnonzero(names == name)
        order = own[np.argsort(keys[own])]
        out[name] = keys[order], values[order]
    return Shares(out, logs.filter(~often).select("lang", "key", "log") if any(least.values()) else None)


@dataclass(frozen=True)
class Limits:
    """What the rules allow.  The band of a language lies so many robust deviations below and above its median."""

    least_words: int = 50
    most_repeated: int = 50          # percent of the words
    below: float = 10.0
    above: float = 8.0
    floor: float = 0.01              # least deviation of log10 perplexity


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); words are what ASCII white space divides."""
    raw = (text or "").encode()
    words = raw.split()
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        upto = 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    lines = [line for line in raw.split(b"\n") if line.strip()]
    chars = len(text or "") - sum(map(raw.count, _ASCII_WHITE))
    return len(words), chars, sum(raw.count(s) for s in SYMBOLS), len(lines) - len(set(lines)), repeated


_COLUMNS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean"
_SUMS = "_log double, _signs bigint, _keys array<bigint>, _often array<bigint>"
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]


def measured(docs: DataFrame, shares: Shares, keep: list[str], limits: Limits = Limits()) -> DataFrame:
    """``keep`` columns, measures, the verdict of the base rules, and ``level``: log10 perplexity by sign in ten-thousandths; written before sequences are joined.

    ``docs`` has the texts the model was learned from (``text``), their language (``_lang``, not null) and digest (``_blob``).  What the
    broadcast sequences give is summed where a text lies.  Of the others (few of a text's signs) each
    content hands on its own once, and they are joined with the table of all.  ``level`` is null where a base rule fails, and where a sequence was never counted.
    """
    shared = docs.sparkSession.sparkContext.broadcast(shares.frequent)
    at = [*keep, "_lang", "_blob"]
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in at)
    none = np.zeros(0, np.int64)

    @giving_back
    def run(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            few, often = [], []
            for t, name in zip(batch.column(len(at)).to_pylist(), batch.column(len(keep)).to_pylist()):
                m = measures(t)
                failed = m[0] < limits.least_words or 100 * m[4] > limits.most_repeated * m[0]
                keys, n = (none, none) if failed else ngrams(t)
                table, logs = shared.value.get(name, (none, none))
                place, known = _lookup(table, keys)
                for column, v in zip(rows, (*m, failed, float((logs[place[known]] * n[known]).sum()), int(n.sum()))):
                    column.append(v)
                few.append(keys[~known])
                often.append(n[~known])
            ends = pa.array(np.cumsum([0, *map(len, few)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([none, *x]), pa.int64())) for x in (few, often)]
            arrays = [*(pa.array(r, pa.int64()) for r in rows[:5]), pa.array(rows[5], pa.bool_()), pa.array(rows[6], pa.float64()), pa.array(rows[7], pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(at)], *arrays], [*at, *_NAMES, *(c.split()[0] for c in _SUMS.split(", "))])

    rows = materialize(docs.select(*at, "text").mapInArrow(run, f"{kinds}{_COLUMNS}, {_SUMS}"), "quality")
    whole = F.size("_keys") == 0
    summed = rows.filter(whole).withColumn("_more", F.lit(0.0))
    if shares.rare is not None:
        single = rows.filter(~whole).groupBy("_lang", "_blob").agg(F.first(F.arrays_zip("_keys", "_often")).alias("_rare"))
        each = single.select("_lang", "_blob", F.explode("_rare").alias("_r")).select("_lang", "_blob", F.col("_r._keys").alias("key"), F.col("_r._often").alias("_n"))
        found = each.join(shares.rare.withColumnRenamed("lang", "_lang"), ["_lang", "key"], "left").groupBy("_lang", "_blob").agg(
            F.when(F.count("log") == F.count("*"), F.sum(F.col("log") * F.col("_n"))).alias("_more"))
        summed = summed.unionByName(rows.filter(~whole).join(materialize(found, "quality-rare"), ["_lang", "_blob"], "left"))
    else:
        summed = summed.unionByName(rows.filter(~whole).withColumn("_more", F.lit(None).cast("double")))
    level = F.when(F.col("_signs") > 0, F.rint(10_000 * -(F.col("_log") + F.col("_more")) / F.col("_signs")).cast("bigint"))
    return summed.select(*at, *_NAMES, level.alias("level"))


def bands(levels: DataFrame, limits: Limits = Limits()) -> dict[str, tuple[int, int]]:
    """Lowest and highest ``level`` allowed for each language (column ``_lang``), from exact medians over all distinct contents (``_blob``).

    Copies have one level, so a text counts once however many rows have it.  The driver gets one row for each language and tenth of a percent of level, as many for any number of documents.
    """
    single = levels.filter(F.col("level").isNotNull()).groupBy("_lang", "_blob").agg(F.first("level").alias("level"))
    rounded = single.groupBy("_lang", (F.floor(F.col("level") / 10) * 10).alias("level")).agg(F.count("*").alias("n")).collect()
    found: dict[str, list] = {}
    for r in rounded:
        found.setdefault(r["_lang"], []).append((r["level"], r["n"]))
    out = {}
    for name, pairs in found.items():
        middle = _median(pairs)
        apart = max(1.4826 * _median([(abs(v - middle), n) for v, n in pairs]), 10_000 * limits.floor)
        out[name] = int(middle - limits.below * apart), int(middle + limits.above * apart)
    return out


def _median(pairs: list[tuple[int, int]]) -> int:
    half, total = sum(n for _, n in pairs) / 2, 0
    for v, n in sorted(pairs):
        total += n
        if total >= half:
            return v
    return 0


def _in_band(allowed: dict[str, tuple[int, int]]):
    if not allowed:
        return F.lit(True)
    low, high = (F.create_map(*[F.lit(x) for name, b in allowed.items() for x in (name, b[i])])[F.col("_lang")] for i in (0, 1))
    return F.coalesce((F.col("level") >= low) & (F.col("level") <= high), F.lit(True))


def judge(docs: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang", doc_id: str = "doc_id", most: int = 400_000) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every whole text.

    ``kept`` is false where a base rule fails or the perplexity lies outside the band of the row's
    language; a null language has its own model and band.  A null or empty text has no words and
    fails.  ``most`` bounds what is broadcast, not the model.  Repeated rows are measured each; columns other than the three named are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang), F.lit("")).alias("_lang"), F.col(text).alias("text"))
    rows = rows.withColumn("_blob", blob(F.col("text")))
    levels = measured(rows, learn(rows, lang="_lang", most=most), ["doc_id"], limits)
    return levels.select("doc_id", *_NAMES, _verdict(levels, limits).alias("kept"), "level")


def _verdict(levels: DataFrame, limits: Limits):
    return ~F.col("base_failed") & _in_band(bands(levels, limits))


def keep_good(docs: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang", in_files: bool = False, most: int = 400_000) -> DataFrame:
    """The rows, with all their columns, that ``judge`` keeps.

    What goes is held as bitmaps by file, and each row is looked up in those of its own file, as in ``simhash.keep_one``: the texts are read
    again instead of being moved, and not measured twice.  ``in_files`` says that ``docs`` is read from files as it is.
    """
    name = "_" * (max(map(len, docs.columns)) + 1)   # longer than any column's name
    given, _ = addressed(docs, text, text, name, in_files)
    rows = given.select(F.col(f"{name}file").alias("file"), F.col(f"{name}row").alias("row"),
                        F.coalesce(F.col(f"`{lang}`"), F.lit("")).alias("_lang"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("_blob", blob(F.col("text")))
    levels = measured(rows, learn(rows, lang="_lang", most=most), ["file", "row"], limits)
    gone = levels.filter(~_verdict(levels, limits)).select("file", "row")
    bits = gathered(gone, ["file"], "row").select(F.col("file").alias(f"{name}of"), F.col("_part").alias(f"{name}part"), F.col("_bits").alias(f"{name}bits"))
    row = F.col(f"{name}row")
    joined = given.join(bits, (F.col(f"{name}file") == F.col(f"{name}of")) & (part_of(row) == F.col(f"{name}part")), "left")
    return joined.filter(~holds(F.col(f"{name}bits"), row)).select(*[F.col(f"`{c}`") for c in docs.columns])
