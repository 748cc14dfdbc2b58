"""SimHash near-duplicates with Burkhard-Keller trees over shards of fingerprints."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from keyquarry.llm.bitmaps import gathered, holds, part_of
from keyquarry.llm.common import ASCII_LOWER, giving_back, parts_of, text_bytes
from keyquarry.llm.components import components
from keyquarry.session import materialize

SEED = 42
_WINDOW = 1 << 15


def fingerprint(text: bytes, size: int = 3) -> int:
    """The bits set in over half of the XXH64 values of a text's shingles of ``size`` words, repeats included.

    A text of fewer words is one shingle; one without words has fingerprint 0.
    """
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return 0
    n = max(len(words) - size + 1, 1)
    total = np.zeros(64, np.int64)
    for at in range(0, n, _WINDOW):
        part = words[at:at + _WINDOW + size - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(size)))) if len(words) > size else [b" ".join(words)]
        hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint of every whole text (null as empty) as a signed long."""
    keep = ["doc_id"] if keep is None else keep
    types = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)

    @giving_back
    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(b, size) for b in text_bytes(batch.column(len(keep)))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(found.view(np.int64))], [*keep, "fp"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{types}fp bigint")


def masks(radius: int, agree: int = 2) -> list[int]:
    """Bit masks of which two fingerprints within ``radius`` agree on one at least.

    The bits are cut into ``radius + agree`` blocks; ``radius`` bits can spoil as many
    blocks at most, so ``agree`` of them are equal.
    """
    blocks = radius + agree
    edges = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(each, agree)]


class Tree:
    """A Burkhard-Keller tree over distinct fingerprints: children keyed by the distance to their parent.

    Node numbers are the positions in ``values``.  Both building and searching treat many
    fingerprints at a node at once, with a stack instead of recursion.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: dict[int, dict[int, int]] = {}
        stack = [np.arange(len(values))] if len(values) else []
        while stack:
            members = stack.pop()
            root, rest = int(members[0]), members[1:]
            if not len(rest):
                continue
            apart = np.bitwise_count(values[rest] ^ values[root]).astype(np.int64)
            below = self.children[root] = {}
            for d in np.unique(apart):
                group = rest[apart == d]
                below[int(d)] = int(group[0])
                stack.append(group)

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, positions of the queries within ``radius`` of it); only edges that can lead to one are followed."""
        stack = [(0, np.arange(len(queries)))] if len(self.values) else []
        while stack:
            node, active = stack.pop()
            apart = np.bitwise_count(queries[active] ^ self.values[node]).astype(np.int64)
            if len(hit := active[apart <= radius]):
                yield node, hit
            for d, child in self.children.get(node, {}).items():
                if len(follow := active[np.abs(apart - d) <= radius]):
                    stack.append((child, follow))


def _forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (positions) that join everything within ``radius`` in one shard: at most one for each fingerprint."""
    label = np.arange(len(values))
    out = []
    for node, hits in Tree(values).within(values, radius):
        new, at = np.unique(label[hits], return_index=True)
        if len(new) > 1:
            own = label[node]
            out += [(node, int(hits[i])) for name, i in zip(new, at) if name != own]
            label[np.isin(label, new)] = new[0]
    return out


def _by_shard(batches, keys: int) -> Iterator[list[np.ndarray]]:
    """The columns behind the first ``keys`` of each shard; rows come sorted by shard, which may reach over batches."""
    held: list[list[np.ndarray]] = []
    last = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows - 1, bool)
        for c in columns[:keys]:
            changed |= c[1:] != c[:-1]
        begins = [0, *(np.flatnonzero(changed) + 1).tolist()]
        for a, b in zip(begins, [*begins[1:], batch.num_rows]):
            if (key := tuple(c[a] for c in columns[:keys])) != last:
                if held:
                    yield [np.concatenate(c) for c in zip(*held)]
                held, last = [], key
            held.append([c[a:b].copy() for c in columns[keys:]])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _linked(batches, radius: int):
    """Links of every shard (which, part) of fingerprints."""
    for names, in _by_shard(batches, 2):
        if len(names) > 1 and (found := np.array(_forest(names.view(np.uint64), radius), np.int64).reshape(-1, 2).tolist()):
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(names[list(a)]), pa.array(names[list(b)])], ["a", "b"])


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) that join all that are within ``radius`` bits.

    Each fingerprint goes to one shard per mask.  With two equal blocks of five a shard is
    picked by some 26 bits, and only different fingerprints are in it: a shard is large only
    if very many different fingerprints lie within a few bits of each other.
    Every shard becomes a tree and is searched with its own members; what leaves a
    shard is a forest and not all pairs.
    """
    picks = masks(radius)
    keys = F.array(*[F.struct(F.lit(i).alias("which"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("part"))
                     for i, m in enumerate(picks)])
    rows = distinct.select("fp", F.explode(keys).alias("_k")).select("_k.which", "_k.part", "fp")
    dealt = rows.repartition(parts_of(distinct.sparkSession), "which", "part").sortWithinPartitions("which", "part", "fp")
    return dealt.mapInArrow(functools.partial(_linked, radius=radius), "a bigint, b bigint")


def classes(marked: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, root) for every fingerprint of the written table ``marked``: its class, named by a fingerprint.

    Copies are one fingerprint from the first step on, however many rows have them.
    """
    distinct = materialize(marked.groupBy("fp").agg(F.lit(1).alias("_one")).select("fp"), "fingerprints")
    roots = components(links(distinct, radius))
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id): texts whose fingerprints differ in at most ``radius`` bits are linked.

    ``component_id`` is the smallest id that can be reached, the row itself included.  Null
    and empty texts have fingerprint 0 and link like others; a null id gets a class but never
    names one unless all ids of the class are null; repeated rows appear each.
    Other columns are not read; an empty table gives none.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = materialize(fingerprints(rows, size), "simhash")
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = classes(marked, radius).join(first, "fp")
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = materialize(named.join(ids, "root").select("fp", "component_id"), "classes")
    return marked.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def addressed(docs: DataFrame, text: str, doc_id: str, name: str, in_files: bool) -> tuple[DataFrame, DataFrame]:
    """(the rows with an address, ids and texts with it): ``name``file and ``name``row.

    If every row of ``docs`` is a row of a file, as read from there, file and position are the
    address, and nothing is written.  Otherwise the rows are written once with a number.
    """
    if in_files and "_metadata" not in docs.columns:
        try:
            rows = docs.select("*", F.xxhash64("_metadata.file_path").alias(f"{name}file"), F.col("_metadata.row_index").alias(f"{name}row"))
        except AnalysisException:       # not read from files
            in_files = False
    if not in_files or "_metadata" in docs.columns:
        at = F.monotonically_increasing_id()
        rows = materialize(docs.select("*", F.shiftright(at, 33).alias(f"{name}file"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias(f"{name}row")), "numbered")
    return rows, rows.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"{name}file").alias("file"), F.col(f"{name}row").alias("row"))


def keep_one(docs: DataFrame, size: int = 3, radius: int = 3, text: str = "text", doc_id: str = "doc_id", in_files: bool = False) -> DataFrame:
    """The rows, with all their columns, that stand for their class: the smallest id (nulls last), then the first row by address.

    Classes are those of ``near_duplicates``: null and empty texts are one class, repeated
    rows are copies; an empty table gives no rows.  They are found on fingerprints and addresses alone. What goes is
    held as bitmaps by file, an eighth of a byte for a row at most, and each row is looked up in those of its own
    file; the texts are read again and not moved if the planner finds the bitmaps small enough to broadcast.
    ``in_files`` says that ``docs`` is read from files as it is.
    """
    name = "_" * (max(map(len, docs.columns)) + 1)   # longer than any column's name
    rows, texts = addressed(docs, text, doc_id, name, in_files)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "file", "row")
    marks = materialize(fingerprints(texts, size, keep=["doc_id", "file", "row"]), "simhash")
    first = marks.groupBy("fp").agg(F.min(key).alias("first"))
    roots = classes(marks, radius).join(first, "fp")
    best = roots.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("best"))
    of = materialize(roots.join(best, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "best"), "classes")
    gone = marks.join(of, F.col("fp") == F.col("_fp")).filter((F.col("file") != F.col("best.file")) | (F.col("row") != F.col("best.row"))).select("file", "row")
    bits = gathered(gone, ["file"], "row").select(F.col("file").alias(f"{name}of"), F.col("_part").alias(f"{name}part"), F.col("_bits").alias(f"{name}bits"))
    row = F.col(f"{name}row")
    joined = rows.join(bits, (F.col(f"{name}file") == F.col(f"{name}of")) & (part_of(row) == F.col(f"{name}part")), "left")
    return joined.filter(~holds(F.col(f"{name}bits"), row)).select(*[F.col(f"`{c}`") for c in docs.columns])
