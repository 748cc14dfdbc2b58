"""Sum-of-squares packing of tokenised documents into sequences."""

from __future__ import annotations

import array
import functools
import zlib
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from keyquarry.llm.common import Stretches, ends_by_letter, giving_back, open_end
from keyquarry.session import materialize

PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


def packed_ids(tokenizer: Tokenizer, text: str) -> bytes:
    return array.array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class Columns(Stretches):
    """The same for columns of texts: the different words of a column are looked up once, and new ones go to the library many in a call.

    In such a call every word stands behind its space, and as no short stretch has another one, each begins with the
    only one of its tokens that starts by a space.  Texts that need more care (white space of more than one sign,
    long words, over ``long`` bytes) go through ``ids`` one by one.
    """

    def __init__(self, tokenizer: Tokenizer, most: int = 600_000, long: int = 1 << 20, together: int = 200):
        super().__init__(functools.partial(packed_ids, tokenizer), most)
        self.library, self.long, self.together = tokenizer.encode_batch_fast, long, together
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.starts = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
        self.starts[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True

    def _encoded(self, words: list[str]) -> list[bytes]:
        """Ids of short stretches, each behind a space."""
        groups = (" " + " ".join(words[i:i + self.together]) for i in range(0, len(words), self.together))
        ids = np.fromiter((i for some in batched(groups, 32) for e in self.library(list(some), add_special_tokens=False) for i in e.ids), "<u4")
        packed, at = ids.tobytes(), (4 * np.flatnonzero(self.starts[ids])).tolist()
        if len(at) != len(words):        # a vocabulary of other signs for a space
            return [self.encode(" " + w) for w in words]
        return [packed[a:b] for a, b in zip(at, [*at[1:], len(packed)])]

    def _looked_up(self, words: list[str]) -> list[bytes | None]:
        """Ids of different words behind a space; None for one that is no short stretch."""
        found = list(map(self.known.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if len(self.known) + len(missing) > self.most:
            self.older, self.known = self.known, {}
        known, older, new, marked = self.known, self.older, {}, []
        for i in missing:
            word = words[i]
            if (ids := older.get(word)) is not None:
                known[word] = ids
            elif len(word) >= 64 or open_end(word):
                continue
            elif ends_by_letter(word):
                marked.append(word)
                if (stem := word[:-1]) not in known:
                    if (ids := older.get(stem)) is not None:
                        known[stem] = ids
                    else:
                        new[stem] = None
            else:
                new[word] = None
        if new:
            known.update(zip(new, self._encoded(list(new))))
        for word in marked:
            known[word] = known[word[:-1]] + self.mark(word[-1])
        for i in missing:
            found[i] = known.get(words[i])
        return found

    def column(self, texts: pa.Array) -> list[bytes]:
        """Ids (packed) of each text, null as empty."""
        if not len(texts):
            return []
        texts = pc.fill_null(texts, "")
        short = pc.if_else(pc.greater(pc.binary_length(texts), self.long), "", texts)
        lists = pc.split_pattern(short, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten().dictionary_encode()
        places, words = flat.indices.to_numpy().astype(np.int64), flat.dictionary.to_pylist()
        found = self._looked_up(words)
        at -= at[0]
        odd = np.logical_or.reduceat(np.array([ids is None for ids in found])[places], at[:-1])
        first = [b"" if o else self.encode(words[i]) for i, o in zip(places[at[:-1]].tolist(), odd.tolist())]     # no space stands before it
        places[at[:-1]] = len(words) + np.arange(len(first))
        every = [ids or b"" for ids in found] + first
        size = np.fromiter(map(len, every), np.int64, len(every)) // 4
        length = size[places]
        upto = np.cumsum(length)
        begin = (np.cumsum(size) - size)[places] - (upto - length)
        ids, out = np.frombuffer(b"".join(every), "<u4"), []
        for a in range(0, len(texts), 256):      # some texts at a time: an index for each token is larger than the token
            x, y = at[a], at[min(a + 256, len(texts))]
            low = upto[x] - length[x]
            packed = ids[np.repeat(begin[x:y], length[x:y]) + np.arange(low, upto[y - 1])].tobytes()
            ends = (4 * (upto[at[a + 1:a + 257] - 1] - low)).tolist()
            out += [self.ids(texts[a + i].as_py()) if o else packed[b:e] for i, (o, b, e) in enumerate(zip(odd[a:a + 256].tolist(), [0, *ends], ends))]
        return out


@functools.cache
def stretches(path: str, most: int = 600_000) -> Columns:
    """One tokenizer per Python process, with the ids of up to twice ``most`` stretches and those of one column; the file lies at ``path`` on every machine."""
    return Columns(Tokenizer.from_file(path), most)


def cuts(length: int, size: int) -> list[int]:
    """Where a document's pieces begin, and its end: only what does not fit is cut, the first piece takes the odd rest."""
    return [0, *range(length % size or size, length, size), length]


def pieces(docs: DataFrame, path: str, size: int = 1024, end: int = 2, text: str = "text", doc_id: str = "doc_id", most: int = 600_000,
           together: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of the ids of every whole text followed by ``end``.

    A null or empty text is one piece with the end alone.  Repeated rows give their pieces
    each; other columns are not read.  With ``together``, so many texts are looked up at once and what a task
    learned of stretches goes when it ends, so less memory stays in use; the pieces are the same.
    """
    @giving_back
    def run(batches):
        held = stretches(path, most)
        if together:
            batches = (batch.slice(at, together) for batch in batches for at in range(0, batch.num_rows, together))
        yield from cut(held.column, batches)
        if together:
            held.forget()

    def cut(encode, batches):
        close = np.array([end], "<u4").tobytes()
        for batch in batches:
            ids, rows = batch.column(0), ([], [], [], [], [])
            for i, packed in enumerate(encode(batch.column(1))):
                packed += close
                at = cuts(len(packed) // 4, size)
                for k, (a, b) in enumerate(zip(at, at[1:])):
                    for out, v in zip(rows, (i, k, a, b - a, zlib.crc32(packed[4 * a:4 * b]))):
                        out.append(v)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, {PIECES}")


class SumOfSquares:
    """Places one length after the other where the sum over gaps of (open bins with that gap) squared becomes smallest.

    Ties go to the smaller gap.  A full bin is closed and no longer counts.
    """

    def __init__(self, size: int):
        self.size = size
        self.open = np.zeros(size + 1, np.int64)   # bins by gap; 0 and the whole size stay 0
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]
        self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of ``length``."""
        size, n = self.size, self.open
        left = size - length
        rise = 2 * n[:left] - 2 * n[length:size] + 2   # from gap g to g - length, for g from length on
        if left:
            rise[0] -= 1 + 2 * n[0]                    # the bin becomes full: only its old gap counts
            rise[n[length:size] == 0] = np.iinfo(np.int64).max
            best = int(rise.argmin())
            gap = best + length
            if rise[best] > (2 * n[left] + 1):
                gap = size
        else:
            gap = size
        if gap == size:
            number, self.made = self.made, self.made + 1
        else:
            number = self.bins[gap].pop()
            n[gap] -= 1
        if rest := gap - length:
            self.bins[rest].append(number)
            n[rest] += 1
        return number, size - gap


def pack(items: DataFrame, size: int = 1024, per_task: int = 250_000) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``; ``items`` must be a written table.

    Pieces are dealt by a hash of their identity to as many tasks as hold ``per_task``
    of them each, and every task packs its share, longest first, in one pass: it holds the
    numbers of the open bins only.  An empty table stays empty.
    """
    spark = items.sparkSession
    tasks = -(-max(items.count(), 1) // per_task)
    keys = ["doc_id", "piece", "start", "ids_crc32"]
    dealt = items.repartition(tasks, F.xxhash64(*keys)).sortWithinPartitions(F.desc("length"), *keys)
    at = items.columns.index("length")
    names = [*items.columns, "sequence_id", "offset"]

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        packer = SumOfSquares(size)
        for batch in batches:
            placed = [packer.place(n) for n in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + p[0] for p in placed], pa.int64()), pa.array([p[1] for p in placed], pa.int64())], names)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return dealt.mapInArrow(run, f"{types}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, size: int = 1024, end: int = 2, text: str = "text", doc_id: str = "doc_id", most: int = 600_000,
                   together: int | None = None) -> DataFrame:
    """Tokenises, cuts and packs; the pieces (no text) are written to the shared folder in between.  ``most`` bounds what a Python process keeps of the ids of stretches; ``together`` as in ``pieces``."""
    return pack(materialize(pieces(docs, path, size, end, text, doc_id, most, together), "pieces"), size)
