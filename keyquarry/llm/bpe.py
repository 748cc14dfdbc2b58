"""Byte-level BPE as a lazily determinised transducer, and streaming decoding."""

from __future__ import annotations

import array
import base64
import codecs
import functools
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from keyquarry.llm.common import WHITE, Stretches


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[list[bytes], list[bytes]]:
    """BPE by its definition: join the neighbours of lowest rank, leftmost first, while any rank exists.

    Returns the parts, and the parts as they were before the last step.
    """
    parts = before = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        found = [ranks.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        if (rank := min(found)) == _NEVER:
            break
        at = found.index(rank)
        before, parts = parts, [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2:]]
    return parts, before


_NEVER = 1 << 60


class Transducer:
    """Bytes in, tokens out, for one piece of text at a time.

    A sequence of tokens is what the merges give for its bytes exactly if every two
    neighbours stay as they are when their joined bytes are merged.  So the merges are a
    nondeterministic machine that reads a token through the vocabulary's tree and goes on
    only to tokens that may stand after the last one.  A state here is a set of such
    readings, each with the tokens that not all of them share; shared ones are emitted at
    once.  A reading lives at most as long as the longest token, which bounds the
    lookahead.  States and transitions are made when they are first met; at ``most``
    transitions all are dropped and made anew as needed, so memory is bounded.
    """

    def __init__(self, ranks: dict[bytes, int], most: int = 300_000):
        self.ranks, self.most = ranks, most
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.halves: dict[int, tuple[int, int]] = {}
        for word, rank in ranks.items():
            if len(word) > 1:
                parts, before = merge(word, ranks)
                if len(parts) > 1:
                    continue  # no merges lead to it: it stands only where it is the whole piece
                self.halves[rank] = ranks[before[0]], ranks[before[1]]
            node = 0
            for b in word:
                if (below := self.children[node].get(b)) is None:
                    below = self.children[node][b] = len(self.token)
                    self.children.append({})
                    self.token.append(-1)
                node = below
            self.token[node] = rank
        self.fits: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = (((), -1, 0),)
        self.numbers = {start: 0}
        self.states = [start]
        self.final: list[tuple[int, ...]] = [()]
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.made = 0

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of ``a`` and ``b``.

        Both are taken apart again from the border outwards, latest merge first.  Two
        parts that met at the border would have been joined if their rank comes before
        the merge that put one of them into something larger (on a tie the left goes first).
        """
        if a < 0:
            return True
        if (known := self.fits.get((a, b))) is not None:
            return known
        if len(self.fits) >= self.most:
            self.fits.clear()
        left, right, left_until, right_until, fits = a, b, _NEVER, _NEVER, True
        while True:
            joined = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], _NEVER)
            if joined < left_until and joined <= right_until and joined != _NEVER:
                fits = False
                break
            if left > right and left in self.halves or right not in self.halves:
                if left not in self.halves:
                    break
                left_until, left = left, self.halves[left][1]
            else:
                right_until, right = right, self.halves[right][0]
        self.fits[a, b] = fits
        return fits

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        readings = []
        for waiting, last, node in self.states[state]:
            if (below := self.children[node].get(byte)) is None:
                continue
            if self.children[below]:
                readings.append((waiting, last, below))
            t = self.token[below]
            if t >= 0 and self._may_follow(last, t):
                readings.append(((*waiting, t), t, 0))
        shared = readings[0][0]
        for waiting, _, _ in readings[1:]:
            n = 0
            for x, y in zip(shared, waiting):
                if x != y:
                    break
                n += 1
            shared = shared[:n]
        key = tuple((w[len(shared):], last, node) for w, last, node in readings)
        if (number := self.numbers.get(key)) is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            self.final.append(next(w for w, _, node in key if node == 0))
        self.moves[state][byte] = (number, shared)
        self.made += 1
        return number, shared

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if self.made >= self.most:
            self._reset()
        out: list[int] = []
        state, moves = 0, self.moves
        for byte in piece:
            step = moves[state].get(byte)
            if step is None:
                step = self._move(state, byte)
            state = step[0]
            if step[1]:
                out += step[1]
        out += self.final[state]
        return out


class Encoder:
    """Texts to ids (packed as little-endian unsigned 32 bit) by a rank file and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        white = "".join(f"\\u{ord(c):04x}" for c in WHITE)
        pattern = pattern.replace(r"[^\s", f"[^{white}").replace(r"\s", f"[{white}]").replace(r"\S", f"[^{white}]")
        self.match = regex.compile(pattern).findall
        self.machine = Transducer(ranks)
        self.encode = Stretches(self._ids).ids

    def _ids(self, text: str) -> bytes:
        out: list[int] = []
        for piece in self.match(text):
            out += self.machine.encode(piece.encode())
        return array.array("I", out).tobytes()


class Decoder:
    """Ids to text in windows: bytes of a sign that is not complete yet wait for the next window."""

    def __init__(self, ranks: dict[bytes, int], window: int = 1 << 16):
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for word, rank in ranks.items():
            self.bytes_of[rank] = word
        self.window = window

    def decode(self, ids: np.ndarray):
        """Yields pieces of text; bytes that are no UTF-8 become replacement signs."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for at in range(0, len(ids), self.window):
            yield machine.decode(b"".join(map(self.bytes_of.__getitem__, ids[at:at + self.window].tolist())))
        yield machine.decode(b"", True)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


@functools.cache
def tools(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """One encoder and decoder per Python process; the file lies at ``path`` on every machine."""
    ranks = read_ranks(path)
    return Encoder(ranks, pattern), Decoder(ranks)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, null as empty.

    An empty text has no ids and the digests of no bytes; repeated rows are encoded each;
    other columns are not read.  Rows stay in their task: nothing is shuffled.
    """
    def run(batches):
        encoder, decoder = tools(path, pattern)
        for batch in batches:
            n, first, second = [], [], []
            for t in batch.column(1).to_pylist():
                packed = encoder.encode(t or "")
                digest = hashlib.sha256()
                for piece in decoder.decode(np.frombuffer(packed, "<u4")):
                    digest.update(piece.encode())
                n.append(len(packed) // 4)
                first.append(hashlib.sha256(packed).hexdigest())
                second.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of every whole text; a null text has no ids."""
    def run(batches):
        encoder, _ = tools(path, pattern)
        for batch in batches:
            ids = [np.frombuffer(encoder.encode(t or ""), "<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text) of rows of ids; null ids give a null text."""
    def run(batches):
        _, decoder = tools(path, pattern)
        for batch in batches:
            texts = [None if x is None else "".join(decoder.decode(np.asarray(x, np.int64))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = tokens.schema[doc_id].dataType.simpleString()
    return tokens.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
