"""Token counts of whole texts; huge ones in overlapping chunks that are spliced at proven borders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from keyquarry.llm.common import DOUBTFUL
from keyquarry.llm.packing import stretches


def _starts(tokenizer: Tokenizer, text: str) -> list[int]:
    return [a for a, _ in tokenizer.encode(text, add_special_tokens=False).offsets]


def borders(text: str, begin: int, end: int) -> set[int]:
    """Places in a stretch where a token starts whatever stands elsewhere: a space after a sign that is no white space.

    No match of the splitting pattern and no special string reaches over such a place.
    """
    out, at = set(), text.find(" ", max(begin, 1), end)
    while at >= 0:
        if text[at - 1] not in DOUBTFUL:
            out.add(at)
        at = text.find(" ", at + 1, end)
    return out


def count_spliced(tokenizer: Tokenizer, text: str, chunk: int = 32_768, overlap: int = 512) -> int:
    """Tokens of a text, encoded in chunks that overlap.

    A chunk is encoded with offsets together with the overlap behind it, and the overlap by
    itself.  The first proven border at which a token starts in both closes the chunk, and
    the next one begins there.  Where they have none in common, the overlap is doubled, up
    to the end of the text, so the result is that of the whole text always.
    """
    total, at, n = 0, 0, len(text)
    while True:
        end, wide = at + chunk, overlap
        while True:
            own = _starts(tokenizer, text[at:end + wide])
            if end + wide >= n:
                return total + len(own)
            behind = {end + a for a in _starts(tokenizer, text[end:end + wide])}
            common = borders(text, end + 1, end + wide) & behind & {at + a for a in own}
            if common:
                splice = min(common)
                total += int(np.searchsorted(np.array(own), splice - at))
                at = splice
                break
            wide *= 2


def count_tokens(docs: DataFrame, path: str, limit: int = 512, huge: int = 65_536, chunk: int = 32_768, overlap: int = 512,
                 text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text, null as empty (0 tokens).

    Texts over ``huge`` signs go through ``count_spliced``, others through the cache of
    stretches; both give the count of the whole text.  Repeated rows are counted each,
    other columns are not read, and nothing is shuffled.
    """
    def run(batches):
        cached = stretches(path)
        tokenizer = cached.encode.args[0]
        for batch in batches:
            size, n = [], []
            for t in batch.column(1).to_pylist():
                t = t or ""
                size.append(len(t.encode()))
                n.append(count_spliced(tokenizer, t, chunk, overlap) if len(t) > huge else len(cached.ids(t)) // 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
