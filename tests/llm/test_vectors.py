"""Vector codes and hard negatives against plain integer arithmetic, with the odd cases."""

import hashlib
import math
import random

import numpy as np
import pytest

from keyquarry.llm import hard_negatives, integers, product_codes
from pyspark.sql import functions as F

DDL = "vec_id bigint, embedding array<float>, label int, v string, `a.b` int, anchor int"


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """By Python integers: {position of the row: (code, error)} and the codebooks' digest."""
    kept = [(i, n, [math.floor(1024 * x) for x in v]) for n, (i, v, _) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    usable = [r for r in kept if r[2] and len(r[2]) % parts == 0]
    size = len(usable[0][2])
    usable = [r for r in usable if len(r[2]) == size] if size else usable
    d = size // parts
    books = [[r[2][p * d:(p + 1) * d] for r in usable[:entries]] for p in range(parts)]

    def near(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, _, x in usable:
                own.setdefault(near(x[p * d:(p + 1) * d], p)[1], []).append(x[p * d:(p + 1) * d])
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e])] if e in own else c for e, c in enumerate(books[p])]
    out = {n: (None, None) for _, n, _ in kept}
    for _, n, x in usable:
        found = [near(x[p * d:(p + 1) * d], p) for p in range(parts)]
        out[n] = "".join(f"{e:02x}" for _, e in found), sum(s for s, _ in found)
    return out, hashlib.sha256(",".join(str(y) for b in books for c in b for y in c).encode()).hexdigest()


def plain_negatives(rows, chosen):
    used = [(i, y, [math.floor(256 * x) for x in v]) for i, v, y in rows
            if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    size = len(min(used)[2])
    used = [r for r in used if len(r[2]) == size]
    out = []
    for a, la, x in (r for r in used if chosen(r[0])):
        score = [(-sum(p * q for p, q in zip(x, v)), i, y) for i, y, v in used if i != a]
        for s, p, _ in sorted(r for r in score if r[2] == la)[:5]:
            hard = sorted(r for r in score if r[2] != la and -50 * s <= -100 * r[0] <= -95 * s)[:3]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(hard)]
    return sorted(out)


@pytest.fixture(scope="module")
def odd():
    """Nulls in every column, numbers that are none, ties, copies, another length, one label with most rows."""
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-0.75, -0.5, 0.1, 0.25, 1.5]) for _ in range(8)], rnd.choice([0, 0, 0, 1, None])) for i in range(-100, 300)]
    rows += rows[:20] + [(i, rows[5][1], 1) for i in range(300, 320)]
    rows += [(None, rows[0][1], 0), (400, None, 0), (401, [None] + rows[0][1][1:], 0), (402, [math.nan] * 8, 1), (403, [math.inf] * 8, 1),
             (404, [0.5] * 12, 0), (405, [], 0), (406, [0.5] * 7, 1), (350, [1000.0, -3000.0] * 4, 0)]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1, 2) for i, v, y in rows], DDL).repartition(5)


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for top, dims in ((3, 5), (300, 64), (1 << 20, 16), (1 << 28, 33)):
        a, b = rng.integers(-top, top, (37, dims)), rng.integers(-top, top + 1, (41, dims))
        a[0], b[0] = top, -top
        want = [[sum(int(p) * int(q) for p, q in zip(x, y)) for y in b] for x in a]
        assert integers.products(a, b).tolist() == want == integers.packed_products(a, b).tolist()
        if top <= 300:
            assert integers.products(a, b, 3).tolist() == want
    assert integers.packed_products(a[:0], b).shape == (0, 41) and integers.packed_products(a, b[:0]).shape == (37, 0)
    assert integers.packed_products(np.zeros((2, 3), np.int64), np.full((5, 3), 7)).tolist() == [[0] * 5] * 2


def test_codes_equal_plain_arithmetic(spark, odd):
    for rows, entries in ((odd, 256), (odd, 7), (odd[:100], 256)):
        found = product_codes.compress(frame(spark, rows), entries=entries).collect()
        want, digest = plain_codes(rows, entries=entries)
        assert sorted(map(repr, [(r.vec_id, r.code, r.error) for r in found])) == sorted(repr((rows[n][0], *w)) for n, w in want.items())
        sums = {}
        for n, (_, e) in want.items():
            if e is not None:
                sums[rows[n][2]] = sums.get(rows[n][2], 0) + e
        assert {r.codebooks_sha256 for r in found} == {digest} and {r.label_error for r in found} <= {*sums.values(), None}
        for r in found:
            assert r.vec_id is None or r.label_error in {sums.get(y) for i, _, y in rows if i == r.vec_id}
    assert product_codes.compress(frame(spark, odd).limit(0)).count() == 0
    assert product_codes.compress(frame(spark, [(1, None, 1), (2, [math.nan], 1)])).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        product_codes.compress(frame(spark, [(1, [1e30] * 8, 1)])).count()


def test_negatives_equal_plain_arithmetic(spark, odd):
    for room in (32 << 20, 500):      # one chunk of anchors, and many
        found = hard_negatives.mine(frame(spark, odd), F.col("vec_id") % 10 == 0, room=room).collect()
        want = plain_negatives(odd, lambda i: i % 10 == 0)
        assert sorted(tuple(r) for r in found) == want and want
    empty = hard_negatives.mine(frame(spark, odd).limit(0), F.lit(True))
    assert empty.count() == 0 and empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert hard_negatives.mine(frame(spark, odd), F.lit(None).cast("boolean")).count() == 0
