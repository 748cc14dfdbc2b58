"""Personal data against plain patterns, the graph against a plain loop, and odd rows."""

import hashlib
import math
import random
import re
import time

from keyquarry.llm import personal_data
from pyspark.sql import functions as F

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    def digits(m):
        return re.sub("[^0-9]", "", m)

    def sums(d):
        return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0

    good = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
            "card": lambda m: 12 <= len(digits(m)) <= 19 and sums(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15}
    return sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if good[k](m[0]))


def noise(n=1500):
    rnd = random.Random(4)
    parts = ["a", "Z", "9", "0", "1.2", ".", ".", "@", "@x.y", "-", " ", "+", "+1", "(", ")", "255", "256.", "4111111111111111", "4111 1111-1111 1111", "%", "_",
             "é", "٣", "😀", "\n", "000", "12.34.56.78", "+44 20 7946 0958", "user", "[at]", " (dot) ", "fe80::1:2", "card:"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def told():
    """Texts in which contexts tell a kind, and others in which they do not."""
    rnd = random.Random(7)
    words = "oak elm ash fir yew box bay fig gum".split()

    def filler():
        return " ".join(rnd.choice(words) for _ in range(6))

    out = [f"{filler()} please dial +1 555 010 {1000 + i} today {filler()}" for i in range(12)]
    out += [f"{filler()} please dial 0{200 + i} 555 90{10 + i} today {filler()}" for i in range(2)]           # by "please dial _"
    out += [f"{filler()} helpdesk extension 0200 555 9010 {filler()}"] * 3
    out += [f"{filler()} write to: user{i}@mail.example {filler()}" for i in range(9)] + [f"{filler()} write to: root [at] host (dot) example {filler()}"]
    out += [f"{filler()} order {7_000_000 + i} {filler()} dial {i}" for i in range(30)]                       # numbers that are no identifiers
    out += [f"{filler()} order +1 555 020 {2000 + i} {filler()}" for i in range(5)]
    return out


def plain_graph(texts, rounds=3, least=5, sure=800_000):
    edges, kind, fits = set(), {}, {}
    for t in texts:
        for k, f, a, b, v, found in personal_data.find(t)[1]:
            kind[v], fits[v] = max(k, kind.get(v, -1)), fits.get(v, 0) | f
            edges |= {(c, v) for c in found}
    of = {}
    for c, v in edges:
        of.setdefault(c, set()).add(v)
    of = {c: vs for c, vs in of.items() if len(vs) >= least}
    trust = {(v, k): 1_000_000 * (kind[v] == k) for v in kind for k in range(4)}
    for step in range(rounds + 1):
        score = {(c, k): sum(trust[v, k] for v in vs) // (len(vs) + 1) for c, vs in of.items() for k in range(4)}
        score = {x: s for x, s in score.items() if s >= sure}
        if step == rounds:
            return score, {(v, k) for (v, k), s in trust.items() if s >= sure}
        for v, k in trust:
            if kind[v] < 0:
                doubt = sum(round(-math.log(1 - s / 1e6) * 1e6) for (c, j), s in score.items() if j == k and v in of[c])
                trust[v, k] = round((1 - math.exp(-doubt / 1e6)) * 1e6) if fits[v] >> k & 1 else 0


def docs(spark, texts):
    rows = [(i, t, "x", "y", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, _row string, spans string, `a.b` int").repartition(4)


def test_fixed_forms_equal_the_patterns(spark):
    texts = noise() + [None, ""]
    for r in personal_data.scan(docs(spark, texts)).collect():
        want = plain(texts[r.doc_id] or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w[3] == k for w in want) for k in PLAIN)
        line = [f"{k}:{a}:{b}" for a, _, b, k in want]
        assert r.base_sha256 == hashlib.sha256(",".join(line).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("near_")] == line


def test_contexts_find_unseen_identifiers(spark):
    texts = told()
    marked = personal_data.mark(docs(spark, texts), ["doc_id"])
    patterns, identifiers = personal_data.bootstrap(marked)
    score, known = plain_graph(texts)
    assert {(r.context, r.kind): round(r.confidence * 1e6) for r in patterns.collect()} == score and ("please dial _", 3) in score
    assert {tuple(r) for r in identifiers.collect()} == known
    found = {r.doc_id: r for r in personal_data.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        near = [s.split(":") for s in found[i].spans.split(",") if s.startswith("near_")]
        shown = {(k, t[int(a):int(b)]) for k, a, b in near}
        if "please dial 0" in t or "helpdesk" in t:
            assert shown == {("near_phone", re.search(r"0\d\d[\d ]+\d", t)[0])}         # also where another context has the same value
        elif "[at]" in t:
            assert shown == {("near_email", "root [at] host (dot) example")}
        else:
            assert not shown


def test_odd_rows_and_copies(spark):
    texts = told()
    assert personal_data.scan(docs(spark, texts).limit(0)).count() == 0
    once = {r.doc_id: r.spans for r in personal_data.scan(docs(spark, texts)).collect()}
    twice = personal_data.scan(docs(spark, texts).unionAll(docs(spark, texts))).collect()
    assert len(twice) == 2 * len(texts) and all(r.spans == once[r.doc_id] for r in twice)
    nameless = docs(spark, texts[:3]).withColumn("doc_id", F.lit(None).cast("bigint"))
    assert [r.doc_id for r in personal_data.scan(nameless).collect()] == [None] * 3


def test_long_texts_take_linear_time():
    began = time.time()
    for piece in ("a", "1", "1.", "1 ", "+1", "a@", "@", "a.b@c.", "(at)", "+1 (", "1:", "A-", "x1@y.z ", "4111111111111111 "):
        personal_data.find(piece * (400_000 // len(piece)))
    assert time.time() - began < 60
