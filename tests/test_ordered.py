import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyquarry.operators import ordered, usage, vectors


def test_rank_is_floor_np(spark):
    """1..4 at p50 is 3: one rank above the discrete percentile."""
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)], "operation string, duration_ms double")
    r = usage.operation_stats(df).first()
    assert (r["count"], r.avg, r.min, r.max, r.p50, r.p95, r.p99) == (4, 2.5, 1.0, 4.0, 3.0, 4.0, 4.0)


@pytest.mark.parametrize("accuracy", [20, 100, 10000])
def test_percentiles_when_the_sketch_only_brackets(spark, accuracy):
    rng = random.Random(5)
    data = []
    for g, n in (("normal", 4000), ("ties", 3000), ("one", 1), ("flat", 500), ("heavy", 3000)):
        for _ in range(n):
            v = {"normal": rng.gauss(0, 1), "ties": float(rng.randint(0, 3)), "one": 7.0, "flat": 2.0,
                 "heavy": math.exp(rng.gauss(0, 6))}[g]
            data.append((g, v))
    df = spark.createDataFrame(data, "g string, v double").repartition(8)
    ps = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    got = {r.g: r for r in ordered.exact_rank_percentiles(df, ["g"], "v", ps, accuracy).collect()}
    for g in got:
        values = sorted(v for k, v in data if k == g)
        for name, p in ps.items():
            assert got[g][name] == values[math.floor(len(values) * p)], (g, name)
    assert len(got) == 5


def test_groups_without_key_or_values_stay(spark):
    rows = [("a", 1.0), ("a", 3.0), ("a", math.nan), ("b", None), ("b", math.nan), (None, 5.0), (None, None)]
    df = spark.createDataFrame(rows, "operation string, duration_ms double")
    exact = {r.operation: r for r in usage.operation_stats(df).collect()}
    assert {k: (r["count"], r.avg, r.min, r.max, r.p50, r.p99) for k, r in exact.items()} == {
        "a": (2, 2.0, 1.0, 3.0, 3.0, 3.0), "b": (0, None, None, None, None, None), None: (1, 5.0, 5.0, 5.0, 5.0, 5.0)}
    approx = {r.operation: r for r in usage.operation_stats(df, approx=True).collect()}
    assert {k: r["count"] for k, r in approx.items()} == {"a": 2, "b": 0, None: 1}
    assert approx["b"].p50_approx is None and approx[None].p95_approx == 5.0


def test_a_wrong_bracket_is_widened(spark, monkeypatch):
    rng = random.Random(9)
    rows = [("a" if i % 3 else None, rng.gauss(0, 1)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    with monkeypatch.context() as m:
        m.setattr(ordered.F, "percentile_approx", lambda c, ps, accuracy: F.array(*[F.max(c) * 0 + 0.3 + 0.0001 * i for i in range(len(ps))]))
        got = {r.g: (r.p50, r.p95) for r in ordered.exact_rank_percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}, accuracy=10).collect()}
    for g in ("a", None):
        values = sorted(v for k, v in rows if k == g)
        assert got[g] == (values[len(values) // 2], values[math.floor(len(values) * 0.95)])


def test_daily_sketches_merge(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.expovariate(1), i % 5) for i in range(20_000)] + [("c", None, 1)]
    df = spark.createDataFrame(rows, "operation string, duration_ms double, d int").withColumn("ts", F.timestamp_seconds(F.col("d") * 86400).cast("timestamp_ntz"))
    days = usage.daily_sketches(df)
    assert days.count() == 3 * 5 + 1
    merged = usage.merged_stats(days)
    whole = {r.operation: r for r in usage.operation_stats(df).collect()}
    for r in merged.collect():
        assert (r["count"], r.min, r.max) == (whole[r.operation]["count"], whole[r.operation].min, whole[r.operation].max)
    errors = usage.rank_errors(merged, df).collect()
    assert len(errors) == 4 and all(x is None or x <= 0.005 for r in errors for x in (r.p50_error, r.p95_error, r.p99_error))
    assert [r.p50_error for r in errors if r.operation == "c"] == [None]


def test_running_count_over_slices(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"t{rng.randint(0, 5)}", rng.randint(0, 20000), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "error_type string, s bigint, event_id bigint").withColumn(
        "ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    want, seen = {}, {}
    for t, s, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        seen[t] = seen.get(t, 0) + 1
        want[i] = seen[t]
    got = usage.running_error_alerts(df).collect()
    assert {r.event_id: r.nth for r in got} == want
    assert all((r.level == "FATAL") == (r.nth >= 10) for r in got)


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, t int, v string")
    assert {r.k: r.v for r in ordered.latest_per_key(df, ["k"], ["t"]).collect()} == {"a": "y", "b": None}


def test_metrics(spark):
    rows = [("c", "counter", None, 1, 1), ("c", "counter", 4.0, 2, 2), ("g", "gauge", 1.0, 2, 3), ("g", "gauge", 9.0, 1, 4), ("h", "histogram", 5.0, 1, 5)]
    df = spark.createDataFrame(rows, "name string, kind string, value double, ts int, id int")
    scalars, hist = usage.metrics_rollup(df)
    assert {r["name"]: r.value for r in scalars.collect()} == {"c": 5.0, "g": 1.0}
    h = hist.first()
    assert (h["count"], h["sum"], h.p99) == (1, 5.0, 5.0)


def test_health_of_an_empty_table(spark):
    df = spark.createDataFrame([], "v int")
    r = usage.health_report(df, {"max": F.max("v") > 0, "rows": F.count("*") >= 0}).collect()
    assert {x["name"]: x.status for x in r} == {"max": "fail", "rows": "pass"} and r[0].overall == "unhealthy"


# ---------------------------------------------------------------- search

def brute(queries, docs, k):
    out = {}
    for q, qv, qt in queries:
        scores = []
        for d, dv, dt in docs:
            if dv is None or qt != dt:
                continue
            n = np.linalg.norm(qv) * np.linalg.norm(dv)
            if n:
                scores.append((-round(float(np.dot(qv, dv) / n), 10), d))
        out[q] = [d for _, d in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("limit", [2048, 7])
def test_search(spark, limit):
    rng = np.random.default_rng(2)
    docs = [(i, [float(x) for x in rng.normal(size=8)], int(rng.integers(0, 2))) for i in range(400)]
    docs += [(1000 + i, docs[i][1], docs[i][2]) for i in range(50)]          # copies tie by id
    docs += [(2000, None, 0), (2001, [0.0] * 8, 0)]
    queries = [(i, docs[i][1], docs[i][2]) for i in range(12)]
    q = spark.createDataFrame(queries, "query_id int, embedding array<float>, tag int")
    d = spark.createDataFrame(docs, "doc_id int, embedding array<float>, tag int").repartition(7)
    d = d.withColumn("embedding", F.col("embedding"))
    got = {}
    for r in vectors.search(q, d, 7, "tag", block=limit).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    as_float = [(i, None if v is None else np.float32(v).astype(float), t) for i, v, t in docs]
    want = brute([(i, np.float32(v).astype(float), t) for i, v, t in queries], as_float, 7)
    assert got == want
    with pytest.raises(ValueError):
        vectors.search(q, d, 21)


def test_search_prunes_far_cells_and_other_values(spark, monkeypatch):
    """Clustered vectors: equal to brute force, few pairs of rows meet, and one value with two thirds of the rows is cut."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 4
    docs = [(i, [float(x) for x in np.float32(centres[i % 12] + rng.normal(size=16) * 0.2)], ["hot", "hot", f"v{i % 40}"][i % 3]) for i in range(1500)]
    queries = [(5000 + i, [float(x) for x in np.float32(centres[i % 12] + rng.normal(size=16) * 0.2)], ["hot", "v2", "none"][i % 3]) for i in range(90)] + [(6000, [0.0] * 16, "hot")]
    q = spark.createDataFrame(queries, "query_id int, embedding array<float>, tag string")
    d = spark.createDataFrame(docs, "doc_id int, embedding array<float>, tag string")
    met = []
    scored = vectors._scored

    def counted(routed, placed, *rest):
        met.append(routed.select("name", "home").join(placed.select(F.col("name").alias("doc"), "home"), "home").count())
        return scored(routed, placed, *rest)

    monkeypatch.setattr(vectors, "_scored", counted)
    got = {}
    for r in vectors.search(q, d, 5, "tag", block=25).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    want = brute([(i, np.array(v), t) for i, v, t in queries if any(v)], [(i, np.array(v), t) for i, v, t in docs], 5)
    assert got == {i: w for i, w in want.items() if w}
    assert 30 * 5 < sum(met) < 0.35 * 31 * 1000      # of the pairs of the one large value
    assert vectors.search(q.limit(0), d, 5, "tag", block=25).count() == 0 and vectors.search(q, d.limit(0), 5).count() == 0


@pytest.mark.parametrize("tag", [None, "tag"])
def test_search_copies_rows_for_tiles_only(spark, monkeypatch, tag):
    """Vectors without clusters, all of them queries, small blocks: equal to brute force, and a row goes to no more than ``TILES`` places."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=8))], i % 3 if tag else 0) for i in range(900)]
    rows += [(2000 + i, rows[5][1], rows[5][2]) for i in range(60)]
    d = spark.createDataFrame(rows, "id int, embedding array<float>, tag int").repartition(5)
    met, scored = [], vectors._scored

    def counted(routed, placed, k, most, *rest):
        met.append((routed.count(), placed.count(), routed.groupBy("home").agg(F.ceil(F.count("*") / most).alias("parts")).agg(F.max("parts")).first()[0]))
        return scored(routed, placed, k, most, *rest)

    monkeypatch.setattr(vectors, "_scored", counted)
    monkeypatch.setattr(vectors, "TILES", 4)
    got = {}
    for r in vectors.search(d, d, 4, tag, query_id="id", doc_id="id", block=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    vectors_of = [(i, np.array(v), t) for i, v, t in rows]
    assert got == brute(vectors_of, vectors_of, 4)
    n = len(rows)
    assert met[0][0] <= n and n < met[1][0] <= (4 if tag is None else 2) * n and met[1][1] == n and met[1][2] <= 4


def test_search_keeps_names_of_any_type_and_none(spark):
    rows = [("b", [1.0, 0.0]), (None, [1.0, 0.1]), ("a", [1.0, 0.0]), ("é", [0.0, 1.0])]
    d = spark.createDataFrame(rows, "id string, embedding array<double>")
    got = [(r.query_id, r.rank, r.doc_id) for r in vectors.search(d.filter("id = 'b'"), d, 3, query_id="id", doc_id="id").orderBy("rank").collect()]
    assert got == [("b", 1, "a"), ("b", 2, "b"), ("b", 3, None)]


def test_best_rows_of_a_product_equal_a_full_sort():
    """Many equal scores, floors that are met exactly, more queries and documents than one product takes."""
    rng = np.random.default_rng(9)
    unit = vectors._unit(rng.integers(-2, 3, (9000, 3)) + np.array([0.0, 0.0, 7.0]))
    order = rng.permutation(len(unit))
    full = np.round(unit[:600] @ unit.T, vectors._DIGITS)
    kth = -np.partition(-full, 6, axis=1)[:, 6]
    for floor in (np.full(600, -2.0), kth):
        i, j, score = vectors._top(unit[:600], unit, order, 7, floor, None)
        for x in range(0, 600, 37):
            want = np.lexsort((order, -full[x]))[:7]
            assert j[i == x].tolist() == want.tolist() and score[i == x].tolist() == full[x][want].tolist()


def test_reach_is_never_passed():
    rng = np.random.default_rng(6)
    for _ in range(200):
        p, q = rng.normal(size=(2, 4))
        x = p + rng.normal(size=(50, 4)) * rng.choice([1e-9, 0.01, 1, 10])
        unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
        p, q, x = unit(p), unit(q), unit(x)
        assert (x @ q).max() <= vectors.reach(np.array([p @ q]), np.array([(x @ p).min()]))[0]


def test_search_sets_unusable_vectors_aside(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0]), (3, [7.0, 1.0, 2.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]), (7, [1e200, 1e200]), (8, [])]
    d = spark.createDataFrame(rows, "doc_id int, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [3.0])], "query_id int, embedding array<double>")
    got = {(r.query_id, r.doc_id): round(r.score, 6) for r in vectors.search(q, d, 5).collect()}
    assert got == {(1, 1): 1.0, (1, 7): 0.707107, (3, 2): 1.0}


def test_running_count_keeps_rows_without_key_or_time(spark):
    rows = [(1, "a", "2024-01-01 00:00:00"), (2, None, "2024-01-01 00:00:00"), (3, "a", None), (4, "a", "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "event_id int, kind string, at string").withColumn("ts", F.to_timestamp_ntz("at"))
    got = {r.event_id: r.nth for r in ordered.running_count(df, ["kind"], "ts", "event_id").collect()}
    assert got == {3: 1, 1: 2, 4: 3, 2: 1}
