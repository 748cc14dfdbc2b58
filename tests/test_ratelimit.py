import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from keyquarry.operators.ratelimit import admit, apply_block, rate_limit, summarize
from keyquarry.session import new_path
from keyquarry.streaming import jobs

SECOND = 1_000_000


def sequential(rows, window, limit):
    """(key, t, id, counted) in any order -> {id: (allowed, remaining, retry_after)}."""
    kept, out = {}, {}
    for key, t, i, counted in sorted(rows):
        live = [k for k in kept.get(key, []) if k > t - window]
        ok = len(live) < limit
        retry = None if ok else -((t - min(live) - window) // SECOND)
        out[i] = (ok, limit - len(live) - 1 if ok else 0, retry)
        kept[key] = live + [t] if ok and counted else live
    return out


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 60), st.booleans()), min_size=1, max_size=50),
    st.integers(1, 20), st.integers(1, 5),
)
def test_admit_equals_sequential(pairs, window, limit):
    pairs = sorted(pairs)
    t = np.array([p[0] for p in pairs], np.int64)
    counted = np.array([p[1] for p in pairs])
    rows = [("k", int(a), i, bool(c)) for i, (a, c) in enumerate(zip(t, counted))]
    want = sequential(rows, window, limit)
    got = admit(t, counted, np.zeros(0, np.int64), window, limit)[0]
    assert list(got) == [want[i][0] for i in range(len(t))]


@settings(max_examples=600, deadline=None)
@given(
    st.lists(st.integers(0, 9), min_size=2, max_size=120), st.integers(1, 100), st.integers(1, 30), st.integers(1, 6),
    st.sampled_from([0, 10**6]),
)
def test_blocks_compose_as_the_fold(gaps, cut, window, limit, room):
    t = np.cumsum(np.array(gaps, np.int64))
    cut = min(cut, len(t) - 1)
    held = np.zeros(0, np.int64)
    for block in (t[:cut], t[cut:]):
        want = admit(block, np.ones(len(block), bool), held, window, limit)[3]
        held = apply_block(summarize(block, window, limit, room), held, window, limit)
        live = block[-1] - window
        assert held[held > live].tolist() == want[want > live].tolist()


def test_a_key_always_over_its_limit_is_one_chain_of_tables():
    rng = np.random.default_rng(2)
    t = np.sort(rng.integers(0, 60_000, 40_000))
    blocks = [summarize(b, 1000, 25, 10**6) for b in np.split(t, 10)]
    assert all("last" in b for b in blocks)
    held, want = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part, block in zip(np.split(t, 10), blocks):
        held = apply_block(block, held, 1000, 25)
        want = admit(part, np.ones(len(part), bool), want, 1000, 25)[3]
        assert held[held > part[-1] - 1000].tolist() == want[want > part[-1] - 1000].tolist()


def requests(spark, rows):
    pdf = pd.DataFrame(rows, columns=["key", "t", "request_id", "counted"])
    return spark.createDataFrame(pdf).withColumn("ts", F.timestamp_micros("t").cast("timestamp_ntz"))


def make(n, keys, hot, span, seed):
    rng = np.random.default_rng(seed)
    return [
        ("hot" if rng.random() < hot else f"k{rng.integers(keys)}",
         int(rng.integers(0, span)) * SECOND + 1_700_000_000 * SECOND, i, bool(rng.random() < 0.8))
        for i in range(n)
    ]


@pytest.mark.parametrize("hot,span,window,limit", [
    (0.4, 4000, 60, 3),      # a hot key far over its limit: no two tasks agree on their own
    (1.0, 3000, 90, 7),      # one key only
    (0.5, 500_000, 60, 2),   # calm: most tasks need nothing from the one before
    (0.3, 50, 3600, 5),      # everything inside one window
])
@pytest.mark.parametrize("skip,room", [(False, 0), (True, 400), (True, 10**6), (False, 10**6)])
def test_batch_equals_sequential(spark, hot, span, window, limit, skip, room):
    data = make(3000, 40, hot, span, 7)
    want = sequential([(k, t, i, c if skip else True) for k, t, i, c in data], window * SECOND, limit)
    out = rate_limit(requests(spark, data), F.col("key"), window, limit,
                     uncounted=~F.col("counted") if skip else None, partitions=9, room=room).collect()
    assert {r.request_id: (r.allowed, r.remaining, r.retry_after) for r in out} == want


def test_quirks_denied_not_counted_and_left_open_window(spark):
    base = 1_700_000_000
    data = [("a", (base + s) * SECOND, i, True) for i, s in enumerate([0, 1, 9, 10, 11])]
    out = rate_limit(requests(spark, data), F.col("key"), 10, 2).orderBy("request_id").collect()
    # 9 is denied and leaves no trace; at 10 the request of 0 is exactly one window old and gone.
    assert [r.allowed for r in out] == [True, True, False, True, True]
    assert out[2].retry_after == 1 and out[2].remaining == 0


@pytest.mark.parametrize("delay,shuffled", [("1 second", False), ("1000 seconds", True)])
def test_stream_equals_batch_over_several_batches(spark, delay, shuffled):
    data = sorted(make(1200, 12, 0.4, 4000, 3), key=lambda r: (r[1], r[2]))
    arrival = sorted(data, key=lambda r: r[1] + r[2] * 7919 % 1000 * SECOND) if shuffled else data
    path, schema = new_path(spark, "stream-in"), None
    for i in range(3):
        part = requests(spark, arrival[i * 400:(i + 1) * 400])
        part.coalesce(1).write.parquet(f"{path}/p{i}")
        schema = part.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/p*")
    # without the delay, requests of the same second as the newest of a batch would be late
    state = new_path(spark, "s")
    out = jobs.rate_limit_stream(stream, F.col("key"), 60, 3, state, new_path(spark, "c"), uncounted=~F.col("counted"), delay=delay).collect()
    want = sequential(data, 60 * SECOND, 3)
    assert len(out) == 1200 and {r.request_id: r.decision for r in out} == {i: "allowed" if w[0] else "denied" for i, w in want.items()}


def test_stream_marks_only_rows_behind_the_delay_as_late(spark):
    base = 1_700_000_000
    path = new_path(spark, "late-in")
    batches = [[("a", 50, "1")], [("a", 20, "2"), ("a", 45, "3"), ("a", 60, "4")], [("a", 90, "5"), ("a", None, "6")]]
    for i, rows in enumerate(batches):
        part = spark.createDataFrame([(k, None if s is None else base + s, n) for k, s, n in rows], "key string, s bigint, request_id string").withColumn(
            "ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s")
        part.coalesce(1).write.parquet(f"{path}/p{i}")
    stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/p*")
    out = jobs.rate_limit_stream(stream, F.col("key"), 60, 2, new_path(spark, "s"), new_path(spark, "c"), delay="10 seconds").collect()
    assert {r.request_id: r.decision for r in out} == {"1": "allowed", "2": "late", "3": "allowed", "4": "denied", "5": "denied", "6": "allowed"}


def test_limit_must_be_positive(spark):
    with pytest.raises(ValueError):
        rate_limit(requests(spark, [("a", 0, 1, True)]), F.col("key"), 10, 0)


def test_a_change_of_tier_starts_a_new_count(spark):
    from keyquarry.operators.ratelimit import tier_rate_limit

    rows = [("u", (1_700_000_000 + i) * SECOND, i, True) for i in range(24)]
    df = requests(spark, rows).withColumn("tier", F.when(F.col("request_id") >= 12, F.lit("pro")).when(F.col("request_id") >= 3, F.lit("free")))
    out = tier_rate_limit(df, F.col("key")).orderBy("request_id").collect()
    # No tier is free: 10 of the first 12 pass; then pro starts from nothing.
    assert [r.allowed for r in out] == [True] * 10 + [False] * 2 + [True] * 12
    assert out[12].remaining == 99


def test_requests_without_a_limit_or_a_time_are_admitted(spark):
    rows = [(1, "k", 1, 1), (2, "k", 2, 1), (3, "x", 1, None), (4, "x", 2, None), (5, "k", None, 1)]
    requests = spark.createDataFrame(rows, "request_id int, key string, s int, most int").withColumn(
        "ts", F.timestamp_micros(F.col("s") * 1_000_000).cast("timestamp_ntz"))
    got = rate_limit(requests, F.col("key"), 60, F.col("most")).orderBy("request_id").collect()
    assert [(r.allowed, r.remaining, r.reset_at is None) for r in got] == [
        (True, 0, False), (False, 0, False), (True, None, True), (True, None, True), (True, None, True)]
