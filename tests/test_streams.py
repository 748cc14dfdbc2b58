import pytest
from pyspark.sql import functions as F

from keyquarry.operators import usage
from keyquarry.operators.access import pair_requests
from keyquarry.session import new_path
from keyquarry.streaming import jobs
from keyquarry.streaming.versions import Versions


def parts(spark, frames, one_by_one=True):
    """Frames written as files of one stream, one micro-batch each."""
    path = new_path(spark, "in")
    for i, df in enumerate(frames):
        df.coalesce(1).write.parquet(f"{path}/p{i}")
    reader = spark.readStream.schema(frames[0].schema)
    return (reader.option("maxFilesPerTrigger", 1) if one_by_one else reader).parquet(f"{path}/p*"), path


def run(stream):
    spark = stream.sparkSession
    return jobs.run_to_table(stream, new_path(spark, "out"), new_path(spark, "progress"))


def stamped(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl + ", s bigint").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s")


def folders(spark, name="state"):
    return new_path(spark, name), new_path(spark, "progress")


def stop_once(monkeypatch, number):
    """The stream ends with an error just before this version is committed, once."""
    commit, stopped = Versions.commit, []

    def fail(self, version, info):
        if version == number and not stopped:
            stopped.append(version)
            raise RuntimeError("lost")
        commit(self, version, info)

    monkeypatch.setattr(Versions, "commit", fail)
    return stopped


def test_alerts_equal_the_batch_form_over_batches(spark, monkeypatch):
    """Three batches out of order, one of them run again after a failure; text ids; a late error and one without a type or time."""
    rows = [("a", f"e{i:03}", 100 * i) for i in range(40)] + [("b", f"x{i}", 700 * i) for i in range(5)] + [(None, "n0", 50), (None, "n1", 3000)]
    frames = [stamped(spark, [r for n, r in enumerate(rows) if (n * 7 % 12) // 4 == k], "error_type string, event_id string") for k in range(3)]
    want = {(r.event_id, r.error_type, r.nth, r.level) for r in usage.running_error_alerts(frames[0].unionByName(frames[1]).unionByName(frames[2])).collect()}
    stopped = stop_once(monkeypatch, 1)
    stream, path = parts(spark, frames)
    state, progress = folders(spark)
    with pytest.raises(Exception, match="lost"):
        jobs.error_alerts_stream(stream, state, progress, delay="2 hours")
    for _ in range(2):          # the second time nothing new is there
        got = jobs.error_alerts_stream(stream, state, progress, delay="2 hours")
        assert stopped and got.count() == len(want)
        assert {(r.event_id, r.error_type, r.nth, r.level) for r in got.collect()} == want
    assert {r.nth for r in got.filter("error_type = 'b'").collect()} == {1, 2, 3, 4, 5}
    versions = Versions(spark, state)
    assert versions.committed() == [0, 1, 2]


def test_late_errors_are_numbered_when_they_come(spark):
    ddl = "error_type string, event_id bigint"
    frames = [stamped(spark, [("a", 1, 10_000), ("a", 2, 10_010)], ddl), stamped(spark, [("a", 3, 100), ("a", 4, 10_005), ("a", 5, 20_000)], ddl)]
    (state, progress), stream = folders(spark), parts(spark, frames)[0]
    got = jobs.error_alerts_stream(stream, state, progress, delay="1 second", close=False)
    assert {(r.event_id, r.nth) for r in got.collect()} == {(1, 1), (3, 2), (4, 3), (2, 4)}
    got = jobs.error_alerts_stream(stream, state, progress, delay="1 second")
    assert {(r.event_id, r.nth) for r in got.collect()} == {(1, 1), (3, 2), (4, 3), (2, 4), (5, 5)}


def test_one_type_is_spread_over_tasks(spark):
    """No Python groups, and no window or aggregate that takes a type whole."""
    rows = spark.range(20_000).select(F.lit("a").alias("error_type"), F.col("id").alias("event_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"))
    plan = usage.running_error_alerts(rows)._jdf.queryExecution().toString()
    assert "InPandas" not in plan and "_slice" in plan


def test_pairs_equal_batch_within_the_timeout(spark):
    left = stamped(spark, [(i, "GET", 1000 + i) for i in range(20)], "request_id bigint, method string")
    right = stamped(spark, [(i, 200, 1000 + i + (60 if i % 5 == 0 else 3)) for i in range(18)], "request_id bigint, status int")
    stream = jobs.pair_requests_stream(
        parts(spark, [left.filter("request_id < 10"), left.filter("request_id >= 10")])[0],
        parts(spark, [right.filter("request_id < 9"), right.filter("request_id >= 9")])[0])
    got = {(r.request_id, r.duration_ms) for r in run(stream).collect()}
    batch = {(r.request_id, r.duration_ms) for r in pair_requests(left, right).collect() if r.duration_ms <= 30000}
    assert got == batch and len(got) == 14


def test_new_files_only_are_scanned(spark):
    key = "sk_live_" + "0123456789abcdef" * 2
    first = spark.createDataFrame([("a.ts", f"x\n{key}")], "file string, content string")
    stream, path = parts(spark, [first])
    out, progress = new_path(spark, "out"), new_path(spark, "progress")
    assert [r.file for r in jobs.run_to_table(jobs.scan_stream(stream), out, progress).collect()] == ["a.ts"]
    spark.createDataFrame([("b.ts", key)], first.schema).coalesce(1).write.parquet(f"{path}/p9")
    again = jobs.run_to_table(jobs.scan_stream(stream), out, progress)
    assert sorted((r.file, r.line_no) for r in again.collect()) == [("a.ts", 2), ("b.ts", 1)]


def test_users_follow_billing_events_over_batches(spark, monkeypatch):
    users = spark.createDataFrame([(str(i), "free" if i != 2 else "pro", f"c{i}") for i in range(1, 41)] + [("99", "team", None)], "id string, tier string, stripe_customer_id string")
    users = users.withColumn("stripe_subscription_id", F.lit(None).cast("string")).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    ddl = "event_id bigint, customer string, type string, price_id string"
    frames = [
        stamped(spark, [(1, "c1", "customer.subscription.created", "price_pro_monthly", 10), (2, "c2", "customer.subscription.deleted", "p", 11)], ddl),
        stamped(spark, [(3, "c1", "customer.subscription.updated", "price_team_yearly", 20), (4, "cX", "customer.subscription.updated", "price_pro", 21)], ddl),
        # older events than those applied, one of the same time, one with a smaller id at the same time
        stamped(spark, [(5, "c1", "customer.subscription.deleted", "p", 15), (6, "c2", "customer.subscription.created", "price_pro_monthly", 11),
                        (0, "c1", "customer.subscription.deleted", "p", 20), (7, None, "customer.subscription.deleted", "p", 30)], ddl),
        stamped(spark, [(8, "c3", "invoice.payment_failed", None, 40)], ddl),
    ]
    snapshot, progress = folders(spark, "users")
    stopped = stop_once(monkeypatch, 1)
    stream, _ = parts(spark, frames)
    with pytest.raises(Exception, match="lost"):
        jobs.keep_users_current(stream, snapshot, users, progress, buckets=8).awaitTermination()
    jobs.keep_users_current(stream, snapshot, users, progress, buckets=8).awaitTermination()
    got = {r.id: (r.tier, r.stripe_subscription_id) for r in jobs.current_users(spark, snapshot).collect()}
    want = {str(i): ("free", None) for i in range(1, 41)} | {"1": ("team", "3"), "2": ("pro", "6"), "99": ("team", None)}
    assert stopped and got == want and jobs.current_users(spark, snapshot).columns == users.columns
    batch = usage.apply_subscription_events(users, frames[0].unionByName(frames[1]).unionByName(frames[2]))
    assert got == {r.id: (r.tier, r.stripe_subscription_id) for r in batch.collect()}
    versions = Versions(spark, snapshot)
    info = versions.info(versions.last())
    assert list(info["buckets"].values()).count(-1) >= 5          # buckets without events keep their first files

    def there(v, b):
        path, fs = versions._fs(versions.path(v, f"users/bucket={b}"))
        return fs.exists(path)

    assert all(there(v, b) for b, v in info["buckets"].items())
    replaced = [b for b, v in info["buckets"].items() if v != -1]
    assert replaced and not any(there(-1, b) for b in replaced)


def test_closing_run_writes_all_windows(spark):
    events = stamped(spark, [("a", i * 50) for i in range(100)] + [("b", 4000), (None, 10)], "kind string")
    frames = [events.filter(F.col("ts") < F.lit("1970-01-01 00:40:00").cast("timestamp_ntz")), events.filter(F.col("ts") >= F.lit("1970-01-01 00:40:00").cast("timestamp_ntz"))]
    for kind, options in (("tumbling", {"size": "10 minutes"}), ("sliding", {"size": "10 minutes", "slide": "5 minutes"}), ("session", {"gap": "2 minutes"})):
        out, progress = folders(spark, kind)
        got = jobs.closed_windows(parts(spark, frames)[0], ["kind"], out, progress, "ts", "5 minutes", kind=kind, **options)
        want = jobs.windowed_counts(events, ["kind"], "ts", kind=kind, **options)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_windows_stream_equals_batch_for_closed_windows(spark):
    events = stamped(spark, [("a", i * 50) for i in range(100)], "kind string")
    frames = [events.filter(F.col("ts") < F.lit("1970-01-01 00:40:00").cast("timestamp_ntz")),
              events.filter(F.col("ts") >= F.lit("1970-01-01 00:40:00").cast("timestamp_ntz"))]
    got = run(jobs.windowed_counts(parts(spark, frames)[0], ["kind"], "ts", size="10 minutes", delay="5 minutes")).collect()
    want = jobs.windowed_counts(events, ["kind"], "ts", size="10 minutes").collect()
    closed = {(r.window_start, r.events) for r in got}
    assert closed and closed <= {(r.window_start, r.events) for r in want} and len(closed) >= len(want) - 2


def test_late_rows_are_dropped_from_windows(spark):
    """A row is late once the watermark of the batch before last has passed its window."""
    batches = [[10_000], [11_000], [100, 20_000], [40_000]]
    frames = [stamped(spark, [("a", t) for t in b], "kind string") for b in batches]
    got = run(jobs.windowed_counts(parts(spark, frames)[0], ["kind"], "ts", size="10 minutes", delay="1 minute")).collect()
    assert sorted(r.window_start.timestamp() % 86400 for r in got) == [9600, 10800, 19800]
