"""Exact sliding-window admission.

A request is admitted iff fewer than ``limit`` admitted requests of its key lie in the
window before it; denied requests do not count.  So a decision depends on earlier
decisions, and a window frame cannot express it.

The rows are range partitioned on (key, time, id).  Range bounds follow the data, so a
key with a third of all requests is cut into many tasks while small keys share one.
Inside a task rows are folded in order by blocks; a task needs nothing from the others
except, for the key it starts with, the admitted times that are still in the window
(at most ``limit`` of them).  These come from one pass in which every task that lies
wholly inside one key writes what it does to any inherited times (``summarize``), and
from a second, small one that applies these summaries in order.  So the number of jobs
does not depend on the data, also for a key that is over its limit all the time.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from keyquarry.functions.access import micros, rate_key, tier_limiter_key, tier_max
from keyquarry.session import checkpoint, materialize

_LONG_AGO = np.int64(-(2**61))


def admit(t: np.ndarray, counted: np.ndarray, held: np.ndarray, window: int, limit: int):
    """Fold the ordered times of one key.

    ``held`` are admitted times before ``t``.  ``limit`` admitted requests act like that
    many slots, each free again one window after its use; the next ``limit`` admissions
    are therefore the first requests after each of the last ``limit`` releases, and a
    whole block of them is found by binary search.  Returns (allowed, in_window, oldest,
    held after).
    """
    n = len(t)
    ct = t[counted]
    hist = held[-limit:]
    start = np.concatenate([np.full(limit - len(hist), _LONG_AGO), hist]).astype(np.int64)
    taken, pos, recent = [], 0, start
    while pos < len(ct):
        block = min(limit, len(ct) - pos)
        first = np.maximum(np.searchsorted(ct, recent[:block] + window, side="left"), pos)
        step = np.arange(block)
        at = np.maximum.accumulate(first - step) + step
        at = at[at < len(ct)]
        if not len(at):
            break
        taken.append(at)
        recent = np.concatenate([recent[len(at):], ct[at]])
        if len(at) < block:
            break
        pos = int(at[-1]) + 1
    idx = np.concatenate(taken) if taken else np.zeros(0, np.int64)
    mask = np.zeros(len(ct), bool)
    mask[idx] = True
    admitted = np.concatenate([start, ct[idx]])
    is_new = np.zeros(n, bool)
    is_new[np.flatnonzero(counted)[mask]] = True
    before = limit + np.cumsum(is_new) - is_new          # admitted entries ahead of each row
    live_from = np.maximum(np.searchsorted(admitted, t - window, side="right"), 0)
    in_window = before - live_from
    allowed = in_window < limit
    oldest = admitted[np.minimum(live_from, len(admitted) - 1)]
    after = admitted[-limit:]
    return allowed, in_window, oldest, after[after > _LONG_AGO]


def _fold(key: np.ndarray, t: np.ndarray, counted: np.ndarray, limits: np.ndarray, first_held: np.ndarray, window: int):
    """Fold ordered rows of many keys; ``first_held`` belongs to the first key.

    A key that never has ``limit`` requests before one inside the window is admitted
    whole; that is seen for all keys at once.  Only the others are folded one by one.
    """
    n = len(t)
    new_run = np.ones(n, bool)
    new_run[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(new_run)
    ends = np.append(starts[1:], n)
    run = np.cumsum(new_run) - 1
    # One rising number per row lets one binary search serve every key.
    span = int(t.max() - t.min()) + window + 1
    line = run * span + (t - t.min())
    at = np.arange(n)
    in_window = at - np.searchsorted(line, line - window, side="right")
    busy = np.zeros(len(starts), bool)
    busy[run[in_window >= limits]] = True
    busy[run[~counted]] = True
    busy[0] |= len(first_held) > 0
    allowed = np.ones(n, bool)
    oldest = np.zeros(n, np.int64)
    held = t[max(starts[-1], n - int(limits[-1])):]
    for i in np.flatnonzero(busy):
        a, b = starts[i], ends[i]
        inherited = first_held if i == 0 else np.zeros(0, np.int64)
        allowed[a:b], in_window[a:b], oldest[a:b], after = admit(t[a:b], counted[a:b], inherited, window, int(limits[a]))
        if i == len(starts) - 1:
            held = after
    return allowed, in_window, oldest, held


def _after_reset(ct: np.ndarray, window: int, limit: int) -> np.ndarray | None:
    """Admitted times after the block if they do not depend on what it inherits, else None.

    A row with fewer than ``limit`` rows in the window before it is admitted whatever was
    decided earlier.  Where a whole window holds such rows only (or none), what is admitted
    in it is known, and with it all that follows.  Rows of the block's first window see rows
    of the block before and are left out.
    """
    n = len(ct)
    whole = int(np.searchsorted(ct, ct[0] + window, side="left"))
    before = np.arange(n) - np.searchsorted(ct, ct - window, side="right")
    unsure = np.flatnonzero((before >= limit) | (np.arange(n) < whole))
    start, until = unsure + 1, np.append(ct[unsure[1:]], ct[-1])
    calm = np.flatnonzero((start < n) & (until - ct[unsure] >= window))
    if not len(calm):
        return None
    first = int(start[calm[-1]])
    return admit(ct[first:], np.ones(n - first, bool), np.zeros(0, np.int64), window, limit)[3]


def summarize(ct: np.ndarray, window: int, limit: int, room: int) -> dict[str, np.ndarray]:
    """What a block of ordered counted times of one key does to any inherited times, for ``apply_block``.

    Either ``after``, if that does not depend on them; or a table, if it takes at most ``room``
    numbers; or else the times themselves.

    The table: the i-th admission of a block is no earlier than the row after the one before
    it and no earlier than the release of its slot, which is inherited or comes from the admission
    ``limit`` before.  Both bounds never fall when their arguments grow, so the i-th admission is
    the latest of those that each inherited time would lead to alone, and alone a
    release leads to what a block admits that starts empty at the first row behind it.
    Releases fall into the block's first window.  So for each row of it the table has the
    number of admissions of that start (``count``) and the last 2 * limit of them (``last``).
    """
    if (after := _after_reset(ct, window, limit)) is not None:
        return {"after": after}
    n, starts = len(ct), int(np.searchsorted(ct, ct[0] + window, side="left")) + 1
    starts = min(starts, n)
    if 2 * limit * starts > room:
        return {"times": ct}
    follow = np.append(np.searchsorted(ct, ct + window, side="left"), n)
    step = np.arange(limit)
    now = np.minimum(np.arange(starts)[:, None] + step, n)
    kept = [np.full((starts, limit), -1), np.full((starts, limit), -1), now]
    count, live = (now < n).sum(1), np.arange(starts)
    last = np.full((starts, 2 * limit), -1)

    def close(done: np.ndarray) -> None:
        # of three rounds of admissions, the newest first; rows behind the end are no admissions
        rounds = np.concatenate([k[done] for k in kept], axis=1)
        ends = (rounds < n).sum(1)
        at = ends[:, None] - 1 - np.arange(2 * limit)
        last[live[done]] = np.where(at >= 0, np.take_along_axis(rounds, np.maximum(at, 0), 1), -1)

    while len(live):
        done = kept[2][:, -1] >= n
        if done.any():
            close(done)
            live, kept = live[~done], [k[~done] for k in kept]
            continue
        after = follow[kept[2]]
        after[:, 0] = np.maximum(after[:, 0], kept[2][:, -1] + 1)
        now = np.minimum(np.maximum.accumulate(after - step, axis=1) + step, n)
        kept = [kept[1], kept[2], now]
        count[live] += (now < n).sum(1)
    recent = int(np.searchsorted(ct, ct[-1] - window, side="right"))
    return {"first": ct[:starts], "count": count, "last": last, "recent": ct[recent:], "end": np.array([n])}


def apply_block(block: dict[str, np.ndarray], held: np.ndarray, window: int, limit: int) -> np.ndarray:
    """Admitted times after a block, ordered, of those before it."""
    if "after" in block:
        return block["after"]
    if "times" in block:
        return admit(block["times"], np.ones(len(block["times"]), bool), held, window, limit)[3]
    slots = np.concatenate([np.full(limit - len(held[-limit:]), _LONG_AGO), held[-limit:]])
    first, count, n = block["first"], block["count"], int(block["end"][0])
    x = np.searchsorted(first, slots + window, side="left")
    found = x < len(first)
    of = np.where(found, count[np.minimum(x, len(first) - 1)], 0)
    place = np.arange(1, limit + 1)
    admitted = int((of + place - 1).min())
    nth = np.arange(max(admitted - limit, 0) + 1, admitted + 1)
    rows = np.full(len(nth), -1)
    width = block["last"].shape[1]
    for a in range(0, limit, 256):
        j, xs = place[a:a + 256][found[a:a + 256]], x[a:a + 256][found[a:a + 256]]
        if len(j) and len(nth):
            back = count[xs][:, None] - 1 - (nth - j[:, None])
            ok = (nth >= j[:, None]) & (back < width)
            values = np.take_along_axis(block["last"][xs], np.clip(back, 0, width - 1), 1)
            rows = np.maximum(rows, np.where(ok, values, -1).max(0))
    recent = block["recent"]
    at = rows - (n - len(recent))
    times = np.where(at >= 0, recent[np.maximum(at, 0)], _LONG_AGO)
    after = np.concatenate([slots[min(admitted, limit):], times])[-limit:]
    return after[after > _LONG_AGO]


_BLOCK = "key string, pid int, part int, kind string, max_requests bigint, data binary"
_PART = 1 << 20          # times in one row of a summary


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as arrays:
        return dict(arrays)


def _blocks(batches: Iterator[pd.DataFrame], window: int, room: int) -> Iterator[pd.DataFrame]:
    """What other tasks need of this one: a summary if it has one key, else the first key and what the last one hands on."""
    first = last = pid = None
    alone: list[np.ndarray] = []
    held, last_t, limit = np.zeros(0, np.int64), 0, 1
    for pdf in batches:
        if not len(pdf):
            continue
        key, t, counted = pdf["_key"].to_numpy(), pdf["_t"].to_numpy(), pdf["_counted"].to_numpy(bool)
        if first is None:
            first = last = key[0]
            pid = int(pdf["_at"].iloc[0]) >> 33
        if key[-1] == first:        # one key so far: its counted times are all there is to keep
            alone.append(t[counted])
        else:
            if key[0] == first and alone:       # the first key ends here; nobody needs what it hands on
                alone = []
            if key[0] != last:
                held = np.zeros(0, np.int64)
            held = _fold(key, t, counted, pdf["_limit"].to_numpy(), held, window)[3]
        last, last_t, limit = key[-1], int(t[-1]), int(pdf["_limit"].iloc[-1])
    if first is None:
        return
    rows = []
    if first != last:
        rows = [(first, pid, 0, "end", 1, b""), (last, pid, 0, "start", limit, held[held > last_t - window].astype(np.int64).tobytes())]
    else:
        times = np.concatenate(alone)
        block = summarize(times, window, limit, room) if len(times) else {"times": times}
        if "times" in block:
            for i in range(0, max(len(times), 1), _PART):
                rows.append((first, pid, i // _PART, "block", limit, _packed({"times": times[i:i + _PART]})))
        else:
            rows = [(first, pid, 0, "block", limit, _packed(block))]
    for r in rows:
        yield pd.DataFrame([r], columns=[c.split()[0] for c in _BLOCK.split(", ")])


def _inherited(blocks: DataFrame, window: int, parts: int) -> DataFrame:
    """(pid, held): the admitted times each task inherits for the key it starts with.

    A key's summaries are applied in order by one task, a row at a time; they are one small row for each task that read the key.
    """
    def run(batches):
        key, held = None, np.zeros(0, np.int64)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.key != key:
                    key, held = r.key, np.zeros(0, np.int64)
                if r.kind != "start" and r.part == 0 and len(held):
                    out.append((r.pid, held.tobytes()))
                if r.kind == "start":
                    held = np.frombuffer(r.data, np.int64)
                elif r.kind == "block":
                    block = _unpacked(r.data)
                    if "times" not in block or len(block["times"]):
                        held = apply_block(block, held, window, int(r.max_requests))
            yield pd.DataFrame(out, columns=["pid", "held"])

    # where one of a key's tasks is alone there is nothing to hand on
    shared = blocks.groupBy(F.col("key").alias("_k")).agg(F.count_distinct("pid").alias("_n")).filter("_n > 1")
    wanted = blocks.join(shared, F.col("key") == F.col("_k"), "left_semi")
    return wanted.repartition(parts, "key").sortWithinPartitions("key", "pid", "part").mapInPandas(run, "pid int, held binary")


def rate_limit(
    requests: DataFrame,
    key: Column,
    window_seconds: float,
    limit: int | Column,
    ts: str = "ts",
    order: str = "request_id",
    uncounted: Column | None = None,
    partitions: int | None = None,
    room: int = 4_000_000,
) -> DataFrame:
    """Adds allowed, remaining, reset_at and retry_after to every request.

    ``key`` is the counter key; ``limit`` may be a column that is the same (and at least
    one) for all rows of a key.  A request without a limit (an unknown tier) or without a
    time is admitted, takes no part in any count, and has no remaining or reset_at.  Equal times are taken in the order of ``order``.
    Rows where ``uncounted`` holds are decided but then taken off the count (the
    skip-successful and skip-failed options).  ``room`` bounds the numbers in a task's summary
    (2 * limit * requests in a window); beyond it a task inside one key hands on its times, eight bytes a request,
    and these are folded one after the other.
    """
    if isinstance(limit, int) and limit < 1:
        raise ValueError("limit must be at least 1")
    spark = requests.sparkSession
    window = int(window_seconds * 1_000_000)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = F.lit(True) if uncounted is None else ~F.coalesce(uncounted, F.lit(False))
    keyed = (
        requests.withColumn("_key", F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("")))
        .withColumn("_t", micros(F.col(ts)))
        .withColumn("_counted", counted)
        .withColumn("_limit", (F.lit(limit) if isinstance(limit, int) else limit).cast("bigint"))
    )
    limited = F.col("_t").isNotNull() & F.col("_limit").isNotNull()
    ranged = (
        keyed.filter(limited)
        .repartitionByRange(n, "_key", "_t", order)
        .sortWithinPartitions("_key", "_t", order)
        .withColumn("_at", F.monotonically_increasing_id())      # the task, and the row's place in it
    )
    # Range bounds are sampled anew on every run, so the cut is fixed in the shared folder.
    rows = checkpoint(ranged)

    def blocks(batches):
        return _blocks(batches, window, room)

    summaries = materialize(rows.select("_at", "_key", "_t", "_counted", "_limit").mapInPandas(blocks, _BLOCK), "admission-blocks")
    carry = materialize(_inherited(summaries, window, n), "admission-carry")
    columns = requests.columns
    task = F.shiftright(F.col("_at"), 33).cast("int")
    is_first = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) == 0
    # One row for each task; the sort restores the order if the planner does not broadcast them.
    given = rows.withColumn("_task", task).join(carry, F.col("_task") == F.col("pid"), "left").select(
        *columns, "_key", "_t", "_counted", "_limit", "_task", F.when(is_first, F.col("held")).alias("_held"), "_at").sortWithinPartitions("_at").drop("_at")

    def decide(batches):
        last, last_task, held = None, None, np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, t, counted, limits, tasks = (
                batch.column(batch.num_columns - 6 + i).to_numpy(zero_copy_only=False) for i in range(5))
            edges = [0, *(np.flatnonzero(tasks[1:] != tasks[:-1]) + 1).tolist(), len(tasks)]
            parts = []
            for a, b in zip(edges, edges[1:]):
                if tasks[a] != last_task:
                    inherited = batch.column(batch.num_columns - 1)[a].as_py()
                    held = np.frombuffer(inherited or b"", np.int64)
                elif keys[a] != last:
                    held = np.zeros(0, np.int64)
                ok, used, oldest, held = _fold(keys[a:b], t[a:b], counted[a:b].astype(bool), limits[a:b], held, window)
                parts.append((ok, used, oldest))
                last, last_task = keys[b - 1], tasks[b - 1]
            ok, used, oldest = (np.concatenate(x) for x in zip(*parts))
            # The caller's columns pass through as they are.
            yield pa.RecordBatch.from_arrays(
                batch.columns[:-6] + [
                    pa.array(ok),
                    pa.array(np.where(ok, limits - used - 1, 0)),
                    pa.array(np.where(ok, t, oldest) + window),
                    pa.array(np.where(ok, 0, -((t - oldest - window) // 1_000_000))),
                ],
                names=[*columns, "allowed", "remaining", "_reset", "retry_after"],
            )

    schema = rows.select(*columns).schema.add("allowed", "boolean").add("remaining", "long").add(
        "_reset", "long").add("retry_after", "long")
    decided = given.mapInArrow(decide, schema)
    free = keyed.filter(~limited).select(
        *columns, F.lit(True).alias("allowed"), *(F.lit(None).cast("bigint").alias(c) for c in ("remaining", "_reset", "retry_after")))
    return decided.unionByName(free).select(
        *columns, "allowed", "remaining",
        F.timestamp_micros("_reset").cast("timestamp_ntz").alias("reset_at"),
        F.when(~F.col("allowed"), F.col("retry_after")).alias("retry_after"),
    )


def tier_rate_limit(requests: DataFrame, identity: Column, tier: str = "tier", window_seconds: float = 60, **kw) -> DataFrame:
    """Requests per minute by tier; the tier is part of the counter key."""
    return rate_limit(requests, tier_limiter_key(F.col(tier), identity), window_seconds, tier_max(F.col(tier)), **kw)


def ip_rate_limit(requests: DataFrame, identity: Column, window_seconds: float = 60, limit: int = 20, **kw) -> DataFrame:
    """Limit of requests without a user."""
    return rate_limit(requests, rate_key("ip-rl", identity), window_seconds, limit, **kw)


def endpoint_rate_limit(
    requests: DataFrame, endpoint: Column, identity: Column, window_seconds: float = 60, limit: int = 30, **kw
) -> DataFrame:
    """Limit per endpoint and caller (``create-secret`` is used with 20)."""
    return rate_limit(requests, rate_key("endpoint-rl", endpoint, identity), window_seconds, limit, **kw)
