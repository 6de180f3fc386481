"""The rate limiter in batch and as a stream against a plain loop."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codesift.operators.rate_limit import busy_segments, rate_limit, rounds, time_bounds
from codesift.streaming.rate_limit import Limiter, limiter_state, rate_limit_stream

START = datetime(2024, 1, 1)


def _loop(requests, limit, window):
    hits, out = {}, {}
    for key, ts, request_id in sorted(requests, key=lambda r: (r[1], r[2])):
        if key is None:
            out[request_id] = True
            continue
        kept = [t for t in hits.get(key, []) if (ts - t).total_seconds() < window]
        out[request_id] = len(kept) < limit
        hits[key] = kept + [ts] if out[request_id] else kept
    return out


def _requests(seed, count=1500):
    rng = random.Random(seed)
    rows, now = [], START
    for number in range(count):
        now += timedelta(seconds=rng.choice([0, 1, 5, 30, 300, 3600, 4000]) * rng.random() // 1)
        # One key holds about a third of the requests.
        key = "hot" if rng.random() < 0.34 else rng.choice(["a", "b", "c", None])
        rows.append((key, now, number))
    return rows


@pytest.mark.parametrize("limit,window", [(5, 3600), (1, 60), (2, 7200)])
def test_batch_is_the_loop(spark, limit, window):
    rows = _requests(limit)
    frame = spark.createDataFrame(rows, "key string, ts timestamp, request_id long").repartition(5)
    got = {r["request_id"]: r["accepted"] for r in rate_limit(frame, limit, window).collect()}
    assert got == _loop(rows, limit, window)


@pytest.mark.parametrize("limit,window", [(5, 3600), (1, 600), (3, 1800)])
def test_hot_segments_are_cut_into_ranges_of_time(spark, limit, window):
    rng = random.Random(limit)
    rows, now = [], START
    for number in range(900):
        now += timedelta(seconds=rng.choice([0, 1, 20, 200, 200, 9000 if rng.random() < 0.1 else 3]))
        key = "hot" if rng.random() < 0.6 else rng.choice(["warm", "a", "b", None])
        rows.append((key, now, number))
    # Requests at the same instant and exactly one window apart.
    rows += [("hot", START, 10_000 + i) for i in range(12)]
    rows += [("hot", START + timedelta(seconds=window), 20_000 + i) for i in range(12)]
    frame = spark.createDataFrame(rows, "key string, ts timestamp, request_id long").repartition(4)
    width = window * 1_000_000
    placed = frame.withColumn("micros", F.unix_micros("ts")).withColumn("cell", F.floor(F.col("micros") / width)).join(
        busy_segments(frame, window).drop("requests"), ["key", "cell"])
    assert len(time_bounds(placed, busy_segments(frame, window), width, 30)) > 3
    got = {r["request_id"]: r["accepted"] for r in rate_limit(frame, limit, window, 30).collect()}
    assert got == _loop(rows, limit, window)


def test_rounds_grow_with_windows_not_with_ranges():
    """A window that is cut into many ranges is one round; ranges longer than the window stay single."""
    bounds = [*range(0, 3000, 10), 10_000, 20_000]
    made = list(rounds(bounds, 1000))
    assert [made[0][0], made[-1][1]] == [None, None] and all(a[1] == b[0] for a, b in zip(made, made[1:]))
    assert len(made) < 10 and any(together for *_, together in made)
    assert all(stop - start <= 1000 for start, stop, together in made if together)
    assert not any(together for start, *_, together in made if start is None or start >= 2990)


@pytest.mark.parametrize("limit,window", [(1, 400), (4, 900), (30, 900), (500, 900)])
def test_ranges_within_a_window_are_decided_side_by_side(spark, limit, window):
    """Many ranges per window, instants with several requests, keys that never reach the limit, repeated ids."""
    rng = random.Random(limit)
    rows, now = [], START
    for number in range(3000):
        now += timedelta(milliseconds=rng.choice([0, 0, 300, 1500, 40_000 if rng.random() < 0.02 else 900]))
        rows.append((rng.choice(["hot", "hot", "hot", "warm", "a", None]), now, number))
    rows += [("hot", START + timedelta(seconds=window), 5000 + k) for k in range(40)]
    rows += [("rare", START + timedelta(seconds=500 * k), 6000 + k) for k in range(6)]
    frame = spark.createDataFrame(rows, "key string, ts timestamp, request_id long").repartition(3)
    got = {r["request_id"]: r["accepted"] for r in rate_limit(frame, limit, window, 20).collect()}
    assert got == _loop(rows, limit, window)
    twice = rate_limit(frame.withColumn("request_id", F.lit(7)), limit, window, 20)
    assert twice.count() == len(rows)
    accepted = Counter(key for key, _, number in rows if got[number])
    assert {r["key"]: r["count"] for r in twice.filter("accepted").groupBy("key").count().collect()} == accepted


def test_ranges_leave_out_requests_without_a_time(spark):
    rows = [("hot", START + timedelta(seconds=k), k) for k in range(200)]
    odd = [("hot", START + timedelta(seconds=700), None), ("a", START, None), (None, START, None)]
    timeless = [("hot", None, 1000), ("a", None, 1001), (None, None, 1002)]
    frame = spark.createDataFrame(rows + odd + timeless, "key string, ts timestamp, request_id long")
    got = rate_limit(frame, 3, 600, 10).collect()
    assert sorted(map(str, (r[:3] for r in got))) == sorted(map(str, rows + odd))
    assert sorted((str(r["key"]), str(r["request_id"])) for r in got if r["accepted"]) == [
        ("None", "None"), ("a", "None"), ("hot", "0"), ("hot", "1"), ("hot", "2"), ("hot", "None")]


def test_small_arrow_batches_carry_state(spark):
    rows = _requests(9)
    frame = spark.createDataFrame(rows, "key string, ts timestamp, request_id long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["request_id"]: r["accepted"] for r in rate_limit(frame).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == _loop(rows, 5, 3600)


def test_a_silence_of_exactly_the_window_starts_a_segment(spark):
    rows = [("k", START, 1), ("k", START + timedelta(seconds=60), 2),
            ("k", START + timedelta(seconds=119), 3)]
    frame = spark.createDataFrame(rows, "key string, ts timestamp, request_id long")
    segments = {r["cell"]: r["segment"] for r in busy_segments(frame, 60).collect()}
    assert sorted(segments.values()) == [0, 1]
    got = {r["request_id"]: r["accepted"] for r in rate_limit(frame, 1, 60).collect()}
    assert got == {1: True, 2: True, 3: False}


def test_stream_is_the_batch(spark, tmp_path):
    rows = [r for r in _requests(4, 600) if r[0] is not None]
    schema = "key string, ts timestamp, request_id long"
    last = rows[-1][1]
    # Three files in time order, shuffled within each by less than the lateness, then
    # one late request that closes everything before it.
    third = len(rows) // 3
    parts = [rows[:third], rows[third : 2 * third], rows[2 * third :],
             [("end", last + timedelta(days=2), 10**6)], [("end", last + timedelta(days=4), 10**6 + 1)]]
    folder = str(tmp_path / "in")
    for number, part in enumerate(parts):
        random.Random(number).shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    )
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    query = (
        rate_limit_stream(stream, 5, 3600, "30 days")
        .writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    # With a lateness above the whole range nothing may be decided yet.
    assert spark.read.schema("key string, accepted boolean").parquet(out).count() == 0

    out, checkpoint = str(tmp_path / "out2"), str(tmp_path / "cp2")
    ordered = stream.withColumn("ts", F.col("ts"))
    query = (
        rate_limit_stream(ordered, 5, 3600, "1 day")
        .writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    got = {r["request_id"]: r["accepted"] for r in spark.read.parquet(out).collect()}
    expected = _loop(rows, 5, 3600)
    assert {k: v for k, v in got.items() if k < 10**6} == expected


def test_stream_goes_on_from_the_batch(spark, tmp_path):
    """Decisions of the batch limiter up to a time, then of the stream: as if the batch had decided all."""
    rows = [r for r in _requests(5, 400) if r[0] is not None]
    schema = "key string, ts timestamp, request_id long"
    half = len(rows) // 2
    while rows[half][1] == rows[half - 1][1]:
        half += 1
    since = rows[half][1]
    decided = rate_limit(spark.createDataFrame(rows[:half], schema), 3, 3600)
    state = limiter_state(decided, F.lit(since), 3600)
    assert state.groupBy("key").count().filter("count > 3").count() == 0 and state.count() > 0
    folder = str(tmp_path / "in")
    for part in (rows[half:], [("end", rows[-1][1] + timedelta(days=2), 10**6)], [("end", rows[-1][1] + timedelta(days=4), 10**6 + 1)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = str(tmp_path / "out")
    query = (
        rate_limit_stream(stream, 3, 3600, "1 hour", state).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    got = {r["request_id"]: r["accepted"] for r in decided.collect() + spark.read.parquet(out).collect()}
    whole = _loop(rows, 3, 3600)
    assert {k: v for k, v in got.items() if k < 10**6} == whole
    alone = _loop(rows[half:], 3, 3600)
    assert any(alone[k] != whole[k] for k in alone)  # without the state it would differ


def test_state_grows_with_new_requests_only():
    """Of what waits, a batch reads and writes only the seconds into which its own requests fall."""
    touched = []

    class Waiting(dict):
        def containsKey(self, key):
            return key in self

        def getValue(self, key):
            return self[key]

        def updateValue(self, key, value):
            touched.append(key[0])
            self[key] = value

    class Handle:
        timers = []

        def registerTimer(self, at):
            self.timers.append(at)

    limiter = Limiter(3, 60_000_000)
    limiter.handle, limiter.waiting = Handle(), Waiting()
    for batch in range(50):
        frame = pd.DataFrame({"micros": [batch * 2_000_000 + k for k in range(4)], "request_id": range(4)})
        list(limiter.handleInputRows(("k",), iter([frame]), None))
        assert touched == [2 * batch]
        touched.clear()
    assert Handle.timers == [(2 * batch + 1) * 1000 for batch in range(50)]
