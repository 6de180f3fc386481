"""Trailing-window rate limiter over a table of requests.

A request is accepted while fewer than ``limit`` accepted requests of its key
are younger than the window; rejected requests are not recorded. The decision
depends on earlier decisions, so it is a fold in time order, but only within a
segment: after a silence as long as the window nothing is remembered.

Segments are folded side by side, each streaming through a task. For those with more
than a bounded number of requests, time is cut into ranges that hold no more of a
segment, and what follows starts from what was accepted within the window before:
at most ``limit`` rows per key. A range longer than the window is folded, with these
rows, which are accepted again. Ranges within one window are decided in one round,
side by side, by counts. So a hot key never meets in one task as a whole, and there
are no more rounds than ranges, nor than about two per window.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesift.functions import patterns as P
from codesift.session import new_table_path, written_table

RANGE_REQUESTS = 100_000_000
_SALTS = 1024
#: Slices of a window by which requests are counted, at least.
_SLICES = 256


def _micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def busy_segments(requests: DataFrame, window_seconds: int) -> DataFrame:
    """(key, cell, segment, requests): cells of one window length, numbered by silences.

    Requests are first reduced to one row per key and cell, so the ordered window
    holds at most one row per cell however hot the key is. A silence as long as
    the window always falls between two cells.
    """
    width = window_seconds * 1_000_000
    micros = _micros()
    cells = (
        requests.filter(F.col("key").isNotNull())
        .groupBy("key", F.floor(micros / width).alias("cell"))
        .agg(F.min(micros).alias("first"), F.max(micros).alias("last"), F.count("*").alias("requests"))
    )
    in_order = Window.partitionBy("key").orderBy("cell")
    silence = F.col("first") - F.lag("last").over(in_order)
    started = cells.withColumn("starts", F.when(silence >= width, 1).otherwise(0))
    return started.select(
        "key", "cell", F.sum("starts").over(in_order).alias("segment"), "requests"
    )


def _accept(limit: int, width: int):
    """Fold over sorted batches; the state is one segment's last accepted times.

    Only accepted requests cost a step: while the limit is reached, a binary search
    jumps to the first request after the oldest accepted one has left the window.
    """

    def fold(micros: np.ndarray, recorded: deque[int], accepted: np.ndarray) -> None:
        at, size = 0, len(micros)
        while at < size:
            if len(recorded) == limit:
                at += int(np.searchsorted(micros[at:], recorded[0] + width, side="left"))
                if at == size:
                    return
                recorded.popleft()
            accepted[at] = True
            recorded.append(int(micros[at]))
            at += 1

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = None
        recorded: deque[int] = deque()
        for batch in batches:
            accepted = batch["key"].isna().to_numpy().copy()
            keyed = np.flatnonzero(~accepted)
            if len(keyed):
                keys = batch["key"].to_numpy()[keyed]
                segments = batch["segment"].to_numpy()[keyed]
                micros = batch["micros"].to_numpy()[keyed]
                decided = np.zeros(len(keyed), dtype=bool)
                changes = (keys[1:] != keys[:-1]) | (segments[1:] != segments[:-1])
                bounds = [0, *(np.flatnonzero(changes) + 1).tolist(), len(keyed)]
                for start, stop in zip(bounds, bounds[1:]):
                    if (keys[start], segments[start]) != current:
                        current = (keys[start], segments[start])
                        recorded.clear()
                    fold(micros[start:stop], recorded, decided[start:stop])
                accepted[keyed] = decided
            yield batch.assign(accepted=accepted)

    return decide


def _fold_segments(placed: DataFrame, limit: int, width: int) -> DataFrame:
    types = {name: placed.schema[name].dataType.simpleString() for name in placed.columns}
    schema = ", ".join(f"{name} {kind}" for name, kind in types.items()) + ", accepted boolean"
    # Requests without a key need no order: a salt spreads them over the tasks.
    salt = F.when(F.col("key").isNull(), F.pmod(F.hash("request_id"), F.lit(_SALTS)))
    ordered = (
        placed.repartition("key", "segment", salt)
        .sortWithinPartitions("key", "segment", "micros", "request_id")
    )
    return ordered.mapInPandas(_accept(limit, width), schema)


def large_segments(segments: DataFrame, range_requests: int) -> DataFrame:
    """(key, segment) of the segments with more than ``range_requests`` requests."""
    return (
        segments.groupBy("key", "segment").agg(F.sum("requests").alias("total"))
        .filter(F.col("total") > range_requests).select("key", "segment")
    )


def time_bounds(
    placed: DataFrame, segments: DataFrame, width: int, range_requests: int
) -> list[int]:
    """Times (micros) that cut the requests so that no segment has many more than ``range_requests`` between two.

    Only segments that hold more than that are looked at, by counts per key and 256th of a window: a range ends where the
    busiest key of each such cell has used it up. The list has about one entry per ``range_requests`` requests.
    """
    large = large_segments(segments, range_requests)
    fine = max(1, width // _SLICES)
    cells = (
        placed.join(large, ["key", "segment"], "left_semi")
        .groupBy("key", F.floor(F.col("micros") / fine).alias("fine")).agg(F.count("*").alias("requests"))
        .groupBy("fine").agg(F.max("requests").alias("requests"))
    )
    total = cells.agg(F.sum("requests")).first()[0] or 0
    ranges = math.ceil(total / range_requests)
    if ranges < 2:
        return []
    shares = ", ".join(str(place / ranges) for place in range(1, ranges))
    cuts = cells.agg(F.expr(f"percentile(fine, array({shares}), requests)")).first()[0]
    return sorted({math.ceil(cut) * fine for cut in cuts})


def rounds(bounds: list[int], width: int) -> Iterator[tuple[int | None, int | None, bool]]:
    """(start, stop, side by side): ranges of time that follow each other, without an end at either side.

    Ranges that lie within one window are one round, decided side by side. There are at most about two rounds per window, and never
    more than ranges.
    """
    yield None, bounds[0], False
    at = 0
    while at < len(bounds) - 1:
        last = max(at + 1, bisect_right(bounds, bounds[at] + width) - 1)
        yield bounds[at], bounds[last], last > at + 1
        at = last
    yield bounds[-1], None, False


def _accepted_in_window(
    part: DataFrame, recent: DataFrame, limit: int, width: int, slice_width: int, stop: int
) -> DataFrame:
    """Rows of ``part``, which is no longer than the window, that are accepted after ``recent``, accepted in the window before.

    What is accepted in ``part`` stays young until its end. So places get free only as rows of ``recent`` leave the window, at
    times known beforehand, and after n requests min(accepted before + 1, places free so far) are accepted. Written out,
    that is n plus the least (free - n) so far, if below zero: counts per key, slice of time and place that got free last
    decide how many are accepted in each, and these are its first ones. No task sees more of a key than a slice.
    """
    requests = part.withColumn("freeing", F.lit(0))
    leaving = (
        recent.select(*[
            (F.col("micros") + width if name == "micros" else F.col(name) if name == "key" else F.lit(None).cast(kind)).alias(name)
            for name, kind in part.dtypes
        ]).filter(F.col("micros") < stop).withColumn("freeing", F.lit(1))
    )
    group = ["key", "slice", "freed"]
    order = ["micros", F.desc("freeing"), "request_id", "row"]
    until_here = (Window.unboundedPreceding, Window.currentRow)
    events = (
        requests.unionByName(leaving).withColumn("slice", F.floor(F.col("micros") / slice_width))
        .withColumn("freed", F.sum("freeing").over(Window.partitionBy("key", "slice").orderBy(*order).rowsBetween(*until_here)))
        .withColumn("rank", F.sum(1 - F.col("freeing")).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(*until_here)))
        .withColumn("requests", F.sum(1 - F.col("freeing")).over(Window.partitionBy(*group)))
    )
    first = written_table(events.filter(F.col("rank") <= limit), "first-requests")
    taken = recent.groupBy("key").agg(F.count("*").alias("taken"))
    so_far = Window.partitionBy("key").orderBy("slice", "freed").rowsBetween(*until_here)
    in_order = Window.partitionBy("key").orderBy("slice", "freed")
    counts = (
        first.groupBy(*group).agg(F.max("requests").alias("requests"), F.sum("freeing").alias("freeing"))
        .join(taken, "key", "left")
        .withColumn("n", F.sum("requests").over(so_far))
        .withColumn("free", limit - F.coalesce("taken", F.lit(0)) + F.sum("freeing").over(so_far))
        .withColumn("short", F.min(F.col("free") - F.col("n")).over(so_far))
        .withColumn("all", F.col("n") + F.least(F.lit(0), "short"))
        .withColumn("take", F.col("all") - F.lag("all", 1, 0).over(in_order))
        .filter("take > 0").select(*group, "take")
    )
    return first.filter("freeing = 0").join(counts, group).filter(F.col("rank") <= F.col("take"))


def rate_limit(
    requests: DataFrame,
    limit: int = P.SCAN_LIMIT,
    window_seconds: int = P.SCAN_WINDOW_SECONDS,
    range_requests: int = RANGE_REQUESTS,
) -> DataFrame:
    """Requests (``key, ts, request_id``) with ``accepted``. A null key is never limited.

    Rows stream through each task in order, so no segment is held as a whole. For large segments, rounds of time follow each
    other; what one has accepted within the last window is read by the next from the shared folder. No request passes the
    driver, and where the cuts lie does not change the result.
    """
    width = window_seconds * 1_000_000
    segments = busy_segments(requests, window_seconds)
    placed = (
        requests.withColumn("micros", _micros())
        .withColumn("cell", F.floor(F.col("micros") / width))
        .join(segments.drop("requests"), ["key", "cell"], "left")
        .select("key", "ts", "request_id", "segment", "micros")
    )
    kept = ["key", "ts", "request_id", "accepted"]
    bounds = time_bounds(placed, segments, width, range_requests)
    if not bounds:
        return _fold_segments(placed, limit, width).select(*kept)

    spark = requests.sparkSession
    large = written_table(large_segments(segments, range_requests), "large-segments")
    # In time order, so that every round reads its own files; numbered, as request ids may repeat.
    timed = written_table(
        placed.join(large, ["key", "segment"], "left_semi").select(*placed.columns)
        .repartitionByRange("micros", "request_id").sortWithinPartitions("micros", "request_id")
        .withColumn("row", F.monotonically_increasing_id()),
        "requests",
    )
    busiest = segments.agg(F.max("requests")).first()[0]
    slice_width = max(1, width // max(_SLICES, math.ceil(4 * busiest / range_requests)))
    target = new_table_path(spark, "accepted")
    done: list[tuple[str, int | None]] = []
    for place, (start, stop, side_by_side) in enumerate(rounds(bounds, width)):
        part = timed
        if start is not None:
            part = part.filter(F.col("micros") >= start)
        if stop is not None:
            part = part.filter(F.col("micros") < stop)
        young = [path for path, until in done if until > start - width]
        recent = spark.read.schema(timed.schema).parquet(*young).filter(F.col("micros") > start - width) if young else None
        if side_by_side:
            accepted = _accepted_in_window(part, recent, limit, width, slice_width, stop)
        else:
            both = part if recent is None else part.unionByName(recent)
            accepted = _fold_segments(both, limit, width).filter("accepted")
            if start is not None:
                accepted = accepted.filter(F.col("micros") >= start)
        path = f"{target}/{place}"
        accepted.select(*timed.columns).write.parquet(path)
        done.append((path, stop))
    rows = spark.read.schema(timed.schema).parquet(*[path for path, _ in done])
    found = timed.join(rows.select("row", F.lit(True).alias("accepted")), "row", "left")
    decided = found.withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    # Requests without a time fall into no range.
    small = placed.filter(F.col("micros").isNotNull()).join(large, ["key", "segment"], "left_anti").select(*placed.columns)
    return decided.select(*kept).unionByName(_fold_segments(small, limit, width).select(*kept))
