"""Scan history and registry answers as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from codesift.functions import patterns as P
from codesift.operators.reports import scan_log_rollup


def scan_log_rollup_stream(
    scan_log: DataFrame, bucket: str = "1 hour", lateness: str = "1 hour"
) -> DataFrame:
    """Scans and findings per bucket; a bucket is emitted once the watermark has passed it."""
    return scan_log_rollup(scan_log.withWatermark("ts", lateness), bucket)


def answers_stream(registry: DataFrame, max_age: str = "24 hours") -> DataFrame:
    """Registry answers without exact repeats within the watermark.

    A renewed answer has its own ``checked_at`` and goes through, so that ``fresh_registry`` over what was written
    sees the newest one and its age. State is bounded by the watermark.
    """
    return registry.withWatermark("checked_at", max_age).dropDuplicatesWithinWatermark(
        ["ecosystem", "name", "exists", "checked_at"]
    )


class Answers(StatefulProcessor):
    """The newest answer about a package until it is too old. A timer tells its end."""

    def __init__(self, max_age: int) -> None:
        self.max_age = max_age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "micros bigint, exists boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.newest.get() if self.newest.exists() else None
        known = known and (known[0], known[1])
        newest = known
        for batch in rows:
            for answer in zip(batch["micros"].tolist(), batch["exists"].tolist(), strict=True):
                newest = answer if newest is None else max(newest, answer)
        changed = newest != known
        if changed:
            self.newest.update(newest)
            self.handle.registerTimer(self._end(newest[0]))
        yield self._row(key, newest, False) if changed else self._row(key, None, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.newest.get() if self.newest.exists() else None
        # The timer of an answer that was renewed meanwhile says nothing.
        ended = known is not None and self._end(known[0]) <= timerValues.getCurrentWatermarkInMs()
        if ended:
            self.newest.clear()
        yield self._row(key, known if ended else None, True)

    def _end(self, micros: int) -> int:
        """The first millisecond at which an answer is older than the age that passes."""
        return (micros + self.max_age * 1_000_000) // 1000 + 1

    @staticmethod
    def _row(key, answer: tuple[int, bool] | None, expired: bool) -> pd.DataFrame:
        rows = [] if answer is None else [(key[0], key[1], answer[1], answer[0], expired)]
        return pd.DataFrame(rows, columns=["ecosystem", "name", "exists", "micros", "expired"])

    def close(self) -> None:
        pass


def answer_changes(
    registry: DataFrame, max_age: int = P.REGISTRY_TTL_SECONDS, lateness: str = "1 hour"
) -> DataFrame:
    """(ecosystem, name, exists, checked_at, expired): newer answers as they come, and their ends.

    An answer's end is told once the watermark (the latest ``checked_at`` less ``lateness``) says that it is older than
    ``max_age`` seconds; a renewed one has no end yet. Answers that come later than the watermark are dropped. State is
    one answer for each package that is not expired.
    """
    marked = registry.withWatermark("checked_at", lateness).withColumn("micros", F.unix_micros("checked_at"))
    return (
        marked.groupBy("ecosystem", "name")
        .transformWithStateInPandas(
            Answers(max_age), "ecosystem string, name string, exists boolean, micros bigint, expired boolean", "append",
            "eventTime",
        )
        .select("ecosystem", "name", "exists", F.timestamp_micros("micros").alias("checked_at"), "expired")
    )


def current_answers(changes: DataFrame) -> DataFrame:
    """The answers that hold after the changes written so far, in any order: what ``fresh_registry`` gives."""
    return (
        changes.groupBy("ecosystem", "name")
        .agg(F.max(F.struct("checked_at", "exists", "expired")).alias("last"))
        .filter(~F.col("last.expired"))
        .select("ecosystem", "name", "last.checked_at", "last.exists")
    )
