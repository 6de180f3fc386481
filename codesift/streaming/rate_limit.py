"""The rate limiter on a stream: requests wait for the watermark, then fold in time order.

Waiting requests are a map from a short stretch of time to the requests in it, so a batch writes the stretches that its
own requests fall into and nothing else, however many are waiting. A timer per stretch fires when the watermark has passed
its end: then no earlier request can come. Beside it, state is the last accepted times of the key, at most ``limit``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from codesift.functions import patterns as P

#: Length of a stretch of time in milliseconds.
STRETCH_MS = 1000
_DECIDED = "key string, micros bigint, request_id bigint, accepted boolean"


class Limiter(StatefulProcessor):
    """Decides the requests of a key once the watermark has passed them."""

    def __init__(self, limit: int, width: int) -> None:
        self.limit, self.width = limit, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState(
            "waiting", "stretch bigint", "requests array<struct<micros: bigint, request_id: bigint>>"
        )
        self.recorded = handle.getValueState("recorded", "times array<bigint>")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """``initialState``: accepted times (micros) of earlier decisions."""
        self._keep(sorted(initialState["micros"].tolist())[-self.limit :])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, list[tuple[int, int]]] = {}
        for batch in rows:
            for micros, request_id in zip(batch["micros"].tolist(), batch["request_id"].tolist(), strict=True):
                new.setdefault(micros // (STRETCH_MS * 1000), []).append((micros, request_id))
        for stretch, requests in new.items():
            if self.waiting.containsKey((stretch,)):
                requests = [tuple(each) for each in self.waiting.getValue((stretch,))[0]] + requests
            else:
                self.handle.registerTimer((stretch + 1) * STRETCH_MS)
            self.waiting.updateValue((stretch,), (requests,))
        yield pd.DataFrame(columns=["key", "micros", "request_id", "accepted"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Decide all that the watermark has passed; one timer does it for those that expire with it."""
        closed = timerValues.getCurrentWatermarkInMs()
        recorded = deque(self.recorded.get()[0]) if self.recorded.exists() else deque()
        before = list(recorded)
        decisions = []
        for stretch in sorted(each[0] for each in self.waiting.keys()):
            if (stretch + 1) * STRETCH_MS > closed:
                break
            for micros, request_id in sorted(tuple(each) for each in self.waiting.getValue((stretch,))[0]):
                while recorded and micros - recorded[0] >= self.width:
                    recorded.popleft()
                accepted = len(recorded) < self.limit
                if accepted:
                    recorded.append(micros)
                decisions.append((key[0], micros, request_id, accepted))
            self.waiting.removeKey((stretch,))
        while recorded and closed * 1000 - recorded[0] >= self.width:
            recorded.popleft()
        if list(recorded) != before:
            self._keep(list(recorded))
        yield pd.DataFrame(decisions, columns=["key", "micros", "request_id", "accepted"])

    def _keep(self, times: list[int]) -> None:
        """Remember accepted times until the last of them has left the window."""
        if not times:
            self.recorded.clear()
            return
        self.recorded.update((times,))
        self.handle.registerTimer((times[-1] + self.width) // 1000 + 1)

    def close(self) -> None:
        pass


def limiter_state(decided: DataFrame, as_of: Column, window_seconds: int = P.SCAN_WINDOW_SECONDS) -> DataFrame:
    """What decisions made so far (by the batch limiter or a stream) leave for requests from ``as_of`` on.

    (key, micros) of accepted requests that are younger than the window: at most ``limit`` rows per key.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    young = micros > F.unix_micros(as_of.cast("timestamp")) - window_seconds * 1_000_000
    return decided.filter(F.col("accepted") & F.col("key").isNotNull() & young).select("key", micros.alias("micros"))


def rate_limit_stream(
    requests: DataFrame,
    limit: int = P.SCAN_LIMIT,
    window_seconds: int = P.SCAN_WINDOW_SECONDS,
    lateness: str = "10 minutes",
    initial: DataFrame | None = None,
) -> DataFrame:
    """Decisions for a stream of ``key, ts, request_id`` (key a string, id a long).

    A request is decided once the watermark has passed the second it falls into; later ones are dropped by the
    watermark. Requests without a key are not limited and pass through. ``initial`` (``limiter_state``) takes over from
    earlier decisions. State per key is what lies between the watermark and now plus at most ``limit`` accepted times.
    The session needs the RocksDB state store, which ``build_session`` sets.
    """
    marked = requests.withWatermark("ts", lateness).withColumn("micros", F.unix_micros("ts"))
    decided = (
        marked.filter(F.col("key").isNotNull())
        .groupBy("key")
        .transformWithStateInPandas(
            Limiter(limit, window_seconds * 1_000_000), _DECIDED, "append", "eventTime",
            None if initial is None else initial.groupBy("key"),
        )
    )
    limited = decided.select("key", F.timestamp_micros("micros").alias("ts"), "request_id", "accepted")
    free = requests.filter(F.col("key").isNull()).select(
        "key", F.col("ts"), "request_id", F.lit(True).alias("accepted")
    )
    return limited.unionByName(free)
