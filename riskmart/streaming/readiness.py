"""Which months have all their sources: arrivals as a keyed stream with state and timers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.sources.schemas import SNAPSHOT

#: The four sources of the mart.
SOURCES = ("lms_loan_daily", "feature_clickstream", "features_financials", "features_attributes")

READY_SCHEMA = f"{SNAPSHOT} date, status string, arrived int, missing string, at timestamp"


def months_ready(
    arrivals: DataFrame, timeout_days: int, sources: Sequence[str] = SOURCES, lateness: str = "0 seconds"
) -> DataFrame:
    """(snapshot_date, status, arrived, missing, at) as months become complete or run out of time.

    `arrivals` is a stream of (source, snapshot_date, arrived_at timestamp). A month is `ready`
    when its last source arrives, at that time. If that is more than `timeout_days` after
    its first arrival, it is `incomplete` at that limit with the sources that are missing, and
    `late` when the last one arrives after all. The limit is passed by the stream's event time
    (a timer per month) or by a later arrival of the month, whichever the stream sees first; the rows are the
    same. Repeated arrivals count once, unknown sources and NULLs not at all. State is a month's first
    arrivals, at most one per source.

    The state store must be the RocksDB one (see `use_state_store`).
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    expected = tuple(sources)
    limit = timeout_days * 86_400_000

    class Readiness(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.seen = handle.getMapState("seen", "source string", "at long")
            self.told = handle.getValueState("told", "limit boolean, whole boolean")

        def _frame(self, key, told: list[tuple]):
            import pandas as pd

            columns = ["snapshot_date", "status", "arrived", "missing", "at"]
            made = pd.DataFrame([(key[0], *row) for row in told], columns=columns)
            made["at"] = pd.to_datetime(made["at"], unit="ms", utc=True)
            return made

        def _incomplete(self, times: dict, end: int) -> tuple:
            in_time = [s for s, at in times.items() if at <= end]
            return ("incomplete", len(in_time), ",".join(s for s in expected if s not in in_time), end)

        def handleInputRows(self, key, rows, timerValues) -> Iterator:
            times = {k[0]: v[0] for k, v in self.seen.iterator()}
            before = dict(times)
            for frame in rows:
                for source, at in zip(frame["source"], frame["at"], strict=True):
                    if source in expected:
                        times[source] = min(int(at), times.get(source, int(at)))
            over, whole = self.told.get() if self.told.exists() else (False, False)
            if not times or whole:
                return
            for source, at in times.items():
                if before.get(source) != at:
                    self.seen.updateValue((source,), (at,))
            first, last = min(times.values()), max(times.values())
            end = first + limit
            told = []
            whole = len(times) == len(expected)
            if not over and last > end:
                told.append(self._incomplete(times, end))
                over = True
            if whole:
                told.append(("late" if last > end else "ready", len(times), "", last))
            elif not over:
                self.handle.registerTimer(end)
            self.told.update((over, whole))
            if told:
                yield self._frame(key, told)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
            over, whole = self.told.get() if self.told.exists() else (False, False)
            times = {k[0]: v[0] for k, v in self.seen.iterator()}
            end = min(times.values(), default=0) + limit
            if times and not over and not whole and end <= expiredTimerInfo.getExpiryTimeInMs():
                self.told.update((True, False))
                yield self._frame(key, [self._incomplete(times, end)])

        def close(self) -> None:
            pass

    timed = arrivals.where(f"source is not null and {SNAPSHOT} is not null and arrived_at is not null")
    keyed = timed.withWatermark("arrived_at", lateness).select("source", SNAPSHOT, "arrived_at", F.unix_millis("arrived_at").alias("at"))
    return keyed.groupBy(SNAPSHOT).transformWithStateInPandas(Readiness(), READY_SCHEMA, "Append", "EventTime")


def use_state_store(spark) -> None:
    """The state store that timers need."""
    store = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
