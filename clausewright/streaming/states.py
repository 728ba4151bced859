"""The states of jobs as a stateful stream: what may follow what, and what is refused.

A job begins PENDING, is then PROCESSING, and ends COMPLETED or FAILED. Each key's state is kept by Spark; a
step that doesn't follow is refused and told why, and a job that stays PROCESSING for too long fails by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..schemas import STATUSES

#: What may follow a state; None stands for no state yet.
NEXT = {None: ("PENDING",), "PENDING": ("PROCESSING",), "PROCESSING": ("COMPLETED", "FAILED"), "COMPLETED": (), "FAILED": ()}
#: Steps as they come out: key, status, at, accepted, reason (why it is refused, or that the timer set it; else null), place
#: (the number of the key's step, from 1).
STEP = "status string, at timestamp, accepted boolean, reason string, place long"
UNKNOWN, OLD, ORDER, HUNG = "unknown status", "older than the state", "doesn't follow the state", "took too long"


def judged(state: tuple[str | None, Any], status: str | None, at: Any) -> str | None:
    """Why a step is refused after a state (status, time); null if it may follow."""
    if status not in STATUSES:
        return UNKNOWN
    if state[1] is not None and at < state[1]:
        return OLD
    return None if status in NEXT[state[0]] else ORDER


class Jobs(StatefulProcessor):
    """Steps of one key at a time; state: the last accepted status, its time, and how many steps there were."""

    def __init__(self, key: str, kind: str, seconds: float | None):
        self.key, self.kind, self.seconds = key, kind, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, at timestamp, n long")

    def _held(self) -> tuple[str | None, Any, int]:
        found = self.state.get() if self.state.exists() else None
        return (found[0], found[1], found[2]) if found else (None, None, 0)

    def _out(self, key: Any, steps: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(steps, columns=["status", "at", "accepted", "reason", "place"])
        out.insert(0, self.key, key[0])
        return out

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        """Of one batch, steps in the order of their time; those of one time as they are passed, unknown ones first."""
        status, since, n = self._held()
        every = pd.concat(list(rows))
        every["passed"] = [STATUSES.index(s) if s in STATUSES else -1 for s in every["status"]]
        steps = []
        for s, at in every.sort_values(["at", "passed"], kind="stable")[["status", "at"]].itertuples(index=False):
            why, n = judged((status, since), s, at), n + 1
            if why is None:
                status, since = s, at
            steps.append((s, at, why is None, why, n))
        self.state.update((status, None if since is None else pd.Timestamp(since).to_pydatetime(), n))
        if self.seconds is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if status == "PROCESSING":
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.seconds))
        yield self._out(key, steps)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        status, since, n = self._held()
        if status != "PROCESSING":
            return
        self.state.update(("FAILED", since, n + 1))
        yield self._out(key, [("FAILED", since, True, HUNG, n + 1)])

    def close(self) -> None:
        pass


def steps(log: DataFrame, key: str, status: str = "status", at: str = "at", seconds: float | None = None) -> DataFrame:
    """Every step of a stream of statuses, accepted or refused: key and STEP. seconds: how long a job may be PROCESSING, by the clock.

    Rows without a key or a time belong to no job and are left out. Needs the state store that `large_state` sets.
    """
    own = log.select(F.col(key).alias(key), F.col(status).alias("status"), F.col(at).cast("timestamp").alias("at")).where(F.col(key).isNotNull() & F.col("at").isNotNull())
    kind = own.schema[key].dataType.simpleString()
    mode = "none" if seconds is None else "processingTime"
    return own.groupBy(key).transformWithStateInPandas(Jobs(key, kind, seconds), f"`{key}` {kind}, {STEP}", "append", mode)


@contextmanager
def large_state(spark: SparkSession) -> Iterator[None]:
    """While a query is started: its states are kept by RocksDB, as keyed processors need. Afterwards the session is as before."""
    name = "spark.sql.streaming.stateStore.providerClass"
    had = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if had is None else spark.conf.set(name, had)


def steps_to(log: DataFrame, path: str, checkpoint: str, key: str, status: str = "status", at: str = "at", seconds: float | None = None) -> StreamingQuery:
    """Judges what has arrived and stops; with seconds it goes on, as timers need, until it is stopped.

    Steps are appended below path, a folder a batch, which a repeated batch writes over.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = steps(log, key, status, at, seconds).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    with large_state(log.sparkSession):
        return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime="1 second")).start()


def accepted(found: DataFrame) -> DataFrame:
    return found.where("accepted")


def rejects(found: DataFrame) -> DataFrame:
    return found.where("not accepted")


def jobs(found: DataFrame, key: str) -> DataFrame:
    """By key: the last accepted status and its time (null if there is none), and how many steps were accepted and refused."""
    last = F.max_by(F.struct("status", "at"), F.when(F.col("accepted"), F.col("place")))
    return found.groupBy(key).agg(last.alias("last"), F.count_if("accepted").alias("n_accepted"), F.count_if(~F.col("accepted")).alias("n_refused")).select(
        key, F.when(F.col("n_accepted") > 0, F.col("last.status")).alias("status"), F.when(F.col("n_accepted") > 0, F.col("last.at")).alias("at"), "n_accepted", "n_refused"
    )
