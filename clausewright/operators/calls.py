"""Calls of a remote model: each distinct request once, ever, in batches, with retries, and failures as rows.

Requests are known by a digest. Those that a table of earlier replies has are not sent again; of the others each distinct
one is sent once, by tasks that keep a bounded number of batches under way. What fails is told in a row of
its own and sent again by the next run.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.stored import KeyedTable
from .updates import free

#: Requests in, replies out, in the same order; an exception fails them all.
Call = Callable[[list[str]], list[str]]
REPLY = "digest string, request string, reply string, error string, tries int"


def digest(request: str = "request") -> Column:
    return F.sha2(F.col(request), 256)


def _tried(call: Call, some: list[str], tries: int, wait: float) -> list[tuple[str | None, str | None, int]]:
    """Reply, error and number of tries of each request. A batch that fails every time is tried one by one, so that one request spoils no others."""
    why = ""
    for n in range(1, tries + 1):
        try:
            got = call(some)
            if len(got) != len(some):
                raise ValueError(f"{len(got)} replies to {len(some)} requests")
            return [(r, None, n) for r in got]
        except Exception as e:  # noqa: BLE001  whatever a client raises is told in the row
            why = f"{type(e).__name__}: {e}"
            time.sleep(wait * 2 ** (n - 1) if n < tries else 0)
    if len(some) == 1:
        return [(None, why, tries)]
    return [(r, e, tries + n) for x in some for r, e, n in _tried(call, [x], 1, 0)]


def _sent(call: Call, batch: int, workers: int, tries: int, wait: float):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(workers) as pool:
            for rows in batches:
                digests, requests = (rows.column(c).to_pylist() for c in ("digest", "request"))
                parts = [requests[k : k + batch] for k in range(0, len(requests), batch)]
                got = [x for part in pool.map(lambda some: _tried(call, some, tries, wait), parts) for x in part]
                yield pa.record_batch(
                    {
                        "digest": pa.array(digests, pa.string()), "request": pa.array(requests, pa.string()), "reply": pa.array([r for r, _, _ in got], pa.string()),
                        "error": pa.array([e for _, e, _ in got], pa.string()), "tries": pa.array([n for _, _, n in got], pa.int32()),
                    }
                )

    return apply


def reply_table(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    return KeyedTable(spark, path, "digest", StructType.fromDDL(REPLY), buckets)


def unanswered(requests: DataFrame, replies: KeyedTable, request: str = "request") -> DataFrame:
    """digest and request of the distinct requests that have no reply yet; null ones ask nothing."""
    known = replies.rows().where(F.col("error").isNull()).select("digest")
    own = requests.where(F.col(request).isNotNull()).select(digest(request).alias("digest"), F.col(request).alias("request"))
    return own.groupBy("digest").agg(F.first("request").alias("request")).join(known, "digest", "left_anti")


def answer(requests: DataFrame, call: Call, path: str, request: str = "request", batch: int = 16, workers: int = 4, tries: int = 2, wait: float = 0.2, buckets: int = 64, tasks: int | None = None) -> DataFrame:
    """The rows of requests with reply and error (null where there is the other). path: the table of replies, made if it isn't there.

    call: what sends a batch; it runs in tasks, so it is a function that can be pickled. At most `workers` batches of
    `batch` requests are under way in a task, and `tasks` tasks share them (as many as Spark shuffles into, by default). What is
    replied is stored before it is returned, so a job that dies calls again only for what it had not stored.
    """
    replies = reply_table(requests.sparkSession, path, buckets)
    open_ = unanswered(requests, replies, request)
    dealt = open_.repartition(tasks, "digest") if tasks else open_.repartition("digest")
    replies.upsert(dealt.mapInArrow(_sent(call, batch, workers, tries, wait), REPLY))
    key = free("digest", requests)
    told = replies.rows().select(F.col("digest").alias(key), "reply", "error")
    return requests.withColumn(key, digest(request)).join(told, key, "left").drop(key)
