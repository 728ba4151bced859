"""Structured Streaming forms of what the engine does in batches; each gives what its batch form gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.flatten import flatten


def table_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table as a stream; it may be one file, which a stream takes by a pattern alone."""
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def contract_stream(spark: SparkSession, path: str) -> DataFrame:
    """deal_id, path, raw of JSON files as they arrive."""
    files = spark.readStream.format("text").schema("value string").option("wholetext", "true").option("pathGlobFilter", "*.json").load(path)
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    return named.select(F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), r"\.json$", "").alias("deal_id"), "path", "raw")


def clauses_to(files: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Flattens what has arrived and stops; a batch that is repeated writes over its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        flatten(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_windows(log: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 day", late: str | None = None) -> DataFrame:
    """start, kind, n, total by tumbling window, for a batch or a stream; late: how long a stream waits."""
    timed = log.withColumn(at, F.col(at).cast("timestamp"))  # a watermark needs a time with zone
    timed = timed.withWatermark(at, late) if late else timed
    return timed.groupBy(F.window(at, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def last_states(log: DataFrame, key: str, state: str, at: str) -> DataFrame:
    """The last state of every key, of those of one time the greatest; as a stream, write it in complete or update mode."""
    return log.groupBy(key).agg(F.max(F.struct(at, state)).alias("last")).select(key, f"last.{state}", f"last.{at}")
