"""Contract files to a vector table as they arrive, each once.

A batch of files is flattened, classified, embedded and trimmed, and upserted by clause; then the ledger says
that its number is done. A batch that is repeated, as a stream does that was killed, finds its number in the
ledger, or else upserts the same rows again, which changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.backends import Classifier, Embedding
from ..operators.trim import LIMIT
from ..plans.retrieval import vectors_of
from ..schemas import VECTOR
from ..session import filesystem
from ..sources.files import JSON
from ..sources.stored import KeyedTable

LEDGER = "number long, files long, rows long"


def vector_table(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    return KeyedTable(spark, path, "chunk_id", spark.createDataFrame([], VECTOR).schema, buckets, "zstd")  # a clause's text is there twice


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Batches that are done: number, files, rows."""
    fs, at = filesystem(spark, f"{path}/_ledger")
    return spark.read.schema(LEDGER).parquet(f"{path}/_ledger") if fs.exists(at) else spark.createDataFrame([], LEDGER)


def ingest_batch(files: DataFrame, number: int, path: str, classifier: Classifier, embedding: Embedding, limit: int = LIMIT, buckets: int = 64) -> bool:
    """files: deal_id, path, raw. Upserts the files' clauses unless the ledger has the number; whether it did.

    A file that comes again replaces its clauses; one with fewer than before leaves those it no longer has (see forget).
    """
    spark = files.sparkSession
    if ledger(spark, path).where(F.col("number") == number).head(1):
        return False
    table = vector_table(spark, path, buckets)
    at = table.stage()
    try:
        n = table.receive(vectors_of(files, classifier, embedding, limit), at).count()
        table.take(at)
        done = files.agg(F.count(F.lit(1)).alias("files"))
        done.select(F.lit(number).cast("long").alias("number"), "files", F.lit(n).cast("long").alias("rows")).coalesce(1).write.mode("overwrite").parquet(f"{path}/_ledger/batch={number}")
    finally:
        table.leave_stage(at)
    return True


def forget(spark: SparkSession, path: str, deals: DataFrame) -> int:
    """Drops all clauses of the deals (deal_id); how many buckets were rewritten."""
    table = vector_table(spark, path)
    return table.delete(table.rows().select("chunk_id", "deal_id").join(deals.select("deal_id").distinct(), "deal_id", "left_semi"))


def contract_stream(spark: SparkSession, path: str, deal_id: Column | None = None, files: int = 1000, first_chunk: Column | None = None) -> DataFrame:
    """deal_id, path, raw of JSON files (plain, or with .gz) as they arrive, at most `files` a batch. Without deal_id (an expression of path) the file's name is it.

    first_chunk, too, is an expression of path: where a deal comes in several files, the number of a file's first clause.
    A batch adds files to the buckets of its clauses, as a rule all, or rewrites those where it changes clauses, so many files want large batches.
    """
    raw = spark.readStream.format("text").schema("value string").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", JSON).option("maxFilesPerTrigger", files).load(path)
    named = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    name = F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), r"\.json(\.gz)?$", "")
    return named.select((name if deal_id is None else deal_id).alias("deal_id"), "path", "raw", *([] if first_chunk is None else [first_chunk.alias("first_chunk")]))


def ingest(files: DataFrame, path: str, checkpoint: str, classifier: Classifier, embedding: Embedding, limit: int = LIMIT, buckets: int = 64) -> StreamingQuery:
    """Takes in what has arrived, batch by batch, and stops."""

    def take(batch: DataFrame, number: int) -> None:
        ingest_batch(batch, number, path, classifier, embedding, limit, buckets)

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
