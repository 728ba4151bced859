"""Contract files, sheets and clause tables, by any path that Spark's readers open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of contract files; Spark's readers unpack those that are packed.
JSON = "*{.json,.json.gz}"


def contracts(spark: SparkSession, path: str | list[str], deal_id: Column | None = None) -> DataFrame:
    """deal_id, path, raw: one row a JSON file (plain, or with .gz), whole. Without deal_id the file's name is it."""
    files = spark.read.option("pathGlobFilter", JSON).option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    name = F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), r"\.json(\.gz)?$", "")
    return files.select((deal_id if deal_id is not None else name).alias("deal_id"), "path", "raw")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modified of all JSON files, however many there are; their content isn't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", JSON).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """target_name, cik, extra of a CSV with a header; every cell is text, so a CIK keeps its zeros."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    others = [c for c in rows.columns if c not in ("Target Name", "CIK Number")]
    extra = F.create_map(*[x for c in others for x in (F.lit(c), F.col(f"`{c}`"))]).cast("map<string,string>")
    named = lambda c: F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string")
    return rows.select(named("Target Name").alias("target_name"), named("CIK Number").alias("cik"), extra.alias("extra"))


def write_clauses(clauses: DataFrame, path: str, kind: str = "parquet") -> None:
    """One folder a deal, written over; Parquet, or JSON to hand out."""
    clauses.write.mode("overwrite").partitionBy("deal_id").format(kind).save(path)


def append(rows: DataFrame, path: str, batch: int | None = None) -> None:
    """Adds rows to a log. With a batch's number they have a folder of their own, which the batch writes over if it comes again: it is then there once."""
    if batch is None:
        rows.write.mode("append").parquet(path)
    else:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
