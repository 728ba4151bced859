"""Batches of deals: validating sheet rows, joining what came back for them, rolling up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import day, second
from .updates import free

NO_NAME, NO_CIK = "missing target name", "missing or unknown CIK"


def missing(value: Column) -> Column:
    """Null, blank, or the text nan that blank cells may have become."""
    plain = F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return plain.isin("", "nan")


def reason(name: Column, cik: Column) -> Column:
    """Why a row can't be processed: the first rule that it fails; null if it can."""
    return F.when(missing(name), NO_NAME).when(missing(cik) | (F.trim(cik) == "Not Found"), NO_CIK)


def has_either(one: Column, other: Column) -> Column:
    """Whether at least one of two inputs is there."""
    return F.coalesce(one, other).isNotNull()


def finite(value: Column) -> Column:
    """NaN and the infinities become null."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def usable(response: Column) -> Column:
    """Of a response's items (file_url, deal_id), those with both and an http address."""
    return F.filter(response, lambda r: F.coalesce(r["file_url"].startswith("http") & (r["deal_id"] != ""), F.lit(False)))


def roll_up(rows: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """rows with status (any result succeeded), n_results and processed_files in order of deal_id.

    results: key, deal_id, file_url, status, message. Rows without results are kept, with status false.
    """
    some, n = free("some", rows), free("n", rows)
    file = F.struct("deal_id", "file_url", "status", "message")
    by_row = results.groupBy(key).agg(F.bool_or(F.col("status") == "success").alias(some), F.count(F.lit(1)).alias(n), F.array_sort(F.collect_list(file)).alias("processed_files"))
    met = rows.join(by_row, key, "left")
    return met.withColumn("status", F.coalesce(some, F.lit(False))).withColumn("n_results", F.coalesce(n, F.lit(0)).cast("long")).drop(some, n)


def listed(jobs: DataFrame, created: str = "created_at", key: str = "deal_id") -> DataFrame:
    """Newest first, dates as text."""
    ordered = jobs.orderBy(F.col(created).desc(), key)
    return ordered.withColumn("created_day", day(F.col(created))).withColumn("created_second", second(F.col(created)))
