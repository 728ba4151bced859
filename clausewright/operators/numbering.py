"""Row numbers within large groups without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .updates import free


def _range(rows: DataFrame, order: str) -> Column:
    """Of a row, which of as many ranges of order as Spark shuffles into it is in."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.select(F.percentile_approx(order, [k / n for k in range(1, n)], 10 * n)).head()[0] if n > 1 else None
    known = F.array(*[F.lit(b) for b in sorted(set(bounds or []))]).cast("array<double>")
    return F.size(F.filter(known, lambda b: b < F.col(order)))


def number_within(rows: DataFrame, key: str, order: str, name: str = "chunk_index") -> DataFrame:
    """Adds 0, 1, ... within each key by order (numeric, unique within a key).

    Rows are dealt into ranges of order; a range's rows of one key are numbered by a window, and what the
    ranges before it hold is added, so the largest window is one key's share of a range.
    """
    part = free("range", rows)
    return _numbered(rows.withColumn(part, _range(rows, order)), key, order, part, name).drop(part)


def _numbered(ranged: DataFrame, key: str, order: str, part: str, name: str) -> DataFrame:
    n_, before_, own_ = (free(c, ranged) for c in ("n", "before", "own"))
    counts = ranged.groupBy(key, part).agg(F.count(F.lit(1)).alias(n_))
    before = counts.withColumn(before_, F.coalesce(F.sum(n_).over(Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = ranged.withColumn(own_, F.row_number().over(Window.partitionBy(key, part).orderBy(order)))
    met = own.alias("l").join(before.alias("r"), F.expr(f"l.`{key}` <=> r.`{key}` and l.`{part}` = r.`{part}`"))
    return met.select(*[F.col(f"l.`{c}`").alias(c) for c in ranged.columns], (F.col(f"r.`{before_}`") + F.col(f"l.`{own_}`") - 1).cast("long").alias(name))


def block_within(rows: DataFrame, key: str, order: str, size: int, at: str, name: str = "first") -> DataFrame:
    """Adds the number, within each key by order (numeric, no nulls), that the first row of a row's block has; a block has `size` rows.

    Rows of one key and order are in one block, which is larger by as many. Only keys and orders are shuffled to find where blocks begin. That,
    a row for each key's share of a range, is written to the new folder `at`: Spark sees how small it is, and sends it to the rows instead of shuffling them.
    """
    part, number, starts, last, before = (free(c, rows) for c in ("range", "number", "starts", "last", "before"))
    range_ = _range(rows, order)
    numbered = _numbered(rows.select(key, order, range_.alias(part)), key, order, part, number)
    # all rows of one order have the number of the first of them
    by_order = numbered.groupBy(key, part, order).agg(F.min(number).alias(number), F.max(number).alias(last))
    begins = F.floor(F.col(last) / size) * size >= F.col(number)  # one of them has a number that `size` divides
    found = by_order.groupBy(key, part).agg(F.array_sort(F.collect_list(F.when(begins, F.struct(F.col(order).alias("o"), F.col(number).alias("n"))))).alias(starts))
    earlier = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    found.withColumn(before, F.max(F.try_element_at(starts, F.lit(-1))["n"]).over(earlier)).write.parquet(at)
    met = rows.withColumn(part, range_).alias("l").join(rows.sparkSession.read.parquet(at).alias("r"), F.expr(f"l.`{key}` <=> r.`{key}` and l.`{part}` = r.`{part}`"))
    own_start = F.try_element_at(F.filter(F.col(f"r.`{starts}`"), lambda s: s["o"] <= F.col(f"l.`{order}`")), F.lit(-1))["n"]
    return met.select(*[F.col(f"l.`{c}`").alias(c) for c in rows.columns], F.coalesce(own_start, F.col(f"r.`{before}`")).alias(name))
