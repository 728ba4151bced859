"""Assembling ranked clauses into context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import context_line

#: Fixed value: what stands between texts that are put together for one field.
RULE = "\n\n" + "-" * 40 + "\n\n"


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys, the first by order (which should be total). An aggregate, so a frequent key is no hot window."""
    others = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*others), F.struct(*order)).alias("_first")
    return rows.groupBy(*keys).agg(first).select(*keys, *[F.col("_first")[c].alias(c) for c in others]).select(*rows.columns)


def joined_texts(order: Column, text: Column, rule: str = RULE) -> Column:
    """Aggregate: texts in order with a rule between them; empty ones left out."""
    some = F.when(F.coalesce(text, F.lit("")) != "", F.struct(order.alias("o"), text.alias("t")))
    return F.array_join(F.transform(F.array_sort(F.collect_list(some)), lambda s: s["t"]), rule)


def context_block(order: Column, label: Column, category: Column, content: Column, query: Column | None = None) -> Column:
    """Aggregate: numbered context lines in order."""
    each = F.struct(order.alias("o"), label.alias("l"), category.alias("c"), content.alias("x"), (query if query is not None else F.lit("")).alias("q"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda s, i: context_line(i + 1, s["l"], s["c"], s["x"], s["q"])), "")
