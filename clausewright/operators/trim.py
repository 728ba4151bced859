"""Keeping a record's metadata within a number of bytes, of its texts or of the record as it is sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .updates import free

#: Bytes of UTF-8 that a record's metadata may have.
LIMIT = 40_960


def cut_to_bytes(text: Column, room: Column) -> Column:
    """The longest beginning of at most room bytes that splits no character."""
    raw = F.encode(text, "UTF-8")
    inside = lambda at: F.substr(F.hex(F.substr(raw, at + 1, F.lit(1))), F.lit(1), F.lit(1)).isin("8", "9", "A", "B")  # noqa: E731  byte at + 1 continues a character
    end = F.when(~inside(room), room).when(~inside(room - 1), room - 1).when(~inside(room - 2), room - 2).otherwise(room - 3)
    return F.when(F.octet_length(text) <= room, text).otherwise(F.decode(F.substr(raw, F.lit(1), F.greatest(end, F.lit(0))), "UTF-8"))


def trim(rows: DataFrame, limit: int = LIMIT, long_columns: tuple[str, ...] = ("combined_text", "original_text"), fixed: tuple[str, ...] = ()) -> DataFrame:
    """Every row's fixed columns whole, then its long columns in the given order as far as there is room. Null counts as empty."""
    size = lambda c: F.octet_length(F.coalesce(F.col(c).cast("string"), F.lit("")))
    room = F.lit(limit)
    for c in fixed:
        room = room - size(c)
    left = free("room", rows)
    rows = rows.withColumn(left, F.greatest(room, F.lit(0)).cast("int"))
    for c in long_columns:
        rows = rows.withColumn(c, cut_to_bytes(F.coalesce(F.col(c), F.lit("")), F.col(left))).withColumn(left, F.col(left) - F.octet_length(c))
    return rows.drop(left)


#: What a record holds, in the order in which there is room for it, but for what is always whole.
ORDER = ("categories", "clause_summary", "combined_text", "deal_name", "label", "original_text")


def encoded(columns: list[str]) -> Column:
    """How many bytes a row takes as the JSON of these columns (nulls aren't written)."""
    return F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])))


def _width(value: Column, kind: str) -> Column:
    """Bytes of a value in JSON, escapes included: of a text without its quotes, of a list with its brackets."""
    return F.octet_length(F.to_json(value)) if kind.startswith("array") else F.octet_length(F.to_json(F.struct(value.alias("x")))) - len('{"x":""}')


def _longest(value: Column, kind: str, room: Column, limit: int) -> Column:
    """The longest beginning (of characters, of elements) that takes at most room bytes, by halving what is open."""
    begin = lambda n: F.slice(value, F.lit(1), n) if kind.startswith("array") else F.substr(value, F.lit(1), n)
    steps = F.array(*[F.lit(1 << k) for k in range(limit.bit_length(), -1, -1)])  # a character takes a byte at least
    n = F.aggregate(steps, F.lit(0), lambda have, step: F.when(_width(begin(have + step), kind) <= room, have + step).otherwise(have))
    return F.when(_width(value, kind) <= room, value).otherwise(begin(n))


def within(rows: DataFrame, limit: int = LIMIT, order: tuple[str, ...] = ORDER, apart: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose JSON, with the names and values of all columns but those apart, takes at most `limit` bytes.

    Columns that order doesn't name (ids, numbers) are whole; a row that they alone make too long fails. Those it
    names follow as far as there is room: a text or a list is cut to the longest beginning that fits, or null
    if not even an empty one does; anything else that doesn't fit is null. Rows that fit stay as they are.
    """
    record = [c for c in rows.columns if c not in apart]
    order = tuple(c for c in order if c in record)
    whole = [c for c in record if c not in order]
    size, fits = free("size", rows), free("fits", rows)
    begun = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in whole]))) if whole else F.lit(2)
    out = rows.withColumn(fits, encoded(record) <= limit).withColumn(size, F.when(begun <= limit, begun).otherwise(F.raise_error(F.lit(f"a record's ids take more than {limit} bytes")).cast("int")))
    for c in order:
        kind = rows.schema[c].dataType.simpleString()
        text = kind == "string"
        # a comma if anything stands before it, the name, a colon, and a text's quotes
        around = F.when(F.col(size) > 2, 1).otherwise(0) + F.octet_length(F.to_json(F.struct(F.lit("").alias(c)))) - 2 - (0 if text else 2)
        room = F.lit(limit) - F.col(size) - around
        if text or kind.startswith("array"):
            cut = F.when(room >= (0 if text else 2), _longest(F.col(c), kind, room, limit))
        else:
            cut = F.when(F.octet_length(F.to_json(F.struct(F.col(c).alias("x")))) - 6 <= room, F.col(c))
        out = out.withColumn(c, F.when(F.col(fits), F.col(c)).otherwise(cut))
        taken = F.octet_length(F.to_json(F.struct(F.col(c))))  # of the column alone, braces included: 2 if it is null
        out = out.withColumn(size, F.col(size) + F.when(F.col(c).isNull(), 0).otherwise(taken - 2 + F.when(F.col(size) > 2, 1).otherwise(0)))
    return out.drop(size, fits)
