"""Open metadata as columns: every key there is, with the type that most of its values have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .updates import free

#: Keys that become columns, at most: beyond that they aren't a record's fields.
KEYS = 1000
#: Types of columns by the kind of a value; numbers of several kinds are doubles, all else is text.
TYPES = {"BIGINT": "bigint", "BOOLEAN": "boolean", "DOUBLE": "double", "STRING": "string"}


def _kind(value: Column) -> Column:
    """The kind of a variant's value: BIGINT, BOOLEAN, STRING, DOUBLE (decimals too), ARRAY, OBJECT, or VOID for null."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.when(name.isin("DECIMAL", "FLOAT"), "DOUBLE").otherwise(name)


def _entries(value: Column) -> Column:
    """An object's values by key."""
    return F.from_json(F.to_json(value), "map<string,variant>")


def found(rows: DataFrame, column: str) -> DataFrame:
    """key, kind, n of all keys of JSON objects in a column; a row a key and kind, combined where the rows are."""
    objects = rows.select(F.try_parse_json(column).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    each = objects.select(F.explode(_entries(F.col("v"))).alias("key", "value"))
    return each.groupBy("key", _kind(F.col("value")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def columns_of(rows: DataFrame, column: str, most: int = KEYS) -> dict[str, str]:
    """Keys in order, with the type of their columns. Nulls say nothing; whole numbers beside others are doubles; of several kinds the most frequent counts, ties by name."""
    told = found(rows, column).where("kind <> 'VOID'")
    wide = told.groupBy("key").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    got = wide.orderBy("key").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"{column} has more than {most} keys")
    number = {"BIGINT", "DOUBLE"}
    return {r.key: "double" if r.kind in number and number <= set(r.kinds) else TYPES.get(r.kind, "string") for r in got}


def spread(rows: DataFrame, column: str, prefix: str = "", types: dict[str, str] | None = None, rest: str = "rest") -> DataFrame:
    """rows with a column for each key of the JSON objects in `column`, and `rest`: as JSON by key, what doesn't fit its column's type.

    types: as columns_of() finds them, for rows that must agree with others. Lists and objects are JSON text. Texts that are no
    object have nulls, and are in rest under the empty key; a key that isn't in types is in rest, too.
    """
    types = columns_of(rows, column) if types is None else types
    v = free("v", rows)
    out = rows.withColumn(v, F.try_parse_json(column))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    held = F.when(is_object, _entries(F.col(v)))
    names: list[Column] = []
    for key, kind in types.items():
        value = F.try_element_at(held, F.lit(key))
        own = _kind(value)
        fits = {"bigint": own == "BIGINT", "double": own.isin("BIGINT", "DOUBLE"), "boolean": own == "BOOLEAN", "string": own.isin("STRING", "ARRAY", "OBJECT")}[kind]
        text = F.when(own == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))
        names.append(F.when(fits, text if kind == "string" else F.try_variant_get(value, "$", kind)).alias(f"{prefix}{key}"))
    known = F.array(*[F.lit(k) for k in types]).cast("array<string>")
    fit = {kind: F.array(*[F.lit(k) for k, t in types.items() if t == kind]).cast("array<string>") for kind in ("bigint", "double", "boolean", "string")}

    def misfit(key: Column, value: Column) -> Column:
        own = _kind(value)
        good = (F.array_contains(fit["bigint"], key) & (own == "BIGINT")) | (F.array_contains(fit["double"], key) & own.isin("BIGINT", "DOUBLE"))
        good = good | (F.array_contains(fit["boolean"], key) & (own == "BOOLEAN")) | (F.array_contains(fit["string"], key) & own.isin("STRING", "ARRAY", "OBJECT"))
        return ~(F.array_contains(known, key) & (good | (own == "VOID")))

    others = F.transform_values(F.map_filter(held, misfit), lambda _, x: F.to_json(x))
    whole = F.when(F.col(column).isNotNull() & ~is_object, F.create_map(F.lit(""), F.col(column)))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *names, F.coalesce(others, whole, F.create_map().cast("map<string,string>")).alias(rest)).drop(v)
