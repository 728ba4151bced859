"""Updates of tables without a transactional store: new rows are computed, then written beside the old."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import STATUSES


def free(name: str, *tables: DataFrame) -> str:
    """A name like `name` that no column of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def latest(rows: DataFrame, key: str, version: list[str | Column]) -> DataFrame:
    """For each key the row of the highest version (which should be total)."""
    others, last = [c for c in rows.columns if c != key], free("last", rows)
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*version)).alias(last)).select(key, *[F.col(last)[c].alias(c) for c in others]).select(*rows.columns)


def upsert(stored: DataFrame, new: DataFrame, key: str, version: list[str] | None = None) -> DataFrame:
    """The stored rows with new ones in place of those of the same key; of several new ones, the highest version."""
    fresh = latest(new, key, version) if version else new
    mark = free("new", stored, new)
    both = stored.withColumn(mark, F.lit(0)).unionByName(fresh.withColumn(mark, F.lit(1)))
    return latest(both, key, [mark]).drop(mark)


def _last_known(values: Column, version: list[Column]) -> Column:
    """Aggregate: the value of the highest version that isn't null."""
    return F.max_by(values, F.when(values.isNotNull(), F.struct(*version))) if version else F.max(values)


def merged_updates(updates: DataFrame, key: str, version: list[str] | None = None, extra: str | None = None) -> DataFrame:
    """One update a key: of each column its last value that isn't null, by version, and of a map column the last of each of its keys.

    Without a version, of several values the largest counts. Updates of one key are combined before they are shuffled; of a map, entries are.
    """
    order = [F.col(c) for c in version or []]
    plain = [c for c in updates.columns if c not in (key, extra, *(version or []))]
    # a version column that is itself an update takes its last value
    last = updates.groupBy(key).agg(*[_last_known(F.col(c), order).alias(c) for c in plain], *[F.max(c).alias(c) for c in version or [] if c in updates.columns], F.count(F.lit(1)).alias(free("n", updates)))
    last = last.drop(free("n", updates))
    if extra is None:
        return last
    k, v = free("k", updates), free("v", updates)
    entries = updates.select(key, *(version or []), F.explode(extra).alias(k, v)).groupBy(key, k).agg(_last_known(F.col(v), order).alias(v))
    maps = entries.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(k, v))).alias(extra))
    return last.join(maps, key, "left")


def patch(stored: DataFrame, updates: DataFrame, key: str, extra: str | None = None, version: list[str] | None = None) -> DataFrame:
    """Columns that an update has (not null) replace the stored ones, all others stay; a map column extra is merged key by key, and is empty rather than null.

    Of several updates of a key, each column's last value that isn't null counts, by version (a column of the updates; see merged_updates).
    """
    changed = [c for c in updates.columns if c != key and c in stored.columns]
    met = stored.alias("l").join(merged_updates(updates, key, version, extra if extra in changed else None).alias("r"), F.expr(f"l.`{key}` = r.`{key}`"), "left")

    def value(c: str) -> Column:
        own, new = F.col(f"l.`{c}`"), F.col(f"r.`{c}`")
        if c not in changed:
            return own
        if c == extra:
            # the update's entries, then stored ones whose key it hasn't: no setting decides which of two stays
            names = F.coalesce(F.map_keys(new), F.array().cast(f"array<{stored.schema[c].dataType.keyType.simpleString()}>"))
            kept = F.map_filter(own, lambda k, _: ~F.array_contains(names, k))
            empty = F.create_map().cast(stored.schema[c].dataType.simpleString())
            return F.coalesce(F.map_concat(kept, new), new, own, empty).alias(c)
        return F.coalesce(new, own).alias(c)

    return met.select(*[value(c) for c in stored.columns])


def deleted(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return stored.join(gone.select(key).distinct(), key, "left_anti")


def with_job(chunks: DataFrame, jobs: DataFrame, key: str = "deal_id") -> tuple[DataFrame, DataFrame]:
    """Chunks of deals that have a job, and those of deals that have none."""
    known = jobs.select(key).distinct()
    return chunks.join(known, key, "left_semi"), chunks.join(known, key, "left_anti")


def passed(status: Column) -> Column:
    """A status's place in the order in which a job passes them, from 1; 0 for any other."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STATUSES]), status), F.lit(0))


def current_status(log: DataFrame, key: str = "deal_id", at: str = "updated_at") -> DataFrame:
    """The last status of each job in an append-only log; of those of one time, the one that is passed last. Unknown statuses don't count."""
    return latest(log.where(passed(F.col("status")) > 0), key, [at, passed(F.col("status"))])


def checked_vectors(vectors: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """Fails on the first vector of another length."""
    wrong = F.size(column) != dimension
    return vectors.withColumn(column, F.when(wrong, F.raise_error(F.concat(F.lit("dimension "), F.size(column).cast("string")))).otherwise(F.col(column)))
