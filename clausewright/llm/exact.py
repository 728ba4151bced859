"""Exact dedup in two passes over a Bloom filter.

The first pass adds every text's hash to a filter whose cells count to two. In the second a text whose
cells haven't all been reached twice is surely alone and passes straight through; only the others, the
possibly repeated, are shuffled and grouped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Tables, free_name, partitions
from .words import U, mix

BLANKS = r"[\x20\x09-\x0D]+"
#: The filter has CELLS_PER_TEXT cells a text, at most MOST_CELLS. A task that counts holds a byte a cell (64 MB), what is
#: broadcast has a bit a cell (8 MB). Beyond that more texts are taken for possibly repeated and shuffled; no result changes.
CELLS_PER_TEXT, MOST_CELLS, HASHES, SHARD = 12, 1 << 26, 3, 1 << 16


def _places(keys: np.ndarray, cells: int) -> np.ndarray:
    return np.stack([(mix(keys.view(U) + U(k)) % U(cells)).astype(np.int64) for k in range(HASHES)])


def _counted(cells: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(cells, np.uint8)
        for batch in batches:
            # a key's equal places must not count twice
            places = np.sort(_places(batch.column("key").to_numpy(), cells), 0)
            new = np.ones(places.shape, bool)
            new[1:] = places[1:] != places[:-1]
            at, n = np.unique(places[new], return_counts=True)
            seen[at] = np.minimum(2, seen[at] + np.minimum(n, 2))
        for k in range(0, cells, SHARD):
            part = seen[k : k + SHARD]
            if part.any():
                once, twice = np.packbits(part > 0).tobytes(), np.packbits(part > 1).tobytes()
                yield pa.record_batch({"shard": pa.array([k // SHARD], pa.int32()), "once": pa.array([once], pa.binary()), "twice": pa.array([twice], pa.binary())})

    return count


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    have: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for shard, once, twice in zip(*(batch.column(k).to_pylist() for k in ("shard", "once", "twice")), strict=True):
            a, b = np.frombuffer(once, np.uint8), np.frombuffer(twice, np.uint8)
            if shard in have:
                c, d = have[shard]
                a, b = a | c, b | d | (a & c)
            have[shard] = a, b
    if have:
        yield pa.record_batch({"shard": pa.array(list(have), pa.int32()), "twice": pa.array([b.tobytes() for _, b in have.values()], pa.binary())})


def possibly_repeated(keys: DataFrame, key: str = "key") -> Callable[[Column], Column]:
    """A function of a key column: false only where the key (long) is in keys, a table that is cheap to read twice, just once.

    What reaches the driver and is broadcast is one bit a cell: CELLS_PER_TEXT bits a row, 8 MB at most.
    """
    spark = keys.sparkSession
    cells = min(MOST_CELLS, max(SHARD, -(-keys.count() * CELLS_PER_TEXT // SHARD) * SHARD))
    slim = keys.select(F.col(key).alias("key"))
    shards = slim.mapInArrow(_counted(cells), "shard int, once binary, twice binary").repartition(min(partitions(spark), cells // SHARD), "shard").mapInArrow(_merged, "shard int, twice binary")
    twice = np.zeros(cells // 8, np.uint8)
    for row in shards.toLocalIterator():
        part = np.frombuffer(row.twice, np.uint8)
        twice[row.shard * SHARD // 8 : row.shard * SHARD // 8 + len(part)] = part
    sent = spark.sparkContext.broadcast(twice)

    @F.pandas_udf("boolean")
    def reached(key: pd.Series) -> pd.Series:
        places = _places(key.to_numpy(np.int64), cells)
        return pd.Series(((sent.value[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).all(0))

    return reached


def digest(text: Column) -> Column:
    """Of the text with each run of blanks as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " "), 256)


def key_of(sha256: Column) -> Column:
    """A digest's first 60 bits."""
    return F.conv(F.substring(sha256, 1, 15), 16, 10).cast("long")


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), digest(docs[text_col]).alias("text_sha256")).withColumn("key", key_of(F.col("text_sha256")))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. Rows that share the smallest id of their group are all kept; a null id
    is larger than any other. An empty table gives no rows.
    """
    tables = Tables(docs.sparkSession)
    rows = tables.cut(hashed(docs, id_col, text_col))
    flagged = tables.cut(rows.withColumn("maybe", possibly_repeated(rows)(F.col("key"))))
    tables.drop(rows)
    alone = flagged.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    some = flagged.where("maybe").select("doc_id", "text_sha256")
    # written, so that either side of the join below has an exchange of its own and Spark can split a large group
    groups = tables.cut(some.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    met = some.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return alone.unionByName(met)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of rows of docs whose texts are equal up to blanks, the one with the smallest id, with all its columns.

    Texts that are surely alone pass straight through, only the others are shuffled. A null text counts as
    empty, a null id is larger than any other; of several rows with one text and its smallest id, one stays
    (any). An id may stay for one of its texts and go for another. An empty table gives no rows.
    """
    tables = Tables(docs.sparkSession)
    rows = tables.cut(hashed(docs, id_col, text_col))
    maybe = possibly_repeated(rows)
    by_id = rows.where(maybe(F.col("key"))).groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    kept = by_id.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.coalesce(F.min_by("n", "doc_id"), F.max("n")).alias("n"))
    kept = tables.cut(kept)
    tables.drop(rows)
    sha, its_sha, its_id = (free_name(docs, c) for c in ("sha", "kept_sha", "kept_id"))
    marked = docs.withColumn(sha, digest(docs[text_col]))
    possible = maybe(key_of(F.col(sha)))

    def those(which: DataFrame) -> DataFrame:
        named = which.select(F.col("text_sha256").alias(its_sha), F.col("keep_id").alias(its_id))
        return marked.where(possible).join(named, (F.col(sha) == F.col(its_sha)) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(its_id)), "left_semi")

    out = marked.where(~possible).unionByName(those(kept.where("n = 1")))
    if kept.where("n > 1").head(1):
        out = out.unionByName(those(kept.where("n > 1")).dropDuplicates([sha]))
    return out.drop(sha)


COPIES_SQL = r"""
with hashed as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from {documents})
select doc_id, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256)::bigint as group_size,
  coalesce(doc_id = min(doc_id) over (partition by text_sha256), min(doc_id) over (partition by text_sha256) is null) as kept, text_sha256
from hashed
"""
