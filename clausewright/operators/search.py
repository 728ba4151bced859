"""Exact nearest neighbours by cosine, for many queries at once.

Vectors and queries are packed into blocks, a row each; every query block meets every vector block (or those
of its own filter value) in one matrix product, which keeps the best k; the last window sees k rows a block
and query. Nothing is broadcast unless Spark finds it small enough. A filter value with many vectors has many
blocks, which are dealt over tasks; the value itself travels with a block and is what is joined on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a packed block of queries and of vectors.
QUERIES, VECTORS = 512, 4096


def _matrix(lists: pa.Array | pa.ChunkedArray) -> bytes:
    """Fails where lists differ in length."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    length = pc.min_max(pc.list_value_length(lists)).as_py()
    if length["min"] != length["max"]:
        raise ValueError(f"vectors of {length['min']} and of {length['max']} numbers")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes()


def _packed(size: int):
    """Blocks of `size` rows of one task, whatever the batches they come in."""

    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        return pa.record_batch({"ids": pa.array([t.column("id").to_pylist()], pa.list_(t.schema.field("id").type)), "vectors": pa.array([_matrix(t.column("v"))], pa.binary())})

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.slice(at, size - n)
                held.append(part)
                at, n = at + len(part), n + len(part)
                if n == size:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    return apply


def _group_packed(key: tuple, rows: pa.Table) -> pa.Table:
    ids = pa.array([rows.column("id").to_pylist()], pa.list_(rows.schema.field("id").type))
    return pa.table({"grp": pa.array([key[0].as_py()], rows.schema.field("grp").type), "salt": pa.array([key[1].as_py()], pa.int32()), "ids": ids, "vectors": pa.array([_matrix(rows.column("v"))], pa.binary())})


def _slim(df: DataFrame, id_col: str, vector_col: str, same: list[str], any_of: str | None = None) -> DataFrame:
    """id, v, and what must agree as grp: the columns of same, and each of the values of the array any_of (a row for each)."""
    own = df.where(F.col(vector_col).isNotNull())
    for c in same:
        own = own.where(F.col(c).isNotNull())
    parts = [F.col(c).alias(f"s{k}") for k, c in enumerate(same)]
    own = own.select(*parts, *([F.explode(F.array_distinct(any_of)).alias("any")] if any_of else []), F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    parts = [f"s{k}" for k in range(len(same))] + ["any"] * bool(any_of)
    if not parts:
        return own.select("id", "v")
    own = own.where(F.col("any").isNotNull()) if any_of else own
    return own.select((F.col(parts[0]) if len(parts) == 1 else F.to_json(F.struct(*parts))).alias("grp"), "id", "v")


def _n_blocks(slim: DataFrame, size: int) -> DataFrame:
    return slim.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n"))


def _blocks(slim: DataFrame, size: int) -> DataFrame:
    """ids, vectors; with a column grp, of each value apart: grp, salt (the block's number in its value), ids, vectors."""
    kind = slim.schema["id"].dataType.simpleString()
    if "grp" not in slim.columns:
        return slim.mapInArrow(_packed(size), f"ids array<{kind}>, vectors binary")
    dealt = slim.join(_n_blocks(slim, size), "grp").select("grp", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("salt"), "id", "v")
    return dealt.groupBy("grp", "salt").applyInArrow(_group_packed, f"grp {slim.schema['grp'].dataType.simpleString()}, salt int, ids array<{kind}>, vectors binary")


#: Queries of a block that are compared at a time: the scores of these and a block of vectors are 4 MB.
AT_ONCE = 128


def _best(k: int):
    def unit(raw: memoryview, n: int) -> np.ndarray:
        x = np.frombuffer(raw).reshape(n, -1)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        with np.errstate(invalid="ignore", divide="ignore"):
            return x / norm

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # pairs are read where they lie in the batch, one by one: a worker holds the batch and one pair's unit vectors
            for p in range(len(batch)):
                names, own = (batch.column(c)[p].values for c in ("q_ids", "ids"))
                ids = np.array(own.to_pylist())
                a, b = unit(batch.column("q_vectors")[p].as_buffer(), len(names)), unit(batch.column("vectors")[p].as_buffer(), len(ids))
                if a.shape[1] != b.shape[1]:
                    raise ValueError(f"queries of {a.shape[1]} numbers and vectors of {b.shape[1]}")
                top = min(k, len(ids))
                by_id = np.argsort(ids, kind="stable")
                place = np.empty(len(ids), np.int64)
                place[by_id] = np.arange(len(ids))
                for q in range(0, len(names), AT_ONCE):
                    # ties within 9 decimals go by id, so that results don't hang on the order of additions
                    score = np.round(a[q : q + AT_ONCE] @ b.T, 9)
                    rank = np.where(np.isnan(score), -np.inf, score)
                    edge = np.partition(rank, len(ids) - top, axis=1)[:, len(ids) - top]
                    row, at = np.nonzero(rank >= edge[:, None])
                    order = np.lexsort((place[at], -rank[row, at], row))
                    row, at = row[order], at[order]
                    first = np.arange(len(row)) - np.searchsorted(row, row) < top
                    row, at = row[first], at[first]
                    found = score[row, at]
                    yield pa.record_batch({"query_id": names.take(pa.array(row + q)), "vec_id": own.take(pa.array(at)), "cosine": pa.array(found, mask=np.isnan(found))})

    return apply


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", same: str | list[str] | None = None, query_col: str | None = None,
    any_of: tuple[str, str] | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, cosine (9 decimals): for each query the k nearest vectors, ties by id.

    Ids are numbers or texts; query_col: the queries' id, if it has another name. same: columns on which
    query and vector must agree (nulls agree with nothing). any_of: array columns of vectors and of queries that
    must have a value in common: a vector is posted under each of its values, met under those that a query
    names, and kept once. Without either, all vectors are searched. A vector of zeros has a null cosine and
    ranks last; null vectors aren't found. Fails where vectors, or vectors and queries, differ in length.
    """
    same = [same] if isinstance(same, str) else same or []
    own, wanted = any_of or (None, None)
    return nearest(_slim(vectors, id_col, vector_col, same, own), _slim(queries, query_col or id_col, vector_col, same, wanted), k, once=any_of is not None)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, once: bool = False) -> DataFrame:
    """top_k() of columns id, v and maybe grp, on which both sides agree. once: a vector, or a query, may be there under several values of grp."""
    of_vectors = _blocks(vectors, VECTORS)
    of_queries = _blocks(queries, QUERIES).withColumnRenamed("ids", "q_ids").withColumnRenamed("vectors", "q_vectors")
    if "grp" in vectors.columns:
        # a query block goes to each block of its value, so that these may be in as many tasks
        sent = of_queries.drop("salt").join(_n_blocks(vectors, VECTORS), "grp").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        met = sent.join(of_vectors, ["grp", "salt"])
    else:
        met = of_queries.crossJoin(of_vectors)
    kinds = [met.schema[c].dataType.elementType.simpleString() for c in ("q_ids", "ids")]
    best = met.select("q_ids", "q_vectors", "ids", "vectors").mapInArrow(_best(k), f"query_id {kinds[0]}, vec_id {kinds[1]}, cosine double")
    best = best.groupBy("query_id", "vec_id").agg(F.max("cosine").alias("cosine")) if once else best
    by_query = Window.partitionBy("query_id").orderBy(F.col("cosine").desc_nulls_last(), "vec_id")
    return best.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "cosine")


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays; null where either has no length. For single pairs: top_k is for searches."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def in_deal(rows: DataFrame, deal: str | None = None, column: str = "deal_id") -> DataFrame:
    """Rows of one deal; of all deals where none is named."""
    return rows if deal is None else rows.where(F.col(column) == str(deal))


def in_categories(rows: DataFrame, wanted: list[str], column: str = "categories") -> DataFrame:
    """Rows that have any of the categories; none where none is wanted."""
    return rows.where(F.arrays_overlap(F.col(column), F.array(*[F.lit(w) for w in wanted]).cast("array<string>")))


def matching(rows: DataFrame, k: int | None = None, order: str = "chunk_index") -> DataFrame:
    """Rows in order of their index, at most k: a listing by metadata alone, in a defined order."""
    ordered = rows.orderBy(order)
    return ordered if k is None else ordered.limit(k)
