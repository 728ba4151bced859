"""A stored index of vectors: inverted lists by k-means, kept on disk and changed in place.

Vectors lie in folders, one a list: those that are nearest to the list's centre. A search asks the few lists
whose centres are nearest to the query and ranks their vectors exactly. As each list's width (the widest angle
between its centre and a vector of it) is kept as well, a search can also tell which other lists could hold
something nearer than what it has found, and ask only those: then its result is that of a search of
everything. Dimension and metric are kept beside the vectors; an index is made once and then reused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.stored import Folders
from .search import AT_ONCE, nearest, top_k
from .updates import free, latest, merged_updates, patch

#: Lists at most (their centres are sent to all tasks: 25 MB at 1,536 numbers); vectors that centres are fitted on, a list; rounds of the fit.
LISTS, SAMPLE, ROUNDS = 4096, 64, 12
#: How many lists a search asks is measured: so many that of the K nearest of PROBED vectors this share lies in them.
RECALL, K, PROBED = 0.95, 10, 100
METRIC = "cosine"


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _rows(values: pa.Array | pd.Series, dimension: int) -> np.ndarray:
    out = np.array([np.asarray(v, np.float64) for v in values]).reshape(-1, dimension)
    return _unit(out)


def nearest_list(vector: Column, centres: np.ndarray) -> Column:
    """list (a vector of zeros goes to the first), and the cosine to its centre."""

    @F.pandas_udf("list int, cosine double")
    def found(v: pd.Series) -> pd.DataFrame:
        return _nearest_lists(v, centres)

    return found(vector)


def _nearest_lists(v: pd.Series, centres: np.ndarray) -> pd.DataFrame:
    at, cosine = np.zeros(len(v), np.int32), np.zeros(len(v))
    for a in range(0, len(v), AT_ONCE):
        score = _rows(v[a : a + AT_ONCE], centres.shape[1]) @ centres.T
        at[a : a + AT_ONCE], cosine[a : a + AT_ONCE] = score.argmax(1), score.max(1)
    return pd.DataFrame({"list": at, "cosine": cosine})


def _slices(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """AT_ONCE rows at a time and their vectors (column v), so that what is made of them and all centres stays small, whatever the batches and lists."""
    for batch in batches:
        for a in range(0, len(batch), AT_ONCE):
            part = batch.slice(a, AT_ONCE)
            yield part, _rows(part.column("v").to_pylist(), dimension)


def _sums(centres: np.ndarray):
    """Within a task: of each list the sum and the number of its vectors."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for _, x in _slices(batches, centres.shape[1]):
            at = (x @ centres.T).argmax(1)
            np.add.at(total, at, x)
            n += np.bincount(at, minlength=len(centres))
        some = np.flatnonzero(n)
        yield pa.record_batch({"list": pa.array(some.astype(np.int32)), "n": pa.array(n[some]), "total": pa.array([t.tobytes() for t in total[some]], pa.binary())})

    return apply


def _added(key: tuple, rows: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(t) for t in rows.column("total").to_pylist()], axis=0)
    return pa.table({"list": pa.array([key[0].as_py()], pa.int32()), "total": pa.array([total.tobytes()], pa.binary())})


def _asked_lists(part: pa.RecordBatch, lists: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch({"lists": pa.array(lists, pa.list_(pa.int32())), "id": part.column("id"), "v": part.column("v")})


def _first(centres: np.ndarray, probes: int):
    """Within a task: of each query (columns id, v) the lists whose centres are nearest."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _slices(batches, centres.shape[1]):
            yield _asked_lists(part, [np.argsort(-s, kind="stable")[:probes].astype(np.int32) for s in x @ centres.T])

    return apply


def _others(centres: np.ndarray, probes: int, width: np.ndarray):
    """Within a task: of each query (columns id, v, least) the lists beyond the first that could hold a vector of cosine `least` or more (any, where that is null)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _slices(batches, centres.shape[1]):
            score = x @ centres.T
            angle = np.arccos(np.clip(score, -1, 1))
            # no vector of the list is nearer than this; a query of zeros asks all lists
            near = np.maximum(angle - width, 0) * np.any(x != 0, axis=1, keepdims=True)
            least = pc.fill_null(part.column("least"), -2.0).to_numpy()
            open_ = (np.cos(near) >= least[:, None] - 1e-6) & np.isfinite(width)
            yield _asked_lists(part, [np.setdiff1d(np.flatnonzero(o), np.argsort(-s, kind="stable")[:probes]).astype(np.int32) for o, s in zip(open_, score, strict=True)])

    return apply


def fit(vectors: DataFrame, lists: int, dimension: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by k-means on directions, of `sample` vectors a list at most (columns id, v): those with the least hash of their id.

    Each round assigns vectors and sums them up where they are; the driver sees a row a list. Begins with the vectors of
    least hash; a list without vectors keeps its centre.
    """
    chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(lists * sample).select("v").persist()
    try:
        begin = _rows([r.v for r in vectors.orderBy(F.xxhash64("id"), "id").limit(lists).collect()], dimension)
        centres = np.unique(begin[np.any(begin != 0, axis=1)], axis=0) if len(begin) else begin
        if not len(centres):
            return np.eye(1, dimension)
        for _ in range(rounds):
            sums = chosen.mapInArrow(_sums(centres), "list int, n long, total binary").groupBy("list").applyInArrow(_added, "list int, total binary").collect()
            moved = centres.copy()
            for r in sums:
                moved[r["list"]] = np.frombuffer(r.total)
            moved = np.where(np.any(moved != 0, axis=1, keepdims=True), _unit(moved), centres)
            if np.allclose(moved, centres, atol=1e-6):
                break
            centres = moved
        return centres
    finally:
        chosen.unpersist()


class VectorIndex(Folders):
    """One row a vector: its id, the vector and any other columns, as the schema says."""

    def __init__(self, spark: SparkSession, path: str, dimension: int, schema: StructType | None = None, metric: str = METRIC, id_col: str = "vec_id", vector_col: str = "embedding"):
        """Opens the index, or makes it where there is none; fails where it was made with another dimension or metric."""
        if metric != METRIC:
            raise ValueError(f"the metric is {METRIC}")
        found, kept = self._open(spark, path, {"dimension": str(dimension), "metric": metric, "id": id_col, "vector": vector_col}, schema)
        self.dimension, self.id_col, self.vector_col = dimension, id_col, vector_col
        super().__init__(spark, path, found, kept, "list")

    def _centres(self) -> np.ndarray:
        """Centres of all lists, in order of their numbers: LISTS rows at most."""
        rows = self.spark.read.parquet(f"{self.path}/_centres").orderBy("list").collect()
        return np.array([r.centre for r in rows])

    def _checked(self, rows: DataFrame) -> DataFrame:
        """The index's columns of rows that have a vector; fails on the first of another length."""
        v = F.col(self.vector_col)
        wrong = F.raise_error(F.concat(F.lit(f"the index has vectors of {self.dimension} numbers, not of "), F.size(v).cast("string")))
        checked = F.when(F.size(v) == self.dimension, v).otherwise(wrong.cast(self.schema[self.vector_col].dataType))
        return rows.where(v.isNotNull() & F.col(self.id_col).isNotNull()).select(*[checked.alias(c) if c == self.vector_col else F.col(c) for c in self.schema.names])

    def _listed(self, rows: DataFrame, centres: np.ndarray) -> DataFrame:
        return rows.withColumn("list", nearest_list(F.col(self.vector_col), centres)["list"])

    def build(self, rows: DataFrame, lists: int | None = None) -> VectorIndex:
        """Fits centres on a bounded part of the rows and puts every row into its list, in place of what the index held. lists: by default the root of the number of rows."""
        own = self._checked(latest(rows.where(F.col(self.id_col).isNotNull()), self.id_col, [F.xxhash64(self.vector_col)]))
        lists = lists or max(1, round(own.count() ** 0.5))
        slim = own.select(F.col(self.id_col).alias("id"), F.col(self.vector_col).cast("array<double>").alias("v"))
        centres = fit(slim, min(lists, LISTS), self.dimension)
        held = sorted(r[0] for r in self.rows(with_part=True).select("list").distinct().collect())
        told = self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "list int, centre array<double>")
        told.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_centres")
        self.rewrite(self._listed(own, centres), sorted({*held, *range(len(centres))}))
        probes = self._measured(centres)
        self.spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_probes")
        return self

    def _measured(self, centres: np.ndarray) -> int:
        """The number of lists that hold RECALL of the K nearest of PROBED vectors (those with the least hash of their id), each list counted by its nearness to the vector.

        Vectors that have no structure want most lists, those of a model few.
        """
        rows = self.rows(with_part=True)
        asked = rows.orderBy(F.xxhash64(self.id_col), self.id_col).limit(PROBED)
        found = top_k(rows, asked, K + 1, self.id_col, self.vector_col).where("cosine is not null and query_id <> vec_id")
        where = found.join(rows.select(F.col(self.id_col).alias("vec_id"), "list"), "vec_id").select("query_id", "list").collect()
        vectors = {r[0]: r[1] for r in asked.select(self.id_col, F.col(self.vector_col).cast("array<double>")).collect()}
        order = {q: np.argsort(np.argsort(-(_rows([v], self.dimension) @ centres.T)[0], kind="stable")) for q, v in vectors.items()}
        places = sorted(int(order[r.query_id][r["list"]]) for r in where)
        return 1 + places[min(len(places) - 1, int(RECALL * len(places)))] if places else len(centres)

    def _probes(self) -> int:
        return self.spark.read.parquet(f"{self.path}/_probes").head()[0]

    def _where(self, ids: DataFrame) -> list[int]:
        """Lists that hold one of these ids; of the files only ids are read."""
        there = self.rows(with_part=True).select(self.id_col, "list").join(ids.select(self.id_col), self.id_col, "left_semi")
        return sorted(r[0] for r in there.select("list").distinct().collect())

    def upsert(self, rows: DataFrame, version: list[str] | None = None) -> int:
        """Rows in place of those of their ids (of several, the highest version), each in the list of its vector; how many lists were rewritten."""
        fresh = self._checked(latest(rows.where(F.col(self.id_col).isNotNull()), self.id_col, [*(version or []), F.xxhash64(self.vector_col)]))
        listed = self._listed(fresh, self._centres())
        touched = sorted({*self._where(fresh), *[r[0] for r in listed.select("list").distinct().collect()]})
        old = self.rows(touched, with_part=True).join(fresh.select(self.id_col), self.id_col, "left_anti")
        self.rewrite(old.unionByName(listed), touched)
        return len(touched)

    def patch(self, updates: DataFrame, extra: str | None = None, version: list[str] | None = None) -> int:
        """Metadata of some ids as operators.updates.patch changes it; vectors stay."""
        own = updates.drop(self.vector_col)
        touched = self._where(merged_updates(own, self.id_col, version, extra))
        mark = free("held", own)
        old = self.rows(touched, with_part=True).withColumnRenamed("list", mark)
        self.rewrite(patch(old, own, self.id_col, extra, version).withColumnRenamed(mark, "list"), touched)
        return len(touched)

    def delete(self, ids: DataFrame) -> int:
        touched = self._where(ids)
        self.rewrite(self.rows(touched, with_part=True).join(ids.select(self.id_col).distinct(), self.id_col, "left_anti"), touched)
        return len(touched)

    def _slim(self, lists: list[int] | None = None) -> DataFrame:
        return self.rows(lists, with_part=True).select(F.col("list").alias("grp"), F.col(self.id_col).alias("id"), F.col(self.vector_col).cast("array<double>").alias("v"))

    def _asking(self, queries: DataFrame, query_col: str | None) -> DataFrame:
        own = queries.where(F.col(self.vector_col).isNotNull()).select(F.col(query_col or self.id_col).alias("id"), F.col(self.vector_col).cast("array<double>").alias("v"))
        wrong = F.raise_error(F.concat(F.lit(f"the index has vectors of {self.dimension} numbers, the query has "), F.size("v").cast("string"))).cast("array<double>")
        return own.withColumn("v", F.when(F.size("v") == self.dimension, F.col("v")).otherwise(wrong))

    def widths(self) -> dict[int, float]:
        """Of each list the widest angle between its centre and one of its vectors (of zeros: any)."""
        centres = self._centres()
        found = self.rows(with_part=True).select("list", nearest_list(F.col(self.vector_col), centres)["cosine"].alias("c")).groupBy("list").agg(F.min("c").alias("c"))
        return {r["list"]: float(np.arccos(np.clip(r.c, -1, 1))) for r in found.collect()}

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, exact: bool = False, query_col: str | None = None) -> DataFrame:
        """query_id, rank, vec_id, cosine (9 decimals), as search.top_k: of the vectors in the `probes` lists whose centres are nearest to the query.

        Without probes, as many as were measured when the index was built.

        exact: then also of all lists that could hold a vector as near as the k-th found so far, by the angles
        between query, centre and list; what is found is what a search of all vectors finds.
        """
        centres = self._centres()
        probes = probes or self._probes()
        own = self._asking(queries, query_col)

        kinds = f"lists array<int>, id {own.schema['id'].dataType.simpleString()}, v array<double>"
        asked = own.mapInArrow(_first(centres, probes), kinds).select(F.explode("lists").alias("grp"), "id", "v")
        found = nearest(self._slim(), asked, k, once=True)
        if not exact:
            return found
        width = np.full(len(centres), -np.inf)
        for at, angle in self.widths().items():
            width[at] = angle

        least = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.max("rank") == k, F.min("cosine")).alias("least"), F.count_if(F.col("cosine").isNull()).alias("none"))
        open_ = own.join(least, "id", "left").select("id", "v", F.when(F.col("none") == 0, F.col("least")).alias("least"))
        asked = open_.mapInArrow(_others(centres, probes, width), kinds).select(F.explode("lists").alias("grp"), "id", "v")
        more = nearest(self._slim(), asked, k, once=True)
        both = found.unionByName(more)
        by_query = Window.partitionBy("query_id").orderBy(F.col("cosine").desc_nulls_last(), "vec_id")
        return both.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "cosine")


def recall(found: DataFrame, wanted: DataFrame) -> float:
    """The share of the wanted pairs (query_id, vec_id) that were found."""
    both = wanted.select("query_id", "vec_id").join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi")
    n = wanted.count()
    return both.count() / n if n else 1.0
