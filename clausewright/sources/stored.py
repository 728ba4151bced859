"""Tables on disk that are changed in place: Parquet in folders, of which a change rewrites those it touches, or adds files to them.

A change is staged first: the new content of the folders it touches is written beside the table, and only when
that is complete do these folders change. Whoever opens the table next finishes a change that was staged and
drops one that wasn't, so a job that dies at any point leaves the table before or after the change.
One writer at a time; readers that began before a change may have to be run again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.updates import free, latest, merged_updates, patch
from ..session import filesystem

_PARTS = "part int, filled boolean, added boolean"
#: A folder with so many files of fewer bytes than these is rewritten by the next change, rather than added to.
MANY, SMALL = 16, 1 << 20


class Folders:
    """Rows in folders numbered by one column, which the rows themselves don't show."""

    #: How what is written is compressed; as the session says where this is None.
    compression: str | None = None

    def __init__(self, spark: SparkSession, path: str, settings: dict[str, str], schema: StructType, part: str):
        self.spark, self.path, self.settings, self.schema, self.part = spark, path.rstrip("/"), settings, schema, part
        self._recover()

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        fs, at = filesystem(spark, f"{path.rstrip('/')}/_table/_SUCCESS")
        return fs.exists(at)

    @classmethod
    def _open(cls, spark: SparkSession, path: str, wanted: dict[str, str], schema: StructType | None) -> tuple[dict[str, str], StructType]:
        """The table's settings and schema, made with the wanted ones if there is none yet. Fails where the table was made with others."""
        at = f"{path.rstrip('/')}/_table"
        if not cls.exists(spark, path):
            if schema is None:
                raise ValueError(f"no table at {path}")
            kept = wanted | {"schema": schema.json().replace("ullable\":false", "ullable\":true").replace("ontainsNull\":false", "ontainsNull\":true")}  # as files are
            spark.createDataFrame(sorted(kept.items()), "name string, value string").coalesce(1).write.mode("overwrite").json(at)
        found = {r["name"]: r["value"] for r in spark.read.schema("name string, value string").json(at).collect()}
        for name, value in wanted.items():
            if found.get(name) != value:
                raise ValueError(f"the table at {path} has {name} {found.get(name)}, not {value}")
        return found, StructType.fromJson(json.loads(found.pop("schema")))

    def rows(self, parts: list[int] | None = None, with_part: bool = False) -> DataFrame:
        """All rows, or those of some folders, of which alone the files are then read."""
        every = StructType([*self.schema.fields, StructField(self.part, IntegerType())])
        if not self._some():
            found = self.spark.createDataFrame([], every)
        else:
            found = self.spark.read.schema(every).parquet(self.path)
        found = found if parts is None else found.where(F.col(self.part).isin(parts))
        return found if with_part else found.drop(self.part)

    def _some(self) -> bool:
        fs, at = filesystem(self.spark, f"{self.path}/{self.part}=*")
        return bool(len(fs.globStatus(at) or []))

    def rewrite(self, new: DataFrame, parts: list[int]) -> None:
        """Puts the rows of new (with the part column) in place of all rows of these folders, and of nothing else."""
        if parts:
            at = self.stage()
            self._complete(at, parts, self._dealt(new, f"{at}/rows"))

    def _dealt(self, rows: DataFrame, at: str) -> list[int]:
        """Writes rows (with the part column) in folders; which these are."""
        out = self._even(rows).write.partitionBy(self.part)
        (out.option("compression", self.compression) if self.compression else out).parquet(at)
        return self._in(at)

    def _in(self, at: str) -> list[int]:
        """The numbers of the folders in a folder."""
        fs, folder = filesystem(self.spark, at)
        return sorted(int(str(x.getPath().getName()).split("=")[1]) for x in fs.listStatus(folder) if "=" in x.getPath().getName())

    def _complete(self, at: str, parts: list[int], filled: list[int], added: list[int] | None = None) -> None:
        """Applies a stage: of these parts, those that are filled get the staged rows for theirs, the others none; those added get the files of new rows besides theirs."""
        listed = [(p, p in filled, False) for p in parts] + [(p, True, True) for p in added or []]
        # the list is the sign that the stage is complete
        self.spark.createDataFrame(sorted(listed), _PARTS).coalesce(1).write.parquet(f"{at}/parts")
        self._apply(at)

    def stage(self) -> str:
        """A new folder for a change; one without a list of parts is dropped by whoever opens the table next."""
        return f"{self.path}/_staged/{uuid.uuid4().hex}"

    def kept(self, rows: DataFrame, at: str) -> DataFrame:
        """Rows that a change reads several times, made once."""
        rows.write.parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def _even(self, rows: DataFrame) -> DataFrame:
        """A folder's rows together, as few files, but those of a large folder in several tasks: Spark splits it by its measured size."""
        return rows.hint("rebalance", self.part)

    def _apply(self, at: str) -> None:
        """Moves staged folders, or the files of one, to their places, one after another; where that has begun, those that are still staged."""
        for r in self.spark.read.schema(_PARTS).parquet(f"{at}/parts").collect():
            name = f"{self.part}={r.part}"
            fs, new = filesystem(self.spark, f"{at}/rows/{name}")
            old = filesystem(self.spark, f"{self.path}/{name}")[1]
            if r.added:
                fs.mkdirs(old)
                for x in fs.globStatus(filesystem(self.spark, f"{at}/new/{name}/part-*")[1]) or []:  # names that no other file has
                    self._move(fs, x.getPath(), filesystem(self.spark, f"{self.path}/{name}/{x.getPath().getName()}")[1])
            elif not r.filled:  # of which no row is left
                fs.delete(old, True)
            elif fs.exists(new):
                fs.delete(old, True)
                self._move(fs, new, old)
        self.drop_stage(at)

    @staticmethod
    def _move(fs, new, old) -> None:
        if not fs.rename(new, old):
            raise OSError(f"can't move {new.toString()} to {old.toString()}")

    def drop_stage(self, at: str) -> None:
        fs, folder = filesystem(self.spark, at)
        fs.delete(folder, True)

    def leave_stage(self, at: str) -> None:
        """Drops a stage unless it is complete: such a one was not applied, and whoever opens the table next finishes it."""
        fs, done = filesystem(self.spark, f"{at}/parts/_SUCCESS")
        if not fs.exists(done):
            self.drop_stage(at)

    def _crowded(self, parts: list[int]) -> list[int]:
        """Folders to which files were added so often that they should be rewritten."""
        fs = filesystem(self.spark, self.path)[0]
        small = lambda p: sum(x.getLen() < SMALL for x in fs.globStatus(filesystem(self.spark, f"{self.path}/{self.part}={p}/part-*")[1]) or [])
        return [p for p in parts if small(p) >= MANY]

    def _recover(self) -> None:
        fs, at = filesystem(self.spark, f"{self.path}/_staged/*")
        for x in fs.globStatus(at) or []:
            stage = str(x.getPath().toString())
            if fs.exists(filesystem(self.spark, f"{stage}/parts/_SUCCESS")[1]):
                self._apply(stage)
            else:
                fs.delete(x.getPath(), True)


class KeyedTable(Folders):
    """One row a key, in buckets by the key's hash."""

    def __init__(self, spark: SparkSession, path: str, key: str | None = None, schema: StructType | None = None, buckets: int = 64, compression: str | None = None):
        """Opens the table, or makes it where there is none. Many more keys want more buckets: one is rewritten as a whole."""
        self.compression = compression
        wanted = {"key": key} if key else {}
        found, kept = self._open(spark, path, wanted if self.exists(spark, path) else wanted | {"buckets": str(buckets)}, schema)
        self.key, self.buckets = found["key"], int(found["buckets"])
        super().__init__(spark, path, found, kept, "bucket")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _touched(self, batch: DataFrame) -> list[int]:
        return sorted(r[0] for r in batch.select(self._bucket()).distinct().collect())  # at most as many as there are buckets

    def _change(self, batch: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """Buckets that hold a key of the batch get the rows that change() makes of theirs; how many these are."""
        touched = self._touched(batch)
        self.rewrite(change(self.rows(touched)).select(*self.schema.names).withColumn("bucket", self._bucket()), touched)
        return len(touched)

    def upsert(self, new: DataFrame, version: list[str] | None = None) -> int:
        """New rows in place of those of their keys; of several of a key, the highest version, or else the largest. Rows without a key are left out.

        Rows that the table already has as they are touch nothing, so a batch that comes twice changes nothing.
        Returns how many buckets were rewritten or added to, as the other changes do.
        """
        at = self.stage()
        try:
            self.receive(self._latest(new.where(F.col(self.key).isNotNull()), version), at)
            return self.take(at)
        finally:
            self.leave_stage(at)

    def _latest(self, rows: DataFrame, version: list[str] | None = None) -> DataFrame:
        return latest(rows, self.key, [*(version or []), *[c for c in self.schema.names if c != self.key and _ordered(self.schema[c].dataType)]]).select(*self.schema.names)

    def receive(self, new: DataFrame, at: str) -> DataFrame:
        """New rows, made once and written once, where take() finds them; those without a key are left out."""
        own = new.where(F.col(self.key).isNotNull()).select(*self.schema.names).withColumn("bucket", self._bucket())
        self._dealt(own, f"{at}/new")
        return self.spark.read.schema(own.schema).parquet(f"{at}/new")

    def take(self, at: str) -> int:
        """Upserts what was received in a stage; how many buckets that touches. Of several rows of a key the largest counts.

        Where all keys of a bucket are new its files are moved to it as they are, and nothing is rewritten.
        """
        every = StructType([*self.schema.fields, StructField("bucket", IntegerType())])
        new = self.spark.read.schema(every).parquet(f"{at}/new")
        came = self._in(f"{at}/new")
        mark, times = free("digest", new), free("times", new)
        keys = new.select("bucket", self.key, F.lit(1).alias(mark)).unionByName(self.rows(came, with_part=True).select("bucket", self.key, F.lit(0).alias(mark)))
        met = keys.groupBy("bucket", self.key).agg(F.sum(mark).alias(mark), F.count(F.lit(1)).alias(times)).where((F.col(mark) > 0) & (F.col(times) > 1))
        found = {r[0]: r[1] for r in met.groupBy("bucket").agg(F.max(mark) > 1).collect()}  # at most as many as there are buckets
        mixed = sorted({*found, *self._crowded(came)})
        added = [p for p in came if p not in mixed]
        touched: list[int] = []
        filled: list[int] = []
        if mixed:
            fresh = new.where(F.col("bucket").isin(mixed)).drop("bucket")
            fresh = self._latest(fresh) if any(found.values()) else fresh
            stored = self.rows(mixed).select(self.key, self._digest().alias(mark))
            changed = self.kept(fresh.withColumn(mark, self._digest()).join(stored, [self.key, mark], "left_anti").drop(mark), f"{at}/changed")
            touched = self._touched(changed)
            if touched:
                old = self.rows(touched).join(changed.select(self.key), self.key, "left_anti")
                filled = self._dealt(old.unionByName(changed).withColumn("bucket", self._bucket()), f"{at}/rows")
        if touched or added:
            self._complete(at, touched, filled, added)
        return len(touched) + len(added)

    def _digest(self) -> Column:
        """Equal rows have equal ones, nulls included."""
        return F.sha2(F.to_json(F.struct(*self.schema.names), {"ignoreNullFields": "false"}), 256)

    def patch(self, updates: DataFrame, extra: str | None = None, version: list[str] | None = None) -> int:
        """Updates as operators.updates.patch takes them; keys that aren't there are passed over."""
        return self._change(merged_updates(updates, self.key, version, extra).select(self.key), lambda old: patch(old, updates, self.key, extra, version))

    def delete(self, keys: DataFrame) -> int:
        gone = keys.select(self.key).distinct()
        there = self.rows().select(self.key).join(gone, self.key, "left_semi")
        return self._change(there, lambda old: old.join(gone, self.key, "left_anti"))


def _ordered(kind) -> bool:
    return kind.typeName() not in ("map", "variant")
