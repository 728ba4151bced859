"""What the operators share: reading a table's id and text, and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one in the warehouse.

    A warehouse on a local disk is shared by nobody but the threads of a local master, so on a cluster without
    either setting this fails rather than have each executor write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path(warehouse)
    scheme = path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
    if scheme == "file" and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share: the warehouse is on a local disk")
    return f"{warehouse}/cut"


#: Of each run of collected() that is under way, the tables it has made.
_made: list[list[Tables]] = []


class Tables:
    """Tables of one run of an operator, in a folder of its own below the shared one.

    Later steps start from these files, so they survive a lost executor. What no later step reads is dropped,
    and everything where a step fails; tables that the operator's result reads stay, as checkpoint files would.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.written: list[tuple[DataFrame, str]] = []
        for made in _made:
            made.append(self)

    def cut(self, df: DataFrame) -> DataFrame:
        """Writes df once and reads it back."""
        path = f"{self.folder}/{len(self.written)}"
        try:
            df.write.parquet(path)
        except BaseException:
            self.drop_all()
            raise
        self.written.append((self.spark.read.schema(df.schema).parquet(path), path))
        return self.written[-1][0]

    def drop(self, *tables: DataFrame) -> None:
        for name in [path for df, path in self.written if any(df is t for t in tables)]:
            self._delete(name)

    def keep(self, *tables: DataFrame) -> None:
        """Drops all but these."""
        self.drop(*[df for df, _ in self.written if not any(df is t for t in tables)])

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, failed: type | None, *_: object) -> None:
        """Leaves nothing behind where a step fails."""
        if failed:
            self.drop_all()

    def drop_all(self) -> None:
        self._delete(self.folder)


@contextmanager
def collected() -> Iterator[None]:
    """Drops in the end all tables that operators made meanwhile: for applications that have written a result by then."""
    _made.append([])
    try:
        yield
    finally:
        for tables in _made.pop():
            tables.drop_all()


def cut(df: DataFrame) -> DataFrame:
    """Writes df once to the shared folder and reads it back."""
    return Tables(df.sparkSession).cut(df)


def looked_up(many: DataFrame, one: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """many with the columns of the row of `one` that has its key, but for the weight: as an inner join.

    weight: how many rows of many a key has at most; total: what they add up to. Keys with a thousandth of
    all or more are a thousand at most and are sent to all tasks, so no key has more than that in a shuffle.
    """
    large = F.col(weight) * 1000 >= total
    return many.join(F.broadcast(one.where(large).drop(weight)), key).unionByName(many.join(one.where(~large).drop(weight), key))


def small_batches(spark: SparkSession) -> SparkSession:
    """For applications, before they run an operator: texts then travel to Python in batches of a few MB, whatever their size.

    Operators themselves change no setting of a session, and are right with any.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return spark


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone, so that other columns, whatever their names, neither clash nor travel; null texts become empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def told_apart(rows: DataFrame, tables: Tables) -> DataFrame:
    """rows (doc_id and text) with a column row, by which they can be dealt evenly: also those that are equal to each other have numbers of their own.

    Only hashes are counted to find them; equal rows are then combined before they are shuffled, and are as many
    again afterwards, each with its number among them (and a word first: nulls are left out of a hash).
    """
    hashed = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    many = tables.cut(hashed.groupBy("row").count().where("count > 1").select("row"))
    if many.isEmpty():
        tables.drop(many)
        return hashed
    copies = hashed.join(many, "row", "left_semi").groupBy("doc_id", "text").count()
    each = copies.select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy"))
    return hashed.join(many, "row", "left_anti").unionByName(each.select("doc_id", "text", F.xxhash64(F.lit("copy"), "copy", "doc_id", "text").alias("row")))


def free_name(df: DataFrame, name: str) -> str:
    """A name like `name` that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(rows: DataFrame, each: int = 128 << 20) -> int:
    """How many parts texts are dealt into: as many as Spark shuffles into, and more where a part would have over `each` bytes."""
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).head()[0] or 0
    return max(partitions(rows.sparkSession), -(-total // each))


def remainder(modulus: int, column: str = "doc_id"):
    """crc32 of the id written as text, modulo a number; ids that are null count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
