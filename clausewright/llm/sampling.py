"""Bounded samples of labelled documents, to fit classifiers on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Tables, remainder, texts

#: What is learned of one text has at most this part of the size that all may have, so that no few texts make the sample: of a
#: larger text, stretches from all over it.
LARGEST = 1 / 64
#: Stretches that are taken of a text that is too large.
STRETCHES = 8


def _stretches(last: Column, seed: Column, take: Callable[[Column], Column], glue: str) -> Column:
    """Of a text's stretches 0 to last, the STRETCHES of least hash, in order."""
    drawn = F.array_sort(F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.xxhash64(seed, k).alias("h"), k.alias("k"))))
    chosen = F.array_sort(F.transform(F.slice(drawn, 1, STRETCHES), lambda s: s["k"]))
    return F.array_join(F.transform(chosen, take), glue)


def some_lines(text: Column, most: int, seed: Column) -> Column:
    """Stretches of whole lines of a text, `most` lines at most (8 or more)."""
    each = most // STRETCHES or 1
    lines = F.split(text, "\n", -1)
    last = F.floor((F.size(lines) - 1) / each).cast("int")
    return _stretches(last, seed, lambda k: F.array_join(F.slice(lines, k * each + 1, each), "\n"), "\n")


def some_letters(text: Column, most: int, seed: Column) -> Column:
    """Stretches of a text, `most` bytes at most (a word at a stretch's end may be cut)."""
    each = max(1, most // STRETCHES // 4 - 1)
    last = F.floor((F.length(text) - 1) / each).cast("int")
    return _stretches(last, seed, lambda k: F.substr(text, k * each + 1, F.lit(each)), " ")


def labelled(
    docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, modulus: int, left_out: int, rows: int, size: Column, most: int, tables: Tables,
    shorten: Callable[[Column, int, Column], Column] = some_lines,
) -> DataFrame:
    """doc_id, label, text of at most `rows` labelled documents, whose sizes add up to `most` at most.

    Of the documents that are there and have a label, those with the least hash of their id come first; those whose
    crc32(doc_id as text) modulo `modulus` is `left_out` are left out. Labels that are null are passed over;
    where a document has several, the largest counts; of several texts of one id, one is taken (the one with
    the least hash). size: a whole number, by the column text. Of a text of more than LARGEST of `most`, shorten() takes so much.
    """
    usable = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label].cast("int").alias("label"))
    usable = usable.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (remainder(modulus) != left_out))
    there = usable.groupBy("doc_id").agg(F.max("label").alias("label")).join(docs.select(docs[id_col].cast("long").alias("doc_id")), "doc_id", "left_semi")
    chosen = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    one = max(1, int(most * LARGEST))
    met = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # `rows` rows at most
    met = met.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).withColumn("size", size)
    met = met.withColumn("text", F.when(F.col("size") > one, shorten(F.col("text"), one, F.col("doc_id"))).otherwise(F.col("text")))
    met = tables.cut(met.select("doc_id", "label", "text").withColumn("size", size))
    upto = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    fits = met.select("doc_id", "size").withColumn("upto", upto).where(F.col("upto") <= most).select("doc_id")  # `rows` rows at most
    return met.join(F.broadcast(fits), "doc_id").select("doc_id", "label", "text")
