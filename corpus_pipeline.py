"""A training corpus from documents: quality, exact copies, near copies, the mix of sources, packing.

Each stage works on what the one before it kept, written as Parquet and read again. All but the last return
the columns of documents. The tables are those of sf_dir; labels teaches the quality classifier. A stage has
texts travel to Python in small batches: a setting of the session, which is the pipeline's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clausewright.llm import crf, exact, mixing, near, packing
from clausewright.llm.store import Tables, collected, small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the conditional random field finds good; a null text is one empty line. Rows of one id, and repeated rows, are scored each."""
    return crf.keep_good(docs, small_batches(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to blanks, the one with the smallest doc_id; null counts as empty. Of repeated rows one stays; an id with several texts keeps those that are first of theirs."""
    small_batches(spark)
    return exact.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near links (five words, a similarity of 0.8) reach, the one with the smallest doc_id; null texts and those without words all stay. Rows of one id are one document, and stay or go together."""
    small_batches(spark)
    return near.keep_one(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document goes, stays, or is there twice. A null source is one of its own, a null text has no words; repeated rows are taken each."""
    return mixing.take(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 2048; a document that is there twice is packed twice. A null text is its end alone."""
    import public_tokenizers

    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("source mix", mixed),
    ("best-fit packing", packed),
]

#: The classifier and the packing aren't expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. What a stage reads goes once its result is written, so one copy of the corpus is there at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Tables(spark) as between:
        for _, stage in STAGES[:-1]:
            with collected():
                last, docs = docs, between.cut(stage(spark, docs, sf_dir))
            between.drop(last)
        return STAGES[-1][1](spark, docs, sf_dir)
