"""Ingest, question answering and summaries, as whole plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_id, words_used
from ..operators.backends import Classifier, Embedding, Generator
from ..operators.context import context_block, first_of
from ..operators.flatten import flatten
from ..operators.search import top_k
from ..operators.threads import asked
from ..operators.trim import LIMIT, within

#: What a summary asks, when nothing else is given.
QUESTIONS = (
    "Who are the parties to the agreement?",
    "What is the price, and how is it paid?",
    "What must happen before closing?",
    "What do the parties promise and represent?",
    "How can the agreement be ended?",
    "Which dates and periods matter?",
)


def vectors_of(files: DataFrame, classifier: Classifier, embedding: Embedding, limit: int = LIMIT) -> DataFrame:
    """VECTOR rows of contract files: flattened, classified, embedded, trimmed; clauses without text are left out but keep their number."""
    rows = flatten(files).where(F.length("combined_text") > 0)
    rows = rows.withColumn("found", classifier.classify(F.col("combined_text"))).withColumn("embedding", embedding.embed(F.col("combined_text")))
    rows = rows.select(
        chunk_id(F.col("deal_id"), F.col("chunk_index")).alias("chunk_id"), "embedding", "deal_id", "deal_name", "label", "original_text", "combined_text",
        F.col("found.categories").alias("categories"), "chunk_index", F.col("found.clause_summary").alias("clause_summary"), F.create_map().cast("map<string,string>").alias("extra"),
    )
    return within(rows, limit, apart=("chunk_id", "embedding"))


def retrieve(vectors: DataFrame, questions: DataFrame, embedding: Embedding, k: int = 5, per_deal: bool = True) -> DataFrame:
    """questions: query_id (long), query, deal_id. The k nearest clauses of each, of its own deal if per_deal: query_id, query, rank, cosine and the clause's columns."""
    embedded = questions.withColumn("embedding", embedding.embed(F.col("query")))
    found = top_k(vectors, embedded.select("query_id", "embedding", "deal_id"), k, "chunk_id", same="deal_id" if per_deal else None, query_col="query_id").withColumnRenamed("vec_id", "chunk_id")
    return found.join(questions.select("query_id", "query"), "query_id").join(vectors.drop("embedding"), "chunk_id")


def answers(found: DataFrame, generator: Generator, histories: DataFrame | None = None) -> DataFrame:
    """query_id, query, answer, context, usage (approximate): one row a question.

    histories: query_id and history (an array of role and content, in order), what was said before some of the questions.
    """
    category = F.array_join("categories", ", ")
    blocks = found.groupBy("query_id", "query").agg(context_block(F.col("rank"), F.col("label"), category, F.col("combined_text")).alias("context"))
    if histories is None:
        out = blocks.withColumn("answer", generator.answer(F.col("query"), F.col("context")))
    else:
        met = blocks.join(histories.select("query_id", "history"), "query_id", "left")
        out = met.withColumn("answer", generator.answer(F.col("query"), F.col("context"), F.col("history")))
    sent, got = words_used(F.concat("query", F.lit(" "), "context")), words_used(F.col("answer"))
    return out.select("query_id", "query", "answer", "context", F.struct(sent.alias("prompt_tokens"), got.alias("completion_tokens"), (sent + got).alias("total_tokens")).alias("usage"))


def thread_replies(messages: DataFrame, generator: Generator, thread_col: str = "thread_id", at: str = "created_at", content_col: str = "content", limit: int | None = None) -> DataFrame:
    """thread, question, answer: to the last message of a user in every thread, one reply from what was said before it."""
    met = asked(messages, thread_col, at, content_col=content_col, limit=limit)
    return met.select(thread_col, "question", generator.answer(F.col("question"), F.lit(""), F.col("history")).alias("answer"))


def summaries(found: DataFrame, generator: Generator) -> DataFrame:
    """deal_id, summary, context: clauses found for several questions, each text once, under the question that found it first."""
    once = first_of(found, ["deal_id", "combined_text"], ["query_id", "rank"])
    ordered = once.withColumn("place", F.row_number().over(Window.partitionBy("deal_id").orderBy("query_id", "rank")))
    blocks = ordered.groupBy("deal_id").agg(context_block(F.col("place"), F.col("label"), F.array_join("categories", ", "), F.col("combined_text"), F.col("query")).alias("context"))
    return blocks.withColumn("summary", generator.answer(F.lit("Summarise the agreement."), F.col("context")))
