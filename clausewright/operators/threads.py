"""Conversation threads and pages of their messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .updates import free


def content(parts: Column) -> Column:
    """A message's first text part; empty where there is none."""
    return F.coalesce(F.try_element_at(F.filter(parts, lambda p: p["type"] == "text"), F.lit(1))["text"], F.lit(""))


def _by(messages: DataFrame, at: str, newest: bool, tie: str) -> list[Column]:
    """Order by time, messages of one time by their id if they have one."""
    columns = [at, *([tie] if tie in messages.columns and tie != at else [])]
    return [F.col(c).desc() if newest else F.col(c).asc() for c in columns]


def threads(rows: DataFrame, user: str | None = None) -> DataFrame:
    """Newest first, of one user if one is named."""
    own = rows if user is None else rows.where(F.col("user_id") == user)
    return own.orderBy(F.col("created_at").desc(), "thread_id")


def page(messages: DataFrame, thread: str, limit: int, order: str = "desc", thread_col: str = "thread_id", at: str = "created_at", tie: str = "message_id") -> DataFrame:
    """The first `limit` messages of a thread in the given order, then reversed: desc gives the newest, oldest first."""
    own = messages.where(F.col(thread_col) == thread)
    first, then = _by(messages, at, order == "desc", tie), _by(messages, at, order != "desc", tie)
    return own.orderBy(*first).limit(limit).orderBy(*then)


def pages(messages: DataFrame, limit: int, order: str = "desc", thread_col: str = "thread_id", at: str = "created_at", tie: str = "message_id") -> DataFrame:
    """page() of every thread at once; place: 1, 2, ... as shown."""
    first, then = _by(messages, at, order == "desc", tie), _by(messages, at, order != "desc", tie)
    by_thread = Window.partitionBy(thread_col)
    n = free("n", messages)
    some = messages.withColumn(n, F.row_number().over(by_thread.orderBy(*first))).where(F.col(n) <= limit)
    return some.withColumn("place", F.row_number().over(by_thread.orderBy(*then))).drop(n)


def after_send(messages: DataFrame, thread: str | None = None, thread_col: str = "thread_id", at: str = "created_at", tie: str = "message_id") -> DataFrame:
    """What a thread shows after a message was sent: newest first. Without a thread, all threads, one after another."""
    own = messages if thread is None else messages.where(F.col(thread_col) == thread)
    return own.orderBy(thread_col, *_by(messages, at, True, tie))


def asked(messages: DataFrame, thread_col: str = "thread_id", at: str = "created_at", tie: str = "message_id", content_col: str = "content", limit: int | None = None) -> DataFrame:
    """thread, question, history: each thread's last message of a user, and what was said before it, in order (the last `limit`, if given).

    Threads in which no user has spoken have no row. An aggregate a thread: its messages come together.
    """
    order = [c for c in (at, tie) if c in messages.columns]
    each = F.struct(*dict.fromkeys(order), "role", F.col(content_col).alias("content"))
    said = messages.groupBy(thread_col).agg(F.array_sort(F.collect_list(each)).alias("_all"))
    last = F.array_max(F.transform(F.col("_all"), lambda m, i: F.when(m["role"] == "user", i)))
    met = said.withColumn("_last", last).where(F.col("_last").isNotNull())
    start = F.lit(0) if limit is None else F.greatest(F.col("_last") - limit, F.lit(0))
    before = F.slice("_all", start + 1, F.col("_last") - start)
    history = F.transform(before, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return met.select(thread_col, F.element_at("_all", F.col("_last") + 1)["content"].alias("question"), history.alias("history"))


def opened(messages: DataFrame, thread_col: str = "thread_id", at: str = "created_at") -> DataFrame:
    """A row a thread: how many messages it has, its first and last time."""
    return messages.groupBy(thread_col).agg(F.count(F.lit(1)).alias("n_messages"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
