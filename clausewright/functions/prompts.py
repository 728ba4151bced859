"""What a language model is told: messages (role, content) of each task, in our own words.

A real model behind operators.backends is given these; its reply goes to functions.replies.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import numbered_list

CLASSIFY = "You sort clauses of contracts. Name those of the listed categories that say what the clause does, and no others, and put the clause in one or two plain sentences."
CLASSIFY_REPLY = 'Reply with JSON alone: {"categories": [names from the list], "clause_summary": "your sentences"}'
EXTRACT = "You find one fact in clauses of a contract. Use nothing but these clauses, and say NA where they don't tell."
EXTRACT_REPLY = 'Reply with JSON alone: {"answer": "the fact"}'
CHAT = "You answer questions on contracts. Use nothing but the numbered clauses below, name the numbers you rely on, and say so where they don't tell."
SUMMARY = "You sum up a contract for a reader in a hurry. Use nothing but the numbered clauses below; keep parties, price, conditions, promises, ways out and dates apart."

_MESSAGES = "array<struct<role:string,content:string>>"


def message(role: str, *parts: Column | str) -> Column:
    """One message; parts stand a blank line apart, and null counts as empty."""
    texts = [F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts]
    return F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *texts).alias("content"))


def classify(text: Column, categories: Column) -> Column:
    """categories: an array of names."""
    return F.array(message("system", CLASSIFY, CLASSIFY_REPLY), message("user", F.lit("Categories:"), numbered_list(categories), F.lit("Clause:"), text))


def extract(instructions: Column, text: Column) -> Column:
    return F.array(message("system", EXTRACT, EXTRACT_REPLY), message("user", instructions, F.lit("Clauses:"), text))


def chat(question: Column, context: Column, history: Column | None = None) -> Column:
    """The context, then what was said before (an array of role and content, in order; null is none), then the question."""
    before = F.array().cast(_MESSAGES) if history is None else F.coalesce(F.transform(history, lambda m: F.struct(F.coalesce(m["role"], F.lit("user")).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"))), F.array().cast(_MESSAGES))
    return F.concat(F.array(message("system", CHAT, context)), before, F.array(message("user", question)))


def summary(context: Column) -> Column:
    return F.array(message("system", SUMMARY, context), message("user", "Sum up the contract."))
