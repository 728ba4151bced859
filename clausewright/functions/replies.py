"""Reading what a language model replied: fenced blocks, classifications, answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once, stripped

#: What stands around a block of code, and how an answer stands in a reply that isn't JSON.
FENCE, LANGUAGE = "```", "json"
ANSWER = r'"answer"\s*:\s*"([^"]*)"'


def fenced(reply: Column) -> Column:
    """What stands between the first two fences, without the language's name and blanks around it; null where there aren't two."""
    parts = F.split(reply, FENCE, 3)
    inside = F.try_element_at(parts, F.lit(2))
    return F.when(F.size(parts) == 3, stripped(F.when(inside.startswith(LANGUAGE), F.substr(inside, F.lit(len(LANGUAGE) + 1))).otherwise(inside)))


def unfenced(reply: Column) -> Column:
    """The first fenced block, else the reply."""
    return F.coalesce(F.nullif(fenced(reply), F.lit("")), reply)


def _parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def is_object(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(_parsed(text)).startswith("OBJECT"), F.lit(False))


def is_list(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(_parsed(text)).startswith("ARRAY"), F.lit(False))


def classification(reply: Column) -> Column:
    """categories (never null) and clause_summary (never null); empty where the reply is no object."""
    none = F.array().cast("array<string>")
    read = lambda text: F.when(is_object(text), F.from_json(text, "categories array<string>, clause_summary string"))
    told = lambda r: F.struct(F.coalesce(r["categories"], none).alias("categories"), F.coalesce(r["clause_summary"], F.lit("")).alias("clause_summary"))
    return once(once(unfenced(F.coalesce(reply, F.lit(""))), read), told)


def answer(reply: Column) -> Column:
    """answer and error: an object's answer (empty where it has none); of what isn't JSON, the first "answer": "..."; other JSON is an error."""
    text = unfenced(F.coalesce(reply, F.lit("")))
    parsed = _parsed(text)
    found = F.when(parsed.isNull(), F.regexp_extract(text, ANSWER, 1)).when(is_object(text), F.coalesce(F.try_variant_get(parsed, "$.answer", "string"), F.lit("")))
    return F.struct(found.alias("answer"), F.when(parsed.isNotNull() & ~is_object(text), F.lit("reply is not an object")).alias("error"))


def metadata(reply: Column) -> Column:
    """The reply's object as JSON text: the reply itself, else a fenced block, else what stands between its outermost braces, else null."""
    tries = [reply, fenced(reply), F.regexp_extract(reply, r"\{[\s\S]*\}", 0)]
    return F.coalesce(*[F.when(is_object(t), t) for t in tries])


def whole_number(text: Column) -> Column:
    """A whole number of any length that fits 64 bits, with or without a sign; null for anything else."""
    return F.when(F.trim(text).rlike("^[+-]?[0-9]+$"), F.trim(text).try_cast("long"))


def decoded(value: Column) -> Column:
    """JSON text as it is; any other string as a JSON string, so that the result always parses."""
    quoted = F.regexp_extract(F.to_json(F.array(value)), r"^\[([\s\S]*)\]$", 1)
    return F.when(F.try_parse_json(value).isNotNull(), value).otherwise(quoted)
