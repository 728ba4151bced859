"""Text normalisation and rendering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """What body() makes of a value that is computed once a row, however often body() names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def straight_quotes(text: Column) -> Column:
    """Curly quotes become straight ones, long dashes hyphens; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), "“”‘’–—", "\"\"''--")


def stripped(text: Column) -> Column:
    """Without any Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def right_stripped(text: Column) -> Column:
    """Without ASCII blanks (tab, line feed, form feed, carriage return, space) at the end; null stays null. A run of blanks is read once, wherever it is."""
    return F.regexp_replace(text, r"(?<![\t\n\f\r ])[\t\n\f\r ]++\z", "")


def clean(text: Column) -> Column:
    return stripped(straight_quotes(text))


def deal_name(path: Column) -> Column:
    """Of a file's path or URL: its name without .json and date, each word capitalised."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_extract(path, "[^/]*$", 0), r"\.json$", ""), r"_\d{4}-\d{2}-\d{2}$", "")
    return F.array_join(F.transform(F.split(name, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ")


def breadcrumb(kind: str, number: Column, title: Column) -> Column:
    """`ARTICLE I Merger`, `Section 1.1 Price`: what is missing counts as empty."""
    return stripped(F.concat(F.lit(f"{kind} "), F.coalesce(number, F.lit("")), F.lit(" "), F.coalesce(title, F.lit(""))))


def path_of(*parts: Column) -> Column:
    return F.concat_ws(" > ", *parts)


def chunk_id(deal: Column, index: Column) -> Column:
    return F.concat_ws("_", deal, index)


def is_object_id(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-fA-F]{24}$"), F.lit(False))


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def second(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def joined_url(base: str, path: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(path, "^/+", ""))


def numbered_list(items: Column) -> Column:
    """1. a, 2. b, ... one a line."""
    return F.array_join(F.transform(items, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c)), "\n")


def definition_list(definitions: Column) -> Column:
    """"term" : definition, joined by bars."""
    return F.array_join(F.transform(definitions, lambda d: F.concat(F.lit('"'), F.coalesce(d["term"], F.lit("")), F.lit('" : '), F.coalesce(d["definition"], F.lit("")))), " | ")


def field_descriptions(fields: Column) -> Column:
    """`name: description` of each (structs), a blank line apart; missing descriptions are empty."""
    return F.array_join(F.transform(fields, lambda f: F.concat(F.coalesce(f["name"], F.lit("")), F.lit(": "), F.coalesce(f["description"], F.lit("")))), "\n\n")


def is_definition(text: Column) -> Column:
    """Whether a text looks like one that defines a term: it has a colon and says that something means something."""
    return F.coalesce(text.contains(":") & text.contains("means"), F.lit(False))


def context_line(number: Column, label: Column, category: Column, content: Column, query: Column | None = None) -> Column:
    """Fixed format: `[n] label [Category: c] (Related to: q): content` and a blank line; the parts in brackets only where there is something."""
    some = lambda before, x, after: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(before), x, F.lit(after))).otherwise("")
    about = some(" (Related to: ", query, ")") if query is not None else F.lit("")
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), F.coalesce(label, F.lit("")), some(" [Category: ", category, "]"), about, F.lit(": "), F.coalesce(content, F.lit("")), F.lit("\n\n"))


def words_used(text: Column) -> Column:
    """A stand-in for a model's token usage: words between blanks. Only an approximation."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")
