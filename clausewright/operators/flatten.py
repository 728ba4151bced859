"""Contract JSON to clause rows.

A file holds articles in one of five shapes; an article flattens to clauses by its sections and
definitions. Everything is one expression on the file's text, so a file is one row until its clauses are
numbered, and no join or shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import breadcrumb, deal_name, once, path_of, stripped, straight_quotes
from ..schemas import ARTICLE

#: Of definitions, those whose term contains this are clauses.
TERM = "Material Adverse Effect"
_KEYS = ("article", "title", "text", "sections")


def _begins(text: Column, sign: str) -> Column:
    return F.coalesce(F.ltrim(text).startswith(sign), F.lit(False))


def _elements(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def articles(raw: Column) -> Column:
    """The file's articles as JSON texts, in file order; null where the file has none of the shapes.

    A list; an object that is an article itself; one with a list under data, or under articles; or one whose
    values are articles or lists of them. Of the last, values that are no objects are passed over.
    """
    of_value = lambda v: F.when(_begins(v, "{"), F.array(v)).when(_begins(v, "["), F.filter(_elements(v), lambda e: _begins(e, "{"))).otherwise(F.array().cast("array<string>"))

    def of_object(entries: Column) -> Column:
        is_article = F.exists(F.map_keys(entries), lambda k: k.isin(*_KEYS))
        data, own = F.try_element_at(entries, F.lit("data")), F.try_element_at(entries, F.lit("articles"))
        return F.when(is_article, F.array(raw)).when(_begins(data, "["), _elements(data)).when(_begins(own, "["), _elements(own)).otherwise(F.flatten(F.transform(F.map_values(entries), of_value)))

    shape = F.when(_begins(raw, "["), _elements(raw)).when(_begins(raw, "{"), once(F.from_json(raw, "map<string,string>"), of_object))
    return F.when(F.try_parse_json(raw).isNotNull(), shape)


def _row(label: Column, original: Column, combined: Column) -> Column:
    return F.struct(label.alias("label"), original.alias("original_text"), combined.alias("combined_text"))


_NONE = "array<struct<label:string,original_text:string,combined_text:string>>"


def _definitions(items: Column, before: Column, term: str) -> Column:
    wanted = F.filter(items, lambda d: F.coalesce(d["term"].contains(term), F.lit(False)))

    def row(d: Column) -> Column:
        text = F.concat(d["term"], F.lit(" "), F.coalesce(d["definition"], F.lit("")))
        return _row(path_of(before, d["term"]), text, text)

    return F.transform(wanted, row)


def clauses(article: Column, term: str = TERM) -> Column:
    """An article (struct) as an array of label, original_text, combined_text.

    An article "Definitions" gives its definitions with the term; one without sections its text, if there is
    any; a section of definitions those with the term; any other section one row, even without text, whose
    combined text has the article's before it.
    """
    label, text = breadcrumb("ARTICLE", article["article"], article["title"]), stripped(straight_quotes(article["text"]))
    none = F.array().cast(_NONE)

    def of_section(s: Column) -> Column:
        own, body = path_of(label, breadcrumb("Section", s["section"], s["title"])), straight_quotes(s["text"])
        defines = F.coalesce(F.lower(s["title"]).contains("definition"), F.lit(False)) & s["definitions"].isNotNull()
        whole = F.when(text != "", F.concat(text, F.lit("\n\n"), body)).otherwise(body)
        return F.when(defines, _definitions(s["definitions"], own, term).cast(_NONE)).otherwise(F.array(_row(own, body, whole)).cast(_NONE))

    without = F.when(text != "", F.array(_row(label, text, text)).cast(_NONE)).otherwise(none)
    sections = article["sections"]
    return (
        F.when(article["article"] == "Definitions", F.coalesce(_definitions(article["definitions"], F.lit("Definition"), term).cast(_NONE), none))
        .when(F.coalesce(F.size(sections), F.lit(0)) <= 0, without)
        .otherwise(F.flatten(F.transform(sections, of_section)))
    )


def flatten(files: DataFrame, term: str = TERM, strict: bool = False) -> DataFrame:
    """files: deal_id, path, raw. One row a clause: deal_id, chunk_index (in file order from 0), label, original_text, combined_text, deal_name.

    A deal that comes in several files has their clauses numbered on where files have a column first_chunk, the number of a file's first clause.
    What rejects() lists is left out; with strict, the job fails on it instead.
    """
    items = articles(files["raw"])
    good = F.filter(items, lambda e: _begins(e, "{"))
    if strict:
        good = F.when(items.isNull() | (F.size(good) < F.size(items)), F.raise_error(F.concat(F.lit("not a contract: "), files["path"])).cast("array<string>")).otherwise(good)
    rows = F.flatten(F.transform(F.transform(good, lambda e: F.from_json(e, ARTICLE)), lambda a: clauses(a, term)))  # each article is parsed once
    first = F.coalesce(files["first_chunk"], F.lit(0)) if "first_chunk" in files.columns else F.lit(0)
    each = files.select("deal_id", deal_name(F.regexp_replace(files["path"], r"\.gz$", "")).alias("deal_name"), first.cast("int").alias("first"), F.posexplode(rows).alias("place", "c"))
    return each.select("deal_id", (F.col("first") + F.col("place")).alias("chunk_index"), "c.label", "c.original_text", "c.combined_text", "deal_name")


def rejects(files: DataFrame) -> DataFrame:
    """deal_id, path, position (null for a whole file), reason: what flatten leaves out."""
    items = articles(files["raw"])
    whole = files.where(items.isNull()).select("deal_id", "path", F.lit(None).cast("int").alias("position"), F.when(F.try_parse_json("raw").isNull(), "not JSON").otherwise("neither a list nor an object").alias("reason"))
    each = files.select("deal_id", "path", F.posexplode(items).alias("position", "item")).where(~_begins(F.col("item"), "{"))
    return whole.unionByName(each.select("deal_id", "path", "position", F.lit("article is not an object").alias("reason")))


def counts(rows: DataFrame) -> DataFrame:
    """A deal's clauses, and how many of them are definitions."""
    return rows.groupBy("deal_id").agg(F.count(F.lit(1)).alias("total_clauses"), F.count_if(F.col("label").contains(" > ") & F.col("label").contains(TERM)).alias("total_definitions"))
