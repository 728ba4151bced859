"""A schema of sections and fields, fanned out over the clauses of their categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .backends import Extractor
from .context import first_of, joined_texts

_FIELD = "array<struct<field_name:string,instructions:string,category_mapping:array<struct<category:string>>>>"


def read_schema(raw: DataFrame, max_sections: int | None = None, max_fields: int | None = None) -> DataFrame:
    """raw: column raw, one JSON object a row, section name to list of fields. FIELD rows in the order of the file."""
    sections = raw.select(F.posexplode(F.map_entries(F.from_json("raw", "map<string,string>"))).alias("section_ord", "e"))
    each = sections.select("section_ord", F.col("e.key").alias("section"), F.posexplode(F.from_json("e.value", _FIELD)).alias("field_ord", "f"))
    rows = each.select("section_ord", "section", "field_ord", F.col("f.field_name").alias("field_name"), F.col("f.instructions").alias("instructions"), F.transform("f.category_mapping", lambda c: c["category"]).alias("categories"))
    rows = rows if max_sections is None else rows.where(F.col("section_ord") < max_sections)
    return rows if max_fields is None else rows.where(F.col("field_ord") < max_fields)


def matched(fields: DataFrame, chunks: DataFrame, k: int | None = None) -> DataFrame:
    """deal_id, section, field_name, chunk_index, text: for each deal and field the clauses that share a category, all or the first k.

    fields: section, field_name, categories; chunks: deal_id, chunk_index, text, categories. Joined category by
    category, so a hash join takes the place of comparing every field with every clause.
    """
    wanted = fields.select("section", "field_name", F.explode("categories").alias("category"))
    held = chunks.select("deal_id", "chunk_index", "text", F.explode("categories").alias("category"))
    met = held.join(wanted, "category").select("deal_id", "section", "field_name", "chunk_index", "text").dropDuplicates(["deal_id", "section", "field_name", "chunk_index"])
    if k is None:
        return met
    order = Window.partitionBy("deal_id", "section", "field_name").orderBy("chunk_index")
    return met.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def field_texts(met: DataFrame) -> DataFrame:
    """deal_id, section, field_name, text, n: distinct texts of each field, in order, put together."""
    once = first_of(met, ["deal_id", "section", "field_name", "text"], ["chunk_index"])
    return once.groupBy("deal_id", "section", "field_name").agg(joined_texts(F.col("chunk_index"), F.col("text")).alias("text"), F.count(F.lit(1)).alias("n"))


def extract(fields: DataFrame, chunks: DataFrame, deals: DataFrame, backend: Extractor, k: int | None = None) -> DataFrame:
    """deal_id, section_ord, section, field_ord, field_name, answer, error, categories_used: a row for every deal and field.

    A field without categories, or of which no clause is found, has what the backend says of an empty text.
    """
    texts = field_texts(matched(fields, chunks, k))
    every = deals.select("deal_id").distinct().crossJoin(fields)  # a row for each is what is asked for; Spark sends the side that it measures small
    met = every.join(texts, ["deal_id", "section", "field_name"], "left")
    none = F.array().cast("array<string>")
    empty = F.size(F.coalesce("categories", none)) == 0
    return met.select(
        "deal_id", "section_ord", "section", "field_ord", "field_name", backend.extract(F.col("instructions"), F.coalesce("text", F.lit(""))).alias("answer"),
        F.when(F.col("categories").isNotNull() & empty, F.lit("field has no categories")).alias("error"), F.coalesce("categories", none).alias("categories_used"),
    )


def as_sections(results: DataFrame) -> DataFrame:
    """deal_id and a map from section to its fields' results, in order."""
    each = F.struct("field_ord", "field_name", "answer", "error", "categories_used")
    sections = results.groupBy("deal_id", "section_ord", "section").agg(F.array_sort(F.collect_list(each)).alias("fields"))
    return sections.groupBy("deal_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("section_ord", "section", "fields"))), lambda s: F.struct(s["section"], s["fields"]))).alias("schema_results"))
