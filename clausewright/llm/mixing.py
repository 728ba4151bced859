"""Mixing sources to target weights with hash-threshold histograms, in DataFrame functions alone.

Each source gets a share of the words by its weight. Which of its documents are taken is decided by a
hash of their id: sizes are summed by source and hash bucket, the bucket in which a source's budget runs
out is found, only that bucket is summed again by finer bits, and at last one comparison with a
threshold tells every document whether it is taken. No document is sorted or moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Tables, free_name

WORD = r"[^\x20\x09-\x0D]+"
#: 3 levels of 4,096 buckets: 36 bits of the id's md5
LEVELS, BITS = 3, 12


def hash36(column: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, 9), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources: source, source_size. Adds target: share of all sizes dealt by weight, none above most times its source's size.

    Weights repeat over the sources in code point order, null last. One row a source passes through here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    dealt = sources.withColumn("place", F.row_number().over(by_name)).withColumn("weight", weight).withColumn("top", most * F.col("source_size"))
    fullest = Window.orderBy(F.col("top") / F.col("weight"), "place")
    earlier, all_rows = fullest.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (share * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("top").over(earlier), F.lit(0.0))) / (
        F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    )
    dealt = dealt.withColumn("level", level).withColumn("full", F.col("top") / F.col("weight") <= F.col("level"))
    # those at their top come first; from the first that isn't, whose level all others share, levels only fall
    common = F.max(F.when(~F.col("full"), F.col("level"))).over(all_rows)
    return dealt.select("source", "source_size", F.when(F.col("full"), F.col("top")).otherwise(F.col("weight") * common).alias("target"))


def thresholds(sized: DataFrame, wanted: DataFrame, tables: Tables) -> DataFrame:
    """sized: source, size, h. wanted: source, source_size, target. Adds base (whole copies of every document) and edge: one copy more where h < edge."""
    same = F.expr("l.source <=> r.source")
    found = wanted.withColumn("base", F.when(F.col("target") >= F.col("source_size"), 1).otherwise(0).cast("long"))
    found = found.withColumn("need", F.col("target") - F.col("base") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        within = sized.alias("l").join(found.alias("r"), same & (F.shiftright("l.h", shift + BITS) == F.col("r.prefix")))
        sums = within.groupBy(F.col("l.source").alias("source"), F.shiftright("l.h", shift).alias("bucket"), F.col("r.need").alias("need")).agg(F.sum("l.size").alias("n"))
        sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")))
        edges = sums.where((F.col("upto") >= F.col("need")) & (F.col("need") > 0)).groupBy("source").agg(F.min(F.struct("bucket", "n", "upto")).alias("e"))
        found = found.alias("l").join(edges.alias("r"), same, "left").select("l.*", "r.e")
        before = F.col("e.upto") - F.col("e.n")
        nearer = F.coalesce(F.col("e.upto") - F.col("need") <= F.col("need") - before, F.lit(False))
        # without a need the edge is the lower end; where rounding leaves more need than there is, the upper
        end = F.when(F.col("need") > 0, F.shiftleft(F.col("prefix") + 1, BITS)).otherwise(F.shiftleft("prefix", BITS))
        found = found.select(
            "source", "source_size", "target", "base",
            F.when(F.col("e").isNull(), F.lit(0.0)).otherwise(F.col("need") - before).alias("need"),
            F.coalesce(F.col("e.bucket"), end).alias("prefix"),
            (F.coalesce(F.col("e.bucket"), end) + F.when(nearer, 1).otherwise(0)).alias("edge"),
        )
        found = tables.cut(found)
    return found.select("source", "source_size", "target", "base", "edge")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (0, 1 or 2 times its size).

    A null text has size 0; null is a source of its own, the last; rows that share an id are taken
    together; an empty table gives no rows. Each source's taken words differ from its target by at most
    half the size of the documents that share one 36-bit hash, as a rule one document.
    """
    sized, edges = _edges(docs, id_col, text_col, source_col, weights, share, most)
    joined = sized.alias("d").join(edges.alias("e"), F.expr("d.source <=> e.source"))
    return joined.select("d.doc_id", "d.size", "e.source_size", "e.target", (F.col("d.size") * _copies(F.col("d.h"))).cast("long").alias("taken"))


def _edges(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, most: float) -> tuple[DataFrame, DataFrame]:
    tables = Tables(docs.sparkSession)
    sized = tables.cut(
        docs.select(
            docs[id_col].cast("long").alias("doc_id"),
            docs[source_col].cast("string").alias("source"),
            F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            hash36(docs[id_col]).alias("h"),
        )
    )
    wanted = tables.cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    return sized, thresholds(sized, wanted, tables).select("source", "source_size", "target", "base", "edge")


def _copies(h: Column) -> Column:
    return F.col("e.base") + F.when(h < F.col("e.edge"), 1).otherwise(0)


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: the rows of docs, all columns, each as many times (0, 1 or 2) as mix() takes it.

    Rows of size 0 (null texts, texts without words) cost no budget and go by their id's hash as others do;
    rows that share an id in a source are taken together; null is a source of its own, the last; an empty
    table gives no rows.
    """
    _, edges = _edges(docs, id_col, text_col, source_col, weights, share, most)
    joined = docs.alias("d").join(edges.alias("e"), F.col(f"d.{source_col}").cast("string").eqNullSafe(F.col("e.source")))
    time = free_name(docs, "time")
    times = F.explode(F.array_repeat(F.lit(True), _copies(hash36(F.col(f"d.{id_col}"))).cast("int"))).alias(time)
    return joined.select("d.*", times).drop(time)


MIX_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 9))::bigint as h
  from {documents}),
named as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as place
  from sized group by source),
weighed as (select *, [5.0::double, 2.0::double, 1.0::double][(place - 1) % 3 + 1] as weight, 2.0::double * source_size as "top" from named),
dealt as (
  select *, (1.5::double * sum(source_size) over ()::double - coalesce(sum("top") over w, 0.0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0.0)) as level
  from weighed window w as (order by "top" / weight, place rows between unbounded preceding and 1 preceding)),
wanted as (
  select source, source_size, case when "top" / weight <= level then "top"
    else weight * (max(level) filter (where "top" / weight > level) over ()) end as target
  from dealt),
needs as (select *, case when target >= source_size then 1 else 0 end::bigint as base, target - (case when target >= source_size then 1 else 0 end) * source_size as need from wanted),
units as (
  select source, h, n, sum(n) over (partition by source order by h)::bigint as upto from (select source, h, sum(size)::bigint as n from sized group by source, h)),
marked as (
  select u.source, u.h, u.upto - u.n < d.need and (u.upto < d.need or u.upto - d.need <= d.need - (u.upto - u.n)) as more
  from units u join needs d on u.source is not distinct from d.source)
select s.doc_id, s.size, d.source_size, d.target, (s.size * (d.base + m.more::int))::bigint as taken
from sized s join needs d on s.source is not distinct from d.source
join marked m on s.source is not distinct from m.source and s.h = m.h
"""
