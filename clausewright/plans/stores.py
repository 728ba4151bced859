"""Registered queries of what is stored and streamed, each with its SQL: indexes, tables changed in place, states, ingest, files.

What they write goes to a folder of their own below the shared one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calls, metadata, numbering, search, trim
from ..operators.backends import HashedWords, Keywords
from ..operators.index import VectorIndex
from ..schemas import STATUSES
from ..session import own_folder, shuffles_dropped
from ..sources import files, workbook
from ..sources.stored import KeyedTable
from ..streaming import ingest, states
from ..streaming.streams import table_stream
from .catalogue import _SCORED, _TAGS, RULES, _found, _tagged, _vectors, query, table


@query(f"with {_SCORED.format(on='true')} select query_id, rank, vec_id, round(cosine, 6) as cosine from ranked where rank <= 10")
def topk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest by a stored index, which asks only the lists that could hold one of them."""
    vectors, asked = _vectors(spark, sf_dir)
    index = VectorIndex(spark, own_folder(spark), 64, vectors.schema).build(vectors)
    return _found(index.search(asked, exact=True))


@query(
    """with held as (
  select vec_id, case when vec_id % 10 = 3 then list_transform(embedding, lambda x: -x) else embedding end as embedding, case when vec_id % 10 = 7 then 99 else label end as label from embeddings where vec_id % 10 <> 1
  union all select vec_id + 1000000, embedding, label from embeddings where vec_id % 10 = 2),
scored as (select q.vec_id as query_id, v.vec_id, v.label, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9) as cosine from (select * from held where vec_id % 20 = 0) q, held v),
ranked as (select *, row_number() over (partition by query_id order by cosine desc, vec_id) as rank from scored)
select query_id, rank, vec_id, round(cosine, 6) as cosine, label from ranked where rank <= 5"""
)
def topk_index_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest by an index some of whose vectors were replaced, added, patched and deleted in place; opened anew."""
    vectors, _ = _vectors(spark, sf_dir)
    path = own_folder(spark)
    index = VectorIndex(spark, path, 64, vectors.schema).build(vectors)
    some = lambda k: vectors.where(F.col("vec_id") % 10 == k)
    turned = some(3).withColumn("embedding", F.transform("embedding", lambda x: -x))
    index.upsert(turned.unionByName(some(2).withColumn("vec_id", F.col("vec_id") + 1_000_000)))
    index.patch(some(7).select("vec_id", F.lit(99).alias("label")))
    index.delete(some(1))
    index = VectorIndex(spark, path, 64)
    asked = index.rows().where(F.col("vec_id") % 20 == 0)
    return _found(index.search(asked, k=5, exact=True)).join(index.rows().select("vec_id", "label"), "vec_id")


_DEALS = f"tagged as (select e.vec_id, e.embedding, d.source as deal, {_TAGS} as categories from embeddings e join documents d on d.doc_id = e.vec_id)"


@query(
    f"""with {_DEALS},
scored as (
  select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9) as cosine
  from (select * from tagged where vec_id % 20 = 0) q join tagged v on q.deal = v.deal and list_has_any(q.categories, v.categories)),
ranked as (select *, row_number() over (partition by query_id order by cosine desc, vec_id) as rank from scored)
select query_id, rank, vec_id, round(cosine, 6) as cosine from ranked where rank <= 5"""
)
def topk_deal_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of the query's deal that have any of its categories."""
    vectors, _ = _vectors(spark, sf_dir)
    tagged = vectors.join(_tagged(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), F.col("source").alias("deal"), "categories"), "vec_id")
    return _found(search.top_k(tagged, tagged.where(F.col("vec_id") % 20 == 0), 5, same=["deal"], any_of=("categories", "categories")))


def _customers(spark: SparkSession, sf_dir: str) -> KeyedTable:
    """Customers as a table on disk."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit(0).cast("long").alias("version"))
    stored = KeyedTable(spark, own_folder(spark), "c_custkey", rows.schema, 16)
    stored.upsert(rows)
    return stored


_LAST = "last as (select o_custkey as c_custkey, max(o_orderkey) as version, count(*) as n from orders group by o_custkey)"


@query(f"with {_LAST} select c_custkey, case when l.version is null then c_name else 'order ' || l.version end as c_name, coalesce(l.version, 0) as version from customer full join last l using (c_custkey)")
def stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers on disk with a customer's highest order written over them, twice."""
    stored = _customers(spark, sf_dir)
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("c_name"), F.col("o_orderkey").alias("version"))
    stored.upsert(new, ["version"])
    stored.upsert(new, ["version"])
    return stored.rows()


@query(
    """with u as (select o_custkey as c_custkey, max(o_orderkey) filter (where o_orderstatus = 'F') as failed, max(o_orderkey) as version from orders group by o_custkey)
select c_custkey, coalesce('failed ' || u.failed, c_name) as c_name, coalesce(u.version, 0) as version from customer left join u using (c_custkey)"""
)
def stored_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers on disk, patched by their orders: many updates a key, of which the last that names them counts."""
    stored = _customers(spark, sf_dir)
    name = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("failed "), F.col("o_orderkey").cast("string")))
    stored.patch(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), name.alias("c_name"), F.col("o_orderkey").alias("version")), version=["version"])
    return stored.rows()


@query("select c_custkey, c_name, 0::bigint as version from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def stored_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers on disk without those that have a failed order."""
    stored = _customers(spark, sf_dir)
    stored.delete(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")))
    return stored.rows()


_FITTED = "list_max(list_filter(range(0, {room} + 1), lambda n: strlen(to_json(substr({t}, 1, n))::varchar) - 2 <= {room}))"


@query(
    f"""with d as (select doc_id, source as deal_id, {_TAGS} as categories, text from documents),
begun as (select *, strlen(to_json(struct_pack(doc_id := doc_id, deal_id := deal_id))::varchar) + strlen(to_json(struct_pack(categories := categories))::varchar) - 1 as size,
  strlen(to_json(struct_pack(doc_id := doc_id, deal_id := deal_id, categories := categories, combined_text := text, original_text := text))::varchar) <= 1024 as fits from d),
one as (select *, 1024 - size - strlen(',"combined_text":""') as room from begun),
cut as (select *, case when fits then text else substr(text, 1, {_FITTED.format(t="text", room="room")}) end as combined_text from one),
two as (select *, room - (strlen(to_json(combined_text)::varchar) - 2) - strlen(',"original_text":""') as rest from cut),
done as (select *, case when fits then text when rest >= 0 then substr(text, 1, {_FITTED.format(t="text", room="rest")}) end as original_text from two)
select doc_id, deal_id, array_to_string(categories, ',') as categories, md5(combined_text) as combined_md5, coalesce(md5(original_text), 'none') as original_md5,
  (case when original_text is null then 1024 - rest - strlen(',"original_text":""') else strlen(to_json(struct_pack(doc_id := doc_id, deal_id := deal_id, categories := categories, combined_text := combined_text, original_text := original_text))::varchar) end)::int as bytes
from done"""
)
def trim_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of at most 1,024 bytes as they are sent, names, escapes and categories counted."""
    rows = _tagged(spark, sf_dir).select("doc_id", F.col("source").alias("deal_id"), "categories", F.col("text").alias("combined_text"), F.col("text").alias("original_text"))
    digest = lambda c: F.md5(F.col(c).cast("binary"))
    return trim.within(rows, 1024).select("doc_id", "deal_id", F.array_join("categories", ",").alias("categories"), digest("combined_text").alias("combined_md5"), F.coalesce(digest("original_text"), F.lit("none")).alias("original_md5"), trim.encoded(rows.columns).alias("bytes"))


_STEPS = [*STATUSES, "odd"]


def _status(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in _STEPS]), (number % len(_STEPS) + 1).cast("int"))


@query(
    f"""with steps as (select user_id, {_STEPS}[event_id % 5 + 1] as status, ts from events),
lists as (select user_id, list({{'s': status, 't': ts, 'a': 0, 'r': 0}} order by ts, list_position({list(STATUSES)}, status)) as l from steps group by user_id),
ran as (
  select user_id, list_reduce(list_prepend({{'s': '', 't': null::timestamp, 'a': 0, 'r': 0}}, l), lambda x, y: case
    when (x.s = '' and y.s = 'PENDING') or (x.s = 'PENDING' and y.s = 'PROCESSING') or (x.s = 'PROCESSING' and y.s in ('COMPLETED', 'FAILED'))
    then {{'s': y.s, 't': y.t, 'a': x.a + 1, 'r': x.r}} else {{'s': x.s, 't': x.t, 'a': x.a, 'r': x.r + 1}} end) as e from lists)
select user_id, coalesce(nullif(e.s, ''), 'none') as status, coalesce(strftime(e.t, '%Y-%m-%d %H:%M:%S.%f'), 'never') as at, e.a::bigint as n_accepted, e.r::bigint as n_refused from ran"""
)
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where jobs stand after a stream of statuses of which many don't follow: the events, a user being a job."""
    events = table(spark, sf_dir, "events")
    log = table_stream(spark, f"{sf_dir}/events.parquet", events.schema).select("user_id", _status(F.col("event_id")).alias("status"), F.col("ts").alias("at"))
    path = own_folder(spark)
    states.steps_to(log, f"{path}/steps", f"{path}/state", "user_id").awaitTermination()
    rows = states.jobs(spark.read.parquet(f"{path}/steps").drop("batch"), "user_id")
    at = F.coalesce(F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("never"))
    return rows.select("user_id", F.coalesce("status", F.lit("none")).alias("status"), at.alias("at"), "n_accepted", "n_refused")


#: A contract has one article a document; a source's documents are dealt into deals, and a deal's into files.
_FILES = "select source || '_' || (doc_id % 4) as deal_id, doc_id, lang as title, text from documents"


#: Articles of a file at most, so that a deal of any size comes in files that a task can hold.
ARTICLES = 500


def _contract_files(spark: SparkSession, sf_dir: str) -> str:
    """Documents as contract files, below a folder a deal; the folder they are in.

    A file's folder names its first clause's number. Articles without text, which give no clause, have files of their own.
    Texts are shuffled once, to their files, which are packed.
    """
    path = own_folder(spark)
    article = F.struct(F.lit("I").alias("article"), F.col("lang").alias("title"), "text", F.col("doc_id").alias("number"))
    deal = F.concat("source", F.lit("_"), (F.col("doc_id") % 4).cast("string"))
    docs = table(spark, sf_dir, "documents").withColumn("deal_id", deal).withColumn("told", F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False)))
    placed = numbering.block_within(docs.select("deal_id", "told", F.concat_ws("/", "deal_id", "told").alias("kind"), "doc_id", "lang", "text"), "kind", "doc_id", ARTICLES, own_folder(spark))
    held = placed.groupBy("deal_id", "told", "first").agg(F.array_sort(F.collect_list(F.struct(F.col("doc_id").alias("o"), article.alias("a")))).alias("l"))
    held.select("deal_id", "told", "first", F.transform("l", lambda x: x["a"]).alias("articles")).write.partitionBy("deal_id", "told", "first").json(path, compression="gzip")
    return path


def _deal_of_folder() -> Column:
    return F.regexp_extract("path", "deal_id=([^/]*)/", 1)


def _first_of_folder() -> Column:
    return F.regexp_extract("path", "/first=([0-9]+)/", 1).cast("int")


_CLAUSES = f"""files as ({_FILES}), clauses as (
  select deal_id, row_number() over (partition by deal_id order by doc_id) - 1 as chunk_index, 'ARTICLE I ' || title as label, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') as combined_text
  from files where regexp_replace(text, '\\s+', '', 'g') <> '')"""


@query(
    f"""with {_CLAUSES}, told as (select *, combined_text as text from clauses)
select deal_id || '_' || chunk_index as chunk_id, deal_id, chunk_index::int as chunk_index, label, md5(combined_text) as text_md5, array_to_string({_TAGS}, ',') as categories, 64 as dimension from told"""
)
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract files that arrive in several batches, to a vector table; the stream is started again at the end, and finds nothing new."""
    path = own_folder(spark)
    with shuffles_dropped(spark):
        came = _contract_files(spark, sf_dir)
        at_once = max(40, -(-files.listing(spark, came).count() // 3))  # a few batches
        for _ in range(2):
            stream = ingest.contract_stream(spark, came, _deal_of_folder(), at_once, _first_of_folder())
            ingest.ingest(stream, f"{path}/vectors", f"{path}/state", Keywords(RULES), HashedWords(), 1 << 20, 8).awaitTermination()
    rows = ingest.vector_table(spark, f"{path}/vectors").rows()
    return rows.select("chunk_id", "deal_id", "chunk_index", "label", F.md5(F.col("combined_text").cast("binary")).alias("text_md5"), F.array_join("categories", ",").alias("categories"), F.size("embedding").alias("dimension"))


@query(f"select deal_id, count(*) as n_articles, sum(length(text))::bigint as n_chars from ({_FILES}) group by deal_id")
def contract_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract files written, listed and read again: a deal's articles and their length."""
    came = _contract_files(spark, sf_dir)
    read = files.contracts(spark, came, _deal_of_folder())
    articles = F.from_json(F.get_json_object("raw", "$.articles"), "array<struct<text:string>>")
    rows = read.join(files.listing(spark, came).where("length > 0").select("path"), "path", "left_semi")
    of_file = rows.select("deal_id", F.size(articles).cast("long").alias("n_articles"), F.aggregate(articles, F.lit(0).cast("long"), lambda n, a: n + F.length(a["text"])).alias("n_chars"))
    return of_file.groupBy("deal_id").agg(F.sum("n_articles").alias("n_articles"), F.sum("n_chars").alias("n_chars"))


def _shout(some: list[str]) -> list[str]:
    """Stands for a remote model: upper case, and a failure for requests in Spanish."""
    if any(x.startswith("es ") for x in some):
        raise ValueError("no Spanish")
    return [x.upper() for x in some]


@query(
    """with asked as (select doc_id, lang || ' ' || source as request from documents)
select doc_id, case when not starts_with(request, 'es ') then upper(request) end as reply, case when starts_with(request, 'es ') then 'ValueError: no Spanish' end as error from asked"""
)
def replies_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model replies to a request of every document, few of which differ; asked for twice, but sent once unless it fails."""
    requests = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "lang", "source").alias("request"))
    path = own_folder(spark)
    for _ in range(2):
        rows = calls.answer(requests, _shout, path, wait=0, buckets=8, tasks=4)
    return rows.select("doc_id", "reply", "error")


_PROPS = """case event_id % 5 when 0 then '{"k": ' || user_id || ', "name": "n' || event_id || '"}' when 1 then '{"k": ' || user_id || '.5, "ok": ' || (event_id % 2 = 0) || '}'
  when 2 then '{"k": "text", "list": [1, 2]}' when 3 then '{"name": ' || event_id || '}' else props end"""


@query(
    f"""with e as (select event_id, user_id, props, {_PROPS} as p from events)
select event_id, case event_id % 5 when 0 then user_id when 1 then user_id + 0.5 when 4 then (props->>'$.k')::double end::double as k, case when event_id % 5 = 1 then (event_id % 2 = 0)::varchar end as ok,
  case when event_id % 5 = 0 then 'n' || event_id end as name, case when event_id % 5 = 2 then '[1,2]' end as list,
  case event_id % 5 when 2 then 'k="text"' when 3 then 'name=' || event_id else '' end as rest from e"""
)
def metadata_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key of events' properties as a column, nobody having named them; what doesn't fit its column's type beside."""
    n, user = F.col("event_id"), F.col("user_id")
    made = F.when(n % 5 == 0, F.format_string('{"k": %d, "name": "n%d"}', user, n)).when(n % 5 == 1, F.format_string('{"k": %d.5, "ok": %s}', user, (n % 2 == 0).cast("string")))
    made = made.when(n % 5 == 2, F.lit('{"k": "text", "list": [1, 2]}')).when(n % 5 == 3, F.format_string('{"name": %d}', n)).otherwise(F.col("props"))
    rows = metadata.spread(table(spark, sf_dir, "events").select("event_id", made.alias("p")), "p").drop("p")
    rest = F.array_join(F.transform(F.map_entries("rest"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return rows.withColumn("rest", rest).withColumn("ok", F.col("ok").cast("string"))


def _books(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [[["Target Name", "CIK Number", "Balance"], *([c["name"], c["cik"], c["balance"]] for c in some)] for some in batch.column("rows").to_pylist()]
        yield pa.record_batch({"path": batch.column("path"), "content": pa.array([workbook.write(r) for r in rows], pa.binary())})


@query("select c_name as target_name, '000' || c_custkey as cik, case when c_acctbal >= 0 then c_acctbal end as balance from customer")
def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written into a workbook for each nation and segment, and read back from its cells; numbers keep their zeros."""
    cik = F.concat(F.lit("000"), F.col("c_custkey").cast("string"))
    row = F.struct(F.col("c_name").alias("name"), cik.alias("cik"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("string")).alias("balance"))
    books = table(spark, sf_dir, "customer").groupBy(F.concat_ws("/", "c_nationkey", "c_mktsegment").alias("path")).agg(F.collect_list(row).alias("rows"))
    cells = workbook.cells(books.mapInArrow(_books, "path string, content binary"))
    cell = lambda c: F.try_element_at("cells", F.lit(c))
    return cells.select(cell("Target Name").alias("target_name"), cell("CIK Number").alias("cik"), cell("Balance").cast("double").alias("balance"))
