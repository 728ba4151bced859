"""Further registered queries: replies, prompts, threads, updates and answers over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts, replies, text
from ..operators import backends, deals, fields, flatten, search, threads, updates
from ..schemas import STATUSES
from . import retrieval
from .catalogue import _CONTEXTS, _SCORED, _TAGS, SCHEMA, _contexts, _tagged, _vectors, query, table


def by_remainder(number: Column, kinds: list[Column]) -> Column:
    """One of several columns by the remainder of a number."""
    out = kinds[-1]
    for k, kind in enumerate(kinds[:-1]):
        out = F.when(number % len(kinds) == k, kind).otherwise(out)
    return out


def filled(template: str, value: Column) -> Column:
    return F.replace(F.lit(template), F.lit("%s"), value.cast("string"))


@query(
    """with new as (select o_custkey as c_custkey, 'order ' || o_orderkey as c_name, o_orderkey as version from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1)
select coalesce(n.c_custkey, c.c_custkey) as c_custkey, coalesce(n.c_name, c.c_name) as c_name, coalesce(n.version, 0) as version from customer c full join new n on n.c_custkey = c.c_custkey"""
)
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, with a customer's highest order written over them."""
    stored = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit(0).cast("long").alias("version"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("c_name"), F.col("o_orderkey").alias("version"))
    return updates.upsert(stored, new, "c_custkey", ["version"])


_STATES = [*STATUSES, "odd"]


@query(f"select user_id, {_STATES}[event_id % 5 + 1] as status from events where event_id % 5 < 4 qualify row_number() over (partition by user_id order by ts desc, status desc) = 1")
def current_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last known status of every user in a log of statuses, some of them unknown."""
    status = by_remainder(F.col("event_id"), [F.lit(s) for s in _STATES])
    log = table(spark, sf_dir, "events").select("user_id", status.alias("status"), "ts")
    return updates.current_status(log, "user_id", "ts").select("user_id", "status")


_CLASSIFIED = ['```json\n{"categories": ["a", "b%s"], "clause_summary": "s"}\n```', "[%s]", "nope %s", '{"categories": null, "clause_summary": "t%s"}']


@query(
    """select event_id, case event_id % 4 when 0 then 'a,b' || event_id else '' end as categories,
  case event_id % 4 when 0 then 's' when 3 then 't' || event_id else '' end as clause_summary from events"""
)
def parse_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories and summary out of replies of four kinds."""
    reply = by_remainder(F.col("event_id"), [filled(r, F.col("event_id")) for r in _CLASSIFIED])
    found = table(spark, sf_dir, "events").select("event_id", replies.classification(reply).alias("c"))
    return found.select("event_id", F.array_join("c.categories", ",").alias("categories"), "c.clause_summary")


_METADATA = ['{"c": %s}', '```json\n{"b": %s}\n```', 'text {"a": %s} more', "none %s"]


@query(
    """select event_id, case event_id % 4 when 0 then '{"c": ' || event_id || '}' when 1 then '{"b": ' || event_id || '}' when 2 then '{"a": ' || event_id || '}' end as metadata,
  case event_id % 2 when 0 then '[' || event_id || ']' else '"a\\"' || event_id || '"' end as decoded from events"""
)
def parse_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects out of replies of four kinds, and values that are JSON or become it."""
    n = F.col("event_id")
    value = by_remainder(n, [filled("[%s]", n), filled('a"%s', n)])
    return table(spark, sf_dir, "events").select("event_id", replies.metadata(by_remainder(n, [filled(r, n) for r in _METADATA])).alias("metadata"), replies.decoded(value).alias("decoded"))


@query("select event_id, text, coalesce(try_cast(nullif(text, '') as bigint)::varchar, 'none') as number from (select event_id, case event_id % 4 when 0 then '-' || event_id when 1 then '12345678901' || event_id when 2 then 'x' || event_id else '' end as text from events)")
def whole_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as whole numbers, long and negative ones among them."""
    n = F.col("event_id")
    given = by_remainder(n, [filled("-%s", n), filled("12345678901%s", n), filled("x%s", n), F.lit("")])
    return table(spark, sf_dir, "events").select("event_id", given.alias("text"), F.coalesce(replies.whole_number(given).cast("string"), F.lit("none")).alias("number"))


@query("select page_id, url as file_url, page_id::varchar as deal_id from pages where starts_with(url, 'http')")
def usable_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of what a service returned for each page, the items that can be fetched and belong to a deal."""
    item = lambda url, deal: F.struct(url.alias("file_url"), deal.alias("deal_id"))
    deal = F.col("page_id").cast("string")
    response = F.array(item(F.col("url"), deal), item(F.lit("ftp://h/x"), deal), item(F.col("url"), F.lit("")), item(F.lit(None).cast("string"), deal))
    return table(spark, sf_dir, "pages").select("page_id", F.inline(deals.usable(response)))


@query("select conv_id, turn, case when turn % 2 = 0 then text else '' end as content from conversations")
def message_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first text part of messages that have one, and of some that have only a picture."""
    part = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    picture = part("image", F.lit(None).cast("string"))
    parts = F.when(F.col("turn") % 2 == 0, F.array(picture, part("text", F.col("text")), part("text", F.lit("later")))).otherwise(F.array(picture))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", threads.content(parts).alias("content"))


@query("select conv_id, turn, role, text from conversations")
def page_after_send(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What threads show after a message was sent."""
    return threads.after_send(table(spark, sf_dir, "conversations"), None, "conv_id", "turn").select("conv_id", "turn", "role", "text")


@query(
    """with f as (select r_name, n_name, n_nationkey, row_number() over (partition by r_name order by n_name) as n from nation join region on r_regionkey = n_regionkey)
select r_name, string_agg(n || '. ' || n_name, chr(10) order by n) as numbered, string_agg('"' || n_name || '" : ' || n_nationkey, ' | ' order by n) as definitions,
  string_agg(n_name || ': ' || n_nationkey, chr(10) || chr(10) order by n) as descriptions, 'http://b/' || r_name as url from f group by r_name"""
)
def rendered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of each region as a numbered list, as definitions and as field descriptions."""
    met = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    key = F.col("n_nationkey").cast("string")
    rows = met.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("name"), key.alias("description"), F.col("n_name").alias("term"), key.alias("definition")))).alias("s"))
    return rows.select("r_name", text.numbered_list(F.col("s.name")).alias("numbered"), text.definition_list(F.col("s")).alias("definitions"), text.field_descriptions(F.col("s")).alias("descriptions"), text.joined_url("http://b/", F.concat(F.lit("/"), F.col("r_name"))).alias("url"))


@query("select doc_id, contains(text, ':') and contains(text, 'means') as is_definition, doc_id % 3 > 0 or doc_id % 2 > 0 as has_input from documents")
def text_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document looks like a definition; and whether at least one of two inputs is there."""
    one, other = F.when(F.col("doc_id") % 3 > 0, F.col("lang")), F.when(F.col("doc_id") % 2 > 0, F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", text.is_definition(F.col("text")).alias("is_definition"), deals.has_either(one, other).alias("has_input"))


@query(
    """with f as (select *, row_number() over (partition by r_regionkey order by n_nationkey) - 1 as k from nation join region on r_regionkey = n_regionkey where r_regionkey < 3)
select r_regionkey::int as section_ord, r_name as section, k::int as field_ord, n_name as field_name, 'Where is ' || n_name || '?' as instructions, r_name || ',' || n_nationkey as categories from f where k < 2"""
)
def first_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a schema of regions (sections) and nations (fields), written as one file's JSON, the first three sections and of each the first two fields."""
    met = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    category = lambda c: F.struct(c.cast("string").alias("category"))
    field = F.struct(F.col("n_name").alias("field_name"), F.concat(F.lit("Where is "), "n_name", F.lit("?")).alias("instructions"), F.array(category(F.col("r_name")), category(F.col("n_nationkey"))).alias("category_mapping"))
    sections = met.groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("o"), field.alias("f")))).alias("l"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("r_regionkey").alias("o"), F.concat(F.to_json(F.array("r_name")), F.lit(":"), F.to_json(F.transform("l", lambda x: x["f"]))).alias("t"))))
    text_ = F.array_join(F.transform(entries, lambda x: F.regexp_replace(x["t"], r'^\[("[^"]*")\]', "$1")), ",")
    rows = fields.read_schema(sections.agg(F.concat(F.lit("{"), text_, F.lit("}")).alias("raw")), 3, 2)
    return rows.select("section_ord", "section", "field_ord", "field_name", "instructions", F.array_join("categories", ",").alias("categories"))


@query("select doc_id, case when regexp_matches(text, '[^\\x09-\\x0D\\x1C-\\x20]') then 1.0 else 0.0 end::double as norm, 64 as dimension from documents")
def embedding_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and dimension of every document's hashed words."""
    rows = table(spark, sf_dir, "documents").select("doc_id", backends.HashedWords().embed(F.col("text")).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.select("doc_id", F.round(F.sqrt(square), 4).alias("norm"), F.size("v").alias("dimension"))


@query(f"select doc_id, array_to_string(list_filter({_TAGS}, lambda x: x in ('french', 'licensing')), ',') as categories from documents")
def strict_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of documents, those alone that a template has."""
    return _tagged(spark, sf_dir).select("doc_id", F.array_join(backends.strict(F.col("categories"), ["licensing", "french", "other"]), ",").alias("categories"))


_LINES = "array_to_string(list_filter(string_split({text}, chr(10)), lambda x: x <> '')[1:3], chr(10))"
_USED = "len(regexp_extract_all({text}, '[^ \\t\\n\\r\\f\\v]+'))"


@query(
    f"""with {_SCORED.format(on='true')}, placed as (select r.query_id, r.rank, d.source, d.lang, d.text from ranked r join documents d on d.doc_id = r.vec_id where rank <= 5),
blocks as (select query_id, string_agg('[' || place || '] ' || source || ' [Category: ' || lang || ']: ' || text || chr(10) || chr(10), '' order by place) as context
  from (select *, row_number() over (partition by query_id order by rank) as place from placed) group by query_id),
told as (select *, {_LINES.format(text='context')} as answer from blocks)
select query_id, answer, {_USED.format(text="'query ' || query_id || ' ' || context")} as prompt_tokens, {_USED.format(text='answer')} as completion_tokens from told"""
)
def question_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply to each query from the documents of its five nearest vectors, with the tokens used."""
    met = search.top_k(*_vectors(spark, sf_dir), k=5).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source", "lang"), "vec_id")
    found = met.select("query_id", F.concat(F.lit("query "), F.col("query_id").cast("string")).alias("query"), "rank", F.col("source").alias("label"), F.array("lang").alias("categories"), F.col("text").alias("combined_text"))
    return retrieval.answers(found, backends.TopLines()).select("query_id", "answer", "usage.prompt_tokens", "usage.completion_tokens")


@query(
    f"""{_CONTEXTS}, placed as (select *, row_number() over (partition by label order by query_id, rank) as place from once),
blocks as (select label, string_agg('[' || place || '] ' || source || ' (Related to: q' || query_id || '): ' || text || chr(10) || chr(10), '' order by place) as context from placed group by label)
select label, {_LINES.format(text='context')} as summary, md5(context) as context_md5 from blocks"""
)
def deal_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of each label from what was found for all its queries, each text once."""
    found = _contexts(spark, sf_dir).select(F.col("label").alias("deal_id"), "query_id", F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("query"), "rank", F.col("source").alias("label"), F.array().cast("array<string>").alias("categories"), F.col("text").alias("combined_text"))
    return retrieval.summaries(found, backends.TopLines()).select(F.col("deal_id").alias("label"), "summary", F.md5(F.col("context").cast("binary")).alias("context_md5"))


_ASKED = """with last as (select conv_id, max(turn) as turn from conversations where role = 'user' group by conv_id),
asked as (select c.conv_id, c.turn, c.text as question from conversations c join last using (conv_id, turn)),
said as (select a.conv_id, a.question, count(c.turn) as n, coalesce(string_agg(c.text, chr(10) order by c.turn desc), '') as newest, coalesce(string_agg(c.role || '=' || c.text, '|' order by c.turn), '') as history
  from asked a left join conversations c on c.conv_id = a.conv_id and c.turn < a.turn group by a.conv_id, a.question)"""


@query(f"{_ASKED} select conv_id, question, {_LINES.format(text='newest')} as answer from said")
def thread_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In every thread, a reply to the user's last message from the turns before it."""
    return retrieval.thread_replies(table(spark, sf_dir, "conversations"), backends.TopLines(), "conv_id", "turn", "text")


@query(f"{_ASKED} select conv_id, n + 2 as n_messages, md5({{chat}} || '||' || history || case when n > 0 then '|' else '' end || 'user=' || question) as prompt_md5 from said".replace("{chat}", "'system=" + prompts.CHAT.replace("'", "''") + "' || chr(10) || chr(10) || 'context'"))
def chat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model would be told in every thread: context, the turns before, the question."""
    met = threads.asked(table(spark, sf_dir, "conversations"), "conv_id", "turn", content_col="text")
    told = F.transform(prompts.chat(F.col("question"), F.lit("context"), F.col("history")), lambda m: F.concat(m["role"], F.lit("="), m["content"]))
    text_ = F.concat(told[0], F.lit("||"), F.array_join(F.slice(told, 2, 1 << 30), "|"))
    return met.select("conv_id", F.size(told).cast("long").alias("n_messages"), F.md5(text_.cast("binary")).alias("prompt_md5"))


_NL = " || chr(10) || chr(10) || "


def _quoted(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


@query(
    f"""select doc_id, md5('system=' || {_quoted(prompts.CLASSIFY)}{_NL}{_quoted(prompts.CLASSIFY_REPLY)} || '|user=Categories:'{_NL}'1. a' || chr(10) || '2. ' || lang{_NL}'Clause:'{_NL}text) as classify_md5,
  md5('system=' || {_quoted(prompts.EXTRACT)}{_NL}{_quoted(prompts.EXTRACT_REPLY)} || '|user=' || lang{_NL}'Clauses:'{_NL}text) as extract_md5 from documents"""
)
def clause_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model would be told to classify every document, and to find a fact in it."""
    told = lambda messages: F.md5(F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|").cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", told(prompts.classify(F.col("text"), F.array(F.lit("a"), F.col("lang")))).alias("classify_md5"), told(prompts.extract(F.col("lang"), F.col("text"))).alias("extract_md5"))


def _contract(shape: int) -> Column:
    """A document as a contract file of one of five shapes."""
    body, lang, source = F.col("text"), F.col("lang"), F.col("source")
    named = lambda **columns: F.struct(*[(c if isinstance(c, Column) else F.lit(c)).alias(k) for k, c in columns.items()])
    if shape == 0:
        return F.to_json(F.array(named(article="I", title=lang, text=body)))
    if shape == 1:
        return F.to_json(named(article="II", title=lang, text="A", sections=F.array(named(section="1.1", title=source, text=body))))
    if shape == 2:
        terms = F.array(named(term="Material Adverse Effect", definition=body), named(term="Person", definition=lang))
        return F.to_json(named(data=F.array(named(article="Definitions", definitions=terms))))
    if shape == 3:
        return F.concat(F.lit('{"z":'), F.to_json(named(title="Z", text=body)), F.lit(',"a":['), F.to_json(named(title="A", text=lang)), F.lit(',3],"m":5}'))
    defines = named(section="2", title="Definitions", definitions=F.array(named(term="Company Material Adverse Effect", definition=body)))
    return F.to_json(named(articles=F.array(named(article="II", text="", sections=F.array(defines)))))


@query(
    """with d as (select doc_id, lang, source, text as body, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') as clean from documents),
held as (
  select doc_id, 0 as place, 'ARTICLE I ' || lang as label, clean as original, clean as combined from d where doc_id % 5 = 0 and clean <> ''
  union all select doc_id, 0, 'ARTICLE II ' || lang || ' > Section 1.1 ' || source, body, 'A' || chr(10) || chr(10) || body from d where doc_id % 5 = 1
  union all select doc_id, 0, 'Definition > Material Adverse Effect', 'Material Adverse Effect ' || body, 'Material Adverse Effect ' || body from d where doc_id % 5 = 2
  union all select doc_id, 0, 'ARTICLE  Z', clean, clean from d where doc_id % 5 = 3 and clean <> ''
  union all select doc_id, 1, 'ARTICLE  A', lang, lang from d where doc_id % 5 = 3
  union all select doc_id, 0, 'ARTICLE II > Section 2 Definitions > Company Material Adverse Effect', 'Company Material Adverse Effect ' || body, 'Company Material Adverse Effect ' || body from d where doc_id % 5 = 4)
select r.doc_id::varchar as deal_id, (row_number() over (partition by r.doc_id order by place) - 1)::int as chunk_index, label, md5(original) as original_md5, md5(combined) as combined_md5,
  array_to_string(list_transform(string_split(d.source || '_TARGET', '_'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') as deal_name
from held r join d using (doc_id)"""
)
def flatten_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a contract file of one of five shapes, flattened to clauses."""
    rows = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("h/"), F.col("source"), F.lit("_TARGET_2024-01-02.json"))
    files = rows.select(F.col("doc_id").cast("string").alias("deal_id"), path.alias("path"), by_remainder(F.col("doc_id"), [_contract(k) for k in range(5)]).alias("raw"))
    digest = lambda c: F.md5(F.col(c).cast("binary"))
    return flatten.flatten(files).select("deal_id", "chunk_index", "label", digest("original_text").alias("original_md5"), digest("combined_text").alias("combined_md5"), "deal_name")
