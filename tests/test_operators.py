from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausewright.functions import prompts, replies, text
from clausewright.operators import backends, context, deals, fields, numbering, search, threads, trim, updates
from clausewright.plans import retrieval
from clausewright.sources import files as sources


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


@pytest.mark.parametrize(
    ("path", "name"),
    [("https://h/p/acme_TARGET_2024-01-02.json", "Acme Target"), ("x/a__b.json", "A  B"), ("x/foo bar_baz.json", "Foo bar Baz")],
)
def test_deal_name(spark, path, name):
    assert one(spark, text.deal_name(F.lit(path))) == name


def test_clean(spark):
    assert one(spark, text.clean(F.lit(" “a” ‘b’ – — \n"))) == "\"a\" 'b' - -"
    assert one(spark, text.clean(F.lit(None).cast("string"))) == ""
    assert one(spark, text.numbered_list(F.array(F.lit("a"), F.lit("b")))) == "1. a\n2. b"
    assert one(spark, text.joined_url("http://b/", F.lit("/x"))) == "http://b/x"
    assert one(spark, text.is_object_id(F.lit("0" * 24))) and not one(spark, text.is_object_id(F.lit(None).cast("string")))


@pytest.mark.parametrize(
    ("reply", "answer", "error"),
    [
        ('```json\n{"answer":"x"}\n```', "x", False), ('{"other":1}', "", False), ('junk "answer": "y" junk', "y", False),
        ("nothing", "", False), ("[1]", None, True), (None, "", False),
    ],
)
def test_answer(spark, reply, answer, error):
    got = one(spark, replies.answer(F.lit(reply).cast("string")))
    assert got.answer == answer and (got.error is not None) == error


@pytest.mark.parametrize(("reply", "wanted"), [("[1]", ([], "")), ("nope", ([], "")), ('```\n{"categories":["a"],"clause_summary":"s"}\n```', (["a"], "s")), ('{"categories":null}', ([], ""))])
def test_classification(spark, reply, wanted):
    got = one(spark, replies.classification(F.lit(reply)))
    assert (got.categories, got.clause_summary) == wanted


def test_whole_numbers(spark):
    rows = spark.createDataFrame([(t,) for t in ("12345678901", "-7", " 8 ", "+9", "1.5", "1e3", "x", "", None, "9" * 19)], "t string")
    assert [r.n for r in rows.select(replies.whole_number(F.col("t")).alias("n")).collect()] == [12345678901, -7, 8, 9, None, None, None, None, None, None]


def test_fences(spark):
    rows = spark.createDataFrame([("```json\n{}\n```",), ("a ``` b ``` c",), ("```one",), ("none",), ("``````",)], "t string")
    assert [r.x for r in rows.select(replies.unfenced(F.col("t")).alias("x")).collect()] == ["{}", "b", "```one", "none", "``````"]


def test_prompts_hold_what_was_said_before(spark):
    history = F.array(F.struct(F.lit("assistant").alias("role"), F.lit("b").alias("content")), F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("content")))
    told = one(spark, prompts.chat(F.lit("q"), F.lit("c"), history))
    assert [m.role for m in told] == ["system", "assistant", "user", "user"] and told[0].content.endswith("\n\nc") and told[-1].content == "q"
    assert len(one(spark, prompts.chat(F.lit("q"), F.lit("c"), F.lit(None).cast("array<struct<role:string,content:string>>")))) == 2
    assert one(spark, prompts.summary(F.lit("c")))[0].content.endswith("c")


def test_threads_of_equal_times_go_by_id(spark):
    rows = [("t", 1, k, "user" if k < 3 else "assistant", f"m{k}") for k in (3, 1, 2, 0)] + [("u", 1, 9, "assistant", "x")]
    m = spark.createDataFrame(rows, "thread_id string, created_at int, message_id int, role string, content string").repartition(3)
    assert [r.message_id for r in threads.page(m, "t", 2).collect()] == [2, 3]
    assert [r.message_id for r in threads.pages(m, 3, "asc").where("thread_id = 't'").orderBy("place").collect()] == [2, 1, 0]
    (row,) = threads.asked(m).collect()
    assert (row.thread_id, row.question, [h.content for h in row.history]) == ("t", "m2", ["m0", "m1"])
    assert [h.content for h in threads.asked(m, limit=1).head().history] == ["m1"]
    assert retrieval.thread_replies(m, backends.TopLines(1)).head().answer == "m1"


def test_answers_know_what_was_said_before(spark):
    found = spark.createDataFrame([(1, "q", 1, "l", ["c"], "text"), (2, "r", 1, "l", ["c"], "other")], "query_id long, query string, rank int, label string, categories array<string>, combined_text string")
    said = spark.createDataFrame([(1, [("user", "before")])], "query_id long, history array<struct<role:string,content:string>>")

    class Echo:
        def answer(self, question, context, history=None):
            return F.concat(question, F.coalesce(F.array_join(history["content"], ","), F.lit("")))

    assert {r.query_id: r.answer for r in retrieval.answers(found, Echo(), said).collect()} == {1: "qbefore", 2: "r"}


def test_search_by_text_ids_and_values_with_many_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(search, "VECTORS", 7)
    monkeypatch.setattr(search, "QUERIES", 3)
    x = np.random.default_rng(1).normal(size=(120, 5))
    rows = [(f"v{i:03}", "hot" if i % 4 else f"k{i % 3}", r.tolist()) for i, r in enumerate(x)]
    v = spark.createDataFrame(rows, "name string, deal string, embedding array<double>").repartition(4)
    q = v.where("name like '%0'").withColumnRenamed("name", "q")
    got = {(r.query_id, r["rank"]): r.vec_id for r in search.top_k(v, q, 4, "name", same="deal", query_col="q").collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 120, 10):
        score = np.round(unit[i] @ unit.T, 9)
        own = sorted((j for j in range(120) if rows[j][1] == rows[i][1]), key=lambda j: (-score[j], j))[:4]
        assert [got[rows[i][0], k + 1] for k in range(len(own))] == [rows[j][0] for j in own]


def test_metadata_and_decoded(spark):
    assert one(spark, replies.metadata(F.lit('text {"a": 1} more'))) == '{"a": 1}'
    assert one(spark, replies.metadata(F.lit("none"))) is None
    assert one(spark, replies.decoded(F.lit('[1]'))) == "[1]" and one(spark, replies.decoded(F.lit('a"b'))) == '"a\\"b"'


def test_search_filters_ties_and_zero_vectors(spark):
    rows = [(0, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (2, [0.0, 0.0], "a"), (3, [1.0, 0.0], "b"), (4, [2.0, 0.0], "a"), (5, None, "a")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, deal string")
    q = v.where("vec_id = 0")
    assert [(r.vec_id, r.cosine) for r in search.top_k(v, q, 5).orderBy("rank").collect()] == [(0, 1.0), (3, 1.0), (4, 1.0), (1, 0.0), (2, None)]
    own = [r.vec_id for r in search.top_k(v, q, 2, same="deal").orderBy("rank").collect()]
    assert own == [0, 4]
    assert search.top_k(v, q.limit(0), 2).count() == 0 and search.top_k(v.limit(0), q, 2).count() == 0
    assert one(spark, search.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert search.in_deal(v, None, "deal").count() == 6 and search.in_deal(v, "b", "deal").count() == 1


def test_blocks_of_search_agree_with_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(search, "VECTORS", 7)
    monkeypatch.setattr(search, "QUERIES", 3)
    x = np.random.default_rng(0).normal(size=(60, 5))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {(r.query_id, r["rank"]): r.vec_id for r in search.top_k(v, v.where("vec_id % 6 = 0"), 4).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 60, 6):
        best = np.argsort(-np.round(unit[q] @ unit.T, 9), kind="stable")[:4]
        assert [got[q, k + 1] for k in range(4)] == best.tolist()


def test_categories(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id int, categories array<string>")
    assert [r.id for r in search.in_categories(df, ["b", "c"]).collect()] == [1]
    assert search.in_categories(df, []).count() == 0


def test_first_of(spark):
    df = spark.createDataFrame([("q1", 1, "a"), ("q1", 2, "b"), ("q2", 1, "b"), ("q2", 2, "c")], "q string, n int, t string")
    once = context.first_of(df, ["t"], ["q", "n"])
    assert sorted((r.q, r.t) for r in once.collect()) == [("q1", "a"), ("q1", "b"), ("q2", "c")]
    assert sorted(map(tuple, context.first_of(once, ["t"], ["q", "n"]).collect())) == sorted(map(tuple, once.collect()))


def test_context_text(spark):
    df = spark.createDataFrame([(2, "L2", "", "y", "q"), (1, "L1", "c", "x", None)], "n int, l string, c string, x string, q string")
    got = df.agg(context.context_block(F.col("n"), F.col("l"), F.col("c"), F.col("x"), F.col("q")).alias("b")).head().b
    assert got == "[1] L1 [Category: c]: x\n\n[2] L2 (Related to: q): y\n\n"
    assert df.agg(context.joined_texts(F.col("n"), F.col("x"), "|").alias("b")).head().b == "x|y"


def test_numbering(spark):
    rows = [(i * 7 % 100, "hot" if i % 3 else f"k{i % 5}") for i in range(100)]
    got = numbering.number_within(spark.createDataFrame(rows, "id long, k string").repartition(5), "k", "id").collect()
    by_key: dict[str, list] = {}
    for r in sorted(got):
        by_key.setdefault(r.k, []).append(r.chunk_index)
    assert all(v == list(range(len(v))) for v in by_key.values()) and len(got) == 100


def test_blocks_begin_where_their_first_row_does(spark, tmp_path):
    import random

    random.seed(2)
    for repeats in (0, 3):
        rows = [(i, k) for k, n in (("a", 300), ("b", 35), ("c", 1), (None, 14)) for i in random.sample(range(3000), n) for _ in range(1 + repeats * (i % 4 == 0))]
        got = numbering.block_within(spark.createDataFrame(rows, "id long, key string").repartition(5), "key", "id", 7, str(tmp_path / f"b{repeats}")).collect()
        assert sorted(map(str, rows)) == sorted(str((r.id, r.key)) for r in got)
        for k in ("a", "b", "c", None):
            blocks: dict[int, list[int]] = {}
            for i, first in sorted((r.id, r.first) for r in got if r.key == k):
                blocks.setdefault(first, []).append(i)
            n = 0
            for first, ids in blocks.items():  # gapless, in order, and rows of one id together
                assert first == n and len(ids) <= 7 + 2 * repeats
                n += len(ids)
            assert sorted(i for ids in blocks.values() for i in ids) == sorted(i for i, x in rows if x == k)
            assert sum(len(set(ids)) for ids in blocks.values()) == len({i for i, x in rows if x == k})
            if not repeats:
                assert all(len(ids) == 7 for ids in list(blocks.values())[:-1])



def test_updates(spark):
    stored = spark.createDataFrame([("d_0", 1, {"a": "1", "b": "2"}), ("d_1", 2, None)], "id string, v int, extra map<string,string>")
    new = spark.createDataFrame([("d_0", 5, None), ("d_2", 6, None)], "id string, v int, extra map<string,string>")
    once = updates.upsert(stored, new, "id")
    assert sorted((r.id, r.v) for r in once.collect()) == [("d_0", 5), ("d_1", 2), ("d_2", 6)]
    assert sorted(map(str, updates.upsert(once, new, "id").collect())) == sorted(map(str, once.collect()))
    change = spark.createDataFrame([("d_0", {"b": "3", "c": "4"})], "id string, extra map<string,string>")
    got = {r.id: (r.v, r.extra) for r in updates.patch(stored, change, "id", "extra").collect()}
    assert got == {"d_0": (1, {"a": "1", "b": "3", "c": "4"}), "d_1": (2, {})}
    assert [r.id for r in updates.deleted(stored, change, "id").collect()] == ["d_1"]
    log = spark.createDataFrame([("d", "PENDING", 1), ("d", "COMPLETED", 3), ("d", "PROCESSING", 2), ("d", "odd", 9)], "deal_id string, status string, updated_at int")
    assert updates.current_status(log).head().status == "COMPLETED"
    with pytest.raises(Exception, match="dimension 2"):
        updates.checked_vectors(spark.createDataFrame([([1.0, 2.0],)], "embedding array<double>"), 3).collect()


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="aé☃😀 ", max_size=12), st.text(alphabet="bß€", max_size=12)), min_size=1, max_size=8), st.integers(0, 30))
def test_trim(spark, pairs, limit):
    df = spark.createDataFrame([(i, "id", c, o) for i, (c, o) in enumerate(pairs)], "n int, deal_id string, combined_text string, original_text string")
    for r in trim.trim(df, limit, fixed=("deal_id",)).collect():
        c, o = pairs[r.n]
        room = max(limit - 2, 0)
        wanted = c.encode()[:room].decode(errors="ignore")
        assert r.deal_id == "id" and r.combined_text == wanted
        assert r.original_text == o.encode()[: room - len(wanted.encode())].decode(errors="ignore")


def test_deals(spark):
    rows = spark.createDataFrame([(" ", "1"), ("A", "Not Found"), ("nan", "Not Found"), ("A", "0000123"), (None, None)], "n string, c string")
    assert [r.x for r in rows.select(deals.reason(F.col("n"), F.col("c")).alias("x")).collect()] == [deals.NO_NAME, deals.NO_CIK, deals.NO_NAME, None, deals.NO_NAME]
    nums = spark.createDataFrame([(float("nan"),), (math.inf,), (-math.inf,), (1.5,), (None,)], "v double")
    assert [r.x for r in nums.select(deals.finite(F.col("v")).alias("x")).collect()] == [None, None, None, 1.5, None]
    results = spark.createDataFrame([("r", "d2", "u", "success", ""), ("r", "d1", "u", "failed", "why")], "k string, deal_id string, file_url string, status string, message string")
    got = {r.k: r for r in deals.roll_up(spark.createDataFrame([("r",), ("s",)], "k string"), results, "k").collect()}
    assert got["r"].status and [f.message for f in got["r"].processed_files] == ["why", ""] and not got["s"].status
    response = F.from_json(F.lit('[{"file_url":"http://a","deal_id":"1"},{"file_url":"ftp://a","deal_id":"2"},{"file_url":"http://b"}]'), "array<struct<file_url:string,deal_id:string>>")
    assert len(one(spark, deals.usable(response))) == 1


def test_pages(spark):
    m = spark.createDataFrame([("t", i) for i in range(1, 6)], "thread_id string, created_at int")
    assert [r.created_at for r in threads.page(m, "t", 2).collect()] == [4, 5]
    assert [r.created_at for r in threads.page(m, "t", 2, "asc").collect()] == [2, 1]
    assert [r.created_at for r in threads.pages(m, 2).orderBy("place").collect()] == [4, 5]
    assert [r.created_at for r in threads.after_send(m, "t").collect()] == [5, 4, 3, 2, 1]
    parts = F.from_json(F.lit('[{"type":"image"},{"type":"text","text":"x"}]'), "array<struct<type:string,text:string>>")
    assert one(spark, threads.content(parts)) == "x" and one(spark, threads.content(F.slice(parts, 1, 1))) == ""


def test_fields(spark):
    raw = '{"B":[{"field_name":"f","instructions":"price","category_mapping":[{"category":"x"},{"category":"y"}]},{"field_name":"g","instructions":"i","category_mapping":[]}],"A":[{"field_name":"h","instructions":"i"}]}'
    schema = fields.read_schema(spark.createDataFrame([(raw,)], "raw string"))
    assert [(r.section, r.field_name) for r in schema.orderBy("section_ord", "field_ord").collect()] == [("B", "f"), ("B", "g"), ("A", "h")]
    chunks = spark.createDataFrame([("d", 0, "The price is 1. Else.", ["x", "y"]), ("d", 1, "The price is 1. Else.", ["x"]), ("d", 2, "No", ["z"])], "deal_id string, chunk_index int, text string, categories array<string>")
    got = {r.field_name: r for r in fields.extract(schema, chunks, chunks, backends.FirstSentence()).collect()}
    assert got["f"].answer == "The price is 1" and got["g"].error and got["h"].error is None
    assert got["h"].answer == backends.FirstSentence().nothing
    sections = fields.as_sections(fields.extract(schema, chunks, chunks, backends.FirstSentence())).head().schema_results
    assert [f.field_name for f in sections["B"]] == ["f", "g"]


def test_question_to_answer(spark):
    raw = '[{"article":"I","title":"Price","text":"The price is one dollar"},{"article":"II","title":"Term","text":"The term ends in May"},{"article":"III","title":"None"}]'
    files = spark.createDataFrame([("d", "h/a_b.json", raw), ("e", "h/c.json", raw)], "deal_id string, path string, raw string")
    embedding, keywords = backends.HashedWords(), backends.Keywords({"money": ["dollar"]})
    vectors = retrieval.vectors_of(files, keywords, embedding)
    assert sorted(r.chunk_id for r in vectors.collect()) == ["d_0", "d_1", "e_0", "e_1"]
    asked = spark.createDataFrame([(1, "what is the price", "d"), (2, "when does the term end", "d")], "query_id long, query string, deal_id string")
    found = retrieval.retrieve(vectors, asked, embedding, 2)
    assert {r.deal_id for r in found.collect()} == {"d"}
    assert found.where("query_id = 1 and rank = 1").head().categories == ["money"]
    assert "price" in retrieval.answers(found, backends.TopLines()).where("query_id = 1").head().answer
    block = retrieval.summaries(found, backends.TopLines()).head()
    assert block.context.count("The price is one dollar") == 1


def test_contract_files_are_read_and_listed(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a_b.json").write_text('[{"title":"T",\n"text":"x"}]')
    (tmp_path / "deep" / "c.json").write_text("[]")
    (tmp_path / "d.txt").write_text("no contract")
    assert sorted((r.deal_id, r.raw) for r in sources.contracts(spark, str(tmp_path)).collect()) == [("a_b", '[{"title":"T",\n"text":"x"}]'), ("c", "[]")]
    assert sorted(r.length for r in sources.listing(spark, str(tmp_path)).collect()) == [2, 27]


def test_sheet_keeps_zeros(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Target Name,CIK Number,More\nA,0000123,x\n")
    row = sources.sheet(spark, str(tmp_path / "s.csv")).head()
    assert (row.target_name, row.cik, row.extra) == ("A", "0000123", {"More": "x"})


def test_clause_tables_are_written_over(spark, tmp_path):
    df = spark.createDataFrame([("d", 0, "x")], "deal_id string, chunk_index int, text string")
    for _ in range(2):
        sources.write_clauses(df, str(tmp_path / "c"))
        sources.append(df, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1 and spark.read.parquet(str(tmp_path / "l")).count() == 2
