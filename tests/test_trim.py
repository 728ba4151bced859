from __future__ import annotations

import json
import random

import pytest

from clausewright.operators import numbering, threads, trim, updates

SCHEMA = "deal_id string, chunk_index int, categories array<string>, clause_summary string, combined_text string, deal_name string, label string, original_text string, vector array<float>"


def size(r) -> int:
    return len(json.dumps({k: v for k, v in r.items() if v is not None}, ensure_ascii=False, separators=(",", ":")).encode())


def rows():
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice('ab"\\\n\t\x01é☃😀 ') for _ in range(n))
    out = [(f"d{k}", k, [text(rng.randrange(9)) for _ in range(rng.randrange(9))], text(rng.randrange(40)), text(rng.randrange(200)), text(5), text(9), text(rng.randrange(200)), [0.5]) for k in range(80)]
    return [*out, ("x" * 60, 1, ["c" * 30] * 40, None, None, None, None, "o", None), ("e", None, None, "", "", "", "", "", None), ("q", 2, [], '"' * 300, "z", "y", "x", "w", None)]


@pytest.mark.parametrize("limit", [150, 333, 40_960])
def test_records_keep_within_bytes_as_they_are_sent(spark, limit):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = [r.asDict() for r in trim.within(df, limit, apart=("vector",)).collect()]
    before = {r["deal_id"]: r for r in (dict(zip(df.columns, x, strict=True)) for x in rows())}
    assert all(list(r) == df.columns for r in got)
    for r in got:
        was = dict(before[r["deal_id"]])
        assert r.pop("vector") == was.pop("vector")
        assert size(r) <= limit and (r["deal_id"], r["chunk_index"]) == (was["deal_id"], was["chunk_index"])
        if size(was) <= limit:
            assert r == was
            continue
        # what is cut is a beginning, and one more character or element would be too much
        sofar = {c: r[c] for c in ("deal_id", "chunk_index")}
        for c in trim.ORDER:
            sofar[c] = r[c]
            if r[c] != was[c]:
                assert r[c] is None or was[c][: len(r[c])] == r[c]
                assert size(sofar | {c: was[c][: len(r[c]) + 1] if r[c] is not None else type(was[c])()}) > limit


def test_ids_that_are_too_long_fail(spark):
    with pytest.raises(Exception, match="ids take more than 100 bytes"):
        trim.within(spark.createDataFrame([("x" * 200, "t")], "deal_id string, combined_text string"), 100).collect()


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([("k", 1, "a", 5, 6, 7, 8)], "key string, ord int, text string, room int, n int, range int, before int")
    assert trim.trim(df, 10, ("text",)).columns == df.columns and trim.within(df.withColumnRenamed("text", "label"), 100).columns == [c if c != "text" else "label" for c in df.columns]
    assert numbering.number_within(df, "key", "ord").drop("chunk_index").collect() == df.collect()
    assert threads.pages(df, 3, thread_col="key", at="ord").drop("place").collect() == df.collect()
    new = spark.createDataFrame([("k", 2)], "new string, last int")
    assert updates.upsert(new, new, "new").collect() == new.collect()


def test_several_updates_of_a_key_are_one(spark):
    stored = spark.createDataFrame([(1, "a", 1, {"x": 1, "y": 1}), (2, "b", 2, None)], "k long, v string, w long, m map<string,long>")
    new = spark.createDataFrame([(1, "first", None, {"x": 5}, 1), (1, None, 7, {"z": 3}, 2), (1, "last", None, {"x": 6}, 3), (2, None, None, {"q": 1}, 1)], "k long, v string, w long, m map<string,long>, at int")
    got = sorted((r.k, r.v, r.w, r.m) for r in updates.patch(stored, new, "k", "m", ["at"]).collect())
    assert got == [(1, "last", 7, {"x": 6, "y": 1, "z": 3}), (2, "b", 2, {"q": 1})]
    assert updates.patch(stored, new.drop("at"), "k", "m").count() == 2


def test_statuses_of_one_time_count_by_their_order(spark):
    log = spark.createDataFrame([("a", "PENDING", 1), ("a", "COMPLETED", 1), ("b", "PROCESSING", 2), ("b", "PENDING", 2), ("b", "odd", 3), ("c", "FAILED", 5), ("c", "COMPLETED", 4)], "deal_id string, status string, updated_at int")
    assert sorted((r.deal_id, r.status) for r in updates.current_status(log).collect()) == [("a", "COMPLETED"), ("b", "PROCESSING"), ("c", "FAILED")]
