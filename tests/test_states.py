from __future__ import annotations

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from clausewright.operators.backends import HashedWords, Keywords
from clausewright.plans import stores
from clausewright.plans.retrieval import vectors_of
from clausewright.sources import files as sources
from clausewright.streaming import ingest, states

AT = dt.datetime(2024, 1, 1)
SCHEMA = "job string, status string, at timestamp"


def put(spark, path, rows, name):
    spark.createDataFrame([(j, s, AT + dt.timedelta(seconds=t)) for j, s, t in rows], SCHEMA).coalesce(1).write.parquet(str(path / name))


def start(spark, tmp_path, seconds=None):
    log = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    return states.steps_to(log, str(tmp_path / "out"), str(tmp_path / "state"), "job", seconds=seconds)


def run(spark, tmp_path):
    assert start(spark, tmp_path).awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def test_jobs_go_from_state_to_state(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    put(spark, tmp_path / "in", [("a", "PENDING", 1), ("a", "PROCESSING", 2), ("b", "COMPLETED", 1), ("b", "PENDING", 1), ("c", "odd", 1), ("d", "PROCESSING", 5), ("d", "PENDING", 5), ("d", "COMPLETED", 5)], "1")
    first = run(spark, tmp_path)
    assert first.count() == 8
    put(spark, tmp_path / "in", [("a", "COMPLETED", 3), ("a", "FAILED", 4), ("b", "PROCESSING", 0), ("b", "PROCESSING", 2), (None, "PENDING", 1)], "2")
    found = run(spark, tmp_path)
    got = sorted((r.job, r.status, r.reason) for r in states.rejects(found).collect())
    assert got == [("a", "FAILED", states.ORDER), ("b", "COMPLETED", states.ORDER), ("b", "PROCESSING", states.OLD), ("c", "odd", states.UNKNOWN)]
    jobs = sorted((r.job, r.status, r.n_accepted, r.n_refused) for r in states.jobs(found, "job").collect())
    assert jobs == [("a", "COMPLETED", 3, 1), ("b", "PROCESSING", 2, 2), ("c", None, 0, 1), ("d", "COMPLETED", 3, 0)]
    # started again, it repeats nothing
    assert run(spark, tmp_path).count() == 12 and sorted(r.place for r in found.where("job = 'a'").collect()) == [1, 2, 3, 4]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_a_job_that_hangs_fails(spark, tmp_path):
    put(spark, tmp_path / "in", [("slow", "PENDING", 1), ("slow", "PROCESSING", 2), ("done", "PENDING", 1), ("done", "PROCESSING", 2), ("done", "FAILED", 3)], "1")
    stream, since = start(spark, tmp_path, 0.5), time.time()
    try:
        found = None
        while time.time() - since < 90 and (found is None or found.where(f"reason = '{states.HUNG}'").isEmpty()):
            time.sleep(1)
            found = spark.read.schema(f"job string, {states.STEP}").parquet(str(tmp_path / "out")) if list((tmp_path / "out").glob("*/_SUCCESS")) else None
    finally:
        stream.stop()
    assert found is not None and [(r.job, r.status) for r in found.where(f"reason = '{states.HUNG}'").collect()] == [("slow", "FAILED")]
    assert {r.job: r.status for r in states.jobs(found, "job").collect()} == {"slow": "FAILED", "done": "FAILED"}


CLASSIFIER, EMBEDDING = Keywords({"price": ["price"]}), HashedWords(8)


def plain(rows):
    return sorted((r.chunk_id, tuple(r.embedding), r.label, r.combined_text, tuple(r.categories)) for r in rows.collect())


def take_in(spark, tmp_path, files=1):
    return ingest.ingest(ingest.contract_stream(spark, str(tmp_path / "in"), files=files), str(tmp_path / "v"), str(tmp_path / "state"), CLASSIFIER, EMBEDDING, buckets=4)


def test_files_are_taken_in_once_even_if_killed(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for k in range(5):
        (tmp_path / "in" / f"deal_{k}.json").write_text(f'[{{"title":"T","text":"the price of {k}"}},{{"title":"U","text":""}},{{"title":"V","text":"words {k}"}}]')
    done: list[int] = []
    take = ingest.ingest_batch

    def killed(files, number, *args):
        take(files, number, *args)
        done.append(number)
        if len(done) == 2:  # after the table has the rows and the ledger the number, before the stream knows
            raise RuntimeError("killed")

    monkeypatch.setattr(ingest, "ingest_batch", killed)
    with pytest.raises(Exception, match="killed"):
        take_in(spark, tmp_path).awaitTermination(120)
    monkeypatch.setattr(ingest, "ingest_batch", lambda *a: done.append(take(*a)))
    assert take_in(spark, tmp_path).awaitTermination(120)
    assert done == [0, 1, False, True, True, True]
    wanted = vectors_of(sources.contracts(spark, str(tmp_path / "in")), CLASSIFIER, EMBEDDING)
    table = ingest.vector_table(spark, str(tmp_path / "v"))
    assert plain(table.rows()) == plain(wanted) and table.rows().count() == 10
    assert sorted((r.number, r.files, r.rows) for r in ingest.ledger(spark, str(tmp_path / "v")).collect()) == [(k, 1, 2) for k in range(5)]
    assert ingest.forget(spark, str(tmp_path / "v"), spark.createDataFrame([("deal_1",)], "deal_id string")) > 0
    assert ingest.vector_table(spark, str(tmp_path / "v")).rows().count() == 8


def test_a_batch_that_died_within_is_taken_in_again(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"title":"T","text":"x"}')
    monkeypatch.setattr(ingest.KeyedTable, "_apply", lambda self, at: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(Exception, match="killed"):
        take_in(spark, tmp_path).awaitTermination(120)
    monkeypatch.undo()
    assert take_in(spark, tmp_path).awaitTermination(120)
    assert [r.chunk_id for r in ingest.vector_table(spark, str(tmp_path / "v")).rows().collect()] == ["a_0"]


def test_a_deal_in_several_files_is_numbered_on(spark, tmp_path):
    for name, raw in (("first=0", '[{"title":"T","text":"a"},{"title":"T","text":" "},{"title":"T","text":"b"}]'), ("first=2", '{"title":"T","text":"c"}')):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "x.json").write_text(raw)
    first = F.regexp_extract("path", "/first=([0-9]+)/", 1).cast("int")
    stream = ingest.contract_stream(spark, str(tmp_path / "in"), F.lit("d"), 1, first)
    assert ingest.ingest(stream, str(tmp_path / "v"), str(tmp_path / "state"), CLASSIFIER, EMBEDDING, buckets=4).awaitTermination(120)
    rows = ingest.vector_table(spark, str(tmp_path / "v")).rows()
    assert sorted((r.chunk_id, r.chunk_index, r.combined_text) for r in rows.collect()) == [("d_0", 0, "a"), ("d_1", 1, "b"), ("d_2", 2, "c")]


def test_contract_files_have_few_articles(spark, data, monkeypatch):
    monkeypatch.setattr(stores, "ARTICLES", 7)
    read = sources.contracts(spark, stores._contract_files(spark, data), stores._deal_of_folder())
    n = [len(json.loads(r.raw)["articles"]) for r in read.collect()]
    assert max(n) == 7 and sum(n) == spark.read.parquet(f"{data}/documents.parquet").count()


def test_packed_files_are_taken_in(spark, tmp_path):
    import gzip

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json.gz").write_bytes(gzip.compress(b'[{"title":"T","text":"x"},{"title":"T","text":"y"}]'))
    (tmp_path / "in" / "b.json").write_text('{"title":"T","text":"z"}')
    (tmp_path / "in" / "c.json").write_text('{"title":"T","text":" "}')
    assert take_in(spark, tmp_path).awaitTermination(120)
    rows = ingest.vector_table(spark, str(tmp_path / "v")).rows().collect()
    assert sorted((r.chunk_id, r.deal_name, r.combined_text) for r in rows) == [("a_0", "A", "x"), ("a_1", "A", "y"), ("b_0", "B", "z")]
    assert sorted((r.deal_id) for r in sources.contracts(spark, str(tmp_path / "in")).collect()) == ["a", "b", "c"]
    assert sorted(r["rows"] for r in ingest.ledger(spark, str(tmp_path / "v")).collect()) == [0, 1, 2]


def test_batches_of_new_clauses_leave_what_is_there(spark, data, monkeypatch, tmp_path):
    """Disk: a batch's rows are staged once, and the table isn't written again."""
    monkeypatch.setattr(stores, "ARTICLES", 7)
    staged, before, apply = [], [], ingest.KeyedTable._apply
    size = lambda at: sum(p.stat().st_size for p in at.rglob("part-*") if p.is_file())

    def seen(self, at):
        there = {str(p) for p in (tmp_path / "v").glob("bucket=*/part-*")}
        staged.append(size(tmp_path / "v" / "_staged"))
        before.append(there)
        apply(self, at)
        assert there <= {str(p) for p in (tmp_path / "v").glob("bucket=*/part-*")}

    monkeypatch.setattr(ingest.KeyedTable, "_apply", seen)
    stream = ingest.contract_stream(spark, stores._contract_files(spark, data), stores._deal_of_folder(), 8, stores._first_of_folder())
    assert ingest.ingest(stream, str(tmp_path / "v"), str(tmp_path / "state"), CLASSIFIER, EMBEDDING, buckets=2).awaitTermination(300)
    table = sum(p.stat().st_size for p in (tmp_path / "v").glob("bucket=*/part-*"))
    assert len(before) > 1 and all(before[1:]) and sum(staged) < 1.2 * table + 10_000 * len(staged)


def test_shuffles_are_dropped_only_where_asked(spark):
    from clausewright.session import shuffles_dropped

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with shuffles_dropped(spark):
        assert spark.conf.get(name) == "true" and spark.range(9).groupBy((F.col("id") % 2).alias("k")).count().count() == 2
    assert spark.conf.get(name) == before
