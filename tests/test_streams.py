from __future__ import annotations

from clausewright.operators.flatten import flatten
from clausewright.sources import files as sources
from clausewright.streaming import streams


def test_log_stream_gives_what_the_batch_gives(spark, data, tmp_path):
    batch = spark.read.parquet(f"{data}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    run = streams.log_windows(stream, late="1 hour").writeStream.format("memory").queryName("log").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    wanted = {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in streams.log_windows(batch).collect()}
    assert wanted == {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in spark.table("log").collect()}


def test_states_stream(spark, data, tmp_path):
    batch = spark.read.parquet(f"{data}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    run = streams.last_states(stream, "user_id", "event_type", "ts").writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(tuple, spark.table("states").collect())) == sorted(map(tuple, streams.last_states(batch, "user_id", "event_type", "ts").collect()))


def test_contracts_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a_b.json").write_text('[{"title":"T","text":"x"},{"title":"U","text":"y"}]')
    run = streams.clauses_to(streams.contract_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    run.awaitTermination()
    wanted = sorted(map(tuple, flatten(sources.contracts(spark, str(tmp_path / "in"))).collect()))
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(tuple, got.collect())) == wanted
