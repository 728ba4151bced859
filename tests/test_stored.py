from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from clausewright.operators import search
from clausewright.operators.index import VectorIndex, recall
from clausewright.sources import files, stored
from clausewright.sources.stored import KeyedTable


def stamps(path) -> dict[str, int]:
    return {str(p): os.stat(p).st_mtime_ns for p in Path(path).glob("*=*/part-*")}


def table(spark, path, n=200, buckets=8):
    rows = spark.range(n).selectExpr("id as k", "concat('v', id) as v", "if(id % 3 = 0, null, id) as w", "map('a', id) as m")
    out = KeyedTable(spark, str(path), "k", rows.schema, buckets)
    out.upsert(rows)
    return out


def held(t):
    return {r.k: (r.v, r.w, r.m) for r in t.rows().collect()}


def test_changes_are_read_back_and_touch_their_buckets_alone(spark, tmp_path):
    t = table(spark, tmp_path)
    wanted = {k: (f"v{k}", None if k % 3 == 0 else k, {"a": k}) for k in range(200)}
    assert held(t) == wanted and len(stamps(tmp_path)) >= 8
    before = stamps(tmp_path)
    new = spark.createDataFrame([(7, "new", 1, {"b": 2}), (7, "newer", 2, {"b": 3}), (900, "more", None, None), (None, "none", 1, None)], t.schema)
    assert 1 <= t.upsert(new, ["w"]) <= 2
    wanted |= {7: ("newer", 2, {"b": 3}), 900: ("more", None, None)}
    assert held(t) == wanted
    after = stamps(tmp_path)
    assert len(before.keys() & after.keys()) >= 6 and all(before[p] == after[p] for p in before.keys() & after.keys())
    assert t.upsert(new, ["w"]) == 0 and stamps(tmp_path) == after
    updates = spark.createDataFrame([(7, None, 5, {"b": 9}, 1), (7, "last", None, {"c": 1}, 2), (12_345, "x", 1, None, 1)], "k long, v string, w long, m map<string,long>, at int")
    t.patch(updates, "m", ["at"])
    wanted[7] = ("last", 5, {"b": 9, "c": 1})
    assert {k: (v, w, m or None) for k, (v, w, m) in held(t).items()} == wanted
    assert t.delete(spark.createDataFrame([(k,) for k in (*range(0, 50), 9999)], "k long")) > 0
    assert {k: (v, w, m or None) for k, (v, w, m) in held(t).items()} == {k: v for k, v in wanted.items() if k >= 50}
    assert t.delete(spark.createDataFrame([(9999,)], "k long")) == 0
    assert held(KeyedTable(spark, str(tmp_path))) == held(t)
    with pytest.raises(ValueError, match="has key k, not v"):
        KeyedTable(spark, str(tmp_path), "v")
    with pytest.raises(ValueError, match="no table"):
        KeyedTable(spark, str(tmp_path / "nowhere"), "v")


def test_a_batch_is_appended_once(spark, tmp_path):
    for batch, n in ((0, 3), (1, 4), (1, 4), (0, 3)):
        files.append(spark.range(n), str(tmp_path / "log"), batch)
    assert sorted((r.batch, r.id) for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [(b, k) for b, n in ((0, 3), (1, 4)) for k in range(n)]


def test_all_keys_of_a_bucket_may_go(spark, tmp_path):
    t = table(spark, tmp_path, 3, 2)
    t.delete(spark.range(3).withColumnRenamed("id", "k"))
    assert held(t) == {} and not stamps(tmp_path)
    t.upsert(spark.range(2).selectExpr("id as k", "'x' as v", "id as w", "cast(null as map<string,bigint>) as m"))
    assert held(t) == {0: ("x", 0, None), 1: ("x", 1, None)}


def test_a_change_that_died_is_finished_or_dropped(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path, 20, 4)
    before = held(t)
    new = spark.createDataFrame([(3, "new", 1, None)], t.schema)
    monkeypatch.setattr(KeyedTable, "_apply", lambda self, at: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        t.upsert(new)
    assert held(t) == before
    monkeypatch.undo()
    assert held(KeyedTable(spark, str(tmp_path))) == before | {3: ("new", 1, None)}
    # one that wasn't complete
    (tmp_path / "_staged" / "half" / "rows" / "bucket=0").mkdir(parents=True)
    assert held(KeyedTable(spark, str(tmp_path))) == before | {3: ("new", 1, None)} and not list((tmp_path / "_staged").iterdir())


@pytest.fixture(scope="session")
def vectors(spark, data):
    return spark.read.parquet(f"{data}/embeddings.parquet")


@pytest.fixture(scope="session")
def index(spark, vectors, tmp_path_factory):
    return VectorIndex(spark, str(tmp_path_factory.mktemp("index") / "x"), 64, vectors.schema).build(vectors)


def found(rows):
    return sorted((r.query_id, r["rank"], r.vec_id, r.cosine) for r in rows.collect())


def test_index_finds_what_a_whole_search_finds(index, vectors):
    asked = vectors.where("vec_id % 20 = 0")
    wanted = search.top_k(vectors, asked)
    assert recall(index.search(asked), wanted) >= 0.9
    assert recall(index.search(asked, probes=1), wanted) < 1
    for probes in (1, 4):
        assert found(index.search(asked, probes=probes, exact=True)) == found(wanted)


def test_index_is_made_once(spark, index, vectors):
    again = VectorIndex(spark, index.path, 64)
    assert again.rows().count() == vectors.count() and again.schema == vectors.schema
    with pytest.raises(ValueError, match="has dimension 64, not 1536"):
        VectorIndex(spark, index.path, 1536)
    with pytest.raises(ValueError, match="metric"):
        VectorIndex(spark, index.path, 64, metric="euclidean")
    with pytest.raises(Exception, match="vectors of 64 numbers, not of 3"):
        index.upsert(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0)], "vec_id long, embedding array<float>, label int"))
    with pytest.raises(Exception, match="vectors of 64 numbers, the query has 2"):
        index.search(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()


def test_index_is_updated_in_place(spark, vectors, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "x"), 64, vectors.schema).build(vectors)
    before = stamps(tmp_path / "x")
    moved = vectors.where("vec_id in (3, 4)").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"), F.lit(77).alias("label"))
    new = vectors.where("vec_id = 5").select((F.col("vec_id") + 10_000).alias("vec_id"), "embedding", "label")
    touched = index.upsert(moved.unionByName(new))
    assert 2 <= touched <= 5 and len(before.keys() & stamps(tmp_path / "x").keys()) > len(before) // 2
    index.patch(spark.createDataFrame([(9, 55), (99_999, 1)], "vec_id long, label int"))
    index.delete(spark.createDataFrame([(11,), (12,)], "vec_id long"))
    wanted = vectors.where("vec_id not in (3, 4, 11, 12)").unionByName(moved).unionByName(new).withColumn("label", F.when(F.col("vec_id") == 9, 55).otherwise(F.col("label")))
    plain = lambda df: sorted((r.vec_id, r.label, tuple(r.embedding)) for r in df.collect())
    assert plain(index.rows()) == plain(wanted)
    asked = wanted.where("vec_id % 20 = 0 or vec_id in (3, 10005)")
    assert found(index.search(asked, probes=2, exact=True)) == found(search.top_k(wanted, asked))


def test_vectors_of_zeros_and_few_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (None, [1.0, 1.0])], "vec_id long, embedding array<float>")
    index = VectorIndex(spark, str(tmp_path / "x"), 2, rows.schema).build(rows)
    kept = rows.where("vec_id is not null")
    assert {r[:3] for r in found(index.search(kept.where("vec_id > 1"), exact=True, probes=1))} >= {(2, 1, 2), (3, 1, 3)}
    empty = VectorIndex(spark, str(tmp_path / "y"), 2, rows.schema).build(rows.where("vec_id > 9"))
    assert empty.search(kept).collect() == [] and empty.search(kept, exact=True).collect() == []
    empty.upsert(kept)
    assert empty.rows().count() == 3


def test_vectors_of_other_lengths_fail(spark):
    mixed = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [1.0] * 5)], "vec_id long, embedding array<double>").coalesce(1)
    four = spark.createDataFrame([(9, [1.0] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="vectors of 3 and of 5 numbers"):
        search.top_k(mixed, mixed).collect()
    with pytest.raises(Exception, match="queries of 4 numbers and vectors of 3"):
        search.top_k(mixed.where("vec_id = 1"), four).collect()


def test_search_under_a_deal_and_categories(spark):
    vectors = spark.createDataFrame([(k, [1.0, k / 10], f"d{k % 2}", [f"c{k % 3}", f"c{k % 4}", None][: k % 4]) for k in range(40)], "vec_id long, embedding array<double>, deal string, categories array<string>")
    asked = spark.createDataFrame([(100, [1.0, 2.0], "d0", ["c1", "c2"]), (101, [1.0, 0.0], "d1", []), (102, [1.0, 3.0], "d1", ["c1", "c1", None])], "vec_id long, embedding array<double>, deal string, wanted array<string>")
    got = search.top_k(vectors, asked, 4, same=["deal"], any_of=("categories", "wanted"))
    rows = [r.asDict() for r in vectors.collect()]
    wanted = []
    for q in asked.collect():
        some = [v for v in rows if v["deal"] == q.deal and {*v["categories"]} & {*q.wanted} - {None}]
        near = lambda v, q=q: -round(sum(a * b for a, b in zip(v["embedding"], q.embedding)) / (sum(a * a for a in v["embedding"]) * sum(b * b for b in q.embedding)) ** 0.5, 9)  # noqa: E731, B905
        wanted += [(q.vec_id, n + 1, v["vec_id"], -near(v)) for n, v in enumerate(sorted(some, key=lambda v: (near(v), v["vec_id"]))[:4])]
    assert found(got) == sorted(wanted) and len(wanted) == 8


def test_a_change_that_died_while_folders_moved_is_finished(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path, 20, 4)
    before = held(t)
    moves: list[str] = []

    def moved(self, at):
        part = next(iter((Path(at) / "rows").glob("bucket=*"))).name  # one folder was moved, then the job died
        for old in (tmp_path / part).iterdir():
            old.unlink()
        (tmp_path / part).rmdir()
        (Path(at) / "rows" / part).rename(tmp_path / part)
        moves.append(part)
        raise RuntimeError("killed")

    monkeypatch.setattr(KeyedTable, "_apply", moved)
    with pytest.raises(RuntimeError, match="killed"):
        t.upsert(spark.range(20).selectExpr("id as k", "'new' as v", "id as w", "cast(null as map<string,bigint>) as m"))
    monkeypatch.undo()
    assert moves and held(KeyedTable(spark, str(tmp_path))) == {k: ("new", k, None) for k in before}


def test_new_keys_are_added_and_nothing_is_rewritten(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path, 200, 4)
    before, staged = stamps(tmp_path), []
    apply = KeyedTable._apply

    def seen(self, at):
        staged.extend({p.relative_to(at).parts[0] for p in Path(at).rglob("part-*")})
        apply(self, at)

    monkeypatch.setattr(KeyedTable, "_apply", seen)
    assert t.upsert(spark.range(200, 300).selectExpr("id as k", "'x' as v", "id as w", "map('a', id) as m")) == 4
    after = stamps(tmp_path)
    assert before.items() <= after.items() and len(after) > len(before) and t.rows().count() == 300
    assert sorted(staged) == ["new", "parts"]  # new rows lie there once


def test_files_that_were_being_added_are_added_once(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path, 20, 2)
    move, moves = KeyedTable._move, []

    def killed(fs, new, old):
        if moves:
            raise RuntimeError("killed")
        moves.append(move(fs, new, old))

    new = spark.range(20, 60).selectExpr("id as k", "'x' as v", "id as w", "map('a', id) as m")
    monkeypatch.setattr(KeyedTable, "_move", staticmethod(killed))
    with pytest.raises(RuntimeError, match="killed"):
        t.upsert(new)
    monkeypatch.undo()
    t = KeyedTable(spark, str(tmp_path))
    assert moves and t.rows().count() == 60 == len(held(t)) and not list((tmp_path / "_staged").iterdir())
    assert t.upsert(new) == 0 and t.upsert(new.where("k < 0")) == 0 and t.rows().count() == 60


def test_a_folder_of_many_small_files_is_rewritten(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "MANY", 3)
    t = table(spark, tmp_path, 20, 1)
    n = []
    for k in range(6):
        t.upsert(spark.range(100 + k, 101 + k).selectExpr("id as k", "'x' as v", "id as w", "map('a', id) as m"))
        n.append(len(stamps(tmp_path)))
    assert max(n) == 3 and min(n[3:]) == 1 and t.rows().count() == 26


def test_repeated_and_stored_keys_of_a_received_batch(spark, tmp_path):
    t = table(spark, tmp_path, 6, 2)
    at = t.stage()
    new = spark.createDataFrame([(1, "v1", 1, {"a": 1}), (2, "b", 5, None), (2, "a", 9, None), (7, "c", 1, None), (None, "d", 1, None)], t.schema)
    assert t.receive(new, at).count() == 4 and t.take(at) >= 1
    t.leave_stage(at)
    got = held(t)
    assert got[1] == ("v1", 1, {"a": 1}) and got[2] == ("b", 5, None) and got[7] == ("c", 1, None) and len(got) == t.rows().count() == 7


def test_new_rows_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(len(b))
            yield b

    t = table(spark, tmp_path, 50, 4)
    assert t.upsert(spark.range(30).selectExpr("id + 40 as k", "'x' as v", "id as w", "map('a', id) as m").mapInArrow(seen, t.schema)) > 0
    assert made.value == 30 and t.rows().count() == 70


def test_a_large_folder_is_written_by_several_tasks(spark, tmp_path):
    t = table(spark, tmp_path, 10, 1)
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        t.upsert(spark.range(0, 20_000, 1, 4).selectExpr("id as k", "sha2(string(id), 512) as v", "id as w", "map('a', id) as m"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    assert len(stamps(tmp_path)) > 1 and t.rows().count() == 20_000


def test_pairs_of_blocks_take_little_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    q, v = rng.integers(-2, 3, (512, 4)).astype(float), rng.integers(-2, 3, (4096, 4)).astype(float)
    ids = rng.permutation(4096)
    n = 8
    batch = pa.record_batch({"q_ids": pa.array([list(range(512))] * n), "q_vectors": pa.array([q.tobytes()] * n, pa.binary()), "ids": pa.array([ids.tolist()] * n), "vectors": pa.array([v.tobytes()] * n, pa.binary())})
    tracemalloc.start()
    got: dict[int, list] = {}
    for b in search._best(5)(iter([batch])):
        for r in b.slice(0, 5).to_pylist():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["cosine"]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45 << 20
    for name, found in got.items():
        norm = np.sqrt((q[name] ** 2).sum()) * np.sqrt((v**2).sum(1))
        with np.errstate(invalid="ignore"):
            score = np.round(v @ q[name] / norm, 9)
        wanted = sorted(range(4096), key=lambda k: (-score[k] if score[k] == score[k] else 9, ids[k]))[:5]
        assert [x for x, _ in found[:5]] == [int(ids[k]) for k in wanted]


def test_a_small_list_is_one_file(index):
    lists = {p.split("/list=")[1].split("/")[0] for p in stamps(index.path)}
    assert len(stamps(index.path)) == len(lists) > 1


def test_comparing_with_all_centres_takes_little_memory():
    import tracemalloc

    import numpy as np
    import pandas as pd
    import pyarrow as pa

    from clausewright.operators import index as of_index

    rng = np.random.default_rng(2)
    unit = lambda x: x / np.sqrt((x * x).sum(1, keepdims=True))
    centres, v, n = unit(rng.normal(size=(1024, 8))), unit(rng.normal(size=(4000, 8))), 4000
    width, least = np.where(np.arange(1024) % 7, 0.2, -np.inf), rng.uniform(0.8, 1, n)
    batch = pa.record_batch({"id": pa.array(range(n)), "v": pa.array(list(v)), "least": pa.array(least, mask=np.arange(n) % 50 == 0)})
    series, peaks = pd.Series(list(v)), []

    def peak(run):
        tracemalloc.start()
        out = run()
        peaks.append(tracemalloc.get_traced_memory()[1] >> 20)
        tracemalloc.stop()
        return out

    listed = peak(lambda: of_index._nearest_lists(series, centres))
    sums = peak(lambda: list(of_index._sums(centres)(iter([batch]))))[0]
    first = [set(x) for b in peak(lambda: list(of_index._first(centres, 3)(iter([batch])))) for x in b.column("lists").to_pylist()]
    others = [set(x) for b in peak(lambda: list(of_index._others(centres, 3, width)(iter([batch])))) for x in b.column("lists").to_pylist()]
    assert max(peaks) < 16, peaks  # a score of each vector and centre would be 33 MB
    score = v @ centres.T
    assert listed["list"].tolist() == score.argmax(1).tolist() and np.allclose(listed["cosine"], score.max(1))
    assert sum(sums.column("n").to_pylist()) == n
    assert first == [set(np.argsort(-s)[:3]) for s in score]
    for k in range(n):
        near = np.cos(np.maximum(np.arccos(np.clip(score[k], -1, 1)) - width, 0))
        open_ = np.isfinite(width) & ((near >= least[k] - 1e-6) | (k % 50 == 0))
        assert others[k] == set(np.flatnonzero(open_)) - first[k]
