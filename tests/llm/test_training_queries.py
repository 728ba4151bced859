"""The registered queries and the pipeline over the smallest tables."""

from __future__ import annotations

import sys
from collections import Counter, defaultdict

import brute
import pandas as pd
import pytest
from compare import rows

from clausewright.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, data, duck, name):
    df, wanted = queries.QUERIES[name](spark, data), duck.sql(queries.ORACLE_SQL[name])
    plain = lambda values, columns: pd.DataFrame(values, columns=columns, dtype=object)  # noqa: E731  whole numbers stay whole beside nulls
    assert rows(plain(df.collect(), df.columns)) == rows(plain(wanted.fetchall(), wanted.columns))


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n.startswith("op")))
def test_query_has_its_columns(spark, data, name):
    wanted = {
        1: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", 2: "doc_id n_words n_removed kept_sha256", 3: "doc_id n_shingles component_id kept",
        4: "doc_id keep_id group_size kept text_sha256", 5: "doc_id n_words n_base first_word last_word base_labels labels score", 6: "doc_id piece start length ids_crc32 sequence_id offset",
        7: "doc_id size source_size target taken", 8: "doc_id held_out score predicted", 9: "doc_id held_out score predicted", 10: "doc_id held_out n_tokens n_known train_tokens base_score score",
        11: "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256 n_best_a",
        12: "doc_id n_shingles component_id",
        13: "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    }
    df = queries.QUERIES[name](spark, data)
    assert df.columns == wanted[int(name[2:].split("_")[0])].split()
    assert df.count() >= (200 if "doc_id" in df.columns else 30)


def test_near_links_start_at_the_contracts_share(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet")
    wanted = brute.components(sorted((r.doc_id, r.text) for r in documents.collect()), percent=85)
    assert sorted(map(tuple, queries.QUERIES["op3_near_dedup"](spark, data).collect())) == wanted


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 14))


def test_pipeline(spark, data):
    sys.path.insert(0, str(queries.__file__).rsplit("/clausewright/", 1)[0])
    import corpus_pipeline as pipeline
    from clausewright.llm import crf, packing
    from clausewright.llm.store import cut

    documents = spark.read.parquet(f"{data}/documents.parquet")
    kept, stages = documents, []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        kept = cut(stage(spark, kept, data))
        stages.append(kept)
        assert kept.columns == documents.columns or k == len(pipeline.STAGES) - 1
    text = {r.doc_id: r.text for r in documents.collect()}
    good = {r.doc_id for r in crf.scores(documents, spark.read.parquet(f"{data}/labels.parquet")).where("predicted = 1").collect()}
    ids = [[r.doc_id for r in s.select("doc_id").collect()] for s in stages]
    assert set(ids[0]) == good
    first = {}
    for i in sorted(good):
        first.setdefault(" ".join(brute.re.split(r"[\x20\x09-\x0D]+", text[i])), i)
    assert sorted(ids[1]) == sorted(first.values())
    near = [i for i, _, _, stays in brute.components([(i, text[i]) for i in ids[1]]) if stays]
    assert sorted(ids[2]) == near
    source = {r.doc_id: r.source for r in documents.collect()}
    size = {i: len(brute.WORD.findall(text[i])) for i in near}
    sizes: dict = defaultdict(int)
    for i in near:
        sizes[source[i]] += size[i]
    took: dict = defaultdict(int)
    for i, n in Counter(ids[3]).items():
        assert n <= 2
        took[source[i]] += n * size[i]
    for s, wanted in brute.targets(sizes).items():
        assert abs(took[s] - wanted) <= max(size[i] for i in near if source[i] == s) / 2 + 1e-6
    assert set(Counter(ids[4])) == set(ids[3]) and packing.__doc__
    assert rows(pipeline.run(spark, data).toPandas()[["doc_id", "piece", "ids_crc32"]]) == rows(stages[-1].toPandas()[["doc_id", "piece", "ids_crc32"]])
