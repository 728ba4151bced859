from __future__ import annotations

import json

import pytest

from clausewright.operators.flatten import flatten, rejects
from clausewright.sources import files as sources

MAE = "Company Material Adverse Effect"


def flat(spark, raw, path="h/a_b.json", **options):
    text = raw if isinstance(raw, str) else json.dumps(raw)
    rows = flatten(spark.createDataFrame([("d", path, text)], "deal_id string, path string, raw string"), **options).orderBy("chunk_index").collect()
    return [(r.label, r.original_text, r.combined_text) for r in rows]


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [
        ([{"article": "I", "title": "Merger", "text": " Body "}], [("ARTICLE I Merger", "Body", "Body")]),
        ([{"article": "I", "title": "Merger", "text": " Body ", "sections": []}], [("ARTICLE I Merger", "Body", "Body")]),
        ({"article": "I", "title": "M", "text": "A", "sections": [{"section": "1.1", "title": "S", "text": " b "}]}, [("ARTICLE I M > Section 1.1 S", " b ", "A\n\n b ")]),
        ({"article": "I", "title": "M", "text": "", "sections": [{"section": "1.1", "title": "S", "text": " b "}]}, [("ARTICLE I M > Section 1.1 S", " b ", " b ")]),
        ({"article": "I", "title": "M", "sections": [{"section": "1", "title": "S"}]}, [("ARTICLE I M > Section 1 S", "", "")]),
        ({"article": "I", "title": "M", "text": "A", "sections": [{"section": "1", "title": "Definitions", "definitions": [{"term": MAE, "definition": "d"}, {"term": "Person", "definition": "p"}]}]}, [(f"ARTICLE I M > Section 1 Definitions > {MAE}", f"{MAE} d", f"{MAE} d")]),
        ({"article": "I", "title": "M", "sections": [{"section": "1", "title": "Definitions", "definitions": []}]}, []),
        ({"article": "I", "title": "M", "sections": [{"section": "1", "title": "Definitions", "text": "x"}]}, [("ARTICLE I M > Section 1 Definitions", "x", "x")]),
        ({"article": "I", "title": "M", "sections": [{"section": "1", "title": "Definitions", "definitions": None, "text": "x"}]}, [("ARTICLE I M > Section 1 Definitions", "x", "x")]),
        ([{"article": "Definitions", "definitions": [{"term": "Material Adverse Effect", "definition": "d"}]}], [("Definition > Material Adverse Effect", "Material Adverse Effect d", "Material Adverse Effect d")]),
        ({"title": "T", "data": [{"text": "x"}]}, []),
        ({"data": [{"article": "I", "title": "M", "text": "A"}]}, [("ARTICLE I M", "A", "A")]),
        ({"articles": [{"article": None, "title": "M", "text": "“A”"}]}, [("ARTICLE  M", '"A"', '"A"')]),
        ([], []),
        ({}, []),
    ],
)
def test_rules(spark, raw, wanted):
    assert flat(spark, raw) == wanted


def test_values_keep_file_order(spark):
    raw = '{"z":{"title":"Z","text":"1"},"a":[{"title":"A","text":"2"},3],"m":5}'
    assert [x[1] for x in flat(spark, raw)] == ["1", "2"]


@pytest.mark.parametrize(("raw", "reason"), [("[3]", "article is not an object"), ("7", "neither a list nor an object"), ('{"a', "not JSON")])
def test_rejects(spark, raw, reason):
    df = spark.createDataFrame([("d", "p", raw), ("e", "p", '[{"text":"x"}]')], "deal_id string, path string, raw string")
    assert [(r.deal_id, r.reason) for r in rejects(df).collect()] == [("d", reason)]
    assert [r.deal_id for r in flatten(df).collect()] == ["e"]
    with pytest.raises(Exception, match="not a contract"):
        flatten(df, strict=True).collect()


def test_files_are_read_and_numbered_whatever_the_partitions(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"deal_{k}_2024-01-0{k + 1}.json").write_text(json.dumps([{"title": f"T{j}", "text": f"x{j}"} for j in range(k)]))
    (tmp_path / "note.txt").write_text("no")
    rows = flatten(sources.contracts(spark, str(tmp_path)))
    one = sorted(map(tuple, rows.collect()))
    assert one == sorted(map(tuple, flatten(sources.contracts(spark, str(tmp_path)).repartition(3)).collect()))
    assert len(one) == 10 and {r[-1] for r in one} == {"Deal 1", "Deal 2", "Deal 3", "Deal 4"}
    assert sources.listing(spark, str(tmp_path)).count() == 5
