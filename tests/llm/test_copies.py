"""Very many equal rows, ids and texts alike: dealt evenly, and with the results that as many different rows have."""

import brute
import pytest
from pyspark.sql import functions as F

from clausewright.llm import interpolation, store, substring

LONG = " ".join(f"w{k}" for k in range(50))


@pytest.fixture(scope="module")
def rows():
    return [(None, None)] * 2000 + [(7, LONG)] * 1500 + [(8, "short text")] * 3 + [(9, "x " + LONG), (10, "once alone"), (11, None), (None, "")]


@pytest.fixture(scope="module")
def copies(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(7)


def test_equal_rows_are_dealt_evenly(spark, copies, rows):
    told = store.told_apart(store.texts(copies), store.Tables(spark))
    assert told.count() == len(rows) == told.select("row").distinct().count()
    blocks = [r["count"] for r in told.groupBy(F.pmod("row", F.lit(8))).count().collect()]
    assert len(blocks) == 8 and max(blocks) < 1.3 * len(rows) / 8
    assert sorted(map(tuple, told.groupBy("doc_id", "text").count().collect()), key=repr) == sorted(
        map(tuple, store.texts(copies).groupBy("doc_id", "text").count().collect()), key=repr
    )


def test_rows_without_copies_pass_as_they_are(spark):
    told = store.told_apart(spark.range(100).selectExpr("id as doc_id", "string(id) as text"), store.Tables(spark))
    assert told.count() == 100 and "Join" not in told._jdf.queryExecution().toString()


def test_equal_rows_repeat_each_other(copies, rows):
    found = substring.remove_repeats(copies, keep_text=False)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute.kept_words(rows), key=repr)


def test_equal_rows_count_each(copies, rows):
    found = interpolation.scores(copies).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6))
    wanted = [(*r[:-1], round(float(r[-1]), 6)) for r in brute.base_scores(rows)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)
