from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from samples import ODD  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, block int, key long, node long, part int, score double, h long, " \
    "gone int, sha string, time int, maybe boolean, _gone_id long, _time int, _maybe boolean, kept_id long, kept_sha string, text_sha256 string, e int, d int"
REST = (1, 2, 3, 4, 5, 6, 0.5, 7, 8, "h", 9, True, 10, 11, False, 12, "k", "t", 13, 14)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="session")
def pairs(documents):
    return sorted(map(tuple, documents.collect()))


@pytest.fixture(scope="session")
def odd(spark):
    """ODD with columns whose names the operators use inside."""
    rows = [(i, t, "en", ["s", None, ""][k % 3], *REST) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def twice(odd, spark):
    """Every row twice, and two rows without an id."""
    none = spark.createDataFrame([(None, "a b c d e f g h", "en", "s", *REST), (None, None, "en", None, *REST)], COLUMNS)
    return odd.unionByName(odd).unionByName(none)


@pytest.fixture(scope="session")
def twice_rows(twice):
    return [tuple(r) for r in twice.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet")
