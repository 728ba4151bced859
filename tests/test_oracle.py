"""Every registered query that isn't a training-data operator, against its SQL."""

from __future__ import annotations

import pytest
from compare import rows

from clausewright.plans import catalogue, further, stores  # noqa: F401  the others add their queries to the catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, data, duck, name):
    got, wanted = catalogue.QUERIES[name](spark, data).toPandas(), duck.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


def test_entry_has_a_query_and_sql_for_each(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(catalogue.SQL) == set(catalogue.QUERIES)
    assert entry.entry(spark).count() > 0


def test_normalize_text_matches_sql_on_odd_texts(spark, tmp_path):
    import duckdb

    blanks = "\t\n\x0b\x0c\r\x1c\x1f \x85\xa0\u2003\u2028\u200b\u3000\ufeff"
    texts = [None, "", " ", "\n\t ", "“q” ‘s’ – —", " a\n b \r\n", "a" + " " * 100_000 + "b", *[f"a{b}" for b in blanks], *[f"a {b} \n" for b in blanks]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert rows(catalogue.QUERIES["normalize_text"](spark, str(tmp_path)).toPandas()) == rows(con.sql(catalogue.SQL["normalize_text"]).df())
