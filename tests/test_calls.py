from __future__ import annotations

import json

import pytest

from clausewright.operators import calls, metadata
from clausewright.sources import files, workbook


def test_each_request_is_sent_once_and_failures_are_rows(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def call(some):
        import os
        import uuid

        for x in some:
            (log / uuid.uuid4().hex).write_text(x)
        if any("bad" in x for x in some) or ("once" in some and not os.path.exists(log / "second")):
            (log / "second").touch()
            raise RuntimeError("refused")
        return [x.upper() for x in some]

    said = lambda: sorted(p.read_text() for p in log.iterdir() if p.name != "second")
    rows = spark.createDataFrame([(k, ["a", "b", "bad", None, "a"][k % 5]) for k in range(50)], "k int, request string")
    answer = lambda df: calls.answer(df, call, str(tmp_path / "t"), batch=2, wait=0.01, buckets=4, tasks=2)
    got = answer(rows)
    assert got.columns == ["k", "request", "reply", "error"]
    told = {(r.request, r.reply, r.error) for r in got.collect()}
    assert told == {("a", "A", None), ("b", "B", None), ("bad", None, "RuntimeError: refused"), (None, None, None)} and got.count() == 50
    sent = said()
    assert sent.count("bad") >= 2 and 1 <= sent.count("a") <= 4
    # a second run sends only what failed, and a new request; one that fails at first is tried again
    more = rows.unionByName(spark.createDataFrame([(99, "once")], "k int, request string"))
    assert {(r.request, r.reply) for r in answer(more).collect()} >= {("once", "ONCE"), ("a", "A")}
    new = said()[:]
    for x in sent:
        new.remove(x)
    assert set(new) == {"bad", "once"}
    replies = {r.request: (r.reply, r.tries) for r in calls.reply_table(spark, str(tmp_path / "t")).rows().collect()}
    assert len(replies) == 4 and replies["once"][0] == "ONCE" and replies["bad"][1] >= 2


def test_fewer_replies_than_requests_are_an_error():
    assert calls._tried(lambda some: [], ["x", "y"], 1, 0) == [(None, "ValueError: 0 replies to 1 requests", 2)] * 2


def test_every_key_becomes_a_column(spark):
    props = ['{"a": 1, "b": "x", "c": [1, 2], "weird key": true}', '{"a": 2.5, "b": 7, "d": {"e": null}}', '{"a": null, "b": "y", "weird key": "no"}', "nope", None, "[1]", '{"weird key": false, "b": null}']
    rows = spark.createDataFrame(list(enumerate(props)), "v int, props string")
    assert metadata.columns_of(rows, "props") == {"a": "double", "b": "string", "c": "string", "d": "string", "weird key": "boolean"}
    got = metadata.spread(rows, "props")
    assert got.columns == ["v", "props", "a", "b", "c", "d", "weird key", "rest"]
    plain = {r.v: (r.a, r.b, r.c, r.d, r["weird key"], r.rest) for r in got.collect()}
    none = (None,) * 5
    assert plain == {
        0: (1.0, "x", "[1,2]", None, True, {}), 1: (2.5, None, None, '{"e":null}', None, {"b": "7"}), 2: (None, "y", None, None, None, {"weird key": '"no"'}),
        3: (*none, {"": "nope"}), 4: (*none, {}), 5: (*none, {"": "[1]"}), 6: (None, None, None, None, False, {}),
    }
    other = metadata.spread(rows, "props", "p_", {"a": "bigint"})
    assert {r.v: r.p_a for r in other.collect()}[0] == 1 and json.loads({r.v: r.rest for r in other.collect()}[0]["c"]) == [1, 2]
    with pytest.raises(ValueError, match="more than 3 keys"):
        metadata.columns_of(rows, "props", 3)


ROWS = [["Target Name", "CIK Number", "Price", "Note"], ["Acme & Co", "0000123", "1.50", None], [None, None, None, None], ["<Sons>", None, None, "  é☃ "], ["x" * 300, "007", "", "TRUE"]]


def test_a_workbook_reads_like_its_csv(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook.write(ROWS))
    import csv

    with open(tmp_path / "a.csv", "w", newline="") as f:
        csv.writer(f).writerows(ROWS)
    plain = lambda df: sorted((r.target_name or "", r.cik or "", sorted((k, v) for k, v in r.extra.items() if v is not None)) for r in df.collect() if any((r.target_name, r.cik, *r.extra.values())))
    assert plain(workbook.sheet(spark, str(tmp_path / "a.xlsx"))) == plain(files.sheet(spark, str(tmp_path / "a.csv")))
    assert {r.cik for r in workbook.sheet(spark, str(tmp_path / "a.xlsx"), "Sheet1").collect()} == {"0000123", None, "007"}
    with pytest.raises(Exception, match="no sheet"):
        workbook.sheet(spark, str(tmp_path / "a.xlsx"), "Other").collect()


def test_shared_strings_numbers_and_gaps():
    import io
    import zipfile

    book = workbook.write([["a"]])
    sheet = f'<worksheet xmlns="{workbook.MAIN[1:-1]}"><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c r="AA2"><v>12.0</v></c><c r="AB2" t="b"><v>1</v></c></row><row><c t="s"><v>0</v></c></row></sheetData></worksheet>'
    strings = f'<sst xmlns="{workbook.MAIN[1:-1]}"><si><t>plain</t></si><si><r><t>two </t></r><r><t>runs</t></r><rPh><t>not</t></rPh></si></sst>'
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as old, zipfile.ZipFile(out, "w") as new:
        for n in old.namelist():
            new.writestr(n, sheet if n.endswith("sheet1.xml") else old.read(n))
        new.writestr("xl/sharedStrings.xml", strings)
    rows = list(workbook.read(out.getvalue()))
    assert rows == [[], [None, "two runs", *[None] * 24, "12.0", "TRUE"], ["plain"]]
