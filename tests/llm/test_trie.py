from __future__ import annotations

import random

import brute
import pytest

from clausewright.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def same(spark, rows, family, extra=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        df = df.selectExpr("*", "1 as depth", "text as cls", "role as digest", "2 as n", "3 as at", "4 as place")
    got = trie.conversation_trie(df, family=family)
    assert got.columns == list(trie.NODES)
    conversations = brute.rebuilt_conversations(rows, family) if family else brute.rebuilt_conversations(rows, longest=0)
    assert sorted(map(tuple, got.collect()), key=repr) == brute.trie_nodes(conversations)


@pytest.mark.parametrize("family", [None, 5])
def test_random_conversations(spark, family):
    rng = random.Random(7)
    rows = []
    for c in range(-12, 45):
        if rng.random() < 0.15:
            continue
        for t in range(rng.choice((1, 2, 3, 8, 12))):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(("user", "assistant")), rng.choice(("a", "b", "é☃"))))
    rng.shuffle(rows)
    same(spark, rows, family, extra=True)


def test_odd_turns(spark):
    """Null and empty roles and texts, equal turns, repeated rows, a very long text, rows without an id, roles that run into texts."""
    rows = [(1, None, None, None), (1, 0, "", ""), (1, 0, "user", "x"), (1, 0, "user", "x"), (2, 5, "u", "serx"), (2, 6, "user", "x"), (3, 1, "user", "y" * 300_000), (None, 1, "user", "z"), (4, 1, "use", "rx"), (5, -3, None, ""), (5, None, "", None)]
    same(spark, rows, None)
    same(spark, rows, 5)


def test_equal_conversations_and_one_of_many_turns(spark):
    """Half of the conversations are the same, and one conversation holds most turns; ends come in several pieces."""
    rows = [(c, t, "user", f"hello {t}") for c in range(400) for t in range(3 if c % 2 else 2)] + [(1000, t, "user", f"hello {min(t, 30)}") for t in range(700)]
    old, trie.PIECE = trie.PIECE, 16
    try:
        got = {(r.conv_id, r.depth): r for r in trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()}
    finally:
        trie.PIECE = old
    assert len(got) == 701 and (got[0, 0].n_convs, got[0, 0].n_leaves, got[0, 0].n_children) == (401, 1, 1)
    assert got[0, 2].ends_sha256 == brute.hashlib.sha256(",".join(str(c) for c in range(0, 400, 2)).encode()).hexdigest()
    assert got[0, 0].saved_tokens == 7 * (400 + 400 + 200) and got[1000, 700].n_children == 0


def test_no_conversations_and_one(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA), family=5).collect() == []
    same(spark, [(7, 1, "user", "x"), (7, 2, "user", "x")], 5)
    same(spark, [(6, k, "user", "x") for k in range(9)], 5)
