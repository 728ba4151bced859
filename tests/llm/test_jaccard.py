from __future__ import annotations

import random

import brute
import numpy as np
import pytest

from clausewright.llm import jaccard, near


def plain(rows, percent=80, width=5):
    return [(i, n, c) for i, n, c, _ in brute.components(rows, width, percent)]


def same(spark, rows, percent=80, part_bytes=64 << 20):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, jaccard.linked_groups(df, percent=percent, part_bytes=part_bytes).collect())) == plain(rows, percent)


@pytest.mark.parametrize("percent", [80, 50, 100])
def test_documents(documents, pairs, percent):
    assert sorted(map(tuple, jaccard.linked_groups(documents, percent=percent).collect())) == plain(pairs, percent)


def test_odd_texts(spark, odd, empty, twice):
    from samples import ODD

    assert sorted(map(tuple, jaccard.linked_groups(odd).collect())) == plain(ODD)
    assert jaccard.linked_groups(empty).collect() == []
    wanted = plain(ODD) * 2 + [(None, 4, None), (None, 0, None)]
    assert sorted(map(tuple, jaccard.linked_groups(twice).collect()), key=repr) == sorted(wanted, key=repr)


def families(seed, n=900):
    """Short texts around few passages, many of them close to the threshold, and a passage that a third of all share."""
    rng = random.Random(seed)
    passages = [[f"p{k}_{j}" for j in range(rng.randrange(20, 60))] for k in range(6)]
    rows = []
    for i in range(n):
        words = list(rng.choice(passages))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        if i % 3 == 0:
            words += passages[0]
        words += [f"o{i}_{j}" for j in range(rng.randrange(5))]
        rows.append((i * 7 % n, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_families(spark, seed, monkeypatch):
    """Also with tiles so small that groups take many, and columns that go to many parts in many messages."""
    rows = families(seed)
    same(spark, rows)
    monkeypatch.setattr(jaccard, "TILE", 20)
    monkeypatch.setattr(near, "TILE", 20)
    monkeypatch.setattr(jaccard, "ENOUGH", 500)
    same(spark, rows, part_bytes=4000)


def test_product_with_bounds(monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    rng = np.random.default_rng(5)
    for percent in (50, 80, 85, 100):
        base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
        sets = [np.unique(np.concatenate((base[rng.random(60) < p], rng.integers(0, 50, k).astype(np.uint64)))) for p in (0.5, 0.9, 0.95, 1) for k in (0, 1, 3) for _ in range(4)]
        got = jaccard.linked([s for s in sets if len(s)], percent)
        each = [set(s.tolist()) for s in sets if len(s)]
        assert got.tolist() == [[x is not y and 100 * len(x & y) >= percent * len(x | y) for y in each] for x in each]


def test_columns_that_senders_share():
    """Each row learns how many of its columns others have, whoever sends them, and copies of it don't count."""
    rng = random.Random(4)
    sets = {k: np.unique(np.array([rng.randrange(300) for _ in range(rng.randrange(1, 40))], np.uint64)) for k in range(1, 60)}
    many = [[k for k, s in sets.items() if g in s] for g in range(300)]
    batches = []
    for _ in range(4):
        sender = jaccard._Sender(3)
        for k in rng.sample(sorted(sets), 40):
            batches += sender.add(k, sets[k])
        batches += sender.send()
    sent = {k for b in batches for x in b.column("keys").to_pylist() for k in np.frombuffer(x, np.int64).tolist()}
    total = dict.fromkeys(sent, 0)
    for b in jaccard._added(jaccard._shared(5)(iter(batches))):
        for k, n in zip(b.column("d1").to_pylist(), b.column("shares").to_pylist(), strict=True):
            total[k] += n
    assert total == {k: sum(len(sent & set(many[g])) > 1 for g in sets[k].tolist()) for k in sent}
