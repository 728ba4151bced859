from __future__ import annotations

import random

import brute
import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from clausewright.llm import alignment  # noqa: E402

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATHS[0])
    own.encode_special_tokens = True
    return own, SentencePieceProcessor(model_file=PATHS[1])


STRANGE = [
    "  two  spaces   ", "\t\n mixed \r\n\x0b blanks \x00 ", "a▁b", "▁", " ", "<|endoftext|> <s> </s> <unk> <0x41> x<0x0A>", "don't we'll I'd they've 'S 'LL", "é é ﬁ ① İ ß ☃😀 ΑΣ 你好  ​　 ١٢ ½²",
    "x" * 5000, "é" * 3000, "ab " * 2000, "퟿\U0010ffff﻿", "͸\U0001e030Ᲊ \U00010d40", "1234567 12,345.67 --- ...", "日本語" * 400,
]


def same(spark, rows, libraries, repartition=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "2 as n_a", "text as pairs", "3 as idx").repartition(repartition)
    got = alignment.align(df, *PATHS)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute.alignments(rows, *libraries), key=repr)


def test_documents(spark, documents, pairs, libraries):
    got = alignment.align(documents, *PATHS)
    assert sorted(map(tuple, got.collect())) == sorted(brute.alignments(pairs, *libraries))


def test_odd_texts(spark, libraries):
    rng = random.Random(3)
    made = ["".join(rng.choice("ab1 .'é▁\n☃") for _ in range(rng.randrange(40))) for _ in range(200)]
    rows = [(k, t) for k, t in enumerate([*STRANGE, *made])]
    same(spark, [*rows, (None, "no id"), (None, None), (7, None), (8, ""), (3, "again"), (3, "again"), (2**62, "far"), (-1, "x " * 50_000)], libraries)


def test_no_documents(spark, libraries):
    same(spark, [], libraries)
    same(spark, [(1, None), (2, "")], libraries)


def test_blocks_of_any_size_give_the_same(spark, pairs, libraries):
    """Blocks of a few texts, so that pairs are told to many; counts above a byte."""
    old, alignment.WHOLE = alignment.WHOLE, 2000
    try:
        align = alignment.Aligner(*PATHS)
        assert len(list(alignment._parts(spark.createDataFrame(pairs[:50], "doc_id long, text string").toArrow().combine_chunks().to_batches()[0]))) > 5
        got = align([t for _, t in pairs[:20]])
        assert got["n_links"].sum() == len(got["a"]) == len(got["b"]) and got["n_groups"].min() >= 1
    finally:
        alignment.WHOLE = old
    same(spark, [(k, "the " * 700 + str(k)) for k in range(30)], libraries, 8)


def test_either_way_of_encoding_gives_the_librarys_ids(pairs, libraries):
    some = [t for _, t in pairs] + STRANGE
    a, b = alignment.ByteLevel(PATHS[0]), alignment.Pieces(PATHS[1])
    assert a.fast is not None and b.apart
    for _ in range(2):
        assert [x.tolist() for x in a.encode([" " + t for t in some])] == [x.ids for x in libraries[0].encode_batch([" " + t for t in some], add_special_tokens=False)]
        assert [x.tolist() for x in b.encode(some)] == libraries[1].encode(some)
    a.fast, b.apart = None, False
    assert [x.tolist() for x in a.encode(some[-20:])] == [x.ids for x in libraries[0].encode_batch(some[-20:], add_special_tokens=False)]
    assert [x.tolist() for x in b.encode(some[-20:])] == libraries[1].encode(some[-20:])


def test_merge():
    at_a, at_b, common = alignment.merged(np.array([2, 5, 6, 9]), np.array([1, 5, 9]))
    assert (at_a.tolist(), at_b.tolist(), common.tolist()) == ([0, 0, 1, 2, 3], [0, 1, 1, 2, 2], [5, 9])
