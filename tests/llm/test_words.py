from __future__ import annotations

import brute
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from clausewright.llm import words as W

TEXTS = st.lists(st.none() | st.text(alphabet="aAbB1é☃😀 \t\n\x0b\x1c.-", max_size=30), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.booleans(), st.integers(1, 40))
def test_words_and_their_hashes(texts, fold, limit):
    data, bounds = W.column(pa.record_batch({"text": pa.array(["x", *texts], pa.string())}).slice(1))
    known: dict[int, str] = {}
    for a, z, own, cuts in W.pieces(data, bounds, limit):
        words = W.find(own, cuts, W.BLANK_SEPARATED, fold)
        for k in range(z - a):
            span = slice(words.first[k], words.first[k + 1])
            got = [own[s:e].tobytes().decode() for s, e in zip(words.start[span], words.end[span], strict=True)]
            assert got == brute.WORD.findall(texts[a + k] or "")
            for w, h in zip(got, words.hash[span].tolist(), strict=True):
                w = brute.low(w) if fold else w  # noqa: PLW2901
                assert known.setdefault(h, w) == w
        table = W.find(own, cuts, W.ALPHANUMERIC, True)
        assert table.counts.tolist() == [len(brute.ALNUM.findall(brute.low(t))) for t in texts[a:z]]
    assert len(set(known.values())) == len(known)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 12))
def test_grams_tell_sequences_apart(items, n):
    one = W.mix(np.array(items, np.uint64))
    got = W.grams(one, n)
    wanted = [tuple(items[k : k + n]) for k in range(len(items) - n + 1)]
    assert len(got) == len(wanted)
    assert len(set(got.tolist())) == len(set(wanted)) == len(set(zip(got.tolist(), wanted, strict=True)))


def thue_morse(n: int, a: str = "a", b: str = "b") -> str:
    return "".join(b if k.bit_count() % 2 else a for k in range(n))


def test_long_words_of_any_build_have_hashes_of_their_own():
    """Sequences whose differences a sum of powers can't see, their complements, and changes of one bit."""
    made = [thue_morse(n, *ab) for n in (512, 1024, 2048, 4096, 65_536) for ab in ("ab", "ba", "aq")]
    made += [w[:k] + chr(ord(w[k]) ^ bit) + w[k + 1 :] for w in made[:6] for k in (0, 100, 511) for bit in (1, 2, 4)]
    made += [w * k for w in ("ab", "ba", "a", "b") for k in range(300, 320)]
    made = sorted(set(made))
    for lane in (0, 1):
        data, bounds = W.column(pa.record_batch({"text": pa.array([" ".join(made)])}))
        assert len(set(W.find(data, bounds, lane=lane).hash.tolist())) == len(made)
