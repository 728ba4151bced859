"""A toxicity classifier: a factorization machine over hashed terms.

Terms are words and the first bytes of words, hashed. Each has a weight and a short vector; the score adds
the weights of a text's distinct terms and the products of the vectors of every two of them, so what two
terms mean together is learned besides what each means alone.

The machine is fitted on a bounded sample of labelled documents, over the terms that tell their labels
apart best, alone or two together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import labelled, some_letters
from .store import Tables, remainder, texts
from .words import ALPHANUMERIC, U, column, find, mix, pieces

#: Labelled documents to fit on, at most, those with the least hash of their id, and bytes of all of them. Slots of hashed
#: terms; terms that are kept; length of a term's vector; rounds of the fit.
SAMPLE, BYTES, SLOTS, TERMS, FACTORS, ROUNDS = 8000, 1 << 25, 1 << 22, 4096, 4, 200
#: Terms that are paired, at most, the most frequent ones; terms kept for their pairs, at most; terms in one product.
PAIRED, TERMS_OF_PAIRS, COLUMNS = 8192, 4096, 2048
#: Bytes of a word's head that are terms of their own.
HEADS = (4, 5, 6)


def terms(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all terms, with repeats, and the text that each belongs to."""
    words = find(data, bounds, ALPHANUMERIC, fold=True)
    of = words.text_of()
    slots, owners = [words.hash], [of]
    for n in HEADS:
        head, which = words.heads(n)
        slots.append(head)
        owners.append(of[which])
    return (mix(np.concatenate(slots)) % U(SLOTS)).astype(np.int64), np.concatenate(owners)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = column(batch)
        for a, z, own, cuts in pieces(data, bounds):
            slot, of = terms(own, cuts)
            key = np.unique(of * SLOTS + slot)
            each = np.split((key % SLOTS).astype(np.int32), np.searchsorted(key // SLOTS, np.arange(1, z - a)))
            yield pa.record_batch({"doc_id": batch.column("doc_id").slice(a, z - a), "label": batch.column("label").slice(a, z - a), "slots": pa.array([e.tobytes() for e in each], pa.binary())})


def select_terms(slots: list[np.ndarray], label: np.ndarray, most: int = TERMS) -> np.ndarray:
    """The slots whose presence says most about the label (by the likelihood ratio), of those in 3 texts or more, ascending."""
    yes = np.bincount(np.concatenate([s for s, y in zip(slots, label, strict=True) if y] or [np.zeros(0, int)]), minlength=SLOTS).astype(float)
    no = np.bincount(np.concatenate([s for s, y in zip(slots, label, strict=True) if not y] or [np.zeros(0, int)]), minlength=SLOTS).astype(float)
    some = np.flatnonzero(yes + no >= 3)
    n1, n0 = max(label.sum(), 1), max((1 - label).sum(), 1)

    def part(k: np.ndarray, n: float, rate: np.ndarray) -> np.ndarray:
        return k * np.log(np.maximum(k / n, 1e-12) / rate) + (n - k) * np.log(np.maximum(1 - k / n, 1e-12) / np.maximum(1 - rate, 1e-12))

    rate = (yes + no)[some] / (n1 + n0)
    gain = part(yes[some], n1, rate) + part(no[some], n0, rate)
    # what chance gives among so many terms isn't kept
    good = gain > 0.7 * np.log(max(len(some), 2))
    some, gain = some[good], gain[good]
    return np.sort(some[np.argsort(-gain, kind="stable")[:most]])


def present(slots: list[np.ndarray], kept: np.ndarray) -> np.ndarray:
    """Texts by kept terms, 0 or 1."""
    x = np.zeros((len(slots), len(kept)), np.float32)
    for i, s in enumerate(slots):
        at = np.searchsorted(kept, s)
        ok = at < len(kept)
        at, s = at[ok], s[ok]  # noqa: PLW2901
        x[i, at[kept[at] == s]] = 1
    return x


def select_pairs(slots: list[np.ndarray], label: np.ndarray, most: int = TERMS_OF_PAIRS) -> np.ndarray:
    """The slots of pairs that say more about the label together than their terms do alone, ascending.

    A pair's gain is the likelihood ratio of its own effect next to what each of its terms adds (in log odds, from
    the base rate). The PAIRED most frequent terms in 3 texts or more are paired, a block of them at a time; terms that are in the
    same texts count as one, and pairs in fewer than 3 texts don't count.
    """
    n = np.bincount(np.concatenate([*slots, np.zeros(0, int)]).astype(int), minlength=SLOTS)
    some = np.flatnonzero(n >= 3)
    some = np.sort(some[np.argsort(-n[some], kind="stable")[:PAIRED]])
    if len(some) < 2 or not 0 < label.sum() < len(label):
        return np.zeros(0, int)
    cuts = range(0, len(some), COLUMNS)
    # texts by terms, as bits; the first of each set of terms that are in the same texts
    held = np.concatenate([np.packbits(present(slots, some[k : k + COLUMNS]).astype(bool), 0) for k in cuts], 1)
    _, first, of = np.unique(np.ascontiguousarray(held.T).view(f"V{len(held)}").ravel(), return_index=True, return_inverse=True)
    held = held[:, first]
    cuts = range(0, len(first), COLUMNS)
    n1, n0 = label.sum(), len(label) - label.sum()

    def block(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.unpackbits(held[:, cuts[k] : cuts[k] + COLUMNS], 0, count=len(label))
        yes, no = x[label == 1].astype(np.float32), x[label == 0].astype(np.float32)
        return yes, no, np.log((yes.sum(0) + 0.5 * n1 / len(label)) / (no.sum(0) + 0.5 * n0 / len(label))) - np.log(n1 / n0)

    best, limit = np.zeros(len(first)), 0.7 * np.log(len(some) * (len(some) - 1) / 2)
    for k, at in enumerate(cuts):
        yes, no, alone = block(k)
        for other, to in list(enumerate(cuts))[k:]:
            yes2, no2, alone2 = (yes, no, alone) if other == k else block(other)
            a, b = yes.T @ yes2, no.T @ no2
            if other == k:
                np.fill_diagonal(a, 0)
                np.fill_diagonal(b, 0)
            i, j = np.nonzero(a + b >= 3)
            a, b = a[i, j], b[i, j]
            p = 1 / (1 + np.exp(-np.clip(np.log(n1 / n0) + alone[i] + alone2[j], -15, 15)))
            rate = np.clip(a / (a + b), 1e-7, 1 - 1e-6)
            gain = a * np.log(rate / p) + b * np.log((1 - rate) / (1 - p))
            np.maximum.at(best, at + i, gain)
            np.maximum.at(best, to + j, gain)
    best = best[of]
    good = np.flatnonzero(best > limit)
    return np.sort(some[good[np.argsort(-best[good], kind="stable")[:most]]])


def machine(x: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """x: texts by terms, 0 or 1. The score before the logistic function."""
    both = x @ v
    return w0 + x @ w + 0.5 * (both**2 - x @ v**2).sum(1)


def fit(slots: list[np.ndarray], label: np.ndarray) -> dict[str, np.ndarray]:
    """Weights by gradient ascent (Adam) on the penalised log likelihood, over the whole sample each round."""
    kept = np.union1d(select_terms(slots, label), select_pairs(slots, label))
    x = present(slots, kept)
    y = label.astype(np.float32)
    rate = (y.sum() + 1) / (len(y) + 2)
    w0, w = float(np.log(rate / (1 - rate))), np.zeros(len(kept), np.float32)
    v = (np.random.default_rng(7).normal(0, 0.05, (len(kept), FACTORS))).astype(np.float32)
    values = [np.array([w0], np.float32), w, v]
    m, s2 = [np.zeros_like(a) for a in values], [np.zeros_like(a) for a in values]
    for t in range(1, ROUNDS + 1):
        w0, w, v = values[0][0], values[1], values[2]
        both = x @ v
        score = w0 + x @ w + 0.5 * (both**2 - x @ v**2).sum(1)
        off = y - 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        slopes = [
            np.array([off.sum()], np.float32),
            x.T @ off - 0.02 * w,
            x.T @ (off[:, None] * both) - v * (x.T @ off)[:, None] - 0.5 * v,
        ]
        for k, g in enumerate(slopes):
            m[k], s2[k] = 0.9 * m[k] + 0.1 * g, 0.99 * s2[k] + 0.01 * g**2
            values[k] = values[k] + 0.05 * (1 - t / (ROUNDS + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s2[k] / (1 - 0.99**t)) + 1e-8)
    return {"kept": kept, "w0": values[0].astype(float), "w": values[1].astype(float), "v": values[2].astype(float)}


def toxicity(data: np.ndarray, bounds: np.ndarray, model: dict[str, np.ndarray], known: np.ndarray) -> np.ndarray:
    """known: for each slot, whether it is among the kept ones."""
    slot, of = terms(data, bounds)
    at = np.flatnonzero(known[slot])
    key = np.unique(of[at] * SLOTS + slot[at])
    of, term = key // SLOTS, np.searchsorted(model["kept"], key % SLOTS)
    n = len(bounds) - 1
    total = model["w0"][0] + np.bincount(of, model["w"][term], n)
    for k in range(model["v"].shape[1]):
        v = model["v"][term, k]
        total += 0.5 * (np.bincount(of, v, n) ** 2 - np.bincount(of, v**2, n))
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, left_out: int = 0, sample: int = SAMPLE, most_bytes: int = BYTES) -> dict[str, np.ndarray]:
    """The model, from at most `sample` labelled documents of at most `most_bytes` bytes, as sampling.labelled() chooses them.

    Without any labelled document the model scores every text 0.5.
    """
    tables = Tables(docs.sparkSession)
    chosen = labelled(docs, labels, label, id_col, text_col, modulus, left_out, sample, F.octet_length("text"), most_bytes, tables, some_letters)
    got = sorted(chosen.mapInArrow(_sampled, "doc_id long, label int, slots binary").toLocalIterator(), key=lambda r: r.doc_id)
    tables.drop(*[t for t, _ in tables.written])
    return fit([np.frombuffer(r.slots, np.int32) for r in got], np.array([r.label for r in got], int))


def _scored(model: dict[str, np.ndarray], limit: float):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(SLOTS, bool)
        known[model["kept"]] = True
        for batch in batches:
            data, bounds = column(batch)
            score = np.concatenate([toxicity(own, cuts, model, known) for _, _, own, cuts in pieces(data, bounds)] or [np.zeros(0)])
            yield batch.select(["doc_id", "held_out"]).append_column("score", pa.array(score, pa.float64())).append_column("predicted", pa.array((score >= limit).astype(np.int32)))

    return apply


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, left_out: int = 0, limit: float = 0.5) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted (1 if score >= limit).

    Scores depend on the text alone. Null and empty texts have no terms, so their score is the base rate's;
    repeated rows are scored each; an empty table gives no rows.
    """
    model = learn(docs, labels, "toxic", id_col, text_col, modulus, left_out)
    own = texts(docs, id_col, text_col).withColumn("held_out", remainder(modulus) == left_out)
    return own.mapInArrow(_scored(model, limit), "doc_id long, held_out boolean, score double, predicted int")
