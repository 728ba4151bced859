"""A quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is good or bad. Its features are its own, and its neighbours', measures of form (length, share
of capitals, symbols, repeats and so on, never words), and neighbouring labels are tied. Forward-backward
gives each line's chance of being good; the mean of these, weighted by length, is the text's quality.

The field is fitted on a bounded sample of labelled documents, whose lines all take their document's label;
every document weighs the same, whatever its number of lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import labelled
from .store import Tables, remainder, texts
from .words import U, column, find, mix, pieces

#: Labelled documents to fit on, at most, those with the least hash of their id, and lines of all of them. Rounds and rate of the fit.
SAMPLE, LINES, ROUNDS, RATE = 4000, 1 << 18, 150, 0.15

_CLASSES = {
    "upper": lambda c: "A" <= c <= "Z",
    "lower": lambda c: "a" <= c <= "z",
    "digit": lambda c: c.isdigit() and c < "\x80",
    "bar": lambda c: c == "|",
    "bang": lambda c: c == "!",
    "symbol": lambda c: c in "#$%&*@^~_=+<>{}[]\\/`",
    "point": lambda c: c in ".,;:'\"()-?",
    "other": lambda c: c >= "\x80",
}
_TABLES = np.array([[f(chr(b)) for b in range(256)] for f in _CLASSES.values()])
_NAMES = list(_CLASSES)


def lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts, their lengths in bytes, and where each text's lines begin; a text has one line at least."""
    breaks = np.flatnonzero(data == 10)
    of = np.searchsorted(bounds, breaks, "right") - 1
    n_lines = np.bincount(of, minlength=len(bounds) - 1) + 1
    first = np.concatenate(([0], np.cumsum(n_lines)))
    start, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    is_first, is_last = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
    is_first[first[:-1]], is_last[first[1:] - 1] = True, True
    start[is_first], start[~is_first] = bounds[:-1], breaks + 1
    end[is_last], end[~is_last] = bounds[1:], breaks
    length = end - start

    def within(marks: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(marks, out=sums[1:], dtype=np.int32)
        return sums[end] - sums[start]

    count = dict(zip(_NAMES, (within(t[data]) for t in _TABLES), strict=True))
    words = find(data, bounds, fold=True)
    line_of = np.searchsorted(start, words.start, "right") - 1
    n_words = np.bincount(line_of, minlength=len(start))
    again = np.zeros(len(words.hash), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (line_of[1:] == line_of[:-1])
    repeats = np.bincount(line_of, again, len(start))
    # lines of two words and more that stand in their text more than once
    sums = np.zeros(len(words.hash) + 1, U)
    np.cumsum(mix(words.hash + U(1)), out=sums[1:])
    upto = np.concatenate(([0], np.cumsum(n_words)))
    content = mix(sums[upto[1:]] - sums[upto[:-1]]) + np.repeat(mix(np.arange(len(n_lines), dtype=U)), n_lines)
    _, which, times = np.unique(content, return_inverse=True, return_counts=True)
    twice = (times[which] > 1) & (n_words > 1)
    full, letters = np.maximum(length, 1), np.maximum(count["upper"] + count["lower"], 1)
    closing = np.zeros(len(start), bool)
    some = length > 0
    closing[some] = np.isin(data[end[some] - 1], np.frombuffer(b".!?:", np.uint8))
    features = np.stack(
        [
            np.log1p(length), np.log1p(n_words), length / np.maximum(n_words, 1) / 10, count["upper"] / letters, count["upper"] / letters > 0.7,
            count["digit"] / full, 5 * count["bar"] / full, 5 * count["bang"] / full, 5 * count["symbol"] / full, 5 * count["point"] / full,
            count["other"] / full, repeats / np.maximum(n_words, 1), repeats / np.maximum(n_words, 1) > 0.2, twice, closing, length == 0,
        ],
        1,
    ).astype(np.float64)
    return features, length, first


def with_neighbours(features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and of the line after (zeros where there is none), whether there is none, and one."""
    edge = np.zeros((len(features), 3))
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    before[first[:-1]], after[first[1:] - 1] = 0, 0
    edge[first[:-1], 0], edge[first[1:] - 1, 1], edge[:, 2] = 1, 1, 1
    return np.hstack([features, before, after, edge])


def _steps(first: np.ndarray) -> Iterator[np.ndarray]:
    """For each position in a text, the lines there: texts by falling length, so those that go on come first."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, n = first[:-1][order], n[order]
    for t in range(int(n[0]) if len(n) else 0):
        yield begin[: np.searchsorted(-n, -t, "left")] + t


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(good: np.ndarray, ties: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """good: each line's score for good (for bad it is 0). Log chances of good and of each pair of labels (line, line after: 4), and log totals by text."""
    own = np.stack([np.zeros_like(good), good], 1)
    forward, backward = own.copy(), np.zeros_like(own)
    steps = list(_steps(first))
    for at in steps[1:]:
        ahead = forward[at - 1]
        forward[at] += _log_add(ahead[:, :1] + ties[0], ahead[:, 1:] + ties[1])
    for at in reversed(steps[1:]):
        behind = own[at] + backward[at]
        backward[at - 1] = _log_add(behind[:, :1] + ties[:, 0], behind[:, 1:] + ties[:, 1])
    last = first[1:] - 1
    total = _log_add(forward[last, 0], forward[last, 1])
    each = np.repeat(total, np.diff(first))
    pairs = np.full((len(good), 2, 2), -np.inf)
    inner = np.ones(len(good), bool)
    inner[last] = False
    at = np.flatnonzero(inner)
    pairs[at] = forward[at][:, :, None] + ties + (own + backward)[at + 1][:, None, :] - each[at][:, None, None]
    return forward[:, 1] + backward[:, 1] - each, pairs, total


def fit(features: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Weights by gradient ascent (Adam) on the conditional likelihood of all lines' labels, a text's divided by its lines; label: of each text."""
    mean, spread = features.mean(0), features.std(0) + 1e-6
    x = with_neighbours((features - mean) / spread, first)
    y = np.repeat(label, np.diff(first)).astype(float)
    share = np.repeat(1 / np.diff(first), np.diff(first))
    pair_n = np.zeros((2, 2))
    inner = np.ones(len(y), bool)
    inner[first[1:] - 1] = False
    for k in (0, 1):
        pair_n[k, k] = share[inner][y[inner] == k].sum()
    weights, ties = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    for t in range(1, ROUNDS + 1):
        chance, pairs, _ = marginals(x @ weights, ties, first)
        own, two = x.T @ (share * (y - np.exp(chance))), (share[inner, None, None] * np.exp(pairs[inner])).sum(0)
        slope = np.concatenate([own - 0.1 * weights, (pair_n - two - 0.1 * ties).ravel()]) / max(len(label), 1)
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        move = RATE * (1 - t / (ROUNDS + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        weights, ties = weights + move[:-4], ties + move[-4:].reshape(2, 2)
    return {"mean": mean, "spread": spread, "weights": weights, "ties": ties}


def quality(features: np.ndarray, length: np.ndarray, first: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    x = with_neighbours((features - model["mean"]) / model["spread"], first)
    chance, *_ = marginals(x @ model["weights"], model["ties"], first)
    weight = length + 1.0
    return np.clip(np.add.reduceat(np.exp(chance) * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]), 0, 1)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, left_out: int = 2, sample: int = SAMPLE, most_lines: int = LINES) -> dict[str, np.ndarray]:
    """The model, from at most `sample` labelled documents of at most `most_lines` lines, as sampling.labelled() chooses them.

    Without any labelled document the model scores every text 0.5.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = column(batch)
            for a, z, own, cuts in pieces(data, bounds):
                features, _, first = lines(own, cuts)
                rows = [x.tobytes() for x in np.split(features, first[1:-1])]
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(a, z - a), "label": batch.column("label").slice(a, z - a), "features": pa.array(rows, pa.binary())})

    tables, n_lines = Tables(docs.sparkSession), F.regexp_count("text", F.lit("\n")) + 1
    chosen = labelled(docs, labels, label, id_col, text_col, modulus, left_out, sample, n_lines, most_lines, tables)
    got = sorted(chosen.mapInArrow(measured, "doc_id long, label int, features binary").toLocalIterator(), key=lambda r: r.doc_id)
    tables.drop(*[t for t, _ in tables.written])
    width = lines(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0].shape[1]
    if not got:
        return {"mean": np.zeros(width), "spread": np.ones(width), "weights": np.zeros(3 * width + 3), "ties": np.zeros((2, 2))}
    each = [np.frombuffer(r.features).reshape(-1, width) for r in got]
    return fit(np.concatenate(each), np.concatenate(([0], np.cumsum([len(e) for e in each]))), np.array([r.label for r in got]))


def _scored(model: dict[str, np.ndarray], limit: float):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = column(batch)
            score = np.concatenate([quality(*lines(own, cuts), model) for _, _, own, cuts in pieces(data, bounds)] or [np.zeros(0)])
            keep = [c for c in batch.schema.names if c != "text"]
            yield batch.select(keep).append_column("score", pa.array(score, pa.float64())).append_column("predicted", pa.array((score >= limit).astype(np.int32)))

    return apply


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, left_out: int = 2, limit: float = 0.7) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted (1 if score >= limit).

    Scores depend on the text alone. Null and empty texts are one empty line; repeated rows are scored each;
    an empty table gives no rows.
    """
    model = learn(docs, labels, "quality", id_col, text_col, modulus, left_out)
    own = texts(docs, id_col, text_col).withColumn("held_out", remainder(modulus) == left_out)
    return own.mapInArrow(_scored(model, limit), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, left_out: int = 2, limit: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, whose text scores limit or more; nothing is shuffled."""
    model = learn(docs, labels, "quality", id_col, text_col, modulus, left_out)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        data, bounds = column(pa.record_batch({"text": pa.array(text, pa.string())}))
        return pd.Series(np.concatenate([quality(*lines(own, cuts), model) for _, _, own, cuts in pieces(data, bounds)] or [np.zeros(0)]))

    return docs.where(score(F.coalesce(docs[text_col], F.lit(""))) >= limit)
