"""Substring dedup by level-wise doubling.

A window of `window` words is removed where its words start anywhere else too. Windows are found level
by level: short seeds first, and only runs that are repeated at one length are extended to twice that length,
to either side, until they are half a window; then the windows around what survives are asked for. Seeds are
chosen by content (in every window the one with the least hash), so equal windows have equal seeds and few
positions are shuffled at the first level. A level without survivors asks for nothing.

Every window holds a chosen seed, and of a run that it holds one of the two extensions to half its length or
less; so a repeated window is met at every level.

A level asks one question of many hashes: which are there more than once? Each batch answers for what it
holds twice itself and sends every other hash once, so a passage that a third of all documents share is
sent once a batch, not once a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Tables, parts_for, texts, told_apart
from .words import U, column, find, grams, mix, pieces, starts

#: Words of a seed, at most.
SEED = 12
#: part: the hashes' share of the work; hashes, rows, places: packed 64-bit, 64-bit and 32-bit numbers; checks: further 64
#: bits of each hash, where an answer decides what is removed, else null; sure: 1 where the
#: sender has the hash twice, and nobody waits for an answer. Without hashes it is no question: rows and places of a
#: block that are certain already.
ASK = "part int, block int, hashes binary, checks binary, rows binary, places binary, sure binary"
ASK_TABLE = pa.schema([("part", pa.int32()), ("block", pa.int32()), *((c, pa.binary()) for c in ("hashes", "checks", "rows", "places", "sure"))])
#: Of the documents of one block: packed 64-bit numbers of documents and, for each, a 32-bit place.
FOUND = "block int, rows binary, places binary"


def _packed(row: np.ndarray, place: np.ndarray, blocks: int) -> pa.RecordBatch:
    """FOUND rows, one a block."""
    block = row % blocks
    order = np.lexsort((row, block))
    block, row, place = block[order], row[order], place[order].astype(np.int32)
    at = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
    cuts = list(zip(at, [*at[1:], len(row)], strict=True))
    return pa.record_batch({"block": pa.array(block[at], pa.int32()), **{k: pa.array([x[a:z].tobytes() for a, z in cuts], pa.binary()) for k, x in (("rows", row), ("places", place))}})


class Asking:
    """Gathers hashes of one task until there are enough of them, then yields asks, and keeps what is certain already."""

    def __init__(self, parts: int, enough: int = 1 << 20):
        self.parts, self.enough, self.held, self.n = parts, enough, [], 0

    def add(self, hashes: np.ndarray, rows: np.ndarray, places: np.ndarray, checks: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        self.held.append((hashes, rows, places.astype(np.int32), np.zeros(0, U) if checks is None else checks))
        self.n += len(hashes)
        if self.n >= self.enough:
            yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        hashes, rows, places, checks = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        checked = len(checks) == len(hashes)
        order, at = _runs(hashes, checks if checked else None)
        hashes, rows, places = hashes[order], rows[order], places[order]
        many = np.diff(np.append(at, len(hashes))) > 1
        twice = np.repeat(many, np.diff(np.append(at, len(hashes))))
        if twice.any():
            yield _certain(_packed(rows[twice], places[twice], self.parts))
        part = (mix(hashes[at] + U(7)) % U(self.parts)).astype(np.int32)
        by_part = np.argsort(part, kind="stable")
        part = part[by_part]
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        own = [by_part[a:z] for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(part)], strict=True)]
        packed = [pa.array([x[i].tobytes() for i in own], pa.binary()) for x in (hashes[at], checks[order][at] if checked else checks, rows[at], places[at], many) if len(x)]
        if not checked:
            packed.insert(1, pa.nulls(len(own), pa.binary()))
        yield pa.record_batch([pa.array(part[cut], pa.int32()), pa.nulls(len(own), pa.int32()), *packed], ASK_TABLE.names)


def _runs(hashes: np.ndarray, checks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The order of hashes, and where in it each run of equal ones (checks included) begins."""
    order = np.argsort(hashes, kind="stable") if checks is None else np.lexsort((checks, hashes))
    new = np.ones(len(order), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    if checks is not None:
        new[1:] |= checks[order][1:] != checks[order][:-1]
    return order, np.flatnonzero(new)


def _certain(found: pa.RecordBatch) -> pa.RecordBatch:
    none = pa.nulls(len(found), pa.binary())
    return pa.record_batch([found.column("block"), found.column("block"), none, none, found.column("rows"), found.column("places"), none], ASK_TABLE.names)


def _answers(blocks: int):
    """Within one task: of each part's hashes, where those stand that are there twice."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple]] = {}
        for batch in batches:
            yield batch.filter(pc.is_null(batch.column("hashes"))).select(["block", "rows", "places"])
            asked = batch.filter(pc.is_valid(batch.column("hashes")))
            for k, *x in zip(*(asked.column(c).to_pylist() for c in ("part", "hashes", "checks", "rows", "places", "sure")), strict=True):
                parts.setdefault(k, []).append(tuple(x))
        for k in list(parts):
            got = parts.pop(k)
            hashes, checks, rows, places, sure = (np.frombuffer(b"".join(x[i] or b"" for x in got), kind) for i, kind in enumerate((U, U, np.int64, np.int32, bool)))
            order, at = _runs(hashes, checks if len(checks) else None)
            n = np.diff(np.append(at, len(hashes)))
            again = np.repeat((n > 1) | np.logical_or.reduceat(sure[order], at), n) & ~sure[order]
            if again.any():
                yield _packed(rows[order][again], places[order][again], blocks)

    return apply


def answered(asked: DataFrame, parts: int) -> DataFrame:
    """FOUND rows of the hashes that are asked about and are there more than once; a block may have several rows."""
    return asked.repartition(parts, "part").mapInArrow(_answers(parts), FOUND)


def _least(seeds: np.ndarray, width: int) -> np.ndarray:
    """For each run of width hashes, where its least stands (of equals the last), by doubling."""
    value, place, length = seeds, np.arange(len(seeds)), 1
    while length < width:
        step = min(length, width - length)
        a, b = value[: len(value) - step], value[step:]
        later = b <= a
        value, place = np.where(later, b, a), np.where(later, place[step:], place[: len(place) - step])
        length += step
    return place


def _seeds(window: int, seed: int, parts: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking = Asking(parts)
        for batch in batches:
            data, bounds = column(batch)
            ids = batch.column("row").to_numpy()
            for a, z, own, cuts in pieces(data, bounds):
                words = find(own, cuts)
                at = starts(words, window)
                if not len(at):
                    continue
                short = grams(words.hash, seed)
                chosen = np.unique(_least(short, window - seed + 1)[at])
                of = np.searchsorted(words.first, chosen, "right") - 1
                yield from asking.add(short[chosen], ids[a:z][of], chosen - words.first[of])
        yield from asking.send()

    return apply


class Places:
    """By document, the distinct places of all FOUND rows of its block, ascending."""

    def __init__(self, found: pa.Table):
        rows, places = (np.frombuffer(b"".join(found.column(c).to_pylist()), kind) for c, kind in (("rows", np.int64), ("places", np.int32)))
        order = np.lexsort((places, rows))
        rows, places = rows[order], places[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (places[1:] != places[:-1])
        self.rows, self.places = rows[new], places[new]

    def of(self, row: int) -> np.ndarray:
        a, z = np.searchsorted(self.rows, [row, row + 1]) if row < np.iinfo(np.int64).max else (np.searchsorted(self.rows, row), len(self.rows))
        return self.places[a:z]


def _with_places(docs: pa.Table, found: pa.Table):
    """Pieces of a block's documents (bytes, bounds, words), with each document's number in the piece, row and places."""
    places = Places(found)
    data, bounds = column(docs)
    rows = docs.column("row").to_pylist()
    for a, z, own, cuts in pieces(data, bounds):
        yield own, cuts, find(own, cuts), [(k - a, rows[k], places.of(rows[k])) for k in range(a, z)]


def lengths(window: int) -> list[int]:
    """Lengths of the levels below the window: each is twice the one before or one less, the last half the window, rounded up."""
    out = [-(-window // 2)]
    while out[0] > SEED:
        out.insert(0, -(-out[0] // 2))
    return out


def _doubled(length: int, longer: int, parts: int):
    """The runs of `longer` words that start or end with a repeated run of `length` words."""

    def apply(docs: pa.Table, found: pa.Table) -> pa.Table:
        asking, out = Asking(parts), []
        for _, _, words, each in _with_places(docs, found):
            runs = grams(words.hash, longer)
            for k, row, place in each:
                at = np.unique(np.concatenate((place, place + (length - longer))))
                at = at[(at >= 0) & (at + longer <= words.counts[k])]
                out += asking.add(runs[words.first[k] + at], np.full(len(at), row), at)
        return pa.Table.from_batches([*out, *asking.send()], ASK_TABLE)

    return apply


def _windows(window: int, length: int, parts: int):
    """All windows that hold a repeated run of `length` words, asked about with 128 bits."""

    def apply(docs: pa.Table, found: pa.Table) -> pa.Table:
        asking, out = Asking(parts), []
        for own, cuts, words, each in _with_places(docs, found):
            if not any(len(place) for _, _, place in each):
                continue
            whole = grams(words.hash, window)
            check = grams(find(own, cuts, lane=1).hash, window)
            for k, row, place in each:
                n = words.counts[k] - window + 1
                if n <= 0 or not len(place):
                    continue
                mark = np.zeros(n + 1, np.int32)
                np.add.at(mark, np.clip(place - (window - length), 0, n), 1)
                np.add.at(mark, np.clip(place + 1, 0, n), -1)
                at = np.flatnonzero(np.cumsum(mark)[:n] > 0)
                out += asking.add(whole[words.first[k] + at], np.full(len(at), row), at, check[words.first[k] + at])
        return pa.Table.from_batches([*out, *asking.send()], ASK_TABLE)

    return apply


KEPT = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.string()}


def _kept(window: int, keep_text: bool):
    def apply(docs: pa.Table, found: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in KEPT}
        for own, _, words, each in _with_places(docs, found):
            raw = own.tobytes()
            for k, _, place in each:
                n = int(words.counts[k])
                mark = np.zeros(n + 1, np.int32)
                np.add.at(mark, place, 1)
                np.add.at(mark, place + window, -1)
                stays = words.first[k] + np.flatnonzero(np.cumsum(mark)[:-1] == 0)
                kept = b" ".join([raw[s:e] for s, e in zip(words.start[stays].tolist(), words.end[stays].tolist(), strict=True)])
                out["n_words"].append(n)
                out["n_removed"].append(n - len(stays))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept_text"].append(kept.decode("utf-8", "replace") if keep_text else None)
        out["doc_id"] = docs.column("doc_id").to_pylist()
        return pa.table({c: pa.array(out[c], kind) for c, kind in KEPT.items() if keep_text or c != "kept_text"})

    return apply


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, keep_text: bool = True, part_bytes: int = 64 << 20) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Every word goes that is covered by a window of `window`
    words (2 at least) which also starts elsewhere, in another document or the same. A null text has no
    words; texts shorter than the window stay whole; of repeated rows, each repeats the other. An empty
    table gives no rows. Windows are compared by 128 bits of hashes of their words. part_bytes: text that
    one task may hold.
    """
    if window < 2:
        raise ValueError("window must be 2 or more")
    rows = told_apart(texts(docs, id_col, text_col), Tables(docs.sparkSession))
    parts = parts_for(rows, part_bytes)
    by_block = rows.withColumn("block", F.pmod("row", F.lit(parts)).cast("int")).groupBy("block")  # one exchange, which the steps below share

    def with_found(found: DataFrame, step: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        return by_block.cogroup(found.groupBy("block")).applyInArrow(step, schema)

    levels = lengths(window)
    found = answered(rows.select("row", "text").mapInArrow(_seeds(window, levels[0], parts), ASK), parts)
    for length, longer in pairwise(levels):
        found = answered(with_found(found, _doubled(length, longer, parts), ASK), parts)
    found = answered(with_found(found, _windows(window, levels[-1], parts), ASK), parts)
    return with_found(found, _kept(window, keep_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)


#: doc_id, n_words, n_removed, kept_sha256 by DuckDB: all windows as texts, and the words that repeated ones cover.
REPEATS_SQL = r"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from {documents}),
windows as (select doc_id, unnest(range(1, len(w) - {window} + 2)) as k, w from words where len(w) >= {window}),
told as (select doc_id, k, count(*) over (partition by md5(array_to_string(w[k : k + {window} - 1], ' '))) as times from windows),
gone as (select distinct doc_id, k + i as k from told, range({window}) t(i) where times > 1),
each as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from words),
kept as (select e.doc_id, count(*) as n, string_agg(e.word, ' ' order by e.k) as text from each e anti join gone g on g.doc_id = e.doc_id and g.k = e.k group by e.doc_id)
select doc_id, len(w)::bigint as n_words, len(w)::bigint - coalesce(n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from words left join kept using (doc_id)"""
