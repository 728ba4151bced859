"""Alignment of two tokenizers over a corpus: which tokens of one overlap which of the other, and how often.

Both tokenizers cover the same bytes, so a document's alignment is a merge of its two ascending lists of token
ends: between one end and the next lies one overlap of one token of either, a link; where both have an end, a
group closes. The merge runs on Arrow batches (as mapInPandas would, but null ids stay whole numbers), for all
documents of a batch at once.

A batch is a block. It names each distinct pair of ids once, with how often its own documents link it; Spark
adds these up by pair, takes the maxima of either side, and joins both back to the blocks that named the pair.
So a pair that all documents have is sent once a block, not once a link.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Tables, texts

#: Byte-level BPE splits a text by this before it merges (a fixed value).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Stretches of text between spaces whose pieces a worker remembers, and how long such a stretch may be.
REMEMBERED, STRETCH = 1 << 18, 64


def byte_of_letter() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others in order from U+0100 on (fixed values)."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """Ids of texts by a byte-level BPE file of the tokenizers library, special tokens' strings being plain text.

    Where the file's merges are in the order of their ids, texts are encoded by tiktoken, several times as
    fast, with the same ids as long as both libraries sort a text's characters (letters, numbers, blanks,
    others) alike; each character is tried once, and texts with one that they sort differently go through the file's own library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        letters = byte_of_letter()
        ranks = {bytes(letters[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
        self.bytes = [b""] * (max(ranks.values()) + 1 + len(special))
        for token, k in ranks.items():
            self.bytes[k] = token
        merged = [spec["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.fast = None
        if plain and merged == sorted(merged) and len(merged) + 256 == len(ranks):
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.alike: dict[str, bool] = {}

    def encode(self, some: list[str]) -> list[np.ndarray]:
        slow = range(len(some))
        out: list = [None] * len(some)
        if self.fast:
            seen = [set(t) for t in some]
            new = sorted(set().union(*seen) - self.alike.keys())
            tried = [f"a{c}a 1{c}1 .{c}. {c} {c}{c}\n{c}" for c in new]
            self.alike |= {c: x.ids == self.fast.encode_ordinary(t) for c, t, x in zip(new, tried, self.own.encode_batch_fast(tried, add_special_tokens=False), strict=True)}
            odd = {c for c, same in self.alike.items() if not same}
            slow = [k for k, chars in enumerate(seen) if not odd.isdisjoint(chars)]
            for k in set(range(len(some))).difference(slow):
                out[k] = np.array(self.fast.encode_ordinary(some[k]), np.int64)
        for k, x in zip(slow, self.own.encode_batch_fast([some[k] for k in slow], add_special_tokens=False), strict=True):
            out[k] = np.array(x.ids, np.int64)
        return out


class Pieces:
    """Ids of texts by a sentencepiece model that puts a space before a text.

    Where no piece has a space after something else, a text falls apart before its spaces, and the stretches
    are remembered: words repeat, and are then encoded once a worker.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.own = SentencePieceProcessor(model_file=path)
        names = [self.own.id_to_piece(k) for k in range(self.own.get_piece_size())]
        self.bytes = [bytes.fromhex(n[3:5]) if self.own.is_byte(k) else b"" if self.own.is_control(k) or self.own.is_unknown(k) else n.replace("▁", " ").encode() for k, n in enumerate(names)]
        self.apart = not any("▁" in n.lstrip("▁") for n in names)
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, some: list[str]) -> list[np.ndarray]:
        if not self.apart:
            return [np.array(x, np.int64) for x in self.own.encode(some, num_threads=1)]
        each = [[s[1:] for s in re.findall(" +[^ ]*", f" {t}")] for t in some]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = sorted(set(chain.from_iterable(each)) - self.known.keys())
        got = dict(zip(new, map(tuple, self.own.encode(new, num_threads=1)), strict=True))
        got |= {"": (self.own.piece_to_id("▁"),)}  # one space at the end of a text, which alone would be no text
        known = self.known | got if len(got) * 4 > len(self.known) else self.known
        self.known |= {s: x for s, x in got.items() if len(s) <= STRETCH}
        if known is not self.known:
            return [np.fromiter(chain.from_iterable(map(known.__getitem__, own)), np.int64) for own in each]
        return [np.fromiter(chain.from_iterable(got[s] if s in got else self.known[s] for s in own), np.int64) for own in each]


_loaded: dict[tuple[type, str], object] = {}


def _tokenizer(kind: type, path: str):
    """One a worker process."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def merged(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two ascending lists of ends that have the last in common: for each link its place in either list, and the ends in common.

    The two-pointer merge: as ends pass in order, either pointer stands at the token whose end is still to come.
    """
    ends = np.concatenate((ends_a, ends_b))
    ends.sort(kind="stable")  # merges two runs
    both = ends[1:] == ends[:-1]
    ends, common = ends[np.append(~both, True)[: len(ends)]], ends[1:][both]
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends), common


def _names(n: int) -> list[str]:
    """Each id in decimals, before a further one of its side, a change of sides, a new group, and the end."""
    return [f"{k}{sign}" for k in range(n) for sign in (",", "|", ";", "")]


class Aligner:
    """Aligns texts of one batch."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = _tokenizer(ByteLevel, path_a), _tokenizer(Pieces, path_b)
        self.sizes = [np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b)]
        self.names = _names(max(map(len, self.sizes)))

    def _covers(self, tokenizer, ids: np.ndarray, raw: bytes) -> bool:
        return b"".join(map(tokenizer.bytes.__getitem__, ids.tolist())) == raw

    def __call__(self, some: list[str]) -> dict[str, list | np.ndarray]:
        """n_a, n_b, n_groups, n_links, groups_sha256 by text; links: number of the text, id of A, id of B, text by text."""
        full = [" " + t for t in some]
        # (ids of a text that isn't covered stay empty: it takes no part)
        ids = [[np.zeros(0, np.int64)] * len(some) for _ in "ab"]
        asked = [k for k, t in enumerate(some) if t]
        for k, x, y in zip(asked, self.a.encode([full[k] for k in asked]), self.b.encode([some[k] for k in asked]), strict=True):
            raw = full[k].encode()
            if self._covers(self.a, x, raw) and self._covers(self.b, y, raw):
                ids[0][k], ids[1][k] = x, y
        n = [np.array([len(x) for x in side], np.int64) for side in ids]
        a, b = (np.concatenate(side or [np.zeros(0, np.int64)]) for side in ids)
        ends = [np.cumsum(size[x]) for size, x in zip(self.sizes, (a, b), strict=True)]
        at_a, at_b, common = merged(*ends)
        last = np.cumsum(n[0]) - 1  # of each text's tokens of A
        text_of = np.repeat(np.arange(len(some)), n[0])[at_a]
        n_links = np.bincount(text_of, minlength=len(some))
        return {"n_a": n[0], "n_b": n[1], "n_links": n_links, "n_groups": n[0] + n[1] - n_links, "groups_sha256": self._digests(a, b, *ends, common, n, last), "text": text_of, "a": a[at_a], "b": b[at_b]}

    def _digests(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, common: np.ndarray, n: list[np.ndarray], last: np.ndarray) -> list[str]:
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        sign_a, sign_b = (ends_a == common[group_a]).astype(np.int64), 2 * (ends_b == common[group_b]).astype(np.int64)
        sign_b[(np.cumsum(n[1]) - 1)[n[1] > 0]] = 3
        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        code = np.concatenate((4 * a + sign_a, 4 * b + sign_b))[order].tolist()
        out, at = [], 0
        for size in (n[0] + n[1]).tolist():
            out.append(hashlib.sha256("".join(map(self.names.__getitem__, code[at : at + size])).encode()).hexdigest() if size else "")
            at += size
        return out


#: One row a block. By text: doc_id to groups_sha256 and n_pairs; by distinct pair, ascending: pairs (id of A * factor + id of B), times.
#: held, many: for each text its pairs by place in `pairs`, and how often it links them, packed.
BLOCK = (
    "block long, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, n_pairs array<int>, "
    "pairs array<bigint>, times array<bigint>, held binary, many binary"
)
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
#: A row is a few MB of text.
WHOLE = 1 << 22


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about WHOLE bytes of text."""
    size = np.cumsum([len(t) for t in batch.column("text").to_pylist()]) // WHOLE
    cuts = np.flatnonzero(np.diff(size, prepend=-1)) if len(size) else []
    for a, z in zip(cuts, [*cuts[1:], len(size)], strict=True):
        yield batch.slice(int(a), int(z - a))


def _small(x: np.ndarray, limit: int) -> bytes:
    """Whole numbers below limit, in as few bytes as their type needs."""
    return x.astype(_kind(limit)).tobytes()


def _kind(limit: int) -> type:
    return np.uint8 if limit <= 1 << 8 else np.uint16 if limit <= 1 << 16 else np.uint32


def _aligned(path_a: str, path_b: str, factor: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner(path_a, path_b)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in _parts(batch):
                got = align(part.column("text").to_pylist())
                pairs, at, times = np.unique(got["a"] * factor + got["b"], return_inverse=True, return_counts=True)
                own, many = np.unique(got["text"] * max(len(pairs), 1) + at, return_counts=True)
                n_pairs = np.bincount(own // max(len(pairs), 1), minlength=len(part))
                one = lambda x, kind: pa.array([x], pa.list_(kind))
                # how often comes in one byte, those from 255 on once more after them
                packed = np.minimum(many, 255).astype(np.uint8).tobytes() + many[many >= 255].astype(np.uint32).tobytes()
                yield pa.record_batch(
                    {
                        "block": pa.array([block], pa.int64()),
                        "doc_id": pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                        **{c: one(got[c], pa.int64()) for c in COUNTS},
                        "groups_sha256": one(got["groups_sha256"], pa.string()),
                        "n_pairs": one(n_pairs.astype(np.int32), pa.int32()),
                        "pairs": one(pairs, pa.int64()),
                        "times": one(times, pa.int64()),
                        "held": pa.array([_small(own % max(len(pairs), 1), len(pairs))], pa.binary()),
                        "many": pa.array([packed], pa.binary()),
                    }
                )
                block += 1

    return apply


DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_best_a long"


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with what all documents together say of their pairs, to documents."""
    for batch in batches:
        for k in range(len(batch)):
            row = {c: batch.column(c)[k] for c in batch.schema.names}
            flat = lambda c, row=row: row[c].values
            n_pairs = flat("n_pairs").to_numpy()
            held = np.frombuffer(row["held"].as_py(), _kind(len(flat("pairs"))))
            raw = row["many"].as_py()
            many = np.frombuffer(raw, np.uint8, len(held)).astype(np.int64)
            many[many == 255] = np.frombuffer(raw[len(held) :], np.uint32)
            of = np.repeat(np.arange(len(n_pairs)), n_pairs)
            if len(held):
                told = row["told"].values
                order = np.argsort(told.field("idx").to_numpy())
                count, best_a, best_b = (told.field(c).to_numpy(zero_copy_only=False)[order][held].astype(np.int64) for c in ("count", "best_a", "best_b"))
            else:
                count = best_a = best_b = many

            def by_text(x: np.ndarray, of=of, n=len(n_pairs)) -> pa.Array:
                out = np.zeros(n, np.int64)
                np.add.at(out, of, x)
                return pa.array(out)

            yield pa.record_batch(
                [flat("doc_id"), *(flat(c) for c in COUNTS), by_text(many * best_b), by_text(many * count), flat("groups_sha256"), by_text(many * best_a)],
                ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256", "n_best_a"],
            )


def pair_counts(blocks: DataFrame, factor: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the blocks (block, idx, pair), and by pair: count (over all documents), best_a and best_b (no pair of the same id of A, or B, has more)."""
    named = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("idx", "p")).select("block", "idx", F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))
    counts = named.groupBy("pair").agg(F.sum("n").alias("count"))
    counts = counts.select("pair", "count", F.floor(F.col("pair") / factor).alias("a"), (F.col("pair") % factor).alias("b"))
    for side in ("a", "b"):
        counts = counts.join(counts.groupBy(side).agg(F.max("count").alias(f"most_{side}")), side)
    return named.drop("n"), counts.select("pair", "a", "b", "count", *[(F.col("count") == F.col(f"most_{s}")).alias(f"best_{s}") for s in ("a", "b")])


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", factor: int = 1 << 17) -> DataFrame:
    """One row a document: DOCUMENT. path_a: a byte-level BPE file, path_b: a sentencepiece model with fewer than `factor` pieces.

    A encodes a space and the text, B the text, before which it puts a space itself. n_groups: the parts into which common
    ends cut both lists; n_links: pairs of tokens whose bytes overlap. A pair of ids counts how many links have it, over all documents;
    count_sum adds this up over a document's links, n_best and n_best_a are its links whose count no other pair of
    the same id of B, or of A, exceeds. groups_sha256 digests the groups as text.

    Texts that are null, empty, or whose tokens don't give back their bytes have no tokens: zeros, and '' for
    the digest. Rows without an id, of one id, and repeated rows are each a document. Other columns don't matter. An empty table gives no rows.
    """
    with Tables(docs.sparkSession) as tables:
        blocks = tables.cut(texts(docs, id_col, text_col).mapInArrow(_aligned(path_a, path_b, factor), BLOCK))
        named, counts = pair_counts(blocks, factor)
        counts = tables.cut(counts)
        told = named.join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("idx", "count", "best_a", "best_b")).alias("told"))
        return blocks.drop("times").join(told, "block", "left").mapInArrow(_told, DOCUMENT)
