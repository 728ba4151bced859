"""Document fingerprints by content-defined chunking.

A gear hash of the bytes before it marks where a chunk may end, so a chunk's bounds depend on its own
content and an insertion moves only the chunks around it. Boundaries are normalised: marks must be rarer
ones before the usual length and may be commoner ones after it. A fingerprint is the set of a text's chunk
digests with their lengths; how much of one text another contains is the shared share of length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import partitions, texts
from .words import mix

#: Bytes of the shortest, the usual and the longest chunk; bits a mark must have before and after the usual length.
LEAST, USUAL, MOST, RARE, COMMON = 12, 32, 128, 6, 4
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def ends(data: bytes) -> list[int]:
    """Where the chunks of a text end."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    # gear hash of the 32 bytes up to each: the sum of their values, each shifted by how far back it stands, by doubling
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        later = h[k:] + (h[:-k] << np.uint32(k))
        h = np.concatenate((h[:k], later))
    top = h >> np.uint32(32 - RARE)
    common = np.flatnonzero(top >> np.uint32(RARE - COMMON) == 0)
    is_rare = top[common] == 0
    at, out = 0, []
    marks, rare = (common + 1).tolist(), (common[is_rare] + 1).tolist()
    i = j = 0
    while n - at > LEAST:
        while i < len(rare) and rare[i] < at + LEAST:
            i += 1
        if i < len(rare) and rare[i] <= at + USUAL:
            at = rare[i]
        else:
            while j < len(marks) and marks[j] <= at + USUAL:
                j += 1
            at = min(marks[j] if j < len(marks) else n, at + MOST, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def chunks(data: bytes) -> dict[str, int]:
    """Digest (12 hex digits) and bytes of each distinct chunk."""
    out, at = {}, 0
    for end in ends(data):
        out[xxhash.xxh3_64_hexdigest(data[at:end])[:12]] = end - at
        at = end
    return out


def written(fingerprint: dict[str, int]) -> str:
    return " ".join(f"{d}:{n}" for d, n in sorted(fingerprint.items()))


def containment(a: dict[str, int], b: dict[str, int]) -> float:
    """The share of a's length that b has too; two empty fingerprints contain each other."""
    if not a or not b:
        return float(not a and not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one bucket come together and in order; a row whose own is false is only there as the one after."""
    held: tuple | None = None
    out: list[tuple] = []

    def result(now: tuple, after: tuple) -> tuple:
        text = now[2]
        half = len(text) // 2
        edited = (text[: len(text) - half] + after[2][:half]).encode()
        print_ = chunks(edited)
        return (
            now[1], len(text), hashlib.sha256(edited).hexdigest(), written(now[3]), written(print_), containment(now[3], print_), containment(now[3], after[3]),
        )

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        return pa.record_batch([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for bucket, doc, text, own in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "text", "own")), strict=True):
            if held and not held[4] and bucket == held[0]:
                continue  # only the first of those that follow a bucket is the one after
            row = (bucket, doc, text, chunks(text.encode()), own)
            if held and held[4] and bucket == held[0]:
                out.append(result(held, row))
                if len(out) == 500:
                    yield batch_of(out)
                    out = []
            held = row
    if out:
        yield batch_of(out)


PRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bucket, doc_id, text, own: documents in ranges of ids, each range followed by the first document of the next (own false).

    What reaches the driver is one bound a range, and each range's first id.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = texts(docs, id_col, text_col).withColumn("place", F.coalesce("doc_id", F.lit(-(1 << 63))))  # null ids come first
    cuts = rows.select(F.percentile_approx("place", [k / n for k in range(1, n)], 10 * n)).head()[0] if n > 1 else None
    bounds = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def range_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, place.to_numpy(np.int64), "left").astype(np.int32))

    dealt = rows.withColumn("bucket", range_of("place"))
    first = dealt.groupBy("bucket").agg(F.min("place").alias("first")).orderBy("bucket").collect()
    firsts, there = np.array([r.first for r in first], np.int64), np.array([r.bucket for r in first], np.int32)
    before = np.roll(there, 1)  # the very first document also follows the last range

    @F.pandas_udf("array<int>")
    def needed_in(place: pd.Series, bucket: pd.Series) -> pd.Series:
        k = np.searchsorted(there, bucket.to_numpy(np.int32))
        leads = firsts[k] == place.to_numpy(np.int64)
        return pd.Series([[b, c] if lead else [b] for b, c, lead in zip(there[k].tolist(), before[k].tolist(), leads.tolist(), strict=True)])

    spread = dealt.select("doc_id", "text", "place", F.posexplode(needed_in("place", "bucket")).alias("copy", "bucket")).withColumn("own", F.col("copy") == 0)
    return spread.repartition(n, "bucket").sortWithinPartitions("bucket", "copy", "place", "text").select("bucket", "doc_id", "text", "own")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half of code points replaced by the first as many of the next document,
    ascending doc_id, after the last the first; a document alone is its own next. Null ids come first, and
    rows that share an id follow each other by text. A null or empty text has the fingerprint "" and contains
    only empty ones. near_edited and near_next say how much of the text's own length the other contains.
    """
    return neighbours(docs, id_col, text_col).mapInArrow(_compared, PRINTS)
