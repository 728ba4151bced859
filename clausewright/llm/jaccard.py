"""N-gram Jaccard join: documents that share most of their n-grams, by a blocked product of sparse incidences.

Think of a matrix with a row for each document and a column for each n-gram: the overlaps of all pairs are
its product with its own transpose. What can't matter is left out of it before any pair is formed, by bounds that
follow from sizes alone:

* Documents with equal sets are one row.
* A column of one row adds to no overlap. A linked row has at least its size times the threshold in common
  with another, so a row with fewer columns that others have, too, is done. Columns are counted by parts of
  their hashes, and a batch sends a column that it has twice once.
* Of rows that are left, ordered by how few rows have a column, two that are linked share one of their first
  columns (all but size times threshold, and one). Rows that share one of these are of one group.
* Groups are multiplied in tiles of bounded size, a block of columns at a time. Overlaps add up, and
  after each block pairs go that can't reach their bound with what either row has left.

All counts are of full sets; nothing is estimated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .near import TILE, WEIGHT, components, digests, joined, large_groups, shingle_sets, tiled
from .store import Tables, looked_up, partitions, parts_for, texts
from .words import U, column, mix, pieces

#: Columns multiplied at a time; n-grams that a task gathers before it sends them.
COLUMNS, ENOUGH = 4096, 1 << 19


def need(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with which sets of these sizes are linked."""
    return np.maximum(-(-percent * (a + b) // (100 + percent)), 1)


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets are linked, as a square, by the blocked product."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    least = need(size[:, None], size[None, :], percent)
    open_ = least <= np.minimum(size[:, None], size[None, :])
    np.fill_diagonal(open_, False)
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    # columns that one row alone has add nothing; of the others the rarest come first
    order = np.argsort(np.where(times > 1, times, len(at) + 1), kind="stable")[: (times > 1).sum()]
    place = np.full(len(values), -1)
    place[order] = np.arange(len(order))
    at = place[at]
    owner, at = owner[at >= 0], at[at >= 0]
    by_column = np.argsort(at, kind="stable")
    owner, at = owner[by_column], at[by_column]
    left = np.bincount(owner, minlength=n)
    overlap = np.zeros((n, n), np.float32)
    for k in range(0, len(order), COLUMNS):
        rows = np.flatnonzero(open_.any(1))
        if not len(rows):
            break
        i, j = np.searchsorted(at, [k, k + COLUMNS])
        row_of = np.full(n, -1)
        row_of[rows] = np.arange(len(rows))
        x = np.zeros((len(rows), min(COLUMNS, len(order) - k)), np.float32)
        own = row_of[owner[i:j]]
        x[own[own >= 0], at[i:j][own >= 0] - k] = 1
        square = np.ix_(rows, rows)
        overlap[square] += x @ x.T
        left -= np.bincount(owner[i:j], minlength=n)
        open_[square] &= overlap[square] + np.minimum(left[rows][:, None], left[rows][None, :]) >= least[square]
    return open_ & (overlap >= least)


def _classed(width: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, own, cuts in pieces(*column(batch)):
                sets, digest = digests(own, cuts, width)
                numbers = {"n_shingles": pa.array([len(s) for s in sets], pa.int64()), "d1": pa.array(digest[:, 0].view(np.int64)), "d2": pa.array(digest[:, 1].view(np.int64))}
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(a, z - a), **numbers})

    return apply


#: Of one sender, for a part of the columns: keys of rows, how many columns each asks about, and how many of its own the
#: sender has in two rows (packed 64, 32 and 32 bits); asked: columns row by row, known: those the sender has in two rows (32 bits of hash).
SENT = "part int, keys binary, n binary, sure binary, asked binary, known binary"
#: What parts tell of rows: keys (64 bits) and numbers of columns that others have, too, to be added up; rows are dealt by key into shares.
TOLD = "share int, keys binary, n binary"


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, of which the upper are mostly zero and cost a shuffle nothing."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class _Sender:
    """Gathers rows until there are enough, then sends their columns to the parts they belong to."""

    def __init__(self, parts: int):
        self.parts, self.held, self.n = parts, {}, 0

    def add(self, key: int, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        if key not in self.held:
            self.held[key] = own
            self.n += len(own)
        if self.n >= ENOUGH:
            yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        keys, sets = np.array(list(self.held), np.int64), list(self.held.values())
        self.held, self.n = {}, 0
        grams, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(grams)
        grams, row = grams[order], row[order]
        same = grams[1:] == grams[:-1]
        many = np.append(same, False) | np.append(False, same)
        spread = mix(grams + U(9))
        part, short = ((spread >> U(32)) % U(self.parts)).astype(np.int64), spread.astype(np.uint32)
        new = np.append(True, ~same)
        order = np.lexsort((row, part))
        part, row, short, many, new = part[order], row[order], short[order], many[order], new[order]
        begin = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
        sure = np.add.reduceat(many, begin, dtype=np.uint32)
        n = np.diff(np.append(begin, len(row))).astype(np.uint32) - sure
        cut = np.flatnonzero(np.diff(part[begin], prepend=-1))
        out: dict[str, list] = {c: [] for c in ("part", "keys", "n", "sure", "asked", "known")}
        for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(begin)], strict=True):
            here = slice(begin[a], begin[z] if z < len(begin) else len(row))
            out["part"].append(int(part[begin[a]]))
            for c, x in (("n", n[a:z]), ("sure", sure[a:z])):
                out[c].append(_planes(x))
            for c, x in (("keys", keys[row[begin[a:z]]]), ("asked", short[here][~many[here]]), ("known", short[here][many[here] & new[here]])):
                out[c].append(x.tobytes())
        yield pa.record_batch({c: pa.array(x, pa.int32() if c == "part" else pa.binary()) for c, x in out.items()})


def _sent(width: int, parts: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(parts)
        for batch in batches:
            for _, _, own, cuts in pieces(*column(batch)):
                for s in shingle_sets(own, cuts, width):
                    if len(s):
                        yield from sender.add(int(mix(s ^ U(0x11)).sum(dtype=U).view(np.int64)), s)
        yield from sender.send()

    return apply


def _shared(shares: int):
    """TOLD: how many columns of one part each row shares with others; rows that share none are left out. Messages of a part come together."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple]] = {}
        for batch in batches:
            for part, *x in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "n", "sure", "asked", "known")), strict=True):
                parts.setdefault(part, []).append(tuple(x))
        for part in list(parts):
            got = parts.pop(part)
            keys, asked, known = (np.frombuffer(b"".join(x[i] for x in got), kind) for i, kind in ((0, np.int64), (3, np.uint32), (4, np.uint32)))
            n, sure = (np.concatenate([_numbers(x[i]) for x in got]).astype(np.int64) for i in (1, 2))
            end = np.cumsum(n)
            order = np.argsort(asked).astype(np.uint32)
            values = asked[order]
            begin = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
            values, count = values[begin], np.diff(np.append(begin, len(values)))
            # of columns that several ask about, whether it is more than one row: copies of a row are one
            some, several = order[np.repeat(count > 1, count)], count[count > 1]
            hit = np.isin(values, known)
            if len(several):
                owner = keys[np.searchsorted(end, some, "right")]
                at = np.concatenate(([0], np.cumsum(several)[:-1]))
                hit[count > 1] |= np.logical_or.reduceat(owner != np.repeat(owner[at], several), at)
            shared = np.zeros(len(asked) + 1, np.int32)
            shared[1:][order] = np.repeat(hit, count)
            np.cumsum(shared, out=shared)
            has = shared[end].astype(np.int64) - shared[end - n] + sure
            # every sender of a row counts all of its columns in this part
            own, at = np.unique(keys[has > 0], return_inverse=True)
            most = np.zeros(len(own), np.int64)
            np.maximum.at(most, at, has[has > 0])
            to = (mix(own.view(U)) % U(shares)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            own, most, to = own[order], most[order], to[order]
            cut = np.flatnonzero(np.diff(to, prepend=-1)).tolist()
            runs = list(zip(cut, [*cut[1:], len(to)][: len(cut)], strict=True))
            yield pa.record_batch({"share": pa.array(to[cut], pa.int32()), "keys": pa.array([own[a:z].tobytes() for a, z in runs], pa.binary()), "n": pa.array([_planes(most[a:z]) for a, z in runs], pa.binary())})

    return apply


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """d1, shares: what all parts tell of each row. TOLD of a share come together."""
    keys, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        for k, x in zip(batch.column("keys").to_pylist(), batch.column("n").to_pylist(), strict=True):
            keys.append(np.frombuffer(k, np.int64))
            n.append(_numbers(x).astype(np.int64))
    own, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, at, np.concatenate(n))
    yield pa.record_batch({"d1": pa.array(own), "shares": pa.array(total)})


#: Bits of a bitmap of ids: 16 an id, and no more than MOST, 8 MB, which is sent to all tasks. Beyond 4 million rows that are
#: left after the count it tells ever less, until the sets of all rows are shuffled.
MOST = 1 << 26


def _bit(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.view(U) + U(0x33)) & U(bits - 1)).astype(np.int64)


def bitmap(left: DataFrame) -> np.ndarray:
    """A bit for each node of left; words of it are put together where the nodes are, so the driver sees MOST bits at most."""
    bits = 1 << max(10, min(MOST, 16 * left.count()).bit_length() - 1)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bit(batch.column("node").to_numpy(), bits))
            yield pa.record_batch({"word": pa.array(at >> 6), "bit": pa.array((np.uint64(1) << (at & 63).astype(U)).view(np.int64))})

    words = left.select("node").mapInArrow(marked, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _sets(width: int, maybe: Broadcast):
    """node, d1, d2, size, text (the set, packed) of rows whose id is in the bitmap."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(maybe.value[_bit(batch.column("doc_id").to_numpy(), len(maybe.value))]))
            for a, z, own, cuts in pieces(*column(some)):
                sets, digest = digests(own, cuts, width)
                yield pa.record_batch(
                    {
                        "node": some.column("doc_id").slice(a, z - a),
                        "d1": pa.array(digest[:, 0].view(np.int64)),
                        "d2": pa.array(digest[:, 1].view(np.int64)),
                        "size": pa.array([len(s) for s in sets], pa.int64()),
                        "text": pa.array([s.tobytes() for s in sets], pa.binary()),
                    }
                )

    return apply


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each row and column of the incidence: gram, d1."""
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column("text").to_pylist()]
        at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        if len(at):
            grams = np.concatenate(sets)
            for k in range(0, len(at), 1 << 17):  # a few at a time
                yield pa.record_batch({"gram": pa.array(grams[k : k + (1 << 17)]), "d1": batch.column("d1").take(pa.array(at[k : k + (1 << 17)]))})


def _confirmed(percent: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for k, (x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("ta", "tb")), strict=True)):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)  # noqa: PLW2901
                least = need(len(x), len(y), percent)
                good[k] = least <= min(len(x), len(y)) and len(np.intersect1d(x, y, assume_unique=True)) >= least
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return apply


def _tile(percent: int, keys: list[str], settle: bool):
    def compared(t: pa.Table, part: np.ndarray, side: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        return joined(part, side, linked([np.frombuffer(x, U) for x in t.column("text").to_pylist()], percent))

    return tiled(compared, keys, settle)


def first_columns(sets: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """sets: node, d1, size, text. gram, node: each set's columns, rarest first, of which two linked sets share one."""
    entries = tables.cut(sets.select("d1", "text").mapInArrow(_columns, "gram long, d1 long"))
    df = entries.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    met = looked_up(entries, df.withColumn("w", F.col("df")), "gram", "w", entries.count()).join(sets.select("d1", "node", "size"), "d1")
    # columns that no other set has come first of all
    rank = F.col("size") - F.count(F.lit(1)).over(Window.partitionBy("d1")) + F.row_number().over(Window.partitionBy("d1").orderBy("df", "gram"))
    first = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    out = tables.cut(met.withColumn("rank", rank).where(F.col("rank") <= first).select("gram", "node"))
    tables.drop(entries)
    return out


def linked_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, part_bytes: int = 64 << 20) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id.

    Links join documents whose sets of `width`-word shingles (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; a text of fewer
    words has all of them as one) have 100 * intersection >= percent * union; component_id is the least doc_id
    that links reach. Texts that are null or have no words link with nothing. Rows that share an id are one document with
    several texts, so repeated rows are one; rows without an id stay alone, with a null component_id. Other columns
    don't matter. An empty table gives no rows. part_bytes: text whose shingles one task may count.
    """
    spark = docs.sparkSession
    n_tasks = partitions(spark)
    with Tables(spark) as tables:
        plain = texts(docs, id_col, text_col)
        rows = tables.cut(plain.mapInArrow(_classed(width), "doc_id long, n_shingles long, d1 long, d2 long"))
        real = rows.where("n_shingles > 0 and doc_id is not null")
        classes = tables.cut(real.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("size")))
        # rows that share enough of their columns
        parts = parts_for(plain, part_bytes)
        asked = plain.where("doc_id is not null").mapInArrow(_sent(width, parts), SENT).repartition(parts, "part")
        shares = asked.mapInArrow(_shared(n_tasks), TOLD).repartition(n_tasks, "share").mapInArrow(_added, "d1 long, shares long")
        left = tables.cut(classes.join(shares, "d1").where(F.col("shares") * 100 >= F.col("size") * percent).select("node", "d1", "d2"))
        # sets of documents that are among them, for all one can tell from a bitmap of ids, then of those that are; one for each class
        maybe = spark.sparkContext.broadcast(bitmap(left))
        own = plain.where("doc_id is not null").mapInArrow(_sets(width, maybe), "node long, d1 long, d2 long, size long, text binary")
        own = own.join(left.select("node", "d1", "d2"), ["node", "d1", "d2"], "left_semi")
        sets = tables.cut(own.groupBy("node", "d1", "d2").agg(F.first("size").alias("size"), F.first("text").alias("text")))
        first = first_columns(sets, percent, tables)
        hubs = first.groupBy("gram").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
        alike = looked_up(first, hubs, "gram", "n", first.count()).where("node <> hub").groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("bands"))
        alike = tables.cut(alike)
        sources = sets.select("node", "text")
        weights = sets.groupBy("node").agg(F.sum("size").alias("weight"))
        groups = tables.cut(components(alike.select("a", "b"), tables).withColumnRenamed("part", "grp").join(weights, "node"))
        sizes = tables.cut(groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")))
        few = (F.col("n") <= TILE) & (F.col("w") <= WEIGHT)
        small = groups.join(sizes.where(few), "grp").select("grp", "node", F.col("node").alias("part"), F.lit(0).alias("side")).join(sources, "node")
        small = small.repartition(n_tasks, "grp").sortWithinPartitions("grp")
        ends = small.mapInArrow(_tile(percent, ["grp"], True), "node long, part long").distinct()
        large = sizes.where(~few)
        if large.head(1):
            tile = _tile(percent, ["grp", "i", "j"], False)
            ends = ends.unionByName(large_groups(groups.join(large.select("grp"), "grp"), alike, sources, _confirmed(percent), tile, n_tasks, tables))
        ends = tables.cut(ends)
        named = tables.cut(classes.join(ends, "node", "left").select("d1", "d2", F.coalesce("part", "node").alias("component_id")))
        tables.keep(rows, named)
        member = real.join(named, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id")
        alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return member.unionByName(alone)

