"""Best-fit packing of token sequences by a linear grouping scheme.

What is planned is the histogram of piece lengths, which has one entry a length at most, however many
documents there are. Large lengths are dealt into groups of equal cardinality and rounded up to their
group's largest; the best mixture of configurations of so few sizes comes from a linear program by
column generation; actual lengths then replace the rounded ones, and what that leaves free is filled
best-fit by small ones. Runs of sequences of the same content stay one entry throughout. Documents learn
their place from their rank among the pieces of their length.
"""

from __future__ import annotations

import bisect
import gc
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Tables, partitions, texts
from .words import column

#: Groups of the large lengths, and what part of the capacity a large one exceeds.
GROUPS, LARGE = 96, 0.4
#: Runs of letters whose ids a Python worker remembers, and half as many whole words (some 150 MB); then it forgets them
#: and goes on. More memory spares time.
REMEMBERED = 1 << 19
_SEPARATOR = b"\x01"
_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: From here on, what counts as a letter differs between versions of Unicode.
_LATER_SCRIPTS = "\u0530"
_memory: dict[tuple[str, int], Ids] = {}


class Ids:
    """Token ids of texts as packed 32-bit numbers.

    The tokenizer lower-cases, and splits at blanks and between letters and other signs whatever stands
    around them. So each word is encoded once, and letters with signs after them as the letters and the signs;
    only letters of common scripts whose small letters are letters again, everything else is encoded as it stands.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # of small ASCII letters nothing is left to normalise or to split but the blanks between words
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        (self.separator,) = self.tokenizer.encode(_SEPARATOR.decode(), add_special_tokens=False).ids
        self.tails: dict[bytes, bytes] = {b"": b""}
        self.known: dict[bytes, bytes] = {}
        self.cores: dict[bytes, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encoded(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        plain = [w for w in words if _SEPARATOR not in w]
        for k in range(0, len(plain), 1000):
            some = plain[k : k + 1000]
            ids = self._encode((b" " + _SEPARATOR + b" ").join(some).decode("utf-8", "replace"))
            at, raw = np.flatnonzero(ids == self.separator) * 4, ids.tobytes()
            yield from zip(some, [raw[a:z] for a, z in zip([0, *(at + 4).tolist()], [*at.tolist(), len(raw)], strict=True)], strict=True)
        for w in set(words) - set(plain):
            yield w, self._encode(w.decode("utf-8", "replace")).tobytes()

    def _encoded_letters(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        for k in range(0, len(words), 1000):
            some = words[k : k + 1000]
            found = self.plain.encode(b" ".join(some).decode(), add_special_tokens=False)
            ends = np.append(np.flatnonzero(np.diff(np.array(found.word_ids))) + 1, len(found.ids)) * 4
            raw, at = np.array(found.ids, np.uint32).tobytes(), 0
            for word, end in zip(some, ends.tolist(), strict=True):
                yield word, raw[at:end]
                at = end

    def learn(self, words: set[bytes]) -> None:
        split, others, ascii_cores, wide_cores = [], [], set(), set()
        together = b" ".join(words)
        special = [t for t in self.special if t in together]
        for w in words:
            core = w.rstrip(_SIGNS)
            tail = w[len(core) :]
            if special and any(t in w for t in special):
                others.append(w)
                continue
            if core.isalpha():  # of bytes: ASCII letters
                core = core.lower()
                ascii_cores.add(core)
            else:
                letters = core.decode("utf-8", "replace")
                # capital sigma's small letter depends on where it stands; a dotted capital I's is a letter and a mark
                if not letters.isalpha() or max(letters) >= _LATER_SCRIPTS or "\u03a3" in letters or not letters.lower().isalpha():
                    others.append(w)
                    continue
                core = letters.lower().encode()
                wide_cores.add(core)
            if tail not in self.tails:
                self.tails[tail] = self._encode(tail.decode()).tobytes()
            split.append((w, core, tail))
        if len(self.tails) > self.remembered:
            self.tails = {tail: self.tails[tail] for _, _, tail in split}
        if len(self.cores) > self.remembered:
            self.cores.clear()
        self.cores.update(self._encoded_letters(list(ascii_cores.difference(self.cores))))
        self.cores.update(self._encoded(list(wide_cores.difference(self.cores))))
        for w, core, tail in split:
            self.known[w] = self.cores[core] + self.tails[tail]
        self.known.update(self._encoded(others))

    def of(self, texts: list[bytes]) -> Iterator[bytes]:
        for k in range(0, len(texts), 512):
            split = [t.split() for t in texts[k : k + 512]]
            if len(self.known) > self.remembered // 2:
                self.known.clear()
            new = set().union(*split).difference(self.known)
            if new:
                self.learn(new)
            get = self.known.__getitem__
            for own in split:
                yield b"".join(map(get, own))


def ids_of(path: str, remembered: int) -> Ids:
    if (path, remembered) not in _memory:
        _memory.clear()
        _memory[path, remembered] = Ids(path, remembered)
    return _memory[path, remembered]


def _cut_up(path: str, capacity: int, end: int, remembered: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, last = ids_of(path, remembered), int(end).to_bytes(4, "little")
        gc.disable()  # nothing here makes cycles, and the collector would walk all lists of words again and again
        try:
            for batch in batches:
                data, bounds = column(batch)
                raw, docs = data.tobytes(), batch.column("doc_id").to_pylist()
                out: list[tuple] = []
                for doc, ids in zip(docs, coder.of([raw[a:z] for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]), strict=True):
                    ids += last  # noqa: PLW2901
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start : start + 4 * capacity]
                        out.append((doc, piece, start // 4, len(own) // 4, zlib.crc32(own)))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        finally:
            gc.enable()

    return apply


@dataclass
class Run:
    """count sequences, each holding of every length so many pieces."""

    count: int
    content: Counter
    free: int


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Numbers of each size in a sequence, and how many such sequences: the linear optimum, rounded down."""
    s, d, k = np.array(sizes), np.array(demand, float), len(sizes)
    basis = np.diag(capacity // s).astype(float)
    for _ in range(40 * k):
        inverse = np.linalg.inv(basis)
        worth = inverse.sum(0)
        # the most worth that fits into each capacity, and the size that came last
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(s.min()), capacity + 1):
            fits = s <= c
            with_it = np.where(fits, best[c - np.minimum(s, c)] + worth, -1)
            j = int(with_it.argmax())
            best[c], last[c] = (with_it[j], j) if with_it[j] > best[c - 1] else (best[c - 1], -1)
        if best[capacity] <= 1 + 1e-7:
            break
        entering, c = np.zeros(k), capacity
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                entering[last[c]] += 1
                c -= int(s[last[c]])
        x, u = inverse @ d, inverse @ entering
        ratio = np.where(u > 1e-9, x / np.where(u > 1e-9, u, 1), np.inf)
        basis[:, int(ratio.argmin())] = entering
    x = np.linalg.inv(basis) @ d
    return [(basis[:, j].astype(int), int(x[j] + 1e-9)) for j in range(k) if x[j] >= 1 - 1e-9]


def plan(lengths: dict[int, int], capacity: int) -> list[Run]:
    """lengths: how many pieces there are of each length (1 to capacity)."""
    left = Counter({k: v for k, v in lengths.items() if v})
    runs = [Run(left.pop(capacity), Counter({capacity: 1}), 0)] if left[capacity] else []
    large = sorted((k for k in left if k > capacity * LARGE and left[k]), reverse=True)
    total = sum(left[k] for k in large)
    if total:
        groups: list[list[list[int]]] = [[]]
        each = -(-total // GROUPS)
        for length in large:
            todo = left[length]
            while todo:
                room = each - sum(n for _, n in groups[-1])
                if not room:
                    groups.append([])
                    room = each
                groups[-1].append([length, n := min(todo, room)])
                todo -= n
        demand: Counter = Counter()
        for g in groups:  # groups of one rounded size are one size
            demand[g[0][0]] += sum(n for _, n in g)
        sizes, there = sorted(demand, reverse=True), sorted(large)

        def take(most: int, count: int) -> tuple[int, int]:
            """The longest actual pieces up to a length, as many as are wanted or left."""
            at = bisect.bisect_right(there, most) - 1
            if at < 0:
                return 0, count
            length = there[at]
            n = min(count, left[length])
            left[length] -= n
            if not left[length]:
                there.pop(at)
            return length, n

        for numbers, count in configurations(sizes, [demand[s] for s in sizes], capacity):
            slots = [s for s, n in zip(sizes, numbers, strict=True) for _ in range(n)]
            # actual pieces replace the rounded ones; the last of a sequence may use what the others have left free
            todo = [(count, Counter(), capacity, 0)]
            while todo:
                count, content, room, k = todo.pop()
                if k == len(slots):
                    runs.append(Run(count, content, room))
                    continue
                length, n = take(room if k == len(slots) - 1 else min(slots[k], room), count)
                todo.append((n, content + Counter({length: 1}) if length else content, room - length, k + 1))
                if n < count:
                    todo.append((count - n, content, room, k))
    # what is left, the longest first, each into the fullest sequences that have room
    by_room: dict[int, list[Run]] = {}
    for r in runs:
        by_room.setdefault(r.free, []).append(r)
    rooms = sorted(by_room)
    done: list[Run] = []

    def put(r: Run) -> None:
        if r.free not in by_room:
            bisect.insort(rooms, r.free)
        by_room.setdefault(r.free, []).append(r)

    for length in sorted(left, reverse=True):
        todo = left[length]
        while todo > 0:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                fit = capacity // length
                r, n = Run(0, Counter(), capacity), max(1, todo // fit)
            else:
                room = rooms[at]
                r = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
                fit = room // length
                n = min(r.count, max(1, todo // fit))
                if r.count > n:
                    put(Run(r.count - n, r.content, r.free))
            fit = min(fit, todo)
            put(Run(n, r.content + Counter({length: fit}), r.free - fit * length))
            todo -= n * fit
    return done + [r for room in rooms for r in by_room[room]]


def places(runs: list[Run]) -> np.ndarray:
    """length, first rank, sequence of that rank, pieces of that length in a sequence, offset of the first: ordered by length and rank."""
    rows, next_rank, sequence = [], Counter(), 0
    for r in runs:
        offset = 0
        for length, n in r.content.items():
            rows.append((length, next_rank[length], sequence, n, offset))
            next_rank[length] += n * r.count
            offset += n * length
        sequence += r.count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed(table: np.ndarray):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = {int(k): int(i) for i, k in reversed(list(enumerate(table[:, 0])))}
        end = {int(k): i + 1 for i, k in enumerate(table[:, 0])}
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for k in np.unique(length).tolist():
                own, t = length == k, table[start[k] : end[k]]
                t = t[np.searchsorted(t[:, 1], rank[own], "right") - 1]
                j = rank[own] - t[:, 1]
                sequence[own], offset[own] = t[:, 2] + j // t[:, 3], t[:, 4] + j % t[:, 3] * k
            yield batch.drop_columns(["rank"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return apply


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end: int = 0, remembered: int = REMEMBERED) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    tokenizer: the path of a tokenizer file that every machine has. A document is its ids and then end; only
    one longer than capacity is cut. A null text is empty, so it is end alone; repeated rows are packed each;
    an empty table gives no rows. Sequences are numbered from 0 and have no gaps.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    pieces = tables.cut(texts(docs, id_col, text_col).mapInArrow(_cut_up(tokenizer, capacity, end, remembered), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    # the rank of a piece among those of its length: places before its bucket, and within it
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(8 * partitions(spark))))
    counts = dealt.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = tables.cut(counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    lengths = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}  # capacity rows at most
    table = places(plan(lengths, capacity))
    own = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("own", own).join(counts.select("bucket", "length", "before"), ["bucket", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_placed(table), schema)
