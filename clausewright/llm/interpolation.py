"""Language-model scores by deleted interpolation.

The model mixes the maximum-likelihood estimates of a token after the two tokens before it, after the one
before it, of the token by itself, and of any token at all. The weights depend on how often the context was
seen (buckets by powers of two) and are learned by expectation-maximisation on counts of held-out tokens:
first those of the shorter contexts, then how much of the longest one goes with what these say together.

Documents are dealt into blocks. A block asks for the counts of the distinct words, pairs and triples in it,
and its question carries how often its own training documents have them; the parts into which hashes are
dealt add up what all blocks say and answer each. A frequent word is thus sent once a block, and no
vocabulary is ever gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Tables, parts_for, remainder, texts, told_apart
from .words import BLANK_SEPARATED, U, column, find, mix, pair, pieces

#: Stand for the end of a text, and for what comes before its first token.
END, BEGIN = U(0x0E0D), U(0x0BE6)
#: Context counts below 1, 2, 4, ... 2 ** (BUCKETS - 2), and above.
BUCKETS = 16
#: One of so many training documents is held out while the weights are learned.
HELD_OUT = 8
#: Held-out tokens are summed by bucket and by the two estimates, to this many steps a factor of ten.
STEPS = 8
#: Single tokens, pairs and triples.
ORDERS = 3


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens of all texts (words, then one end), of each with the one and with the two before it, and where each text begins."""
    words = find(data, bounds, BLANK_SEPARATED, fold=True)
    n = len(bounds) - 1
    first = words.first[:-1] + np.arange(n)
    out = np.empty(len(words.hash) + n, U)
    last = words.first[1:] + np.arange(n)
    inside = np.ones(len(out), bool)
    inside[last] = False
    out[inside], out[last] = words.hash, END
    before = np.empty_like(out)
    before[1:], before[first] = out[:-1], BEGIN
    two = pair(before, out)
    before[1:], before[first] = two[:-1], BEGIN
    return out, two, pair(before, out + U(1)), np.append(first, len(out))


def _block(batches: Iterator[pa.RecordBatch]) -> dict | None:
    """All tokens of one block's documents: their hashes by order (single, pair, triple), and of each document its number of tokens, kind and id."""
    got: list[list] = [[] for _ in range(ORDERS + 3)]
    for batch in batches:
        data, bounds = column(batch)
        kind, ids = batch.column("kind").to_numpy(), batch.column("doc_id")
        for a, z, own, cuts in pieces(data, bounds):
            *orders, first = tokens(own, cuts)
            for held, x in zip(got, (*orders, np.diff(first), kind[a:z], ids.slice(a, z - a)), strict=True):
                held.append(x)
    if not got[-1]:
        return None
    ids = pa.chunked_array(got.pop()).combine_chunks()
    whole = []
    while got:  # one by one, so that no two copies of all of them are there at once
        whole.append(np.concatenate(got.pop(0)))
    return {"orders": whole[:ORDERS], "n": whole[ORDERS], "kind": whole[ORDERS + 1], "ids": ids}


#: kind of a document: 0 isn't learned from, 1 is, 2 is and is held out when the weights are learned
ASK = "block int, part int, hashes array<binary>, learned array<binary>"
#: Arrays are by order; totals come with a part's first answer.
ANSWER = "block int, part int, learned array<binary>, held array<binary>, total array<long>, held_total array<long>, distinct array<long>"


#: Bytes by which hashes of single tokens, of pairs and of triples travel; the part a hash belongs to adds to these. A pair
#: that wasn't learned is thus taken for another about once in a million times, at any size, as parts grow with the data.
WIDTH = (8, 5, 5)


def _routes(hashes: np.ndarray, parts: int) -> dict[int, np.ndarray]:
    """By part, of those that have any: which hashes belong to it, ascending."""
    part = (mix(hashes + U(3)) % U(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    at = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    return {int(part[a]): order[a:z] for a, z in zip(at, [*at[1:], len(part)][: len(at)], strict=True)}


def _packed(hashes: np.ndarray, width: int) -> bytes:
    """The upper bytes of ascending hashes as differences, byte by byte, which shuffles compress well."""
    upper = hashes >> U(64 - 8 * width)
    upper[1:] = np.diff(upper)
    return upper.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return np.cumsum(out.view(U)[:, 0], dtype=U)


def _small(counts: np.ndarray) -> bytes:
    """Counts as bytes; those from 255 on follow as 64-bit numbers."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def _large(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw[n:], "<i8")
    return out


def _grouped(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Runs of rows of one value, of batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    value = None
    for batch in batches:
        key = batch.column(by).to_numpy()
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))).tolist() if len(key) else []
        for s, e in zip(at, [*at[1:], len(key)], strict=True):
            if held and key[s] != value:
                yield value, held
                held = []
            held.append(batch.slice(s, e - s))
            value = key[s]
    if held:
        yield value, held


def _asks(parts: int):
    """One row a block and part, with the block's hashes of all orders that belong to the part, and how often its documents teach each."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, own in _grouped(batches, "block"):
            block = _block(own)
            learns = np.repeat(block["kind"], block["n"]) > 0
            packed: dict[int, tuple[list[bytes], list[bytes]]] = {}
            for order in range(ORDERS):
                hashes, at = np.unique(block["orders"][order], return_inverse=True)
                block["orders"][order] = None
                learned = np.bincount(at[learns], minlength=len(hashes))
                del at
                for k, own in _routes(hashes, parts).items():
                    said = packed.setdefault(k, ([b""] * ORDERS, [b""] * ORDERS))
                    said[0][order], said[1][order] = _packed(hashes[own], WIDTH[order]), _small(learned[own])
            some = sorted(packed)
            arrays = [pa.array([packed[k][side] for k in some], pa.list_(pa.binary())) for side in (0, 1)]
            yield pa.record_batch([pa.array(np.full(len(some), number, np.int32)), pa.array(some, pa.int32()), *arrays], ["block", "part", "hashes", "learned"])

    return apply


def _added(at: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by place; exact below 2 ** 53, more than any corpus has tokens."""
    return np.bincount(at, counts, n).astype(np.int64)


def _answers(n_blocks: int):
    """For each part: the sums over all blocks, in the order each block asked; totals and distinct counts with the first answer.

    Blocks from n_blocks on hold the held-out documents; only they are told what was learned from these.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _grouped(batches, "part"):
            block = np.concatenate([b.column("block").to_numpy() for b in rows])
            asked, said_ = ([x for b in rows for x in b.column(c).to_pylist()] for c in ("hashes", "learned"))
            rows.clear()
            is_held = block >= n_blocks
            learned_of: list[list] = [[] for _ in block]
            held_of: list[list] = [[] for _ in block]
            totals: list[list[int]] = [[], [], []]
            for order in range(ORDERS):
                every = [_unpacked(x[order], WIDTH[order]) for x in asked]
                cuts = np.cumsum([0, *map(len, every)])
                hashes, at = np.unique(np.concatenate(every), return_inverse=True)
                n = len(hashes)
                del every, hashes
                said = np.concatenate([_large(x[order], k) for x, k in zip(said_, np.diff(cuts).tolist(), strict=True)])
                of_held = np.repeat(is_held, np.diff(cuts))
                learned, held = _added(at, said, n), _added(at[of_held], said[of_held], n)
                for out, total in zip(totals, (learned.sum(), held.sum(), (learned > 0).sum()), strict=True):
                    out.append(int(total))
                for k, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    learned_of[k].append(_small(learned[at[a:z]]))
                    if is_held[k]:
                        held_of[k].append(_small(held[at[a:z]]))
            none = [None] * (len(block) - 1)
            lists = pa.list_(pa.binary())
            yield pa.record_batch(
                [pa.array(block, pa.int32()), pa.array(np.full(len(block), part, np.int32)), pa.array(learned_of, lists), pa.array([x or None for x in held_of], lists)] + [pa.array([t, *none], pa.list_(pa.int64())) for t in totals],
                ["block", "part", "learned", "held", "total", "held_total", "distinct"],
            )

    return apply


def _counts(block: dict, answers: list[tuple], parts: int, side: int) -> list[np.ndarray]:
    """By order, per token: how often its run was learned (side 0), or learned from held-out documents (side 1)."""
    found = {part: x[side] for part, *x in answers}
    out = []
    for order in range(ORDERS):
        hashes, at = np.unique(block["orders"][order], return_inverse=True)
        n = np.zeros(len(hashes), np.int64)
        for k, own in _routes(hashes, parts).items():
            if k in found:
                n[own] = _large(found[k][order], len(own))
        out.append(n[at])
    return out


def _contexts(one: np.ndarray, two: np.ndarray, n: np.ndarray, texts_: int) -> tuple[np.ndarray, np.ndarray]:
    """How often the token before, and the pair before, was learned; before the first token, how many texts were."""
    first, out = np.cumsum(n) - n, []
    for counts in (one, two):
        before = np.empty_like(counts)
        before[1:], before[first] = counts[:-1], texts_
        out.append(before)
    return out[0], out[1]


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def _shares(counts: list[np.ndarray], contexts: tuple[np.ndarray, np.ndarray], total: int) -> list[np.ndarray]:
    """The maximum-likelihood estimates by order."""
    return [counts[0] / max(total, 1), *(c / np.maximum(context, 1) for c, context in zip(counts[1:], contexts, strict=True))]


def value_of(step: np.ndarray) -> np.ndarray:
    """The middle of a step; -1 stands for none."""
    return np.where(step >= 0, 10.0 ** (-(step + 0.5) / STEPS), 0.0)


def learned_weights(sums: list[tuple[int, int, int, float]], distinct: int, rounds: int = 60) -> np.ndarray:
    """sums: bucket, step of the single's estimate, step of the pair's (or -1 for none), tokens. Weights of pair, single and any token by bucket."""
    weights = np.tile(np.array([0.3, 0.6, 0.1]), (BUCKETS, 1))
    if not sums:
        return weights
    bucket, single, double, n = (np.array(x) for x in zip(*sums, strict=True))
    p = np.stack([value_of(double), value_of(single), np.full(len(n), 1 / (distinct + 1))], 1)
    for _ in range(rounds):
        part = weights[bucket] * p
        part *= (n / part.sum(1))[:, None]
        # a little of every share stays, so that no bucket loses a way to score what it hasn't met
        got = np.stack([np.bincount(bucket, part[:, k], BUCKETS) for k in range(3)], 1) + np.array([0.3, 0.6, 0.1])
        weights = got / got.sum(1, keepdims=True)
    weights[0, 1:] += weights[0, 0] * weights[0, 1:] / weights[0, 1:].sum()  # a context never seen has no pairs
    weights[0, 0] = 0
    return weights


def learned_trust(sums: list[tuple[int, int, int, float]], rounds: int = 60) -> np.ndarray:
    """sums: bucket of the pair before, step of what shorter contexts say, step of the triple's estimate (or -1), tokens. The triple's weight by bucket."""
    trust = np.full(BUCKETS, 0.3)
    if sums:
        bucket, lower, triple, n = (np.array(x) for x in zip(*sums, strict=True))
        high, low = value_of(triple), value_of(lower)
        for _ in range(rounds):
            own = trust[bucket] * high
            part = n * own / (own + (1 - trust[bucket]) * low)
            trust = (np.bincount(bucket, part, BUCKETS) + 0.3) / (np.bincount(bucket, n, BUCKETS) + 1)
    trust[0] = 0  # a context never seen has no triples
    return trust


def _joined(batches: Iterator[pa.RecordBatch], parts: int, sides: tuple[int, ...]) -> Iterator[tuple[dict, list[list[np.ndarray]]]]:
    """Blocks with the counts of their tokens by side: rows of one block come together, answers among its documents."""
    for _, rows in _grouped(batches, "block"):
        block = _block(b.filter(pc.is_null(b.column("part"))) for b in rows)
        if block is not None:
            answers = [x for b in rows for x in zip(*(b.filter(pc.is_valid(b.column("part"))).column(c).to_pylist() for c in ("part", "learned", "held")), strict=True)]
            rows.clear()
            counts = [_counts(block, answers, parts, side) for side in sides]
            block["orders"] = answers = None  # what counted isn't needed any more
            yield block, counts


#: Buckets of the two contexts, steps of the three estimates, and how many tokens have these.
STEPPED = "b1 long, b2 long, single long, double long, triple long, n long"


def _summed(parts: int, total: int, docs: int):
    """Of held-out documents' tokens: what the documents that aren't held out say of them."""

    def step(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.floor(-np.log10(np.where(p > 0, p, 1)) * STEPS), -1).astype(np.int64)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (every, held) in _joined(batches, parts, (0, 1)):
            counts = [a - b for a, b in zip(every, held, strict=True)]
            contexts = _contexts(counts[0], counts[1], block["n"], docs)
            own = np.repeat(block["kind"], block["n"]) == 2
            columns = [bucket_of(c) for c in contexts] + [step(p) + 1 for p in _shares(counts, contexts, total)]
            key = np.zeros(own.sum(), np.int64)
            for x in columns:
                key = key * 256 + x[own]
            values, n = np.unique(key, return_counts=True)
            split = [values >> (8 * k) & 255 for k in (4, 3, 2, 1, 0)]
            yield pa.record_batch([*map(pa.array, split[:2]), *(pa.array(x - 1) for x in split[2:]), pa.array(n, pa.int64())], ["b1", "b2", "single", "double", "triple", "n"])

    return apply


def _mixed(weights: np.ndarray, distinct: int) -> Column:
    """What the shorter contexts say of a row of STEPPED, as a step."""
    weight = lambda k: F.element_at(F.array(*[F.lit(float(x)) for x in weights[:, k]]), (F.col("b1") + 1).cast("int"))
    value = lambda c: F.when(F.col(c) >= 0, F.pow(F.lit(10.0), -(F.col(c) + 0.5) / STEPS)).otherwise(0.0)
    return F.floor(-F.log10(weight(0) * value("double") + weight(1) * value("single") + weight(2) / (distinct + 1)) * STEPS)


def _scored(parts: int, total: int, distinct: int, docs: int, weights: np.ndarray, trust: np.ndarray):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (counts,) in _joined(batches, parts, (0,)):
            first, one = np.cumsum(block["n"]) - block["n"], counts[0]
            contexts = _contexts(one, counts[1], block["n"], docs)
            p1, p2, p3 = _shares(counts, contexts, total)
            w, t = weights[bucket_of(contexts[0])], trust[bucket_of(contexts[1])]
            lower = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (distinct + 1)
            by_text = lambda x: np.add.reduceat(x, first)  # noqa: E731  every text has its end
            yield pa.record_batch(
                {
                    "doc_id": block["ids"],
                    "held_out": pa.array(block["kind"] == 0),
                    "n_tokens": pa.array(block["n"].astype(np.int64)),
                    "n_known": pa.array(by_text((one > 0).astype(np.int64))),
                    "train_tokens": pa.array(np.full(len(first), total, np.int64)),
                    "base_score": pa.array(by_text(np.log10((one + 1) / (total + distinct + 1)))),
                    "score": pa.array(by_text(np.log10(t * p3 + (1 - t) * lower))),
                }
            )

    return apply


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, left_out: int = 2, part_bytes: int = 16 << 20, mixture: tuple[np.ndarray, np.ndarray] | None = None
) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose crc32(doc_id as text) modulo `modulus` isn't `left_out` (a null id counts as
    the empty text). A-Z are lower-cased; tokens are words `[^\\x20\\x09-\\x0D]+` and one end, so a null or
    empty text is its end alone. base_score adds one to every count; score is the interpolated model's. Both
    are base-10 logarithms of the text's probability. An empty table gives no rows; where nothing is learned
    from, every token counts as new. part_bytes: text whose tokens one task may hold. mixture: weights learned
    before (of learned_weights and learned_trust), instead of learning them here.
    """
    tables = Tables(docs.sparkSession)
    kind = F.when(remainder(modulus) == left_out, 0).when(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(HELD_OUT)) == 0, 2).otherwise(1).cast("int")
    own = told_apart(texts(docs, id_col, text_col), tables).withColumn("kind", kind)
    parts = parts_for(own, part_bytes)
    # held-out documents have blocks of their own, so that learning the weights reads no others
    n_blocks = 2 * parts
    few, dealt = -(-n_blocks // HELD_OUT), F.col("row")
    block = F.when(F.col("kind") == 2, n_blocks + F.pmod(dealt, F.lit(few))).otherwise(F.pmod(dealt, F.lit(n_blocks))).cast("int")
    blocks = own.withColumn("block", block).drop("row").repartition(parts, "block").sortWithinPartitions("block")
    asked = blocks.mapInArrow(_asks(parts), ASK)
    answers = tables.cut(asked.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_answers(n_blocks), ANSWER))
    sums = lambda c: F.sum(F.coalesce(F.col(c)[0], F.lit(0)))  # noqa: E731  of single tokens
    total, held, distinct = answers.where("total is not null").agg(*[F.coalesce(sums(c), F.lit(0)) for c in ("total", "held_total", "distinct")]).head()
    learned_docs = {r.kind: r["count"] for r in own.groupBy("kind").count().collect()}
    null = F.lit(None)
    said = answers.select("block", "part", "learned", "held", null.cast("long").alias("doc_id"), null.cast("string").alias("text"), null.cast("int").alias("kind"))

    def with_answers(rows: DataFrame, answers: DataFrame) -> DataFrame:
        asking = rows.withColumn("block", block).select(
            "block", null.cast("int").alias("part"), null.cast("array<binary>").alias("learned"), null.cast("array<binary>").alias("held"), "doc_id", "text", "kind"
        )
        return asking.unionByName(answers).repartition(parts, "block").sortWithinPartitions("block")

    if mixture is None:
        sums = with_answers(own.where("kind = 2"), said.where(F.col("block") >= n_blocks)).mapInArrow(_summed(parts, total - held, learned_docs.get(1, 0)), STEPPED)
        sums = tables.cut(sums.groupBy("b1", "b2", "single", "double", "triple").agg(F.sum("n").alias("n")))
        # what reaches the driver has at most BUCKETS times the squared number of steps rows
        short = sums.groupBy("b1", "single", "double").agg(F.sum("n").alias("n")).collect()
        weights = learned_weights([tuple(r) for r in short], distinct)
        long = sums.groupBy("b2", _mixed(weights, distinct).alias("lower"), "triple").agg(F.sum("n").alias("n")).collect()
        mixture = weights, learned_trust([tuple(r) for r in long])
        tables.drop(sums)
    scored = _scored(parts, total, distinct, learned_docs.get(1, 0) + learned_docs.get(2, 0), *mixture)
    return with_answers(own, said.withColumn("held", null.cast("array<binary>"))).mapInArrow(scored, SCORES)


#: The columns of scores() that come from counts alone, by DuckDB; {crc} is crc32 of the id in decimals.
BASE_SQL = r"""
with docs as (
  select doc_id, {crc} % 7 = 2 as held_out,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from {documents}),
tokens as (select doc_id, held_out, unnest(list_append(list_transform(w, lambda x: 'w' || x), 'end')) as token from docs),
counts as (select token, count(*) as c from tokens where not held_out group by token),
totals as (select coalesce(sum(c), 0)::bigint as n, count(*) as v from counts)
select doc_id, bool_or(held_out) as held_out, count(*) as n_tokens, count(c) as n_known, any_value(n) as train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 4) as base_score
from tokens left join counts using (token), totals group by doc_id"""
