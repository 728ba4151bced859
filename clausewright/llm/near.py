"""Near-duplicate groups with HyperMinHash signatures.

Every register keeps, for the least hash of its bucket, the number of leading zeros and a few mantissa
bits. Bands of compressed registers propose links, an estimate corrected for chance collisions gathers
them into groups, and links are confirmed on the full shingle sets.

No pairs of a group are listed. Texts with equal shingle sets are one class from the start. A group of at
most TILE classes (of WEIGHT shingles at most) is compared by one task, which counts all common shingles at once. In a larger one each
class is first compared with the member of its buckets that it shares most bands with; only the parts that
these links leave apart are then compared, in tiles of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Tables, free_name, partitions, texts
from .words import BLANK_SEPARATED, U, column, find, grams, mix, pieces, starts

#: Registers in bands: a pair at 0.85 shares no band with probability (1 - 0.85 ** 5) ** 26, or 3e-7; one at 0.80 with 3e-5.
BAND, BANDS = 5, 26
REGISTERS = BAND * BANDS
MANTISSA = 10
#: A bucket's members belong to the group of its first one if the estimate is above the threshold less SLACK. Those
#: below SETTLED meet each other too: registers that differ are (nearly) a metric, so what is linked to a member at
#: SETTLED or above is itself above the threshold less SLACK, while the estimate of a link is off by less than NOISE.
SLACK, NOISE = 0.35, 0.15
SETTLED = 1 - SLACK + NOISE
#: Members in one block of a group, and their shingles, at most (but for a single text that has more); columns of shingles
#: that are counted together, and members in one block of a bucket.
TILE, WEIGHT, COLUMNS, BLOCK = 512, 1 << 21, 4096, 1024
#: Tasks that share the links of one node.
SALTS = 8


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text its distinct shingles' hashes, ascending; all words as one shingle where they are fewer than width."""
    words = find(data, bounds, BLANK_SEPARATED, fold=True)
    whole = grams(words.hash, width)
    out = []
    for first, end in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        n = end - first
        if n >= width:
            out.append(np.unique(whole[first : end - width + 1]))
        elif n:
            out.append(grams(words.hash[first:end], n))
        else:
            out.append(np.zeros(0, U))
    return out


def register(least: np.ndarray) -> np.ndarray:
    """Of 64-bit values, 1 + leading zeros above the mantissa bits that follow the first one."""
    length = np.frexp(least.astype(np.float64))[1].clip(1, 64)
    shift = (length - 1 - MANTISSA).clip(0)
    bits = (least >> shift.astype(U)) & U((1 << MANTISSA) - 1)
    return (((65 - length) << MANTISSA) | bits.astype(np.int64)).astype(np.uint16)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each set; 0 stands for an empty bucket."""
    n = [len(s) for s in sets]
    least = np.full(len(sets) * REGISTERS, np.iinfo(np.uint64).max, U)
    if sum(n):
        every = mix(np.concatenate(sets) + U(0x51))
        bucket = ((every >> U(32)) * U(REGISTERS)) >> U(32)
        np.minimum.at(least, np.repeat(np.arange(len(sets)), n) * REGISTERS + bucket.astype(np.int64), mix(every))
    return np.where(least == np.iinfo(np.uint64).max, 0, register(least)).astype(np.uint16).reshape(len(sets), REGISTERS)


#: That two different values make equal registers: equal zeros (1/3) and equal mantissas.
COLLISION = 1 / 3 / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows of registers, corrected for collisions, and the number of buckets they rest on."""
    used = ((a > 0) | (b > 0)).sum(-1)
    equal = ((a == b) & (a > 0)).sum(-1)
    return (equal / np.maximum(used, 1) - COLLISION) / (1 - COLLISION), used


def digests(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The shingle sets, and 128 bits of each that come from hashes of their own, so that texts are one class only if their words are equal."""
    one, two = (find(data, bounds, BLANK_SEPARATED, fold=True, lane=k) for k in (0, 1))
    whole = [grams(w.hash, width) for w in (one, two)]
    sets, out = [], np.zeros((len(bounds) - 1, 2), U)
    for k, (first, end) in enumerate(zip(one.first[:-1].tolist(), one.first[1:].tolist(), strict=True)):
        n = end - first
        if n >= width:
            own, at = np.unique(whole[0][first : end - width + 1], return_index=True)
            other = whole[1][first + at]
        else:
            own, other = (grams(w.hash[first:end], n) if n else np.zeros(0, U) for w in (one, two))
        sets.append(own)
        out[k] = mix(own ^ U(0x11)).sum(dtype=U), mix(other ^ U(0x22)).sum(dtype=U)
    return sets, out


def _signed(width: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = column(batch)
            for a, z, own, cuts in pieces(data, bounds):
                sets, digest = digests(own, cuts, width)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(a, z - a),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "d1": pa.array(digest[:, 0].view(np.int64)),
                        "d2": pa.array(digest[:, 1].view(np.int64)),
                        "registers": pa.array([r.tobytes() for r in signatures(sets)], pa.binary()),
                    }
                )

    return apply


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a band that isn't empty: band (a hash of its number and registers), node."""
    for batch in batches:
        r = _registers(batch.column("registers")).reshape(-1, BANDS, BAND)
        key = np.broadcast_to(mix(np.arange(BANDS, dtype=U) + U(0x77)), r.shape[:2])
        for k in range(BAND):
            key = mix(key * U(0x9E3779B97F4A7C15) + r[:, :, k])
        some = (r > 0).any(-1)
        node = np.repeat(batch.column("node").to_numpy(), BANDS).reshape(some.shape)
        yield pa.record_batch({"band": pa.array(key[some].view(np.int64)), "node": pa.array(node[some])})


def _registers(values: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _alike(least: float):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                guess, _ = estimate(_registers(batch.column("ra")), _registers(batch.column("rb")))
                yield batch.select(["a", "b", "bands"]).append_column("settled", pa.array(guess >= SETTLED)).filter(pa.array(guess >= least))

    return apply


def meeting(part: np.ndarray, registers: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Of one tile of a bucket, pairs with an estimate of `least` or more that join its parts, one for each two that become one.

    Each member in turn meets all that are left, and settles those at SETTLED or above.
    """
    _, of = np.unique(part, return_inverse=True)
    left = np.ones(len(of), bool)
    out = []
    for i in range(len(of)):
        if not left[i]:
            continue
        left[i] = False
        j = np.flatnonzero(left)
        guess, _ = estimate(registers[j], registers[i])
        left[j[guess >= SETTLED]] = False
        j = j[(guess >= least) & (of[j] != of[i])]
        for k in j[np.unique(of[j], return_index=True)[1]].tolist():
            of[of == of[k]] = of[i]
            out.append((i, k))
    return out


def _confirmed(width: int, percent: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (da, ba), (db, bb) = column(batch, "ta"), column(batch, "tb")
            good = np.zeros(len(batch), bool)
            for a, z, own, cuts in pieces(da, ba):
                left, right = shingle_sets(own, cuts, width), shingle_sets(db[bb[a] : bb[z]], bb[a : z + 1] - bb[a], width)
                for k, (x, y) in enumerate(zip(left, right, strict=True), a):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good[k] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return apply


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    values, column_, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    owner, at = np.repeat(np.arange(n), [len(s) for s in sets]), place[column_]
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for k in range(0, len(shared), COLUMNS):
        i, j = np.searchsorted(at, [k, k + COLUMNS])
        x = np.zeros((n, min(COLUMNS, len(shared) - k)), np.float32)
        x[owner[i:j], at[i:j] - k] = 1
        out += x @ x.T
    return out


def joining(part: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Confirmed links of one tile that join its parts, one for each two that become one; and for each member the part's first member."""
    both, size = common(sets), np.array([len(s) for s in sets], np.float32)
    return joined(part, side, (both > 0) & (100 * both >= percent * (size[:, None] + size[None, :] - both)))


def joined(part: np.ndarray, side: np.ndarray, linked: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """What joining() returns, of a square of the members' links."""
    _, of = np.unique(part, return_inverse=True)
    top = list(range(of.max() + 1))

    def find_top(k: int) -> int:
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    out = []
    for i in range(len(of)):
        j = np.flatnonzero(linked[i, :i] & (of[:i] != of[i]) & ((side[:i] != side[i]) | (side[i] == 0)))
        # one link for each other part is enough
        for k in j[np.unique(of[j], return_index=True)[1]].tolist():
            x, y = find_top(of[i]), find_top(of[k])
            if x != y:
                top[max(x, y)] = min(x, y)
                out.append((k, i))
    return out, np.array([find_top(k) for k in of])


def _by_tile(keys: list[str], done):
    """Rows of one tile come together and in order; done() gets them as a table."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in keys], 1)
            at = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1)))).tolist() if len(key) else []
            for s, e in zip(at, [*at[1:], len(key)], strict=True):
                if held and tuple(key[s]) != last:
                    yield done(pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(batch.slice(s, e - s))
                last = tuple(key[s])
        if held:
            yield done(pa.Table.from_batches(held).combine_chunks())

    return apply


def _met(least: float):
    """The pairs of one tile of a bucket that join parts."""

    def done(t: pa.Table) -> pa.RecordBatch:
        node, part = (t.column(c).to_numpy() for c in ("node", "part"))
        pairs = [sorted((node[i], node[k])) for i, k in meeting(part, _registers(t.column("registers")), least)]
        return pa.record_batch({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    return _by_tile(["band", "i", "j"], done)


def _tiled(width: int, percent: int, keys: list[str], settle: bool):
    """Returns the links of a tile that join parts, or with settle every node and the least one of its part."""

    def compared(t: pa.Table, part: np.ndarray, side: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        return joining(part, side, [s for _, _, own, cuts in pieces(*column(t)) for s in shingle_sets(own, cuts, width)], percent)

    return tiled(compared, keys, settle)


def tiled(compared, keys: list[str], settle: bool):
    """Of each tile what compared() says of its rows: the links that join parts, or with settle every node and the least one of its part."""

    def done(t: pa.Table) -> pa.RecordBatch:
        node, part, side = (t.column(c).to_numpy() for c in ("node", "part", "side"))
        links, top = compared(t, part, side)
        if settle:
            least = np.full(top.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, top, node)
            return pa.record_batch({"node": pa.array(node), "part": pa.array(least[top])})
        return pa.record_batch({"a": pa.array([node[a] for a, _ in links], pa.int64()), "b": pa.array([node[b] for _, b in links], pa.int64())})

    return _by_tile(keys, done)


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """links: a, b (long). node, part: the least node that can be reached, for every node of a link.

    A round points all larger neighbours of a node at the least one around it, then all smaller ones and the
    node itself; it is written to the shared folder in place of the round before. Rounds go on until every
    node has one link down, to a node that has none.
    """

    def done(links: DataFrame) -> bool:
        ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("e")
        by_node = links.select(ends).groupBy("e.node").agg(F.sum("e.down").alias("down"), F.max("e.up").alias("up"))
        return not by_node.where("down > 1 or (down = 1 and up = 1)").head(1)

    links = tables.cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while not done(links):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a node with very many neighbours meets its least in several tasks
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        large = both.where("b > a").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(least, ["a", "salt"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        low = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        ends = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        links, last = tables.cut(low.select(ends).select("e.a", "e.b").where("a <> b").distinct()), links
        tables.drop(last)
    return links.select(F.col("a").alias("node"), F.col("b").alias("part")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("part")).distinct())


def _left_over(shared: DataFrame, stars: DataFrame, parts: DataFrame, classes: DataFrame, least: float, n_tasks: int, tables: Tables) -> DataFrame:
    """shared: band, node, hub; stars: a, b, settled; parts: what stars join. a, b: pairs that join what the hubs leave apart in a bucket.

    Members that their hub doesn't settle meet each other wherever they are in two parts or more, in tiles of two blocks.
    """
    settled = stars.where("settled").select(F.col("a").alias("hub"), F.col("b").alias("node"))
    rest = shared.where("node <> hub").join(settled, ["hub", "node"], "left_anti").select("band", "node")
    rest = tables.cut(rest.join(parts, "node", "left").select("band", "node", F.coalesce("part", "node").alias("part")))
    sizes = tables.cut(rest.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("n")))
    dealt = rest.join(sizes, "band").withColumn("k", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    # a tile of two blocks compares either with itself, too
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).where("k <> o or n = 1")
    dealt = dealt.select("band", "node", "part", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"))
    held = _with(dealt, "node", classes, "registers", "registers").repartition(n_tasks, "band", "i", "j").sortWithinPartitions("band", "i", "j")
    return held.mapInArrow(_met(least), "a long, b long").distinct()


def _with(pairs: DataFrame, side: str, table: DataFrame, value: str, name: str) -> DataFrame:
    other = table.select(F.col("node").alias(side), F.col(value).alias(name))
    return pairs.join(other, side)


def _blocks_of(n: str, weight: str):
    """How many blocks so many members with so many shingles are dealt into."""
    return F.greatest(F.ceil(F.col(n) / TILE), F.ceil(F.col(weight) / WEIGHT)).cast("int")


def large_groups(groups: DataFrame, alike: DataFrame, sources: DataFrame, confirmed, tile, n_tasks: int, tables: Tables) -> DataFrame:
    """groups: grp, node, weight. node, part for each: every node is compared with the one it shares most bands with, then parts with parts.

    sources: node, text (or what else is compared). confirmed: of rows a, b, ta, tb leaves the links; tile: of sorted rows of tiles returns links.
    """
    own = alike.join(groups.select(F.col("node").alias("b")), "b", "left_semi")
    nearest = own.groupBy("b").agg(F.max_by("a", F.struct("bands", -F.col("a"))).alias("a")).select("a", "b")
    pairs = _with(_with(nearest, "a", sources, "text", "ta"), "b", sources, "text", "tb").select("a", "b", "ta", "tb")
    links = tables.cut(pairs.mapInArrow(confirmed, "a long, b long"))
    members = tables.cut(groups.join(components(links, tables), "node", "left").select("grp", "node", "weight", F.coalesce("part", "node").alias("part")))
    sizes = members.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    sizes = sizes.groupBy("grp").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "w", "part")).alias("most")).where("n > most.n")
    # members of a group's largest part needn't meet each other; all others meet every one
    sizes = sizes.selectExpr("grp", "most.part as most", "n - most.n as n", "w - most.w as w", "most.n as most_n", "most.w as most_w")
    sizes = sizes.select("grp", "most", _blocks_of("n", "w").alias("n_rest"), _blocks_of("most_n", "most_w").alias("n_most"))
    dealt = members.join(sizes, "grp").withColumn("in_most", F.col("part") == F.col("most"))
    dealt = dealt.withColumn("k", F.pmod(F.xxhash64("node"), F.when(F.col("in_most"), F.col("n_most")).otherwise(F.col("n_rest"))).cast("int"))
    meets = F.when(F.col("in_most"), F.sequence(F.lit(0), F.col("n_rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("n_rest") + F.col("n_most") - 1))
    dealt = dealt.withColumn("o", F.explode(meets))
    block = F.when(F.col("in_most"), F.col("n_rest") + F.col("k")).otherwise(F.col("k"))  # blocks of the largest part are numbered after the others
    dealt = dealt.select("grp", "node", "part", F.least(block, "o").alias("i"), F.greatest(block, "o").alias("j"), F.when(block == F.col("o"), 0).when(block < F.col("o"), 1).otherwise(2).alias("side"))
    held = _with(dealt, "node", sources, "text", "text").repartition(n_tasks, "grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    more = tables.cut(held.mapInArrow(tile, "a long, b long"))
    if not more.head(1):
        return members.select("node", "part")
    # what the tiles join, between the parts there were
    named = more.join(members.select(F.col("node").alias("a"), F.col("part").alias("pa")), "a").join(members.select(F.col("node").alias("b"), F.col("part").alias("pb")), "b")
    last = components(named.select(F.col("pa").alias("a"), F.col("pb").alias("b")), tables).select(F.col("node").alias("part"), F.col("part").alias("last"))
    return members.join(last, "part", "left").select("node", F.coalesce("last", "part").alias("part"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Links join texts whose sets of `width`-word shingles (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased) have
    100 * intersection >= percent * union; component_id is the smallest doc_id that links reach. Texts that
    are null or have no words link with nothing. Rows that share an id are one document with several texts;
    rows without an id stay alone, with a null component_id, and are kept. An empty table gives no rows.
    """
    least, n_tasks, tables = percent / 100 - SLACK, partitions(docs.sparkSession), Tables(docs.sparkSession)
    plain = texts(docs, id_col, text_col)
    rows = tables.cut(plain.mapInArrow(_signed(width), "doc_id long, n_shingles long, d1 long, d2 long, registers binary"))
    real = rows.where("n_shingles > 0 and doc_id is not null")
    classes = tables.cut(real.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.first("registers").alias("registers"), F.max("n_shingles").alias("weight")))
    bands = tables.cut(classes.select("node", "registers").mapInArrow(_banded, "band long, node long").distinct())
    hubs = bands.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = tables.cut(bands.join(hubs, "band"))
    tables.drop(bands)
    # every bucket's members and its first, with the number of bands they share, then members whose first leaves them apart;
    # groups are what the alike of them join
    stars = shared.where("node <> hub").groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("bands"))
    stars = tables.cut(_with(_with(stars, "a", classes, "registers", "ra"), "b", classes, "registers", "rb").mapInArrow(_alike(least), "a long, b long, bands long, settled boolean"))
    parts = components(stars.select("a", "b"), tables)
    more = tables.cut(_left_over(shared, stars, parts, classes, least, n_tasks, tables))
    alike = stars.drop("settled").unionByName(more.withColumn("bands", F.lit(1).cast("long")))
    tables.drop(shared)
    if more.head(1):
        parts = components(parts.select(F.col("node").alias("a"), F.col("part").alias("b")).unionByName(more), tables)
    weights = classes.groupBy("node").agg(F.sum("weight").alias("weight"))
    groups = tables.cut(parts.withColumnRenamed("part", "grp").join(weights, "node"))
    # the texts that later steps compare, once
    sources = tables.cut(plain.join(groups.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text"))
    sizes = tables.cut(groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")))
    few = (F.col("n") <= TILE) & (F.col("w") <= WEIGHT)
    small = groups.join(sizes.where(few), "grp").select("grp", "node", F.col("node").alias("part"), F.lit(0).alias("side"))
    small = _with(small, "node", sources, "text", "text").repartition(n_tasks, "grp").sortWithinPartitions("grp")
    parts = small.mapInArrow(_tiled(width, percent, ["grp"], True), "node long, part long").distinct()
    large = sizes.where(~few)
    if large.head(1):
        tile = _tiled(width, percent, ["grp", "i", "j"], False)
        parts = parts.unionByName(large_groups(groups.join(large.select("grp"), "grp"), alike, sources, _confirmed(width, percent), tile, n_tasks, tables))
    parts = tables.cut(parts)
    named = tables.cut(classes.select("d1", "d2", "node").join(parts, "node", "left").select("d1", "d2", F.coalesce("part", "node").alias("component_id")))
    tables.drop(*[t for t, _ in tables.written if t is not rows and t is not named])
    member = real.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return member.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, that near_groups() keeps: one document of each group.

    Rows without an id or without words all stay; rows that share an id are one document, so they stay or go
    together. An empty table gives no rows.
    """
    its_id = free_name(docs, "gone")
    gone = near_groups(docs, id_col, text_col, width, percent).where("not kept").select(F.col("doc_id").alias(its_id)).distinct()
    return docs.join(Tables(docs.sparkSession).cut(gone), F.col(f"`{id_col}`").cast("long") == F.col(its_id), "left_anti")


#: doc_id, n_shingles, component_id by DuckDB: every shingle with every one that equals it, links by counts, and what links reach.
GROUPS_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from {documents}),
sets as (
  select doc_id, case when len(w) >= {width} then list_distinct(list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i : i + {width} - 1], ' ')))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from words),
each as (select doc_id, len(s) as n, unnest(s) as shingle from sets),
links as (
  select a.doc_id as a, b.doc_id as b from each a join each b on a.shingle = b.shingle and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id having 100 * count(*) >= {percent} * (max(a.n) + max(b.n) - count(*))),
reach as (select doc_id, doc_id as other from sets union select r.doc_id, l.b from reach r join links l on l.a = r.other),
components as (select doc_id, min(other) as component_id from reach group by doc_id)
select doc_id, len(s)::bigint as n_shingles, component_id{more} from sets join components using (doc_id)"""
