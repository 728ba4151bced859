"""A prefix trie of conversations by partition refinement.

All conversations start as one class. Turn by turn, every class that has several members is split by what
they say next; a class is known by a digest of its turns, so that telling a member its class needs no join
with the classes, and counting them is an aggregate which frequent turns pass combined. A class of one
member retires: the rest of that conversation is a chain of nodes without branches, emitted as it is. When
no class has several members left, what nodes say of their subtrees is folded back level by level.

Rounds are as many as the longest beginning that two conversations share has turns; each reads its turns and
the members of classes that are still being split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .store import Tables, looked_up, partitions

#: Ids in one piece of a node's list of ends.
PIECE = 2048
NODES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered(rows: DataFrame, tables: Tables, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """conv_id, place (0, 1, ...), digest, bytes of every turn; and conv_id, n of every conversation.

    Turns are ordered by turn_col, null first, equal ones by their digest (of role and text; null counts as empty). Rows
    without an id belong to no conversation. Rows are dealt into ranges of conversations and turns, so a
    conversation of any length is numbered by many tasks: within a range by its rows' order, with what the
    ranges before it hold added.
    """
    role, text = (F.coalesce(rows[c].cast("string"), F.lit("")).cast("binary") for c in (role_col, text_col))
    size = F.octet_length(role).cast("string").cast("binary")
    own = rows.select(rows[id_col].cast("long").alias("conv_id"), rows[turn_col].alias("turn"), _digest(size, F.lit(b":"), role, text).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    dealt = own.where("conv_id is not null").repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    held = tables.cut(dealt.select("conv_id", F.monotonically_increasing_id().alias("at"), "digest", "bytes")).withColumn("range", F.shiftright("at", 33))
    runs = held.groupBy("conv_id", "range").agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range at most
    runs = runs.select("conv_id", "range", (F.coalesce(earlier, F.lit(0)) - F.col("begin")).alias("shift"))
    turns = held.join(runs, ["conv_id", "range"]).select("conv_id", (F.col("at") + F.col("shift")).alias("place"), "digest", "bytes")
    return turns, held.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


def grafted(turns: DataFrame, sizes: DataFrame, family: int = 5, longest: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their family does: turns (conv_id, depth from 1, digest, bytes), sizes (conv_id, length).

    Of conversation c the first h turns, h = crc32(c in decimals) % (longest + 1), are those of conversation
    c - c % family (fewer if it has fewer, none if it isn't there); then come c's own after its first h, if any. % has the sign of c.
    """
    id_ = F.col("conv_id")
    known = sizes.select("conv_id", "n", (id_ - id_ % family).alias("base"), (F.crc32(id_.cast("string").cast("binary")) % (longest + 1)).alias("h"))
    bases = sizes.select(id_.alias("base"), F.col("n").alias("base_n"))
    known = known.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    own = looked_up(turns, known.select("conv_id", "h", "taken", F.col("n").alias("w")), "conv_id", "w", total).where("place >= h")
    own = own.select("conv_id", (F.col("taken") + F.col("place") - F.col("h") + 1).alias("depth"), "digest", "bytes")
    # a base has `longest` turns to give to a family that isn't larger than twice its number
    given = turns.where(F.col("place") < longest).withColumnRenamed("conv_id", "base").join(known.select("conv_id", "base", "h"), "base").where("place < h")
    given = given.select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "bytes")
    return own.unionByName(given), known.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, pa.RecordBatch]]:
    """Slices of sorted batches with one class each; a class may have several."""
    for batch in batches:
        classes = batch.column("cls").to_pylist()
        begin = 0
        for k in range(1, len(classes) + 1):
            if k == len(classes) or classes[k] != classes[begin]:
                yield classes[begin], batch.slice(begin, k - begin)
                begin = k


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one class in pieces, comma-joined; first: the piece's least id."""
    for cls, run in _runs(batches):
        ids = run.column("conv_id").to_pylist()
        some = [ids[k : k + PIECE] for k in range(0, len(ids), PIECE)]
        yield pa.record_batch({"cls": pa.array([cls] * len(some), pa.binary()), "first": pa.array([x[0] for x in some], pa.int64()), "ids": pa.array([",".join(map(str, x)) for x in some])})


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a class of all its pieces in order; only the digest's state is held."""
    now = state = None
    for cls, run in _runs(batches):
        if state is not None and cls != now:
            yield pa.record_batch({"cls": pa.array([now], pa.binary()), "ends_sha256": pa.array([state.hexdigest()])})
            state = None
        for piece in run.column("ids").to_pylist():
            if state is None:
                now, state = cls, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
    if state is not None:
        yield pa.record_batch({"cls": pa.array([now], pa.binary()), "ends_sha256": pa.array([state.hexdigest()])})


def digest_of_ends(ends: DataFrame) -> DataFrame:
    """ends: cls, conv_id. cls, ends_sha256: of its ids, ascending, in decimals, comma-joined.

    A class may end any number of conversations: its ids are sorted and joined in ranges by many tasks; what
    one task then digests in order are these pieces, a row for PIECE ids.
    """
    n = partitions(ends.sparkSession)
    pieces = ends.repartitionByRange(n, "cls", "conv_id").sortWithinPartitions("cls", "conv_id").mapInArrow(_listed, "cls binary, first long, ids string")
    return pieces.repartition(n, "cls").sortWithinPartitions("cls", "first").mapInArrow(_streamed, "cls binary, ends_sha256 string")


def refined(turns: DataFrame, sizes: DataFrame, tables: Tables) -> tuple[list[DataFrame], DataFrame]:
    """Nodes of each depth (cls, conv_id, parent, n, bytes, length), down to where their members are alone; and the ends (cls, conv_id) of those that aren't."""
    whole = sizes.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.min("length").alias("length"))
    # an empty table has no root
    root = whole.where("n > 0").select(F.lit(b"").alias("cls"), "conv_id", F.lit(None).cast("long").alias("parent"), "n", F.lit(0).cast("long").alias("bytes"), "length")
    levels = [tables.cut(root)]
    total = (levels[0].head() or {"n": 0})["n"]
    active = sizes.select("conv_id", F.lit(b"").alias("cls"), "length", F.lit(None).cast("long").alias("bytes")).where(F.lit(total > 1))
    ends = active.where("length = 0").select("cls", "conv_id")
    several = total
    while several:
        depth = len(levels)
        open_ = active.where(F.col("length") >= depth).select("conv_id", F.col("cls").alias("above"), "length")
        step = tables.cut(open_.join(turns.where(F.col("depth") == depth), "conv_id").select("conv_id", "above", _digest(F.col("above"), F.col("digest")).alias("cls"), "length", "bytes"))
        split = step.groupBy("cls", "above").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"), F.max("length").alias("length"))
        above = levels[-1].where("n > 1").select(F.col("cls").alias("above"), F.col("conv_id").alias("parent"), F.col("n").alias("w"))
        seen = Observation()
        nodes = looked_up(split, above, "above", "w", total).select("cls", "conv_id", "parent", "n", "bytes", "length")
        levels.append(tables.cut(nodes.observe(seen, F.count_if(F.col("n") > 1).alias("several"))))
        several = seen.get["several"]
        active = step.join(levels[-1].where("n = 1").select("conv_id"), "conv_id", "left_anti")
        ends = ends.unionByName(active.where(F.col("length") == depth).select("cls", "conv_id"))
    return levels, ends


def folded(levels: list[DataFrame], tables: Tables) -> list[DataFrame]:
    """Nodes of each depth with n_children, n_leaves and saved of their subtrees, the deepest first."""
    out: list[DataFrame] = []
    zero = F.lit(0).cast("long")
    for depth in range(len(levels) - 1, -1, -1):
        rest = (F.col("length") > depth).cast("long")  # of a member that is alone: whether a chain follows
        own = levels[depth].withColumn("depth", F.lit(depth).cast("long"))
        if out:
            sums = out[-1].groupBy(F.col("parent").alias("conv_id")).agg(F.count(F.lit(1)).alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
            own = own.join(sums, "conv_id", "left")
        else:
            own = own.withColumns({k: F.lit(None).cast("long") for k in ("c", "l", "s")})
        out.append(
            tables.cut(
                own.select(
                    "cls", "conv_id", "depth", "parent", "n", "length", F.when(F.col("n") == 1, rest).otherwise(F.coalesce("c", zero)).alias("n_children"),
                    F.coalesce("l", F.lit(1).cast("long")).alias("n_leaves"), ((F.col("n") - 1) * F.col("bytes") + F.coalesce("s", zero)).alias("saved"),
                )
            )
        )
    return out


def trie(turns: DataFrame, sizes: DataFrame, tables: Tables) -> DataFrame:
    """One row a node: NODES. turns: conv_id, depth (1 to length), digest, bytes; sizes: conv_id, length; ids are unique and not null."""
    n = partitions(turns.sparkSession)
    sizes = tables.cut(sizes)
    # by depth, so that a round reads the files of its own
    turns = tables.cut(turns.repartitionByRange(n, "depth", "conv_id").sortWithinPartitions("depth", "conv_id"))
    levels, ends = refined(turns, sizes, tables)
    said = tables.cut(digest_of_ends(ends))
    nodes = folded(levels, tables)
    tables.keep(turns, sizes, said, *nodes)
    every = nodes[0]
    for level in nodes[1:]:
        every = every.unionByName(level)
    no_end = F.lit(hashlib.sha256(b"").hexdigest())
    alone = lambda depth: F.when(F.col("length") == depth, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(no_end)
    shared = every.join(said, "cls", "left").withColumn("ends_sha256", F.when(F.col("n") == 1, alone(F.col("depth"))).otherwise(F.coalesce("ends_sha256", no_end)))
    shared = shared.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")
    retired = every.where("n = 1 and length > depth").select("conv_id", F.col("depth").alias("since"), "length", F.col("length").alias("w"))
    total = sizes.agg(F.coalesce(F.sum("length"), F.lit(0))).head()[0]
    one = F.lit(1).cast("long")
    tails = looked_up(turns.select("conv_id", "depth"), retired, "conv_id", "w", total).where("depth > since")
    tails = tails.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), (F.col("depth") < F.col("length")).cast("long").alias("n_children"), one.alias("n_leaves"), (one - one).alias("saved_tokens"), alone(F.col("depth")).alias("ends_sha256"))
    return shared.unionByName(tails)


def conversation_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int | None = None, longest: int = 8) -> DataFrame:
    """One row a node of the trie of all conversations: NODES, all long but for ends_sha256.

    A node of depth d is a distinct sequence of first d turns (role, text); the root has none. Its members are
    the conversations that begin with it: conv_id is the least, n_convs their number, parent_conv_id the
    parent's conv_id (null for the root). n_children counts the nodes right below; n_leaves the nodes without children in its subtree, itself
    included; saved_tokens adds up, over its subtree, n_convs - 1 times the UTF-8 bytes of a node's last text;
    ends_sha256 digests the ids of members that end at it (ascending, comma-joined; of none, of the empty text).

    family: rebuilds each conversation with the beginning of another first (see grafted). A null role or text counts as
    empty, a null turn comes first, equal turns are ordered by a digest of role and text, so repeated rows are
    turns of their own. Rows without an id are left out. Other columns don't matter. An empty table gives no rows.
    """
    with Tables(conversations.sparkSession) as tables:
        turns, sizes = numbered(conversations, tables, id_col, turn_col, role_col, text_col)
        if family is not None:
            turns, sizes = grafted(turns, sizes, family, longest)
        else:
            turns, sizes = turns.select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "bytes"), sizes.select("conv_id", F.col("n").alias("length"))
        return trie(turns, sizes, tables)


#: crc32 of a text of ASCII in DuckDB's SQL, byte by byte and bit by bit.
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda p, q: case when p % 2 = 1 then xor(p // 2, 3988292384::bigint) else p // 2 end)), 4294967295::bigint)"""

TRIE_SQL = f"""
with own as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first) - 1 as place, coalesce(role, '') as role, coalesce(text, '') as text from {{conversations}} where conv_id is not null),
known as (select conv_id, count(*) as n, conv_id - conv_id % {{family}} as base, {CRC_SQL.format(text="conv_id::varchar")} % ({{longest}} + 1) as h from own group by conv_id),
turns as (
  select k.conv_id, o.place + 1 as depth, o.role, o.text from known k join own o on o.conv_id = k.base where o.place < k.h
  union all
  select k.conv_id, least(k.h, coalesce(b.n, 0)) + o.place - k.h + 1, o.role, o.text from known k join own o on o.conv_id = k.conv_id left join known b on b.conv_id = k.base where o.place >= k.h),
prefixes as (
  select conv_id, depth, text, list([role, text]) over (partition by conv_id order by depth) as said from turns
  union all select conv_id, 0, '', []::varchar[][] from known),
ended as (select *, depth = max(depth) over (partition by conv_id) as ends from prefixes),
member as (select *, min(conv_id) over (partition by depth, said) as node from ended),
nodes as (
  select node as conv_id, depth, count(*) as n_convs, any_value(strlen(text)) as bytes, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '') as ends from member group by node, depth),
above as (select n.*, m.node as parent from nodes n left join member m on m.conv_id = n.conv_id and m.depth = n.depth - 1),
children as (select parent as conv_id, depth - 1 as depth, count(*) as n from above where parent is not null group by all),
counted as (select a.*, coalesce(c.n, 0) as n_children from above a left join children c using (conv_id, depth)),
subtrees as (
  select m.node as conv_id, m.depth, count(*) filter (where y.n_children = 0) as n_leaves, sum((y.n_convs - 1) * y.bytes)::bigint as saved
  from counted y join member m on m.conv_id = y.conv_id and m.depth <= y.depth group by all)
select conv_id::bigint as conv_id, depth::bigint as depth, parent::bigint as parent_conv_id, n_convs::bigint as n_convs, n_children::bigint as n_children, n_leaves::bigint as n_leaves, saved as saved_tokens, sha256(ends) as ends_sha256
from counted join subtrees using (conv_id, depth)"""
