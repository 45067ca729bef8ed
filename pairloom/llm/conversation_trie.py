"""Prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns, named by its length and by the exclusive or of digests of
place and turn; the root is the empty sequence. Totals go from children to parents:

1. nodes are dealt into shards by ranges of their smallest conversation, so that a conversation's own
   nodes, and mostly those around it, lie together; each shard is sorted by falling depth (Spark's sort,
   which spills to disk);
2. a shard is one pass. A node that has heard from all its children is done and passes its totals on,
   within the shard through a priority queue that hands them over when the parent's turn comes. A message
   to another shard, and one that a full queue spills, becomes a row;
3. rows are folded by parent and sorted in before the nodes that wait for them: the shard roots and those
   above. These are dealt anew, into fewer shards, until no node waits. Every pass finishes the deepest
   ones at least, so the passes are as many as there are shards on a way to the root, mostly a few.

How the work is spread: turns are ordered by range over (conversation, turn), so a conversation of any
length is cut over tasks; places and digests within it are running values of a range plus those of the
ranges before. Nodes fold map-side, so a turn that all conversations begin with is no hot key. The parents
of very many children are broadcast (``WIDE`` at most) and all others joined. The ids that end in a node
are put together in chunks, and one task runs over the chunks of a node in order to digest them. The queue
holds at most ``QUEUE`` parents. Each pass is written to the shared folder.

Turns are ordered by turn, null first; of one turn number by role, text (their first 64 and 256
characters) and digest. A null role or text is empty. Rows without a conversation id are left out.
Repeated rows are turns of their own. A conversation without turns left is a member of the root. Empty
table: no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import saved, text_or_empty, word_count
from pairloom.operators import order

# Rebuilding: conversations of a block of this many ids start with turns of its first one, and fewer than
# this many of them.
BLOCK, MOST = 20, 4
# Nodes per shard, and shards at most; beyond, shards grow.
SHARD, MAX_SHARDS = 4_000, 4_096
# Parents whose totals wait in a shard's queue.
QUEUE = 200_000
# Parents that are broadcast: those with the most children.
WIDE = 100_000
# Ids of a chunk.
CHUNK = 4_096

KEY = ["depth", "k1", "k2"]
_STATE = (
    "kind long, conv long, depth long, k1 long, k2 long, p1 long, p2 long, parent_conv long, n_convs long, "
    "n_children long, own long, got long, leaves long, saved long, home long"
)
_NAMES = [part.split(" ")[0] for part in _STATE.split(", ")]
MESSAGE, NODE, DONE = 0, 1, 2


def ordered_turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, part, rank, t1, t2, words): each turn's rank in its conversation, from 1, and two digests.

    ``part`` is the range of the sort that the turn lies in.
    """
    turns = df.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"),
        text_or_empty(role_col).alias("role"), text_or_empty(text_col).alias("text"),
    )
    narrow = turns.select(
        "conv", "turn", F.substring("role", 1, 64).alias("role"), F.substring("text", 1, 256).alias("head"),
        F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "text", "role").alias("t2"),
        word_count("text").alias("words"), F.monotonically_increasing_id().alias("tie"),
    )
    by = ["conv", "turn", "role", "head", "t1", "t2", "tie"]
    dealt = narrow.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = saved(
        dealt.select(
            "conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("i"), "t1", "t2", "words"
        ),
        "turns",
    )
    before = _before(placed.groupBy("part", "conv").agg(F.count("*").alias("n")), n=F.sum("n"))
    place = F.row_number().over(Window.partitionBy("part", "conv").orderBy("i"))
    ranked = placed.withColumn("place", place).join(before, ["part", "conv"])
    rank = (F.col("place") + F.coalesce("n", F.lit(0))).cast("bigint")
    return saved(ranked.select("conv", "part", rank.alias("rank"), "t1", "t2", "words"), "turns")


def _before(groups: DataFrame, **sums: Column) -> DataFrame:
    """Each group of (part, conv) with running values over the earlier parts of its conversation.

    A conversation has as many groups as it has ranges.
    """
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return groups.select("part", "conv", *[value.over(earlier).alias(name) for name, value in sums.items()])


def rebuilt(turns: DataFrame, block: int = BLOCK, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(conv, part, pos, t1, t2, words) and (conv, size): conversations that share their first turns.

    Conversation c begins with the first h turns of conversation c - c % block (all if that has fewer,
    none if it is absent), with h = crc32 of the decimal c modulo ``most``; its own turns follow after its
    first h. The borrowed turns are part -1.
    """
    counts = turns.groupBy("conv").agg(F.max("rank").alias("n"))
    heads = turns.filter(F.col("rank") < most).groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("rank", "t1", "t2", "words"))).alias("head")
    )  # fewer than ``most`` turns of each
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h")
    base = (F.col("conv") - F.col("conv") % block).alias("base")
    convs = counts.select("conv", "n", h, base).join(heads.withColumnRenamed("conv", "base"), "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h").cast("int"))
    convs = convs.select("conv", "n", "h", head.alias("head"))
    borrowed = F.size("head").cast("bigint")
    sizes = convs.select(
        "conv", "h", "head", borrowed.alias("borrowed"), (borrowed + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("size")
    )
    sizes = saved(sizes, "conversations")
    first = sizes.select("conv", F.lit(-1).alias("part"), F.inline("head")).withColumnRenamed("rank", "pos")
    # Through (part, conv), so that a conversation of very many turns is not one key.
    groups = turns.select("part", "conv").distinct().join(sizes.select("conv", "h", "borrowed"), "conv")
    own = turns.join(groups, ["part", "conv"]).filter(F.col("rank") > F.col("h"))
    pos = F.col("rank") - F.col("h") + F.col("borrowed")
    columns = ["conv", "part", "pos", "t1", "t2", "words"]
    rows = first.select(*columns).unionByName(own.withColumn("pos", pos).select(*columns))
    return saved(rows, "rebuilt"), sizes.select("conv", "size")


def members(turns: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, words): the node of each first turns of a conversation, and its parent."""
    marked = turns.withColumns(
        {"x1": F.xxhash64(F.lit(1), "pos", "t1", "t2"), "x2": F.xxhash64(F.lit(2), "t2", "t1", "pos")}
    )
    so_far = Window.partitionBy("part", "conv").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    groups = marked.groupBy("part", "conv").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    before = _before(groups, b1=F.bit_xor("x1"), b2=F.bit_xor("x2"))
    zero = F.lit(0).cast("bigint")
    within = marked.withColumns({"w1": F.bit_xor("x1").over(so_far), "w2": F.bit_xor("x2").over(so_far)})
    keyed = within.join(before, ["part", "conv"]).withColumns(
        {k: F.col(w).bitwiseXOR(F.coalesce(b, zero)) for k, w, b in (("k1", "w1", "b1"), ("k2", "w2", "b2"))}
    )
    parents = {p: F.col(k).bitwiseXOR(F.col(x)) for p, k, x in (("p1", "k1", "x1"), ("p2", "k2", "x2"))}
    columns = ["conv", F.col("pos").alias("depth"), "k1", "k2", "p1", "p2", "words"]
    return saved(keyed.withColumns(parents).select(*columns), "members")


def nodes(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, parent_conv, n_convs, n_children, own) of each node, the root included.

    ``own`` is what the node saves by itself: its last turn's words for each member but the first.
    """
    zero = F.lit(0).cast("bigint")
    found = rows.groupBy(*KEY).agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.min("words").alias("words"),
    )
    root = sizes.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).filter(F.col("n_convs") > 0)
    root = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv", "n_convs", zero.alias("p1"), zero.alias("p2"), zero.alias("words"))
    found = saved(found.unionByName(root), "nodes")
    up = {"depth": F.col("depth") - 1, "k1": F.col("p1"), "k2": F.col("p2")}
    children = found.filter(F.col("depth") > 0).groupBy(*[c.alias(n) for n, c in up.items()]).agg(F.count("*").alias("n_children"))
    found = found.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero))
    found = saved(found.withColumn("own", (F.col("n_convs") - 1) * F.col("words")).drop("words"), "nodes")
    # At most WIDE parents have so many children.
    many = max(2, found.count() // WIDE)
    parents = found.filter(F.col("n_children") > 0).select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
        F.col("conv").alias("parent_conv"), "n_children",
    )
    link = ["depth", "p1", "p2"]
    wide = parents.filter(F.col("n_children") >= many).drop("n_children")
    rest = parents.filter(F.col("n_children") < many).drop("n_children")
    below = found.filter(F.col("depth") > 0)
    linked = below.join(F.broadcast(wide), link, "left")
    narrow = linked.filter(F.col("parent_conv").isNull()).drop("parent_conv").join(rest, link)
    top = found.filter(F.col("depth") == 0).withColumn("parent_conv", F.lit(None).cast("bigint"))
    return top.unionByName(linked.filter(F.col("parent_conv").isNotNull())).unionByName(narrow)


def _pass(batches: Iterable[pa.RecordBatch], queue: int) -> Iterator[pa.RecordBatch]:
    """One shard: rows by falling depth and key, messages before their node."""
    waiting: dict[tuple, list[int]] = {}
    due: list[tuple] = []
    posted, post = None, None
    schema = pa.schema([(name, pa.int64()) for name in _NAMES])
    out: list[tuple] = []

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    for batch in batches:
        for row in zip(*[batch.column(name).to_pylist() for name in [*_NAMES, "shard"]]):
            kind, conv, depth, k1, k2, p1, p2, parent_conv, n_convs, n_children, own, got, leaves, total, home, shard = row
            key = (-depth, k1, k2)
            if kind == MESSAGE:
                posted, post = key, (got, leaves, total)
                continue
            if posted == key:
                got, leaves, total = got + post[0], leaves + post[1], total + post[2]
            if due and due[0] == key:
                heapq.heappop(due)
                more = waiting.pop(key)
                got, leaves, total = got + more[0], leaves + more[1], total + more[2]
            if got < n_children:
                out.append((NODE, *row[1:11], got, leaves, total, home))
            else:
                leaves = leaves if n_children else 1
                total += own
                out.append((DONE, *row[1:11], got, leaves, total, home))
                parent = (1 - depth, p1, p2)
                if depth and home == shard and (parent in waiting or len(due) < queue):
                    if parent not in waiting:
                        heapq.heappush(due, parent)
                        waiting[parent] = [0, 0, 0]
                    told = waiting[parent]
                    told[0], told[1], told[2] = told[0] + 1, told[1] + leaves, told[2] + total
                elif depth:
                    out.append((MESSAGE, parent_conv, depth - 1, p1, p2, *[0] * 6, 1, leaves, total, 0))
            if len(out) >= 8192:
                yield block()
                out.clear()
    if out:
        yield block()


def subtree_totals(found: DataFrame, shard: int = SHARD, queue: int = QUEUE) -> DataFrame:
    """Nodes with ``leaves`` and ``saved``, summed over the subtree of each."""
    zero = F.lit(0).cast("bigint")
    names = ["conv", *KEY, "p1", "p2", "parent_conv", "n_convs", "n_children", "own"]
    left = saved(
        found.select(F.lit(NODE).cast("bigint").alias("kind"), *names, *[zero.alias(n) for n in ("got", "leaves", "saved")]),
        "trie",
    )
    messages, done = None, []
    n = left.count()
    while n:
        ranges = order.plan_ranges(left, "conv", rows_per_range=max(shard, -(-n // MAX_SHARDS)), n_rows=n)
        homed = ranges.assign(left.withColumns({"at": F.col("conv"), "conv": F.col("parent_conv")}))
        homed = homed.withColumns({"conv": F.col("at"), "home": F.col(order.RANGE).cast("bigint")}).drop(order.RANGE, "at")
        rows = homed.select(*_NAMES)
        if messages is not None:
            rows = rows.unionByName(messages.select(*_NAMES))
        dealt = ranges.assign(rows).withColumn("shard", F.col(order.RANGE).cast("bigint"))
        dealt = dealt.repartitionById(len(ranges.starts), F.col(order.RANGE)).drop(order.RANGE)
        dealt = dealt.sortWithinPartitions(F.desc("depth"), "k1", "k2", "kind")
        passed = saved(dealt.mapInArrow(lambda batches: _pass(batches, queue), _STATE), "trie")
        done.append(passed.filter(F.col("kind") == DONE))
        left = passed.filter(F.col("kind") == NODE).drop("home")
        rest = {name: zero for name in _NAMES if name not in ("conv", *KEY, "got", "leaves", "saved")}
        messages = (
            passed.filter(F.col("kind") == MESSAGE)
            .groupBy("conv", *KEY)
            .agg(*[F.sum(name).alias(name) for name in ("got", "leaves", "saved")])
            .withColumns(rest)
        )
        n = left.count()
    if not done:
        return left.drop("kind", "got")
    return reduce(DataFrame.unionByName, done).drop("kind", "got", "home")


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node, joined with commas. Rows come sorted by node and id."""
    key, first, ids = None, None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"depth": [key[0]], "k1": [key[1]], "k2": [key[2]], "first": [first], "ids": [",".join(map(str, ids))]}
        )

    for batch in batches:
        for *node, conv in zip(*[batch.column(name).to_pylist() for name in [*KEY, "conv"]]):
            if node != key or len(ids) >= CHUNK:
                if ids:
                    yield row()
                key, first, ids = node, conv, []
            ids.append(conv)
    if ids:
        yield row()


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the chunks of each node, which come sorted."""
    key, digest, out = None, None, []

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip([*KEY, "ends"], map(list, zip(*out)))))

    for batch in batches:
        for *node, ids in zip(*[batch.column(name).to_pylist() for name in [*KEY, "ids"]]):
            if node == key:
                digest.update(b"," + ids.encode())
                continue
            if key is not None:
                out.append((*key, digest.hexdigest()))
            key, digest = node, hashlib.sha256(ids.encode())
            if len(out) >= 8192:
                yield block()
                out.clear()
    if key is not None:
        out.append((*key, digest.hexdigest()))
    if out:
        yield block()


def ends(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends): digest of the ids of the conversations that end in a node."""
    zero = F.lit(0).cast("bigint")
    # The end of a conversation is its deepest row; this folds map-side.
    last = rows.groupBy("conv").agg(F.max_by(F.struct(*KEY), "depth").alias("node")).select("conv", "node.*")
    none = sizes.filter(F.col("size") == 0).select("conv", *[zero.alias(name) for name in KEY])
    ids = last.unionByName(none).repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv")
    chunks = ids.mapInArrow(_chunks, "depth long, k1 long, k2 long, first long, ids string")
    together = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return together.mapInArrow(_digests, "depth long, k1 long, k2 long, ends string")


def trie(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    shard: int = SHARD,
    queue: int = QUEUE,
) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations, one row each."""
    turns, sizes = rebuilt(ordered_turns(df, conv_col, turn_col, role_col, text_col))
    rows = members(turns)
    totals = subtree_totals(nodes(rows, sizes), shard, queue)
    return totals.join(ends(rows, sizes), KEY, "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
