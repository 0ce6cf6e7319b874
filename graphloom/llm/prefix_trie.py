"""The trie of conversations' turns, built as a burst trie.

A conversation is the list of its turn ids (128-bit hashes of role and text); equal lists are one
row with their count, smallest conv_id and the digest of all ids.  A container
holds the lists below one node of the trie.  A container with more than LOAD turns bursts: the node, and
those that all of its lists go through, become heads, and the lists are dealt out to new
containers by their next turn id.  What is left is sorted, and each task sweeps its containers
in order, a stack of open nodes at hand, so that a node is closed with all its counts when the first list
passes it by.  Counts of subtrees climb the heads from the last burst to the first.

The stack is as deep as one conversation; nothing else is held.  Rounds of bursting are bounded by
MOST_BURSTS: a container that is still larger is swept by one task like others.

Turns are ordered by turn, null first, then by role and id; null roles and texts are empty.  Rows
without a conv_id are left out; repeated rows are turns of their own.  An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import stage

#: Turns of a container that does not burst; bursts one after the other; heads that are broadcast at most; characters of a run of ids.
LOAD, MOST_BURSTS, MOST_BROADCAST, RUN = 4_096, 40, 10_000, 1 << 16
#: Turns that a conversation takes from the first of its block, and conversations of a block.
SHARED, BLOCK = 4, 20

WORD = r"[^\x20\x09-\x0D]+"


def _hash(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def conversations_of(turns: DataFrame) -> DataFrame:
    """conv_id, ids, words: turn ids and words of the turns of each conversation, in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    id_ = _hash(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), role.alias("role"), id_.alias("id"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t")).where("conv_id is not null")
    # within structs nulls come first
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, ids, words: the first h turns of the first conversation of the block, if it is there, then the own turns
    behind the first h; h is the crc32 of the id modulo SHARED."""
    c = F.col("conv_id")
    some = lambda a, h: F.slice(a, F.lit(1), h)
    rest = lambda a, h: F.slice(F.col(a), h + 1, F.greatest(F.size(a) - h, F.lit(0)))
    firsts = conversations.where(c % BLOCK == 0).select(c.alias("block"), *(F.slice(x, 1, SHARED - 1).alias(f"first_{x}") for x in ("ids", "words")))
    rows = conversations.withColumn("h", (F.crc32(c.cast("string")) % SHARED).cast("int")).withColumn("block", c - c % BLOCK)
    met = rows.join(firsts, "block", "left")
    none = {"ids": F.array().cast("array<binary>"), "words": F.array().cast("array<int>")}
    return met.select("conv_id", *(F.concat(F.coalesce(some(f"first_{x}", F.col("h")), none[x]), rest(x, F.col("h"))).alias(x) for x in none))


def distinct_lists(conversations: DataFrame) -> DataFrame:
    """ids, words, n, conv_id (the smallest) and ends (the digest of all ids) for each distinct list of turns.

    Sorted ids become runs of text before they meet, so a list that very many conversations share
    is a few rows; its digest runs over them one after the other."""
    keyed = stage(conversations.withColumn("key", _hash(F.lit(b""), F.array_join(F.transform("ids", F.hex), ""))), "lists")

    def runs(batches):
        key, first, parts, held, n = None, None, [], 0, 0
        for batch in batches:
            out = []
            for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if parts and (k != key or held >= RUN):
                    out.append((key, first, n, ",".join(parts)))
                    parts, held, n = [], 0, 0
                if not parts:
                    key, first = k, c
                parts.append(str(c))
                held, n = held + len(parts[-1]) + 1, n + 1
            if out:
                yield table(out)
        if parts:
            yield table([(key, first, n, ",".join(parts))])

    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["key", "first", "n", "text"])

    def digests(batches):
        key, first, n, sha = None, None, 0, None
        close = lambda: (first, n, sha.hexdigest())
        told = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "n", "ends"])
        for batch in batches:
            out = []
            for k, f, m, text in zip(*(batch.column(c).to_pylist() for c in ("key", "first", "n", "text"))):
                if sha is None or k != key:
                    if sha is not None:
                        out.append(close())
                    key, first, n, sha = k, f, 0, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(text.encode())
                n += m
            if out:
                yield told(out)
        if sha is not None:
            yield told([close()])

    pairs = keyed.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = pairs.mapInArrow(runs, "key binary, first long, n long, text string")
    classes = pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digests, "conv_id long, n long, ends string")
    return classes.join(keyed.select("conv_id", "ids", "words"), "conv_id")


def _node(conv, depth, parent, n, children, leaves, saved, ends) -> list[Column]:
    parts = {"conv_id": conv, "depth": depth, "parent_conv_id": parent, "n_convs": n, "n_children": children, "n_leaves": leaves, "saved_tokens": saved}
    return [*(v.cast("long").alias(k) for k, v in parts.items()), ends.alias("ends_sha256")]


NONE = hashlib.sha256().hexdigest()


def _burst(rows: DataFrame, load: int, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Lists in containers that need not burst, and for each round a table of the heads.

    Containers: key, up (the container that it burst from), up_conv (the smallest id there), depth (of its top node).
    Heads: key, up, up_conv, depth, n, conv_id, own (words of the turns from the top node to the one that bursts), ends."""
    left, settled, heads = stage(rows, "containers"), [], []
    for _ in range(most):
        size = left.groupBy("key").agg(F.sum(F.size("ids") - F.col("depth")).alias("load"), F.count("*").alias("lists")).where((F.col("load") > load) & (F.col("lists") > 1)).select("key")
        large = stage(size, "large")
        if not (found := large.count()):
            break
        few = F.broadcast if found <= MOST_BROADCAST else lambda df: df
        settled.append(left.join(few(large), "key", "left_anti"))
        mine = left.join(few(large), "key", "left_semi")
        behind = F.slice("ids", F.col("depth") + 1, F.size("ids") - F.col("depth"))
        # the first and the last list share what all share
        ends = mine.groupBy("key").agg(F.min(behind).alias("a"), F.max(behind).alias("b"), F.first("up").alias("up"), F.first("up_conv").alias("up_conv"), F.first("depth").alias("top"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("least"))
        least = F.least(F.size("a"), F.size("b"))
        differ = F.array_position(F.zip_with(F.slice("a", F.lit(1), least), F.slice("b", F.lit(1), least), lambda x, y: x == y), False)
        shared = F.when(differ == 0, least).otherwise(differ - 1).cast("int")
        ends = stage(ends.select("key", "up", "up_conv", "top", "n_convs", "least", (F.col("top") + shared).alias("at")), "bursting")
        mine = mine.drop("up", "up_conv").join(few(ends), "key")
        closed = F.size("ids") == F.col("at")
        own = F.when(F.col("top") > 0, F.slice("words", F.col("top"), F.col("at") - F.col("top") + 1)).otherwise(F.concat(F.array(F.lit(0)), F.slice("words", F.lit(1), F.col("at"))))
        told = mine.groupBy("key").agg(F.first(own).alias("own"), F.max(F.when(closed, F.col("ends"))).alias("ends"))
        heads.append(stage(ends.join(told, "key"), "heads"))
        key = _hash(F.col("key"), F.col("ids")[F.col("at")]).alias("key")
        child = mine.where(~closed).select(key, F.col("key").alias("up"), F.col("least").alias("up_conv"), (F.col("at") + 1).alias("depth"), "ids", "words", "n", "conv_id", "ends")
        left = stage(child, "containers")
    return reduce(DataFrame.unionByName, settled, left), heads


SWEPT = "key binary, up binary, up_conv long, top int, opened long, above long, depth int, conv_id long, n long, children long, leaves long, saved long, ends string"


def _sweep(containers: DataFrame) -> DataFrame:
    """The nodes of containers: key, up, up_conv, top (depth of the container's first node), opened (a number of the node within
    the container), above (its parent's, null for the first), depth, conv_id, n, children, leaves, saved, ends."""

    def sweep(batches):
        names = ["key", "up", "up_conv", "top", "opened", "above", "depth", "conv_id", "n", "children", "leaves", "saved", "ends"]
        types = [pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string()]
        key = up = up_conv = None
        top = opened = 0
        before: list[bytes] = []
        stack: list[list] = []  # opened, conv_id, n, children, leaves, saved, ends, words; the first has depth `top`
        out: list[tuple] = []

        def close(to: int) -> None:
            """Closes nodes until `to` are open."""
            while len(stack) > to:
                number, conv, n, children, leaves, saved, ends, words = stack.pop()
                leaves, saved = leaves or 1, saved + (n - 1) * words
                above = None
                if stack:
                    parent = stack[-1]
                    above = parent[0]
                    parent[1], parent[2] = min(parent[1], conv), parent[2] + n
                    parent[3], parent[4], parent[5] = parent[3] + 1, parent[4] + leaves, parent[5] + saved
                out.append((key, up, up_conv, top, number, above, top + len(stack), conv, n, children, leaves, saved, ends))

        def told():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

        for batch in batches:
            columns = {c: batch.column(c) for c in ("ids", "words")}
            plain = zip(*(batch.column(c).to_pylist() for c in ("key", "up", "up_conv", "depth", "n", "conv_id", "ends")))
            for i, (k, u, uc, depth, n, conv, ends) in enumerate(plain):
                ids, words = columns["ids"][i].as_py(), columns["words"][i].as_py()
                same = 0
                if stack and k == key:
                    same = depth
                    while same < len(before) and same < len(ids) and before[same] == ids[same]:
                        same += 1
                    close(same - depth + 1)
                else:
                    close(0)
                    key, up, up_conv, top, opened = k, u, uc, depth, 0
                    stack.append([0, conv, 0, 0, 0, 0, NONE, words[depth - 1] if depth else 0])
                    same = depth
                for w in words[same:]:
                    opened += 1
                    stack.append([opened, conv, 0, 0, 0, 0, NONE, w])
                end = stack[-1]
                end[1], end[2], end[6] = min(end[1], conv), end[2] + n, ends
                before = ids
                if len(out) >= 4_000:
                    yield told()
                    out.clear()
        close(0)
        if out:
            yield told()

    ordered = containers.repartition("key").sortWithinPartitions("key", "ids")
    return ordered.mapInArrow(sweep, SWEPT)


def trie(lists: DataFrame, load: int = LOAD, most: int = MOST_BURSTS) -> DataFrame:
    """The nodes of the trie over lists (ids, words, n, conv_id, ends): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    root = lists.select(F.lit(b"").alias("key"), F.lit(None).cast("binary").alias("up"), F.lit(None).cast("long").alias("up_conv"), F.lit(0).alias("depth"), "ids", "words", "n", "conv_id", "ends")
    containers, heads = _burst(root, load, most)
    swept = stage(_sweep(containers), "swept")
    parents = swept.where("children > 0").select("key", F.col("opened").alias("above"), F.col("conv_id").alias("parent"))
    inner = swept.where("above is not null").join(parents, ["key", "above"])
    col = F.col
    nodes = inner.select(*_node(*map(col, ("conv_id", "depth", "parent", "n", "children", "leaves", "saved", "ends"))))
    tops = swept.where("above is null")
    nodes = nodes.unionByName(tops.select(*_node(*map(col, ("conv_id", "depth", "up_conv", "n", "children", "leaves", "saved", "ends")))))
    counts = [F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("under").alias("under")]
    # a row for each head, and of heads only those of the round after come in later
    below = stage(tops.groupBy(F.col("up").alias("key")).agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("under")), "below")
    above = None
    for level in reversed(heads):
        sums = below if above is None else below.unionByName(above).groupBy("key").agg(*counts)
        chain = level.join(sums, "key").withColumn("gained", F.transform("own", lambda w: (F.col("n_convs") - 1) * w))
        # from the last node of the chain to the first
        chain = stage(chain.withColumn("saved", F.col("under") + _sum(col("gained"))), "chains")
        each = chain.select("*", F.posexplode("gained").alias("i", "g"))
        last = F.col("i") == F.size("own") - 1
        saved = F.col("saved") - _sum(F.slice("gained", F.lit(1), col("i")))
        parent = F.when(col("i") == 0, col("up_conv")).otherwise(col("least"))
        ends = F.when(last, F.coalesce("ends", F.lit(NONE))).otherwise(NONE)
        nodes = nodes.unionByName(each.select(*_node(col("least"), col("top") + col("i"), parent, col("n_convs"), F.when(last, col("children")).otherwise(1), col("leaves"), saved, ends)))
        above = chain.select(F.col("up").alias("key"), F.lit(1).cast("long").alias("children"), "leaves", F.col("saved").alias("under"))
    return nodes


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def build(turns: DataFrame, load: int = LOAD, most: int = MOST_BURSTS) -> DataFrame:
    """The trie of the rebuilt conversations of turns (conv_id, turn, role, text)."""
    return trie(distinct_lists(rebuilt(stage(conversations_of(turns), "conversations"))), load, most)
