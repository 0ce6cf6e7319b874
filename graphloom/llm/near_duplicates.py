"""Exact n-gram Jaccard join by T-occurrence search, and the groups that its links make.

Two texts link when 100 * |a & b| >= percent * |a | b| over their sets of five-word shingles.
Texts with the same word sequence are one entry, kept by a 64-bit hash of it.

A text of n shingles overlaps in at least T = percent * n shingles with whatever it links
with.  Its inverted lists, in one order for all texts (rarest first), are divided as
DivideSkip does: the last L = T - k are long and are never merged, only probed; the others
are short, and whatever links occurs at least k = T - L times in short lists of both texts.

1. Half of all shingles, chosen by hash, come first in the order, by frequency; the others,
   needed for texts with few of the first half, follow by hash.  Shingles of one text alone
   cost nothing further, and a text with enough of them has no candidates at all.  Shingles
   that a bounded sample shows to be very common are dealt out by text as well.
2. In a list, each text looks at those with a smaller hash, without emitting pairs: sizes,
   then 1024-bit parity sketches, whose distance is never above the true difference, rule out
   nearly all that do not link.  What is left is the list's run for this text, nearest first.
   Large lists are dealt out in blocks.
3. The runs of a text's short lists meet in a heap, which merges them and counts how often
   each candidate occurs; those with at least k occurrences are probed: binary searches of
   the smaller set in the larger.
4. This goes in rounds.  A list gives a text its nearest few candidates only (1, then 4, 16,
   ...) outside of the text's group, and the text remembers up to where its candidates are
   closed: as far as every list's run reaches.  All links so far join groups completely before
   the next round, so a large group of near copies costs a few pairs for each text, not all
   its pairs.  The rounds end when every text has closed all its candidates or shares a group
   with them.

No pair that links different groups escapes; nothing is capped or sampled.

Null and empty texts have the size 0 and link with nothing.  Repeated rows, and rows with a
null or repeated id, are documents of their own; a group's id is its smallest non-null
doc_id (null if it has none).  An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from graphloom.llm.shingles import Shingled, mix
from graphloom.llm.units import blocks
from graphloom.session import stage

PERCENT = 75
#: A text of n shingles asks for 1 + n // OCCURRENCES occurrences in short lists.
OCCURRENCES = 40
#: Entries of a list that meet in one task; bits of a sketch.
BLOCK, BITS = 4_000, 1_024
#: Candidates that a list gives a text in the first round, and how many times more in each round.
NEAREST, MORE = 1, 4
#: Documents that show which shingles are common, the share of them that makes one common, and how finely its entries are dealt.
SAMPLE, COMMON, DEALT = 20_000, 0.004, 256


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, and th: a hash of the whole text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def _least_overlap(n, percent: int):
    """The smallest overlap of a set of n with any set that it links with."""
    return -(-percent * n // 100)


def _occurrences(n):
    """k: how often what links with a set of n occurs in its short lists."""
    return 1 + n // OCCURRENCES


def _short(n, percent: int):
    """How many short lists a set of n has."""
    return n - _least_overlap(n, percent) + _occurrences(n)


def shingle_counts(docs: DataFrame) -> DataFrame:
    """doc_id, th, fp (hash of the word sequence; null without words), n (size of the set)."""

    def count(batches):
        for batch in batches:
            for block in blocks(batch):
                s = Shingled(block.column("text"))
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("th"), pa.array(s.print.view(np.int64), mask=s.words == 0), pa.array(s.size)], names=["doc_id", "th", "fp", "n"])

    return _texts(docs).mapInArrow(count, "doc_id long, th long, fp long, n long")


def _listed(docs: DataFrame, percent: int) -> DataFrame:
    """token, fp, size (of the set, times 2^32, plus the tokens given): what may be in a text's short lists."""

    def give(batches):
        for batch in batches:
            for block in blocks(batch):
                s = Shingled(block.column("text"))
                front = (s.values & np.uint64(1)) == 0
                in_front = np.bincount(s.owner[front], minlength=len(s.size))
                short = _short(s.size, percent)
                # place of each shingle among those of its text that are not in the first half
                behind = np.cumsum(~front) - 1
                begin = np.cumsum(s.size - in_front) - (s.size - in_front)
                extra = ~front & (behind - begin[s.owner] < (short - in_front)[s.owner])
                given = np.where(s.size > 0, np.maximum(in_front, np.minimum(short, s.size)), 0)
                use = front | extra
                owner = s.owner[use]
                size = (s.size << 32) + given
                out = pa.RecordBatch.from_arrays([pa.array(x[owner] if x is not None else s.values[use].view(np.int64)) for x in (None, s.print.view(np.int64), size)], names=["token", "fp", "size"])
                for at in range(0, len(out), 200_000):
                    yield out.slice(at, 200_000)

    return _texts(docs).mapInArrow(give, "token long, fp long, size long")


def _common(docs: DataFrame, rows: int, percent: int) -> DataFrame:
    """token, often (about how many texts have it): shingles that a sample of about SAMPLE documents shows to be common.

    Every document has COMMON * SAMPLE such shingles at most on average; the sample only says what is dealt more finely."""
    share = min(1.0, SAMPLE / max(rows, 1))
    sample = docs.sample(share, seed=5) if share < 1 else docs
    seen = _listed(sample, percent).groupBy("token").agg(F.countDistinct("fp").alias("c"))
    return seen.where(F.col("c") >= max(8, int(COMMON * min(rows, SAMPLE)))).select("token", (F.col("c") / share).cast("long").alias("often"))


def short_lists(docs: DataFrame, rows: int, percent: int = PERCENT) -> DataFrame:
    """token, fp: the entries of texts in their short lists, without lists of one text.

    A common shingle has its frequency from the sample; any order of lists will do, if it is one for all texts."""
    common = stage(_common(docs, rows, percent), "common")
    listed = _listed(docs, percent).join(F.broadcast(common), "token", "left")
    listed = listed.withColumn("deal", F.when(F.col("often").isNull(), 0).otherwise(F.pmod("fp", F.lit(DEALT))))
    list_ = Window.partitionBy("token", "deal")
    listed = listed.withColumn("c", F.count("*").over(list_)).where("c > 1 or often is not null").drop("c")
    listed = listed.groupBy("token", "deal", "fp").agg(F.first("size").alias("size"), F.first("often").alias("often"))  # copies
    listed = listed.withColumn("c", F.coalesce("often", F.count("*").over(list_))).where("c > 1")
    own = Window.partitionBy("fp")
    n, given = F.shiftright("size", 32), F.col("size") % (1 << 32)
    short = n - F.ceil(n * percent / 100) + 1 + F.floor(n / OCCURRENCES)
    # the order: the first half (even tokens), by frequency, then the others; lists of one text came before
    listed = listed.withColumn("place", F.row_number().over(own.orderBy(F.col("token").bitwiseAND(1), "c", "token"))).withColumn("k", F.count("*").over(own))
    alone = given - F.col("k")
    return listed.where(F.col("place") <= short - alone).select("token", "fp")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp, n, bits, values of the texts whose id and hash are wanted."""

    def give(batches):
        for batch in batches:
            for block in blocks(batch):
                s = Shingled(block.column("text"))
                bit = (mix(s.values) % np.uint64(BITS)).astype(np.int64)
                parity = np.bincount(s.owner * BITS + bit, minlength=len(s.size) * BITS).reshape(-1, BITS) & 1
                bits = np.packbits(parity.astype(np.uint8), axis=1)
                offsets = np.concatenate([[0], np.cumsum(s.size)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.print.view(np.int64)), pa.array(s.size), pa.array([b.tobytes() for b in bits], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(s.values.view(np.int64)))],
                    names=["fp", "n", "bits", "values"],
                )

    # `wanted` has a row for each word sequence: the id and hash of one document that has it
    w = wanted.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    t = _texts(docs)
    texts = t.join(w, (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return texts.mapInArrow(give, "fp long, n long, bits binary, values array<long>").dropDuplicates(["fp"])


def _allowed(n1, n2, percent: int):
    """The most in which two linked sets of these sizes differ."""
    both = n1 + n2
    return both - 2 * (-(-percent * both // (100 + percent)))


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _probe(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those that link: the smaller set is searched in the larger."""

    def probe(batches):
        for batch in batches:
            v1, v2 = batch.column("v1"), batch.column("v2")
            keep = []
            for i in range(len(batch)):
                x, y = (v[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for v in (v1, v2))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("fp").alias("a"), F.col("values").alias("v1"))
    two = sets.select(F.col("fp").alias("b"), F.col("values").alias("v2"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(probe, "a long, b long")


def _starred(edges: DataFrame) -> DataFrame:
    """One large star and one small star: (u, v) with v < u, connecting what the edges connect."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
    return small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node that it is connected with), by alternating large and small stars.

    `edges`: a, b.  Nodes that are the smallest themselves are given as well."""
    edges, last = stage(_ends(edges), "edges"), None
    while True:
        edges = stage(_starred(edges), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first()
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _by_list(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, F.desc("fp"))


def _whole(batches, keys: list[str]):
    """Batches put together and cut so that rows of one key are in one; with the ends of the keys' runs."""
    held: list = []

    def cut(last: bool):
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        columns = [np.asarray(batch.column(c), np.int64) for c in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        held.clear()
        if not last:
            at = int(cuts[-1]) if len(cuts) else 0
            held.append(batch.slice(at))
            batch, cuts = batch.slice(0, at), cuts[:-1]
        return batch, np.r_[cuts, len(batch)].astype(np.int64)

    for batch in batches:
        if len(batch):
            held.append(batch)
            if sum(map(len, held)) >= 20_000:
                batch, ends = cut(False)
                if len(batch):
                    yield batch, ends
    if held:
        yield cut(True)


def _runs(lists: DataFrame, texts: DataFrame, percent: int, most: int) -> DataFrame:
    """For each text (a) and list the nearest candidates, at most `most`: their sketches' distances d and hashes b, ascending.

    `lists`: token, fp.  `texts`: fp, n, bits, label (of its group), asks, and d0, b0: where its closed candidates end.
    `more` says that the list has further ones."""
    labels = texts.select("fp", "label", "asks")
    of = lists.join(labels, "fp").groupBy("token").agg(F.count("*").alias("c"), F.min("label").alias("l1"), F.max("label").alias("l2"), F.max("asks").alias("any"))
    of = of.where("l1 <> l2 and any").select("token", F.ceil(F.col("c") / BLOCK).alias("parts"))
    dealt = lists.join(of, "token").withColumn("part", F.pmod(F.xxhash64("fp"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("fp", "token", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part")
    dealt = dealt.join(texts, "fp").select("token", "p", "q", "part", "fp", "n", "bits", "label", "asks", "d0", "b0")

    def look(batches):
        for batch, ends in _whole(batches, ["token", "p", "q"]):
            n, part, p, q, fp, label, d0, b0 = (np.asarray(batch.column(c), np.int64) for c in ("n", "part", "p", "q", "fp", "label", "d0", "b0"))
            asks = np.asarray(batch.column("asks"), bool)
            bits = _bits(batch.column("bits"))
            # each row looks at all behind it in its list: texts with smaller hashes
            partners = np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(len(batch)) - 1
            partners[~asks] = 0
            before = np.r_[0, np.cumsum(partners)]
            at = 0
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(before, before[at] + 1_000_000, "right")) - 1)
                i = np.repeat(np.arange(at, to), partners[at:to])
                j = i + 1 + np.arange(len(i)) - (before[i] - before[at])
                at = to
                n1, n2 = n[i], n[j]
                open_ = (label[i] != label[j]) & (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & ((p[i] == q[i]) | (part[i] != part[j]))
                i, j = i[open_], j[open_]
                d = np.zeros(len(i), np.int64)
                for a in range(0, len(i), 50_000):
                    d[a : a + 50_000] = np.bitwise_count(bits[i[a : a + 50_000]] ^ bits[j[a : a + 50_000]]).sum(1)
                b = fp[j]
                near = (d <= _allowed(n[i], n[j], percent)) & ((d > d0[i]) | (d == d0[i]) & (b > b0[i]))
                i, d, b = i[near], d[near], b[near]
                if not len(i):
                    continue
                order = np.lexsort((b, d, i))
                i, d, b = i[order], d[order], b[order]
                first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                many = np.diff(np.r_[first, len(i)])
                keep = np.arange(len(i)) - np.repeat(first, many) < most
                offsets = np.r_[0, np.cumsum(np.minimum(many, most))].astype(np.int32)
                a = i[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp[a]), pa.array(n[a]), pa.ListArray.from_arrays(offsets, pa.array(d[keep])), pa.ListArray.from_arrays(offsets, pa.array(b[keep])), pa.array(many > most)],
                    names=["a", "n", "d", "b", "more"],
                )

    return _by_list(dealt, "token", "p", "q").mapInArrow(look, "a long, n long, d array<long>, b array<long>, more boolean")


def merged(runs: list[list[tuple[int, int]]], more: list[bool], least: int) -> tuple[list[int], tuple[int, int] | None]:
    """Candidates with `least` occurrences in ascending runs, and up to where that is certain: the nearest end
    of a run that has more (None: everywhere)."""
    end = min((r[-1] for r, m in zip(runs, more) if m), default=None)
    found, last, count = [], None, 0
    for x in heapq.merge(*runs):
        if end is not None and x > end:
            break
        count = count + 1 if x == last else 1
        last = x
        if count == least:
            found.append(x[1])
    return found, end


def _candidates(runs: DataFrame, percent: int) -> DataFrame:
    """a, b (array: to be probed), d0, b0 (where its closed candidates end; null: all are closed)."""

    def count(batches):
        for batch, ends in _whole(batches, ["a"]):
            rows = batch.to_pydict()
            out = []
            for i, j in zip([0, *ends[:-1].tolist()], ends.tolist()):
                # a partner may be smaller by as much as percent allows, and then needs fewer occurrences
                least = int(_occurrences(_least_overlap(rows["n"][i], percent)))
                found, end = merged([list(zip(rows["d"][x], rows["b"][x])) for x in range(i, j)], rows["more"][i:j], least)
                out.append((rows["a"][i], found, *(end or (None, None))))
            a, b, d0, b0 = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.list_(pa.int64())), pa.array(d0, pa.int64()), pa.array(b0, pa.int64())], names=["a", "b", "d0", "b0"])

    ordered = runs.repartition("a").sortWithinPartitions("a")
    return ordered.mapInArrow(count, "a long, b array<long>, d0 long, b0 long")


def links(lists: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame | None:
    """node, label: the groups of texts that links join (None: there is no link)."""
    small = sets.select("fp", "n", "bits")
    open_, groups, most = None, None, NEAREST
    while True:
        texts = small.withColumn("label", F.col("fp")) if groups is None else small.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        if open_ is None:
            texts = texts.withColumns({"asks": F.lit(True), "d0": F.lit(-1).cast("long"), "b0": F.lit(0).cast("long")})
        else:
            texts = texts.join(open_, "fp", "left").withColumn("asks", F.col("d0").isNotNull()).fillna(0, ["d0", "b0"])
        found = stage(_candidates(_runs(lists, texts, percent, most), percent), "candidates")
        pairs = found.select("a", F.explode("b").alias("b"))
        linked = stage(_probe(pairs, sets, percent), "links")
        if not linked.isEmpty():
            edges = linked if groups is None else linked.unionByName(groups.select(F.col("node").alias("a"), F.col("label").alias("b")))
            groups = components(edges)
        open_ = found.where("d0 is not null").select(F.col("a").alias("fp"), "d0", "b0")
        if open_.isEmpty():
            return groups
        most *= MORE


def grouped(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, th (hash of the text), fp, n_shingles, kept (doc_id and th of the first of the group, by id, then by hash; null without words)."""
    counts = stage(shingle_counts(docs), "counts")
    first: Column = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    firsts = stage(counts.where("fp is not null").groupBy("fp").agg(first.alias("first")), "firsts")
    lists = stage(short_lists(docs, counts.count(), percent), "short-lists")
    wanted = firsts.join(lists.select("fp").distinct(), "fp", "left_semi").select("first.doc_id", "first.th")
    groups = links(lists, stage(_sets(docs, wanted), "sets"), percent)
    if groups is not None:
        labelled = stage(firsts.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labelled")
        firsts = labelled.select("fp", "label").join(labelled.groupBy("label").agg(F.min("first").alias("first")), "label").select("fp", "first")
    with_words = counts.where("fp is not null").join(firsts, "fp").select("doc_id", "th", "fp", F.col("n").alias("n_shingles"), F.struct("first.doc_id", "first.th").alias("kept"))
    none = counts.where("fp is null").select("doc_id", "th", "fp", F.col("n").alias("n_shingles"), F.lit(None).cast("struct<doc_id:bigint,th:bigint>").alias("kept"))
    return with_words.unionByName(none)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs`."""
    component = F.when(F.col("kept").isNull(), F.col("doc_id")).otherwise(F.col("kept.doc_id"))
    return grouped(docs, percent).select("doc_id", "n_shingles", component.alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of each group the first row, by id, then by the text's hash, then by the other columns; rows without words all stay."""
    kept = grouped(docs, percent).where("kept is not null").select("kept.*").distinct().select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    text = F.coalesce("text", F.lit(""))
    columns = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(docs.columns, columns)), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(text).alias("_hash"), F.lower(text).rlike(r"[^\x20\x09-\x0D]").alias("_words"))
    chosen = rows.where("_words").join(kept, (F.col("_hash") == F.col("_th")) & F.col("_doc").eqNullSafe(F.col("_id")), "left_semi")
    one = Window.partitionBy("_doc", "_hash").orderBy(F.xxhash64(*columns))
    chosen = chosen.withColumn("_row", F.row_number().over(one)).where("_row = 1")
    return chosen.select(*columns).unionByName(rows.where("not _words").select(*columns)).toDF(*docs.columns)
