"""Document fingerprints from closed syncmers, in DataFrame functions alone.

A text's words (runs without white space) are hashed, with K - 1 empty words before and behind
them, so that one rule holds for texts of any length.  A run of K words is a closed syncmer if,
of its inner runs of S words, one with the smallest hash lies at its first or last place; that
depends on these K words only, so an edit moves no anchor elsewhere.  A fingerprint is all of a
text's syncmers (anchors) with their places, in hexadecimal.

Likeness matches anchors by place: two neighbouring anchors (and the start and the first one)
make a link, the hash of both and of how far apart they are.  The likeness of two texts is the
share of distinct links that both have in those that either has.  A link needs no more than its
own two anchors to agree in relative place, so inserted, cut or moved parts cost their own links
only, and chance meetings of single anchors count for nothing.

Null and empty texts, and texts of white space, have no anchor: an empty fingerprint, like (1.0)
another empty one and unlike (0.0) any other.  Repeated rows and rows with a null or repeated id
are documents of their own; null ids come first, ties go by the hash of the text.  An empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from graphloom.session import stage

K, S = 5, 2
#: Rows of a run of documents in doc_id order, runs at most, and runs of a range of sorted keys.
RUN_ROWS, MOST_RUNS, RANGE_RUNS = 500, 100_000, 64


def _hashes(text: Column) -> Column:
    """Hashes of the words, between empty ones."""
    words = F.filter(F.split(text, r"[\x20\t\n\x0B\f\r]"), lambda w: w != "")
    edge = F.array_repeat(F.lit(0).cast("long"), K - 1)
    return F.concat(edge, F.transform(words, lambda w: F.xxhash64(w)), edge)


def anchors(df: DataFrame, text: str, to: str) -> DataFrame:
    """Adds `to`: array of (place, hash) of the closed syncmers of the whole text; place 0 is K - 1 words before the first."""
    h, inner, at = (F.col(f"{to}_{x}") for x in ("h", "s", "i"))
    df = df.withColumn(f"{to}_h", _hashes(F.coalesce(F.col(text), F.lit(""))))
    # hashes of the runs of S words; then where the smallest of those in K words is the first or the last
    df = df.withColumn(f"{to}_s", F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, S, F.size(h) - 1), lambda a, b: F.xxhash64(a, b)))
    last = K - S

    def closed(i):
        rest = F.least(*(F.get(inner, i + j) for j in range(last + 1)))
        return (F.get(inner, i) == rest) | (F.get(inner, i + last) == rest)

    places = F.sequence(F.lit(0), F.size(h) - K)
    df = df.withColumn(f"{to}_i", F.when(F.size(h) >= 2 * K - 1, F.filter(places, closed)).otherwise(F.array().cast("array<int>")))
    hashed = lambda i: F.struct(i.alias("place"), F.xxhash64(F.get(inner, i), F.get(inner, i + S), F.get(h, i + (K - 1))).alias("hash"))
    return df.withColumn(to, F.transform(at, hashed)).drop(f"{to}_h", f"{to}_s", f"{to}_i")


def as_text(found: Column) -> Column:
    """place:hash of each anchor."""
    return F.lower(F.array_join(F.transform(found, lambda x: F.concat(F.hex(x["place"].cast("long")), F.lit(":"), F.hex(x["hash"]))), ","))


def links(found: Column) -> Column:
    """The distinct links of neighbouring anchors."""
    before = F.concat(F.slice(found, 1, 0), F.array(F.get(found, F.lit(0))), F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))))
    pairs = F.zip_with(found, F.slice(before, 1, F.size(found)), lambda x, y: F.xxhash64(y["hash"], x["hash"], x["place"] - y["place"]))
    return F.array_distinct(pairs)


def likeness(a: Column, b: Column) -> Column:
    """Likeness (0 to 1) of two texts by their distinct links."""
    shared = F.size(F.array_intersect(a, b))
    sizes = F.size(a) + F.size(b)
    return F.when(sizes == 0, 1.0).otherwise(shared / (sizes - shared))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row."""
    return anchors(docs.select("doc_id", "text"), "text", "found").select("doc_id", as_text(F.col("found")).alias("fingerprint"))


def in_runs(docs: DataFrame) -> DataFrame:
    """The rows (doc_id, text) dealt into runs of ascending doc_id: with _key (what orders them), _run, and _mark.

    A run also has, with _mark 1 and in the end, a copy of the first row of the next run (the last: of the first
    run), so no run needs another.  Spark's range partitioning of the keys alone says where runs begin; rows of
    one id with one text stay in one run.  What is broadcast are the first keys of MOST_RUNS runs at most."""
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.xxhash64("text").alias("th"))
    keys = docs.select(key.alias("k"))
    rows = keys.count()
    runs = int(min(max(1, rows // RUN_ROWS), MOST_RUNS))
    # a row a run: every RUN_ROWS-th key of sorted partitions of many runs each
    ordered = keys.repartitionByRange(-(-runs // RANGE_RUNS), "k").sortWithinPartitions("k").withColumn("n", F.monotonically_increasing_id() % (1 << 33))
    firsts = stage(ordered.where(F.col("n") % F.lit(max(RUN_ROWS, rows // MOST_RUNS)) == 0).select("k").distinct(), "run-keys")
    count = firsts.count()
    side = math.isqrt(count) + 1
    numbered = firsts.withColumn("run", F.row_number().over(Window.orderBy("k")) - 1).withColumn("block", F.floor(F.col("run") / side).cast("int"))
    table = numbered.groupBy("block").agg(F.sort_array(F.collect_list("k")).alias("ks"), F.min("run").alias("base"))
    tops = [r.k for r in table.select(F.col("ks")[0].alias("k")).orderBy("k").collect()]
    if not count:
        return docs.select("*", key.alias("_key"), F.lit(0).alias("_run"), F.lit(0).alias("_mark"))
    literal = F.array(*(F.struct(F.lit(k.known).alias("known"), F.lit(k.id).cast("long").alias("id"), F.lit(k.th).cast("long").alias("th")) for k in tops))
    not_after = lambda cuts: F.size(F.filter(cuts, lambda c: c <= F.col("_key"))) - 1
    dealt = docs.select("*", key.alias("_key")).withColumn("block", not_after(literal)).join(F.broadcast(table), "block")
    dealt = dealt.withColumn("_at", not_after(F.col("ks")))
    run = (F.col("base") + F.col("_at")).cast("int")
    own, copy = F.struct(run.alias("run"), F.lit(0).alias("mark")), F.struct(F.pmod(run - 1, F.lit(count)).alias("run"), F.lit(1).alias("mark"))
    dealt = dealt.withColumn("_to", F.explode(F.when(F.get(F.col("ks"), F.col("_at")) == F.col("_key"), F.array(own, copy)).otherwise(F.array(own))))
    return dealt.select(*docs.columns, "_key", F.col("_to.run").alias("_run"), F.col("_to.mark").alias("_mark"))


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of the document with its second half replaced by the start of the next.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = in_runs(rows).repartition("_run")
    rows = anchors(rows, "text", "found").withColumn("links", links(F.col("found")))
    order = Window.partitionBy("_run").orderBy("_mark", "_key")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_links", F.lead("links").over(order)).where("_mark = 0")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, int(n_chars - floor(n_chars / 2)))"), F.substring("next_text", F.lit(1), half)))
    rows = anchors(rows, "edited", "edited_found").withColumn("edited_links", links(F.col("edited_found")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("found")).alias("fingerprint"),
        as_text(F.col("edited_found")).alias("edited_fingerprint"),
        likeness(F.col("links"), F.col("edited_links")).alias("near_edited"),
        likeness(F.col("links"), F.col("next_links")).alias("near_next"),
    )
