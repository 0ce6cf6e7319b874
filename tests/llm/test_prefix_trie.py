"""The trie against one in plain Python."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm import prefix_trie, queries
from graphloom.session import table

SF = "/root/testdata/sf0.01"


def plain_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = [*own.get(c - c % 20, [])[:h], *ts[h:]]
    return out


def plain(lists):
    """conv_id, depth, parent, members, children, leaves, saved, ends of every node; lists by conv_id."""
    nodes = {}
    for c, ts in lists.items():
        for d in range(len(ts) + 1):
            n = nodes.setdefault(tuple(ts[:d]), {"m": [], "e": [], "k": 0, "leaves": 0, "saved": 0})
            n["m"].append(c)
            if d == len(ts):
                n["e"].append(c)
    for key in sorted(nodes, key=len, reverse=True):
        n = nodes[key]
        n["leaves"] = n["leaves"] or 1
        n["saved"] += (len(n["m"]) - 1) * len(re.findall("[^ \t-\r]+", key[-1][1])) if key else 0
        if key:
            p = nodes[key[:-1]]
            p["k"], p["leaves"], p["saved"] = p["k"] + 1, p["leaves"] + n["leaves"], p["saved"] + n["saved"]
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(n["m"]), len(k), min(nodes[k[:-1]]["m"]) if k else None, len(n["m"]), n["k"], n["leaves"], n["saved"], digest(n["e"])) for k, n in nodes.items()), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("load, most", [(4_096, 40), (30, 40), (1, 40), (1, 2)])
def test_random(spark, load, most):
    """Few distinct turns, so prefixes are shared at every depth; some conversations are copies, some very long chains."""
    rng = random.Random(load + most)
    rows = []
    for c in range(0, 300):
        kind = rng.random()
        turns = [rng.choice("ab") + " w" * rng.randrange(2) for _ in range(rng.randrange(7))] if kind < 0.6 else ["s"] * rng.randrange(1, 30) if kind < 0.8 else ["copy", "of", "one"] * 4
        rows += [(c, i, rng.choice(["u", "v"]) if kind < 0.3 else "u", t) for i, t in enumerate(turns)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert rows_of(prefix_trie.build(df, load, most)) == plain(plain_rebuilt(rows))


def test_odd(spark):
    rows = [
        (20, 0, "u", "a b"), (20, None, None, None), (20, 1, "", ""), (20, 1, "", ""), (21, 5, "u", "a\x0bb c"), (22, None, None, None), (23, 1, None, "x"), (23, 1, "", "x"), (None, 0, "u", "no id"),
        (-7, 0, "u", "minus"), (45, 0, "u", "one"), (45, 1, "u", "two"), (46, 0, "u", "of an absent block"), (60, 0, "u", "word " * 30_000), (61, 3, "u:", "1"), (61, 4, "u", ":1"), (40_000_000_000, 0, "u", "a b"),
    ]
    got = rows_of(prefix_trie.build(spark.createDataFrame([(*r, 1, "k", b"x") for r in rows], SCHEMA + ", n int, key string, ids binary"), 1))
    fixed = [(c, t, r, x) for c, t, r, x in rows if c != -7]
    minus = [r for r in rows if r[0] == -7]
    own = plain_rebuilt(fixed)
    own[-7] = [("u", "minus")][zlib.crc32(b"-7") % 4 :]  # its block is 0, which is absent
    assert minus and got == plain(own)


def test_turnless(spark):
    """A conversation that is shorter than what it would take from an absent one has no turns: the root alone."""
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    got = rows_of(prefix_trie.build(spark.createDataFrame([(c, 0, "u", "x")], SCHEMA)))
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_runs_of_ids(spark, monkeypatch):
    """Ids of one list in many runs and partitions have one digest, in numeric order."""
    monkeypatch.setattr(prefix_trie, "RUN", 7)
    rows = spark.range(-50, 950).select(F.col("id").alias("conv_id"), F.array(F.lit(b"a")).alias("ids"), F.array(F.lit(2)).alias("words")).repartition(5)
    got = prefix_trie.distinct_lists(rows).collect()
    assert [(r.conv_id, r.n, r.ends) for r in got] == [(-50, 1000, hashlib.sha256(",".join(map(str, range(-50, 950))).encode()).hexdigest())]


def test_empty(spark):
    assert prefix_trie.build(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op12_prefix_trie(spark, SF)) == plain(plain_rebuilt(rows))
