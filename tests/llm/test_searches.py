"""Neighbours, near duplicates, fingerprints, personal data and SentencePiece against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import fingerprints, near_duplicates, neighbours, personal_data, queries, sentencepiece_scan
from graphloom.session import table

from .conftest import ODD

SF = "/root/testdata/sf0.01"


# neighbours


def nearest(rows, k):
    """Brute force over (id, vector): {query: [(id, distance)]}."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in good:
        if q % 100 == 0:
            found = sorted({(float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q})
            out[q] = found[:k]
    return out


def test_neighbours_recall(spark):
    e = table(spark, SF, "embeddings")
    want = nearest([(r.vec_id, r.embedding) for r in e.collect()], 10)
    got = queries.op1_neighbours(spark, SF).collect()
    hit = sum((r.score, r.vec_id) in set(want[r.query_id]) for r in got)
    assert hit >= 0.9 * sum(map(len, want.values()))
    for q in want:
        mine = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)


def test_neighbours_of_a_real_tree(spark):
    """50,000 rows around 300 centres: far fewer leaves are visited than there are, and recall holds."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(300, 16))
    x = (centres[rng.integers(0, 300, 50_000)] + 0.35 * rng.normal(size=(50_000, 16))).round(4)
    tree = neighbours.grow(x[:20_000], len(x), 10, 0.97)
    assert tree.leaves > 50 and tree.visits < tree.leaves / 3, (tree.leaves, tree.visits)
    e = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    got = neighbours.search(e, F.col("vec_id") % 100 == 0).collect()
    hit, queries_ = 0, range(0, len(x), 100)
    mine = {}
    for r in got:
        mine.setdefault(r.query_id, set()).add(r.vec_id)
    for q in queries_:
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(mine[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hit >= 0.9 * 10 * len(queries_), hit


def test_neighbours_odd(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(1, 400)] + [(0, [1.0, 1.0, 1.0])] * 2 + [(1000 + i, [1.0, 1.0, 1.0]) for i in range(200)]
    rows += [(None, [1.0, 1.0, 1.0]), (500, None), (600, [0.0, 0.0, 0.0]), (700, [1.0, None, 2.0]), (800, [1.0, float("nan"), 1.0]), (900, [1.0])]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, v string, leaf int")
    got = neighbours.search(df, F.col("vec_id") % 100 == 0, leaf_rows=10).collect()
    want = nearest([r for r in rows if r[0] != 900], 10)
    assert {r.query_id for r in got} == set(want)
    for q, found in want.items():
        assert [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == found
    assert neighbours.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# near duplicates


def groups(docs):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    label = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and label[i] != label[j]:
                old = label[i]
                label = [label[j] if x == old else x for x in label]
    out = []
    for i, (d, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if label[j] == label[i] and docs[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids and sets[i] else d))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


def test_near_duplicates_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert order(map(tuple, near_duplicates.near_duplicates(table(spark, sf, "documents")).collect())) == order(groups(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_edits(spark, odd, none, seed, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 7)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([4, 6, 12, 60]))] for _ in range(12)]
    passage = [rng.choice(words) for _ in range(30)]
    docs = list(ODD)
    for i in range(220):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, max(1, len(w) // 10) + 1)):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.3:
            w += passage
        docs.append((100 + i, " ".join(w).upper() if rng.random() < 0.2 else "\t".join(w)))
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n int")
    assert order(map(tuple, near_duplicates.near_duplicates(df).collect())) == order(groups(docs))
    if seed == 1:
        assert near_duplicates.near_duplicates(none).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(a, a + 1) for a in range(50)] + [(rng.randrange(100, 140), rng.randrange(100, 140)) for _ in range(40)] + [(200, x) for x in range(201, 260)]
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in near_duplicates.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: l for x, l in label.items() if any(x in e and e[0] != e[1] for e in edges)}


# fingerprints


def test_fingerprints_documents(spark):
    docs = sorted((r.doc_id, r.text) for r in table(spark, SF, "documents").collect())
    got = {r.doc_id: r for r in queries.op9_fingerprints(spark, SF).collect()}
    same = {}
    for i, (d, t) in enumerate(docs):
        half = len(t) // 2
        e = t[: len(t) - half] + docs[(i + 1) % len(docs)][1][:half]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert same.setdefault(t, got[d].fingerprint) == got[d].fingerprint
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.97 * len(got)


def test_fingerprints_odd(spark, odd, none):
    rows = fingerprints.edited(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    th = {r.text: r.h for r in odd.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    docs = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, th[r[1] or ""]))
    want = []
    for i, (d, t) in enumerate(docs):
        t, n = t or "", docs[(i + 1) % len(docs)][1] or ""
        want.append((d, hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.edited_sha256) for r in rows) == sorted((d or -1, s) for d, s in want)
    assert fingerprints.edited(none).count() == 0 and fingerprints.fingerprints(none).count() == 0
    one = fingerprints.edited(odd.where("doc_id = 8")).collect()
    assert len(one) == 1


def plain_anchors(spark, texts):
    """Closed syncmers by loops: [(place, hash)] of each text."""
    K, S = fingerprints.K, fingerprints.S
    known = {}

    def hashes(keys):
        """Spark's 64-bit hashes of tuples of words or of numbers."""
        new = [k for k in dict.fromkeys(keys) if k not in known]
        for n in {len(k) for k in new}:
            part = [k for k in new if len(k) == n]
            kind = "string" if isinstance(part[0][0], str) else "long"
            rows = spark.createDataFrame(part, ", ".join(f"c{i} {kind}" for i in range(n)))
            known.update({tuple(r)[:n]: r.h for r in rows.withColumn("h", F.xxhash64(*rows.columns)).collect()})
        return [known[k] for k in keys]

    hashes([(w,) for t in texts for w in t.split()])
    h = [[0] * (K - 1) + [known[w,] for w in t.split()] + [0] * (K - 1) if t.split() else [] for t in texts]
    inner = [hashes([tuple(x[i : i + S]) for i in range(len(x) - S + 1)]) for x in h]
    out = []
    for x, s in zip(h, inner):
        found = [i for i in range(len(x) - K + 1) if min(s[i : i + K - S + 1]) in (s[i], s[i + K - S])]
        out.append(list(zip(found, hashes([(s[i], s[i + S], x[i + K - 1]) for i in found]))))
    return out


def plain_likeness(a, b):
    """By sets of neighbours that agree in hashes and in distance."""
    def links(found):
        return {(x[1], y[1], y[0] - x[0]) for x, y in zip([found[0], *found], found)} if found else set()

    one, two = links(a), links(b)
    return len(one & two) / len(one | two) if one or two else 1.0


def test_anchors_and_likeness_are_brute_force(spark):
    """Every anchor counts, in texts of any length: shared passages, edits, moved and repeated parts, few words."""
    rng = random.Random(7)
    word = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage, long, short = word(60), word(3000), word(3)
    texts = [
        long, long[:1500] + ["edit"] + long[1500:], word(2500) + passage + word(900), passage + word(1500), long[2000:] + long[:2000], passage * 3 + word(400),
        ["same"] * 700, ["same"] * 900, passage, passage[:30] + ["x"] + passage[30:], short, short, [], word(40) + long[10:18] + word(50), ["one"], ["one"], ["one", "two"], [" \t\n "], ["é\u00a0日"],
    ]
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain_anchors(spark, [t.replace("\u00a0", "_") for t in texts])
    found = {r.doc_id: [(x.place, x.hash) for x in r.f] for r in fingerprints.anchors(docs, "text", "f").collect()}
    rows = {r.doc_id: r for r in fingerprints.edited(docs).collect()}
    assert len(rows) == len(texts)
    halves = [t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2] for i, t in enumerate(texts)]
    again = plain_anchors(spark, [t.replace("\u00a0", "_") for t in halves])
    for i, r in rows.items():
        if "\u00a0" not in texts[i]:
            assert found[i] == want[i]
            assert r.fingerprint == ",".join(f"{p:x}:{h & (1 << 64) - 1:x}" for p, h in want[i])
            if "\u00a0" not in halves[i] + texts[(i + 1) % len(texts)]:
                assert r.near_next == pytest.approx(plain_likeness(want[i], want[(i + 1) % len(texts)])), i
                assert r.near_edited == pytest.approx(plain_likeness(want[i], again[i])), i
    near = {r.doc_id: r.near_next for r in rows.values()}
    assert 0.99 < near[0] < 1 and 0 < near[2] < 0.03 and near[10] == 1.0 and near[14] == 1.0


def test_one_rule_for_every_length(spark):
    """Nothing changes at any length: a text and the same text with one word more stay alike, from few characters to many."""
    words = [f"w{i}" for i in range(400)]
    rows = []
    for n in (8, 20, 39, 40, 41, 50, 51, 52, 100, 400):
        rows += [(len(rows), " ".join(words[:n])), (len(rows) + 1, " ".join(words[:n]) + " z")]
    assert {199, 201} & {len(t) for _, t in rows} or any(len(t) < 200 < len(u) for (_, t), (_, u) in zip(rows, rows[1:]))
    found = {r.doc_id: (r.near_next, len(r.fingerprint.split(","))) for r in fingerprints.edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(0, len(rows), 2):
        # a word at the end takes K - 1 anchors away and gives K new ones at most, and one more link of each
        near, n = found[i]
        assert near >= (n - fingerprints.K) / (n + fingerprints.K + 1), (n, near)


def test_runs(spark, monkeypatch):
    """Documents in many runs: the next of each is right, with null and repeated ids."""
    monkeypatch.setattr(fingerprints, "RUN_ROWS", 3)
    rng = random.Random(2)
    docs = [(rng.choice([None, 1, 2, *range(100, 130)]), f"text {i % 40} of {i % 3}") for i in range(150)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    th = {r.text: r.h for r in rows.select("text", F.xxhash64("text").alias("h")).collect()}
    ordered = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, th[r[1]]))
    want = []
    for i, (d, t) in enumerate(ordered):
        n = ordered[(i + 1) % len(ordered)][1]
        want.append((d or -1, hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.edited_sha256) for r in fingerprints.edited(rows).collect()) == sorted(want)


# personal data

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def luhn(s):
        return sum(v - 9 if (v := int(c) * (2 if i % 2 else 1)) > 9 else v for i, c in enumerate(reversed(s))) % 10 == 0

    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) < 256 for p in m[0].split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


HARD = [
    "a@b.c_d@e.f x@y a@b..c é mail.me+x%y@ab-c.de.", "1.2.3.4.5 256.1.1.1 001.02.3.255 1.2.3.4.5.6.7.8", "4111 1111 1111 1111 4111-1111-1111-1112 411111111111111",
    "+1 (743) 555-3824 +12345 +1-2 ++1 234 567 8901.", "1" * 3000 + " " + "a" * 3000 + "@" + "b.c" * 3000, "a@b.c" * 3000, "9" * 40 + " 4111111111111111é4111111111111111", "", None,
    'token = "ABCDEF0123456789ABCDEF0123456789" mail: u1@v.de',
]


def test_personal_data_forms(spark):
    rng = random.Random(5)
    texts = HARD + ["".join(rng.choice("aé1249 .@-+()x:") for _ in range(rng.randrange(80))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    got = {r.doc_id: r for r in personal_data.find(df).select("doc_id", personal_data.as_text(F.col("base")).alias("base")).collect()}
    for i, t in enumerate(texts):
        assert got[i].base == ",".join(plain_spans(t or "")), t


def test_personal_data_documents(spark):
    got = {r.doc_id: r for r in queries.op4_personal_data(spark, SF).collect()}
    for r in table(spark, SF, "documents").collect():
        want = plain_spans(r.text)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and got[r.doc_id].spans.startswith(",".join(want))


def test_patterns_discover(spark, odd, none):
    docs = [(i, f"contact: user{i}@mail.example.com and more words here") for i in range(20)]
    docs += [(100, "contact: someone-at-home and more"), (101, "note: someone-else-here and more"), (102, "note: hello.there friend"), (102, "note: hello.there friend")]
    docs += [(200 + i, f"note: word{'abcdefghij'[i]}x and") for i in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans = {(r.doc_id, s.kind, s.start, s.end) for r in personal_data.find(df).collect() for s in r.spans}
    assert (100, "email", 9, 24) in spans and not any(d in (101, 102) or d >= 200 for d, *_ in spans)
    texts = {r.doc_id: r.text for r in personal_data.redact(df).collect()}
    assert texts[0] == "contact: <EMAIL> and more words here" and texts[100] == "contact: <EMAIL> and more" and texts[101] == docs[21][1]
    assert personal_data.redact(df).count() == len(docs)
    assert sorted(personal_data.redact(odd).columns) == sorted(odd.columns) and personal_data.redact(odd).count() == odd.count()
    assert personal_data.find(none).count() == 0


def test_masked_is_brute_force(spark):
    """Marks in place of spans that may overlap, in texts with very many of them."""
    rng, rows = random.Random(3), []
    for n in [0, 1, 2, 5, 40, 300, 1500]:
        text = "".join(rng.choice("ab é") for _ in range(4 * n + 5))
        spans = [(rng.choice(["ip", "card"]), a, min(len(text), a + rng.randrange(1, 9))) for a in (rng.randrange(len(text)) for _ in range(n))]
        rows.append((text, spans))
    df = spark.createDataFrame(rows, f"text string, spans array<{personal_data.SPAN}>")
    for r in df.withColumn("got", personal_data.masked(F.col("text"), F.col("spans"))).collect():
        out, end = "", 0
        for kind, a, b in sorted(map(tuple, r.spans), key=lambda s: (s[1], -s[2])):
            if a >= end:
                out += r.text[end:a] + f"<{kind.upper()}>"
            end = max(end, b)
        if len({(a, -b) for _, a, b in r.spans}) == len(r.spans):
            assert r.got == out + r.text[end:]
        else:  # spans of the same bounds and several kinds: either kind
            assert re.sub("<[A-Z]+>", "<>", r.got) == re.sub("<[A-Z]+>", "<>", out + r.text[end:])


def test_values_run_to_their_end(spark):
    """Long, quoted and spaced values are whole; labels have digits and any length."""
    secret, label = "s3cr!t " * 30 + "end", "a_very_long_label_of_a_field_2"
    texts = [f'password="{secret}" x', "phone: +1 (743) 555-3824 at home", "oauth2_token=abc.def. Next", f"{label}='x y'", f"key={'k' * 5000}", 'q="open end', "call  me\nat x-1!"]
    fronts = ['password="', "phone: ", "oauth2_token=", f"{label}='", "key=", 'q="', "call me at "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = [re.findall(personal_data.ELEMENT.replace("++", "+").replace("*+", "*"), f) for f in fronts]
    h = lambda *x: spark.range(1).select(F.xxhash64(*(F.lit(v).cast("long") if i and isinstance(v, int) else F.lit(v) for i, v in enumerate(x)))).first()[0]
    patterns = [h(len(w), *(h(x) for x in w)) for w in words]
    got = {(r.pattern, r.value, r.start, r.end) for r in personal_data.places(docs, spark.createDataFrame([(p, h(w[-1])) for p, w in zip(patterns, words)], "pattern long, word long")).collect()}
    values = [secret, "+1", "abc.def", "x y", "k" * 5000, "open", "x-1"]
    assert got == {(p, v, len(f) + (i == 6), len(f) + (i == 6) + len(v)) for i, (p, v, f) in enumerate(zip(patterns, values, fronts))}
    rows = [(i, f"phone: +1 (743) 555-38{i}") for i in range(10, 20)] + [(50, "phone: 743-555-1234 at home")]
    spans = {(r.doc_id, s.kind, s.start, s.end) for r in personal_data.find(spark.createDataFrame(rows, docs.schema)).collect() for s in r.spans}
    assert (50, "phone", 7, 19) in spans


MARKS = r"\s:=#\x22'<>(){}\[\],;"


def plain_discover(docs):
    """Bootstrapping by loops over (id, text): {(id, kind, start, end)} of what is added."""
    element = re.compile(rf"[^{MARKS}]+[{MARKS}]*")
    key = re.compile(r"(?=[0-9]*[a-fA-F])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{32,64}")
    norm = lambda e: re.sub(r"\s+", " ", e).lower()

    def patterns(before, after):
        out = [(n, *before[-n:]) for n in (1, 2, 3) if len(before) >= n]
        return out + ([("after", before[-1], after)] if before and after else [])

    seeds, here, base_of = [], [], {}
    for d, t in docs:
        base = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in plain_spans(t))]
        base_of[d] = base
        keys = [("key", m.start(), m.end()) for m in re.finditer(rf"(?<![^{MARKS}]){key.pattern}(?=[.!?]*(?:[{MARKS}]|\Z))", t)]
        for kind, a, b in base + keys:
            if a == 0 or re.match(rf"[{MARKS}]", t[a - 1]):
                after = re.match(rf"[.!?]*[{MARKS}]+({element.pattern})", t[b:])
                for p in patterns([norm(x) for x in element.findall(t[:a])], after and norm(after[1])):
                    seeds.append((p, t[a:b], kind))
        found = list(element.finditer(t))
        for i in range(len(found) - 1):
            a = found[i + 1].start()
            quote = found[i][0][-1]
            m = re.match(rf"[^{quote}\r\n]+(?={quote})", t[a:]) if quote in "\"'" else None
            value = m[0] if m else re.sub(rf"[.!?]*[{MARKS}]*\Z", "", found[i + 1][0])
            for p in patterns([norm(x[0]) for x in found[: i + 1]], norm(found[i + 2][0]) if i + 2 < len(found) else None):
                here.append((p, value, d, a, a + len(value)))
    many = {p: len({v for q, v, _ in seeds if q == p}) for p in {s[0] for s in seeds}}
    times = {p: (sum(s[0] == p for s in seeds), sum(x[0] == p for x in here)) for p in many}
    kept = {p for p, n in many.items() if n >= personal_data.SUPPORT and times[p][0] >= personal_data.START * times[p][1]}
    here = [x for x in here if x[1] and x[0] in kept and not any(a < x[4] and x[3] < b for _, a, b in base_of[x[2]])]
    edges = {}
    for p, v, kind in [s for s in seeds if s[0] in kept] + [(x[0], x[1], "key" if key.fullmatch(x[1]) else None) for x in here]:
        edges[p, v] = max(filter(None, (edges.get((p, v)), kind)), default=None)
    of = {p: {v: k for (q, v), k in edges.items() if q == p} for p in kept}
    seed = {}
    for vs in of.values():
        for v, k in vs.items():
            seed[v] = max(filter(None, (seed.get(v), k)), default=None)
    belief = {v: float(k is not None) for v, k in seed.items()}
    for _ in range(personal_data.ROUNDS):
        score = {p: sum(belief[v] for v in vs) / (len(vs) + 0.5) for p, vs in of.items() if sum(seed[v] is not None for v in vs) >= personal_data.SUPPORT}
        score = {p: x for p, x in score.items() if x >= personal_data.SURE}
        for v in belief:
            if seed[v] is None:
                doubt = [1 - min(x, 0.99) for p, x in score.items() if v in of[p]]
                belief[v] = 1 - float(np.prod(doubt)) if doubt else 0.0
    return {(x[2], x[3], x[4]) for x in here if x[0] in score}


def test_discovery_is_brute_force(spark):
    """Plain words as contexts: unseen identifiers are found, lone keys are not, and the rounds equal loops."""
    rng = random.Random(9)
    word = lambda n: " ".join(rng.choice("alpha beta gamma delta omega kappa sigma theta".split()) for _ in range(n))
    hexa = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(36)) + "a1"
    texts = [f"{word(3)} call me at +1 743 555 {1000 + i} {word(2)}" for i in range(30)]
    texts += [f"{word(3)} call me at x-{i}-y {word(2)}" for i in range(3)] + [f"we met at noon {word(4)} at home", f"commit: {hexa()} {word(3)}"]
    texts += [f'{word(2)} token = "{hexa()}" {word(3)}' for _ in range(12)] + ['it says token = "not so long" here', f"{hexa()} alone"]
    texts += [f"{word(2)} write to u{i}@mail.example.org or {word(3)}" for i in range(9)] + ["please write to our-office-desk or leave", "", f"write to u1@mail.example.org. Then {word(5)}"]
    texts += [f"we sat at desk{chr(97 + i)} {word(2)} at hall{chr(97 + i)}" for i in range(20)]  # `at` alone is no sure pattern
    texts += [f"id={i} {word(3)}" for i in range(20)] + [f"reach u{i}@a.example.org via id={i}" for i in range(12)]
    # contexts far longer than what is looked at first, before and behind
    long, far = "very_long_label_" * 40, "z" * 700
    texts += [f"{word(2)} {long}: u{i}@far.example.org {word(3)}" for i in range(9)] + [f"{word(1)} {long}: some-one-at-far {word(2)}", f"{word(1)} x{long}: nothing {word(2)}"]
    texts += [f"so u{i}@near.example.org  {'.' * i} {far} {word(1)}" for i in range(3)] + [f"so u{i}@near.example.org {far} {word(1)}" for i in range(9)] + [f"so some-one-near {far} x"]
    texts += [" " * 300 + f"{far} {far} {far} u{i}@triple.example.org" for i in range(8)]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = plain_discover(docs)
    got = set()
    for r in personal_data.find(df).collect():
        got |= {(r.doc_id, s.start, s.end) for s in r.spans[len(r.base) :]}
    apart = {x for x in want if not any(x != y and x[0] == y[0] and y[1] <= x[1] < y[2] and (y[1], -y[2]) < (x[1], -x[2]) for y in want)}
    assert got == apart
    at = {(d, texts[d][a:b]) for d, a, b in got}
    assert {(30, "x-0-y"), (31, "x-1-y"), (47, "not so long")} <= at and {"some-one-at-far", "some-one-near"} <= {v for _, v in at} and "nothing" not in {v for _, v in at} and not any(d in (33, 34, 48) for d, _ in at)
    # a map of so few bits that it rules out little
    found = personal_data.stage(personal_data.extract(df), "base")
    several = {(r.key, tuple(map(tuple, r.spans))) for r in personal_data.discover(df, found, bits=64).collect()}
    assert several == {(r.key, tuple(map(tuple, r.spans))) for r in personal_data.discover(df, found).collect()}


# SentencePiece

MODEL = "piece_bpe_32k.model"


TEXTS = [t or "" for _, t in ODD if not t or len(t) < 2000] + [" a  b ", "日本語 x\n\ty", "   ", "\U0001f600 x", "nospaces" * 90, "é" * 50]


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file(MODEL))


def test_sentencepiece_is_the_library(spark):
    """Ids of whole texts, of texts of few characters in any order, and with a memory that forgets."""
    rng = random.Random(4)
    parts = ["a", "aa", "b", " ", " ", "  ", "ing", "the", "th", "e", "er", "é", "日", "\n", "\x00", "\U0001f600", "1", "0", ".", "ung"]
    texts = TEXTS + ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(2000)]
    for generation in (1_000, 24_000_000):
        code = sentencepiece_scan.Pieces(queries.tokenizer_file(MODEL), generation)
        code.beside = sentencepiece_scan.Pairs(code._ask, 1 << 10 if generation == 1_000 else 1 << 20)
        for at in range(0, len(texts), 500):
            part = texts[at : at + 500]
            got = code.encode(pa.array(part)).to_pylist()
            assert got == library().encode(part)
            assert [code.decode(np.array(x, int)) for x in got] == part
    mark = "▁a ▁ b▁"  # what the library takes for a blank has its ids, and comes back by its places
    ids = code.encode(pa.array([mark]))[0].values.to_numpy()
    assert ids.tolist() == library().encode(mark) and code.decode(ids, sentencepiece_scan.places_of([mark])[0].as_py()) == mark


def test_sentencepiece_chunks(spark, odd, none):
    """Any chunking, in one task or dealt out, gives the library's ids, and the text comes back."""
    model = queries.tokenizer_file(MODEL)
    texts = TEXTS + ["▁", "▁x ▁▁ y", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa ing" * 9]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    want = library().encode(texts)
    for chunk, run in ((1, 4), (5, 3), (17, 2), (3, 1_000_000), (100, 256)):
        encoded = sentencepiece_scan.encode(docs, model, chunk, run)
        rows = sentencepiece_scan.decode(encoded, model).collect()
        assert len(rows) == len(texts) + 1
        for r in rows:
            assert r.text == texts[r.doc_id] and r.ids == want[r.doc_id], (r, chunk)
    assert sentencepiece_scan.encode(none, model).count() == 0
    assert sentencepiece_scan.decode(sentencepiece_scan.encode(odd, model), model).count() == len(ODD)


def test_sentencepiece_chunks_of_documents(spark, sf):
    """Whole documents, each cut into many chunks, against the library."""
    docs = table(spark, sf, "documents").orderBy("doc_id").limit(12)
    want = {r.doc_id: library().encode(r.text) for r in docs.collect()}
    for r in sentencepiece_scan.encode(docs, queries.tokenizer_file(MODEL), 500, 3).collect():
        assert r.ids == want[r.doc_id]


def test_sentencepiece_scans_ordinary_documents(spark, monkeypatch):
    """At the chunk size of the query many documents go through products, with several states at their cuts."""
    seen = []
    plain = sentencepiece_scan.walk
    monkeypatch.setattr(sentencepiece_scan, "walk", lambda matrices, *ends: seen.append(matrices) or plain(matrices, *ends))
    texts = [r.text for r in table(spark, SF, "documents").collect()]
    code = sentencepiece_scan.Pieces(queries.tokenizer_file(MODEL))
    assert code.encode(pa.array(texts)).to_pylist() == library().encode(texts)
    assert len(seen) == sum(len(t) >= sentencepiece_scan.CHUNK for t in texts) > len(texts) / 10
    assert sum(m.shape[1] > 1 for matrices in seen for m in matrices) > len(seen)


def test_sentencepiece_documents(spark):
    got = {r.doc_id: r for r in queries.op6_sentencepiece(spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    for r, ids in zip(docs, library().encode([r.text for r in docs])):
        assert got[r.doc_id].text_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
        assert got[r.doc_id].n_tokens == len(ids) and got[r.doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4"))
