"""Token files and packing against the tokenizer applied to each whole text."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import packing, token_files
from graphloom.llm.queries import tokenizer_file
from graphloom.llm.units import UnitEncoder
from graphloom.session import table

from .conftest import ODD


def plain(path, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_equal_whole_texts(name):
    code = UnitEncoder(tokenizer_file(name))
    texts = [t for _, t in ODD]
    ids, counts = code.encode(pa.array(texts))
    want = plain(tokenizer_file(name), texts, 0)
    assert counts.tolist() == [len(w) - 1 for w in want]
    assert ids.tolist() == np.concatenate([w[:-1] for w in want]).tolist()
    assert code.encode(pa.array([], pa.string()))[1].tolist() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_of_many_kinds(name, sf):
    import random

    import pyarrow.parquet as pq

    rng = random.Random(3)
    parts = ["a", "B", "é", "e\u0301", "Σ", "ß", "日", "1", "23", ".", ",", "'s", "'", "-", "€", "•", " ", " ", " ", "\n", "\n", "\t", "\u00a0", "\x00", "\u2003"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(3000)]
    texts += pq.read_table(f"{sf}/documents.parquet", columns=["text"]).column("text").to_pylist()[:60]
    # a small memory forgets units again and again
    for generation in (2_000, 24_000_000):
        code = UnitEncoder(tokenizer_file(name), generation)
        want = plain(tokenizer_file(name), texts, 0)
        for at in range(0, len(texts), 500):
            ids, counts = code.encode(pa.array(texts[at : at + 500]))
            assert counts.tolist() == [len(w) - 1 for w in want[at : at + 500]]
            assert ids.tolist() == np.concatenate([w[:-1] for w in want[at : at + 500]]).tolist()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_frequent_units_stay(name):
    """A flood of units that come once, one of them as large as the memory, does not drive out those that most blocks had."""
    code = UnitEncoder(tokenizer_file(name), 20_000)
    encoded, learn = [], code._encoded
    code._encoded = lambda units, *rest: encoded.append(len(units)) or learn(units, *rest)
    common = " ".join(f"word{i} of" for i in range(40))
    for _ in range(40):
        code.encode(pa.array([common]))
    assert sum(encoded) <= 42
    flood = [" ".join(f"once{i} flood{i}" for i in range(at, at + 75)) for at in range(0, 750, 75)] + ["x" * 20_000, "end"]
    for text in flood:
        code.encode(pa.array([text]))
    encoded.clear()
    ids, counts = code.encode(pa.array([common, "  " + common]))
    assert sum(encoded) <= 2
    want = plain(tokenizer_file(name), [common, "  " + common], 0)
    assert ids.tolist() == [i for w in want for i in w[:-1]] and counts.tolist() == [len(w) - 1 for w in want]


def key(row):
    return (row[0] is not None, row[0] or 0, row[1] or "")


@pytest.mark.parametrize("length", [8, 2048])
def test_token_files(spark, odd, none, tmp_path, length):
    folder = f"file://{tmp_path}/f"
    path = tokenizer_file("byte_bpe_50k.json")
    manifest = token_files.write_token_files(odd, path, 0, folder, length)
    rows = sorted(token_files.read_token_files(manifest, folder).collect(), key=lambda r: (r.start, r.n_tokens))
    docs = sorted(ODD, key=key)
    want = plain(path, [t for _, t in docs], 0)
    assert [r.doc_id for r in rows] == [i for i, _ in docs]
    assert [r.ids for r in rows] == [w.tolist() for w in want]
    assert [r.ids_crc32 for r in rows] == [zlib.crc32(w) for w in want]
    assert [r.start for r in rows] == np.cumsum([0, *map(len, want)])[:-1].tolist()
    for f in (tmp_path / "f").glob("*.arrow"):
        with pa.memory_map(str(f)) as source:
            t = pa.ipc.open_file(source).read_all()
            assert t.schema.field("ids").type == pa.list_(pa.uint16(), length)
            mask = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t["mask"].chunks])
            assert not mask[mask.sum() :].any() and len(mask) - mask.sum() < length
    empty = token_files.write_token_files(none, path, 0, folder + "2")
    assert token_files.read_token_files(empty, folder + "2").count() == 0


def pieces_are_right(rows, docs, path, capacity):
    want = defaultdict(list)
    for (doc, _), ids in zip(docs, plain(path, [t for _, t in docs], 1)):
        want[doc].append(ids)
    got = defaultdict(int)
    for r in rows:
        assert any(len(w) == r.doc_tokens and zlib.crc32(w[r.start : r.start + r.length]) == r.ids_crc32 for w in want[r.doc_id])
        got[r.doc_id] += r.length
    assert got == {d: sum(map(len, w)) for d, w in want.items()}
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == np.cumsum([0, *(n for _, n in b)])[:-1].tolist()
        used = sum(n for _, n in b)
        assert used <= capacity
        padding += capacity - used if used & (used - 1) else 0
    return padding


def test_packing_odd(spark, odd, none):
    path = tokenizer_file("word_bpe_49k.json")
    for capacity in (64, 2048):
        pieces_are_right(packing.pack(odd.repartition(5), path, 1, capacity).collect(), ODD, path, capacity)
    kept = packing.pack(odd, path, 1, keep_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4")) == r.ids_crc32 for r in kept)
    assert packing.pack(none, path, 1).count() == 0


def test_packing_documents(spark, sf):
    docs = table(spark, sf, "documents").repartition(70)
    path = tokenizer_file("word_bpe_49k.json")
    rows = packing.pack(docs, path, 1).collect()
    padding = pieces_are_right(rows, [(r.doc_id, r.text) for r in docs.collect()], path, 2048)
    assert padding <= 2 * 2048


def test_cut():
    n = np.arange(5000)
    for smallest in (1, 32, 2048):
        doc, length = packing.cut(n, smallest=smallest)
        assert np.bincount(doc, length, len(n)).tolist() == n.tolist() and (length > 0).all() and (np.diff(doc) >= 0).all()


@pytest.mark.parametrize("workers", [1, 3, 40])
def test_packing_classes(spark, workers):
    """Pieces of several lengths of one class share a bin, at most as many as the class says; rests of workers meet by class, too."""
    path = tokenizer_file("word_bpe_49k.json")
    docs = [(i, "a " * (98 + i % 5)) for i in range(50 * workers)]
    lengths = {len(x) for x in plain(path, [t for _, t in docs], 1)}
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(workers), path, 1).collect()
    pieces_are_right(rows, docs, path, 2048)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(r.length)
    assert len(lengths) > 2 and max(lengths) < 128
    classes = {2048 // n for n in lengths}
    # a bin is of one class and full, but for the last ones
    mixed = [b for b in bins.values() if len({2048 // n for n in b}) == 1 and len(b) == 2048 // b[0]]
    assert all(len(b) <= max(classes) for b in bins.values())
    assert sum(len(b) for b in mixed) >= len(docs) - sum(k - 1 for k in classes) and any(len(set(b)) > 1 for b in mixed)
