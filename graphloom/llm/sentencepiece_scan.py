"""SentencePiece encoding and decoding as a max-plus scan.

The public model merges (BPE).  What merging gives is the only segmentation in which every two
neighbouring pieces are left side by side by the merges: merges inside of a piece do not depend
on others, and one that crosses a border would cross it in the two pieces alone as well.  So
encoding is a path of weight 0 in (max, +) where a pair of neighbours weighs 0 if the model
leaves it and -inf if not.  Which pairs it leaves is asked from the library, once for each pair
that comes up.  A character that no piece has becomes the pieces of its bytes.

In (max, +) a stretch of text is a matrix: from each state at its start (the last piece that
ended there or before, and where) to each state at its end, the best weight.  Stretches put
together are the product of their matrices, in any grouping.  Every text is cut into chunks of
CHUNK characters, wherever that falls.  No piece crosses the place before a blank behind another
character, so there all states are one, and a chunk's matrix is the outer sum of what leads from
its start to its first such place and from its last one to its end; a chunk without one has its
matrix computed whole.  The units between such places have one start each: a unit is traced once
for all places where it stands.  With the states at both ends of each chunk known from the
products, it is traced back by itself.

The chunks of a text of at most RUN chunks are multiplied where the text is; those of longer
texts are dealt out: Spark multiplies runs of chunks, scans the runs, then the chunks of each
run.  The chunks, matrices and traces are the same ones, and any chunking gives the library's ids.

Null and empty texts have no ids.  U+2581, which the library takes for a blank, has the ids of a
blank, and `marks` has its places, so that every text comes back as it was.  Repeated rows and
null ids are documents like others; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.units import blocks, ragged
from graphloom.session import stage

BLANK = "▁"
#: A character that no piece has, put before pieces so that the library adds nothing to them.
SHIELD = "\ue000"
#: Characters of a chunk, and chunks of a run.  Units with more characters than LONG are traced one by one.
CHUNK, RUN, LONG = 4_096, 256, 256
#: Bytes of units that a generation of a worker's memory holds (there are two), and places for pairs of pieces.
GENERATION, PAIRS = 24_000_000, 1 << 21
#: Chunks of a task, and tasks at most.
TASK_CHUNKS, MOST_TASKS = 16, 10_000

#: Where no piece crosses: before a blank behind another character.
CUT = re.compile("(?<=[^ ])(?= )")

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_WORKERS: dict[str, "Pieces"] = {}


class Pairs:
    """Whether pairs of pieces may stand side by side: a table of 64-bit keys that asks once for each and starts anew when full."""

    def __init__(self, ask: Callable[[np.ndarray], np.ndarray], places: int = PAIRS):
        self.ask, self.places = ask, places
        self.shift = np.uint64(64 - (places.bit_length() - 1))
        self.table, self.held = np.full(places, -1, np.int64), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _FACTOR) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        left, slot = np.arange(len(keys)), self._slots(keys)
        new = []
        while len(left):
            got = self.table[slot]
            hit, empty = got >> 1 == keys[left], got < 0
            out[left[hit]] = got[hit] & 1
            new.append(left[empty])
            on = ~(hit | empty)
            left, slot = left[on], (slot[on] + 1) % self.places
        missing = np.concatenate([np.zeros(0, np.int64), *new])
        if len(missing):
            distinct, at = np.unique(keys[missing], return_inverse=True)
            found = self.ask(distinct)
            out[missing] = found[at]
            self._put(distinct, found)
        return out

    def _put(self, keys: np.ndarray, found: np.ndarray) -> None:
        if self.held + len(keys) > self.places * 0.6:
            self.table[:], self.held = -1, 0
            keys, found = keys[: self.places // 2], found[: self.places // 2]
        self.held += len(keys)
        entry, slot = keys << 1 | found, self._slots(keys)
        while len(entry):
            empty = self.table[slot] < 0
            self.table[slot[empty]] = entry[empty]
            on = self.table[slot] != entry
            entry, slot = entry[on], (slot[on] + 1) % self.places


class Pieces:
    """The pieces of a SentencePiece model that merges."""

    def __init__(self, path: str, generation: int = GENERATION):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i).replace(BLANK, " ") for i in range(n)]
        self.byte_ids, self.out, plain = {}, [b""] * n, []
        for i, name in enumerate(self.names):
            if model.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                self.out[i] = bytes([int(name[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain.append(i)
                self.out[i] = name.encode()
        self.unknown_id = model.unk_id()
        self.longest = max(len(self.names[i]) for i in plain)
        #: beside the pieces' ids: the start of a text, and a character that no piece has
        self.start, self.odd = n, n + 1
        single = {self.names[i] for i in plain if len(self.names[i]) == 1}
        if any(c not in single for i in plain for c in self.names[i]):
            raise ValueError(f"{path}: a piece has a character that is no piece itself")
        if any(" " in self.names[i].lstrip(" ") for i in plain):
            raise ValueError(f"{path}: a piece goes on over a blank")
        if SHIELD in single or model.decode(model.encode(text := "a  \ufb01 b\n ")) != text:
            raise ValueError(f"{path}: the model changes texts")
        self.shield = len(model.encode(SHIELD))
        #: hashes of the pieces of each length, their ids, and which first 16 bits they have
        self.tables = []
        for length in range(1, self.longest + 1):
            ids = np.array([i for i in plain if len(self.names[i]) == length], np.int64)
            hashes = np.array([self._hash(self.names[i]) for i in ids.tolist()], np.uint64)
            order = np.argsort(hashes)
            few = np.zeros(1 << 16, bool)
            few[(hashes >> np.uint64(48)).astype(np.int64)] = True
            self.tables.append((hashes[order], ids[order], few))
        self.beside = Pairs(self._ask)
        self.generation = generation
        self.known: dict[str, int] = {}
        self.flat, self.offsets, self.held = np.zeros(0, np.int32), np.zeros(1, np.int64), 0
        self.before: tuple[dict[str, int], np.ndarray, np.ndarray] = ({}, self.flat, self.offsets)

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_FACTOR) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _ask(self, keys: np.ndarray) -> np.ndarray:
        """Of pairs (left * (n + 2) + right), whether merging leaves the two as they are."""
        left, right = keys // (self.odd + 1), keys % (self.odd + 1)
        out = np.ones(len(keys), bool)  # what no piece has is never merged
        some = np.flatnonzero((left != self.odd) & (right != self.odd))
        first = ["" if i == self.start else self.names[i] for i in left[some].tolist()]
        texts = [f"{SHIELD}{a}{self.names[b]}" for a, b in zip(first, right[some].tolist())]
        want = [[b] if a == self.start else [a, b] for a, b in zip(left[some].tolist(), right[some].tolist())]
        for at in range(0, len(texts), 10_000):
            got = self.model.encode(texts[at : at + 10_000], num_threads=1)
            out[some[at : at + 10_000]] = [g[self.shield :] == w for g, w in zip(got, want[at : at + 10_000])]
        return out

    def look(self, codes: np.ndarray) -> np.ndarray:
        """For columns of code points plus 1 (0: beyond the end) the piece that ends at each place, by length: [place, column, length - 1], -1 for none."""
        width, n = codes.shape
        prefix = np.zeros((width + 1, n), np.uint64)
        for t in range(width):
            prefix[t + 1] = prefix[t] * _FACTOR + codes[t].astype(np.uint64)
        span = min(self.longest, width)
        ids = np.full((width, n, span), -1, np.int32)
        power = _FACTOR
        for length, (hashes, pieces_, few) in zip(range(1, span + 1), self.tables):
            if len(hashes):
                h = prefix[length:] - prefix[:-length] * power
                # a small table rules out most
                place, column = np.nonzero(few[(h >> np.uint64(48)).astype(np.int64)] & (codes[length - 1 :] > 0))
                h = h[place, column]
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = hashes[at] == h
                ids[place[hit] + length - 1, column[hit], length - 1] = pieces_[at[hit]]
            power = np.uint64(int(power) * int(_FACTOR) & 0xFFFFFFFFFFFFFFFF)
        lone = (ids[:, :, 0] < 0) & (codes > 0)
        ids[:, :, 0][lone] = self.odd
        return ids

    def spelled(self, ids: list[int], text: str, ends: list[int]) -> list[int]:
        """Ids, with the bytes of a character that no piece has in its place."""
        out = []
        for i, end in zip(ids, ends):
            if i != self.odd:
                out.append(i)
            else:
                out += [self.byte_ids.get(b, self.unknown_id) for b in text[end].encode("utf-8", "replace")] if self.byte_ids else [self.unknown_id]
        return out

    def best(self, units: list[str]) -> list[bytes]:
        """The segmentation of each unit, as 32-bit ids."""
        out = [b""] * len(units)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(sizes, kind="stable")
        at = int((sizes == 0).sum())
        while at < len(order):
            width = int(sizes[order[at]])
            if width > LONG:
                out[order[at]] = np.array(self.chunk("", units[order[at]])[1](0, -1), np.int32).tobytes()
                at += 1
                continue
            rows = max(1, 1_000_000 // (width * min(self.longest, width)))
            to = min(at + rows, int(np.searchsorted(sizes[order], min(LONG, width + max(2, width // 8)), "right")))
            group, at = order[at:to].tolist(), to
            size = sizes[group]
            width = int(size.max())
            raw = np.frombuffer("".join([units[i] for i in group]).encode("utf-32-le", "surrogatepass"), np.uint32)
            codes = np.zeros((len(group), width), np.int64)
            codes[np.arange(width)[None] < size[:, None]] = raw + np.uint32(1)
            ids = self.look(np.ascontiguousarray(codes.T))
            # the one piece that may end at each place, and how long it is
            last = np.full((width + 1, len(group)), -1, np.int64)
            last[0] = self.start
            back = np.zeros((width, len(group)), np.int64)
            place, column, length = np.nonzero(ids >= 0)
            piece = ids[place, column, length].astype(np.int64)
            cuts = np.searchsorted(place, np.arange(width + 1))
            for t in range(width):
                here = slice(cuts[t], cuts[t + 1])
                c, n, p = column[here], length[here], piece[here]
                left = last[t - n, c]
                fits = np.flatnonzero(left >= 0)
                fits = fits[self.beside(left[fits] * (self.odd + 1) + p[fits])]
                back[t, c[fits]] = n[fits]
                last[t + 1, c[fits]] = p[fits]
            all_ = np.arange(len(group))
            # all units are traced back at once: -2 for those that are at their start
            t, steps = size - 1, []
            while (t >= 0).any():
                here = np.maximum(t, 0)
                steps.append(np.where(t >= 0, last[here + 1, all_], -2))
                t = np.where(t >= 0, t - back[here, all_] - 1, -1)
            found = np.stack(steps[::-1], 1)
            real = found != -2
            flat, ends = found[real].astype(np.int32).tobytes(), np.cumsum(real.sum(1)) * 4
            for i, a, b in zip(group, [0, *ends[:-1].tolist()], ends.tolist()):
                out[i] = flat[a:b]
            for k in np.flatnonzero((found == self.odd).any(1)).tolist():
                places, t = [], int(size[k]) - 1
                while t >= 0:
                    places.append(t)
                    t -= int(back[t, k]) + 1
                places.reverse()
                out[group[k]] = np.array(self.spelled([int(last[t + 1, k]) for t in places], units[group[k]], places), np.int32).tobytes()
        return out

    def _places(self, units: list[str]) -> np.ndarray:
        """The place of each of the distinct units in the memory, tracing those that it lacks."""
        found = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        if (missing := np.flatnonzero(found < 0)).size:
            if self.held > self.generation:
                self.before = (self.known, self.flat, self.offsets)
                self.known, self.flat, self.offsets, self.held = {}, np.zeros(0, np.int32), np.zeros(1, np.int64), 0
                missing = np.arange(len(units))
            names = [units[i] for i in missing.tolist()]
            old, flat, offsets = self.before
            at = np.fromiter(map(old.get, names, repeat(-1)), np.int64, len(names))
            kept, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
            traced = self.best([names[i] for i in new.tolist()])
            size = np.r_[np.diff(offsets)[at[kept]], np.fromiter(map(len, traced), np.int64, len(traced)) // 4]
            base = len(self.offsets) - 1
            self.known.update(zip([names[i] for i in np.r_[kept, new].tolist()], range(base, base + len(names))))
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(size)])
            self.flat = np.concatenate([self.flat, ragged(flat, offsets, at[kept]), np.frombuffer(b"".join(traced), np.int32)])
            self.held += 140 * len(names) + 4 * int(size.sum())
            found = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        return found

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that begin and end where no piece crosses, by their distinct units, and the ends of each text's ids (from 0 on)."""
        # a cut before each blank behind another character; a text that has the mark of cuts is cut by hand
        marked = np.asarray(pc.match_substring(texts, "\x00"), bool)
        lists = pc.split_pattern(pc.replace_substring_regex(texts, "([^ ]) ", "\\1\x00 "), "\x00")
        if marked.any():
            lists = pa.array([CUT.split(t) if m else u for t, m, u in zip(texts.to_pylist(), marked, lists.to_pylist())], pa.large_list(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        places = self._places(coded.dictionary.to_pylist())[np.asarray(coded.indices, np.int64)]
        offsets = np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
        return ragged(self.flat, self.offsets, places), np.r_[0, np.cumsum(np.diff(self.offsets)[places])][offsets]

    def encode(self, texts: pa.Array, chunk: int = CHUNK) -> pa.ListArray:
        """Ids of each text, by its chunks."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return pa.array([], pa.list_(pa.int32()))
        texts, none = pc.replace_substring(texts, BLANK, " "), pa.scalar("", pa.large_string())
        texts = pc.if_else(pc.equal(texts, none), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, none))
        several = np.flatnonzero(np.asarray(pc.utf8_length(texts)) > chunk)
        if not len(several):
            flat, ends = self.units(texts)
            return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
        # the only chunk of a text is all units; of the others the units are put behind
        cut = [self.chunks(texts[int(i)].as_py(), chunk) for i in several]
        inner = pa.array([c[2] for some in cut for c in some], pa.large_string())
        short = pc.if_else(pa.array(np.isin(np.arange(len(texts)), several)), none, texts)
        flat, ends = self.units(pa.concat_arrays([short.combine_chunks() if isinstance(short, pa.ChunkedArray) else short, inner]))
        parts = [[flat[a:b]] for a, b in zip(ends[: len(texts)].tolist(), ends[1 : len(texts) + 1].tolist())]
        at = len(texts)
        for i, some in zip(several.tolist(), cut):
            made = [self.stretch(before, head, tail, through) for before, head, _, tail, through in some]
            parts[i] = []
            for (_, trace), (first, last) in zip(made, walk([m for m, _ in made], 0, None)):
                parts[i] += trace(first, last, flat[ends[at] : ends[at + 1]])
                at += 1
        sizes = [sum(map(len, x)) for x in parts]
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.concatenate([y for x in parts for y in x]).astype(np.int32)))

    def chunks(self, text: str, chunk: int) -> list[tuple[str, str, str, str, bool]]:
        """(before, head, inner, tail, through) of each chunk of a text as shown.

        The head goes on to the first place that no piece crosses, the tail begins at the last one, and
        `before` is what is in front of the head behind such a place (2 * longest characters at most).  A
        chunk without such a place goes `through`: it is all head."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        cuts = np.r_[0, np.flatnonzero((codes[1:] == 32) & (codes[:-1] != 32)) + 1, len(text)]
        at = np.arange(0, len(text), chunk)
        last, first = cuts[np.searchsorted(cuts, at, "right") - 1], cuts[np.searchsorted(cuts, at)]
        out = []
        for x, y, a, b, to in zip(*(z.tolist() for z in (at, np.r_[at[1:], len(text)], last, first, np.r_[last[1:], len(text)]))):
            before = text[max(a, x - 2 * self.longest) : x]
            out.append((before, text[x:y], "", "", True) if b > y else (before, text[x:b], text[b:to], text[to:y], False))
        return out

    def stretch(self, before: str, head: str, tail: str, through: bool) -> tuple[np.ndarray, Callable[[int, int, np.ndarray], list[np.ndarray]]]:
        """The matrix of a chunk, and what gives its ids from a state at its start to one at its end, given the ids of its inner units."""
        matrix, trace = self.chunk(before, head, not through)
        if through:
            return matrix, lambda i, j, _: [np.array(trace(i, j), np.int32)]
        ends, trace_end = self.chunk("", tail, False)
        return matrix.max(1)[:, None] + ends[:1], lambda i, j, inner: [np.array(trace(i, -1), np.int32), inner, np.array(trace_end(0, j), np.int32)]

    def states(self, ids: np.ndarray, at: int) -> list[tuple[int, int]]:
        """(place behind the last piece, its length) of the states at a cut: pieces that end up to `longest` - 1 characters
        before it, and the start of the text (0, 0) if that is as near."""
        found = [(t, length + 1) for t in range(at, max(0, at - self.longest), -1) for length in np.flatnonzero(ids[t - 1] >= 0).tolist()]
        return found + [(0, 0)] * (at < self.longest)

    def chunk(self, before: str, text: str, final: bool = True) -> tuple[np.ndarray, Callable[[int, int], list[int]]]:
        """The matrix of characters, and what traces them from a state at their start to one at their end.

        `before` is the text in front (2 * longest characters, or all there is behind a place that no piece
        crosses); the states at the end of a `final` stretch are those of pieces that end there."""
        if not text:
            return np.zeros((1, 1), np.float32), lambda i, j: []
        whole, cut = before + text, len(before)
        n = len(whole)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)[:, None] + 1
        ids = self.look(codes)[:, 0]
        ending = [[]] + [[(length + 1, int(ids[t, length])) for length in np.flatnonzero(ids[t] >= 0).tolist() if length <= t] for t in range(n)]
        first = self.states(ids, cut)
        number = {s: i for i, s in enumerate(first)}
        # all pairs of neighbours in the chunk, looked up at once
        wide, keys = self.odd + 1, []
        for t in range(cut + 1, n + 1):
            for length, piece in ending[t]:
                keys += [left * wide + piece for _, left in ending[t - length]] if t > length else [self.start * wide + piece]
        fits = iter(self.beside(np.array(keys, np.int64)).tolist() if keys else [])
        reach: dict[tuple[int, int], int] = {}  # bits of the first states that lead to a piece
        came: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for t in range(cut + 1, n + 1):
            for length, _ in ending[t]:
                bits, ways, p = 0, [], t - length
                for left in [x for x, _ in ending[p]] if p else [0]:
                    ok = next(fits)
                    if ok and (bit := 1 << number[p, left] if p <= cut and (p, left) in number else reach.get((p, left), 0) if p > cut else 0):
                        bits |= bit
                        ways.append((p, left))
                if bits:
                    reach[t, length], came[t, length] = bits, ways
        last = [s for s in self.states(ids, n) if not final or s[0] == n]
        matrix = np.full((len(first), len(last)), -np.inf, np.float32)
        for j, s in enumerate(last):
            bits = 1 << number[s] if s in number else reach.get(s, 0)
            for i in range(len(first)):
                if bits >> i & 1:
                    matrix[i, j] = 0

        def trace(i: int, j: int) -> list[int]:
            at = last[j] if j >= 0 else last[int(matrix[i].argmax())]
            found = []
            while at[0] > cut:
                found.append(at)
                at = next(s for s in came[at] if (1 << number[s] if s[0] <= cut else reach[s]) >> i & 1)
            found.reverse()
            return self.spelled([int(ids[t - 1, length - 1]) for t, length in found], whole, [t - 1 for t, _ in found])

        return matrix, trace

    def decode(self, ids: np.ndarray, marks: list[int] | None = None) -> str:
        text = b"".join([self.out[i] for i in ids.tolist()]).decode("utf-8", "replace")
        text = text[1:] if text[:1] == " " else text
        if marks:
            ends = [-1, *marks]
            text = BLANK.join([text[a + 1 : b] for a, b in zip(ends, [*marks, len(text)])])
        return text


def shown(text: str) -> str:
    """The text as the library encodes it."""
    return " " + text.replace(BLANK, " ") if text else ""


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product."""
    return (a[:, :, None] + b[None]).max(1)


def walk(matrices: list[np.ndarray], first: int, last: int | None) -> list[tuple[int, int]]:
    """The states at both ends of each stretch on the best way from `first` to `last` (None: to the best end)."""
    sums = [np.where(np.arange(len(matrices[0])) == first, 0.0, -np.inf)]
    for m in matrices:
        sums.append((sums[-1][:, None] + m).max(0))
    out, at = [], int(sums[-1].argmax()) if last is None else last
    for m, before in zip(matrices[::-1], sums[-2::-1]):
        came = int((before + m[:, at]).argmax())
        out.append((came, at))
        at = came
    return out[::-1]


def dump(m: np.ndarray) -> bytes:
    return np.array([m.shape[1]], np.int32).tobytes() + m.astype(np.float32).tobytes()


def load(m: bytes) -> np.ndarray:
    return np.frombuffer(m, np.float32, offset=4).reshape(-1, int(np.frombuffer(m, np.int32, 1)[0]))


def pieces(path: str) -> Pieces:
    if path not in _WORKERS:
        _WORKERS[path] = Pieces(path)
    return _WORKERS[path]


def places_of(texts: list[str | None]) -> pa.Array:
    """Where each text has U+2581."""
    return pa.array([[m.start() for m in re.finditer(BLANK, t)] if t and BLANK in t else [] for t in texts], pa.list_(pa.int32()))


def encode(docs: DataFrame, model: str, chunk: int = CHUNK, run: int = RUN) -> DataFrame:
    """doc_id, ids and marks (places of U+2581) of each row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def direct(batches):
        code = pieces(model)
        for batch in batches:
            for block in blocks(batch):
                texts = block.column("text")
                has = pc.any(pc.match_substring(texts, BLANK)).as_py()
                marks = places_of(texts.to_pylist()) if has else pa.array([[]] * len(texts), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), code.encode(texts, chunk), marks], names=["doc_id", "ids", "marks"])

    here = F.length("text") < chunk * run
    short = rows.where(here).mapInArrow(direct, f"doc_id {kind}, ids array<int>, marks array<int>")
    return short.unionByName(_dealt(rows.where(~here), model, chunk, run))


def _dealt(rows: DataFrame, model: str, chunk: int, run: int) -> DataFrame:
    """The same for texts whose chunks are dealt out to tasks."""
    # equal rows would share a key: they are told apart by a count
    keyed = rows.groupBy("doc_id", "text").count().withColumn("key", F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text"), 256))
    parts = ["before", "head", "inner", "tail", "through"]

    def cut(batches):
        code = pieces(model)
        for batch in batches:
            for i in range(len(batch)):
                found = code.chunks(shown(batch.column("text")[i].as_py()), chunk)
                for a in range(0, len(found), 64):
                    some = found[a : a + 64]
                    columns = [[batch.column("key")[i].as_py()] * len(some), pa.array(range(a, a + len(some)), pa.int64()), *map(list, zip(*some))]
                    yield pa.RecordBatch.from_pydict(dict(zip(["key", "chunk", *parts], columns)))

    chunks = stage(keyed.select("key", "text").mapInArrow(cut, "key string, chunk long, before string, head string, inner string, tail string, through boolean"), "chunks")

    def matrices(batches):
        code = pieces(model)
        for batch in batches:
            if len(batch):
                made = [dump(code.stretch(*x)[0]) for x in zip(*(batch.column(c).to_pylist() for c in ("before", "head", "tail", "through")))]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chunk"), pa.array(made, pa.binary())], names=["key", "chunk", "m"])

    # a chunk's work is far larger than its row: a number keeps Spark from putting them together
    tasks = max(1, min(MOST_TASKS, chunks.count() // TASK_CHUNKS + 1))
    made = stage(chunks.repartition(tasks, "key", "chunk").mapInArrow(matrices, "key string, chunk long, m binary"), "matrices").withColumn("run", F.floor(F.col("chunk") / run))

    def multiply(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        total = load(frame["m"].iloc[0])
        for m in frame["m"].iloc[1:]:
            total = product(total, load(m))
        return pd.DataFrame({"key": [frame["key"].iloc[0]], "run": [frame["run"].iloc[0]], "m": [dump(total)]})

    def scan_runs(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("run")
        found = walk([load(m) for m in frame["m"]], 0, None)
        return pd.DataFrame({"key": frame["key"], "run": frame["run"], "first": [a for a, _ in found], "last": [b for _, b in found]})

    def scan_chunks(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        found = walk([load(m) for m in frame["m"]], int(frame["first"].iloc[0]), int(frame["last"].iloc[0]))
        return pd.DataFrame({"key": frame["key"], "chunk": frame["chunk"], "first": [a for a, _ in found], "last": [b for _, b in found]})

    runs = made.groupBy("key", "run").applyInPandas(multiply, "key string, run long, m binary")
    ends = runs.groupBy("key").applyInPandas(scan_runs, "key string, run long, first long, last long")
    inner = made.join(ends, ["key", "run"]).groupBy("key", "run").applyInPandas(scan_chunks, "key string, chunk long, first long, last long")

    def trace(batches):
        code = pieces(model)
        for batch in batches:
            if not len(batch):
                continue
            d = batch.to_pydict()
            flat, ends = code.units(pa.array(d["inner"], pa.large_string()))
            ids = []
            for i, x in enumerate(zip(d["before"], d["head"], d["tail"], d["through"])):
                ids.append(np.concatenate(code.stretch(*x)[1](d["first"][i], d["last"][i], flat[ends[i] : ends[i + 1]])))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chunk"), pa.array(ids, pa.list_(pa.int32()))], names=["key", "chunk", "ids"])

    def with_marks(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], places_of(batch.column("text").to_pylist())], names=["key", "doc_id", "count", "marks"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    traced = chunks.join(inner, ["key", "chunk"]).repartition(tasks, "key", "chunk").mapInArrow(trace, "key string, chunk long, ids array<int>")
    whole = traced.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids"))
    marks = keyed.select("key", "doc_id", "count", "text").mapInArrow(with_marks, f"key string, doc_id {kind}, count long, marks array<int>")
    copies = marks.join(whole, "key")
    return copies.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("count").cast("int")))).select("doc_id", "ids", "marks")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and text of each row of ids and marks."""

    def give(batches):
        code = pieces(model)
        for batch in batches:
            lists = batch.column("ids")
            texts = [code.decode(x.values.to_numpy(), m) if x.is_valid else "" for x, m in zip(lists, batch.column("marks").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(texts)], names=["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids", "marks").mapInArrow(give, f"doc_id {kind}, ids array<int>, text string")


def digest(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (ids as little-endian 32-bit integers), text_sha256 and n_chars of the decoded text."""

    def give(batches):
        import hashlib

        code = pieces(model)
        for batch in batches:
            ids = [x.values.to_numpy() for x in batch.column("ids")]
            texts = [code.decode(x, m) for x, m in zip(ids, batch.column("marks").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4")) for x in ids], pa.int64()),
                 pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in texts]), pa.array([len(t) for t in texts], pa.int64())],
                names=["doc_id", "n_tokens", "ids_crc32", "text_sha256", "n_chars"],
            )

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids", "marks").mapInArrow(give, f"doc_id {kind}, n_tokens long, ids_crc32 long, text_sha256 string, n_chars long")
