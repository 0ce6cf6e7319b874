"""Whole-text tokenization by repeated units.

The public tokenizers split a text into pieces before they merge anything.  No piece goes on
over a plain blank or line end with other characters on both sides, and none holds both a
letter and an ASCII mark behind it.  A text may therefore be cut there into units, each
distinct unit encoded once, and the ids put together again; the ids equal those of encoding
the whole text.  Texts in which a blank or line end meets other white space are cut by a
slower rule of the same kind.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of units (and their ids) that a worker's memory holds before it forgets some.
MEMORY = 12_000_000
#: Bytes of text that are put through in one go; bounds a worker's memory.
BLOCK_CHARS = 3_000_000

#: Units that are encoded in one call.
JOINED = 256

_INNER_BLANK = re.compile(r"(?<=\S) (?=\S)")
#: White space of any kind, for regular expressions of Arrow.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_WHITE_BUT_BLANK = r"[\t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNEVEN = rf"\A[ \n]|[ \n]\z|{_WHITE}[ \n]|[ \n]{_WHITE}|\x00"
_WORKERS: dict[str, "UnitEncoder"] = {}


class UnitEncoder:
    """Encodes Arrow string arrays with one tokenizer file."""

    def __init__(self, path: str, memory: int = MEMORY):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.memory = memory
        #: unit i has the ids flat[offsets[i] : offsets[i + 1]]; seen[i] blocks had it, those before it was last kept count half
        self.known = pa.array([], pa.large_string())
        self.flat, self.offsets, self.seen = np.zeros(0, self.dtype), np.zeros(1, np.int64), np.zeros(0)
        for self.mark in ("\n", "\n€\n", "\n•\n", "\n1\n"):  # a text that is one token between any two units
            ids = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
            if len(ids) == 1:
                self.mark_id = ids[0]
                break
        else:
            raise ValueError(f"{path}: no one-token mark to put between units")
        #: A text that holds such a string is encoded as it is.
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def _places(self, units: pa.Array) -> np.ndarray:
        """The place of each of the units in the memory, learning those that it lacks."""
        if self._taken().sum() > self.memory:
            self._forget()
        coded = units.dictionary_encode()
        found = np.array(pc.fill_null(pc.index_in(coded.dictionary, self.known), -1))
        if (missing := np.flatnonzero(found < 0)).size:
            new = coded.dictionary.take(pa.array(missing))
            ids, size = self._encoded(new)
            found[missing] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, new])
            self.flat = np.concatenate([self.flat, ids])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(size)])
            self.seen = np.concatenate([self.seen, np.zeros(len(new))])
        self.seen[found] += 1
        return found[np.asarray(coded.indices)]

    def _taken(self) -> np.ndarray:
        """Bytes of each unit: its characters, its ids, and three numbers."""
        return np.asarray(pc.binary_length(self.known)) + np.diff(self.offsets) * self.flat.itemsize + 24

    def _forget(self) -> None:
        """Keeps the units that most blocks had, younger ones first, as far as half of the memory holds them."""
        order = np.argsort(self.seen, kind="stable")[::-1]
        kept = np.sort(order[np.cumsum(self._taken()[order]) <= self.memory // 2])
        size = np.diff(self.offsets)[kept]
        self.known, self.flat = self.known.take(pa.array(kept)), ragged(self.flat, self.offsets, kept)
        self.offsets, self.seen = np.r_[0, np.cumsum(size)], self.seen[kept] / 2

    def _encoded(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units one after the other, and how many each has: most are lines of one text, as a call costs more than a unit."""
        core = self.mark.strip("\n") or self.mark
        apart = np.asarray(pc.match_substring_regex(units, rf"\n|\A\z|{_WHITE}\z|\A{_WHITE_BUT_BLANK}|{re.escape(core)}"), bool)
        alone, together = np.flatnonzero(apart), np.flatnonzero(~apart)
        runs = [self._whole(u) for u in units.take(pa.array(alone)).to_pylist()]
        sizes = [np.array([len(r) for r in runs], np.int64)]
        bounds = np.append(np.arange(0, len(together), JOINED), len(together))
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), units.take(pa.array(together)))
        for many, lines in zip(np.diff(bounds).tolist(), pc.binary_join(lists, pa.scalar(self.mark, pa.large_string()))):
            (e,) = self.tokenizer.encode_batch_fast([lines.as_py()], add_special_tokens=False)
            ids = np.array(e.ids, self.dtype)
            ends = np.flatnonzero(ids == self.mark_id)
            if len(ends) != many - 1:
                raise ValueError("the tokenizer does not keep units apart")
            runs.append(np.delete(ids, ends))
            sizes.append(np.diff(np.r_[-1, ends, len(ids)]) - 1)
        flat, size = np.concatenate([np.zeros(0, self.dtype), *runs]), np.concatenate(sizes)
        order = np.argsort(np.r_[alone, together])
        return ragged(flat, np.r_[0, np.cumsum(size)], order), size[order]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _uneven_units(self, text: str) -> pa.Array:
        """Units by the slower rule; none of a text that is encoded as it is."""
        if self.special and self.special.search(text):
            return pa.array([], pa.large_string())
        first, *rest = _INNER_BLANK.split(text)
        return pa.array([first, *(" " + u for u in rest)], pa.large_string())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has (null: none)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        slow = np.asarray(pc.match_substring_regex(texts, _UNEVEN), bool)
        if self.special:
            slow |= np.asarray(pc.match_substring_regex(texts, self.special.pattern), bool)
        even = pc.if_else(pa.array(slow), pa.scalar("", pa.large_string()), texts)
        # every unit gets a cut in front: blanks stay with what follows, line ends are units
        even = pc.replace_substring(pc.replace_substring(even, " ", "\x00 "), "\n", "\x00\n\x00")
        even = pc.replace_substring_regex(even, r"(\pL)([!-/:-@\[-`{-~])", "\\1\x00\\2")
        lists = pc.split_pattern(even, "\x00")
        offsets = np.asarray(lists.offsets, np.int64)
        units, rows = lists.flatten(), np.flatnonzero(slow).tolist()
        uneven = [self._uneven_units(texts[i].as_py()) for i in rows]
        places = self._places(pa.concat_arrays([units, *uneven]))
        ids = ragged(self.flat, self.offsets, places)
        ends = np.r_[0, np.cumsum(np.diff(self.offsets)[places])]
        bounds = ends[offsets - offsets[0]]
        counts = np.diff(bounds)
        if not rows:
            return ids, counts
        own = ends[np.cumsum([len(units), *map(len, uneven)])].tolist()
        parts, done = [], 0
        for i, cut, a, b in zip(rows, uneven, own, own[1:]):
            parts += [ids[done : bounds[i]], ids[a:b] if len(cut) else self._whole(texts[i].as_py())]
            done = int(bounds[i])
            counts[i] = len(parts[-1])
        return np.concatenate([*parts, ids[done : bounds[-1]]]), counts


def ragged(flat: np.ndarray, offsets: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The runs of `flat` at these places, one after the other."""
    start, size = offsets[places], offsets[places + 1] - offsets[places]
    ends = np.cumsum(size)
    return flat[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def encoder(path: str) -> UnitEncoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _WORKERS:
        _WORKERS[path] = UnitEncoder(path)
    return _WORKERS[path]


def blocks(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_CHARS):
    """Slices of a batch that hold about `most` bytes of text each, one row at least."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    start, held = 0, 0
    for i, x in enumerate(size.tolist()):
        if i > start and held + x > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += x
    if len(size) > start:
        yield batch.slice(start, len(size) - start)
    pa.default_memory_pool().release_unused()
