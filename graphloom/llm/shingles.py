"""Word shingles of whole texts as 64-bit hashes.

Words are `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased.  A text's set has the hashes of
its distinct runs of five words; with fewer words, of the whole sequence; without words
(or text) it is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
#: Numbers that a shingle's words are multiplied by, in order, and that a word's bytes are, by their place.
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_BYTE = np.uint64(0x9FB21C651E98DF25)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEPARATES = np.zeros(256, bool)
_SEPARATES[[0x20, *range(0x09, 0x0E)]] = True
#: What a byte is worth in a word's hash: capitals as small letters, separators nothing.
_WORTH = mix(np.arange(1, 257, dtype=np.uint64) * _BYTE)
_WORTH[0x41:0x5B] = _WORTH[0x61:0x7B]
_WORTH[_SEPARATES] = 0


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of all texts, and how many words each text has."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~_SEPARATES[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] = inside[first]
    at = np.flatnonzero(begins)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    span = np.diff(np.r_[at, len(data)])
    power = np.full(int(span.max()), _BYTE | np.uint64(1))
    power[0] = 1
    power = np.multiply.accumulate(power)
    worth = _WORTH[data[at[0] :]] * power[np.arange(at[0], len(data)) - np.repeat(at, span)]
    return mix(np.add.reduceat(worth, at - at[0])), np.diff(np.searchsorted(at, offsets))


class Shingled:
    """Sets of many texts: `values`, ascending within a text, and `size` of each; `print` is a
    64-bit hash of the whole word sequence, and `words` its length."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        h, self.words = word_hashes(texts)
        text = np.repeat(np.arange(n), self.words)
        first = np.cumsum(self.words) - self.words
        place = (np.arange(len(h)) - first[text]).astype(np.uint64)
        self.print = np.zeros(n, np.uint64)
        some = np.flatnonzero(self.words)
        if len(h):
            self.print[some] = np.add.reduceat(h * (mix(place + np.uint64(1)) | np.uint64(1)), first[some])
        self.print = mix(self.print + self.words.astype(np.uint64))
        runs = len(h) - WORDS + 1
        if runs > 0:
            whole = text[:runs] == text[WORDS - 1 :]
            long = np.zeros(runs, np.uint64)
            for i, f in enumerate(_FACTORS):
                long = mix(long + h[i : runs + i] * f)
            long, owner = long[whole], text[:runs][whole]
        else:
            long, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        few = np.flatnonzero((self.words > 0) & (self.words < WORDS))
        values, owner = np.concatenate([long, self.print[few]]), np.concatenate([owner, few])
        order = np.argsort(values)
        # a stable sort of small numbers is quick
        order = order[np.argsort(owner[order].astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")]
        values, owner = values[order], owner[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        self.values, self.owner = values[new], owner[new]
        self.size = np.bincount(self.owner, minlength=n)
