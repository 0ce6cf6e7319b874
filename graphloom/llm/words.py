"""Words of many texts at once, each distinct blank-separated unit looked at a single time."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTERS = re.compile(r"[^\W\d_]+")


class Units:
    """The blank-separated units of an Arrow string array (null: none).

    `distinct` has each unit once, `codes` the place of every unit of every text there,
    one text after the other, and `text` the text of each."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        self.n = len(texts)
        if not self.n:
            self.distinct, self.codes, self.text = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        self.distinct = coded.dictionary.to_pylist()
        self.codes = np.asarray(coded.indices, np.int64)
        self.text = np.repeat(np.arange(self.n), np.diff(np.asarray(lists.offsets, np.int64)))

    def features(self, of) -> list[np.ndarray]:
        """For each text the distinct numbers that `of(unit)` gives for its units."""
        found = [of(u) for u in self.distinct]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((x for f in found for x in f), np.int64, int(size.sum()))
        start = np.cumsum(size) - size
        hit = size[self.codes] > 0
        codes, text = self.codes[hit], self.text[hit]
        per = size[codes]
        at = np.cumsum(per) - per
        numbers = flat[np.repeat(start[codes] - at, per) + np.arange(per.sum())]
        owner = np.repeat(text, per)
        both = np.unique(np.stack([owner, numbers]), axis=1) if len(owner) < 2 else _pairs(owner, numbers)
        bounds = np.searchsorted(both[0], np.arange(self.n + 1))
        return [both[1][a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _pairs(owner: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((numbers, owner))
    owner, numbers = owner[order], numbers[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (numbers[1:] != numbers[:-1])
    return owner[first], numbers[first]
