"""Document quality from a linear-chain conditional random field over lines.

Each line has a state, good or bad.  Its evidence is a vector of features of the line and
of its two neighbours; a table of transitions ties states together.  The field is trained
on documents labelled good or bad: lines take their document's label, then, in a second
round, lines of bad documents that the field finds surely good (boilerplate among junk) are
relabelled.  The score of a document is the mean of its lines' marginal probabilities to be
good (forward-backward), weighted by line length, calibrated against the labels.

Training looks at a bounded sample of labelled documents (`ROWS`), in hashed order as long as
their lines together are at most LINES (a longer one is passed over); scoring looks at the
whole text of every document, in one pass, without a shuffle.  Null and empty texts are one
empty line; repeated rows and null ids are scored like others; an empty table gives no rows;
other columns are not looked at.  Without labels of both kinds every document scores 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from graphloom.llm.training import sigmoid
from graphloom.llm.units import blocks

#: Labelled documents that are looked at, and their lines in all.
ROWS, LINES = 12_000, 150_000
#: Classes of bytes that lines are measured by.
BYTES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".,;:?'\"()-", "shout": b"!", "bar": b"|", "mark": b"#$%&*@^~<>{}[]=+_\\/`", "blank": b" \t"}
_TABLE = np.full(256, len(BYTES), np.uint8)
for _i, _chars in enumerate(BYTES.values()):
    _TABLE[list(_chars)] = _i
_TABLE[128:192] = len(BYTES) + 1  # inside a character of several bytes


def lines_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line of all texts, length of each line in characters, lines of each text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.split_pattern(texts, "\n")
    counts = np.diff(np.asarray(lists.offsets, np.int64))
    lines = pa.concat_arrays([lists.flatten()])
    n = len(lines)
    offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + n + 1]
    raw = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    line = np.repeat(np.arange(n), np.diff(offsets))
    kinds = len(BYTES) + 2
    by = np.bincount(line * kinds + _TABLE[raw], minlength=n * kinds).reshape(n, kinds).astype(np.float64)
    length = by[:, :-1].sum(1)
    upper, lower, digit, stop, shout, bar, mark, blank, other = (by[:, i] for i in range(kinds - 1))
    words = pc.split_pattern(lines, " ")
    coded = words.flatten().dictionary_encode()
    per = np.diff(np.asarray(words.offsets, np.int64))
    code = np.asarray(coded.indices, np.int64)
    owner = np.repeat(np.arange(n), per)
    key = np.sort(owner * max(1, len(coded.dictionary)) + code)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    distinct = np.bincount(key[new] // max(1, len(coded.dictionary)), minlength=n)
    again = np.zeros(n)
    if len(code) > 1:
        same = (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])
        again = np.bincount(owner[1:][same], minlength=n)
    same_line = np.asarray(lines.dictionary_encode().indices, np.int64)
    text = np.repeat(np.arange(len(texts)), counts)
    as_before = np.zeros(n)
    as_before[1:] = (same_line[1:] == same_line[:-1]) & (text[1:] == text[:-1])
    size, w = np.maximum(length, 1), np.maximum(per, 1)
    letters = np.maximum(upper + lower + other, 1)
    values = [upper / letters, digit / size, stop / w, shout / w, bar / w, mark / w, other / size, blank / size, 1 - distinct / w, again / w, length / w / 10]
    cuts = [(0.3, 0.7), (0.05, 0.3), (0.4,), (0.1, 0.5), (0.1, 0.5), (0.1, 0.5), (0.3,), (0.05, 0.3), (0.35, 0.6, 0.8), (0.1, 0.5), (0.3, 1.2)]
    columns = [np.ones(n), length == 0, length < 25, length > 2000, per <= 2, as_before]
    for v, at in zip(values, cuts):
        columns += [v > x for x in at] + [np.minimum(v, 2)]
    return np.stack(columns, 1).astype(np.float32), np.maximum(length, 1), counts


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Features of each line, of the line before and of the line after, within a text."""
    n, k = x.shape
    ends = np.cumsum(counts)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[ends - counts] = 0
    after[ends - 1] = 0
    return np.concatenate([x, before, after], 1)


def forward_backward(scores: np.ndarray, counts: np.ndarray, transitions: np.ndarray):
    """Marginals [line, state], expected transitions [2, 2] and log partition, over all chains.

    `scores` [line, state] are log potentials; chains lie one after the other."""
    n = len(scores)
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    longest = counts[order]
    e = np.exp(transitions)
    potential = np.exp(np.clip(scores - scores.max(1, keepdims=True), -60, 0))
    top = scores.max(1)
    alpha, beta, scale = np.zeros((n, 2)), np.ones((n, 2)), np.ones(n)
    steps = [int(np.searchsorted(-longest, -t, "left")) for t in range(int(longest[0]) if len(longest) else 0)]
    for t, live in enumerate(steps):
        at = starts[:live] + t
        a = potential[at] if t == 0 else (alpha[at - 1] @ e) * potential[at]
        scale[at] = a.sum(1)
        alpha[at] = a / scale[at][:, None]
    pairs = np.zeros((2, 2))
    for t in range(len(steps) - 1, 0, -1):
        at = starts[: steps[t]] + t
        right = potential[at] * beta[at] / scale[at][:, None]
        beta[at - 1] = right @ e.T
        pairs += (alpha[at - 1].T @ right) * e
    marginals = alpha * beta
    return marginals / marginals.sum(1, keepdims=True), pairs, float(np.log(scale).sum() + top.sum())


@dataclass
class QualityModel:
    weights: np.ndarray
    transitions: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def good(self, x: np.ndarray, length: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length-weighted marginals of each text, and the marginals of its lines."""
        s = np.stack([np.zeros(len(x)), with_neighbours(x, counts) @ self.weights], 1)
        m = forward_backward(s, counts, self.transitions)[0][:, 1]
        at = np.cumsum(counts) - counts
        return np.add.reduceat(m * length, at) / np.add.reduceat(length, at), m

    def score(self, texts: pa.Array) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), 0.5)
        mean, _ = self.good(*lines_of(texts))
        return sigmoid(self.slope * _logit(mean) + self.shift)


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(x: np.ndarray, length: np.ndarray, counts: np.ndarray, y: np.ndarray, steps: int = 120, l2: float = 0.5) -> QualityModel:
    """Trains the field and the calibration on lines and on labels of their texts (1: good)."""
    at = np.cumsum(counts) - counts
    wide = with_neighbours(x, counts)
    state = np.repeat(y, counts).astype(int)
    model = QualityModel(np.zeros(wide.shape[1]), np.zeros((2, 2)))
    chain = np.ones(len(state), bool)
    chain[at] = False
    n = len(y)
    for again in range(2):
        want = (wide.T @ state.astype(np.float32)).astype(np.float64)
        want_pairs = np.zeros((2, 2))
        np.add.at(want_pairs, (state[:-1][chain[1:]], state[1:][chain[1:]]), 1)
        w, t = model.weights.copy(), model.transitions.copy()
        gw, gt = np.full_like(w, 1e-8), np.full_like(t, 1e-8)
        for _ in range(steps):
            m, pairs, _z = forward_backward(np.stack([np.zeros(len(wide)), (wide @ w.astype(np.float32)).astype(np.float64)], 1), counts, t)
            dw, dt = (want - wide.T @ m[:, 1].astype(np.float32) - l2 * w) / n, (want_pairs - pairs - l2 * t) / n
            gw, gt = gw + dw**2, gt + dt**2
            w, t = w + 0.5 * dw / np.sqrt(gw), np.clip(t + 0.5 * dt / np.sqrt(gt), -6, 6)
        model = QualityModel(w, t)
        if again == 0:
            _, marginal = model.good(x, length, counts)
            bad = np.repeat(y, counts) == 0
            state = np.where(bad & (marginal > 0.5), 1, state)
            none = np.add.reduceat(1 - state, at) == 0  # a bad text keeps one bad line
            worst = [a + int(np.argmin(marginal[a : a + c])) for a, c, z in zip(at, counts, none & (y == 0)) if z]
            state[worst] = 0
    mean, _ = model.good(x, length, counts)
    z, slope, shift = _logit(mean), 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic regression with one input
        p = sigmoid(slope * z + shift)
        r, c = p * (1 - p) + 1e-6, p - y
        h = np.array([[(r * z * z).sum() + 1, (r * z).sum()], [(r * z).sum(), r.sum() + 1]])
        step = np.linalg.solve(h, [(c * z).sum() + slope - 1, c.sum() + shift])
        slope, shift = slope - np.clip(step[0], -1, 1), shift - np.clip(step[1], -1, 1)
    return QualityModel(model.weights, model.transitions, float(slope), float(shift))


def train(sample: DataFrame, lines: int = LINES) -> QualityModel:
    """Trains on a bounded table of at, doc_id, text and y (`training.labelled_sample`)."""
    # ROWS rows of numbers at most: one window may add them up
    order = Window.orderBy("at", "doc_id", "th")
    sized = sample.select("at", "doc_id", F.xxhash64("text").alias("th"), "y", F.size(F.split("text", "\n", -1)).alias("n")).where(F.col("n") <= lines)
    taken = sized.withColumn("sum", F.sum("n").over(order)).where(F.col("sum") <= lines).select("at", "doc_id", F.col("th").alias("_th"))
    chosen = sample.join(F.broadcast(taken), ["at", "doc_id"]).where(F.xxhash64("text") == F.col("_th")).select("at", F.col("doc_id").cast("string").alias("id"), "text", "y")

    def measure(batches):
        for batch in batches:
            for block in blocks(batch):
                x, length, counts = lines_of(block.column("text"))
                ends = np.cumsum(counts)
                cut = lambda v: pa.array([v[b - c : b].tobytes() for b, c in zip(ends, counts)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in ("at", "id", "y")), cut(x), cut(length)], names=["at", "id", "y", "x", "length"])

    # LINES lines at most, as a few dozen numbers each, in an order that does not depend on tasks
    rows = chosen.mapInArrow(measure, "at long, id string, y int, x binary, length binary").toPandas().sort_values(["at", "id"], kind="stable")
    y = (rows["y"].to_numpy() > 0).astype(int)
    if len(set(y.tolist())) < 2:
        return QualityModel(np.zeros(0), np.zeros((2, 2)))
    length = [np.frombuffer(v) for v in rows["length"]]
    counts = np.array([len(v) for v in length])
    x = np.concatenate([np.frombuffer(v, np.float32).reshape(c, -1) for v, c in zip(rows["x"], counts)])
    del rows
    return fit(x, np.concatenate(length), counts, y)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score (0 to 1, higher: good)."""

    def put(batches):
        for batch in batches:
            for block in blocks(batch):
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(model.score(block.column("text")))], names=["doc_id", "score"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(put, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
