"""Toxicity by weak supervision.

1. Voters.  Words (lexicon) and word beginnings (patterns) that labelled documents show to
   go with toxicity each vote `toxic` where they occur and abstain elsewhere; groups of
   voters also vote `clean` where none of the group occurs.
2. Label model.  Expectation-maximization estimates, without the labels, how often each
   voter votes what on toxic and on clean documents.  Voters that agree beyond this
   (correlation given the posterior) share their weight; then the model is fitted again.
3. Classifier.  A logistic regression on the words and word beginnings that tell most
   about the posterior is trained on posterior labels and scores every document.

Labels come in at 1 (which words may vote) and at the start of 2 (the share of toxic
documents).  All of this looks at a bounded sample of labelled documents (`rows`); scoring
looks at the whole text of every document, in one pass, without a shuffle.

Null and empty texts are scored by the bias; repeated rows and null ids are scored like
others; an empty table gives no rows; other columns are not looked at.  Without labels of
both kinds, or without any voter, every document has the score 0.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.training import SparseRows, logistic, sigmoid
from graphloom.llm.units import blocks
from graphloom.llm.words import LETTERS, Units

#: Labelled documents that are looked at; voters; groups of voters; columns of the classifier; lengths of word beginnings.
ROWS, VOTERS, GROUPS, COLUMNS, BEGINNINGS = 12_000, 240, 6, 3_000, (4, 5, 6)
#: Documents that a voter must occur in, and its least z value.
SUPPORT, LEAST_Z = 6, 5.0


def signs(unit: str) -> set[str]:
    """Words and word beginnings (with a `*`) of a unit, lower-cased."""
    found = set()
    for word in LETTERS.findall(unit.lower()):
        found.add(word)
        for n in BEGINNINGS:
            if len(word) > n:
                found.add(word[:n] + "*")
    return found


@dataclass
class LabelModel:
    """P(vote | class) for each voter: tables of [class, voter, vote], votes 0 none, 1 toxic, 2 clean."""

    prior: float
    tables: np.ndarray
    share: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.log(self.tables)
        voters = np.arange(votes.shape[1])
        evidence = ((logs[1][voters, votes] - logs[0][voters, votes]) * self.share).sum(1)
        return sigmoid(evidence + np.log(self.prior / (1 - self.prior)))

    def accuracies(self) -> np.ndarray:
        """How often each voter is right when it votes."""
        right = self.prior * self.tables[1, :, 1] + (1 - self.prior) * self.tables[0, :, 2]
        wrong = (1 - self.prior) * self.tables[0, :, 1] + self.prior * self.tables[1, :, 2]
        return right / (right + wrong)


def fit_label_model(votes: np.ndarray, prior: float, rounds: int = 40) -> LabelModel:
    """Expectation-maximization over the votes; `prior`, the share of toxic documents, is held."""
    n, m = votes.shape
    kinds = np.stack([votes == k for k in range(3)]).astype(np.float32)
    x = (votes == 1).astype(np.float64) - (votes == 2)

    def shares(left, least):
        left = left - left.mean(0)
        corr = np.abs(left.T @ left) / (np.outer(*[np.linalg.norm(left, axis=0)] * 2) + 1e-9)
        np.fill_diagonal(corr, 1)
        return 1 / np.where(corr > least, corr, 0).sum(1)

    # voters that say nearly the same share their weight from the start, lest they make the class
    share = shares(x, 0.8)
    toxic, clean = (votes == 1) @ share, (votes == 2) @ share
    q = np.where(toxic > clean, 0.9, np.where(toxic > 0, 0.6, 0.02))

    def tables(q):
        out = np.stack([np.stack([w @ kinds[k] for k in range(3)], 1) + np.array([1.0, 0.05, 0.05]) for w in (1 - q, q)])
        return out / out.sum(2, keepdims=True)

    model = LabelModel(prior, tables(q), share)
    for again in range(2):
        for _ in range(rounds):
            new = model.posterior(votes)
            model = LabelModel(prior, tables(new), share)
            if abs(new - q).max() < 1e-4:
                break
            q = new
        if again == 0:
            # what the class does not explain: correlation of the votes given the posterior
            mean = [((1 - q) @ x) / (1 - q).sum(), (q @ x) / q.sum()]
            share = shares(x - ((1 - q)[:, None] * mean[0] + q[:, None] * mean[1]), 0.2)
            model = LabelModel(prior, model.tables, share)
    return model


@dataclass
class ToxicityModel:
    columns: dict[str, int]
    weights: np.ndarray
    bias: float
    label_model: LabelModel | None = None
    voters: tuple[str, ...] = ()

    def numbers(self, unit: str) -> list[int]:
        get = self.columns.get
        return [c for s in signs(unit) if (c := get(s)) is not None]

    def score(self, texts: pa.Array) -> np.ndarray:
        if not self.columns:
            return np.zeros(len(texts))
        rows = Units(texts).features(self.numbers)
        return sigmoid(np.array([self.weights[r].sum() for r in rows]) + self.bias)


def train(sample: DataFrame, voters: int = VOTERS, columns: int = COLUMNS) -> ToxicityModel:
    """Trains on a bounded table of text and y (`training.labelled_sample`)."""

    def count(batches):
        seen, n = {0: Counter(), 1: Counter()}, Counter()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                y = int(y > 0)
                seen[y].update(set().union(*map(signs, set(text.split(" ")))))
                n[y] += 1
        names = sorted(set(seen[0]) | set(seen[1]))
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"sign": part, "clean": [seen[0][s] for s in part], "toxic": [seen[1][s] for s in part]})
        yield pa.RecordBatch.from_pydict({"sign": [""], "clean": [n[0]], "toxic": [n[1]]})  # the documents

    counts = sample.mapInArrow(count, "sign string, clean long, toxic long").groupBy("sign").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = counts.persist()
    try:
        total = counts.where("sign = ''").first()
        if total is None or not total.clean or not total.toxic:
            return ToxicityModel({}, np.zeros(0), 0.0)
        n0, n1 = float(total.clean), float(total.toxic)
        pooled = (F.col("toxic") + F.col("clean") + 1) / (n0 + n1 + 2)
        z = (F.col("toxic") / n1 - F.col("clean") / n0) / F.sqrt(pooled * (1 - pooled) * (1 / n0 + 1 / n1))
        best = counts.where(F.col("sign") != "").where(F.col("toxic") + F.col("clean") >= SUPPORT).withColumn("z", z)
        top = best.where(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "sign").limit(columns).collect()
    finally:
        counts.unpersist()
    votes_toxic = [r for r in top if r.z > 0 and r.toxic / n1 > 8 * (r.clean + 0.5) / n0][:voters]
    if not votes_toxic:
        return ToxicityModel({}, np.zeros(0), 0.0)
    names = {r.sign: i for i, r in enumerate(top)}
    model = ToxicityModel(names, np.zeros(len(names)), 0.0)

    def incidence(batches):
        for batch in batches:
            for block in blocks(batch):
                rows = Units(block.column("text")).features(model.numbers)
                yield pa.RecordBatch.from_arrays([block.column("at"), block.column("doc_id").cast(pa.string()), pa.array(rows, pa.list_(pa.int64()))], names=["at", "id", "c"])

    # at most ROWS lists of at most COLUMNS numbers, in an order that does not depend on tasks
    found = sample.select("at", "doc_id", "text").mapInArrow(incidence, "at long, id string, c array<long>").collect()
    rows = [np.array(r.c, np.int64) for r in sorted(found, key=lambda r: (r["at"], r.id, r.c))]
    place = {names[r.sign]: i for i, r in enumerate(votes_toxic)}
    m = len(place)
    votes = np.zeros((len(rows), m + GROUPS), np.int64)
    for i, r in enumerate(rows):
        for c in r.tolist():
            if c in place:
                votes[i, place[c]] = 1
    for g in range(GROUPS):
        hit = (votes[:, np.arange(g, m, GROUPS)] == 1).any(1) if m > g else np.zeros(len(rows), bool)
        votes[:, m + g] = np.where(hit, 1, 2)
    label_model = fit_label_model(votes, n1 / (n0 + n1))
    q = label_model.posterior(votes)
    w, b = logistic(SparseRows(rows, len(names)), q, np.ones(len(q)), l2=1.0, steps=300)
    return ToxicityModel(names, w, b, label_model, tuple(r.sign for r in votes_toxic))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score (0 to 1, higher: toxic)."""

    def put(batches):
        for batch in batches:
            for block in blocks(batch):
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(model.score(block.column("text")))], names=["doc_id", "score"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(put, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
