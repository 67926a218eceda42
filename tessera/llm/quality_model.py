"""Quality classifier from weak labels: labelled by voting rules, learnt by a hashed linear scorer.

Overlapping heuristic labellers vote on every document; expectation-maximisation over the vote patterns of all
documents estimates their accuracies and gives each pattern a posterior chance to be good (label_model). A bounded
sample of documents of either posterior side (SAMPLE each, those with the least text hash) with its posterior labels
trains a logistic scorer on hashed word and word-shape frequencies, each side weighted by its share of the corpus. The
scorer then judges every whole text: documents with a score of at least one half are kept.

Null and empty texts have no features and get the score of the intercept. Repeated rows are scored alike. Ties at one
half are kept. An empty table gives an empty result. score() reads doc_id and text; keep() passes all columns through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, release, whole
from tessera.llm.label_model import posteriors
from tessera.llm.quality_rules import rules, stats

#: Documents of each posterior side in the training sample: the bound of what reaches the driver.
SAMPLE = 2000
SLOTS = 2048
EPOCHS, RATE, DECAY = 300, 0.5, 1e-5
CACHE = 300_000


def shape(word: str) -> str:
    """The kinds of characters of a word, runs collapsed: 'THE!!' -> 'A!', 'Reed,' -> 'Aa,'."""
    out = []
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out[:12])


class Slots(dict):
    """word -> (slot of the word, slot of its shape), kept for a bounded number of words."""

    def __missing__(self, word: str) -> tuple[int, int]:
        import xxhash

        if len(self) >= CACHE:
            self.clear()
        half = SLOTS // 2
        got = self[word] = xxhash.xxh32_intdigest(word) % (half - 1) + 1, half + xxhash.xxh32_intdigest(shape(word)) % half
        return got


class Weighed(dict):
    """word -> the sum of its slots' weights."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights, self.slots = weights, Slots()

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        a, b = self.slots.__missing__(word)
        self.slots.clear()
        got = self[word] = float(self.weights[a] + self.weights[b])
        return got


#: Slot 0: share of words equal to the word before.
def features(text: str, slots: Slots) -> np.ndarray:
    found = text.split()
    x = np.zeros(SLOTS, np.float32)
    if found:
        x += np.bincount(np.array([slots[w] for w in found]).ravel(), minlength=SLOTS)
        x[0] = sum(map(eq, found, found[1:]))
        x /= len(found)
    return x


def train(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on soft labels; full-batch Adam."""
    theta, bias, turned = np.zeros(x.shape[1], np.float32), 0.0, np.ascontiguousarray(x.T)
    m, v = np.zeros(x.shape[1] + 1, np.float64), np.zeros(x.shape[1] + 1, np.float64)
    w = w / max(w.sum(), 1e-9)
    for t in range(1, EPOCHS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ theta + bias, -30, 30)))
        d = ((p - y) * w).astype(np.float32)
        g = np.append(turned @ d + DECAY * theta, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        theta, bias = theta - step[:-1].astype(np.float32), bias - float(step[-1])
    return theta, bias


def fit(docs: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and intercept. Without documents on one side the scorer keeps all, or none."""
    own = rules()
    hashed = docs.select("doc_id", "text").withColumn("_hash", F.xxhash64(whole()))
    voted = cut(stats(hashed, ("_hash",)).select("_hash", F.array(*own).alias("votes")))
    chance = cut(posteriors(voted, len(own)))  # at most 3 ** rules rows
    sides = {bool(r.good): r.n for r in chance.groupBy((F.col("posterior") >= 0.5).alias("good")).agg(F.sum("n").alias("n")).collect()}
    if len(sides) < 2:
        return np.zeros(SLOTS, np.float32), -30.0 if sides and True not in sides else 30.0
    marked = voted.join(F.broadcast(chance.select("votes", "posterior")), "votes").select("_hash", "posterior").distinct()
    good = F.col("posterior") >= 0.5
    sample = marked.where(good).orderBy("_hash").limit(SAMPLE).union(marked.where(~good).orderBy("_hash").limit(SAMPLE))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in batches:
            rows = [features(t.as_py(), slots) for t in batch.column(2)]
            at = [np.flatnonzero(x) for x in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array([x[i] for x, i in zip(rows, at, strict=True)], pa.list_(pa.float32()))],
                ["h", "posterior", "at", "x"],
            )

    picked = hashed.join(F.broadcast(cut(sample)), "_hash").select("_hash", "posterior", whole().alias("t"))
    table = picked.mapInArrow(featurise, "h long, posterior double, at array<int>, x array<float>").dropDuplicates(["h"]).orderBy("h").toArrow()
    x = np.zeros((table.num_rows, SLOTS), np.float32)
    for k, (at, values) in enumerate(zip(table["at"], table["x"], strict=True)):
        x[k, at.values.to_numpy()] = values.values.to_numpy()
    y = table["posterior"].to_numpy()
    up = y >= 0.5
    weight = np.where(up, sides[True] / max(1, up.sum()), sides[False] / max(1, (~up).sum()))
    release(docs.sparkSession)
    return train(x, y, weight)


def _scorer(weights: np.ndarray, bias: float):
    weighed = Weighed(weights)

    def one(text: str | None) -> float:
        found = (text or "").split()
        s = bias
        if found:
            s += (sum(map(weighed.__getitem__, found)) + float(weights[0]) * sum(map(eq, found, found[1:]))) / len(found)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))

    return one


def score(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, score, kept."""
    weights, bias = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _scorer(weights, bias)
        for batch in batches:
            s = [one(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array([x >= 0.5 for x in s], pa.bool_())], ["doc_id", "score", "kept"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, score double, kept boolean")


def keep(docs: DataFrame) -> DataFrame:
    """docs without the documents that the scorer rejects. Same columns."""
    weights, bias = fit(docs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _scorer(weights, bias)
        for batch in batches:
            yield batch.filter(pa.array([one(t.as_py()) >= 0.5 for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
