"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A text becomes three streams: its words (lower case), its words' shapes (runs of upper-case, lower-case
letters, digits and marks) and whether a word repeats the one before or the one before that. Uni- and
bigrams of words and uni-, bi- and trigrams of the marks are hashed to a table of 2^BITS weights; a
feature's value is its share of the text's n-grams, under a root, so that length has little say. A score
is one sparse dot product. Training sees a bounded sample of the labelled rows."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, held_out, labels, map_arrow, slices

BITS = 18
_K = np.uint64(0x9E3779B97F4A7C15)
_SHAPE = re.compile(r"([A-Z\xc0-\xde]+)|([a-z\xdf-\xff]+)|(\d+)|([^\w\s]+)|(.)", re.S)


def shape(word: str) -> str:
    """Kinds of the whole word's character runs, in order; marks by themselves, once each."""
    runs = _SHAPE.findall(word)
    return "".join("A" if up else "a" if low else "0" if digit else mark[0] if mark else "x" for up, low, digit, mark, _ in runs)


class _Words(dict):
    """word: hashes of its lower case and its shape; starts anew beyond a bound."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= 300_000:
            self.clear()
        v = self[word] = (xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass")), xxhash.xxh3_64_intdigest(shape(word).encode("utf-8", "surrogatepass"), 1))
        return v


def _mixed(*parts: np.ndarray, kind: int) -> np.ndarray:
    h = np.full(len(parts[0]), kind + 1, np.uint64)
    for p in parts:
        h = (h ^ (h >> np.uint64(31))) * _K + p
    h = (h ^ (h >> np.uint64(32))) * _K
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a whole text; an empty one has the bias alone (slot 0)."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return np.zeros(1, np.int64), np.ones(1, np.float32)
    pairs = np.array([known[w] for w in words], np.uint64)
    word, form = pairs[:, 0], pairs[:, 1]
    same = np.zeros(n, np.uint64)
    same[1:] |= (word[1:] == word[:-1]).astype(np.uint64)
    same[2:] |= (word[2:] == word[:-2]).astype(np.uint64) << np.uint64(1)
    marks = form + same * np.uint64(0x9E37)
    groups = [_mixed(word, kind=0), _mixed(word[:-1], word[1:], kind=1), _mixed(form, kind=2), _mixed(marks[:-1], marks[1:], kind=3), _mixed(form[:-2], form[1:-1], form[2:], kind=4), _mixed(same, kind=5)]
    slots, values = [np.zeros(1, np.int64)], [np.ones(1)]
    for g in groups:
        if len(g):
            s, c = np.unique(g, return_counts=True)
            slots.append(s)
            values.append(np.sqrt(c / len(g)))
    return np.concatenate(slots), np.concatenate(values).astype(np.float32)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader with L1 and L2."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 1e-4):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, slots) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int, weight: float = 1.0) -> None:
        w = self.weights(slots)
        p = 1 / (1 + np.exp(-np.clip(w @ values, -35, 35)))
        g = weight * (p - label) * values
        self.z[slots] += g - (np.sqrt(self.n[slots] + g * g) - np.sqrt(self.n[slots])) / self.alpha * w
        self.n[slots] += g * g


def sample(known: DataFrame, rows: int) -> DataFrame:
    """At most so many rows, the first by a hash of their id: the same ones in every run."""
    return known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)


def train(docs: DataFrame, known: DataFrame, rows: int = 6000, passes: int = 4, chars: int = 1 << 26) -> np.ndarray:
    """Weights from docs (doc_id, text) and known (doc_id, label 0/1). rows and chars bound what is learnt from:
    the first rows by a hash of their id, as long as their texts have no more characters together (the first row
    is always taken).

    Features are made on the executors; the driver holds those of the sample at most. Rows without an id or a
    label teach nothing; repeated ids are learnt as often as they stand with a text; texts are whole, however
    long. Without labels all weights are 0. Other columns don't matter."""
    chosen = sample(known.where("doc_id is not null and label is not null").select("doc_id", "label"), rows)
    sized = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `rows` rows
    before = W.orderBy(F.xxhash64("doc_id"), "doc_id", "is", "label").rowsBetween(W.unboundedPreceding, -1)
    # the sample's ids, hashes and sizes in one task: bounded by `rows` and what repeats their ids
    sized = sized.select("doc_id", "label", F.xxhash64("text").alias("is"), F.length(F.coalesce("text", F.lit(""))).alias("size"), "text")
    fits = sized.select("doc_id", "label", "is", "size").withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).where((F.col("before") == 0) | (F.col("before") + F.col("size") <= chars))
    fits = fits.select("doc_id", "label", "is").distinct()

    def run(batches):
        words = _Words()
        for batch in batches:
            for r in slices(batch, "text"):
                made = [features(t, words) for t in r["text"]]
                yield {"doc_id": r["doc_id"], "label": r["label"], "slots": [m[0].astype("<i4").tobytes() for m in made], "shares": [m[1].astype("<f2").tobytes() for m in made]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = map_arrow(sized.join(F.broadcast(fits), ["doc_id", "label", "is"]).select("doc_id", "text", "label"), run, f"doc_id {kind}, label int, slots binary, shares binary").collect()
    data = [(np.frombuffer(bytes(r.slots), "<i4").astype(np.int64), np.frombuffer(bytes(r.shares), "<f2").astype(np.float64), r.label) for r in sorted(found, key=lambda r: (xxhash.xxh3_64_intdigest(str(r.doc_id)), bytes(r.slots)))]
    model = Ftrl(1 << BITS)
    for _ in range(passes):
        for slots, values, label in data:
            model.learn(slots, values, label)
    return model.weights(slice(None)).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score of every row, repeated ones and null ids too; whole texts, however long. Null and empty texts
    get the bias alone; equal texts get equal scores. Other columns don't matter; an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2^BITS numbers

    def run(batches):
        words, w = _Words(), shared.value
        for batch in batches:
            for r in slices(batch, "text"):
                made = [features(t, words) for t in r["text"]]
                yield {"doc_id": r["doc_id"], "score": [float(1 / (1 + np.exp(-np.clip(w[s] @ v, -35, 35)))) for s, v in made]}

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op10_quality_classifier(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    docs = documents(spark, sf_dir)
    known = labels(spark, sf_dir).where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("label"))
    scored = score(docs, train(docs, known))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
