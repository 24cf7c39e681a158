"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

A text becomes the counts of its words, marks and pairs of neighbours, hashed to `2**bits` slots,
damped by log(1 + count) and scaled to length one. A pair of two equal words counts as one
feature whatever the word, so that repetition is learnt for words that training never saw.
Training runs over at most `max_rows` labelled rows (a documented bound: the rows with the smallest
keyed hashes), in an order that depends on those hashes alone. Their features are written once; each epoch is a task that
streams them in that order, so it holds a batch and the model's two vectors whatever the texts' lengths, and a lost
epoch starts again from the vectors of the one before. Scoring is a sparse dot product for each whole text, without any shuffle.

Nulls: a null or empty text has only the intercept and still gets a score. A null doc_id is never
held out and never a training row. Labels that are null or not 0 or 1 are ignored; of repeated
labels of a document the smallest counts. Without labels every score is one half. Extra
columns pass through `scored` and `accepted` unread.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import forget, memories, staged, table, texts

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Added to the input's columns; renamed by callers.
SCORE = "__quality_score"
_MEMORY = 400_000


class _Hashes(dict):
    """Hashes of words, for as many words as a worker may remember."""

    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        if len(self) >= _MEMORY:
            self.clear()
        self[word] = h
        return h


_hashes = _Hashes()
memories.append(_hashes)


def _alone() -> None:
    """Have this worker forget what other operators remember. Tasks call it by name: they get copies of what they hold themselves."""
    forget(_hashes)


def features(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a whole text; slot 2**bits is the intercept."""
    h = np.fromiter(map(_hashes.__getitem__, TOKEN.findall(text or "")), np.uint32)
    pairs = h[:-1] * np.uint32(0x9E3779B1) + h[1:] * np.uint32(0x85EBCA6B)
    pairs[h[:-1] == h[1:]] = 0x5BD1E995
    slots, counts = np.unique(np.concatenate([h, pairs]) >> np.uint32(32 - bits), return_counts=True)
    values = np.log1p(counts)
    norm = np.sqrt((values * values).sum()) or 1.0
    return np.append(slots, np.uint32(1 << bits)), np.append(values / norm, 1.0)


class Ftrl:
    """FTRL-proximal over 2**bits slots and the intercept; share: the weight of a row by its label."""

    def __init__(self, bits: int, share: dict[int, float], state: bytes | None = None, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.05) -> None:
        self.share, self.alpha, self.beta, self.l1, self.l2 = share, alpha, beta, l1, l2
        held = np.frombuffer(state, "<f8").copy() if state else np.zeros(2 * ((1 << bits) + 1))
        self.z, self.n = held.reshape(2, -1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w, before = self.weights(at), self.n[at]
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30))) - y) * self.share[y] * x
        self.n[at] = before + g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - np.sqrt(before)) / self.alpha * w

    def state(self) -> bytes:
        return np.stack([self.z, self.n]).astype("<f8").tobytes()


def _extract(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _alone()
        for batch in batches:
            got = [features(x.as_py(), bits) for x in batch.column("text")]
            columns = [pa.array([a.astype(t).tobytes() for a in g], pa.binary()) for g, t in zip(zip(*got), ("<u4", "<f4"))] if got else [pa.array([], pa.binary())] * 2
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("turn"), *columns], names=["label", "turn", "slots", "vals"])

    return run


def _epoch(bits: int, share: dict[int, float], state: bytes | None):
    """Rows in the order of training -> the model's vectors after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl(bits, share, state)
        for batch in batches:
            for y, slots, vals in zip(batch.column("label").to_pylist(), batch.column("slots"), batch.column("vals")):
                model.learn(np.frombuffer(slots.as_buffer(), "<u4"), np.frombuffer(vals.as_buffer(), "<f4").astype(float), y)
        yield pa.RecordBatch.from_arrays([pa.array([model.state()], pa.binary())], names=["state"])

    return run


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, bits: int = 18, max_rows: int = 20_000, epochs: int = 8, seed: int = 9) -> np.ndarray:
    """Weights from labelled documents outside the held-out fold.

    The sample has at most max_rows rows of two numbers, so broadcasting it is safe by its bound.
    """
    known = labels.select(F.col("doc_id").alias("of_doc"), F.col("quality").cast("int").alias("label")).where("of_doc is not null and label in (0, 1)")
    known = known.where(~held_out(F.col("of_doc"))).groupBy("of_doc").agg(F.min("label").alias("label"))
    sample = known.withColumn("turn", F.xxhash64(F.lit(seed), "of_doc")).orderBy("turn", "of_doc").limit(max_rows)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("of_doc")).select("text", "label", "turn")
    rows = staged(rows.mapInArrow(_extract(bits), "label int, turn long, slots binary, vals binary"), "quality-rows")
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    share = {y: sum(counts.values()) / (2 * n) for y, n in counts.items()}
    state = None
    for _ in range(epochs if counts else 0):
        state = rows.coalesce(1).sortWithinPartitions("turn", "label", "slots").mapInArrow(_epoch(bits, share, state), "state binary").first().state
    return Ftrl(bits, share, state).weights().astype("<f4")


def _score(weights: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _alone()
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column("text")):
                at, x = features(text.as_py(), bits)
                scores[i] = weights[at] @ x
            yield batch.append_column(SCORE, pa.array(1.0 / (1.0 + np.exp(-np.clip(scores, -30, 30)))))

    return run


def scored(docs: DataFrame, weights: np.ndarray, bits: int = 18) -> DataFrame:
    """docs with a column SCORE from 0 to 1."""
    return docs.mapInArrow(_score(weights, bits), T.StructType([*docs.schema.fields, T.StructField(SCORE, T.DoubleType())]))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that score at least the threshold."""
    return scored(docs, trained(docs, labels)).where(F.col(SCORE) >= threshold).drop(SCORE)


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    out = scored(docs, trained(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= 0.3).cast("int").alias("predicted"))
