"""Toxicity: cumulative-link ordinal regression on sparse text features.

Severity has ordered grades 0 to K - 1.  One weight per feature is shared by all thresholds:
``P(grade <= k) = logistic(threshold_k - score)``, ``score`` the sum of the weights of a
document's distinct words (runs of letters, lower-cased) and word beginnings (of ``PREFIXES``
bytes, where the word goes on).  What is reported is the expected
grade, the probability of a grade above 0 and the most probable grade.

The model is fitted on a bounded sample of labelled documents (``sample_docs``, by a seeded
hash of the id): features of at least ``LEAST_DOCS`` of them are screened by their score test
to the ``most_features`` strongest, and fitted by accelerated proximal gradient with an L1
penalty, which leaves few features.  Features are 50-bit hashes in a sorted array, so that no
frequent word shares a weight with rare ones; the model that is broadcast has at most
``most_features`` of them.

Defined results: null and empty texts have no features and the score 0; repeated rows get
equal results, and repeated labels count as often; a text of any length is one set of features;
unlabelled documents are scored as all others; without any label the
expected grade is 0; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm import textkit as tk

LEAST_DOCS = 3
PREFIXES = (5, 6, 7)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class OrdinalModel:
    """Sorted feature hashes with their weights, and the thresholds between grades."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        return logistic(score[:, None] - self.thresholds[None, :])


def occurrences(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word of a slice of texts, and of the proper prefixes of words."""
    words = tk.Words(part, lower=True, letters=True)
    rows, hashes = [words.row], [words.hash]
    for n in PREFIXES:
        long = words.end - words.start > n
        start = words.start[long]
        rows.append(words.row[long])
        hashes.append(tk.mix(tk.word_hashes(words.bytes, start, start + n) + np.uint64(n)))
    return np.concatenate(rows), np.concatenate(hashes)


def row_features(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of a slice of texts."""
    return tk.distinct(*occurrences(part))


def fit(row: np.ndarray, feature: np.ndarray, grade: np.ndarray, *, grades: int, penalty: float, most_features: int, rounds: int = 300) -> OrdinalModel:
    """The model of (row, feature) pairs and a grade for each row."""
    n = len(grade)
    level = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:-1] / n if n else np.ones(grades - 1), 1e-4, 1 - 1e-4)
    thresholds = np.maximum.accumulate(np.log(level / (1 - level)) + 1e-6 * np.arange(grades - 1))
    empty = OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), thresholds)
    if not n or len(np.unique(grade)) < 2:
        return empty
    names, column, count = np.unique(feature, return_inverse=True, return_counts=True)
    edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
    null = 1 - logistic(edges[grade + 1]) - logistic(edges[grade])  # slope of the loss by the score
    strength = np.abs(np.bincount(column, null[row], len(names))) / np.sqrt(count)
    chosen = np.flatnonzero(count >= min(LEAST_DOCS, n))
    chosen = np.sort(chosen[np.argsort(-strength[chosen], kind="stable")[:most_features]])
    if not len(chosen):
        return empty
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    own = place[column] >= 0
    row, column = row[own], place[column[own]]
    m = len(chosen)
    # the largest eigenvalue of X'X / n bounds the curvature
    v = np.ones(m)
    for _ in range(20):
        v = np.bincount(column, np.bincount(row, v[column], n)[row], m)
        size = np.linalg.norm(v)
        v /= size
    step = 1 / (0.5 * size / n + 1)
    weights = ahead = np.zeros(m)
    cuts = cuts_ahead = thresholds.copy()
    momentum = 1.0
    for _ in range(rounds):
        score = np.bincount(row, ahead[column], n)
        edges = np.concatenate([[-np.inf], cuts_ahead, [np.inf]])
        high, low = logistic(edges[grade + 1] - score), logistic(edges[grade] - score)
        slope = (1 - high - low) / n
        inside = np.maximum(high - low, 1e-12)
        push = np.bincount(grade, -high * (1 - high) / inside, grades)[:-1] + np.bincount(grade, low * (1 - low) / inside, grades)[1:]
        moved = ahead - step * np.bincount(column, slope[row], m)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        new_cuts = np.maximum.accumulate(cuts_ahead - step * push / n)
        next_momentum = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        keep = (momentum - 1) / next_momentum
        ahead, cuts_ahead = new + keep * (new - weights), np.maximum.accumulate(new_cuts + keep * (new_cuts - cuts))
        weights, cuts, momentum = new, new_cuts, next_momentum
    alive = weights != 0
    return OrdinalModel(names[chosen][alive], weights[alive], cuts)


def train(docs: DataFrame, labels: DataFrame, grade: Column, *, grades: int, sample_docs: int = 8000, seed: int = 5, penalty: float = 1e-4, most_features: int = 4096) -> OrdinalModel:
    """Fits the model to ``grade``, an expression over the columns of ``labels``.

    Of documents of one id, the text of least hash stands for it; an id with several labels
    counts with each.
    """
    sample = labels.select("doc_id", grade.cast("int").alias("grade")).filter("doc_id is not null and grade is not null").orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id", "grade").limit(sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in tk.slices(batch.column("text")):
                row, feature = row_features(part)
                ends = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("grade").slice(at, len(part)), pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int64)))], names=["grade", "features"])

    texts = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi")
    one = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))  # so at most ``sample_docs`` rows come to the driver
    found = one.join(F.broadcast(sample), "doc_id").select("grade", "text").mapInArrow(run, "grade int, features array<long>").toArrow().combine_chunks()
    lists = found["features"].combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    target = np.clip(found["grade"].to_numpy().astype(np.int64), 0, grades - 1)
    return fit(row, lists.flatten().to_numpy().astype(np.uint64), target, grades=grades, penalty=penalty, most_features=most_features)


def score(docs: DataFrame, model: OrdinalModel, *, least: float = 0.3) -> DataFrame:
    """Per document: doc_id, expected_severity, p_toxic, grade, toxic (p_toxic of ``least`` or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at, part in tk.slices(batch.column("text")):
                rows, hashes = occurrences(part)
                total = np.zeros(len(part))
                if len(own.features):
                    token = hashes >> np.uint64(64 - tk.TOKEN_BITS)
                    place = np.minimum(np.searchsorted(own.features, token), len(own.features) - 1)
                    known = own.features[place] == token
                    row, feature = tk.distinct(rows[known], hashes[known])
                    total = np.bincount(row, own.weights[np.searchsorted(own.features, feature)], len(part))
                above = own.above(total)
                each = -np.diff(np.concatenate([np.ones((len(part), 1)), above, np.zeros((len(part), 1))], axis=1), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(part)), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] >= least)],
                    names=["doc_id", "expected_severity", "p_toxic", "grade", "toxic"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, expected_severity double, p_toxic double, grade int, toxic boolean")
