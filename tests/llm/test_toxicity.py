"""The ordinal regression: its fit against a plain optimiser, and scores of odd rows by hand."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import textkit as tk
from tidewell.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, grade string, toxic int"


def docs(spark, rows):
    """(doc_id, text) rows with the columns of documents and two that clash."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 7) for i, t in rows], DOCS).repartition(3)


def loss(matrix, grade, weights, cuts, penalty):
    """Mean negative log-likelihood of the cumulative-link model, plus the penalty."""
    total = 0.0
    for row, g in zip(matrix, grade, strict=True):
        s = float(row @ weights)
        below = [0.0, *(1 / (1 + math.exp(s - c)) for c in cuts), 1.0]
        total -= math.log(max(below[g + 1] - below[g], 1e-300))
    return total / len(grade) + penalty * np.abs(weights).sum()


def sample(seed, n=90, m=9, grades=3):
    rng = np.random.default_rng(seed)
    matrix = (rng.random((n, m)) < 0.35).astype(float)
    latent = matrix @ rng.normal(0, 1.5, m) + rng.logistic(size=n)
    grade = np.searchsorted(np.quantile(latent, [0.5, 0.8][: grades - 1]), latent)
    return matrix, grade


@pytest.mark.parametrize(("seed", "grades"), [(1, 3), (2, 3), (3, 2)])
def test_fit_is_the_optimum(seed, grades):
    matrix, grade = sample(seed, grades=grades)
    row, column = np.nonzero(matrix)
    names = np.arange(100, 100 + matrix.shape[1], dtype=np.uint64)
    penalty = 0.01
    model = toxicity.fit(row, names[column], grade, grades=grades, penalty=penalty, most_features=50, rounds=3000)
    weights = np.zeros(matrix.shape[1])
    weights[np.searchsorted(names, model.features)] = model.weights
    best = loss(matrix, grade, weights, model.thresholds, penalty)
    # slopes by differences: none along thresholds and live weights, at most the penalty elsewhere
    smooth = lambda w, c: loss(matrix, grade, w, c, 0.0)
    h = 1e-5
    for j in range(len(weights)):
        step = np.eye(len(weights))[j] * h
        slope = (smooth(weights + step, model.thresholds) - smooth(weights - step, model.thresholds)) / (2 * h)
        assert slope == pytest.approx(-penalty * np.sign(weights[j]), abs=1e-4) if weights[j] else abs(slope) <= penalty + 1e-4
    for j in range(grades - 1):
        step = np.eye(grades - 1)[j] * h
        assert abs(smooth(weights, model.thresholds + step) - smooth(weights, model.thresholds - step)) / (2 * h) < 1e-4
    # a plain search from elsewhere finds nothing better
    rng = random.Random(seed)
    w, c, width = np.zeros(len(weights)), np.sort(np.array([rng.uniform(-1, 1) for _ in range(grades - 1)])), 1.0
    found = loss(matrix, grade, w, c, penalty)
    while width > 1e-4:
        better = False
        for k in range(len(w) + len(c)):
            for sign in (1, -1):
                x, y = w.copy(), c.copy()
                if k < len(w):
                    x[k] += sign * width
                else:
                    y[k - len(w)] += sign * width
                if (y[1:] > y[:-1]).all() and (now := loss(matrix, grade, x, y, penalty)) < found - 1e-12:
                    w, c, found, better = x, y, now, True
        width *= 1 if better else 0.5
    assert best <= found + 1e-6


def plain_features(text):
    """Hashes of a text's distinct words and word beginnings."""
    data = (text or "").encode()
    words = re.findall(rb"[a-z\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in data))
    hash_of = lambda w: int(tk.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    found = {hash_of(w) for w in words}
    for w in words:
        for n in toxicity.PREFIXES:
            if len(w) > n:
                found.add(int(tk.mix(np.array([hash_of(w[:n]) + n & (1 << 64) - 1], dtype=np.uint64))[0]))
    return {h >> (64 - tk.TOKEN_BITS) for h in found}


def test_scores_by_hand(spark):
    rng = random.Random(5)
    vocabulary = ["Idiots", "idiotic", "scum!", "kind", "straße", "日本", "überaus", "words", "disgustingly"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "IDIOTS " * 60_000), (None, "scum"), (7, rows[7][1]), (503, "𝔘 1234 ...")]
    features = sorted(set().union(*(plain_features(t) for _, t in rows)))
    model = toxicity.OrdinalModel(np.array(features, np.uint64), np.array([rng.uniform(-1, 2) for _ in features]), np.array([0.5, 1.75]))
    found = sorted(toxicity.score(docs(spark, rows), model).collect(), key=str)
    weight = dict(zip(features, model.weights.tolist(), strict=True))
    expected = []
    for i, text in rows:
        s = sum(weight[f] for f in plain_features(text))
        above = [1 / (1 + math.exp(t - s)) for t in model.thresholds]
        each = [1 - above[0], above[0] - above[1], above[1]]
        expected.append((i, sum(above), above[0], each.index(max(each)), above[0] >= 0.3))
    for r, e in zip(found, sorted(expected, key=lambda e: f"Row(doc_id={e[0]}, expected_severity={e[1]}"), strict=True):
        assert (r.doc_id, r.grade, r.toxic) == (e[0], e[3], e[4])
        assert (r.expected_severity, r.p_toxic) == pytest.approx((e[1], e[2]))


def test_held_out_in_languages_and_repeated_labels(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(900):
        toxic = rng.random() < 0.2
        tag = "é" if i % 3 == 0 else "w"
        words = [f"{tag}{int(rng.paretovariate(0.7)) % 400}" for _ in range(60)]
        if toxic:
            words[rng.randrange(60)] = rng.choice(["crétin", "Ordure!"] if i % 3 == 0 else ["idiot,", "SCUM", "moron!!"])
        rows.append((i, " ".join(words)))
        labels.append((i, rng.randint(0, 1), int(toxic)))
    given = spark.createDataFrame(labels[:600] + labels[:50] + [(None, 1, 1), (77_777, None, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs(spark, rows), given, F.col("toxic") * (2 - F.col("quality")), grades=3)
    assert len(model.features) < 2000 and (np.diff(model.thresholds) >= 0).all()
    found = {r.doc_id: r for r in toxicity.score(docs(spark, rows), model).collect()}
    held = [(found[i].toxic, bool(t)) for i, _, t in labels[600:]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert sum(a and b for a, b in held) >= 0.9 * sum(b for _, b in held)
    assert all(0 <= r.expected_severity <= 2 for r in found.values())


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(1, "some words"), (2, None)]
    model = toxicity.train(docs(spark, rows), none, F.col("toxic"), grades=2)
    assert not any(r.toxic for r in toxicity.score(docs(spark, rows), model).collect())
    assert toxicity.score(docs(spark, []), model).collect() == []
    assert len(tk.distinct(*toxicity.occurrences(pa.array([""], pa.large_string())))[0]) == 0


def test_repeated_ids_give_one_row_each(spark):
    """However often a labelled id repeats, one text stands for it, the same in any order of rows."""
    rows = [(i, f"word{i % 7} other{i % 3} text") for i in range(60)]
    often = rows + [(5, f"copy{k} text") for k in range(500)]
    labels = spark.createDataFrame([(i, i % 7 == 0) for i in range(60)], "doc_id long, bad boolean")
    fits = [toxicity.train(docs(spark, order), labels, F.col("bad").cast("int"), grades=2) for order in (often, often[::-1])]
    assert fits[0].features.tolist() == fits[1].features.tolist() and np.allclose(fits[0].weights, fits[1].weights) and np.allclose(fits[0].thresholds, fits[1].thresholds)
