"""Hard negatives against plain loops over rows."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from tidewell.llm import hard_negatives
from tidewell.operators import vectors

COLUMNS = "vec_id long, embedding array<float>, label int, id long, score double, copies string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 0.5, "x") for r in rows], COLUMNS).repartition(3)


def expected(rows, positives=5, negatives=3, every=50):
    """The result as a multiset of rows, by comparing every anchor with every row."""
    own = []
    for at, (i, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        own.append((at, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(float(np.float32(x)) * 256) for x in vector]))
    order = lambda r: (-r[1], r[2] is None, r[2] or 0)
    out = Counter()
    for at, i, label, vector in own:
        if i is None or i % every:
            continue
        scored = [(l == label, sum(a * b for a, b in zip(vector, v, strict=True)), j) for k, j, l, v in own if k != at and len(v) == len(vector)]
        for _, p, j in sorted((s for s in scored if s[0]), key=order)[:positives]:
            window = sorted((s for s in scored if not s[0] and 50 * p <= 100 * s[1] <= 95 * p), key=order)[:negatives]
            out.update((i, j, rank, n, p, s) for rank, (_, s, n) in enumerate(window, 1))
    return out


def got(found):
    assert found.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    return Counter(tuple(r) for r in found.collect())


def unit(rng, n, centre):
    v = [rng.gauss(c, 0.35) for c in centre]
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v]


@pytest.mark.parametrize("numbers", [60, 1 << 19])
def test_against_all_pairs(spark, monkeypatch, numbers):
    """Blocks and stripes of any size; coarse vectors give many ties, and some rows repeat."""
    monkeypatch.setattr(vectors, "QUERY_NUMBERS", numbers)
    monkeypatch.setattr(vectors, "ROW_NUMBERS", 8 * numbers)
    rng = random.Random(2)
    centre = [1, 1, 0, 0, 1, 0, 0, 1]
    rows = [(i, unit(rng, 8, centre), rng.randrange(4)) for i in range(400)]
    rows += [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(8)], 1) for i in range(400, 520)]
    rows += [(None, unit(rng, 8, centre), k % 3) for k in range(20)]
    rows += [rows[50], rows[50], rows[100], rows[7], rows[7], rows[-1]]  # anchors and others again
    rows += [(150, unit(rng, 8, centre), 2), (150, rows[150][1], 3), (-50, unit(rng, 8, centre), 0), (-7, unit(rng, 8, centre), 9)]
    found = got(hard_negatives.mine(frame(spark, rows)))
    assert found == expected(rows) and sum(found.values()) > 100


def test_common_vector(spark):
    """A third of all rows share one vector and label, and tie in every score."""
    rng = random.Random(5)
    rows = [(i, [0.5] * 4 if i % 3 == 0 else [rng.random() for _ in range(4)], 1 if i % 3 == 0 else rng.randrange(3)) for i in range(600)]
    assert got(hard_negatives.mine(frame(spark, rows))) == expected(rows)


def test_rows_that_take_no_part(spark):
    rng = random.Random(6)
    rows = [(i, [rng.random() for _ in range(4)], i % 3) for i in range(120)]
    rows += [(150, None, 1), (200, [0.1, None, 0.2, 0.3], 1), (250, [0.1, float("nan"), 0.2, 0.3], 1), (300, [0.1, float("inf"), 0.2, 0.3], 1), (350, [0.5] * 4, None)]
    rows += [(400, [0.5, 0.5], 1), (401, [0.4, 0.5], 1), (402, [0.3, 0.5], 2), (450, [], 0), (451, [], 0), (500, [0.0] * 4, 2)]
    found = got(hard_negatives.mine(frame(spark, rows)))
    assert found == expected(rows) and any(r[0] == 400 for r in found)
    assert not any(x in (150, 200, 250, 300, 350) for r in found for x in (r[0], r[1], r[3]))


def test_few_positives_and_empty(spark):
    rows = [(0, [1.0, 0.0], 6), (50, [1.0, 0.5], 6), (1, [0.7, 0.1], 2), (2, [0.6, 0.1], 2), (100, [1.0, 1.0], 8)]
    assert got(hard_negatives.mine(frame(spark, rows))) == expected(rows)
    assert not got(hard_negatives.mine(frame(spark, rows).limit(0)))
    negative = [(50, [1.0, 1.0], 1), (51, [-1.0, -0.5], 1), (52, [-0.9, 0.0], 2), (53, [-0.6, 0.0], 2), (100, [0.0, 0.0], 1)]
    assert got(hard_negatives.mine(frame(spark, negative))) == expected(negative)


def test_large_numbers_stay_exact(spark):
    """Products beyond 53 bits and beyond 64, which become the nearest 64-bit number."""
    rng = random.Random(8)
    left, right = (np.array([[rng.randrange(-(1 << bits), 1 << bits) for _ in range(3)] for _ in range(20)]) for bits in (30, 28))
    for scale in (1, 1 << 30):
        whole = [[min(max(sum(int(a) * int(b) for a, b in zip(x, y, strict=True)), -(1 << 63)), (1 << 63) - 1) for y in (right * scale).tolist()] for x in left.tolist()]
        assert vectors.products(left, right * scale).tolist() == whole
    big = [(i, [rng.uniform(1e5, 1e6) for _ in range(3)], i % 2) for i in range(60)]
    assert got(hard_negatives.mine(frame(spark, big))) == expected(big)
    assert sum(got(hard_negatives.mine(frame(spark, [(i, [3e38, 1e30], i % 2) for i in range(60)]))).values()) == 0
