"""Hard negatives against brute force with Python's integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulewright.llm import hard_negatives
from rulewright.llm.hard_negatives import best, strassen

SCHEMA = "vec_id long, embedding array<float>, label int, row long, anchor int, rank int, side string, i int, j int, score long"


def brute(rows, positives=5, negatives=3, low=50, high=95):
    """rows: (id, vector, label); sorted results."""
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab, n) for n, (i, v, lab) in enumerate(rows)
          if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in ok:
        if a[0] % 50:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a[1], b[1])), b[0], b[3], b[2]) for b in ok if b[3] != a[3])
        for p in [s for s in scores if s[3] == a[2]][:positives]:
            fit = [s for s in scores if s[3] != a[2] and low * -p[0] <= 100 * -s[0] <= high * -p[0]]
            out += [(a[0], p[1], rank, s[1], -p[0], -s[0]) for rank, s in enumerate(fit[:negatives], 1)]
    return sorted(out)


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, *[None] * 7) for r in rows], SCHEMA).repartition(7)
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 50 == 0, **more).collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    # sixteenths and few dimensions make many ties
    rows = [(i, [r.randrange(-2, 9) / 16 for _ in range(6)], r.randrange(4)) for i in range(400)]
    same = [0.25] * 6
    rows += [(1000 + i, same, i % 2) for i in range(300)]  # a hot vector
    rows += [(50, same, 1)] * 3 + [(2000, same, 0)] * 2  # repeated rows, anchors among them
    return rows + [(2050, None, 1), (2100, same, None), (2150, [0.5, None], 1), (2200, [float("nan")], 1), (2250, [float("inf")] * 6, 1),
                   (None, same, 1), (2300, [], 1), (2350, [0.5], 2), (2400, [-0.5] * 6, 3), (2450, [1.0] * 6, 99)]


def test_against_brute_force(spark, rows):
    got = found(spark, rows)
    assert got == brute(rows) and len(got) > 100


def test_blocks_do_not_matter(spark, rows, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 5)
    monkeypatch.setattr(hard_negatives, "CANDIDATE_ROWS", 90)
    assert found(spark, rows) == brute(rows)


def test_other_parameters(spark, rows):
    assert found(spark, rows, positives=2, negatives=7, window=(10, 100)) == brute(rows, 2, 7, 10, 100)


def test_large_components_are_exact(spark):
    rows = [(0, [2.0 ** 20, 2.0 ** 20], 0), (1, [2.0 ** 21, 1.0], 0), (2, [2.0 ** 20, 1.0], 1), (3, [2.0 ** 40], 1), (4, [-(2.0 ** 40)], 1)]
    assert found(spark, rows) == brute(rows) != []


def test_small_tables(spark):
    assert found(spark, []) == [] == found(spark, [(0, [1.0], 1)]) == found(spark, [(1, [1.0], 1), (2, [0.6], 2)])


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 17, 50), (64, 64, 64), (130, 64, 77), (100, 3, 100), (40, 0, 9)])
def test_strassen(shape):
    r = np.random.default_rng(1)
    m, k, n = shape
    a, b = r.integers(-(1 << 27), 1 << 27, (m, k)), r.integers(-(1 << 27), 1 << 27, (k, n))
    assert (strassen(a, b) == a @ b).all()
    big = strassen(a.astype(object) * (1 << 40), b.astype(object))
    assert (big == (a.astype(object) * (1 << 40)) @ b.astype(object)).all()


def test_heap_ties_go_to_the_first_column():
    scores = np.array([[3, 5, 5, 1], [0, 0, 0, 0]])
    got = best(scores, np.array([[True, True, True, True], [False, True, False, True]]), 3)
    assert [(a.tolist(), c.tolist()) for a, c in got] == [([0, 1], [1, 1]), ([0, 1], [2, 3]), ([0], [0])]
