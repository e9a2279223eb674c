import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecare.llm import hard_negatives as module
from tablecare.llm.hard_negatives import Heaps, hard_negatives, strassen

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, k=5, m=3):
    """Rows (id, label, vector) that take part; the result with anchors of even id / 4."""
    rows = [(i, label, [int(np.floor(x * 256)) for x in v]) for i, label, v in rows]
    out = []

    def score(a, b):
        return sum(x * y for x, y in zip(a[2], b[2], strict=True))

    def first(some, a):
        return sorted(some, key=lambda r: (-score(a, r), r[0] is None, r[0] or 0))

    for n, a in enumerate(rows):
        if a[0] is None or a[0] % 4:
            continue
        others = [r for at, r in enumerate(rows) if at != n and len(r[2]) == len(a[2])]
        for p in first([r for r in others if r[1] == a[1]], a)[:k]:
            ps = score(a, p)
            far = [r for r in others if r[1] != a[1] and 50 * ps <= 100 * score(a, r) <= 95 * ps]
            for rank, r in enumerate(first(far, a)[:m], 1):
                out.append((a[0], p[0], rank, r[0], ps, score(a, r)))
    return sorted(out, key=str)


def mined(spark, rows, **options):
    table = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("x")).withColumn("score", F.lit(None).cast("int"))
    return sorted((tuple(r) for r in hard_negatives(table, F.col("vec_id") % 4 == 0, **options).collect()), key=str)


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 3), (33, 65, 40), (64, 64, 64), (70, 130, 257), (1, 300, 2), (0, 4, 5), (4, 0, 5)])
def test_products_are_exact(shape):
    draw = np.random.default_rng(1)
    m, k, n = shape
    for limit in (300, 2**26):
        a, b = draw.integers(-limit, limit, (m, k)), draw.integers(-limit, limit, (k, n))
        want = a.astype(object) @ b.astype(object) if k else np.zeros((m, n), int)
        assert (strassen(a, b, leaf=4) == want).all() and (strassen(a, b) == want).all()


def test_heaps_take_tiles_in_any_order():
    draw = np.random.default_rng(3)
    scores = draw.integers(-4, 4, (6, 50))
    for cuts in ([0, 50], [0, 3, 4, 30, 50]):
        heaps, parts = Heaps(6, 5), list(zip(cuts[:-1], cuts[1:], strict=True))
        for a, b in reversed(parts):
            heaps.merge(0, scores[:, a:b].copy(), np.arange(a, b))
        for row in range(6):
            want = sorted((-s, i) for i, s in enumerate(scores[row]))[:5]
            assert list(zip((-heaps.score[row]).tolist(), heaps.id[row].tolist(), strict=True)) == want


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(module, "TILE_ROWS", 16)
    monkeypatch.setattr(module, "ANCHOR_ROWS", 4)
    monkeypatch.setattr(module, "BLOCK_BYTES", 2048)  # many blocks, more than one wave
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(3, 6))
    rows = []
    for i in range(160):
        label = int(draw.integers(0, 3)) if i % 3 else 1  # one label holds a third of all rows
        rows.append((i, label, (centres[label % 2] + draw.normal(size=6) * 0.6).round(2).tolist()))
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 100


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [
        (0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (0, 2, [0.9, 0.1]), (4, 1, [1.0, 0.5]), (3, 2, [0.7, 0.0]), (3, 2, [0.7, 0.0]),
        (None, 2, [0.7, 0.0]), (None, 1, [0.8, 0.0]), (8, 3, [0.0, 0.0]), (9, 1, [-1.0, -1.0]), (12, 5, []), (13, 5, []), (14, 6, []),
        (16, 1, [1.0, 0.0, 0.0]), (17, 2, [1.0, 0.0, 0.0]), (20, -3, [0.5, 0.5]),
    ]
    bad = [
        (1, None, [1.0, 0.0]), (2, 1, None), (5, 1, [None, 1.0]), (6, 1, [nan, 0.0]), (7, 1, [inf, 0.0]), (10, 1, [1e300, 0.0]),
        (None, None, None), (24, 1, [-inf, 0.0]),
    ]
    rows = good + bad
    random.Random(2).shuffle(rows)
    assert mined(spark, rows) == brute(good)
    assert mined(spark, bad) == mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0])]) == []


def test_options(spark):
    rows = [(i, i % 2, [1.0 - i / 64, i / 64]) for i in range(24)]
    got = mined(spark, rows, positives=1, negatives=2, low_percent=10, high_percent=100)
    assert {r[0] for r in got} == {0, 4, 8, 12, 16, 20} and all(r[2] <= 2 and 10 * r[4] <= 100 * r[5] <= 100 * r[4] for r in got)
