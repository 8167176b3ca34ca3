"""Hard negatives beside brute force, and the threshold algorithm on its own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, scale=256):
    good = sorted({(i, (l + 1) % 10 if i % 7 == 0 else l, tuple(int(np.floor(scale * c)) for c in x))
                   for i, x, l in rows if i is not None and l is not None and x is not None
                   and all(c is not None and np.isfinite(c) for c in x)})
    width = max(len(x) for *_, x in good)
    good = [(i, l, x + (0,) * (width - len(x))) for i, l, x in good]
    out = []
    for i, label, x in good:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j, l) for j, l, y in good if j != i)
        for s, j, _ in [r for r in scored if r[2] == label][:5]:
            p = -s
            hard = [(-t, k) for t, k, l in scored if l != label and 50 * p <= -100 * t <= 95 * p][:3]
            out += [(i, j, rank, k, p, t) for rank, (t, k) in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit(1), "rank": F.lit("x"), "v": F.lit(2)})
    return sorted(map(tuple, negatives.mine_table(frame.repartition(3)).collect()))


@pytest.mark.parametrize("seed, scale", [(1, 0.1), (2, 3.0), (3, 0.004)])
def test_equals_brute_force(spark, monkeypatch, seed, scale):
    """Small blocks, so that every label is several; few different values, so that ties abound."""
    monkeypatch.setattr(negatives, "CELLS", 64 * 8)
    monkeypatch.setattr(negatives, "ANCHORS_IN_BLOCK", 2)
    monkeypatch.setattr(negatives, "FIRST", 2)
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(3, 8))
    rows = [(int(k), (scale * (base[k % 3] + rng.normal(scale=0.6, size=8))).tolist(), int(rng.integers(0, 3)))
            for k in range(400)]
    found = mined(spark, rows)
    assert found == brute(rows) and len(found) > 40


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (50, None, 1), (100, [None, 1.0], 1), (150, [nan, 1.0], 1),
            (200, [inf, 1.0], 1), (None, [1.0, 1.0], 1), (250, [1.0, 1.0], None), (300, [], 2), (301, [2.0], 2),
            (1, [1.0, 2.0, 3.0], 2), (2, [1.0, 1.9], 2), (3, [0.5, 1.5], 3), (4, [0.9, 1.7], 4), (5, [0.9, 1.7], 4),
            (6, [-1.0, -2.0], 2), (8, [1.0, 1.9], 2)]
    found = mined(spark, rows)
    assert found == brute(rows)
    assert 0 in {r[0] for r in found} <= {0, 300}
    assert mined(spark, rows[2:8]) == []
    assert negatives.mine_table(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_label_and_large_values(spark):
    assert mined(spark, [(k, [1.0, float(k)], 1) for k in range(1, 60) if k % 7]) == []
    # Scores beyond what a double holds exactly.
    rows = [(k, [1e5 * (k % 9) + k, 1e5 + 1], k % 2) for k in range(1, 120)]
    assert mined(spark, rows) == brute(rows)


def test_lists_are_read_no_further_than_needed():
    """One row far ahead: the threshold falls below it after the first step."""
    values = np.zeros((5000, 4), np.int64)
    values[:, 0] = np.arange(5000) % 50
    values[17] = 1000
    lists = negatives.Lists(np.arange(5000), values)
    best, scored = negatives.Best(negatives.LEAST, 2 ** 63 - 1, 1), []
    for new, scores, bound in negatives.steps(lists, np.array([1, 1, 1, 1])):
        best.offer(scores, lists.ids[new])
        scored.append(len(new))
        if bound is not None and bound < best.wants():
            break
    assert best.ids.tolist() == [17] and sum(scored) < 500


def test_threshold_bounds_what_is_left():
    rng = np.random.default_rng(4)
    values = rng.integers(-50, 50, (700, 6))
    lists = negatives.Lists(np.arange(700), values)
    for anchor in (rng.integers(-9, 9, 6), np.zeros(6, np.int64), np.array([0, 0, 5, 0, -3, 0])):
        met = np.zeros(700, bool)
        for new, scores, bound in negatives.steps(lists, anchor):
            assert not met[new].any() and (scores == values[new] @ anchor).all()
            met[new] = True
            assert bound is None or (values[~met] @ anchor <= bound).all()
        assert met.all()


def test_a_window_keeps_ties_to_the_smaller_id():
    best = negatives.Best(5, 10, 3)
    best.offer(np.array([11, 10, 4, 7]), np.array([1, 9, 2, 8]))
    assert best.wants() == 5
    best.offer(np.array([7, 7]), np.array([3, 30]))
    assert list(zip(best.scores, best.ids)) == [(10, 9), (7, 3), (7, 8)] and best.wants() == 7
