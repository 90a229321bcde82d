import math
import random
from collections import Counter

import pytest

from narrata.llm.op12_negatives import bracket, far, hard_negatives

ROWS = "vec_id long, embedding array<float>, label int, i long, a string, group int, block int, rank int, slots string"


def plain(rows, every=50, n_pos=5, n_neg=3):
    good = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    order = lambda x: (-x[1], x[0] is None, x[0] or 0)
    out = []
    for a, label, q in good:
        if a is None or a % every:
            continue
        s = [(i, sum(x * y for x, y in zip(q, v)), lab == label) for i, lab, v in good if i != a]
        pos = sorted((x for x in s if x[2]), key=order)[:n_pos]
        for p in pos:
            fit = sorted((x for x in s if not x[2] and 50 * p[1] <= 100 * x[1] <= 95 * p[1]), key=order)[:n_neg]
            out += [(a, p[0], r + 1, x[0], p[1], x[1]) for r, x in enumerate(fit)]
    return out


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows: spark.createDataFrame([(i, v, lab, 1, "x", 2, 3, 4, "s") for i, v, lab in rows], ROWS)


def vectors(n, dim, seed, labels=10):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.3) for _ in range(dim)] for _ in range(6)]
    eighth = lambda x: round(x * 64) / 64  # noqa: E731  exact as a float
    return [(i, [eighth(c + r.gauss(0, 0.15)) for c in centres[i % 6]], r.randrange(labels)) for i in range(n)]


def test_plain_version(make):
    rows = vectors(400, 8, 1)
    got = hard_negatives(make(rows), every=20, ring_rows=16, group_rows=8)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = plain(rows, every=20)
    assert Counter(map(tuple, got.collect())) == Counter(expected) and len(expected) > 100


def test_one_label_holds_most_rows_and_ties(make):
    rows = [(i, v, lab if i % 3 == 0 else 2) for i, v, lab in vectors(240, 3, 2)]
    rows += [(1000 + i, [0.5, 0.25, 0.0], i % 2) for i in range(60)]
    got = hard_negatives(make(rows), every=25, ring_rows=32, group_rows=16)
    assert Counter(map(tuple, got.collect())) == Counter(plain(rows, every=25))


def test_odd_rows(make):
    rows = vectors(60, 4, 3, 3) + [
        (100, None, 1), (150, [0.1, None, 0.2, 0.0], 1), (200, [float("nan"), 0.0, 0.0, 0.0], 1), (250, [float("inf"), 0.0, 0.0, 0.0], 2), (300, [0.5, 0.5, 0.5, 0.5], None),
        (350, [0.5], 1), (400, [], 1), (None, [0.5, 0.25, 0.25, 0.0], 1), (None, [0.5, 0.25, 0.25, 0.0], 2), (61, [0.5, 0.25, 0.25, 0.0], 1), (61, [0.5, 0.25, 0.25, 0.0], 1),
        (450, [-0.5, -0.25, 0.0, 0.0], 0), (500, [0.0, 0.0, 0.0, 0.0], 9),
    ]
    got = [tuple(r) for r in hard_negatives(make(rows), every=10, ring_rows=8).collect()]
    assert Counter(got) == Counter(plain(rows, every=10))
    twice = Counter(tuple(r) for r in hard_negatives(make(rows + [rows[10]]), every=10).collect() if r.anchor_id == 10)
    assert set(twice.values()) == {2} and set(twice) == {x for x in got if x[0] == 10}


def test_empty_and_lone(make):
    assert hard_negatives(make([])).collect() == []
    assert hard_negatives(make([(1, [1.0, 0.0], 1), (3, [0.5, 0.0], 2)])).collect() == []
    assert hard_negatives(make([(50, [1.0, 0.0], 1)])).collect() == []


def test_brackets_hold():
    import numpy as np

    r = np.random.default_rng(0)
    q, x, p = r.normal(size=(20, 6)), r.normal(size=(300, 6)), r.normal(size=(4, 6))
    lift = (x**2).sum(1).max()
    up = lambda v, last: np.column_stack([v, last])
    xa, qa, pa = up(x, np.sqrt(lift - (x**2).sum(1))), up(q, np.zeros(20)), up(p, np.zeros(4))
    dx, dq = far(xa, pa), far(qa, pa)
    near, away = np.abs(dq[:, None] - dx[None]).max(2), (dq[:, None] + dx[None]).min(2)
    upper, lower = bracket(near, away, (q**2).sum(1)[:, None], lift)
    s = q @ x.T
    assert (upper >= s).all() and (lower <= s).all()
