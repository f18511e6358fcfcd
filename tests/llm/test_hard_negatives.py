"""Hard negatives against scoring all pairs."""

import math

import numpy as np
import pytest

from lintlake.llm import hard_negatives
from lintlake.llm.one_bit_codes import LEVELS, OneBitCoder

SCHEMA = "vec_id long, embedding array<double>, label int"


def expected(rows, every=50):
    """All result rows by scoring every pair; copies of a row are rows of their own."""
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        kept.append((i, [math.floor(256 * c) for c in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    width = max((len(v) for _, v, _ in kept), default=0)
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    found = []
    for at, (i, v, label) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), math.inf if j is None else j, k, n) for n, (j, w, k) in enumerate(kept)]
        positives = sorted(s for s in scored if s[2] == label and s[3] != at)[:5]
        for p, positive, _, _ in positives:
            inside = sorted(s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p)[:3]
            found += [(i, positive, rank, s[1], -p, -s[0]) for rank, s in enumerate(inside, 1)]
    return [tuple(None if c == math.inf else c for c in r) for r in found]


def check(spark, rows, **settings):
    table = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in hard_negatives.mine(table, **settings).collect()]
    wanted = expected(rows, settings.get("every", 50))
    assert sorted(got, key=str) == sorted(wanted, key=str)
    return got


def clustered(seed, n=400, width=16, spread=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, width))
    labels = rng.integers(0, 10, n)
    return [(i, (centres[k] + spread * rng.normal(size=width) + 0.5).tolist(), int(k)) for i, k in enumerate(labels)]


@pytest.mark.parametrize(("width", "spread"), [(16, 0.6), (64, 0.2), (70, 1.5), (3, 1.0)])
def test_equals_scoring_all_pairs(spark, width, spread):
    assert check(spark, clustered(width, 300, width, spread), every=10, blocks=(64, 16))


def test_ties_copies_and_odd_rows(spark):
    rows = clustered(5, 120, 4)
    rows = [(i, [float(round(c)) for c in v], k % 2) for i, v, k in rows]  # many equal scores
    rows += [(i % 3, rows[0][1], rows[0][2]) for i in range(60)]  # copies, and ids with several vectors
    rows += [(50, rows[50][1], rows[50][2])] * 3 + [(None, rows[1][1], 1), (None, rows[2][1], 0)]
    rows += [(900, None, 1), (950, [1.0], None), (1000, [1.0, None], 1), (1050, [float("nan")], 1), (1100, [float("inf")] * 4, 0)]
    rows += [(1150, [], 0), (1200, [1.0], 1), (-50, [2.0, 1.0], 0)]
    assert check(spark, rows, blocks=(32, 2))


def test_clashing_columns_and_nothing(spark):
    rows = clustered(6, 100, 4)
    plain = spark.createDataFrame(rows, SCHEMA)
    wanted = sorted(tuple(r) for r in hard_negatives.mine(plain).collect())
    extra = plain.selectExpr("*", "'a' AS key", "'b' AS X", "'c' AS copies", "1 AS r", "'d' AS words")
    assert sorted(tuple(r) for r in hard_negatives.mine(extra).collect()) == wanted
    for empty in (plain.limit(0), plain.selectExpr("vec_id", "embedding", "CAST(NULL AS INT) AS label"), plain.where("vec_id = 50")):
        assert hard_negatives.mine(empty).collect() == []


def test_scores_beyond_doubles(spark):
    rows = [(i, [3.0e5 * (1 + (i * k) % 11) + i for k in range(1, 5)], i % 2) for i in range(60)]
    check(spark, rows, every=10)


@pytest.mark.parametrize("width", [5, 64, 100])
def test_bounds_hold_and_narrow(width):
    rng = np.random.default_rng(width)
    rows = rng.integers(-300, 300, (500, width))
    coder = OneBitCoder(width)
    codes = coder.encode(rows)
    asked = rng.integers(-300, 300, (5, width))
    queries, every = coder.queries(asked), np.arange(500)
    for n, x in enumerate(asked):
        exact, estimate, error, reaches = rows @ x, 0.0, 0.0, []
        for level in range(LEVELS):
            estimate, error, with_code = coder.add(codes, queries, n, level, every, estimate, error)
            reach = coder.reach(codes, queries, n, level, every, error, with_code)
            assert (np.abs(estimate - exact) <= reach).all()
            reaches.append(reach.mean())
        assert reaches[-1] < 0.2 * reaches[0]


def test_codes_leave_few_rows_to_score(monkeypatch):
    """The exact products are asked for a small part of the rows only."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    labels = np.repeat(np.arange(10), 200)
    x = np.rint(rng.normal(size=(2000, 64)) * 32).astype(np.int64)
    codes = OneBitCoder(64).encode(x)
    v = hard_negatives.vectors
    block = hard_negatives._Block(
        pa.table(
            {
                "label": labels, "key": np.arange(2000), "vec_id": np.arange(2000), "copies": np.ones(2000, np.int64), "x": v.lists(x),
                "words": v.lists(codes.words.transpose(1, 0, 2).reshape(2000, -1).view(np.int64)),
                "gains": v.lists(codes.gains.T), "rests": v.lists(codes.rests.T), "length": codes.lengths,
            }
        ),
        64,
    )
    scored = []
    plain = v.products
    monkeypatch.setattr(v, "products", lambda rows, other: scored.append(len(rows)) or plain(rows, other))
    for at in range(0, 2000, 100):
        rows, scores = hard_negatives.positives_in(block, block.coder.queries(x[[at]]), 0, at, labels[at], x[at])
        exact = x @ x[at]
        others = sorted((-exact[j], j) for j in range(2000) if labels[j] == labels[at] and j != at)[:5]
        assert list(zip(-scores, rows)) == others
        assert len(scored) and scored.pop() < 80  # of 199
