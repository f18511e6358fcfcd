"""Whitening against a plain covariance over the distinct vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintlake.llm import whitening


def expected(rows, components=4, weights="one"):
    """{vec_id: (deviation, whitened)}, n and explained by plain numpy over the distinct vectors."""
    width = max(len(v) for _, v in rows)
    whole = [(i, tuple(math.floor(256 * c) for c in v) + (0,) * (width - len(v))) for i, v in rows]
    counts = {}
    for _, x in whole:
        counts[x] = counts.get(x, 0) + 1
    distinct = np.array([x for x, c in counts.items() for _ in range(c if weights == "count" else 1)], float)
    n, mean = len(distinct), distinct.mean(axis=0)
    covariance = (distinct - mean).T @ (distinct - mean) / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    sums = distinct.sum(axis=0).astype(int).tolist()
    found = [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums)), (np.array(x) - mean) @ axes / np.sqrt(values)) for i, x in whole]
    return found, n, values / np.trace(covariance)


def check(spark, rows, weights="one"):
    table = spark.createDataFrame([(i, list(map(float, v))) for i, v in rows], "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    wanted, n, explained = expected(rows, weights=weights)
    got = whitening.whiten(table, weights=weights).collect()
    assert len(got) == 4 * len(wanted) and {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    by_component = {k: sorted((r.vec_id, r.deviation, r.whitened) for r in got if r.component == k) for k in range(1, 5)}
    for k, own in by_component.items():
        plain = sorted((i, d, w[k - 1]) for i, d, w in wanted)
        assert [r[:2] for r in own] == [r[:2] for r in plain]
        signs = [np.array([r[2] for r in own]) * s - np.array([r[2] for r in plain]) for s in (1, -1)]
        assert min(np.abs(d).max() for d in signs) < 1e-8
        assert [r.explained for r in got if r.component == k] == pytest.approx([explained[k - 1]] * len(own), rel=1e-9)


def vectors_with_copies(seed, n=300, width=8):
    rng = np.random.default_rng(seed)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, width)) * np.arange(1, width + 1))]
    return rows + [(n + i, rows[0][1]) for i in range(n)] + [(2 * n + i, rows[i % 7][1]) for i in range(50)]


@pytest.mark.parametrize("weights", ["one", "count"])
def test_equals_plain_covariance(spark, weights):
    check(spark, vectors_with_copies(1), weights)


def test_hot_vectors_are_dealt_over_keys(spark, monkeypatch):
    monkeypatch.setattr(whitening, "HOT_SHARE", 1 / 1024)
    check(spark, vectors_with_copies(2))


def test_odd_rows(spark):
    good = vectors_with_copies(3, 60, 5)
    good += [(7, good[0][1]), (7, good[0][1]), (1000, [1.0]), (1001, [])]  # repeated, short and empty
    bad = [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 5), (2003, [float("inf"), 0, 0, 0, 0])]
    schema = "vec_id long, embedding array<float>, deviation string, X string, component int"
    table = spark.createDataFrame([(i, v and list(map(lambda c: c if c is None else float(c), v)), "a", "b", 1) for i, v in good + bad], schema)
    got = whitening.whiten(table).collect()
    clean = [(r.vec_id, r.embedding) for r in table.where("vec_id < 2000").collect()]
    wanted, n, _ = expected(clean)
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 1) == sorted((i, d) for i, d, _ in wanted)
    nameless = table.where("vec_id < 2000").withColumn("vec_id", F.lit(None).cast("long"))
    assert {r.vec_id for r in whitening.whiten(nameless).collect()} == {None}


def test_nothing_to_whiten(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        found = whitening.whiten(spark.createDataFrame(rows, schema))
        assert found.count() == 0
        assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_a_long(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) * 1e7 for _ in range(3)]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    wanted, _, _ = expected(rows, 3)
    got = {(r.vec_id, r.deviation) for r in whitening.whiten(table).collect()}
    assert got == {(i, d if d < 2**63 else None) for i, d, _ in wanted} and any(d is None for _, d in got)
