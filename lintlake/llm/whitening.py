"""Whitening of embeddings by a covariance weighted by multiplicity.

Rows with equal integer vectors x = floor(256 c) are one distinct vector with a count. Sums and the
covariance are taken over the distinct vectors, each with its weight (``one``: 1, ``count``: its
rows): every task multiplies its own centred vectors as one matrix product and sends one matrix;
Spark adds the matrices up. Only the sums and the covariance, whose size is the vectors' width, come to
the driver, which finds the eigenvectors. Each distinct vector is whitened once, then the rows join
what was found for theirs. A vector that more than ``HOT_SHARE`` of all rows have is dealt over several
join keys; there are at most 1 / HOT_SHARE such vectors, so their list may be broadcast.

Rows whose vector is null or holds null or non-finite entries are dropped. Shorter vectors are filled
up with zeros; empty ones are all zeros. Null and repeated ids are rows like any other; repeated rows are
returned as often as they come. Columns other than id and vector are not read. Components without
variance (below 1e-12 of the first) are not returned, so a table with fewer than two distinct vectors gives
no rows, as an empty one does. ``deviation`` is null where it does not fit a long. Of equal
eigenvalues any basis may be returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import known_to_workers, written

COMPONENTS = 4
HOT_SHARE = 1 / 256
LEAST_VARIANCE = 1e-12
KEYS = ("__key1", "__key2")


@dataclass
class Fit:
    """What was fitted: weight in all, sums by dimension, components by falling eigenvalue."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / max(self.n, 1) for s in self.sums], np.float64)


def _keyed(df: DataFrame) -> DataFrame:
    """df with 128 bits of hash that stand for x in joins."""
    return df.withColumns({KEYS[0]: F.xxhash64("x"), KEYS[1]: F.xxhash64(F.lit(1), F.reverse("x"))})


def _exact_sum(rows: np.ndarray, weights: np.ndarray) -> list[int]:
    most = max(abs(int(rows.max())), abs(int(rows.min()))) * int(weights.sum())
    if most < 2**62:
        return [int(v) for v in weights @ rows]
    return [int(v) for v in weights.astype(object) @ rows.astype(object)]


def _sums(distinct: DataFrame, width: int) -> tuple[int, list[int]]:
    """(weight in all, weighted sum of every dimension), exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (width + 1)
        for batch in batches:
            if batch.num_rows:
                rows, weights = vectors.matrix(batch.column(0), width), batch.column(1).to_numpy()
                own = [int(weights.sum()), *_exact_sum(rows, weights)]
                total = [a + b for a, b in zip(total, own)]
        places = pa.array(range(-1, width), pa.int32())
        yield pa.RecordBatch.from_arrays([places, pa.array(list(map(Decimal, total)), pa.decimal128(38, 0))], names=["place", "total"])

    parts = distinct.select("x", "weight").mapInArrow(run, "place int, total decimal(38,0)")
    found = {r.place: int(r.total) for r in parts.groupBy("place").agg(F.sum("total").alias("total")).collect()}
    return found.get(-1, 0), [found.get(d, 0) for d in range(width)]


def _covariance(distinct: DataFrame, mean: np.ndarray, n: int) -> np.ndarray:
    """Centred covariance, divisor n: a matrix from every task, added up by Spark."""
    width = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                centred = vectors.matrix(batch.column(0), width) - mean
                total += (centred * batch.column(1).to_numpy()[:, None]).T @ centred
        left, right = np.triu_indices(width)
        cells = [pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), pa.array(total[left, right])]
        yield pa.RecordBatch.from_arrays(cells, names=["i", "j", "total"])

    parts = distinct.select("x", "weight").mapInArrow(run, "i int, j int, total double")
    found = np.zeros((width, width))
    for r in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        found[r.i, r.j] = found[r.j, r.i] = r.total / n
    return found


def fit(distinct: DataFrame, width: int, components: int = COMPONENTS) -> Fit:
    """Fit to distinct vectors (``x``, ``weight``)."""
    known_to_workers(distinct.sparkSession)
    n, sums = _sums(distinct, width)
    fitted = Fit(n, sums, np.zeros((0, width)), np.zeros(0), 0.0)
    if n == 0 or width == 0:
        return fitted
    covariance = _covariance(distinct, fitted.mean, n)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes.T[::-1][:components]
    kept = (values > 0) & (values > LEAST_VARIANCE * values[0])
    return Fit(n, sums, axes[kept], values[kept], float(np.trace(covariance)))


def whitened(distinct: DataFrame, fitted: Fit) -> DataFrame:
    """distinct with ``deviation`` and ``whitened`` (an entry for each component) in place of x."""
    width, mean = len(fitted.sums), fitted.mean
    scaled = fitted.axes / np.sqrt(fitted.variances)[:, None]
    n, sums = fitted.n, np.array(fitted.sums, object)
    squares = sum(s * s for s in fitted.sums)
    small = all(abs(s) < 2**62 for s in fitted.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = vectors.matrix(batch.column(0), width)
            most = max(abs(int(rows.max())), abs(int(rows.min()))) if rows.size else 0
            if small and most * most * width < 2**62 and most * sum(map(abs, fitted.sums)) < 2**62:
                own, cross = (rows * rows).sum(axis=1).tolist(), (rows @ sums.astype(np.int64)).tolist()
            else:
                exact = rows.astype(object)
                own, cross = (exact * exact).sum(axis=1).tolist(), (exact @ sums).tolist()
            deviation = [n * n * a - 2 * n * b + squares for a, b in zip(own, cross)]
            deviation = [d if d < 2**63 else None for d in deviation]
            found = vectors.lists((rows - mean) @ scaled.T)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(deviation, pa.int64()), found], names=[*batch.schema.names[1:], "deviation", "whitened"]
            )

    keyed = _keyed(distinct).select("x", *KEYS, "copies", "weight")
    return keyed.mapInArrow(run, f"{KEYS[0]} long, {KEYS[1]} long, copies long, weight long, deviation long, whitened array<double>")


def identity_error(found: DataFrame, n: int, components: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    if not n or not components:
        return 0.0
    at = [F.col("whitened")[k] for k in range(components)]
    mean = found.agg(*(F.sum(c * F.col("weight")) / n for c in at)).first()
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    entries = found.agg(*(F.sum((at[i] - mean[i]) * (at[j] - mean[j]) * F.col("weight")) / n for i, j in pairs)).first()
    return max(abs(value - (i == j)) for value, (i, j) in zip(entries, pairs))


def whiten(table: DataFrame, components: int = COMPONENTS, weights: str = "one", vector: str = "embedding") -> DataFrame:
    """A row for each usable row of the table (``vec_id``, the vector) and component, from 1."""
    rows, width = vectors.integer_vectors(table, ("vec_id",), vector)
    counted = rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
    distinct = written(counted.withColumn("weight", F.col("copies") if weights == "count" else F.lit(1).cast("long")), "whiten-distinct")
    fitted = fit(distinct, width, components)
    found = written(whitened(distinct, fitted), "whiten-found")
    error = identity_error(found, fitted.n, len(fitted.variances))
    explained = F.array(*(F.lit(float(v / fitted.trace)) for v in fitted.variances)).cast("array<double>")

    total = found.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    fair = max(1, int(total * HOT_SHARE))
    salts = F.ceil(F.col("copies") / fair).cast("int")
    hot = found.where(F.col("copies") > fair).select(*KEYS, salts.alias("salts"))
    dealt = _keyed(rows).select("vec_id", *KEYS).join(F.broadcast(hot), list(KEYS), "left")
    dealt = dealt.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    once = F.when(F.col("copies") > fair, salts).otherwise(1)
    each = found.select(*KEYS, "deviation", "whitened", F.explode(F.sequence(F.lit(0), once - 1)).alias("salt"))
    joined = dealt.join(each, [*KEYS, "salt"]).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return joined.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained[F.col("place")].alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
