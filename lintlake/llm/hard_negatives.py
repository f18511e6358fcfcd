"""Hard negatives of anchors: rows of other labels that score just below a positive.

Vectors become whole numbers, floor(256 c); a score is their exact inner product. An anchor's positives
are its best rows of the same label; for each of them the best rows of other labels are asked for whose score
lies between half and 95% of the positive's.

Rotated one-bit codes decide what is scored (``one_bit_codes``): codes and their alignments are made
once and stored in a table. All anchors meet all rows in cells, a block of rows by a block of anchors,
both bounded in size. In a cell, popcounts give every row an interval its score lies in. The rows with the best
estimates are scored first; their fifth best score (positives), or third best inside a band (negatives), is a
floor. Level by level those rows are dropped whose interval lies below the floor or above the band. What
survives is scored as whole numbers, so results are exact; a cell sends its best few rows on, and the best of
all cells are the result. Two passes: positives, whose scores make the bands, then negatives.

Equal rows (id, label and vector) are one row with a count before anything is shuffled to cells, so
copies, however many, cost one; the count is taken into account where the best rows are counted and
results repeated. Blocks are dealt by a hash of the row, so no label or vector is a hot key.

Rows with a null label, a null vector or a null or non-finite entry take no part. Shorter vectors
are filled up with zeros. Rows with a null id come after all others in ties and are no anchors; repeated ids
with other labels or vectors are rows of their own. Scores beyond a long count as the nearest long. Columns
other than the three read are ignored. Positives below zero have no negatives. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .common import known_to_workers, written
from .one_bit_codes import LEVELS, Codes, OneBitCoder, Queries

POSITIVES, NEGATIVES = 5, 3
EVERY = 50
ROWS_A_BLOCK, ANCHORS_A_BLOCK = 8192, 16384
LOW, HIGH = 50, 95
#: Before this level intervals are too wide to drop a row; rows scored first there; so few are scored at once.
FIRST, SEEDS, FEW = 2, 16, 48
_NO_ID = np.iinfo(np.int64).max


def relabelled(table: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """(the rows that take part, one for each distinct id, label and vector, with ``copies``; the width)."""
    rows, width = vectors.integer_vectors(table.where("label IS NOT NULL"), ("vec_id", "label"), vector)
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    counted = rows.withColumn("label", moved.cast("long")).groupBy("vec_id", "label", "x").agg(F.count(F.lit(1)).alias("copies"))
    return counted.withColumn("key", F.xxhash64("vec_id", "label", "x")), width


def with_codes(rows: DataFrame, width: int) -> DataFrame:
    """rows with ``words``, ``gains``, ``rests`` (level after level) and ``length``."""
    known_to_workers(rows.sparkSession)
    at = rows.columns.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = OneBitCoder(width)
        for batch in batches:
            codes = coder.encode(vectors.matrix(batch.column(at), width))
            words = codes.words.transpose(1, 0, 2).reshape(batch.num_rows, -1).view(np.int64)
            new = [vectors.lists(words), vectors.lists(codes.gains.T), vectors.lists(codes.rests.T), pa.array(codes.lengths)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "words", "gains", "rests", "length"])

    coded = "words array<long>, gains array<double>, rests array<double>, length double"
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, {coded}")


class _Block:
    """The rows of a cell, sorted by label."""

    def __init__(self, table: pa.Table, width: int):
        self.coder = OneBitCoder(width)
        labels = table["label"].to_numpy()
        order = np.argsort(labels, kind="stable")
        self.labels, self.keys = labels[order], table["key"].to_numpy()[order]
        ids = table["vec_id"].combine_chunks().fill_null(_NO_ID)
        self.ids, self.copies = ids.to_numpy(zero_copy_only=False)[order], table["copies"].to_numpy()[order]
        self.x = vectors.matrix(table["x"], width)[order]
        words = vectors.matrix(table["words"], LEVELS * self.coder.padded // 64)[order].view(np.uint64)
        self.codes = Codes(
            np.ascontiguousarray(words.reshape(len(order), LEVELS, -1).transpose(1, 0, 2)),
            np.ascontiguousarray(vectors.matrix(table["gains"], LEVELS)[order].T),
            np.ascontiguousarray(vectors.matrix(table["rests"], LEVELS)[order].T),
            table["length"].to_numpy()[order],
        )

    def span(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))

    def best(self, rows: np.ndarray, scores: np.ndarray, copies: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the best so many, by score and then id, copies as rows of their own."""
        order = np.lexsort((self.ids[rows], -scores))[:many]
        repeated = np.repeat(order, np.minimum(copies[order], many))[:many]
        return rows[repeated], scores[repeated]


def _narrowed(block: _Block, queries: Queries, n: int, rows: np.ndarray, limits) -> np.ndarray:
    """The rows whose score with query n may lie inside ``limits(rows, estimates)``, which is asked once."""
    estimate = error = low = high = 0.0
    for level in range(LEVELS):
        if len(rows) <= FEW:
            break
        estimate, error, with_code = block.coder.add(block.codes, queries, n, level, rows, estimate, error)
        if level == FIRST:
            low, high = limits(rows, estimate)
        if level >= FIRST:
            reach = block.coder.reach(block.codes, queries, n, level, rows, error, with_code)
            kept = np.flatnonzero((estimate + reach >= low) & (estimate - reach <= high))
            rows, estimate, error = rows[kept], estimate[kept], error[kept]
    return rows


def positives_in(
    block: _Block, queries: Queries, n: int, key: int, label: int, x: np.ndarray, many: int = POSITIVES
) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the block's best rows of the anchor's label, itself left out once."""
    start, end = block.span(label)
    copies = block.copies[start:end] - (block.keys[start:end] == key)
    rows = np.arange(start, end)[copies > 0]

    def limits(rows, estimate):
        seeds = rows[np.argpartition(estimate, -SEEDS)[-SEEDS:]]
        return np.sort(vectors.products(block.x[seeds], x))[-many], np.inf

    rows = _narrowed(block, queries, n, rows, limits)
    return block.best(rows, vectors.products(block.x[rows], x), block.copies[rows] - (block.keys[rows] == key), many)


def negatives_in(
    block: _Block, queries: Queries, n: int, label: int, x: np.ndarray, scores: list[int], many: int = NEGATIVES
) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each positive score (the score, rows, scores) of the block's best rows of other labels in its band."""
    start, end = block.span(label)
    rows = np.concatenate([np.arange(start), np.arange(end, len(block.keys))])
    bands = [(s, -(-LOW * s // 100), HIGH * s // 100) for s in scores]
    least = min(low for _, low, _ in bands)

    def limits(rows, estimate):
        near = np.flatnonzero(estimate >= least)
        near = near[np.argsort(estimate[near])]
        ends = np.searchsorted(estimate[near], [high for _, _, high in bands])
        seeds = rows[near[sorted({k for end in ends for k in range(max(0, end - SEEDS), end)})]]
        exact, floor = vectors.products(block.x[seeds], x), np.inf
        for _, low, high in bands:
            inside = exact[(exact >= low) & (exact <= high)]
            floor = min(floor, np.sort(inside)[-many] if len(inside) >= many else low)
        return floor, max(high for _, _, high in bands)

    rows = _narrowed(block, queries, n, rows, limits)
    exact = vectors.products(block.x[rows], x)
    found = []
    for score, low, high in bands:
        inside = (exact >= low) & (exact <= high)
        found.append((score, *block.best(rows[inside], exact[inside], block.copies[rows[inside]], many)))
    return found


def _cells(rows: DataFrame, anchors: DataFrame, rows_a_block: int, anchors_a_block: int):
    """(rows, anchors), both dealt to the cells they meet in, ``r`` and ``q``."""
    many_rows = max(1, -(-rows.count() // rows_a_block))
    many_anchors = max(1, -(-anchors.count() // anchors_a_block))
    r = F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(many_rows))
    q = F.pmod(F.xxhash64(F.lit(2), "key"), F.lit(many_anchors))
    rows = rows.withColumn("r", r).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many_anchors - 1).cast("long"))))
    anchors = anchors.withColumn("q", q).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many_rows - 1).cast("long"))))
    return rows, anchors


def _in_cells(rows: DataFrame, anchors: DataFrame, run, schema: str, blocks: tuple[int, int]) -> DataFrame:
    dealt, asked = _cells(rows, anchors.toDF(*anchors.columns), *blocks)
    return dealt.groupBy("r", "q").cogroup(asked.groupBy("r", "q")).applyInArrow(run, schema)


def _found(parts: dict[str, list], ids: str) -> pa.Table:
    """Arrow columns of what a cell found; the largest long stands for a null id."""
    columns = {name: pa.array(np.concatenate(p) if p else np.zeros(0, np.int64), pa.int64()) for name, p in parts.items()}
    listed = columns[ids].to_numpy()
    columns[ids] = pa.array(listed, pa.int64(), mask=listed == _NO_ID)
    return pa.table(columns)


def _first(df: DataFrame, by: list[str], score: str, name: str, many: int) -> DataFrame:
    """The first so many of each group, by falling score and then id; ``rank`` from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc_nulls_last(name))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= many)


def mine(table: DataFrame, every: int = EVERY, vector: str = "embedding", blocks: tuple[int, int] = (ROWS_A_BLOCK, ANCHORS_A_BLOCK)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and the two scores, for ids divisible by ``every``."""
    counted, width = relabelled(table, vector)
    rows = written(with_codes(counted, width), "mining-rows")
    anchors = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("key", "vec_id", "label", "copies", "x")

    def positives(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = {"key": [], "positive_id": [], "positive_score": []}
        if left.num_rows and right.num_rows:
            block = _Block(left, width)
            asked = vectors.matrix(right["x"], width)
            queries = block.coder.queries(asked)
            for n, (key, label, x) in enumerate(zip(right["key"].to_numpy(), right["label"].to_numpy(), asked)):
                found, scores = positives_in(block, queries, n, key, label, x)
                parts["key"].append(np.full(len(found), key))
                parts["positive_id"].append(block.ids[found])
                parts["positive_score"].append(scores)
        return _found(parts, "positive_id")

    def negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = {"key": [], "positive_score": [], "negative_id": [], "negative_score": []}
        if left.num_rows and right.num_rows:
            block = _Block(left, width)
            asked = vectors.matrix(right["x"], width)
            queries, listed = block.coder.queries(asked), zip(right["key"].to_numpy(), right["label"].to_numpy(), right["bands"].to_pylist())
            for n, (key, label, bands) in enumerate(listed):
                for score, found, scores in negatives_in(block, queries, n, label, asked[n], bands):
                    parts["key"].append(np.full(len(found), key))
                    parts["positive_score"].append(np.full(len(found), score))
                    parts["negative_id"].append(block.ids[found])
                    parts["negative_score"].append(scores)
        return _found(parts, "negative_id")

    in_cells = _in_cells(rows, anchors, positives, "key long, positive_id long, positive_score long", blocks)
    chosen = written(_first(in_cells, ["key"], "positive_score", "positive_id", POSITIVES).drop("rank"), "mining-positives")
    bands = chosen.where("positive_score >= 0").groupBy("key").agg(F.collect_set("positive_score").alias("bands"))
    asking = anchors.join(bands, "key")
    in_cells = _in_cells(rows, asking, negatives, "key long, positive_score long, negative_id long, negative_score long", blocks)
    best = _first(in_cells, ["key", "positive_score"], "negative_score", "negative_id", NEGATIVES)
    named = anchors.select("key", F.col("vec_id").alias("anchor_id"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    found = best.join(chosen, ["key", "positive_score"]).join(named, "key")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
