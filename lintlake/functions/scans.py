"""Prefix scans over the chunks of long files.

What a chunk does to a running state is put into a small summary. Summaries of neighbours
compose, so the state before every chunk follows from a tree of two levels: chunks are
composed in groups, the groups of a file are run through in order, and each group hands the
state on to its chunks. Only summaries are shuffled, and no group holds more than
``2 ** GROUP_BITS`` chunks; the top level has one row per group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import folds

GROUP_BITS = 11


def states_before(
    summaries: DataFrame,
    initial: str,
    combine: Callable[[str, str], str],
    apply: Callable[[str, str], str],
    backwards: bool = False,
) -> DataFrame:
    """``(file, chunk, state)`` from ``(file, chunk, summary)``: the state each chunk starts with.

    ``combine(first, second)`` is the summary of two neighbours and ``apply(state, summary)`` the
    state behind a chunk, both as SQL text. Backwards, the state comes from the chunks behind.
    """
    order = "b.chunk - a.chunk" if backwards else "a.chunk - b.chunk"
    ordered = f"array_sort(collect_list(struct(chunk, summary)), (a, b) -> {order})"
    groups = summaries.groupBy("file", F.expr(f"shiftright(chunk, {GROUP_BITS})").alias("node")).agg(
        F.expr(ordered).alias("children")
    )
    whole = folds.let(
        "c",
        "children",
        f"aggregate(slice(c, 2, size(c)), c[0].summary, (one, next) -> {combine('one', 'next.summary')})",
    )
    top = groups.selectExpr("file", "node AS chunk", f"{whole} AS summary")
    top = top.groupBy("file").agg(F.expr(ordered).alias("children"))
    entered = top.selectExpr("file", f"inline({_running(initial, apply)})").withColumnRenamed("chunk", "node")
    return groups.join(entered, ["file", "node"]).selectExpr("file", f"inline({_running('state', apply)})")


def _running(initial: str, apply) -> str:
    """``(chunk, state)`` of every child, the state being the one before it."""
    empty = f"slice(transform(children, c -> named_struct('chunk', c.chunk, 'state', {initial})), 1, 0)"
    return (
        f"aggregate(children, named_struct('now', {initial}, 'out', {empty}), (acc, c) -> "
        f"named_struct('now', {apply('acc.now', 'c.summary')}, "
        "'out', array_append(acc.out, named_struct('chunk', c.chunk, 'state', acc.now))), acc -> acc.out)"
    )
