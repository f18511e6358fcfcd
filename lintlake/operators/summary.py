"""Aggregates over findings: summaries and severity groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules.fixed_values import SEVERITIES
from .context import known_keys
from .diff import diff_review_files
from .review import count_findings, rules_applied

COUNTS = ("total_findings", *SEVERITIES)


def _finding_counts():
    return [
        F.count("severity").alias("total_findings"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES],
    ]


def summarize(
    files: DataFrame, findings: DataFrame | None = None, by: Sequence[str] = (), **options
) -> DataFrame:
    """Finding counts, files reviewed and rules applied, for all files or per ``by``.

    Files without findings count as reviewed. ``rules_applied`` is the largest number of
    rules that one file's language allows. Findings are counted inside each file's row, in
    one scan; findings that are there already can be given, and then only they and the
    paths are read.
    """
    if findings is None:
        each = count_findings(files, by, **options)
        total = " + ".join(SEVERITIES)
        return each.groupBy(*by).agg(
            _total(F.sum(F.expr(total)), COUNTS[0]),
            *[_total(F.sum(s), s) for s in SEVERITIES],
            F.count(F.lit(1)).alias("files_reviewed"),
            _total(F.max("rules_applied"), "rules_applied"),
        )
    chosen = {k: options.get(k) for k in ("rules", "categories", "severities")}
    found = findings.groupBy(*by).agg(*_finding_counts())
    seen = rules_applied(files, **chosen).groupBy(*by).agg(
        F.count("*").alias("files_reviewed"), F.max("rules_applied").alias("rules_applied")
    )
    both = found.unionByName(seen, allowMissingColumns=True)
    return both.groupBy(*by).agg(
        *[_total(F.sum(c), c) for c in COUNTS],
        _total(F.sum("files_reviewed"), "files_reviewed"),
        _total(F.max("rules_applied"), "rules_applied"),
    )


def _total(value, name: str):
    return F.coalesce(value, F.lit(0)).cast("bigint").alias(name)


def summary_by_file(files: DataFrame, key: str | None = None, **options) -> DataFrame:
    """One summary row per row of ``files``, files without findings included; nothing is shuffled."""
    keys = known_keys(files, None if key is None else (key,))
    each = count_findings(files, (*keys, "path"), **options)
    return each.select(
        *keys,
        "path",
        _total(F.expr(" + ".join(SEVERITIES)), COUNTS[0]),
        *[_total(F.col(s), s) for s in SEVERITIES],
        F.lit(1).cast("bigint").alias("files_reviewed"),
        _total(F.col("rules_applied"), "rules_applied"),
    )


def summarize_diffs(diffs: DataFrame, keys: Sequence[str] = ("diff_id",), **options) -> DataFrame:
    """One summary row per diff that has a file to review."""
    return summarize(diff_review_files(diffs, keys), by=tuple(keys), **options)


def severity_sizes(files: DataFrame, **options) -> DataFrame:
    """``severity`` and ``group_size``, counted inside the files' rows: four rows at most."""
    counts = summarize(files, **options)
    pairs = ", ".join(f"'{s}', {s}" for s in SEVERITIES)
    sizes = counts.selectExpr(f"stack({len(SEVERITIES)}, {pairs}) AS (severity, group_size)")
    return sizes.where("group_size > 0")


def severity_groups(findings: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Findings with their severity's ``group_size``; order by rank to read the groups.

    A group may hold a large part of all findings, so it is never collected: the sizes are
    one row per severity, four at most, and are broadcast to the findings. Give the sizes
    (:func:`severity_sizes`) where the findings come from a review rather than a table, for
    without them the findings are read twice.
    """
    if sizes is None:
        sizes = findings.groupBy("severity").agg(F.count("*").alias("group_size"))
    return findings.join(F.broadcast(sizes), "severity")
