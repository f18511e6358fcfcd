"""Sink for findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..rules.fixed_values import SEVERITIES


def write_findings(findings: DataFrame, path: str, mode: str = "errorifexists") -> dict[str, int]:
    """Parquet by severity. Files stay sorted inside, so a reader can stop early.

    Rows are written where they were found: a severity with most of the findings is
    written by all tasks and not by one. Returns the findings of each severity, counted
    while they are written.
    """
    sizes = Observation()
    observed = findings.observe(sizes, *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    order = ["severity", "confidence", "file", "rule_seq", "line", "emit_seq"]
    (
        observed.sortWithinPartitions(*order)
        .write.partitionBy("severity")
        .mode(mode)
        .parquet(path)
    )
    return dict(sizes.get)
