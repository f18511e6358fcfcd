"""Continuous review: the batch pipeline over a stream of files or diffs.

Review keeps no state between rows, so it runs in append mode without a watermark. A running
summary keeps one row of counts per key in the state store; no watermark drops late files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.diff import review_diffs
from ..operators.review import review
from ..operators.summary import summarize
from ..rules.fixed_values import SEVERITIES
from ..sources import folders
from ..sources.files import CONTENT, DIFFS_SCHEMA, FILES_SCHEMA

_NUMBER = "summary_batch"


def file_stream(
    spark: SparkSession, directory: str, schema: str = FILES_SCHEMA, max_files: int | None = None
) -> DataFrame:
    """Parquet files of (file_seq, path, content) rows that arrive in a directory."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(directory)


def diff_stream(
    spark: SparkSession, directory: str, schema: str = DIFFS_SCHEMA, max_files: int | None = None
) -> DataFrame:
    """Parquet files of (diff_id, raw) rows that arrive in a directory."""
    return file_stream(spark, directory, schema, max_files)


def file_directory_stream(
    spark: SparkSession, root: str, glob: str | None = None, settle: float = 2.0,
    partitions: int | None = None,
) -> DataFrame:
    """Source files that arrive below a folder, empty ones too, as (path, content) rows.

    Paths are relative to the folder, as in :func:`files_from_directory`. A file is taken up
    ``settle`` seconds after its last change; one that is changed later is taken up again.
    """
    reader = folders.configured(spark, spark.readStream, root, glob, partitions, settle=settle)
    return reader.load().selectExpr("path", CONTENT)


def diff_directory_stream(
    spark: SparkSession, root: str, glob: str = "*.diff", settle: float = 2.0,
    partitions: int | None = None,
) -> DataFrame:
    """Diff files that arrive below a folder; the path below it is the ``diff_id``."""
    files = file_directory_stream(spark, root, glob, settle, partitions)
    return files.withColumnsRenamed({"path": "diff_id", "content": "raw"})


def start_review(
    stream: DataFrame, output: str, checkpoint: str, available_now: bool = False, **options
) -> StreamingQuery:
    """Append findings of a stream of files to Parquet, exactly once."""
    return _start(review(stream, **options), output, checkpoint, available_now)


def start_diff_review(
    stream: DataFrame, output: str, checkpoint: str, available_now: bool = False, **options
) -> StreamingQuery:
    """Append findings of a stream of diffs to Parquet, exactly once."""
    return _start(review_diffs(stream, **options), output, checkpoint, available_now)


def start_summary(
    stream: DataFrame, output: str, checkpoint: str, by: Sequence[str] = (),
    available_now: bool = False, **options,
) -> StreamingQuery:
    """Keep :func:`summarize` of all files of a stream so far, per ``by``.

    A batch writes the rows of the keys it changed into a folder of its own, which a batch that
    is run again replaces; :func:`running_summary` reads the newest row of every key. Counts
    go on from the checkpoint after a restart.
    """

    def save(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{output.rstrip('/')}/{_NUMBER}={number}")

    summary = summarize(stream, by=by, **options)
    writer = summary.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def running_summary(spark: SparkSession, output: str, by: Sequence[str] = ()) -> DataFrame:
    """The summary as of the last batch that :func:`start_summary` wrote; keys may be null."""
    rows = spark.read.parquet(output)
    values = [c for c in rows.columns if c not in (*by, _NUMBER)]
    newest = rows.groupBy(*by).agg(F.max_by(F.struct(*values), _NUMBER).alias(_NUMBER))
    return newest.select(*by, f"{_NUMBER}.*")


def severity_sizes_of(summary: DataFrame) -> DataFrame:
    """``severity`` and ``group_size`` over all rows of a summary, four rows at most."""
    totals = summary.agg(*(F.sum(s).alias(s) for s in SEVERITIES))
    pairs = ", ".join(f"'{s}', {s}" for s in SEVERITIES)
    return totals.selectExpr(f"stack({len(SEVERITIES)}, {pairs}) AS (severity, group_size)").where("group_size > 0")


def _start(findings: DataFrame, output: str, checkpoint: str, available_now: bool):
    writer = (
        findings.writeStream.outputMode("append")
        .format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
