"""Sources of files and diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import folders

FILES_SCHEMA = "file_seq bigint, path string, content string"
DIFFS_SCHEMA = "diff_id bigint, raw string"


def files_from_rows(spark: SparkSession, rows) -> DataFrame:
    """A (path, content) list as a table, numbered in its order. For small inputs."""
    numbered = [(i, path, content) for i, (path, content) in enumerate(rows)]
    return spark.createDataFrame(numbered, FILES_SCHEMA)


CONTENT = "make_valid_utf8(CAST(content AS STRING)) AS content"


def files_from_directory(
    spark: SparkSession, root: str, glob: str | None = None, partitions: int | None = None
) -> DataFrame:
    """One row per file below ``root``: ``path`` relative to it, and ``content``.

    All files count, also empty ones and names that start with a dot or an underscore; ``glob``
    is matched with the name. Bytes that are no UTF-8 become replacement characters. Tasks list
    and read the folders, at least ``partitions`` where the folders allow it. Store a corpus
    that is read often as a table instead and use :func:`files_from_table`.
    """
    return folders.configured(spark, spark.read, root, glob, partitions).load().selectExpr("path", CONTENT)


def files_from_table(
    df: DataFrame, path: str = "path", content: str = "content", partitions: int | None = None
) -> DataFrame:
    """Name a table's path and content columns; the other columns stay and can be keys.

    Partitions of the scan are kept unless ``partitions`` asks for others.
    """
    named = df.withColumnsRenamed({path: "path", content: "content"})
    return named.repartition(partitions) if partitions else named


def diffs_from_directory(spark: SparkSession, root: str, glob: str = "*.diff") -> DataFrame:
    """One row per diff file; the path below ``root`` is its ``diff_id``."""
    return files_from_directory(spark, root, glob).withColumnsRenamed(
        {"path": "diff_id", "content": "raw"}
    )
