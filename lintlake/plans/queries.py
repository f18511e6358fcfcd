"""Registered queries: every operator over the whole derived corpora."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as op
from ..functions import text
from ..rules import BUILT_IN_RULES, FileRule, LineRule, Report, Test, hit, list_rules, rule_table
from ..sources import files_from_directory, write_files, write_findings
from ..streaming import (
    file_directory_stream,
    running_summary,
    severity_sizes_of,
    start_diff_review,
    start_review,
    start_summary,
)
from . import corpus

Query = Callable[[SparkSession, str], DataFrame]


def _on_files(operator: Callable[..., DataFrame], **options) -> Query:
    return lambda spark, sf_dir: operator(corpus.files(spark, sf_dir), **options)


def _on_diffs(operator: Callable[..., DataFrame], **options) -> Query:
    return lambda spark, sf_dir: operator(corpus.diffs(spark, sf_dir), **options)


def _shared(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors and the driver share.

    Where it is unset, tests on a local master get a local folder; any other master is
    refused, for its executors would write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _on_lines(operator: Callable[..., DataFrame]) -> Query:
    """The operator over the table of all lines of the corpus, which it puts in chunks."""
    return lambda spark, sf_dir: operator(op.lines(corpus.files(spark, sf_dir)), keys=("file_seq",))


def language_counts(spark, sf_dir):
    files = corpus.files(spark, sf_dir).selectExpr(f"{text.detect_language('path')} AS language")
    return files.groupBy("language").agg(F.count("*").alias("files"))


def language_full(spark, sf_dir):
    language = text.detect_language_full("path")
    return corpus.files(spark, sf_dir).selectExpr("file_seq", "path", f"{language} AS language")


def file_types(spark, sf_dir):
    file_type = text.detect_file_type("path")
    return corpus.files(spark, sf_dir).selectExpr("file_seq", "path", f"{file_type} AS file_type")


def findings_sorted(spark, sf_dir):
    """Findings in report order, over range partitions."""
    return op.sort_findings(op.review(corpus.files(spark, sf_dir)))


def summary_by_source(spark, sf_dir):
    """Summaries per document source and language: which sources bring which findings."""
    documents = corpus.documents(spark, sf_dir)
    files = corpus.document_files(documents, keep=("source", "lang"))
    return op.summarize(files, by=("source", "lang"))


def severity_groups(spark, sf_dir):
    """Groups over findings that are reviewed and written once; their sizes are counted as they are written."""
    findings, output = op.review(corpus.files(spark, sf_dir)), _shared(spark, "findings")
    sizes = [(s, n) for s, n in write_findings(findings, output).items() if n]
    written = spark.read.schema(findings.schema).parquet(output)
    return op.severity_groups(written, spark.createDataFrame(sizes, "severity string, group_size bigint"))


def rule_coverage(spark, sf_dir):
    """The rule list with the number of files each rule speaks to."""
    per_language = language_counts(spark, sf_dir)
    rules = list_rules(spark)
    spoken = rule_table(spark).select("rule_seq", F.explode("languages").alias("language"))
    # One row per known language, so both sides stay as small as the catalog.
    counted = (
        spoken.join(F.broadcast(per_language), "language")
        .groupBy("rule_seq")
        .agg(F.sum("files").alias("files"))
    )
    return rules.join(F.broadcast(counted), "rule_seq", "left").withColumn(
        "files", F.coalesce("files", F.lit(0))
    )


CUSTOM_RULES = (
    LineRule(
        id="DOC001",
        name="long-line",
        category="test-coverage",
        severity="low",
        languages=(),
        reports=(Report(50, "Line of {1} characters"),),
        tests=(Test(0, "length(l.text) > 1000", "length(l.text)"),),
    ),
    FileRule(
        id="DOC002",
        name="long-file",
        category="test-coverage",
        severity="high",
        languages=(),
        reports=(Report(70, "File of {1} lines", "Split the file"),),
        needs="contains(content, '\\n')",
        hits="filter(array("
        + hit(0, "1", end_line="size(lines)", arg1="size(lines)")
        + "), h -> size(lines) > 40)",
    ),
)


def _table_stream(spark, sf_dir, name, schema):
    # A pattern, since a stream takes a single file by a pattern only; a folder works as well.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _streamed(spark, start, stream):
    """What a stream writes until it has seen all there is, read back."""
    output = _shared(spark, "findings")
    start(stream, output, _shared(spark, "progress"), available_now=True).awaitTermination()
    return spark.read.parquet(output)


def streaming_review(spark, sf_dir):
    """Documents and pages as streams, reviewed to a Parquet sink that is read back."""
    documents = _table_stream(spark, sf_dir, "documents", corpus.documents(spark, sf_dir).schema)
    pages = _table_stream(spark, sf_dir, "pages", corpus.pages(spark, sf_dir).schema)
    files = corpus.document_files(documents).unionByName(corpus.page_files(pages))
    return _streamed(spark, start_review, files)


def _summed_stream(spark, sf_dir, by):
    """The documents as a stream, summarized in the state store; the folder of the results."""
    documents = _table_stream(spark, sf_dir, "documents", corpus.documents(spark, sf_dir).schema)
    files, output = corpus.document_files(documents, keep=("source", "lang")), _shared(spark, "summary")
    start_summary(files, output, _shared(spark, "progress"), by, available_now=True).awaitTermination()
    return running_summary(spark, output, by)


def streaming_summary_by_source(spark, sf_dir):
    """Running summaries per document source and language, as of the stream's last batch."""
    return _summed_stream(spark, sf_dir, ("source", "lang"))


def streaming_severity_sizes(spark, sf_dir):
    """Sizes of the severity groups from running summaries."""
    return severity_sizes_of(_summed_stream(spark, sf_dir, ("source", "lang")))


def streaming_diff_review(spark, sf_dir):
    """The documents' diffs as a stream, reviewed to a Parquet sink that is read back."""
    documents = _table_stream(spark, sf_dir, "documents", corpus.documents(spark, sf_dir).schema)
    return _streamed(spark, start_diff_review, corpus.document_diffs(documents))


def _written_findings(spark, sf_dir):
    output = _shared(spark, "findings")
    write_findings(op.review(corpus.files(spark, sf_dir)), output)
    return spark.read.parquet(output)


def _as_folder(spark, sf_dir):
    """The corpus written as one file per row, below a folder that carries the number."""
    root = _shared(spark, "folder")
    numbered = corpus.files(spark, sf_dir).selectExpr(
        "concat_ws('/', file_seq % 100, file_seq, path) AS path", "content"
    )
    write_files(numbered, root)
    return root


def _numbered_again(files):
    return files.selectExpr(
        "CAST(split_part(path, '/', 2) AS BIGINT) AS file_seq",
        "regexp_replace(path, '^[0-9]+/[0-9]+/', '') AS path",
        "content",
    )


def directory_review(spark, sf_dir):
    """The corpus as files in folders, read back by the folder source and reviewed."""
    return op.review(_numbered_again(files_from_directory(spark, _as_folder(spark, sf_dir))))


def directory_files(spark, sf_dir):
    """Lines and characters of every file in folders, empty ones included."""
    root = _as_folder(spark, sf_dir)
    empty = corpus.files(spark, sf_dir).selectExpr("concat('empty/', file_seq, '/none') AS path", "'' AS content")
    write_files(empty, root)
    return files_from_directory(spark, root).selectExpr(
        "CAST(split_part(path, '/', 2) AS BIGINT) AS file_seq",
        "startswith(path, 'empty/') AS is_empty_twin",
        "length(content) AS n_chars",
        f"size({text.split_lines('content')}) AS n_lines",
    )


def streaming_directory_review(spark, sf_dir):
    """The corpus as files in folders, reviewed as a stream of the folder."""
    root = _as_folder(spark, sf_dir)
    files = _numbered_again(file_directory_stream(spark, root, settle=0))
    return _streamed(spark, start_review, files)


def findings_sink(spark, sf_dir):
    """Findings written by severity and counted from the written table."""
    written = _written_findings(spark, sf_dir)
    return written.groupBy("severity", "rule").agg(F.count("*").alias("findings"))


def queries() -> dict[str, Query]:
    """Queries by name."""
    found = {
        "lines": _on_files(op.lines),
        "language_counts": language_counts,
        "language_full": language_full,
        "file_types": file_types,
        "line_context": _on_files(op.line_context),
        "line_context_chunked": _on_lines(op.line_context_of_lines),
        "try_regions_chunked": _on_lines(op.try_regions_of_lines),
        "brace_spans_chunked": _on_lines(op.brace_spans_of_lines),
        "imports": _on_files(op.imports),
        "import_module_counts": _on_files(op.import_module_counts),
        "try_regions": _on_files(op.try_regions),
        "brace_blocks": _on_files(op.brace_blocks),
        "indent_blocks": _on_files(op.indent_blocks),
        "code_blocks": _on_files(op.code_blocks),
        "diff_files": _on_diffs(op.diff_files),
        "diff_hunks": _on_diffs(op.diff_hunks),
        "diff_lines": _on_diffs(op.diff_lines),
        "diff_review_text": _on_diffs(op.diff_review_files),
        "diff_findings": _on_diffs(op.review_diffs),
        "diff_findings_mapped": _on_diffs(op.review_diffs, map_lines=True),
        "diff_summary": _on_diffs(op.summarize_diffs),
        "findings_all": _on_files(op.review),
        "findings_sorted": findings_sorted,
        "findings_no_context": _on_files(op.review, use_context=False),
        "findings_min_conf_80": _on_files(op.review, min_confidence=80),
        "findings_security": _on_files(op.review, categories=["security"]),
        "findings_rule_severity_medium": _on_files(op.review, severities=["medium"]),
        "check_error_handling": _on_files(op.check_error_handling),
        "summary": _on_files(op.summarize),
        "summary_by_file": _on_files(op.summary_by_file),
        "summary_by_source": summary_by_source,
        "severity_groups": severity_groups,
        "rule_coverage": rule_coverage,
        "custom_rules": _on_files(op.review, rules=CUSTOM_RULES),
        "streaming_review": streaming_review,
        "streaming_diff_review": streaming_diff_review,
        "directory_files": directory_files,
        "directory_review": directory_review,
        "streaming_directory_review": streaming_directory_review,
        "streaming_summary_by_source": streaming_summary_by_source,
        "streaming_severity_sizes": streaming_severity_sizes,
        "findings_sink": findings_sink,
    }
    for rule in BUILT_IN_RULES:
        found[f"rule_{rule.id}"] = _on_files(op.review, rules=[rule.id])
    return found
