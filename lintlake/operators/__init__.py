"""Operators on (path, content) and (diff_id, raw) tables."""

from .blocks import brace_blocks, code_blocks, indent_blocks
from .context import import_module_counts, imports, line_context, lines, try_regions
from .diff import diff_files, diff_hunks, diff_lines, diff_review_files, review_diffs
from .long_files import brace_spans_of_lines, line_context_of_lines, try_regions_of_lines
from .review import check_error_handling, count_findings, review, rules_applied, sort_findings
from .summary import severity_groups, severity_sizes, summarize, summarize_diffs, summary_by_file

__all__ = [
    "brace_blocks", "brace_spans_of_lines", "check_error_handling", "code_blocks", "count_findings", "diff_files", "diff_hunks",
    "diff_lines", "diff_review_files", "import_module_counts", "imports", "indent_blocks",
    "line_context", "line_context_of_lines", "lines", "review", "review_diffs", "rules_applied", "severity_groups",
    "severity_sizes",
    "sort_findings", "summarize", "summarize_diffs", "summary_by_file", "try_regions",
    "try_regions_of_lines",
]
