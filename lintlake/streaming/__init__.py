"""Review of streams."""

from .continuous import (
    diff_directory_stream,
    diff_stream,
    file_directory_stream,
    file_stream,
    start_diff_review,
    running_summary,
    severity_sizes_of,
    start_review,
    start_summary,
)

__all__ = [
    "diff_directory_stream", "diff_stream", "file_directory_stream", "file_stream",
    "start_diff_review", "running_summary", "severity_sizes_of", "start_review", "start_summary",
]
