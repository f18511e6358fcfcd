"""Where files and diffs come from, and where findings go."""

from .files import (
    diffs_from_directory,
    files_from_directory,
    files_from_rows,
    files_from_table,
)
from .folders import write_files
from .sinks import write_findings

__all__ = [
    "diffs_from_directory", "files_from_directory", "files_from_rows", "files_from_table",
    "write_files", "write_findings",
]
