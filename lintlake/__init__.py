"""Corpus-scale code review on Spark DataFrames."""

from .operators import *  # noqa: F403
from .operators import __all__ as _operators
from .rules import FileRule, LineRule, Report, Test, hit, list_rules, rule_table

__all__ = [
    *_operators, "FileRule", "LineRule", "Report", "Test", "hit", "list_rules", "rule_table",
]
