"""Detection rules: fixed values, Column builders and the catalog."""

from .catalog import BUILT_IN_RULES, list_rules, rule_table, select_rules
from .model import FileRule, LineRule, Report, Rule, Test, hit

__all__ = [
    "BUILT_IN_RULES", "FileRule", "LineRule", "Report", "Rule", "Test", "hit",
    "list_rules", "rule_table", "select_rules",
]
