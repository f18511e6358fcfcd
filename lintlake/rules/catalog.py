"""The built-in rule set and the rule catalog as a table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from . import fixed_values as fv
from .file_rules import FILE_RULES
from .line_rules import LINE_RULES
from .model import FileRule, LineRule, Report, Rule


def _built_in() -> tuple[Rule, ...]:
    rules = []
    for rule_id, name, category, severity, languages in fv.RULES:
        reports = tuple(Report(*texts) for texts in fv.TEXTS[rule_id])
        if rule_id == "QA002":
            reports += (replace(reports[0], severity="medium"),)
        meta = dict(
            id=rule_id,
            name=name,
            category=category,
            severity=severity,
            languages=languages,
            reports=reports,
        )
        if rule_id in LINE_RULES:
            rules.append(LineRule(**meta, **LINE_RULES[rule_id]))
        else:
            rules.append(FileRule(**meta, **FILE_RULES[rule_id]))
    return tuple(rules)


BUILT_IN_RULES = _built_in()


def select_rules(rules=None, categories=None, severities=None) -> tuple[Rule, ...]:
    """Rules to run. ``rules`` holds ids of built-in rules, custom rules, or both.

    Filters look at the rule's own category and severity, also where a finding of the rule
    carries another severity.
    """
    if rules is None:
        chosen = BUILT_IN_RULES
    else:
        by_id = {rule.id: rule for rule in BUILT_IN_RULES}
        chosen = tuple(by_id[rule] if isinstance(rule, str) else rule for rule in rules)
    return tuple(
        rule
        for rule in chosen
        if (categories is None or rule.category in categories)
        and (severities is None or rule.severity in severities)
    )


def rule_table(spark: SparkSession, rules=None) -> DataFrame:
    """The catalog: one row per rule, in the order rules run."""
    rows = [
        (seq, r.id, r.name, r.category, r.severity, list(r.languages))
        for seq, r in enumerate(select_rules(rules))
    ]
    return spark.createDataFrame(
        rows,
        "rule_seq int, id string, name string, category string, severity string, "
        "languages array<string>",
    )


def list_rules(spark: SparkSession, rules=None) -> DataFrame:
    """The catalog for display: languages shortened to three and ``...``."""
    shown = "array_join(slice(languages, 1, 3), ', ')"
    return rule_table(spark, rules).selectExpr(
        "rule_seq", "id", "name", "category", "severity",
        f"concat({shown}, if(size(languages) > 3, '...', '')) AS languages",
    )
