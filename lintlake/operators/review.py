"""Review of a whole corpus: every rule over every file in one narrow pass.

Scan -> lines and flags per file -> hits per file -> explode hits -> attach texts. Lines
that no rule cares about are dropped while they are still array items, and only findings
become rows. No step needs a key, so there is no shuffle before a caller sorts or
summarises, and no path, repository or source can be a hot key. Whatever is decided by
catalog, language or path is decided before a file's content is touched.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.folds import let, struct
from ..rules import fixed_values as fv
from ..rules import select_rules
from ..rules.model import (
    FLAGS,
    HIT_TYPE,
    LINES,
    LOWERED,
    NUMBER,
    SKIP_CONTEXT,
    SKIP_NOTHING,
    SKIP_TEST_AND_CONFIG_PATHS,
    SKIP_TEST_PATHS,
    FileRule,
    LineRule,
    Report,
    Rule,
    hit,
)
from . import context

_MASK_BITS = 62  # rules per bit mask


class _Plan:
    """SQL expressions for one set of rules."""

    def __init__(
        self,
        rules: Sequence[Rule],
        order: dict[str, int],
        min_confidence: int,
        info_type: str | None,
    ):
        self.rules = rules
        self.order = order  # a rule's place before categories and severities are filtered
        self.min_confidence = min_confidence
        self.info_type = info_type  # of the line info that goes with each hit
        self.reports = [(rule, report) for rule in rules for report in rule.reports]
        self.first_code = {}
        for code, (rule, _) in enumerate(self.reports):
            self.first_code.setdefault(rule.id, code)

    # Which rules apply to a file, as bits.

    def masks(self) -> list[str]:
        """Bits of the rules that can report something for a file, from its path alone."""
        masks = []
        for first in range(0, len(self.rules), _MASK_BITS):
            chunk = self.rules[first : first + _MASK_BITS]

            def bits(test) -> int:
                return sum(1 << i for i, rule in enumerate(chunk) if test(rule))

            mask = _per_language(
                "language",
                lambda name: bits(lambda rule: _speaks(rule, name) and self.wanted(rule)),
            )
            tests = bits(
                lambda rule: rule.skip_paths in (SKIP_TEST_PATHS, SKIP_TEST_AND_CONFIG_PATHS)
            )
            configs = bits(lambda rule: rule.skip_paths == SKIP_TEST_AND_CONFIG_PATHS)
            for skipped, where in (
                (tests, text.is_test_path("path")),
                (configs, text.is_config_path("path")),
            ):
                if skipped:
                    mask += f" & if({where}, {~skipped}L, -1L)"
            masks.append(mask)
        return masks

    def wanted(self, rule: Rule) -> bool:
        """False where every report of a rule is below the wanted confidence."""
        return any(report.confidence >= self.min_confidence for report in rule.reports)

    def applies(self, rule: Rule) -> str:
        chunk, bit = divmod(self.rules.index(rule), _MASK_BITS)
        return f"mask{chunk} & {1 << bit}L <> 0"

    def active_masks(self) -> list[str]:
        """The masks without the rules that a file's content rules out."""
        masks = []
        for first in range(0, len(self.rules), _MASK_BITS):
            chunk = [r for r in self.rules[first : first + _MASK_BITS] if self.wanted(r)]
            bits = [
                f"if({self.applies(r)} AND ({r.needs}), {1 << self.rules.index(r) - first}L, 0L)"
                for r in chunk
            ]
            masks.append(let(LOWERED, self.lowered(), text.chained("|", bits) if bits else "0L"))
        return masks

    def lowered(self) -> str:
        """Lower-case content where an applicable rule asks for it."""
        readers = [r for r in self.rules if self.wanted(r) and LOWERED in r.needs]
        if not readers:
            return "CAST(NULL AS STRING)"
        return f"if({text.any_of(self.applies(r) for r in readers)}, lower(content), NULL)"

    # Hits of lines.

    def line_rules(self) -> list[LineRule]:
        return [r for r in self.rules if isinstance(r, LineRule) and self.wanted(r)]

    def gate(self, rule: LineRule) -> str:
        test = self.applies(rule)
        if rule.skip_lines == SKIP_CONTEXT:
            return f"({test} AND l.flag = '{context.PLAIN}')"
        if rule.skip_lines != SKIP_NOTHING:
            return f"({test} AND l.flag <> '{context.STRING}')"
        return f"({test})"

    def candidate(self) -> str:
        """Lines some rule may report, rules with the same mark tested together."""
        groups: dict[str, list[LineRule]] = {}
        for rule in self.line_rules():
            groups.setdefault(rule.mark, []).append(rule)
        return text.any_of(
            f"({text.any_of(self.applies(rule) for rule in rules)} AND {mark} AND "
            + text.any_of(f"({self.gate(rule)} AND ({rule.candidate}))" for rule in rules)
            + ")"
            for mark, rules in groups.items()
        )

    def tests(self, rule: LineRule) -> list[str]:
        """Nullable hits of one rule on line ``l``."""
        values = [
            (
                test.when,
                self.packed(
                    hit(
                        self.first_code[rule.id] + test.report,
                        NUMBER,
                        "0" if rule.first_only else str(seq),
                        arg1=test.arg1,
                        arg2=test.arg2,
                    ),
                    rule.snippet,
                    "l.info",
                ),
            )
            for seq, test in enumerate(rule.tests)
        ]
        gate = f"{self.gate(rule)} AND ({rule.candidate})"
        if rule.first_only:
            cases = " ".join(f"WHEN {when} THEN {value}" for when, value in values)
            return [f"CASE WHEN {gate} THEN CASE {cases} END END"]
        return [f"CASE WHEN {gate} AND ({when}) THEN {value} END" for when, value in values]

    def line_hits(self, line_info: str | None) -> str:
        """Hits of all line rules over a file's lines."""
        columns = [LINES, FLAGS]
        fields = dict(text="z.lines", flag="z.flags")
        if line_info:
            columns.append(line_info)
            fields["info"] = f"z.{line_info}"
        items = f"arrays_zip({', '.join(columns)})"
        numbered = struct(number="i + 1", **fields)
        found = f"filter(transform({items}, (z, i) -> {numbered}), l -> {self.candidate()})"
        trimmed = struct(
            trimmed=text.trim("l.text"), number=NUMBER, **{name: f"l.{name}" for name in fields}
        )
        tests = [test for rule in self.line_rules() for test in self.tests(rule)]
        hits = let("l", trimmed, f"filter(array({', '.join(tests)}), h -> h IS NOT NULL)")
        some_rule = text.any_of(self.applies(rule) for rule in self.line_rules())
        return f"if({some_rule}, flatten(transform({found}, l -> {hits})), {self.nothing()})"

    # Hits of files.

    def file_rules(self) -> list[FileRule]:
        return [r for r in self.rules if isinstance(r, FileRule) and self.wanted(r)]

    def file_hits(self, rule: FileRule, line_info: str | None) -> str:
        """One file rule's hits, codes made global and snippets attached."""
        moved = struct(
            code=f"h.code + {self.first_code[rule.id]}",
            **{f: f"h.{f}" for f in ("line", "end_line", "seq", "arg1", "arg2")},
        )
        snippet = f"get({LINES}, h.line - 1)" if rule.has_snippet else "CAST(NULL AS STRING)"
        info = f"get({line_info}, h.line - 1)"
        return (
            f"if({self.applies(rule)}, "
            f"transform({rule.hits}, h -> {self.packed(moved, snippet, info)}), {self.nothing()})"
        )

    # A hit with what its line adds to it.

    def packed(self, value: str, snippet: str, info: str) -> str:
        fields = {"hit": value, "snippet": snippet}
        if self.info_type:
            fields["info"] = info
        return struct(**fields)

    def nothing(self) -> str:
        info = f",info:{self.info_type}" if self.info_type else ""
        return f"CAST(array() AS ARRAY<STRUCT<hit:{HIT_TYPE},snippet:string{info}>>)"

    # Findings from hits.

    def texts(self) -> str:
        """Everything fixed about a report, indexed by the hit's code."""
        rows = []
        nothing = (Rule("", "", "", fv.SEVERITIES[0], (), ()), Report(0, ""))
        for rule, report in self.reports or [nothing]:
            severity = report.severity or rule.severity
            messages, suggestions = _pieces(report.message), _pieces(report.suggestion)
            rows.append(
                struct(
                    rule=text.literal(rule.id),
                    category=text.literal(rule.category),
                    severity=text.literal(severity),
                    severity_rank=str(fv.SEVERITIES.index(severity)),
                    confidence=str(report.confidence),
                    rule_seq=str(self.order.get(rule.id, 0)),
                    **{f"m{i}": text.literal(piece) for i, piece in enumerate(messages)},
                    **{f"s{i}": text.literal(piece) for i, piece in enumerate(suggestions)},
                )
            )
        return f"array({', '.join(rows)})"


def _pieces(template: str | None) -> list[str | None]:
    """A text cut at ``{1}`` and ``{2}``; a piece is NULL where nothing is inserted before it."""
    if template is None:
        return [None, None, None]
    pieces = re.split(r"\{[12]\}", template)
    return pieces + [None] * (3 - len(pieces))


def _filled(prefix: str) -> str:
    """The pieces of a text with the hit's arguments between them."""
    return (
        f"concat({prefix}0, coalesce(concat(coalesce(h.hit.arg1, ''), {prefix}1), ''), "
        f"coalesce(concat(coalesce(h.hit.arg2, ''), {prefix}2), ''))"
    )


def _speaks(rule: Rule, language: str) -> bool:
    return not rule.languages or language in rule.languages


def _per_language(language: str, value) -> str:
    """``value(name)`` as a bigint for the file's language."""
    names = sorted(set(text.REVIEW_LANGUAGES.values()))
    table = ", ".join(f"'{name}', {value(name)}L" for name in names)
    return f"coalesce(try_element_at(map({table}), {language}), {value(text.UNKNOWN)}L)"


def _any_applies(plan: _Plan, rules: Sequence[Rule]) -> str:
    return text.any_of(plan.applies(rule) for rule in rules)


def review(
    files: DataFrame,
    *,
    rules=None,
    categories: Sequence[str] | None = None,
    severities: Sequence[str] | None = None,
    min_confidence: int = 0,
    use_context: bool = True,
    keys: Sequence[str] | None = None,
    line_info: str | None = None,
) -> DataFrame:
    """Findings of a (path, content) table, batch or streaming, in no particular order.

    ``rules`` holds ids and custom rules; ``categories`` and ``severities`` filter on the
    rule, ``min_confidence`` on the finding. ``use_context=False`` also looks into comments
    and strings. ``keys`` are columns of ``files`` to keep with each finding (by default
    ``file_seq`` where there is one), and
    ``line_info`` names an array of structs, one per line, whose fields go with it.
    """
    keys = context.known_keys(files, keys)
    info_type = files.schema[line_info].dataType.elementType.simpleString() if line_info else None
    plan = _plan(rules, categories, severities, min_confidence, info_type)
    key = F.struct(*keys) if keys else F.lit(None).cast("void")
    lined, hits = _with_hits(files, plan, key, use_context, line_info)
    return (
        lined.selectExpr("key", "path", f"explode({hits}) AS h")
        .selectExpr("*", f"{plan.texts()}[h.hit.code] AS r")
        .selectExpr(
            *[f"key.`{name}`" for name in keys],
            "path AS file",
            "h.hit.line AS line",
            "h.hit.end_line AS end_line",
            "r.rule AS rule",
            "r.category AS category",
            "r.severity AS severity",
            "r.confidence AS confidence",
            f"{_filled('r.m')} AS message",
            "h.snippet AS snippet",
            f"{_filled('r.s')} AS suggestion",
            "r.severity_rank AS severity_rank",
            "r.rule_seq AS rule_seq",
            "h.hit.seq AS emit_seq",
            *(["h.info.*"] if line_info else []),
        )
        .where(f"confidence >= {min_confidence}" if min_confidence > 0 else "true")
    )


def _plan(rules, categories, severities, min_confidence: int, info_type: str | None = None) -> _Plan:
    order = {rule.id: seq for seq, rule in enumerate(select_rules(rules))}
    return _Plan(select_rules(rules, categories, severities), order, min_confidence, info_type)


def _with_hits(
    files: DataFrame, plan: _Plan, key, use_context: bool, line_info: str | None = None, all_files: bool = False
) -> tuple[DataFrame, str]:
    """A frame with ``key`` and ``path``, and the expression for a file's hits.

    Files that no rule can report on are left out, unless ``all_files``.
    """
    infos = [F.col(line_info).alias("info")] if line_info else []
    info = "info" if line_info else None

    # Decided from the path alone, then from what the content holds at all. A file that no
    # rule is left for is not split into lines. Only the first of the two is a filter: the
    # second would be evaluated again below it when the optimizer pushes it down.
    masks = [f"{mask} AS mask{i}" for i, mask in enumerate(plan.masks())]
    active = [f"{mask} AS mask{i}" for i, mask in enumerate(plan.active_masks())]
    some_rule = " OR ".join(f"mask{i} <> 0" for i in range(len(masks))) or "false"
    known = (
        files.select(key.alias("key"), *infos, "path", "content")
        .selectExpr("*", f"{text.detect_language('path')} AS language")
        .selectExpr("*", *masks)
        .where("true" if all_files else some_rule)
        .selectExpr("key", *([info] if info else []), "path", "content", *active)
    )

    lined = context.with_lines(known, use_context, only=some_rule)
    file_rules = plan.file_rules()
    if file_rules:
        trimmed = f"transform({LINES}, l -> {text.trim('l')})"
        lined = lined.selectExpr("*", f"if({_any_applies(plan, file_rules)}, {trimmed}, NULL) AS trimmed")
    for name, value in {n: v for r in file_rules for n, v in r.shared}.items():
        readers = [r for r in file_rules if name in dict(r.shared)]
        lined = lined.selectExpr("*", f"if({_any_applies(plan, readers)}, {value}, NULL) AS {name}")

    parts = [plan.file_hits(rule, info) for rule in file_rules]
    if plan.line_rules():
        parts.append(plan.line_hits(info))
    return lined, f"concat({', '.join(parts)})" if parts else plan.nothing()


def count_findings(
    files: DataFrame,
    by: Sequence[str] = (),
    *,
    rules=None,
    categories: Sequence[str] | None = None,
    severities: Sequence[str] | None = None,
    min_confidence: int = 0,
    use_context: bool = True,
) -> DataFrame:
    """A row per file: ``by``, its number of findings of each severity, and ``rules_applied``.

    Findings are counted inside the file's row and never become rows.
    """
    plan = _plan(rules, categories, severities, min_confidence)
    kept = [name for name in by if name != "path"]
    key = F.struct(*kept) if kept else F.lit(None).cast("void")
    lined, hits = _with_hits(files, plan, key, use_context, all_files=True)
    codes: dict[str, list[str]] = {name: [] for name in fv.SEVERITIES}
    for code, (rule, report) in enumerate(plan.reports):
        if report.confidence >= min_confidence:
            codes[report.severity or rule.severity].append(str(code))
    counts = {
        name: f"size(filter(codes, c -> c IN ({', '.join(own)})))" if own else "0"
        for name, own in codes.items()
    }
    # Exploding the one struct keeps a filter on the counts from being pushed below them,
    # where it would repeat the whole review for every count.
    counted = f"transform(array(transform({hits}, h -> h.hit.code)), codes -> {struct(**counts)})"
    return lined.selectExpr("key", "path", f"explode({counted}) AS c").selectExpr(
        *("path" if name == "path" else f"key.`{name}`" for name in by),
        *(f"c.{name} AS {name}" for name in fv.SEVERITIES),
        f"{_rules_of_language(plan.rules)} AS rules_applied",
    )


def _rules_of_language(chosen: Sequence[Rule]) -> str:
    return _per_language(
        text.detect_language("path"), lambda name: sum(_speaks(rule, name) for rule in chosen)
    )


def check_error_handling(files: DataFrame, **options) -> DataFrame:
    """Only the error-handling rules."""
    return review(files, categories=["error-handling"], **options)


def rules_applied(files: DataFrame, rules=None, categories=None, severities=None) -> DataFrame:
    """Add ``rules_applied``: how many of the chosen rules speak the file's language."""
    chosen = select_rules(rules, categories, severities)
    return files.selectExpr("*", f"{_rules_of_language(chosen)} AS rules_applied")


def sort_findings(findings: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Severity, then confidence; ties in file, rule, line and report order.

    A range sort reads its input twice, first for a sample. Findings are therefore put into
    a shuffle of their own, by file and line, so that the sample comes from there and the
    corpus is not reviewed a second time.
    """
    keys = context.known_keys(findings, keys) or ("file",)
    return findings.repartition(*keys, "line", "rule_seq").orderBy(
        "severity_rank", F.desc("confidence"), *keys, "rule_seq", "line", "emit_seq"
    )
