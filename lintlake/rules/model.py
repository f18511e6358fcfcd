"""Rules as Spark SQL expressions.

A rule reports *hits*. A :class:`LineRule` looks at one line at a time, a :class:`FileRule`
at the arrays of a whole file. Both only hold expressions, so any set of rules becomes part
of one plan over one scan. A registered function, for example an Arrow one, is used by its
name like any other function.
"""

from __future__ import annotations

from dataclasses import dataclass

HIT_TYPE = "struct<code:int,line:int,end_line:int,seq:int,arg1:string,arg2:string>"

SKIP_CONTEXT = "context"  # skip comments and string content
SKIP_STRINGS = "strings"  # skip string content only
SKIP_NOTHING = "nothing"

SKIP_TEST_PATHS = "tests"
SKIP_TEST_AND_CONFIG_PATHS = "tests and config"

# What expressions about a line can use, besides ``path`` and ``language``.
TEXT, TRIMMED, NUMBER = "l.text", "l.trimmed", "l.number"

# What expressions about a file's need for a rule can use.
CONTENT, LOWERED = "content", "lowered"

# What a file rule's hits can use, besides ``content``: arrays with an entry per line.
LINES, TRIMMED_LINES, FLAGS = "lines", "trimmed", "flags"


@dataclass(frozen=True)
class Report:
    """What a hit says. ``{1}`` and ``{2}`` take the hit's arguments."""

    confidence: int
    message: str
    suggestion: str | None = None
    severity: str | None = None  # the rule's severity unless given


@dataclass(frozen=True)
class Test:
    """When a line rule's report applies, and the values it puts in its texts."""

    report: int
    when: str
    arg1: str = "NULL"
    arg2: str = "NULL"


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    category: str
    severity: str
    languages: tuple[str, ...]  # empty: every language
    reports: tuple[Report, ...]
    needs: str = "true"
    skip_paths: str | None = None


@dataclass(frozen=True)
class LineRule(Rule):
    """``tests`` are the reports to try on a line.

    ``needs`` is a cheap test on :data:`CONTENT` or :data:`LOWERED`, its lower-case form,
    that is true for every file with a hit; files that no rule needs are not even split.
    ``candidate`` is such a test on :data:`TEXT`, and ``mark`` one more that rules share:
    lines that are no rule's candidate are dropped before any pattern runs.
    """

    tests: tuple[Test, ...] = ()
    candidate: str = "true"
    mark: str = "true"
    first_only: bool = True
    skip_lines: str = SKIP_CONTEXT
    snippet: str = TEXT


@dataclass(frozen=True)
class FileRule(Rule):
    """``hits`` is an array of :func:`hit` values.

    ``needs`` is as for line rules; where it is false, ``hits`` is not evaluated.
    ``shared`` names columns that several rules read and that are computed once per file.
    """

    hits: str = ""
    shared: tuple[tuple[str, str], ...] = ()
    has_snippet: bool = True


def hit(report: int | str, line: str, seq="0", end_line="NULL", arg1="NULL", arg2="NULL") -> str:
    """One :data:`HIT_TYPE` value; ``report`` is the number of one of the rule's reports."""
    return (
        f"named_struct('code', {report}, 'line', CAST({line} AS INT), "
        f"'end_line', CAST({end_line} AS INT), 'seq', CAST({seq} AS INT), "
        f"'arg1', CAST({arg1} AS STRING), 'arg2', CAST({arg2} AS STRING))"
    )


def no_hits() -> str:
    return f"CAST(array() AS ARRAY<{HIT_TYPE}>)"
