"""Unified diffs as tables of files, hunks and lines, and as reviewable files.

A diff is cut into files and a file into hunks with ``split`` before rows multiply, without a
shuffle or a window on its id; the rows of a diff stay in the task that read it. Lines are
numbered by a running fold inside the hunk. What is exploded is an expression rather than a
column, and files are dropped as array items: filters on columns would be pushed below the
cuts and cut again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import folds, text
from .context import key_columns
from .review import review

# How parts of a unified diff begin.
FILE_START = "diff --git"
HUNK_START = "@@"
FILE_HEADER = r"^diff --git a/(.+) b/(.+)\z"
HUNK_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
STATUS_LINES = (
    ("new file", "added"),
    ("deleted file", "deleted"),
    ("--- /dev/null", "added"),
    ("+++ /dev/null", "deleted"),
)
NEW_PATH = "+++ b/"
OLD_PATH = "--- a/"

# What a hunk line is, by its first character: added, removed, context, skipped, end.
_KIND = """CASE WHEN startswith(l, '+') THEN 'a' WHEN startswith(l, '-') THEN 'r'
    WHEN startswith(l, ' ') OR l = '' THEN 'c' WHEN startswith(l, '\\\\') THEN 's' ELSE 'x' END"""


def _rest(array: str) -> str:
    """All but the first element."""
    return f"slice({array}, 2, greatest(size({array}) - 1, 0))"


def _file_parts(diffs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per file: header lines and the texts of its hunks."""
    key = F.struct(*keys) if keys else F.lit(None).cast("void")
    parts = (
        f"filter(split(raw, '\\n(?={FILE_START})'), part -> startswith(part, '{FILE_START}'))"
    )
    return (
        diffs.select(key.alias("key"), "raw")
        .selectExpr("key", f"posexplode({parts}) AS (file_seq, part)")
        .selectExpr("key", "file_seq", f"split(part, '\\n(?={HUNK_START})') AS pieces")
        .selectExpr(
            "key",
            "file_seq",
            f"{text.split_lines('pieces[0]')} AS header",
            f"{_rest('pieces')} AS hunks",
        )
    )


def _with_names(parts: DataFrame) -> DataFrame:
    """Add ``path``, ``old_path`` and ``status``; later header lines win."""
    old = text.extract("header[0]", FILE_HEADER, 1)
    new = text.extract("header[0]", FILE_HEADER, 2)
    rest = _rest("header")
    status_of = " ".join(
        f"WHEN startswith(l, '{start}') THEN '{status}'" for start, status in STATUS_LINES
    )
    statuses = f"filter(transform({rest}, l -> CASE {status_of} END), s -> s IS NOT NULL)"
    takes_old = " OR ".join(
        f"startswith(l, '{start}')"
        for start in (OLD_PATH, *(s for s, status in STATUS_LINES if status == "added"))
    )
    after = len(OLD_PATH) + 1
    return (
        parts.selectExpr(
            "*",
            f"{old} AS head_old",
            f"{new} AS head_new",
            f"try_element_at({statuses}, -1) AS set_status",
            f"try_element_at(filter({rest}, l -> startswith(l, '{NEW_PATH}')), -1) AS set_new",
            # Lines that set the old path, and lines that take it away.
            f"try_element_at(filter({rest}, l -> {takes_old}), -1) AS set_old",
        )
        .selectExpr(
            "*",
            f"coalesce(substring(set_new, {len(NEW_PATH) + 1}), head_new) AS path",
            "coalesce(set_status, if(head_old <> head_new, 'renamed', 'modified')) AS status",
        )
        .selectExpr(
            "*",
            f"""CASE WHEN status = 'added' THEN NULL
                WHEN set_old IS NULL THEN nullif(head_old, '')
                WHEN startswith(set_old, '{OLD_PATH}') THEN substring(set_old, {after})
                END AS old_path""",
        )
    )


def diff_files(diffs: DataFrame, keys: Sequence[str] = ("diff_id",)) -> DataFrame:
    """Files of (keys, raw) diffs: path, old path and status."""
    return _with_names(_file_parts(diffs, keys)).selectExpr(
        *key_columns(keys), "file_seq", "path", "old_path", "status"
    )


def _number(head: str, group: int, missing: int) -> str:
    digits = text.extract(head, HUNK_HEADER, group)
    return (
        f"CASE WHEN NOT {text.matches(head, HUNK_HEADER)} THEN 0L "
        f"WHEN {digits} = '' THEN {missing}L ELSE try_cast({digits} AS BIGINT) END"
    )


def _hunk_rows(diffs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        _file_parts(diffs, keys)
        .selectExpr(
            "key",
            "file_seq",
            f"posexplode(transform(hunks, hunk -> {text.split_lines('hunk')})) AS (hunk_seq, lines)",
        )
    )


def diff_hunks(diffs: DataFrame, keys: Sequence[str] = ("diff_id",)) -> DataFrame:
    """Hunks with their ranges; an unreadable header gives zeros."""
    return _hunk_rows(diffs, keys).selectExpr(
        *key_columns(keys), "file_seq", "hunk_seq",
        f"{_number('lines[0]', 1, 0)} AS old_start", f"{_number('lines[0]', 2, 1)} AS old_count",
        f"{_number('lines[0]', 3, 0)} AS new_start", f"{_number('lines[0]', 4, 1)} AS new_count",
    )


def _body(lines: str) -> str:
    """Lines of a hunk after its header, up to the first that is no hunk line."""
    stop = f"CAST(array_position(transform(body, l -> {_KIND}), 'x') AS INT)"
    cut = folds.let("stop", stop, "if(stop > 0, slice(body, 1, stop - 1), body)")
    return folds.let("body", _rest(lines), cut)


def diff_lines(diffs: DataFrame, keys: Sequence[str] = ("diff_id",)) -> DataFrame:
    """Typed hunk lines with their line numbers on the old and the new side."""
    numbers = folds.running_pieces(
        "kinds",
        folds.struct(old="old_start", new="new_start", seq="0"),
        lambda state, kind: folds.struct(
            old=f"{state}.old + if({kind} IN ('r', 'c'), 1, 0)",
            new=f"{state}.new + if({kind} IN ('a', 'c'), 1, 0)",
            seq=f"{state}.seq + if({kind} = 's', 0, 1)",
        ),
        lambda state, kind: f"concat_ws(',', {state}.old, {state}.new, {state}.seq) || ';'",
    )
    return (
        _hunk_rows(diffs, keys)
        .selectExpr(
            "key", "file_seq", "hunk_seq",
            f"{_number('lines[0]', 1, 0)} AS old_start",
            f"{_number('lines[0]', 3, 0)} AS new_start",
            f"{_body('lines')} AS body",
        )
        .selectExpr("*", f"transform(body, l -> {_KIND}) AS kinds")
        .selectExpr("*", f"{numbers} AS numbers")
        .selectExpr(
            "key", "file_seq", "hunk_seq",
            "explode(filter(arrays_zip(body, kinds, numbers), l -> l.kinds <> 's')) AS item",
        )
        .selectExpr(
            "*",
            "item.body AS line",
            "item.kinds AS kind",
            "CAST(split(item.numbers, ',') AS ARRAY<BIGINT>) AS number",
        )
        .selectExpr(
            *key_columns(keys), "file_seq", "hunk_seq",
            "CAST(number[2] AS INT) AS line_seq",
            "CASE kind WHEN 'a' THEN 'add' WHEN 'r' THEN 'remove' ELSE 'context' END AS type",
            "substring(line, 2) AS content",
            "if(kind = 'a', NULL, number[0]) AS old_line",
            "if(kind = 'r', NULL, number[1]) AS new_line",
        )
    )


def _kept_lines() -> str:
    """Added and context lines of ``hunk``, with their numbers in the new file.

    These are the lines that advance the new side, so the place among them is enough.
    """
    kept = f"filter({_body('hunk_lines')}, l -> {_KIND} IN ('a', 'c'))"
    numbered = folds.struct(
        content="substring(l, 2)", new_line="first + i", is_added="startswith(l, '+')"
    )
    lines = folds.let(
        "first", _number("hunk_lines[0]", 3, 0), f"transform({kept}, (l, i) -> {numbered})"
    )
    return folds.let("hunk_lines", text.split_lines("hunk"), lines)


def diff_review_files(
    diffs: DataFrame, keys: Sequence[str] = ("diff_id",), with_line_info: bool = False
) -> DataFrame:
    """Files of diffs that are not deleted, with added and context lines as content.

    With ``with_line_info``, ``line_info`` holds each content line's ``new_line`` and
    ``is_added``.
    """
    info = "transform(kept, k -> named_struct('new_line', k.new_line, 'is_added', k.is_added))"
    return (
        _with_names(_file_parts(diffs, keys))
        .selectExpr(
            "key",
            "file_seq",
            "explode(filter(array(named_struct('path', path, 'status', status, 'hunks', hunks)), "
            "f -> f.status <> 'deleted')) AS f",
        )
        .selectExpr(
            "key",
            "file_seq",
            "f.path AS path",
            f"flatten(transform(f.hunks, hunk -> {_kept_lines()})) AS kept",
        )
        .selectExpr(
            *key_columns(keys), "file_seq", "path",
            f"{text.join_lines('kept.content')} AS content",
            *([f"{info} AS line_info"] if with_line_info else []),
        )
    )


def review_diffs(
    diffs: DataFrame, keys: Sequence[str] = ("diff_id",), map_lines: bool = False, **options
) -> DataFrame:
    """Findings of diffs. ``line`` counts the lines of the rebuilt content.

    ``map_lines`` adds ``new_line``, the line in the new file, and ``is_added``.
    """
    files = diff_review_files(diffs, keys, with_line_info=map_lines)
    return review(
        files,
        keys=(*keys, "file_seq"),
        line_info="line_info" if map_lines else None,
        **options,
    )
