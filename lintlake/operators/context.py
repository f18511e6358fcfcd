"""Line context: which lines are comments, string content, imports or blank.

The comment and string states run down a file, so they are folded inside the file's row.
Each line becomes one packed transition table and the fold only looks states up in it;
files that hold no multi-line marker at all skip the fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import folds, text

# Line flags, one character per line.
PLAIN, COMMENT, STRING = "0", "1", "2"

# States between lines.
NORMAL, BLOCK, DOCSTRING, TEMPLATE, BLOCK_IN_TEMPLATE = range(5)

_STATE_BITS = 3
_FLAG_BITS = 2
_FLAG_SHIFT = 16

DOC_QUOTES = ('"""', "'''")
LINE_COMMENTS = ("//", "#")


def _transitions(language: str) -> str:
    """Next state for every state, then the flag for every state, of line ``l``.

    ``s`` is the line without leading white space.
    """
    block_end = "contains(l, '*/')"
    block_open = f"contains(l, '/*') AND NOT {block_end}"
    doc_end = text.contains_any("l", DOC_QUOTES)
    odd = text.odd_backticks("l")
    comment = text.starts_with("s", *LINE_COMMENTS)
    block_start = "startswith(s, '/*')"
    doc_start = f"({language} = 'python' AND {text.starts_with('s', *DOC_QUOTES)})"
    doc_closes = text.contains_any("substring(s, 4)", DOC_QUOTES)
    block_stays = f"(NOT {block_end} OR endswith({text.trim('s')}, '/*'))"

    next_states = {
        NORMAL: f"""CASE WHEN {comment} THEN {NORMAL}
            WHEN {block_start} THEN if({block_stays}, {BLOCK}, {NORMAL})
            WHEN {doc_start} THEN if({doc_closes}, {NORMAL}, {DOCSTRING})
            WHEN {block_open} THEN if({odd}, {BLOCK_IN_TEMPLATE}, {BLOCK})
            WHEN {odd} THEN {TEMPLATE} ELSE {NORMAL} END""",
        BLOCK: f"if({block_end}, {NORMAL}, {BLOCK})",
        DOCSTRING: f"if({doc_end}, {NORMAL}, {DOCSTRING})",
        TEMPLATE: f"if({odd}, {NORMAL}, {TEMPLATE})",
        BLOCK_IN_TEMPLATE: f"if({block_end}, {TEMPLATE}, {BLOCK_IN_TEMPLATE})",
    }
    flags = {
        NORMAL: f"""CASE WHEN {comment} OR {block_start} OR {doc_start} THEN {COMMENT}
            WHEN {odd} THEN {STRING} ELSE {PLAIN} END""",
        BLOCK: COMMENT,
        DOCSTRING: COMMENT,
        TEMPLATE: STRING,
        BLOCK_IN_TEMPLATE: COMMENT,
    }
    parts = [f"({v}) * {1 << (_STATE_BITS * at)}" for at, v in next_states.items()]
    parts += [f"({v}) * {1 << (_FLAG_SHIFT + _FLAG_BITS * at)}" for at, v in flags.items()]
    # Most lines hold none of the markers: they keep every state.
    quiet = sum(state << (_STATE_BITS * state) for state in range(5))
    quiet += sum(
        int(flags[at]) << (_FLAG_SHIFT + _FLAG_BITS * at) for at in flags if at != NORMAL
    )
    markers = text.contains_any("l", ("/*", "*/", "`", *DOC_QUOTES))
    plain = f"{quiet} + if({comment}, {int(COMMENT) << _FLAG_SHIFT}, 0)"
    return folds.let("s", text.trim_start("l"), f"if({markers}, {text.chained('+', parts)}, {plain})")


def line_flags(content: str, lines: str, language: str) -> str:
    """Array of :data:`PLAIN`, :data:`COMMENT` or :data:`STRING`, one per line."""
    in_python = f"({language} = 'python' AND {text.contains_any(content, DOC_QUOTES)})"
    has_regions = f"({text.contains_any(content, ('/*', '`'))} OR {in_python})"
    folded = flags_from(str(NORMAL), lines, language)
    comment = text.starts_with(text.trim_start("l"), *LINE_COMMENTS)
    alone = f"transform({lines}, l -> if({comment}, '{COMMENT}', '{PLAIN}'))"
    return f"if({has_regions}, {folded}, {alone})"


def flags_from(state: str, lines: str, language: str) -> str:
    """Flags of lines that are entered in a state."""
    folded = folds.running_text(
        f"transform({lines}, l -> {_transitions(language)})",
        state,
        state_behind,
        lambda state, table: (
            f"CAST(shiftright({table}, {_FLAG_SHIFT} + {state} * {_FLAG_BITS}) & 3 AS STRING)"
        ),
    )
    return f"split({folded}, '')"


def state_behind(state: str, table: str) -> str:
    """The state that a table of transitions leads to."""
    return f"(shiftright({table}, {state} * {_STATE_BITS}) & 7)"


def joined_tables(first: str, second: str) -> str:
    """The table of transitions of two stretches of lines, one after the other."""
    parts = (
        f"shiftleft({state_behind(state_behind(str(state), first), second)}, {state * _STATE_BITS})"
        for state in range(5)
    )
    return text.chained("+", parts)


def table_of(lines: str, language: str) -> str:
    """The table of transitions of all lines together."""
    keep = sum(state << (_STATE_BITS * state) for state in range(5))
    return (
        f"aggregate(transform({lines}, l -> {_transitions(language)}), {keep}, "
        f"(one, next) -> {joined_tables('one', 'next')})"
    )


def no_flags(lines: str) -> str:
    """Flags that suppress nothing, for rules run without context."""
    return f"transform({lines}, l -> '{PLAIN}')"


def with_lines(files: DataFrame, use_context: bool = True, only: str = "true") -> DataFrame:
    """Add ``language``, ``lines`` and ``flags`` to a (path, content) table.

    Lines and flags are NULL where ``only`` is false.
    """
    lined = files.selectExpr(
        "*",
        f"{text.detect_language('path')} AS language",
        f"if({only}, {text.split_lines('content')}, NULL) AS lines",
    )
    flags = line_flags("content", "lines", "language") if use_context else no_flags("lines")
    return lined.selectExpr("*", f"if({only}, {flags}, NULL) AS flags")


def keyed(files: DataFrame, keys) -> DataFrame:
    """``path``, ``content`` and the keys as one struct, out of the way of other names."""
    key = F.struct(*keys) if keys else F.lit(None).cast("void")
    return files.select(key.alias("key"), "path", "content")


def key_columns(keys) -> list[str]:
    return [f"key.`{name}`" for name in keys]


def known_keys(files: DataFrame, keys) -> tuple[str, ...]:
    """The keys asked for; by default ``file_seq`` where the table has it."""
    if keys is not None:
        return tuple(keys)
    return ("file_seq",) if "file_seq" in files.columns else ()


def lines(files: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """One row per line, numbered from 1, without context."""
    keys = known_keys(files, keys)
    return (
        keyed(files, keys)
        .selectExpr("key", "path", f"posexplode({text.split_lines('content')}) AS (pos, text)")
        .selectExpr(*key_columns(keys), "path", "pos + 1 AS line", "text")
    )


def _is_import(flag: str, trimmed: str) -> str:
    # How an import line starts, or what it contains.
    starts = text.starts_with(trimmed, "import ", "import(", "from ")
    return f"({flag} <> '{COMMENT}' AND {trimmed} <> '' AND ({starts} OR contains({trimmed}, 'require(')))"


def line_context(files: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """One row per line with ``is_comment``, ``is_string``, ``is_import``, ``is_blank``."""
    keys = known_keys(files, keys)
    rows = with_lines(keyed(files, keys)).selectExpr(
        "key", "path", "posexplode(arrays_zip(lines, flags)) AS (pos, l)"
    )
    return context_rows(rows, [*key_columns(keys), "path"], "pos + 1")


def context_rows(rows: DataFrame, named: list[str], line: str) -> DataFrame:
    """The columns of :func:`line_context` from a row per line ``l`` with its flag."""
    return rows.selectExpr("*", f"{text.trim('l.lines')} AS trimmed").selectExpr(
        *named,
        f"{line} AS line",
        "l.lines AS text",
        f"l.flags = '{COMMENT}' AS is_comment",
        f"l.flags = '{STRING}' AS is_string",
        f"{_is_import('l.flags', 'trimmed')} AS is_import",
        "trimmed = '' AS is_blank",
    )


def imports(files: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Modules named on import lines, in line order, duplicates kept.

    Files without a sign of an import are not split, and only modules become rows.
    """
    keys = known_keys(files, keys)
    # Where a module's name stands, first hit wins.
    quoted_from = r"""from\s+['"]([^'"]+)['"]"""
    required = r"""require\(\s*['"]([^'"]+)['"]\s*\)"""
    plain_import = r"^import\s+(\w+)"
    plain_from = r"^from\s+(\w+)"

    def hit(pattern: str) -> str:
        return f"nullif({text.extract('l.trimmed', pattern)}, '')"

    module = (
        f"coalesce({hit(quoted_from)}, {hit(required)}, "
        f"if(contains(l.trimmed, 'from') OR contains(l.trimmed, '{{'), NULL, {hit(plain_import)}), "
        f"{hit(plain_from)})"
    )
    numbered = f"named_struct('line', i + 1, 'flag', l.flags, 'trimmed', {text.trim('l.lines')})"
    found = f"filter(transform(arrays_zip(lines, flags), (l, i) -> {numbered}), l -> {_is_import('l.flag', 'l.trimmed')})"
    named = f"transform({found}, l -> named_struct('line', l.line, 'module', {module}))"
    marks = text.contains_any("content", ("import", "from ", "require("))
    return (
        with_lines(keyed(files, keys).where(marks))
        .selectExpr("key", "path", f"explode(filter({named}, m -> m.module IS NOT NULL)) AS m")
        .selectExpr(*key_columns(keys), "path", "m.line AS line", "m.module AS module")
    )


def import_module_counts(files: DataFrame) -> DataFrame:
    """How often each module is imported over the corpus."""
    return imports(files, keys=()).groupBy("module").agg(F.count("*").alias("imports"))


CONTINUES = r"^(?:catch|finally)\b"


def code_lines(before: str = "0") -> str:
    """Lines that are not blank, numbered after the ``before`` lines of earlier chunks."""
    return f"""filter(transform(arrays_zip(lines, flags), (l, i) -> named_struct(
        'line', {before} + i + 1, 'trimmed', {text.trim('l.lines')}, 'plain', l.flags = '{PLAIN}')),
        l -> l.trimmed <> '')"""


def try_events(behind: str = "false") -> str:
    """What the plain lines of ``code`` do to a region; ``behind`` is about the line after the last.

    A following line that starts with catch or finally keeps the region open, whether or not
    that line is a comment's or a string's.
    """
    follows = text.matches("get(code, i + 1).trimmed", CONTINUES)
    return f"""filter(transform(code, (l, i) -> named_struct(
        'line', l.line, 'plain', l.plain, 'delta', {text.brace_delta('l.trimmed')},
        'opens', l.plain AND {text.matches('l.trimmed', r'\btry\s*\{')},
        'continues', if(i + 1 < size(code), {follows}, {behind}))), l -> l.plain)"""


def _ends(state: str, item: str) -> str:
    return f"({state}.start > 0 AND {state}.depth + {item}.delta = 0 AND NOT {item}.continues)"


def after_event(state: str, item: str) -> str:
    """The state of try regions behind an event: start line (0: outside) and depth."""
    begins = f"({state}.start = 0 AND {item}.opens)"
    return folds.struct(
        start=f"CASE WHEN {begins} THEN {item}.line WHEN {_ends(state, item)} THEN 0 "
        f"ELSE {state}.start END",
        depth=f"if({begins}, {item}.delta, {state}.depth + {item}.delta)",
    )


def region_end(state: str, item: str) -> str:
    return f"if({_ends(state, item)}, concat({state}.start, ',', {item}.line, ';'), '')"


def try_regions(files: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Start and end line of every outermost ``try`` region."""
    keys = known_keys(files, keys)
    regions = folds.running_pieces(
        "events",
        folds.struct(start="0", depth="0"),
        after_event,
        region_end,
        lambda state: f"if({state}.start > 0, concat({state}.start, ',', size(lines)), '')",
    )
    return (
        with_lines(keyed(files, keys).where("contains(content, 'try')"))
        .selectExpr("key", "path", "lines", f"{code_lines()} AS code")
        .selectExpr("key", "path", "lines", f"{try_events()} AS events")
        .selectExpr("key", "path", f"explode({regions}) AS region")
        .selectExpr(
            *key_columns(keys),
            "path",
            "CAST(split_part(region, ',', 1) AS INT) AS start_line",
            "CAST(split_part(region, ',', 2) AS INT) AS end_line",
        )
    )
