"""Text helpers: trimming, line splitting, language and file kind.

Helpers take and give Spark SQL expressions as text. A review has some thousand small
expressions; as text, each column is parsed once instead of built call by call.
"""

from __future__ import annotations

# The white space that trimming and ``\s`` cover.
WHITESPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Extension -> language, for the reviewer.
REVIEW_LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript",
    ".js": "javascript", ".jsx": "javascript",
    ".py": "python", ".rs": "rust", ".go": "go",
    ".java": "java", ".rb": "ruby", ".php": "php",
    ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp",
    ".cs": "csharp", ".swift": "swift", ".kt": "kotlin",
}

# What the block extractor knows on top of the reviewer's languages.
PARSER_LANGUAGES = {
    **REVIEW_LANGUAGES,
    ".sh": "shell", ".bash": "shell", ".zsh": "shell",
    ".yml": "yaml", ".yaml": "yaml", ".json": "json", ".md": "markdown",
    ".css": "css", ".scss": "scss", ".html": "html", ".sql": "sql",
}

# Path fragments that mark tests and configuration.
TEST_PATH_PARTS = (".test.", ".spec.", "__tests__")
CONFIG_PATH_PARTS = (".config.", "config/")

UNKNOWN = "unknown"

RARE_SPACE = r"\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
RARE_SPACE_CLASS = f"[{RARE_SPACE}]"
SPACE_CLASS = rf"[\s{RARE_SPACE}]"
ANY_CLASS = r"[^\n\r\u2028\u2029]"


def literal(value: str | None) -> str:
    """A SQL string literal."""
    if value is None:
        return "CAST(NULL AS STRING)"
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    shown = "".join(c if c.isprintable() else f"\\u{ord(c):04x}" for c in escaped)
    # A dollar and a brace together would be taken for a variable.
    return "'" + shown.replace("${", "\\u0024{") + "'"


def spark_regex(pattern: str) -> str:
    """Give a pattern ECMAScript meaning under ``java.util.regex``.

    ``\\s`` covers Unicode space, ``\\b`` looks at ASCII word characters only and a
    repeated dot stops at the four ECMAScript line ends. End anchors are written
    ``\\z`` in the patterns, because ``$`` also matches before a final line end.
    """
    return (
        pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")
        .replace(r"\s", SPACE_CLASS)
        .replace(".*", ANY_CLASS + "*")
        .replace(".+", ANY_CLASS + "+")
    )


def matches(value: str, pattern: str) -> str:
    return f"rlike({value}, {literal(spark_regex(pattern))})"


def extract(value: str, pattern: str, group: int = 1) -> str:
    """First match's group; the empty string where nothing matches."""
    return f"regexp_extract({value}, {literal(spark_regex(pattern))}, {group})"


def chained(operator: str, parts) -> str:
    """Many operands of one associative operator as a balanced tree, so that it is not deep.

    Plans are sent to tasks by a serializer that goes down a tree with its stack.
    """
    parts = list(parts)
    if len(parts) < 3:
        return "(" + f" {operator} ".join(parts) + ")"
    half = len(parts) // 2
    return f"({chained(operator, parts[:half])} {operator} {chained(operator, parts[half:])})"


def any_of(tests) -> str:
    return "(" + " OR ".join(tests) + ")"


def contains(value: str, needle: str) -> str:
    return f"contains({value}, {literal(needle)})"


def contains_any(value: str, needles) -> str:
    return any_of(contains(value, needle) for needle in needles)


def starts_with(value: str, *prefixes: str) -> str:
    return any_of(f"startswith({value}, {literal(prefix)})" for prefix in prefixes)


def ends_with(value: str, *suffixes: str) -> str:
    return any_of(f"endswith({value}, {literal(suffix)})" for suffix in suffixes)


def one_of(value: str, choices) -> str:
    return f"{value} IN ({', '.join(literal(choice) for choice in choices)})"


def trim(value: str) -> str:
    return f"trim(BOTH {literal(WHITESPACE)} FROM {value})"


def trim_start(value: str) -> str:
    return f"trim(LEADING {literal(WHITESPACE)} FROM {value})"


def split_lines(content: str) -> str:
    """Lines of a text. Empty text is one empty line; a final newline adds one."""
    return f"split({content}, '\\n')"


def join_lines(lines: str) -> str:
    return f"array_join({lines}, '\\n')"


def brace_delta(value: str) -> str:
    """Opening minus closing braces."""
    return f"(length(replace({value}, '}}', '')) - length(replace({value}, '{{', '')))"


def odd_backticks(value: str) -> str:
    """Odd number of backticks that no backslash precedes."""
    count = f"regexp_count({value}, {literal(r'(?<!\\)`')})"
    return f"(contains({value}, '`') AND {count} % 2 = 1)"


def _by_extension(path: str, languages: dict[str, str]) -> str:
    table = "map(" + ", ".join(literal(v) for pair in languages.items() for v in pair) + ")"
    known = f"try_element_at({table}, concat('.', substring_index({path}, '.', -1)))"
    return (
        f"CASE WHEN contains({path}, '.') THEN coalesce({known}, '{UNKNOWN}') "
        f"ELSE '{UNKNOWN}' END"
    )


def detect_language(path: str) -> str:
    """Language for review, by the case-sensitive extension after the last dot."""
    return _by_extension(path, REVIEW_LANGUAGES)


def detect_language_full(path: str) -> str:
    """Language for block extraction: the review languages and a few more."""
    return _by_extension(path, PARSER_LANGUAGES)


def detect_file_type(path: str) -> str:
    """test, config, migration, generated or source; the first that fits wins."""
    lower = f"lower({path})"
    config = [contains_any(lower, (*CONFIG_PATH_PARTS, ".env"))]
    config.append(ends_with(lower, ".rc", "rc.ts", "rc.js"))
    return (
        f"CASE WHEN {contains_any(lower, TEST_PATH_PARTS)} THEN 'test' "
        f"WHEN {any_of(config)} THEN 'config' "
        f"WHEN {contains_any(lower, ('migration', 'migrate'))} THEN 'migration' "
        f"WHEN {contains_any(lower, ('.generated.', '.gen.'))} THEN 'generated' "
        "ELSE 'source' END"
    )


def is_test_path(path: str) -> str:
    """Case-sensitive, unlike the ``test`` file type."""
    return contains_any(path, TEST_PATH_PARTS)


def is_config_path(path: str) -> str:
    return contains_any(path, CONFIG_PATH_PARTS)
