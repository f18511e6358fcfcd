"""Code blocks: top-level braces, and Python functions and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import folds, text
from .context import key_columns, keyed, known_keys

# Languages whose blocks are braces, and what opens a Python block.
BRACE_LANGUAGES = (
    "typescript", "javascript", "java", "csharp", "go", "rust", "cpp", "c", "swift",
    "kotlin", "php",
)
INDENT_LANGUAGES = ("python",)
INDENT_START = r"^(?:def |class |async def )"


def _brace_spans() -> str:
    """``start,end`` of every top-level brace pair; the fold runs over braces only."""
    braces = """flatten(transform(transform(lines, l -> regexp_replace(l, '[^{}]+', '')),
        (found, i) -> if(found = '', CAST(array() AS ARRAY<STRUCT<line:INT,delta:INT>>),
          transform(split(found, ''), b -> named_struct('line', i + 1, 'delta', if(b = '{', 1, -1)))
        )))"""

    def step(state: str, brace: str) -> str:
        opens = f"{state}.depth = 0 AND {brace}.delta > 0"
        return folds.struct(
            depth=f"{state}.depth + {brace}.delta",
            start=f"if({opens}, {brace}.line, {state}.start)",
        )

    def emit(state: str, brace: str) -> str:
        closes = f"{state}.depth = 1 AND {brace}.delta < 0"
        return f"if({closes}, concat({state}.start, ',', {brace}.line, ';'), '')"

    return folds.running_pieces(braces, folds.struct(depth="0", start="0"), step, emit)


def _indent_spans() -> str:
    """``start,end`` of every function or class; a new one ends the one before."""
    items = (
        "transform(lines, (l, i) -> "
        + folds.let(
            "code",
            text.trim_start("l"),
            folds.struct(
                line="i + 1",
                indent="length(l) - length(code)",
                blank="code = ''",
                starts=text.matches("code", INDENT_START),
            ),
        )
        + ")"
    )

    def leaves(state: str, item: str) -> str:
        outside = f"NOT {item}.blank AND {item}.indent <= {state}.base"
        return f"({state}.start > 0 AND ({item}.starts OR ({outside})))"

    def step(state: str, item: str) -> str:
        return folds.struct(
            start=f"CASE WHEN {item}.starts THEN {item}.line WHEN {leaves(state, item)} THEN 0 "
            f"ELSE {state}.start END",
            base=f"if({item}.starts, {item}.indent, {state}.base)",
        )

    def emit(state: str, item: str) -> str:
        return f"if({leaves(state, item)}, concat({state}.start, ',', {item}.line - 1, ';'), '')"

    def at_end(state: str) -> str:
        return f"if({state}.start > 0, concat({state}.start, ',', size(lines)), '')"

    return folds.running_pieces(items, folds.struct(start="0", base="0"), step, emit, at_end)


_KINDS = {
    "brace": (BRACE_LANGUAGES, "contains(content, '{')", _brace_spans),
    "indent": (INDENT_LANGUAGES, text.contains_any("content", ("def ", "class ")), _indent_spans),
}


def _blocks(files: DataFrame, kinds: tuple[str, ...], keys) -> DataFrame:
    """Blocks of the kinds, in one pass: a file's language says how its spans are found."""
    keys = known_keys(files, keys)
    chosen = [_KINDS[kind] for kind in kinds]
    wanted = text.any_of(f"({text.one_of('language', names)} AND {marker})" for names, marker, _ in chosen)
    cases = " ".join(f"WHEN {text.one_of('language', names)} THEN {spans()}" for names, _, spans in chosen)
    # Content is cut out before the rows multiply, so a row carries its own block only.
    cut = f"""transform(transform(CASE {cases} END, s -> CAST(split(s, ',') AS ARRAY<INT>)),
        b -> named_struct('start_line', b[0], 'end_line', b[1],
          'content', {text.join_lines('slice(lines, b[0], b[1] - b[0] + 1)')}))"""
    return (
        keyed(files, keys)
        .selectExpr("*", f"{text.detect_language_full('path')} AS language")
        .where(wanted)
        .selectExpr("key", "path", "language", f"{text.split_lines('content')} AS lines")
        .selectExpr("key", "path", "language", f"posexplode({cut}) AS (block_seq, block)")
        .selectExpr(
            *key_columns(keys), "path", "language", "block_seq",
            "block.start_line", "block.end_line", "block.content",
        )
    )


def brace_blocks(files: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    return _blocks(files, ("brace",), keys)


def indent_blocks(files: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    return _blocks(files, ("indent",), keys)


def code_blocks(files: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Blocks of every language that has them."""
    return _blocks(files, ("brace", "indent"), keys)
