"""Built-in rules that look ahead, look back or keep state down a file.

Each is one pass over the file's own arrays, so nothing is shuffled and the cost grows
with the number of lines, not with the distance between a construct's start and end. A
fold's state is copied at every line, so folds keep a small state and write what they find
as text, ``report,line;`` or ``line,line;``, from which the hits are made afterwards.
"""

from __future__ import annotations

from ..functions.folds import let, running_pieces, struct
from ..functions.text import (
    brace_delta,
    contains,
    extract,
    join_lines,
    literal,
    matches,
    spark_regex,
    trim,
)
from . import fixed_values as fv
from .model import CONTENT, FLAGS, LINES, TRIMMED_LINES, hit, no_hits

# One line inside the expressions below: ``l.lines``, ``l.trimmed``, ``l.flags``.
ALL_LINES = f"arrays_zip({LINES}, {TRIMMED_LINES}, {FLAGS})"
PLAIN = "l.flags = '0'"


def _each_line(**fields: str) -> str:
    """An array of structs with ``line`` and the given fields for every line ``l``."""
    return f"transform({ALL_LINES}, (l, i) -> {struct(line='i + 1', **fields)})"


def _number(place: int) -> str:
    """A number of a piece ``p`` that a fold wrote."""
    return f"CAST(split_part(p, ',', {place}) AS INT)"


def _hits(pieces: str, hit_of_piece: str) -> str:
    return f"transform({pieces}, p -> {hit_of_piece})"


# What each line does inside a catch body, and which catch heads it is.
CATCH_LINES = _each_line(
    closes="startswith(l.trimmed, '}')",
    logs=matches("l.trimmed", fv.LOG_CALL),
    idle="l.trimmed = '' OR startswith(l.trimmed, '//')",
    throws=f"startswith(l.trimmed, 'throw') AND {matches('l.trimmed', fv.BARE_THROW)}",
    ends_catch="l.trimmed = '}' OR startswith(l.trimmed, '} catch')",
    **{
        name: f"{PLAIN} AND contains(l.trimmed, 'catch') AND {matches('l.trimmed', pattern)}"
        for name, pattern in (
            ("empty", fv.CATCH_EMPTY),
            ("at_end", fv.CATCH_AT_END),
            ("opens", fv.CATCH_OPENS),
            ("generic", fv.CATCH_GENERIC),
        )
    },
)


def _catch_rule(state: dict[str, str], found: dict[int, str]) -> dict:
    """Walk a file from its last line to its first.

    ``state`` says what is known about the lines below a line, up to where its block
    closes; ``found`` uses it at a catch head, report by report, and the first one counts.
    ``acc`` is the state, false at first, and ``l`` the line.
    """

    def named(expression: str, state_name: str, line_name: str) -> str:
        return expression.replace("acc.", f"{state_name}.").replace("l.", f"{line_name}.")

    cases = " ".join(
        f"WHEN {when} THEN concat('{report},', l.line, ';')" for report, when in found.items()
    )
    pieces = running_pieces(
        "reverse(catch_lines)",
        struct(**dict.fromkeys(state, "false")),
        lambda acc, line: struct(**{k: named(v, acc, line) for k, v in state.items()}),
        lambda acc, line: named(f"CASE {cases} ELSE '' END", acc, line),
    )
    return dict(
        needs=contains(CONTENT, "catch"),
        shared=(("catch_lines", CATCH_LINES),),
        hits=_hits(pieces, hit(_number(1), _number(2))),
    )


EMPTY_CATCH = _catch_rule(
    {"next_ends": "l.ends_catch"}, {0: "l.empty", 1: "l.at_end AND acc.next_ends"}
)
CATCH_ONLY_LOGS = _catch_rule(
    {
        "logs": "NOT l.closes AND (acc.logs OR l.logs)",
        "works": "NOT l.closes AND (acc.works OR NOT (l.logs OR l.idle))",
    },
    {0: "l.opens AND acc.logs AND NOT acc.works"},
)
CATCH_RETHROW = _catch_rule(
    {"throws": "NOT l.closes AND (acc.throws OR l.throws)"}, {0: "l.generic AND acc.throws"}
)


def _async_rule() -> dict:
    """Async functions whose body awaits and never tries.

    Heads wait in ``pending`` until the brace depth is back where they began; whether a
    body awaits or tries is then read from the last line that did.
    """
    lines = _each_line(
        delta=brace_delta("l.lines"),
        opens="contains(l.lines, '{')",
        awaits=f"contains(l.lines, 'await') AND {matches('l.lines', fv.AWAIT)}",
        tries=f"contains(l.lines, 'try') AND {matches('l.lines', fv.TRY)}",
        head=f"{PLAIN} AND contains(l.trimmed, 'async') "
        f"AND {matches('l.trimmed', fv.ASYNC_FUNCTION)}",
    )

    def unhandled(heads: str, state: str) -> str:
        bad = (
            f"h.opened > 0 AND {state}.last_await >= h.opened AND {state}.last_try < h.opened"
        )
        return (
            f"array_join(transform(filter({heads}, h -> {bad}), h -> concat(h.line, ';')), '')"
        )

    def step(acc: str, line: str) -> str:
        counts = dict(
            depth=f"{acc}.depth + {line}.delta",
            last_await=f"if({line}.awaits, {line}.line, {acc}.last_await)",
            last_try=f"if({line}.tries, {line}.line, {acc}.last_try)",
        )
        new_head = struct(line=f"{line}.line", base=f"{acc}.depth", opened="0")
        waiting = f"if({line}.head, array_append({acc}.pending, {new_head}), {acc}.pending)"
        first_open = struct(
            line="h.line", base="h.base", opened=f"if(h.opened > 0, h.opened, {line}.line)"
        )
        opened = f"if({line}.opens, transform({waiting}, h -> {first_open}), {waiting})"
        closed = "h.opened > 0 AND h.base = now.depth"
        settled = struct(
            depth="now.depth",
            last_await="now.last_await",
            last_try="now.last_try",
            pending=f"filter(now.pending, h -> NOT ({closed}))",
            done=unhandled(f"filter(now.pending, h -> {closed})", "now"),
        )
        quiet = struct(**counts, pending=f"{acc}.pending", done="''")
        return (
            f"if({line}.head OR size({acc}.pending) > 0, "
            f"{let('now', struct(**counts, pending=opened), settled)}, {quiet})"
        )

    start = struct(
        depth="0",
        last_await="0",
        last_try="0",
        pending="CAST(array() AS ARRAY<STRUCT<line:INT,base:INT,opened:INT>>)",
        done="''",
    )
    # A step leaves in ``done`` what it found; the next step or the end writes it.
    pieces = running_pieces(
        lines,
        start,
        step,
        lambda acc, line: f"{acc}.done",
        lambda acc: f"concat({acc}.done, {unhandled(f'{acc}.pending', acc)})",
    )
    return dict(
        needs=f"contains({CONTENT}, 'async') AND contains({CONTENT}, 'await') "
        f"AND contains({CONTENT}, '{{')",
        hits=_hits(pieces, hit(0, _number(1))),
    )


def starts_function(trimmed: str) -> str:
    """A line that begins a function, by keyword, by assignment or as a method.

    The method form is checked in two steps, the head and then the words before the
    method's name, so that no pattern repeats a group over long runs of words.
    """
    last_word = literal(spark_regex(r"(?<!\w)\w++\s*+\z"))
    modifiers = literal(spark_regex(fv.METHOD_MODIFIER))
    method = let(
        "head",
        extract(trimmed, fv.METHOD_HEAD),
        f"{matches('head', r'\w')} AND "
        + let(
            "before",
            f"regexp_replace(head, {last_word}, '')",
            let(
                "rest",
                f"regexp_replace(before, {modifiers}, '')",
                f"rest = '' OR (rest = 'async' AND {matches('before', r'async\s+\z')})",
            ),
        ),
    )
    return (
        f"({matches(trimmed, fv.FUNCTION_KEYWORD)} OR {matches(trimmed, fv.FUNCTION_VARIABLE)} "
        f"OR {matches(trimmed, fv.PY_FUNCTION)} OR (contains({trimmed}, '(') AND {method}))"
    )


def function_name(trimmed: str) -> str:
    def found(pattern: str) -> str:
        return f"nullif({extract(trimmed, pattern)}, '')"

    return f"coalesce({found(fv.NAMED_FUNCTION)}, {found(fv.NAME_BEFORE)}, '{fv.ANONYMOUS}')"


def _long_function_rule() -> dict:
    lines = _each_line(trimmed="l.trimmed", delta=brace_delta("l.lines"))

    def step(acc: str, line: str) -> str:
        start = (
            f"CASE WHEN {acc}.start > 0 THEN {acc}.start "
            f"WHEN {starts_function(f'{line}.trimmed')} THEN {line}.line ELSE 0 END"
        )
        depth = f"if({acc}.start > 0, {acc}.depth + {line}.delta, {line}.delta)"
        ends = f"(now.start > 0 AND {line}.line > now.start AND now.depth <= 0)"
        is_long = f"{line}.line - now.start + 1 > {fv.MAX_FUNCTION_LINES}"
        settled = struct(
            start=f"if({ends}, 0, now.start)",
            depth="now.depth",
            done=f"if({ends} AND {is_long}, concat(now.start, ',', {line}.line, ';'), '')",
        )
        return let("now", struct(start=start, depth=depth), settled)

    pieces = running_pieces(
        lines,
        struct(start="0", depth="0", done="''"),
        step,
        lambda acc, line: f"{acc}.done",
        lambda acc: f"{acc}.done",
    )
    found = hit(
        0,
        _number(1),
        end_line=_number(2),
        arg1=function_name(f"{TRIMMED_LINES}[{_number(1)} - 1]"),
        arg2=f"{_number(2)} - {_number(1)} + 1",
    )
    return dict(
        # As many line ends as lines a short function may have, or more.
        needs=f"octet_length(substring_index({CONTENT}, '\\n', {fv.MAX_FUNCTION_LINES})) "
        f"< octet_length({CONTENT})",
        has_snippet=False,
        hits=_hits(pieces, found),
    )


def _unused_import_rule() -> dict:
    skipped = " OR ".join(
        matches("l.trimmed", p) for p in (fv.TYPE_IMPORT, fv.STAR_IMPORT, fv.BARE_IMPORT)
    )
    named = (
        f"l.plain AND startswith(l.trimmed, 'import') "
        f"AND {matches('l.trimmed', fv.NAMED_IMPORT)} AND NOT ({skipped})"
    )
    # The name after ``as`` where there is one.
    pieces = f"split({trim('part')}, {literal(spark_regex(fv.IMPORT_ALIAS))})"
    local = trim(f"coalesce(get({pieces}, 1), get({pieces}, 0))")
    listed = f"split({extract('l.trimmed', fv.NAMED_IMPORT)}, ',')"
    names = (
        f"flatten(transform(filter({_each_line(trimmed='l.trimmed', plain=PLAIN)}, "
        f"l -> {named}), l -> transform(filter(transform({listed}, part -> {local}), "
        f"name -> name <> ''), (name, i) -> {struct(line='l.line', seq='i', name='name')})))"
    )
    rest = join_lines(f"filter({TRIMMED_LINES}, l -> NOT startswith(l, 'import '))")

    # Plain words are looked up among the words of the code. For other names a word
    # boundary needs a word on exactly one side of the name's first and last character.
    quoted = r"concat('\\Q', replace(n.name, '\\E', '\\E\\\\E\\Q'), '\\E')"
    before = r"if(rlike(n.name, '^\\w'), '(?<!\\w)', '(?<=\\w)')"
    after = r"if(rlike(n.name, '\\w\\z'), '(?!\\w)', '(?=\\w)')"
    is_unused = (
        r"if(rlike(n.name, '^\\w+\\z'), array_contains(words, n.name), "
        f"NOT rlike(code, concat({before}, {quoted}, {after})))"
    )
    unused_words = (
        r"array_except(transform(names, n -> n.name), regexp_extract_all(code, '(\\w+)'))"
    )
    unused = let("words", unused_words, f"filter(names, n -> {is_unused})")
    found = f"transform({unused}, n -> {hit(0, 'n.line', 'n.seq', arg1='n.name')})"
    return dict(
        needs=f"rlike({CONTENT}, 'import[^\\n]*\\\\{{')",
        hits=let(
            "names", names, f"if(size(names) > 0, {let('code', rest, found)}, {no_hits()})"
        ),
    )


def _duplicate_condition_rule() -> dict:
    def condition(pattern: str) -> str:
        matched = f"{PLAIN} AND {matches('l.trimmed', pattern)}"
        return f"if({matched}, {trim(extract('l.trimmed', pattern))}, NULL)"

    lines = _each_line(
        if_condition=f"if(startswith(l.trimmed, 'if'), {condition(fv.IF_LINE)}, NULL)",
        else_condition=f"if(contains(l.trimmed, 'else'), {condition(fv.ELSE_IF_LINE)}, NULL)",
    )

    def emit(acc: str, line: str) -> str:
        same = f"coalesce({line}.else_condition = {acc}.condition, false)"
        return f"if({same}, concat({line}.line, ',', {acc}.line, ';'), '')"

    with_condition = "l.if_condition IS NOT NULL OR l.else_condition IS NOT NULL"
    pieces = running_pieces(
        f"filter({lines}, l -> {with_condition})",
        struct(condition="CAST(NULL AS STRING)", line="0"),
        lambda acc, line: struct(
            condition=f"coalesce({line}.if_condition, {acc}.condition)",
            line=f"if({line}.if_condition IS NULL, {acc}.line, {line}.line)",
        ),
        emit,
    )
    condition_text = trim(extract(f"{TRIMMED_LINES}[{_number(1)} - 1]", fv.ELSE_IF_LINE))
    return dict(
        needs=f"contains({CONTENT}, 'else') AND contains({CONTENT}, 'if')",
        hits=_hits(pieces, hit(0, _number(1), arg1=condition_text, arg2=_number(2))),
    )


# rule -> how it is run; metadata and texts come from the fixed values.
FILE_RULES = {
    "ERR001": EMPTY_CATCH,
    "ERR002": CATCH_ONLY_LOGS,
    "ERR004": CATCH_RETHROW,
    "ERR005": _async_rule(),
    "QA005": _long_function_rule(),
    "QA006": _unused_import_rule(),
    "QA007": _duplicate_condition_rule(),
}
