"""Context, try regions and brace blocks of files too long for a row.

The input is a table of lines. Lines are put together in chunks of a fixed number of lines, so
that a long file is worked on by many tasks. What runs down a file goes from chunk to chunk by a
prefix scan of summaries: comment and string state as a table of five states, braces as sums,
try regions as the net depth with the places where a depth first comes back to zero.

Lines of a file are numbered from 1 without gaps; a file is known by its keys and path, nulls
being values like any other. No lines, no rows. Results equal those of the operators on whole files,
but that a block's content, which may be longer than a row, is left in the line table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import folds, scans, text
from . import context
from .blocks import BRACE_LANGUAGES

CHUNK_LINES = 4096


def chunks(lines: DataFrame, keys: tuple[str, ...] = (), size: int = CHUNK_LINES) -> DataFrame:
    """``(file, chunk, lines)``: the lines of each stretch of ``size`` lines, in order."""
    spot = lines.select(
        F.struct(*keys, "path").alias("file"),
        F.expr(f"CAST((line - 1) DIV {size} AS INT)").alias("chunk"),
        F.struct("line", F.coalesce("text", F.lit("")).alias("text")).alias("item"),
    )
    held = spot.groupBy("file", "chunk").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return _kept(held.selectExpr("file", "chunk", "items[0].line - 1 AS before", "items.text AS lines"))


def _kept(df: DataFrame) -> DataFrame:
    """df, made once and kept with its partitioning if the session has a folder for checkpoints.

    Scans read chunks several times; without a folder each of them shuffles the lines anew.
    """
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def _with_flags(chunked: DataFrame) -> DataFrame:
    language = text.detect_language("file.path")
    tables = chunked.selectExpr("file", "chunk", f"{context.table_of('lines', language)} AS summary")
    states = scans.states_before(
        tables, str(context.NORMAL), context.joined_tables, context.state_behind
    )
    entered = chunked.join(states, ["file", "chunk"])
    return entered.selectExpr(
        "file", "chunk", "before", "lines", f"{context.flags_from('state', 'lines', language)} AS flags"
    )


def _file_columns(keys) -> list[str]:
    return [f"file.`{name}`" for name in (*keys, "path")]


def line_context_of_lines(
    lines: DataFrame, keys: tuple[str, ...] = (), size: int = CHUNK_LINES
) -> DataFrame:
    """:func:`line_context` of a ``(keys, path, line, text)`` table."""
    flagged = _with_flags(chunks(lines, keys, size))
    rows = flagged.selectExpr("file", "before", "posexplode(arrays_zip(lines, flags)) AS (pos, l)")
    return context.context_rows(rows, _file_columns(keys), "before + pos + 1")


_NO_REGION = folds.struct(start="0", depth="0")


def _behind(summary: str, state: str) -> str:
    """The state of try regions behind a chunk: outside, at a depth known to close, or deeper in."""
    deeper = folds.struct(start=f"{state}.start", depth=f"{state}.depth + {summary}.net")
    return (
        f"if({state}.start = 0, {summary}.outside, "
        f"coalesce(try_element_at({summary}.closes, {state}.depth), {deeper}))"
    )


def _joined_regions(first: str, second: str) -> str:
    """One summary of two neighbours; what closes in the first no longer matters to the second."""
    later = (
        f"transform_keys(map_filter({second}.closes, (d, s) -> "
        f"NOT map_contains_key({first}.closes, d - {first}.net)), (d, s) -> d - {first}.net)"
    )
    sooner = f"transform_values({first}.closes, (d, s) -> {_behind(second, 's')})"
    return folds.struct(
        net=f"{first}.net + {second}.net",
        outside=_behind(second, f"{first}.outside"),
        closes=f"map_concat({sooner}, {later})",
    )


def _region_summary(events: str) -> str:
    """Net depth, the state behind for an entry outside, and for each depth that closes inside."""
    none = f"map_filter(map(0, {_NO_REGION}), (d, s) -> false)"
    one = folds.struct(
        net="e.delta",
        outside=f"if(e.opens, {folds.struct(start='e.line', depth='e.delta')}, {_NO_REGION})",
        closes=f"if(e.continues, {none}, map(-e.delta, {_NO_REGION}))",
    )
    nothing = folds.struct(net="0", outside=_NO_REGION, closes=none)
    return (
        f"aggregate(transform({events}, e -> {one}), {nothing}, "
        f"(one, next) -> {_joined_regions('one', 'next')})"
    )


def try_regions_of_lines(
    lines: DataFrame, keys: tuple[str, ...] = (), size: int = CHUNK_LINES
) -> DataFrame:
    """:func:`try_regions` of a ``(keys, path, line, text)`` table.

    A chunk's summary has an entry for each depth that closes in it, so it is as large as code
    is nested; where braces are never closed, as large as there are such braces.
    """
    chunked = chunks(lines, keys, size)
    first = f"get(filter(transform(lines, l -> {text.trim('l')}), t -> t <> ''), 0)"
    heads = chunked.selectExpr("file", "chunk", f"{text.matches(first, context.CONTINUES)} AS summary")
    behind = scans.states_before(
        heads,
        folds.struct(last="true", follows="false"),
        lambda nearer, farther: f"coalesce({farther}, {nearer})",
        lambda state, head: folds.struct(last="false", follows=f"coalesce({head}, {state}.follows)"),
        backwards=True,
    ).withColumnRenamed("state", "behind")
    events = (
        _with_flags(chunked)
        .join(behind, ["file", "chunk"])
        .selectExpr(
            "file", "chunk", "behind", "before + size(lines) AS n_lines",
            f"{context.code_lines('before')} AS code",
        )
        .selectExpr("file", "chunk", "behind.last", "n_lines", f"{context.try_events('behind.follows')} AS events")
    )
    events = _kept(events)
    summaries = events.selectExpr("file", "chunk", f"{_region_summary('events')} AS summary")
    states = scans.states_before(
        summaries, _NO_REGION, _joined_regions, lambda state, summary: _behind(summary, state)
    )
    regions = folds.running_pieces(
        "events",
        "state",
        context.after_event,
        context.region_end,
        lambda state: f"if(last AND {state}.start > 0, concat({state}.start, ',', n_lines), '')",
    )
    return (
        events.join(states, ["file", "chunk"])
        .selectExpr("file", f"explode(transform({regions}, r -> split(r, ','))) AS region")
        .selectExpr(
            *_file_columns(keys),
            "CAST(region[0] AS INT) AS start_line",
            "CAST(region[1] AS INT) AS end_line",
        )
    )


def brace_spans_of_lines(
    lines: DataFrame, keys: tuple[str, ...] = (), size: int = CHUNK_LINES
) -> DataFrame:
    """Number, first and last line of every block of :func:`brace_blocks`, without its content.

    Depths are sums; once they are known, a chunk knows which of its braces open and close a
    block, and only the last opening line and the number of blocks are handed on.
    """
    in_braces = text.one_of(text.detect_language_full("path"), BRACE_LANGUAGES)
    braces = """flatten(transform(transform(lines, l -> regexp_replace(l, '[^{}]+', '')),
        (found, i) -> if(found = '', CAST(array() AS ARRAY<STRUCT<line:INT,delta:INT>>),
          transform(split(found, ''), b -> named_struct(
            'line', CAST(before + i + 1 AS INT), 'delta', if(b = '{', 1, -1))))))"""
    held = chunks(lines.where(in_braces), keys, size).selectExpr("file", "chunk", f"{braces} AS braces")
    nets = held.selectExpr("file", "chunk", "aggregate(braces.delta, 0, (n, d) -> n + d) AS summary")

    def added(one: str, two: str) -> str:
        return f"({one} + {two})"

    depths = scans.states_before(nets, "0", added, added).withColumnRenamed("state", "depth")
    # o: a block opens, c: a block closes; other braces are of no account.
    edges = folds.running_pieces(
        "braces",
        "depth",
        lambda depth, brace: f"({depth} + {brace}.delta)",
        lambda depth, brace: (
            f"CASE WHEN {depth} = 0 AND {brace}.delta > 0 THEN concat('o,', {brace}.line, ';') "
            f"WHEN {depth} = 1 AND {brace}.delta < 0 THEN concat('c,', {brace}.line, ';') ELSE '' END"
        ),
    )
    marked = (
        held.join(depths, ["file", "chunk"])
        .selectExpr("file", "chunk", f"transform({edges}, e -> split(e, ',')) AS edges")
        .selectExpr(
            "file", "chunk",
            "transform(edges, e -> named_struct('opens', e[0] = 'o', 'line', CAST(e[1] AS INT))) AS edges",
        )
    )
    opened = "element_at(filter(edges, e -> e.opens), -1).line"
    summaries = marked.selectExpr(
        "file", "chunk",
        f"named_struct('opened', if(exists(edges, e -> e.opens), {opened}, NULL), "
        "'blocks', size(filter(edges, e -> NOT e.opens))) AS summary",
    )

    def joined(one: str, two: str) -> str:
        return folds.struct(
            opened=f"coalesce({two}.opened, {one}.opened)", blocks=f"{one}.blocks + {two}.blocks"
        )

    states = scans.states_before(
        summaries, folds.struct(opened="CAST(NULL AS INT)", blocks="0"), joined, joined
    )
    # Openings and closings take turns, so a block opens at the edge before, or chunks before.
    spans = """filter(transform(edges, (e, i) -> named_struct('opens', e.opens, 'end', e.line,
        'start', if(i = 0, state.opened, get(edges, i - 1).line))), e -> NOT e.opens)"""
    return (
        marked.join(states, ["file", "chunk"])
        .selectExpr("file", "state.blocks", f"posexplode({spans}) AS (pos, span)")
        .selectExpr(
            *_file_columns(keys), "CAST(blocks + pos AS INT) AS block_seq",
            "span.start AS start_line", "span.end AS end_line",
        )
    )
