"""Files in chunks give what whole files give, wherever the cuts are."""

import random

import pytest

from lintlake.operators import (
    brace_blocks,
    brace_spans_of_lines,
    line_context,
    line_context_of_lines,
    lines,
    try_regions,
    try_regions_of_lines,
)
from random_files import random_files

PIECES = [
    "try {", "}", "{", "} catch (e) {", "catch (e) {", "finally {", "", "  ", "x = 1;", "// try {",
    "/* a", "*/", "`", "try { a() } finally { b() }", "}}", '"""', "f(); }", "try {{", "}{",
]
SPANS = ("file_seq", "path", "block_seq", "start_line", "end_line")


def tuples(df, *columns):
    df = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def files(make_files):
    rng = random.Random(11)
    names = ["a.ts", "a.py", "b.java", "c.md"]
    rows = [
        (rng.choice(names), "\n".join(rng.choices(PIECES, k=rng.choice([1, 20, 200]))))
        for _ in range(120)
    ]
    # Rarely closed, often closed, and a region that stays open over all chunks.
    rows += [("a.ts", "\n".join(rng.choices(["try {", "}", "x"], weights, k=1500))) for weights in
             ([1, 1, 8], [1, 3, 1], [3, 1, 1])]
    rows += [("a.ts", "try {\n" + "x\n" * 400 + "}\n" + "\n" * 300 + "finally {\n}\ny"), ("a.ts", "")]
    return make_files(rows + random_files(40)).cache()


@pytest.mark.parametrize("size", [1, 7, 100])
def test_chunks_equal_whole_files(files, size):
    table, keys = lines(files), ("file_seq",)
    assert tuples(line_context_of_lines(table, keys, size)) == tuples(line_context(files))
    assert tuples(try_regions_of_lines(table, keys, size)) == tuples(try_regions(files))
    assert tuples(brace_spans_of_lines(table, keys, size), *SPANS) == tuples(brace_blocks(files), *SPANS)


def test_groups_of_chunks(spark, make_files):
    """More chunks than one group of the scan holds."""
    rng = random.Random(5)
    files = make_files([("a.ts", "\n".join(rng.choices(PIECES, k=6000)))])
    table, keys = lines(files), ("file_seq",)
    assert tuples(line_context_of_lines(table, keys, 1)) == tuples(line_context(files))
    assert tuples(try_regions_of_lines(table, keys, 1)) == tuples(try_regions(files))
    assert tuples(brace_spans_of_lines(table, keys, 1), *SPANS) == tuples(brace_blocks(files), *SPANS)


def test_odd_tables(spark):
    schema = "repo string, path string, line int, text string, file string, chunk int, state int"
    rows = [
        (None, "a.ts", 1, "/* a", "f", 9, 9), (None, "a.ts", 2, None, "f", 9, 9), ("r", "a.ts", 1, "b", "f", 9, 9),
        ("r", None, 1, "try {", "f", 9, 9),
    ]
    table = spark.createDataFrame(rows, schema)
    found = line_context_of_lines(table, ("repo",), 1).collect()
    assert sorted((str(r.repo), str(r.path), r.line, r.text, r.is_comment) for r in found) == [
        ("None", "a.ts", 1, "/* a", True), ("None", "a.ts", 2, "", True), ("r", "None", 1, "try {", False),
        ("r", "a.ts", 1, "b", False),
    ]
    assert [(r.path, r.start_line, r.end_line) for r in try_regions_of_lines(table, ("repo",)).collect()] == [(None, 1, 1)]
    for operator in (line_context_of_lines, try_regions_of_lines, brace_spans_of_lines):
        assert operator(table.limit(0), ("repo",)).count() == 0
