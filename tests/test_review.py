"""Filters, order, summaries, custom rules, and properties of a review."""

import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import lintlake
from lintlake import FileRule, LineRule, Report, hit
from lintlake import Test as LineTest
from lintlake.operators import review, severity_groups, sort_findings, summarize, summary_by_file
from lintlake.rules import BUILT_IN_RULES
from random_files import random_files

MIXED = "\n".join([
    "try { riskyOp(); } catch (e) { }", 'const password = "mysecretpassword123";',
    'console.log("debug:", data);', "const x = eval('1+1');", "// TODO: fix later", "// FIXME now",
])
FILES = [
    ("a.ts", MIXED), ("clean.ts", "const x = 1;\n"), ("b.py", "eval(x)\n# eval(y)\nyaml.load(z)"),
    ("data.json", '{"key": "value"}'), ("m.ts", "if (a) {\n} else if (a) {\n}"),
]


def ids(df):
    return sorted((r.file, r.line, r.rule, r.emit_seq) for r in df.collect())


def test_clean_and_unknown_files_have_none(make_files):
    found = ids(review(make_files(FILES)))
    assert {f[0] for f in found} == {"a.ts", "b.py", "m.ts"}


def test_suppressed_in_comments_and_strings(make_files):
    files = make_files([
        ("a.ts", '// const password = "secret123456";\n/*\neval(x)\n*/\nconst m = `\n'
                 "SELECT * FROM u WHERE id = ${id}\n`;"),
        ("a.py", '# password = "secret123456"'),
    ])
    assert ids(review(files)) == []
    assert len(ids(review(files, use_context=False))) >= 4


def test_filters(make_files):
    files = make_files(FILES)
    everything = review(files)
    assert ids(review(files, min_confidence=90)) == ids(everything.where("confidence >= 90"))
    assert ids(review(files, categories=["security"])) == ids(
        everything.where("category = 'security'")
    )
    # The filter looks at the rule: QA002 is a low rule whose FIXME findings are medium.
    medium = review(files, severities=["medium"])
    assert {r.rule for r in medium.collect()} == {"QA007"}
    low = review(files, severities=["low"]).collect()
    assert ("QA002", "medium") in {(r.rule, r.severity) for r in low}
    assert ids(lintlake.check_error_handling(files)) == ids(
        everything.where("category = 'error-handling'")
    )
    assert ids(review(files, categories=["nothing"])) == []


def test_order(make_files):
    rows = sort_findings(review(make_files(FILES))).collect()
    keys = [
        (r.severity_rank, -r.confidence, r.file_seq, r.rule_seq, r.line, r.emit_seq) for r in rows
    ]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)


def test_summary(make_files):
    (s,) = summarize(make_files(FILES)).collect()
    assert s.files_reviewed == 5
    assert s.rules_applied == 22
    assert s.critical + s.high + s.medium + s.low == s.total_findings > 0
    (python,) = summarize(make_files(FILES[2:4])).collect()
    assert python.rules_applied == 12


def test_summary_of_nothing(make_files):
    (s,) = summarize(make_files(FILES).where("false")).collect()
    assert tuple(s) == (0,) * 7


def test_summary_by_file(make_files):
    rows = {r.path: r for r in summary_by_file(make_files(FILES)).collect()}
    assert len(rows) == 5
    assert rows["clean.ts"].total_findings == 0 and rows["clean.ts"].rules_applied == 22
    assert rows["data.json"].rules_applied == 0
    assert rows["b.py"].critical == 2


def test_severity_groups(make_files):
    rows = severity_groups(review(make_files(FILES))).collect()
    for row in rows:
        assert row.group_size == sum(r.severity == row.severity for r in rows)


def test_union_and_permutation(make_files):
    def found(rows):
        return ids(review(make_files(rows)))

    assert sorted(found(FILES[:2]) + found(FILES[2:])) == found(FILES)
    assert found(FILES[::-1]) == found(FILES)


def test_same_path_many_times(make_files):
    """Files are told apart by row, never by path."""
    rows = [("index.js", f"eval(x{i})") for i in range(300)] + [("a.js", "eval(y)")]
    assert review(make_files(rows)).groupBy("file").count().orderBy("count").collect()[-1][1] == 300


def test_custom_rules_replace_the_built_in_ones(make_files):
    long_line = LineRule(
        "L1", "long-line", "style", "low", (), (Report(50, "{1} characters"),),
        tests=(LineTest(0, "length(l.text) > 20", "length(l.text)"),),
    )
    python_file = FileRule(
        "F1", "python", "style", "high", ("python",), (Report(10, "First of {1}"),),
        hits=f"array({hit(0, '1', arg1='size(lines)')})",
    )
    rows = review(make_files(FILES), rules=[long_line, python_file]).collect()
    assert {(r.file, r.message) for r in rows if r.rule == "F1"} == {("b.py", "First of 3")}
    assert len([r for r in rows if r.rule == "L1"]) == 4
    assert {r.rule for r in rows} == {"L1", "F1"}


def test_custom_rule_with_a_pandas_function(spark, make_files):
    @F.pandas_udf("boolean")
    def shouts(texts):
        return texts.str.isupper()

    spark.udf.register("shouts", shouts)
    rule = FileRule(
        "U1", "upper", "style", "low", (), (Report(10, "Loud"),),
        hits=f"if(shouts(content), array({hit(0, '1')}), array())",
    )
    files = make_files([("a.ts", "LOUD"), ("b.ts", "quiet")])
    assert ids(review(files, rules=[rule])) == [("a.ts", 1, "U1", 0)]


def test_more_rules_than_bits(make_files):
    rules = [
        LineRule(
            f"R{i}", "r", "style", "low", (), (Report(10, "Found"),),
            tests=(LineTest(0, f"l.text = 'x{i}'"),),
        )
        for i in range(130)
    ]
    files = make_files([("a.ts", "x0\nx61\nx62\nx129")])
    assert [f[2] for f in ids(review(files, rules=rules))] == ["R0", "R61", "R62", "R129"]


@pytest.mark.parametrize("line", [
    "catch" + " " * 20000 + "x", "a" * 200000 + "(", "(" * 20000, "static " * 5000 + "(", " " * 50000,
    "import {" + "a, " * 20000 + "} from 'x'", "if (" + ")" * 20000, "SELECT " + "x" * 50000,
    "async " + "a" * 100000, "console." * 5000, "'" * 20000, "f(" + "1234, " * 5000 + ")",
])
def test_hard_lines_end_soon(make_files, line):
    content = "\n".join([line, "catch (e) {", "import { q } from 'x'", "else if"] + ["{"] * 60)
    review(make_files([("a.ts", content), ("a.py", content)])).count()


@pytest.mark.parametrize("line", [
    'if(process.env.NODE_ENV!=="production")x();' * 40000, "x.allowedOrigins=y;'" * 40000,
    "SELECT a from b;" * 40000 + "+ {", "f(" * 40000 + ".then(", "catch(" * 40000, "cors({" * 40000,
    "SELECT\r" * 40000 + "+ {", "f'SELECT a;" * 40000 + "{", "catch(e" * 40000 + ")",
], ids=lambda line: line[:12].strip("\r"))
def test_repeated_keywords_take_linear_time(make_files, line):
    """Each of these took minutes or hours when every keyword was tried to the line's end."""
    start = time.monotonic()
    review(make_files([("a.ts", line), ("a.py", line)])).count()
    assert time.monotonic() - start < 30


def test_keywords_across_carriage_returns(make_files):
    lines = ["SELECT\rx' + y", "SELECT a\rb' + y", "x\rSELECT a' + y", "SELECT \r\u2028 `${a}`", "aSELECTED SELECT q` ${a}`"]
    files = make_files([(f"{i}.ts", line) for i, line in enumerate(lines)])
    assert [f[0] for f in ids(review(files, rules=["SEC004"]))] == ["0.ts", "2.ts", "3.ts", "4.ts"]


def test_long_file(make_files):
    content = "\n".join(["x = `", "eval(a)", "`", "try { eval(b) } catch (e) {", "}"] * 20000)
    counts = {r["rule"]: r["count"] for r in review(
        make_files([("a.ts", content)]), rules=["SEC001", "ERR001"]
    ).groupBy("rule").count().collect()}
    assert counts == {"SEC001": 20000, "ERR001": 20000}


def test_review_needs_no_shuffle(make_files):
    plan = review(make_files(FILES))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_cheap_tests_lose_nothing(make_files):
    """With every ``needs``, ``candidate`` and ``mark`` open, the findings are the same."""
    files = make_files(random_files())
    opened = [
        replace(rule, needs="true", **({"candidate": "true", "mark": "true"} if hasattr(rule, "mark") else {}))
        for rule in BUILT_IN_RULES
    ]
    found = ids(review(files))
    assert len(found) > 300
    other = ids(review(files, rules=opened))
    assert set(other) ^ set(found) == set()
    assert found == other
