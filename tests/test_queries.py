"""Registered queries give what their SQL gives."""

import random
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from lintlake import operators as op
from lintlake.operators import review
from lintlake.plans import oracle
from lintlake.plans import queries as registered
from random_files import random_files

DATA = Path("/root/testdata/sf0.001")
TABLES = ("documents", "pages")
SQL = entry_point.oracle_sql()
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA / table}.parquet'")
    return con


def test_every_query_has_sql():
    """But for those of the optional subpackage, which SQL cannot all express."""
    assert set(registered.queries()) == set(oracle.oracle_sql())
    assert set(SQL) <= set(entry_point.queries())


@pytest.mark.parametrize("name", [
    "line_context", "line_context_chunked", "try_regions_chunked", "brace_spans_chunked", "imports", "try_regions", "brace_blocks", "indent_blocks", "code_blocks",
    "diff_lines", "diff_files", "findings_all", "findings_no_context", "diff_findings_mapped",
    "summary", "summary_by_file", "summary_by_source", "diff_summary", "severity_groups",
    "rule_coverage", "custom_rules", "streaming_review", "streaming_diff_review", "findings_sink",
    "streaming_summary_by_source", "streaming_severity_sizes", "directory_files", "directory_review", "streaming_directory_review",
])
def test_query(spark, duck, name):
    df = entry_point.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    expected = duck.sql(SQL[name])
    assert sorted(expected.columns) == columns
    order = [expected.columns.index(c) for c in columns]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert got == sorted((tuple(r[i] for i in order) for r in expected.fetchall()), key=str)


def _plans(df):
    execution = df._jdf.queryExecution()
    return execution.optimizedPlan().toString(), execution.executedPlan().toString()


def test_registered_plans(spark):
    """No shuffle but for aggregates and sorts, one scan of each table, every cut made once."""
    known, folder = registered.queries(), str(DATA)
    for name in ("findings_all", "summary_by_file", "imports", "code_blocks", "diff_findings"):
        assert "Exchange" not in _plans(known[name](spark, folder))[1], name
    for name in ("summary", "summary_by_file", "summary_by_source", "diff_summary", "code_blocks"):
        tables = 1 if name in ("summary_by_source", "diff_summary") else 2
        assert _plans(known[name](spark, folder))[0].count("Relation [") == tables, name
    for name in ("diff_hunks", "diff_lines", "diff_review_text", "diff_findings", "diff_summary"):
        optimized = _plans(known[name](spark, folder))[0]
        assert optimized.count("(?=diff --git)") == 1, name
        assert optimized.count("(?=@@)") == 1, name


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Conf:
        values = {"spark.master": "spark://host:7077"}

        def get(self, name, default=None):
            return self.values.get(name, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        registered._shared(Session, "findings")
    Conf.values["spark.checkpoint.dir"] = "hdfs://store/shared"
    assert registered._shared(Session, "findings").startswith("hdfs://store/shared/findings-")


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("use_context", [True, False])
def test_random_files(make_files, use_context):
    """All rules on random lines, against the SQL of the review."""
    rows = random_files(seed=11)
    con = duckdb.connect()
    con.sql("CREATE TABLE soup (file_seq BIGINT, path VARCHAR, content VARCHAR)")
    con.executemany("INSERT INTO soup VALUES (?, ?, ?)", [(i, *r) for i, r in enumerate(rows)])
    sql = oracle._review(
        f"SELECT {oracle.FINDING} FROM findings",
        files="files AS (SELECT * FROM soup)",
        lines=oracle.LINES if use_context else oracle.NO_CONTEXT,
    )
    df = review(make_files(rows), use_context=use_context)
    expected = con.sql(sql)
    assert expected.columns == df.columns
    got, wanted = {tuple(r) for r in df.collect()}, set(expected.fetchall())
    assert sorted(got - wanted, key=str)[:5] == sorted(wanted - got, key=str)[:5] == []


def _same(df, expected):
    columns = sorted(df.columns)
    order = [expected.columns.index(c) for c in columns]
    got = {tuple(r[c] for c in columns) for r in df.collect()}
    wanted = {tuple(r[i] for i in order) for r in expected.fetchall()}
    assert sorted(got - wanted, key=str)[:5] == sorted(wanted - got, key=str)[:5] == []
    assert got


@pytest.mark.parametrize(
    "name", ["line_context", "imports", "try_regions", "brace_blocks", "indent_blocks"]
)
def test_random_files_by_operator(make_files, name):
    rows = random_files(seed=12)
    con = duckdb.connect()
    con.sql("CREATE TABLE soup (file_seq BIGINT, path VARCHAR, content VARCHAR)")
    con.executemany("INSERT INTO soup VALUES (?, ?, ?)", [(i, *r) for i, r in enumerate(rows)])
    sql = SQL[name].replace(oracle.FILES, "files AS (SELECT * FROM soup)")
    _same(getattr(op, name)(make_files(rows)), con.sql(sql))


@pytest.mark.parametrize("name", ["diff_files", "diff_hunks", "diff_lines", "diff_review_text"])
def test_random_diffs(spark, name):
    rng = random.Random(5)
    lines = [
        "diff --git a/x.ts b/x.ts", "diff --git a/x.ts b/y b/z.ts", "diff --git odd",
        "diff --git a/x b/x\r", "new file mode", "deleted file mode", "--- /dev/null",
        "+++ /dev/null", "--- a/old", "+++ b/new", "rename to q", "@@ -1,2 +3,4 @@ f()",
        "@@ -7 +8 @@", "@@ odd @@", "+added", "-gone", " same", "", "\\ No newline", "stray", "+", "\r",
    ]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 40)))) for i in range(400)]
    con = duckdb.connect()
    con.sql("CREATE TABLE soup (diff_id BIGINT, raw VARCHAR)")
    con.executemany("INSERT INTO soup VALUES (?, ?)", rows)
    rest = oracle.DIFFS[oracle.DIFFS.index("dl AS MATERIALIZED"):]
    sql = SQL[name].replace(oracle.DIFFS, "diffs AS (SELECT * FROM soup),\n" + rest)
    operator = op.diff_review_files if name == "diff_review_text" else getattr(op, name)
    _same(operator(spark.createDataFrame(rows, "diff_id bigint, raw string")), con.sql(sql))
