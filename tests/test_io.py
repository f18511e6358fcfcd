"""Sources, sink and streams."""

import os

import pytest

from lintlake.operators import lines, review, review_diffs, sort_findings, summarize, summary_by_file
from lintlake.sources import folders
from lintlake.sources import (
    diffs_from_directory,
    files_from_directory,
    files_from_table,
    write_findings,
)
from lintlake.streaming import (
    diff_directory_stream,
    diff_stream,
    file_directory_stream,
    file_stream,
    running_summary,
    severity_sizes_of,
    start_diff_review,
    start_review,
    start_summary,
)

FILES = [("a.ts", "eval(x)\n// TODO: y"), ("b.py", "pickle.load(f)"), ("c.md", "eval(z)")]


def ids(df):
    return sorted((r.file, r.line, r.rule) for r in df.collect())


def test_directory(spark, tmp_path):
    root = tmp_path / "config" / "my repo+x%20"
    (root / "src").mkdir(parents=True)
    (root / "src" / "a b.ts").write_text("eval(x)\nwait(500, y)\n")
    (root / "bytes.py").write_bytes(b"x = '\xff'")
    files = files_from_directory(spark, str(root))
    assert {(r.path, r.content) for r in files.collect()} == {
        ("src/a b.ts", "eval(x)\nwait(500, y)\n"), ("bytes.py", "x = '\ufffd'"),
    }
    # The folder above the root is called config and must not matter.
    assert ids(review(files, keys=())) == [("src/a b.ts", 1, "SEC001"), ("src/a b.ts", 2, "QA003")]


def test_diff_directory(spark, tmp_path):
    (tmp_path / "one.diff").write_text("diff --git a/x.ts b/x.ts\n@@ -1 +1 @@\n+eval(x)\n")
    (tmp_path / "note.txt").write_text("no diff")
    (row,) = review_diffs(diffs_from_directory(spark, str(tmp_path))).collect()
    assert (row.diff_id, row.file, row.rule) == ("one.diff", "x.ts", "SEC001")


def test_table_with_other_names(spark):
    table = spark.createDataFrame([("r", "a.ts", "eval(x)")], "repo string, name string, body string")
    files = files_from_table(table, "name", "body")
    (row,) = review(files, keys=("repo",)).collect()
    assert (row.repo, row.rule) == ("r", "SEC001")


def test_partitions_are_kept_unless_asked_for(spark, make_files):
    files = make_files(FILES).coalesce(2)
    assert files_from_table(files).rdd.getNumPartitions() == 2
    assert files_from_table(files, partitions=5).rdd.getNumPartitions() == 5


def test_empty_files_count(spark, tmp_path):
    (tmp_path / "full.ts").write_text("eval(x)")
    (tmp_path / "empty 1%.ts").write_text("")
    files = files_from_directory(spark, str(tmp_path))
    assert {(r.path, r.content) for r in files.collect()} == {("full.ts", "eval(x)"), ("empty 1%.ts", "")}
    assert summarize(files).first().files_reviewed == 2
    assert lines(files).where("path = 'empty 1%.ts'").count() == 1
    # The other operators work without keys as well.
    assert ids(review(files)) == [("full.ts", 1, "SEC001")]
    assert [r.path for r in summary_by_file(files).where("total_findings = 0").collect()] == ["empty 1%.ts"]
    assert sort_findings(review(files)).count() == 1
    assert files_from_directory(spark, "file://" + str(tmp_path)).select("path").count() == 2


def test_sink(spark, make_files, tmp_path):
    findings = review(make_files(FILES))
    write_findings(findings, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert ids(back) == ids(findings)
    assert (tmp_path / "out" / "severity=critical").is_dir()


def test_stream_equals_batch_and_goes_on(spark, make_files, tmp_path):
    source, output, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    files = make_files(FILES)
    files.where("file_seq < 2").write.parquet(source)
    for more in (None, files.where("file_seq = 2")):
        if more is not None:
            more.selectExpr("file_seq", "'c.ts' AS path", "content").write.mode("append").parquet(source)
        start_review(
            file_stream(spark, source, max_files=1), output, progress, available_now=True
        ).awaitTermination()
    assert ids(spark.read.parquet(output)) == sorted(
        ids(review(files.where("file_seq < 2"))) + [("c.ts", 1, "SEC001")]
    )


def test_diff_stream(spark, tmp_path):
    source, output, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    diffs = spark.createDataFrame(
        [(1, "diff --git a/x.ts b/x.ts\n@@ -1 +1 @@\n+eval(x)\n")], "diff_id bigint, raw string"
    )
    diffs.write.parquet(source)
    start_diff_review(
        diff_stream(spark, source), output, progress, available_now=True
    ).awaitTermination()
    assert ids(spark.read.parquet(output)) == ids(review_diffs(diffs))


def test_directory_streams(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.ts").write_text("eval(x)")
    (tmp_path / "src" / "b.diff").write_text("diff --git a/x.ts b/x.ts\n@@ -1 +1 @@\n+eval(x)\n")
    for name, start, stream in (
        ("files", start_review, file_directory_stream(spark, str(tmp_path / "src"), "*.ts", 0)),
        ("diffs", start_diff_review, diff_directory_stream(spark, str(tmp_path / "src"), settle=0)),
    ):
        output = str(tmp_path / f"{name}-out")
        start(stream, output, str(tmp_path / f"{name}-progress"), available_now=True).awaitTermination()
        assert [r.rule for r in spark.read.parquet(output).collect()] == ["SEC001"]


def test_directory_stream_goes_on_and_sees_empty_files(spark, tmp_path):
    """Each file in one batch, also old, moved and empty ones, over a restart."""
    root, output, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    (root / "__tests__").mkdir(parents=True)
    (tmp_path / "old.ts").write_text("eval(z)")
    os.utime(tmp_path / "old.ts", (1, 1))

    def run():
        stream = file_directory_stream(spark, str(root), settle=0)
        writer = stream.writeStream.format("parquet").option("path", output).option("checkpointLocation", progress)
        writer.trigger(availableNow=True).start().awaitTermination()
        return sorted((r.path, r.content) for r in spark.read.parquet(output).collect())

    (root / "a.ts").write_text("eval(x)")
    (root / "empty.ts").write_text("")
    first = [("a.ts", "eval(x)"), ("empty.ts", "")]
    assert run() == first
    assert run() == first
    (root / "__tests__" / "none.ts").write_text("")
    (tmp_path / "old.ts").rename(root / "old.ts")
    found = run()
    assert found == sorted(first + [("__tests__/none.ts", ""), ("old.ts", "eval(z)")])
    assert found == sorted((r.path, r.content) for r in files_from_directory(spark, str(root)).collect())


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_every_file_is_in_one_part(tmp_path, monkeypatch, parts):
    """Narrow and wide folders, files at every depth, by a path and by an address."""
    monkeypatch.setattr(folders, "WIDE", 9)
    expected = set()
    for i in range(60):
        path = f"{i % 5}/w/{i}.ts" if i % 2 else f"{i % 3}/{i}/.{i}" if i % 3 else f"_{i}"
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("")
        expected.add(path)
    (tmp_path / "none").mkdir()
    (tmp_path / "loop").symlink_to(tmp_path)
    for tree in (folders._Local(str(tmp_path)), folders._Remote("file://" + str(tmp_path))):
        monkeypatch.setattr(folders, "_tree", lambda root: tree)
        found = [f for part in folders._parts(str(tmp_path), parts) for f in folders._files(tree, part, None)]
        if isinstance(tree, folders._Local):
            assert sorted(found) == sorted(expected)
        else:
            assert expected <= set(found)


def test_running_summary_goes_on_after_a_restart(spark, make_files, tmp_path):
    """State after every start equals the summary of all files so far, null keys included."""
    source, output, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    files = make_files([(f"{i}.ts", "eval(x)\n" * (i % 3)) for i in range(9)]).selectExpr(
        "*", "if(file_seq % 4 = 3, NULL, CAST(file_seq % 4 AS STRING)) AS repo"
    )
    schema = "file_seq bigint, path string, content string, repo string"
    for upto in (3, 3, 9):
        have = spark.read.schema(schema).parquet(source).select("file_seq") if os.path.isdir(source) else files.limit(0).select("file_seq")
        files.where(f"file_seq < {upto}").join(have, "file_seq", "left_anti").select("file_seq", "path", "content", "repo").write.mode("append").parquet(source)
        start_summary(
            file_stream(spark, source, schema, max_files=1), output, progress, ("repo",), available_now=True
        ).awaitTermination()
        expected = summarize(files.where(f"file_seq < {upto}"), by=("repo",))
        found = running_summary(spark, output, ("repo",)).select(expected.columns)
        assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    sizes = {r.severity: r.group_size for r in severity_sizes_of(found).collect()}
    assert sizes == {"critical": 9}


def test_sizes_are_counted_while_findings_are_written(spark, make_files, tmp_path):
    from lintlake import review
    from lintlake.sources import write_findings

    found = review(make_files([("a.ts", "eval(x)\neval(y)\n// TODO: z\n"), ("b.ts", "")]))
    sizes = write_findings(found, str(tmp_path / "found"))
    written = spark.read.parquet(str(tmp_path / "found"))
    assert {r["severity"]: r["count"] for r in written.groupBy("severity").count().collect()} == {s: n for s, n in sizes.items() if n}
    assert sum(write_findings(found.limit(0), str(tmp_path / "none")).values()) == 0
