"""Code blocks and unified diffs."""

import lintlake
from lintlake.operators import (
    code_blocks,
    diff_files,
    diff_hunks,
    diff_lines,
    diff_review_files,
    review_diffs,
    summarize_diffs,
)

MODIFIED = """diff --git a/depot/crate.ts b/depot/crate.ts
index 4410c2e..90be71d 100755
--- a/depot/crate.ts
+++ b/depot/crate.ts
@@ -31,3 +44,4 @@ class Crate {
 first
-gone
+eval(x)
\\ No newline at end of file
 last
stray
+dropped
@@ -60 +74 @@
+eval(y)"""
NEW = """diff --git a/n.ts b/n.ts
new file mode 100644
--- /dev/null
+++ b/n.ts
@@ -0,0 +1,2 @@
+try { x } catch (e) {
+}
"""
DELETED = """diff --git a/d.ts b/d.ts
deleted file mode 100644
--- a/d.ts
+++ /dev/null
@@ -1,1 +0,0 @@
-eval(z)
"""
RENAMED = """diff --git a/lib/pallet.ts b/lib/stack.ts
similarity index 97%
rename from lib/pallet.ts
rename to lib/stack.ts"""
DIFFS = ["note\n" + MODIFIED + "\n" + RENAMED, NEW + DELETED, "", "diff --git odd\n@@ odd @@\n+x"]


def table(spark):
    return spark.createDataFrame(list(enumerate(DIFFS)), "diff_id bigint, raw string")


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_files(spark):
    assert rows(diff_files(table(spark)), "diff_id", "file_seq", "path", "old_path", "status") == [
        (0, 0, "depot/crate.ts", "depot/crate.ts", "modified"),
        (0, 1, "lib/stack.ts", "lib/pallet.ts", "renamed"),
        (1, 0, "n.ts", None, "added"),
        (1, 1, "d.ts", "d.ts", "deleted"),
        (3, 0, "", None, "modified"),
    ]


def test_hunks(spark):
    names = ("diff_id", "file_seq", "hunk_seq", "old_start", "old_count", "new_start", "new_count")
    assert rows(diff_hunks(table(spark)), *names) == [
        (0, 0, 0, 31, 3, 44, 4), (0, 0, 1, 60, 1, 74, 1), (1, 0, 0, 0, 0, 1, 2),
        (1, 1, 0, 1, 1, 0, 0), (3, 0, 0, 0, 0, 0, 0),
    ]


def test_lines(spark):
    found = diff_lines(table(spark).where("diff_id = 0"))
    names = ("hunk_seq", "line_seq", "type", "content", "old_line", "new_line")
    assert rows(found, *names) == [
        (0, 0, "context", "first", 31, 44), (0, 1, "remove", "gone", 32, None),
        (0, 2, "add", "eval(x)", None, 45), (0, 3, "context", "last", 33, 46),
        (1, 0, "add", "eval(y)", None, 74),
    ]


def test_review_files_keep_added_and_context(spark):
    found = diff_review_files(table(spark))
    assert rows(found, "diff_id", "path", "content") == [
        (0, "depot/crate.ts", "first\neval(x)\nlast\neval(y)"), (0, "lib/stack.ts", ""),
        (1, "n.ts", "try { x } catch (e) {\n}"), (3, "", "x"),
    ]


def test_findings_and_their_file_lines(spark):
    found = review_diffs(table(spark), map_lines=True)
    assert rows(found, "diff_id", "file", "line", "rule", "new_line", "is_added") == [
        (0, "depot/crate.ts", 2, "SEC001", 45, True), (0, "depot/crate.ts", 4, "SEC001", 74, True),
        (1, "n.ts", 1, "ERR001", 1, True),
    ]
    plain = review_diffs(table(spark))
    assert rows(plain, "diff_id", "line", "rule") == rows(found, "diff_id", "line", "rule")


def test_summary_counts_renamed_file_without_hunks(spark):
    found = {r.diff_id: r for r in summarize_diffs(table(spark)).collect()}
    assert found[0].files_reviewed == 2 and found[0].total_findings == 2
    assert found[3].rules_applied == 0
    assert 2 not in found


def test_long_hunk_is_numbered_to_the_end(spark):
    body = "\n".join(["+a", " b", "-c"] * 2000)
    diff = spark.createDataFrame(
        [(1, f"diff --git a/x b/x\n@@ -10,1 +20,1 @@\n{body}")], "diff_id int, raw string"
    )
    last = diff_lines(diff).orderBy("line_seq").collect()[-1]
    assert (last.line_seq, last.type, last.old_line) == (5999, "remove", 10 + 2 * 2000 - 1)


def test_brace_blocks(make_files):
    content = "function a() {\n return {x:1};\n}\nlet q = {}; let z = {\n y }\n}} {\n"
    found = code_blocks(make_files([("a.ts", content), ("a.md", content), ("a.ts", "")]))
    assert rows(found, "file_seq", "block_seq", "start_line", "end_line") == [
        (0, 0, 1, 3), (0, 1, 4, 4), (0, 2, 4, 5),
    ]


def test_indent_blocks(make_files):
    content = "import x\n\nclass A:\n  def f(self):\n    return 1\n\n  y = 2\nasync def g():\n  pass\n"
    found = code_blocks(make_files([("p.py", content)]))
    assert rows(found, "start_line", "end_line", "content") == [
        (3, 3, "class A:"), (4, 6, "  def f(self):\n    return 1\n"),
        (8, 10, "async def g():\n  pass\n"),
    ]


def test_public_names():
    assert all(hasattr(lintlake, name) for name in lintlake.__all__)
