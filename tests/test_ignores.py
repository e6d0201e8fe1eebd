"""Ignore files: lines by cases, cascades by table."""

from __future__ import annotations

import re

import pytest

from weftgraph.sources import files as SF
from weftgraph.sources import ignores as I

LINES = [
    ("skip.md", ["skip.md", "a/skip.md"], ["skip.mdx", "a/skip.md/b"]),
    ("/skip.md", ["skip.md"], ["a/skip.md"]),
    ("a/*.py", ["a/x.py"], ["a/b/x.py", "z/a/x.py"]),
    ("*.py[co]", ["x.pyc", "d/y.pyo"], ["x.py", "x.pyd"]),
    ("**/logs", ["logs", "a/b/logs"], ["a/logsx"]),
    ("logs/**", ["logs/a", "logs/a/b"], ["logs", "x/logs/a"]),
    ("a/**/z", ["a/z", "a/b/z", "a/b/c/z"], ["a/bz", "b/a/z"]),
    ("x?z", ["xyz", "d/xaz"], ["x/z", "xz"]),
    ("[!a-c]d", ["xd", "d/zd"], ["ad", "cd", "/d"]),
    ("\\#keep", ["#keep"], ["keep"]),
    ("\\!keep", ["!keep"], ["keep"]),
    ("a.b+c", ["a.b+c"], ["aXb+c", "a.bbc"]),
    ("trail\\ ", ["trail "], ["trail"]),
    ("foo**bar", ["fooxbar", "foobar"], ["foo/bar"]),
]


@pytest.mark.parametrize(("line", "hits", "misses"), LINES)
def test_lines(line, hits, misses):
    pattern = I.expression(line)[0]
    assert all(re.match(pattern, h) for h in hits) and not any(re.match(pattern, m) for m in misses), pattern


def test_marks_of_lines():
    assert I.expression("") is None and I.expression("# remark") is None and I.expression("   ") is None and I.expression("/") is None
    assert I.expression("!x/")[1:] == (True, True) and I.expression("x  ")[0] == I.expression("x")[0] and I.expression("x\r")[0] == I.expression("x")[0]


CASES = [
    # (name, rule files, input folder, {path: reason})
    ("rules above the input hold relative to it too", [("repo", "ignore", "skip.md\ngenerated/**\n!generated/keep.md")], "repo/src", {"repo/src/keep.md": None, "repo/src/skip.md": "ignore", "repo/src/generated/drop.md": "ignore", "repo/src/generated/keep.md": None}),
    ("a nested file holds below it only", [("in/nested", "ignore", "drop.md\n")], "in", {"in/nested/drop.md": "ignore", "in/drop.md": None, "in/nested/keep.md": None, "in/nested/deep/drop.md": "ignore"}),
    (
        "cascading git files, exceptions by an include file",
        [("repo", "gitignore", "root-skip.md\ngenerated/\n"), ("repo/src/nested", "gitignore", "drop.md\n"), ("repo/src", "include", "generated/keep.md\n")], "repo/src",
        {"repo/src/keep.md": None, "repo/src/root-skip.md": "gitignore", "repo/src/generated/keep.md": None, "repo/src/generated/drop.md": "gitignore", "repo/src/nested/drop.md": "gitignore", "repo/src/nested/keep.md": None, "repo/src/.weftinclude": "include", "repo/src/.gitignore": None},
    ),
    ("what is under an ignored folder stays ignored", [("", "gitignore", "build\n!build/keep\n*.log\n!good.log\n")], "", {"build/keep": "gitignore", "x/build/y": "gitignore", "a.log": "gitignore", "good.log": None, "d/good.log": None}),
    ("the last line wins within a file, but files do not take back each other", [("", "gitignore", "*.md\n"), ("a", "gitignore", "!x.md\n"), ("b", "gitignore", "!y.txt\ny.txt\n!y.txt\n")], "", {"a/x.md": "gitignore", "b/y.txt": None}),
    ("git rules above the input hold from their own folder only", [("r", "gitignore", "/src/a.md\n/b.md\n")], "r/src", {"r/src/a.md": "gitignore", "r/src/b.md": None}),
    ("nothing without rule files", [], "", {"a": None, "b/c": None}),
    ("no text, empty text, only remarks", [("", "gitignore", None), ("", "ignore", ""), ("", "include", "# x\n\n")], "", {"a": None}),
]


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_cascades(spark, case):
    _, rules, input_dir, want = case
    files = spark.createDataFrame(rules, "dir string, kind string, text string")
    paths = spark.createDataFrame([(p,) for p in want], "path string")
    assert {r["path"]: r["ignore_reason"] for r in I.ignore_reasons(paths, files, input_dir).collect()} == want


def test_kinds_can_be_switched_off(spark):
    files = spark.createDataFrame([("", "gitignore", "a"), ("", "ignore", "b")], "dir string, kind string, text string")
    paths = spark.createDataFrame([("a",), ("b",)], "path string")
    said = lambda **how: {r["path"]: r["ignore_reason"] for r in I.ignore_reasons(paths, files, **how).collect()}
    assert said() == {"a": "gitignore", "b": "ignore"} and said(git=False) == {"a": None, "b": "ignore"} and said(custom=False) == {"a": "gitignore", "b": None}


def test_scan_reads_rule_files(spark, tmp_path):
    for name, text in (("a.py", "x"), ("gen/b.py", "x"), (".gitignore", "gen/\n"), (".weftignore", "c.*\n"), ("c.py", "x"), ("gen/.weftinclude", "kept.py"), ("gen/kept.py", "x")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r["path"]: r["reason"] for r in SF.scan(spark, str(tmp_path)).collect()}
    assert got["a.py"] is None and got["gen/b.py"] == "gitignore" and got["c.py"] == "ignore" and got["gen/kept.py"] is None
