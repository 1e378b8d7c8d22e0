import posixpath
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gneiss.functions import paths as P


def col(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").orderBy("i").select(f("x")).collect()]


def test_extensions_and_bases(spark):
    paths = ["a/b.GO", ".env", "Makefile", "x/y.d.ts", "a.b/c"]
    assert col(spark, paths, P.ext) == [".go", ".env", "", ".ts", ""]
    assert col(spark, paths, P.basename) == ["b.GO", ".env", "Makefile", "y.d.ts", "c"]
    assert col(spark, paths, P.dirname) == ["a", ".", ".", "x", "a.b"]
    assert col(spark, ["a.py", "a.mjs", "a.php", "a.go"], P.language) == ["text", "ts/js", "php", "go"]
    assert col(spark, ["a.mts", "a.jsx", "a.go", "a.py"], P.outline_language) == ["typescript", "javascript", "go", ""]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", ".", "..", ""]), min_size=1, max_size=6).map("/".join), min_size=20, max_size=60))
def test_clean_is_normpath(spark, paths):
    want = [re.sub("^//", "/", posixpath.normpath(p)) if p else "." for p in paths]
    assert col(spark, paths, P.clean) == want


def test_safe_rejects_escapes(spark):
    assert col(spark, ["../escape.txt", "a/../../x", "/a/b", "./c", "a/..", "..."], P.safe) == [None, None, "a/b", "c", None, "..."]


@pytest.mark.parametrize(
    "glob, yes, no",
    [
        ("*.md", ["a.md", "x/a.md"], ["a.mdx", "a"]),
        ("a?c", ["abc"], ["a/c", "ac"]),
        ("[a-c]x", ["bx"], ["dx"]),
        ("[^a]x", ["bx"], ["ax"]),
        ("src/*", ["src/a"], ["src/a/b", "xsrc/a"]),
        ("a\\*", ["a*"], ["ab"]),
        ("[", [], ["["]),
        ("a.b", ["a.b"], ["aXb"]),
    ],
)
def test_globs(spark, glob, yes, no):
    assert col(spark, yes + no, lambda c: P.matches_any(c, [glob])) == [True] * len(yes) + [False] * len(no)


def test_ignore_rules(spark):
    assert col(spark, ["a/vendor/x", "vendor", ".github/x", ".gneiss/x", "a/b"], P.in_ignored_dir) == [True, False, True, True, False]
    assert col(spark, [".gneiss/x"], lambda c: P.in_ignored_dir(c, False)) == [False]
    assert col(spark, ["X.PNG", "x.png", "server", "a/server", "serverx"], P.ignored_file) == [True, True, True, True, False]
    assert col(spark, ["X.PNG", "x.png"], lambda c: P.ignored_file(c, any_case=False)) == [False, True]
    assert col(spark, ["vendor", "a/dist/b"], P.ignored_change) == [True, True]


def test_walk_order(spark):
    x = spark.createDataFrame([("a.txt",), ("a/b",), ("B",)], "path string").orderBy(P.walk_key("path"))
    assert [r.path for r in x.collect()] == ["B", "a/b", "a.txt"]


def test_normal_lists(spark):
    assert col(spark, [[" MCP", "Repo", "mcp", ""], None], P.normalise_tags, "array<string>") == [["mcp", "repo"], []]
    assert col(spark, [["b", " ./a ", "", ".", "b"]], P.normalise_paths, "array<string>") == [["a", "b"]]
