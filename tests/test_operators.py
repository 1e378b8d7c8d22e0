import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gneiss.config import Config
from gneiss.operators import chunk, context, graph, notes, outline, related, search, select
from gneiss.plans import fixtures
from gneiss.streaming import changes


def files(spark, tree):
    return fixtures.repo(spark, tree)


# == chunks


def test_chunk_bounds():
    go = "package p\n\n// One.\nfunc One() {}\n// Two.\nfunc Two() {\n\treturn\n}\n\nvar x = 1\n"
    assert [c[:2] for c in chunk.chunk_text(go, 4, 1 << 20)] == [(1, 4), (5, 8), (9, 10)]
    five = "".join(f"line {i}\n" for i in range(1, 6))
    assert [c[:2] for c in chunk.chunk_text(five, 2, 8192)] == [(1, 2), (3, 4), (5, 5)]
    assert all(c[2].endswith("\n") and not c[2].endswith("\n\n") for c in chunk.chunk_text(go, 4, 100))


def test_chunk_edges():
    assert chunk.chunk_text("", 5, 10) == []
    assert chunk.chunk_text("\n\n \n", 5, 100) == []
    assert chunk.chunk_text("a\r\nb\r\n", 5, 100) == [(1, 2, "a\nb\n")]
    assert chunk.chunk_text("a\n" + "x" * 15 + "\nb\n", 5, 10) == [(1, 1, "a\n"), (2, 2, "x" * 15 + "\n"), (3, 3, "b\n")]
    assert chunk.chunk_text("a\n" + "x" * 40 + "\nb\n", 5, 10) == [(1, 1, "a\n")]  # a line of 4 x the size ends the file
    assert chunk.chunk_text("\n\n\na\n", 2, 100) == [(3, 4, "\na\n")]


def sequential(text, max_lines, max_bytes):
    lines = text.split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    out, buf, start = [], [], 1

    def flush(end):
        body = "\n".join(buf).rstrip("\n")
        if body.strip():
            out.append((start, end, body + "\n"))

    for i, line in enumerate(lines, 1):
        if len(line.encode()) >= 4 * max_bytes:
            i -= 1
            break
        if sum(len(x.encode()) + 1 for x in buf) + len(line.encode()) + 1 > max_bytes or len(buf) >= max_lines:
            if buf:
                flush(i - 1)
            buf, start = [], i
        buf.append(line)
    if buf:
        flush(i)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["", "a", "é" * 3, "x" * 9, " ", "y" * 30, "z" * 50]), max_size=30).map("\n".join), st.integers(1, 5), st.integers(8, 40))
def test_chunks_equal_the_sequential_rule(text, max_lines, max_bytes):
    assert chunk.chunk_text(text, max_lines, max_bytes) == sequential(text, max_lines, max_bytes)


# == selection


def test_selection(spark):
    tree = {p: "x" for p in ["a.go", "b.py", "README.txt", "k.key", ".github/workflows/ci.yml", "vendor/a.go", "x.PNG", "go.sum", "big.go", "empty.go"]}
    tree["big.go"], tree["empty.go"] = "x" * 50, ""
    got = {r.path for r in select.candidates(files(spark, tree), Config(max_file_bytes=40)).collect()}
    assert got == {"a.go", "README.txt", "go.sum"}


def test_listing(spark):
    x = files(spark, {"one.txt": "", "in/two.go": "", "in/three.md": "", "__init__.py": "", "dist/x": ""})
    assert [r.path for r in select.listing(x).collect()] == ["__init__.py", "in/three.md", "in/two.go", "one.txt"]
    assert [r.path for r in select.listing(x, "in/*.go").collect()] == ["in/two.go"]
    assert [r.path for r in select.listing(x, most=1).collect()] == ["__init__.py"]


def test_first_fit_skips_and_goes_on(spark):
    x = spark.createDataFrame([("a", 5), ("b", 8), ("c", 4), ("d", 1)], "path string, size long")
    assert {r.path for r in select.first_fit(x, 10, "size", ["path"]).where("fits").collect()} == {"a", "c", "d"}
    assert {r.path for r in select.prefix_budget(x, 10, "size", ["path"]).where("fits").collect()} == {"a"}
    assert select.first_fit(x.limit(0), 10, "size", ["path"]).count() == 0


def test_difference_to_index(spark):
    now = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, 3)], "path string, size long, mod_time long")
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 9), ("z", 1, 1)], "path string, size long, mod_time long")
    assert {r.path for r in select.changed(now, old).collect()} == {"b", "c"}
    assert {r.path for r in select.deleted(old, now).collect()} == {"z"}


# == search


def test_search_lines_context(spark):
    x = files(spark, {"a.txt": "1\n2\nhit\n3\nhit\nhit\n4\n5\n6\nHIT\n"})
    got = [(r.line, r.snippet) for r in search.search_lines(x, "hit", context=2).collect()]
    assert got == [(3, "1\n2\nhit"), (5, "3\nhit"), (6, "hit"), (10, "5\n6\nHIT")]
    assert [r.line for r in search.search_lines(x, "hit", case_sensitive=True).collect()] == [3, 5, 6]
    assert search.search_lines(files(spark, {"a": ""}), "x").count() == 0
    with pytest.raises(ValueError):
        search.search_lines(x, "")


def test_search_chunks_score(spark):
    c = chunk.chunks(files(spark, {"hello.go": "Hello hello\n", "b.go": "HELLO\n", "c.go": "no\n"}))
    assert [(r.path, r.score) for r in search.search_chunks(c, " hello ").collect()] == [("hello.go", 17), ("b.go", 11)]
    with pytest.raises(ValueError):
        search.search_chunks(c, "  ")


def test_read_lines(spark):
    x = files(spark, {"a": "one\ntwo\r\nthree\nfour"})
    read = lambda *a: [(r.line, r.text) for r in search.read_lines(x, "a", *a).orderBy("line").collect()]
    assert read() == [(1, "one"), (2, "two"), (3, "three"), (4, "four")]
    assert read(2, 3) == [(2, "two"), (3, "three")]
    assert read(0, 0, 9) == [(1, "one"), (2, "two")]


# == relations


def test_related_go_ts_generic(spark):
    t = lambda p: spark.createDataFrame([(p,)], "target string")
    x = fixtures.repo(spark)
    got = {r.path: (r.score, r.reasons) for r in related.related(x, t("src/a.ts")).collect()}
    assert got == {"src/b.ts": (14, ["imports", "same_dir"]), "src/c.js": (15, ["imported_by", "same_dir"]), "src/d.mjs": (5, ["same_dir"]), "src/lib/index.tsx": (9, ["imports"])}
    got = [r.path for r in related.related(x, t("docs/guide.md"), related.RelatedOptions(same_dir=False)).collect()]
    assert got == ["README.md"]
    assert related.related(x, t("src/a.ts"), related.RelatedOptions(most=1)).count() == 1


def test_removed_files_are_not_related(spark):
    tree = dict(fixtures.FILES)
    del tree["src/b.ts"]
    assert "src/b.ts" not in {r.dst for r in graph.js_edges(files(spark, tree)).collect()}


def test_bonus(spark):
    x = spark.createDataFrame([(["imported_by", "same_dir"],), (["mention", "new"],), ([],)], "r array<string>")
    from pyspark.sql import functions as F

    assert [r[0] for r in x.select(related.bonus(F.col("r"))).collect()] == [6, 2, 0]


# == outlines


def test_go_outline():
    text = fixtures.FILES["go/pkg/a.go"]
    out = outline.go_outline(text)
    for part in ["package pkg\n", "// A gives one.\nfunc A() int\n", "// T is a pair.\ntype T struct { /* 3 fields */ }\n", "type I interface {\n\tDo(a int) error\n}\n", "const K int\n"]:
        assert part in out
    assert "return" not in out and "import" not in outline.go_outline(fixtures.FILES["cmd/main.go"])
    assert outline.go_outline(fixtures.FILES["go/pkg/b.go"]) == "package pkg\nvar b, c\nfunc (t *T) Sum(z int) (int, error)\n"
    assert outline.go_outline("func broken( {\n") == "func broken( {\nL1: func broken( {\n"


def test_go_summary():
    assert outline.go_summary(fixtures.FILES["go/pkg/a.go"]) == "package pkg\nL4: func A\nL7: type T struct\nL12: type I interface\nL16: const K\n"
    assert "L5: func (*T) Sum\n" in outline.go_summary(fixtures.FILES["go/pkg/b.go"])


def test_js_outline():
    text = "/**\n * Doc.\n */\nexport function f() {\n  return 1;\n}\n/** Lost. */\nx = 1;\nclass A {}\n"
    assert outline.js_outline(text) == "/**\n * Doc.\n */\nexport function f() {\nclass A {}\n"
    assert outline.js_summary(text) == "L4: export function f() {\nL9: class A {}\n"
    assert outline.js_outline("a\nb\n") == "a\nb\n"


def test_generic_outline():
    assert outline.generic("\n# x\nimport os\nclass A:\n    def f(self):\n") == "# x\nimport os\nclass A:\nL4: class A:\nL5: def f(self):\n"


# == context and notes


def test_modes():
    assert context.resolve_mode("full", "navigate")["strategy"] == "explicit_mode"
    assert context.resolve_mode("bad", "navigate")["resolvedMode"] == "outline"
    assert context.resolve_mode(None, " review ")["strategy"] == "intent:review"
    assert context.resolve_mode(None, "other")["strategy"] == "default_auto"


def test_follow_up():
    assert context.follow_up("a", "", []) is None
    assert context.follow_up("a", "f", ["b", "c"])["arguments"] == {"focus": "f", "excludePaths": ["a", "c"], "path": "b", "mode": "full"}


def test_first_chunk_comes_first_without_focus(spark):
    c = chunk.chunks(files(spark, {"a.go": "".join(f"l{i}\n" for i in range(30))}), Config(max_chunk_lines=3))
    got = context.best_chunks(c).orderBy("place").collect()
    assert [r.start_line for r in got] == [1, 4]


def test_notes_upsert_and_search(spark):
    rows = [(1, "k", "one", ["A", "a "], "./docs/../R.md"), (2, "j", "two", [], None), (3, " k ", "three", ["B"], ""), (4, "", "x", [], ""), (5, "e", "  ", [], "")]
    n = notes.upsert(spark.createDataFrame(rows, "seq long, key string, text string, tags array<string>, path string"))
    assert [(r.pos, r.key, r.text, r.tags, r.path) for r in n.orderBy("pos").collect()] == [(1, "k", "three", ["b"], "."), (2, "j", "two", [], ".")]
    assert [r.key for r in notes.search(n, "THREE").collect()] == ["k"]
    assert [r.key for r in notes.search(n, ".").collect()] == ["k", "j"]
    assert [r.key for r in notes.search(n, "", [" B"]).collect()] == ["k"]


# == streams


def test_porcelain():
    blob = " M a.go\0D  b.go\0R  old.go\0new.go\0?? c.go\0"
    assert changes.parse_porcelain(blob) == ({"a.go", "new.go", "c.go"}, {"b.go", "old.go"})
    assert changes.parse_porcelain(blob, new_first=True) == ({"a.go", "old.go", "c.go"}, {"b.go", "new.go"})
    assert changes.parse_porcelain("") == (set(), set())


def test_fixed_delay_isnt_a_session(spark):
    x = spark.createDataFrame([(1, i, i * 400) for i in range(6)], "k int, id int, us long").selectExpr("k", "id", "timestamp_micros(us) AS ts")
    got = changes.fixed_delay_batches(x, "k", "ts", "id", 1000).orderBy("id").collect()
    assert [r.batch for r in got] == [1, 1, 1, 2, 2, 2]


def test_flush_sets(spark):
    x = spark.createDataFrame([("add", "a"), ("add", "a"), ("del", "b"), ("del", "a"), ("add", "vendor/x")], "op string, path string")
    add, gone = changes.fold_changes(x)
    assert ({r.path for r in add.collect()}, {r.path for r in gone.collect()}) == ({"a"}, {"a", "b"})


def test_refresh_edges(spark):
    old = spark.createDataFrame([("js", "a", "b"), ("js", "c", "d")], "lang string, src string, dst string")
    new = spark.createDataFrame([("js", "a", "x"), ("js", "c", "y")], "lang string, src string, dst string")
    got = changes.refresh_edges(old, new, spark.createDataFrame([("a",)], "path string"))
    assert {(r.src, r.dst) for r in got.collect()} == {("a", "x"), ("c", "d")}


def test_first_fit_starts_with_bytes_and_gives_some_back(spark):
    from gneiss.operators import select

    x = spark.createDataFrame([(1, 60, 0), (2, 50, 50), (3, 30, 0), (4, None, 0), (5, 30, 0)], "i int, size long, old long")
    fits = lambda **k: [r.i for r in select.first_fit(x, 100, "size", ["i"], **k).where("fits").orderBy("i").collect()]
    assert fits() == [1, 3] and fits(used=45) == [2]
    assert fits(used=45, back="old") == [2, 3] and fits(used=101) == []


def test_words_in_texts_by_an_automaton(spark):
    from gneiss.operators import related

    texts = spark.createDataFrame([(1, "abcab"), (2, None), (3, ""), (4, "bca ab ж“x”")], "id long, t string")
    words = spark.createDataFrame([("ab",), ("bc",), ("zz",), ("",), ("ж“x",), ("ab",)], "w string")
    for portion in (1 << 20, 3):
        got = sorted(map(tuple, related.find_all(texts, "id", "t", words, "w", portion).collect()))
        assert got == [(1, "ab"), (1, "bc"), (4, "ab"), (4, "bc"), (4, "ж“x")]
    assert related.find_all(texts, "id", "t", words.limit(0), "w").count() == 0


def test_the_best_of_a_directory_don_t_need_all_pairs(spark):
    from gneiss.operators import related

    names = [f"d/f{i:02d}.py" for i in range(30)] + [f"d/g{i}_test.go" for i in range(3)]
    files = spark.createDataFrame([(p, "import d.f29\n" if p == "d/f05.py" else "", 1, 1) for p in names], "path string, content string, size long, mod_time long")
    targets = files.select(F.col("path").alias("target"))
    for most in (1, 2, 5, 40):
        got = {(r.target, r.path, r.score) for r in related.related(files, targets, related.RelatedOptions(most)).collect()}
        want = set()
        for t in names:
            score = {p: 6 if p.endswith("_test.go") else 5 for p in names if p != t}
            for a, b, w in (("d/f05.py", "d/f29.py", 9), ("d/f29.py", "d/f05.py", 10)):
                if t == a:
                    score[b] += w
            want |= {(t, p, s) for p, s in sorted(score.items(), key=lambda x: (-x[1], x[0]))[:most]}
        assert got == want, most


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_first_fit_by_class_equals_one_row_after_another(spark, small_batches):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.randrange(4), r.choice([0, 5, 5, 7, 30, r.randrange(1, 60)]), i) for i in range(300)]
    x = spark.createDataFrame(rows, "g string, k int, size long, i int").repartition(5)
    for by in ([], ["g"]):
        for used in (0, 90, 1000):
            want, total = set(), {}
            for g, k, size, i in sorted(rows, key=lambda t: (t[1], t[2], t[3])):
                g = g if by else 0
                if total.setdefault(g, used) + size <= 400:
                    total[g] += size
                    want.add(i)
            a = select.first_fit_by_class(x, 400, "size", F.col("k"), ["i"], by, used)
            b = select.first_fit(x, 400, "size", ["k", "size", "i"], by, used)
            for y in (a, b):
                assert y.columns == [*x.columns, "fits"] and y.count() == 300
                assert {r.i for r in y.where("fits").collect()} == want
    assert select.first_fit_by_class(x.limit(0), 10, "size", F.col("k"), ["i"]).count() == 0


def test_fixed_delay_by_hand(spark, small_batches):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), None if i % 41 == 0 else r.randrange(3000), i) for i in range(200)] + [("c", 1, 900)]
    x = spark.createDataFrame(rows, "k string, t long, id int").selectExpr("k", "timestamp_micros(t) AS ts", "id", "k AS extra")
    got = {q.id: q.batch for q in changes.fixed_delay_batches(x, "k", "ts", "id", 100).collect()}
    want = {}
    for k in ("a", "b", "c", None):
        start, n = None, 0
        for _, t, i in sorted((q for q in rows if q[0] == k), key=lambda q: (q[1] is not None, q[1] or 0, q[2])):
            if t is not None and (start is None or t > start + 100):
                start, n = t, n + 1
            want[i] = n
    assert got == want
