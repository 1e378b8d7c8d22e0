"""Queries in forms that hold at size: bounded tasks, the same rows."""

import random
import re
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gneiss.functions.batches import slices
from gneiss.operators import chunk, graph, outline, related, search
from gneiss.plans.queries import SMALL
from gneiss.streaming import changes


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_equal_a_join(spark):
    from gneiss.operators.pairs import pairs

    r = random.Random(1)
    some = lambda n: [(r.choice(["a", "b", "c", None]), r.choice([None, *range(20)])) for _ in range(n)]
    a, b = some(60), [*some(40), ("d", 1)]
    want = Counter((x, y) for k, x in a for m, y in b if k is not None and k == m)
    for block in (1, 7, 1000):
        got = pairs(spark.createDataFrame(a, "k string, x int"), spark.createDataFrame(b, "k string, y int"), "k", block)
        assert got.columns == ["x", "y"] and Counter(map(tuple, got.collect())) == want
    assert pairs(spark.createDataFrame(a, "k string, x int"), spark.createDataFrame([], "k string, y int"), "k").count() == 0


def test_the_pairs_of_one_directory_come_out_of_several_tasks(spark, no_broadcast):
    x = spark.range(1100).selectExpr("'d/' || id AS path")
    per = related.same_dir(x, x.select(F.col("path").alias("target"))).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in per) == 1100 * 1099 and len(per) > 1


def _plan(x) -> str:
    return x._jdf.queryExecution().executedPlan().toString()


def _go(spark):
    text = 'package p\n\nimport "m/a"\nimport q "m/a"\nimport "m/b"\n'
    rows = [("go.mod", "module m\n"), *((f"a/{i}.go", text) for i in range(4)), ("a/0.go", text), ("a/x_test.go", text), ("b/1.go", "package b\n")]
    return spark.createDataFrame(rows, "path string, content string")


def test_go_package_edges_count_before_the_join(spark):
    x = graph.go_package_edges(_go(spark))
    # a source that is there twice has its lines twice, a file that is there twice counts twice
    twice = lambda p: 2 if p == "a/0.go" else 1
    a = [*(f"a/{i}.go" for i in range(4)), "a/x_test.go"]
    want = {(s, d, 2 * twice(s) * twice(d)) for s in a for d in a} | {(s, "b/1.go", twice(s)) for s in a}
    assert set(map(tuple, x.collect())) == want and x.count() == len(want)
    assert "hashpartitioning(src" in _plan(x) and "hashpartitioning(src#0, dst" not in re.sub(r"#\d+", "#0", _plan(x))


def test_go_importers_don_t_gather_the_pairs(spark):
    x = graph.go_importers(_go(spark))
    a = [f"a/{i}.go" for i in range(4)]
    want = {(t, s) for s in a for t in (*a, "a/x_test.go", "b/1.go") if s != t}
    assert Counter(map(tuple, x.collect())) == Counter(want)
    assert "hashpartitioning(target#0, src" not in re.sub(r"#\d+", "#0", _plan(x))


def test_slices_are_all_of_a_batch_in_order():
    texts = ["a" * 30, None, "", "ж" * 25, "b" * 500, "c"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(6))], names=["t", "i"])
    got = [p.column(1).to_pylist() for p in slices(batch, 80)]
    assert got == [[0, 1, 2, 3], [4], [5]]
    assert [p.column(0).to_pylist() for p in slices(batch.slice(2, 3), 80)] == [["", "ж" * 25], ["b" * 500]]
    assert sum(p.num_rows for p in slices(batch, 1)) == 6 and list(slices(batch.slice(0, 0))) == []


def test_outlines_of_a_batch_in_slices(monkeypatch):
    text = ["def a(x): pass\n" * 40, None, "", "class B\n"]
    language = pa.array(["", "", "", "go"] * 25)
    monkeypatch.setattr(slices, "__defaults__", (2000,))
    got = outline._each(outline._OUTLINE, language, pa.array(text * 25))
    assert got.to_pylist() == [None if c is None else outline._OUTLINE[k](c) for k, c in zip(language.to_pylist(), text * 25)]
    assert outline._each(outline._SUMMARY, language[:0], pa.array([], pa.string())).to_pylist() == []


def test_chunks_of_a_batch_come_in_parts():
    text = "".join(f"line {i}\n" for i in range(4000))
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i}.go" for i in range(200)]), pa.array(["go"] * 200), pa.array([text] * 199 + [None])], names=["path", "language", "content"])
    parts = list(chunk._chunked(200, 8192)([batch]))
    assert len(parts) > 4 and max(p.nbytes for p in parts) < 3 << 20
    want = [(f"{i}.go", "go", *c) for i in range(199) for c in chunk.chunk_text(text, 200, 8192)]
    assert [tuple(r.values()) for p in parts for r in p.to_pylist()] == want


def test_chunks_of_a_long_text_don_t_hold_all_its_lines():
    text = "ab\n" * (4 << 20)
    batch = pa.RecordBatch.from_arrays([pa.array(["a.go"]), pa.array(["go"]), pa.array([text])], names=["path", "language", "content"])
    tracemalloc.start()
    spans = [x for p in chunk._chunked(200, 8192)([batch]) for x in zip(p.column(2).to_pylist(), p.column(3).to_pylist())]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert spans == [(i + 1, min(i + 200, 4 << 20)) for i in range(0, 4 << 20, 200)]
    assert peak < 4 * len(text)


def test_search_chunks_of_a_long_text_are_cut_without_a_copy_of_it():
    text = "the line of a file\r\n" * (1 << 20)
    batch = pa.RecordBatch.from_arrays([pa.array(["a.md", "b.md", "c.md"]), pa.array(["text"] * 3), pa.array([text, None, ""])], names=["path", "language", "content"])
    run = chunk._chunked(SMALL.max_chunk_lines, SMALL.max_chunk_bytes)
    tracemalloc.start()
    n = sum(p.num_rows for p in run([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == -(-(1 << 20) // SMALL.max_chunk_lines) and peak < len(text) / 2
    want = [("d.md", "text", *c) for c in chunk.chunk_text("the ж\r\n" * 90, SMALL.max_chunk_lines, SMALL.max_chunk_bytes)]
    for kind in (pa.string(), pa.large_string()):
        some = pa.RecordBatch.from_arrays([pa.array(["x", "d.md"]), pa.array(["text"] * 2), pa.array([text[:30], "the ж\r\n" * 90], kind)], names=batch.schema.names).slice(1)
        assert [tuple(r.values()) for p in run([some]) for r in p.to_pylist()] == want


def test_chunks_in_windows_are_those_of_the_whole(monkeypatch):
    r = random.Random(3)
    for alphabet in ("a\n", "ab\n\r", "aж \n\r ", "a" * 30 + "\n"):
        for _ in range(300):
            text, lines, size = "".join(r.choices(alphabet, k=r.randrange(400))), r.randrange(1, 8), r.randrange(1, 20)
            monkeypatch.setattr(chunk, "WINDOW", 1 << 18)
            want = chunk.chunk_text(text, lines, size)
            monkeypatch.setattr(chunk, "WINDOW", 1)
            assert chunk.chunk_text(text, lines, size) == want


def test_search_finds_the_same_in_slices(spark, monkeypatch):
    text = "the other line\n" * 300
    x = spark.createDataFrame([(f"{i}.md", text if i % 3 else "none\n") for i in range(60)], "path string, content string").coalesce(1)
    found = lambda: [(r.path, r.start_line, r.score) for r in search.search_chunks(chunk.chunks(x, SMALL), "the", 0).orderBy("path", "start_line").collect()]
    want = found()
    whole = [(f"{i}.md", a, 10 + c.count("the")) for i in range(60) if i % 3 for a, _, c in chunk.chunk_text(text, SMALL.max_chunk_lines, SMALL.max_chunk_bytes)]
    assert want == sorted(whole)
    run = chunk._chunked(SMALL.max_chunk_lines, SMALL.max_chunk_bytes)
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i}.md" for i in range(60)]), pa.array(["text"] * 60), pa.array([text if i % 3 else "none\n" for i in range(60)])], names=["path", "language", "content"])
    monkeypatch.setattr(slices, "__defaults__", (5000,))
    parts = list(run([batch]))
    assert len(parts) > 20 and sum(p.num_rows for p in parts if p) == len(whole) + 20


def test_search_over_the_chunks_of_a_long_text_in_parts(spark):
    text = "".join(f"the line {i}\n" for i in range(200_000))
    batch = pa.RecordBatch.from_arrays([pa.array(["a.md", "b.md"]), pa.array(["text"] * 2), pa.array([text, "the\n"])], names=["path", "language", "content"])
    parts = list(chunk._chunked(SMALL.max_chunk_lines, SMALL.max_chunk_bytes)([batch]))
    assert len(parts) > 2 and max(p.nbytes for p in parts) < 3 << 20 and sum(p.num_rows for p in parts) == 10_001
    x = spark.createDataFrame([("a.md", text), ("b.md", "the\n")], "path string, content string")
    got = {(r.path, r.start_line): r.score for r in search.search_chunks(chunk.chunks(x, SMALL), "the", 0).collect()}
    assert got == {("a.md", i): 30 for i in range(1, 200_001, 20)} | {("b.md", 1): 11}


def test_symbol_uses_by_hand(spark):
    from itertools import product

    r = random.Random(5)
    uses = [(r.choice(["p", "q", "s", None]), r.choice([*"abcd", None]), r.choice([*"abcdef", None]), r.choice([1, 2, 7, None])) for _ in range(60)]
    targets = [*"abe", "z", "a"]
    x = related.go_uses(spark.createDataFrame([(t,) for t in targets], "target string"), spark.createDataFrame(uses, "package string, file string, def_file string, n long"))
    per, want = {}, Counter()
    for p, _, d, n in uses:
        per.setdefault((p, d), []).append(n)
    per = {k: sum(n for n in v if n is not None) if any(n is not None for n in v) else None for k, v in per.items() if None not in k}
    for (p, f), ((q, d), n) in product({(p, f) for p, f, *_ in uses if None not in (p, f)}, per.items()):
        if p == q and f != d:
            if d in targets:
                want[d, f, "go_types_refs_target"] += 12 + min(3, 3 if n is None else n)
            if f in targets:
                want[f, d, "go_types_used_by_target"] += 7 + min(5, 5 if n is None else n)
    assert {(q.target, q.path, q.reason): q.w for q in x.collect()} == want and x.count() == len(want)
    # the uses by package, and the pairs once
    assert len(re.findall(r"Exchange hashpartitioning\((?:def_file|file)#\d+[^,]*, (?:def_file|file)#", _plan(x))) == 0


def test_symbol_uses_make_the_pairs_once(spark, no_broadcast):
    u = spark.createDataFrame([("p", "a", "b", 1)], "package string, file string, def_file string, n long")
    assert _plan(related.go_uses(u.select(F.col("def_file").alias("target")), u)).count("SortMergeJoin [package") == 1


def test_status_of_a_batch_in_slices(monkeypatch):
    blobs = [" M a\0?? b\0D  c\0", None, "", "R  new\0old\0C  x\0y\0"] * 50
    monkeypatch.setattr(slices, "__defaults__", (100,))
    parts = []
    monkeypatch.setattr(changes, "slices", lambda b: (parts.append(p) or p for p in slices(b)))
    got = changes.status_paths.func(pa.array(blobs)).to_pylist()
    assert len(parts) > 10
    for b, have in zip(blobs, got, strict=True):
        add, gone = changes.parse_porcelain(b or "")
        assert have == [{"op": "add", "path": p} for p in sorted(add)] + [{"op": "del", "path": p} for p in sorted(gone)]
    assert changes.status_paths.func(pa.array([], pa.string())).to_pylist() == []
