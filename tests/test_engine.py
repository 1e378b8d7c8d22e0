import os
import subprocess
import time

import pytest

from gneiss.config import Config
from gneiss.engine import Engine, strings, whole
from gneiss.plans import fixtures
from gneiss.sources.store import Store
from gneiss.sources.tree import walk
from gneiss.streaming import changes


def write(root, tree):
    for p, c in tree.items():
        f = root / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(c)


@pytest.fixture
def engine(spark, tmp_path):
    write(tmp_path / "repo", fixtures.FILES | {".hidden/_x.go": "package x\n", "node_modules/y.js": "", "long.txt": "short\n" + "x" * 50 + "\n"})
    return Engine(spark, str(tmp_path / "repo"), str(tmp_path / "store"))


def test_arguments():
    assert [whole(x, 5) for x in (2.9, 0, -1, "3", True, None, float("nan"))] == [2, 5, 5, 5, 5, 5, 5]
    assert whole(0, 5, 0) == 0
    assert strings(["a", 1]) is None
    assert Config.from_env({"GNEISS_MAX_TOTAL_BYTES": "7", "GNEISS_MAX_FILE_BYTES": "x"}).max_total_bytes == 7


def test_files(engine):
    names = engine.repo_list_files()["files"]
    assert "pkg/__init__.py" in names and ".hidden/_x.go" in names and not any(n.startswith("node_modules") for n in names)
    assert engine.repo_list_files("src/*.ts")["files"] == ["src/a.ts", "src/b.ts"]
    assert engine.call("repo.read_file", {"path": "./pkg/../go.mod", "startLine": 3})["structuredContent"]["content"] == "go 1.22\n"
    with pytest.raises(ValueError):
        engine.repo_read_file("long.txt", maxBytes=20)
    assert engine.repo_read_file("long.txt", endLine=1, maxBytes=20)["content"] == "short\n"
    for bad, error in (("../x", ValueError), ("pkg", IsADirectoryError), ("none", FileNotFoundError), ("", ValueError)):
        with pytest.raises(error):
            engine.repo_read_file(bad)
    assert engine.repo_search("helper", contextLines=1)["matches"] == [{"path": "pkg/main.py", "line": 2, "snippet": "import pkg.util as u, os\nfrom pkg.sub import (helper)"}]


def test_index_and_refresh(engine):
    s = engine.repo_reindex()
    assert s["ready"] and s["filesIndexed"] > 5 and not s["partial"] and s["lastIndexedAt"].endswith("Z")
    assert [r["path"] for r in engine.search_index("gives one")] == ["go/pkg/a.go"]
    root = engine.root
    with open(os.path.join(root, "go/pkg/a.go"), "w") as f:
        f.write("package pkg\n// changed\n")
    os.remove(os.path.join(root, "src/b.ts"))
    engine.refresh()
    assert engine.search_index("gives one") == []
    assert [r["path"] for r in engine.search_index("changed")] == ["go/pkg/a.go"]
    assert "src/b.ts" not in {r.path for r in engine.index().collect()}
    assert engine.repo_index_debug()["filesIndexed"] == engine.repo_index_status()["filesIndexed"]
    engine.repo_clear_index()
    assert not engine.repo_index_status()["ready"]


def test_context(engine):
    full = engine.repo_context("src/a.ts", mode="full")
    assert full["files"][0]["path"] == "src/a.ts" and full["limits"]["usedBytes"] > 0 and "suggestedNextCall" not in full
    auto = engine.repo_context("src/a.ts", intent="implement", excludePaths=["src/c.js"])
    assert [f["mode"] for f in auto["files"]][0] == "full" and all(f["mode"] == "outline" for f in auto["files"][1:])
    assert "src/c.js" not in [f["path"] for f in auto["files"]] and auto["suggestedNextCall"]["arguments"]["mode"] == "full"
    out = engine.repo_context("src/a.ts", intent="navigate", maxTotalBytes=60)
    assert out["mode"] == "outline" and out["limits"]["clamped"]


def test_notes_are_isolated(engine, spark, tmp_path):
    n = engine.memory_upsert("repo-overview", "About it", ["MCP", "Repo", "mcp"], "./docs/../README.md", {"a": "1", "b": 2})
    assert (n["tags"], n["path"], n["meta"]) == (["mcp", "repo"], "README.md", {"a": "1"})
    engine.memory_upsert("other", "More")
    engine.memory_upsert("repo-overview", "New text")
    assert [x["key"] for x in engine.memory_search("e")["notes"]] == ["repo-overview", "other"]
    with pytest.raises(ValueError):
        engine.memory_search()
    (tmp_path / "two").mkdir()
    assert engine.call("memory_search", {"root": str(tmp_path / "two"), "query": "e"})["structuredContent"] == {"notes": []}
    engine.memory_clear()
    assert engine.memory_search("e")["notes"] == []


def test_workspace_checks(engine):
    with pytest.raises(ValueError):
        engine.switch_workspace("relative")
    with pytest.raises(NotADirectoryError):
        engine.switch_workspace("/no/such/place")
    with pytest.raises(ValueError):
        engine.call("nothing")


def test_broken_tables_read_as_empty(spark, tmp_path):
    s = Store(spark, str(tmp_path), "r")
    assert s.read("t", "a int").count() == 0
    s.write("t", spark.range(3).selectExpr("CAST(id AS INT) AS a"))
    assert s.read("t", "a int").count() == 3
    s.clear("t")
    assert s.read("t", "a int").count() == 0


def test_walk_order(tmp_path):
    write(tmp_path, {"a.txt": "", "a/b": "", "B": "", ".git/x": ""})
    assert [p for p, _, _ in walk(str(tmp_path))] == ["B", "a/b", "a.txt"]


def test_git_stream(spark, tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path / "w")], check=True)
    (tmp_path / "w/new.go").write_text("x")
    seen = []
    q = changes.run_stream(changes.change_stream(spark, "git", str(tmp_path / "w")), lambda add, gone: seen.append(({r.path for r in add.collect()}, {r.path for r in gone.collect()})), str(tmp_path / "c"), "200 milliseconds")
    try:
        end = time.time() + 60
        while not any(seen) and time.time() < end:
            time.sleep(0.2)
    finally:
        q.stop()
    assert ({"new.go"}, set()) in seen


def test_tree_stream(spark, tmp_path):
    write(tmp_path / "t", {"a": "1", "vendor/b": "", "c": ""})
    seen = []
    x = changes.change_stream(spark, "auto", str(tmp_path / "t"))
    q = changes.run_stream(x, lambda add, gone: seen.append(({r.path for r in add.collect()}, {r.path for r in gone.collect()})), str(tmp_path / "c2"), "200 milliseconds")

    def wait(what):
        end = time.time() + 60
        while what not in seen and time.time() < end:
            time.sleep(0.2)
        assert what in seen

    try:
        wait(({"a", "c"}, set()))
        (tmp_path / "t/a").write_text("22")
        os.remove(tmp_path / "t/c")
        wait(({"a"}, {"c"}))
    finally:
        q.stop()


def test_call_log(spark, tmp_path):
    (tmp_path / "r").mkdir()
    e = Engine(spark, str(tmp_path / "r"), str(tmp_path / "s"), log=str(tmp_path / "log"))
    e.call("memory_upsert", {"key": "k", "text": "x" * 5000})
    assert len((tmp_path / "log").read_text()) < 2300


def tree(tmp_path, sizes, name="b"):
    write(tmp_path / name, {p: "x" * (n - 1) + "\n" for p, n in sizes.items()})
    return str(tmp_path / name)


def held(e):
    return {r.path: r.size for r in e.index().collect()}


def test_refresh_keeps_the_budget(spark, tmp_path):
    root = tree(tmp_path, {f"f{i}.md": 1000 for i in range(2)})
    e = Engine(spark, root, str(tmp_path / "s"), Config(max_total_bytes=2500))
    assert e.repo_reindex()["bytesIndexed"] == 2000
    tree(tmp_path, {f"g{i}.md": 1000 for i in range(5)} | {"a.go": 400})
    s = e.refresh()
    # the full order is priority, then size: the small Go file comes first, and no other fits
    assert held(e) == {"f0.md": 1000, "f1.md": 1000, "a.go": 400} and s["bytesIndexed"] == 2400 and s["partial"]
    os.remove(os.path.join(root, "f0.md"))
    e.refresh()
    assert held(e) == {"f1.md": 1000, "a.go": 400, "g0.md": 1000}
    # a changed file is measured by its whole size, and gives its old size back
    tree(tmp_path, {"a.go": 50, "g0.md": 1010})
    s = e.refresh()
    assert held(e) == {"f1.md": 1000, "a.go": 50, "g0.md": 1000} and s["partial"]
    for i in range(5):
        if i:
            os.remove(os.path.join(root, f"g{i}.md"))
    os.remove(os.path.join(root, "f1.md"))
    assert not e.refresh()["partial"] and held(e) == {"a.go": 50, "g0.md": 1010}


def test_changed_paths_are_taken_in_order_within_the_budget(spark, tmp_path):
    root = tree(tmp_path, {"k.md": 1000})
    e = Engine(spark, root, str(tmp_path / "s"), Config(max_total_bytes=2600, max_file_bytes=1500))
    e.repo_reindex()
    tree(tmp_path, {"z.go": 100, "b.md": 900, "a.md": 1000, "big.md": 1600, "c.txt": 10, "vendor/v.go": 100, "x.key": 5})
    open(os.path.join(root, "empty.md"), "w").close()
    s = e.refresh(["z.go", "./b.md", "sub/../a.md", "big.md", "c.txt", "vendor/v.go", "x.key", "none.md", "../out.md", "empty.md", ""])
    # by path: a.md fits, b.md doesn't, the rest does but for what the rules leave out
    assert held(e) == {"k.md": 1000, "a.md": 1000, "z.go": 100, "empty.md": 0} and not s["partial"]
    assert {r["path"] for r in e.search_index("xxx")} == {"a.md", "k.md", "z.go"}
    e.refresh([], spark.createDataFrame([("a.md",)], "path string"))
    assert held(e) == {"k.md": 1000, "z.go": 100, "empty.md": 0}


def test_a_filter_on_paths_reaches_the_source(spark, tmp_path):
    write(tmp_path / "t", {"a.md": "1", "b/c.md": "2", "vendor/d": "3", "e.md": "4"})
    from gneiss.sources.tree import look, read_tree, with_content

    x = read_tree(spark, str(tmp_path / "t"))
    plan = lambda y: y._jdf.queryExecution().executedPlan().toString()
    one = x.where("path = 'b/c.md'").select("path", "content")
    assert "Filter" not in plan(one).replace("PushedFilters", "").replace("RuntimeFilters", "") and [tuple(r) for r in one.collect()] == [("b/c.md", "2")]
    some = x.where("path IN ('a.md', 'vendor/d', '../t/e.md', 'no') AND size = 1")
    assert [r.path for r in some.collect()] == ["a.md"]
    assert [r.content for r in read_tree(spark, str(tmp_path / "t"), content="false").orderBy("path").collect()] == [None] * 3
    (tmp_path / "t/link").symlink_to(tmp_path / "t/b")
    assert look(str(tmp_path / "t"), ["link/c.md", "a.md", "b", "b/c.md"]) == [f for f in walk(str(tmp_path / "t")) if f[0] in ("a.md", "b/c.md")]
    meta = x.select("path", "size", "mod_time").where("path <> 'a.md'")
    assert {(r.path, r.content) for r in with_content(meta, str(tmp_path / "t"), 1).collect()} == {("b/c.md", "2"), ("e.md", "4")}


def test_an_update_writes_the_parts_it_touches(spark, tmp_path):
    s = Store(spark, str(tmp_path), "r")
    rows = spark.range(200).selectExpr("CONCAT('p', id) AS path", "id AS n")
    s.write("t", rows)
    before = s.parts("t")
    s.upsert_paths("t", "path string, n long", spark.createDataFrame([("p7", -1), ("new", -2)], "path string, n long"), spark.createDataFrame([("p7",), ("new",)], "path string"))
    after = s.parts("t")
    assert 1 <= sum(before.get(k) != v for k, v in after.items()) <= 2 and all(os.path.isdir(p) for p in after.values())
    got = {r.path: r.n for r in s.read("t", "path string, n long").collect()}
    assert len(got) == 201 and got["p7"] == -1 and got["new"] == -2 and got["p8"] == 8
    s.remove_paths("t", "path string, n long", rows.select("path"))
    assert [tuple(r) for r in s.read("t", "path string, n long").collect()] == [("new", -2)]
    assert sum(n.startswith("t-") for n in os.listdir(s.dir)) <= 2  # what was replaced is gone


def wait(what, seconds=90):
    end = time.time() + seconds
    while not what() and time.time() < end:
        time.sleep(0.3)
    assert what()


def test_watch(engine):
    seen = []
    w = engine.watch(changed=lambda add, gone: seen.append((set(add), set(gone))))
    root = engine.root
    try:
        wait(lambda: seen)  # what is there already
        assert "go/pkg/a.go" in held(engine)
        near = lambda: {r["path"]: r["reasons"] for r in engine.repo_related_files("src/b.ts", includeSameDir=False)["related"]}
        assert near() == {"src/a.ts": ["imported_by"], "src/lib/index.tsx": ["imported_by"]} and engine.store.parts("edges")
        with open(os.path.join(root, "src/a.ts"), "w") as f:
            f.write("const nothing = 1;\n")
        wait(lambda: any("src/a.ts" in add for add, _ in seen[1:]))
        assert near() == {"src/lib/index.tsx": ["imported_by"]}
        os.remove(os.path.join(root, "src/lib/index.tsx"))
        with open(os.path.join(root, "src/e.js"), "w") as f:
            f.write("import x from './b';\n")
        wait(lambda: any("src/lib/index.tsx" in gone for _, gone in seen) and any("src/e.js" in add for add, _ in seen))
        assert near() == {"src/e.js": ["imported_by"]}
        assert [r["path"] for r in engine.search_index("import x from")] == ["src/e.js"] and "src/lib/index.tsx" not in held(engine)
    finally:
        w.stop()
    assert engine.watching is None and w.batches >= 3


def test_full_passes_of_a_watch(spark, tmp_path):
    """The poller finds what no event told of."""
    root = tree(tmp_path, {"a.md": 10})
    e = Engine(spark, root, str(tmp_path / "s"), Config(poll_seconds=1, flush_ms=600_000))
    w = e.watch()
    try:
        tree(tmp_path, {"b.md": 20})
        wait(lambda: held(e) == {"a.md": 10, "b.md": 20})
    finally:
        w.done.set()
        w.stop()


def test_detectors(tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path / "w")], check=True)
    (tmp_path / "d/.git").mkdir(parents=True)
    found = {(d, n): changes.choose_detector(d, str(tmp_path / n)) for d in (" Git ", "fs", "auto", "?") for n in ("w", "d")}
    assert found[" Git ", "w"] == "git" and {v for k, v in found.items() if k != (" Git ", "w")} == {"fs"}
    r = changes.GitStatusReader({"path": str(tmp_path / "d")})
    with pytest.raises(RuntimeError):
        r.read({"poll": 0})


def test_a_batch_ends_after_its_first_event(tmp_path):
    import threading

    write(tmp_path / "q", {"a": "1"})
    r = changes.TreeChangeReader({"path": str(tmp_path / "q"), "delayMs": "700"})
    threading.Timer(0.3, lambda: write(tmp_path / "q", {"b": "2"})).start()
    threading.Timer(1.4, lambda: write(tmp_path / "q", {"c": "3"})).start()
    rows, at = r.read({"poll": 0})
    assert sorted(rows) == [("add", "a"), ("add", "b")]
    time.sleep(1.2)
    assert sorted(r.read(at)[0]) == [("add", "c")]


def test_tools_and_calls_over_lines(engine):
    import json

    tools = {t["name"]: t for t in engine.tools()}
    assert set(tools) == set(engine.TOOLS) and tools["repo_search"]["annotations"] == {"readOnlyHint": True} and tools["memory_clear"]["annotations"] == {"readOnlyHint": False, "destructiveHint": True}
    assert tools["repo_read_file"]["inputSchema"]["required"] == ["path"]
    ask = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "repo.read_file", "arguments": {"path": "go.mod", "endLine": 1}}}, {"id": 4, "method": "tools/call", "params": {"name": "repo_read_file", "arguments": {"path": "../x"}}}, {"id": 5, "method": "no"}]
    out = []
    engine.serve([*map(json.dumps, ask), "{", ""], lambda x: out.append(json.loads(x)))
    assert [x["id"] for x in out] == [1, 2, 3, 4, 5, None] and len(out[1]["result"]["tools"]) == 13
    assert out[2]["result"]["structuredContent"]["content"] == "module example.com/app\n" and "error" in out[3] and out[4]["error"]["code"] == -32601


def test_cancel(engine):
    import threading

    spark, got = engine.spark, []
    slow = lambda: engine.spark.range(0, 100, 1, 4).selectExpr("max(java_method('java.lang.Thread', 'sleep', 300L))").collect()

    def run():
        spark.sparkContext.setJobGroup("job-1", "slow", True)
        try:
            slow()
            got.append("done")
        except Exception:
            got.append("stopped")

    from pyspark import InheritableThread

    t = InheritableThread(target=run)
    t.start()
    end = time.time() + 30
    while not got and time.time() < end:
        time.sleep(0.5)
        engine.cancel("job-1")
    t.join(60)
    assert got == ["stopped"]
    assert threading.active_count() > 0


def test_chunks_as_json_lines(engine, tmp_path):
    engine.repo_reindex()
    engine.export_chunks(str(tmp_path / "out"))
    assert sorted(map(tuple, engine.exported_chunks(str(tmp_path / "out")).collect())) == sorted(map(tuple, engine.chunks().collect()))
    with pytest.raises(FileNotFoundError):
        engine.exported_chunks(str(tmp_path / "none"))
