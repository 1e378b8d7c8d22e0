"""The tools as methods: arguments are checked here, the work is in plans; results are small Python values.

A workspace is a root directory; its tables live in a store folder of its own, told apart by the hash of the root. One writer at a time changes a store (within this process); watch() keeps it fresh.
"""

from __future__ import annotations

import inspect
import json
import math
import os
import threading
import uuid
from collections import defaultdict
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import paths as P
from .functions import text as X
from .operators import chunk, context, graph, notes, related, search, select
from .sources.store import Store, read_jsonl, repo_id, write_jsonl
from .sources.tree import read_tree, with_content
from .streaming import changes

EDGES = "lang string, src string, dst string"
_locks: dict[str, threading.RLock] = defaultdict(threading.RLock)
INDEX = "path string, id string, size long, mod_time long, hash string, language string, chunks int"


def whole(value, default: int, least: int = 1) -> int:
    """A JSON number cut to a whole one; the default where it is no number or below `least`."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        return default
    return int(value) if int(value) >= least else default


def strings(value) -> list[str] | None:
    """A list of strings, or None if any item isn't one."""
    return list(value) if isinstance(value, (list, tuple)) and all(isinstance(x, str) for x in value) else None


class Engine:
    def __init__(self, spark: SparkSession, root: str, store: str, config: Config | None = None, log: str = ""):
        """log: a file to which calls are added as JSON lines, for development."""
        self.spark, self.base, self.config, self.log = spark, store, config or Config.from_env(), log
        self.switch_workspace(root)

    # == workspaces

    def switch_workspace(self, root: str) -> dict:
        root = root.strip()
        if not os.path.isabs(root):
            raise ValueError("the root must be an absolute path")
        if not os.path.isdir(root):
            raise NotADirectoryError(root)
        self.root = os.path.normpath(root)
        self.store = Store(self.spark, self.base, repo_id(self.spark, self.root))
        self.lock = _locks[self.store.dir]
        self.error, self.watching = "", None
        return {"root": self.root}

    def meta(self, own: bool = False) -> DataFrame:
        """path, size, mod_time of the files: none is opened."""
        return read_tree(self.spark, self.root, own=str(own).lower(), content="false").select("path", "size", "mod_time")

    def files(self, own: bool = False) -> DataFrame:
        return read_tree(self.spark, self.root, own=str(own).lower())

    @contextmanager
    def _read_once(self):
        """The files for a plan of many branches, so that each is read once."""
        x = self.files().persist(StorageLevel.DISK_ONLY)
        try:
            yield x
        finally:
            x.unpersist()

    def _path(self, path) -> str:
        if not isinstance(path, str) or not path.strip():
            raise ValueError("missing path")
        done = self.spark.range(1).select(P.safe(F.lit(path))).first()[0]
        if done is None:
            raise ValueError(f"path leads out of the root: {path}")
        if os.path.isdir(os.path.join(self.root, done)):
            raise IsADirectoryError(done)
        if not os.path.isfile(os.path.join(self.root, done)):
            raise FileNotFoundError(done)
        return done

    # == files

    def repo_list_files(self, glob: str = "", max=None) -> dict:
        x = select.listing(self.meta(), glob, whole(max, 2000))
        return {"files": [r.path for r in x.collect()]}

    def repo_read_file(self, path: str, startLine=None, endLine=None, maxBytes=None) -> dict:
        path, start, stop, most = self._path(path), whole(startLine, 0), whole(endLine, 0), whole(maxBytes, 200_000)
        x = self.files(own=False).where(F.col("path") == path)
        rows = search.read_lines(x, path, start, stop, most).orderBy("line").collect()
        every = x.select(F.posexplode(X.lines("content")).alias("i", "text"))
        bad = every.where(F.octet_length("text") >= most).agg(F.min("i")).first()[0]
        last = rows[-1].line if rows else 0
        if bad is not None and bad + 1 <= last + 1 and (stop == 0 or bad + 1 <= stop):
            raise ValueError(f"line {bad + 1} is longer than the limit")
        return {"path": path, "startLine": start, "endLine": stop, "content": "".join(f"{r.text}\n" for r in rows)}

    def repo_search(self, query: str, glob: str = "", maxResults=None, caseSensitive: bool = False, contextLines=None, maxFileBytes=None) -> dict:
        cfg = Config(search_file_bytes=whole(maxFileBytes, 1_000_000))
        x = search.search_lines(self.files(), query, whole(maxResults, 50), glob, caseSensitive is True, whole(contextLines, 0, 0), cfg)
        return {"query": query, "matches": [r.asDict() for r in x.collect()]}

    def repo_related_files(self, path: str, max=None, includeSameDir=True, includeImports=True, includeImporters=True, includeReferences=True, symbol_uses: DataFrame | None = None) -> dict:
        path = self._path(path)
        options = related.RelatedOptions(whole(max, 50), includeSameDir is not False, includeImports is not False, includeImporters is not False, includeReferences is not False)
        with self._read_once() as files:
            x = related.related(files, self._target(path), options, symbol_uses=symbol_uses, edges=self._edges()).orderBy("rank")
            return {"path": path, "related": [{"path": r.path, "score": r.score, "reasons": r.reasons} for r in x.collect()]}

    def _target(self, path: str) -> DataFrame:
        return self.spark.range(1).select(F.lit(path).alias("target"))

    # == context

    def repo_context(self, path: str, mode=None, intent=None, focus="", maxFiles=None, maxChunksPerFile=None, maxTotalBytes=None, excludePaths=None, includeSameDir=True, includeImports=True, includeImporters=True, includeReferences=True) -> dict:
        path = self._path(path)
        focus = focus if isinstance(focus, str) else ""
        o = context.ContextOptions(focus, whole(maxFiles, 10), whole(maxChunksPerFile, 2), whole(maxTotalBytes, 120_000))
        how = context.resolve_mode(mode, intent)
        flags = (includeSameDir is not False, includeImports is not False, includeImporters is not False, includeReferences is not False)
        with self._read_once() as x:
            return self._context(x, path, o, how, flags, strings(excludePaths))

    def _context(self, x: DataFrame, path: str, o: context.ContextOptions, how: dict, flags: tuple, gone: list[str] | None) -> dict:
        target = self._target(path)
        near = related.related(x, target, related.RelatedOptions(o.max_files * 3, *flags), edges=self._edges())
        without = None
        if gone:
            without = self.spark.createDataFrame([(os.path.normpath(p),) for p in gone], "path string")
        paths = context.file_list(target, near, o, without)
        names = paths.select("path")
        some = x.join(F.broadcast(names), "path", "left_semi")
        chunks = chunk.chunks(select.changed_candidates(some, self.config), self.config)
        limits = {"maxFiles": o.max_files, "maxTotalBytes": o.max_bytes}
        if how["resolvedMode"] in ("outline", "summary"):
            rows = context.outline_pack(paths, some, o, how["resolvedMode"] == "summary").orderBy("file_place").collect()
            out = [{"path": r.path, "outline": r.outline, "mode": how["resolvedMode"]} for r in rows if r.fits]
            used, clamped = max((r.total for r in rows if r.fits), default=0), any(not r.fits for r in rows)
        elif how["resolvedMode"] == "auto":
            own, rest = context.auto(paths, some, chunks, o)
            own, rows = own.orderBy("place").collect(), rest.orderBy("file_place").collect()
            out = [{"path": path, "mode": "full", "chunks": [self._chunk(r) for r in own]}] if own else []
            out += [{"path": r.path, "mode": "outline", "outline": r.outline} for r in rows if r.fits]
            used = max([sum(len(r.content.encode()) for r in own), *(r.total for r in rows if r.fits)])
            clamped = any(not r.fits for r in rows)
            limits["maxChunksPerFile"] = o.chunks_per_file
        else:
            rows = context.full(paths, chunks, o).orderBy(F.desc("rank"), "path", "start_line").collect()
            kept: dict[str, list] = {}
            for r in rows:
                if r.fits:
                    kept.setdefault(r.path, []).append((r.file_place, r))
            order = sorted(kept, key=lambda p: (p != path, kept[p][0][0]))
            out = [{"path": p, "chunks": [self._chunk(r) for _, r in kept[p]]} for p in order]
            used, clamped = max((r.total for r in rows if r.fits), default=0), any(not r.fits for r in rows)
            limits["maxChunksPerFile"] = o.chunks_per_file
        answer = {"path": path, "focus": o.focus, "intent": how["requestedIntent"], "mode": how["resolvedMode"], "resolved": how, "files": out, "limits": limits | {"usedBytes": used, "clamped": clamped}}
        if how["resolvedMode"] != "full" and (more := context.follow_up(path, o.focus, [f["path"] for f in out if f["path"] != path])):
            answer["suggestedNextCall"] = more
        return answer

    @staticmethod
    def _chunk(r) -> dict:
        return {"path": r.path, "startLine": r.start_line, "endLine": r.end_line, "content": r.content}

    # == index

    def repo_reindex(self) -> dict:
        """A full build: selection, first-fit budget on metadata, chunks of what fits."""
        with self.lock:
            # one listing for all that is asked of it
            meta = self.meta(own=True).persist(StorageLevel.DISK_ONLY)
            fit = select.budgeted(meta, self.config).persist(StorageLevel.DISK_ONLY)
            total, kept = fit.agg(F.count("*"), F.count_if("fits")).first()
            taken = with_content(fit.where("fits"), self.root)
            self.store.write("chunks", chunk.chunks(taken, self.config))
            self.store.write("index", select.index_rows(taken, self.chunks()))
            fit.unpersist(), meta.unpersist()
            self._status(kept < total)
        return self.repo_index_status()

    def _status(self, partial: bool) -> None:
        self.store.write("status", self.spark.createDataFrame([(datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), partial)], "at string, partial boolean"))

    def refresh(self, paths: list[str] | DataFrame | None = None, removed: DataFrame | None = None) -> dict:
        """An incremental pass over all files, by the full scan's rules and order: what is gone goes, what is new or changed is cut anew as far as the budget allows; the status says whether something
        didn't fit. With `paths` (a list, or a table that is bounded as a change batch is) only these are looked at, in the order of their paths, by the rules for changes; `removed` go first.

        A file is taken if all that is indexed and its whole size stay within the budget; its old size is given back then. A changed file that isn't taken keeps its old entry."""
        with self.lock:
            if removed is not None:
                for table, schema in (("chunks", chunk.CHUNKS), ("index", INDEX)):
                    self.store.remove_paths(table, schema, removed)
            old, meta = self.index(), self.meta(own=True)
            gone = None
            if paths is None:
                now = select.candidates(meta, self.config)
                gone = select.deleted(old, now).select("path")
                order = [select.priority("path", self.config), "size", "path"]
            else:
                given = paths if not isinstance(paths, DataFrame) else [r.path for r in paths.select("path").distinct().collect()]
                names = sorted({os.path.normpath(p.strip()) for p in given if p.strip()})
                now = select.changed_candidates(meta.where(F.col("path").isin(names)) if names else meta.limit(0), self.config)
                order = ["path"]
            held = old if gone is None else old.join(gone, "path", "left_anti")
            used = held.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
            new = select.changed(now, old).join(old.select("path", F.col("size").alias("_old")), "path", "left").withColumn("_old", F.coalesce("_old", F.lit(0)))
            fit = select.first_fit(new, self.config.max_total_bytes, "size", order, used=used, back="_old").persist()
            taken = fit.where("fits")
            left = fit.where("NOT fits").limit(1).count()
            touched = taken.select("path") if gone is None else gone.union(taken.select("path"))
            fresh = chunk.chunks(with_content(taken, self.root), self.config).persist()
            rows = select.index_rows(with_content(taken, self.root), fresh)
            self.store.upsert_paths("chunks", chunk.CHUNKS, fresh, touched)
            self.store.upsert_paths("index", INDEX, rows, touched)
            fit.unpersist(), fresh.unpersist()
            if paths is None:
                self._status(left > 0)
        return self.repo_index_status()

    # == live index

    def watch(self, detector: str = "auto", checkpoint: str | None = None, changed=None) -> Watch:
        """Keeps the index fresh until the result's stop(): a full pass, then a change stream (see change_stream) whose batches end config.flush_ms after their first event, and, where the
        root is no git work tree, a full pass every config.poll_seconds. changed(add, del) is called after each batch."""
        return Watch(self, detector, checkpoint or os.path.join(self.store.dir, f"stream-{uuid.uuid4().hex}"), changed)

    def _edges(self) -> DataFrame | None:
        """Import edges at hand: kept while a watch runs, computed when first asked for."""
        if self.watching is None:
            return None
        with self.lock:
            if not self.store.parts("edges"):
                self.store.write("edges", graph.import_edges(self.files(), self.config))
            return self.store.read("edges", EDGES)

    def _stale_edges(self, add: list[str], gone: list[str]) -> None:
        """Where files came or went, names may lead elsewhere, so all edges of the workspace go; where files only changed, theirs are computed anew."""
        if not self.store.parts("edges"):
            return
        names = self.spark.createDataFrame([(p,) for p in [*add, *gone]], "path string")
        flags = changes.class_flags("path")
        if not names.where(flags["js"] | flags["php"] | F.col("path").endswith(".py")).limit(1).count():
            return
        old = self.index().select("path").where(F.col("path").isin(add)).count() if add else 0
        if gone or old < len(add):
            self.store.clear("edges")
            return
        some = with_content(self.meta().where(F.col("path").isin(add)), self.root)
        # all files by name, the changed ones with their text: only they have edges to find
        x = self.meta().join(some.select("path", "content"), "path", "left").withColumn("content", F.coalesce("content", F.lit("")))
        self.store.write("edges", changes.refresh_edges(self.store.read("edges", EDGES), graph.import_edges(x, self.config), names))

    def chunks(self) -> DataFrame:
        return self.store.read("chunks", chunk.CHUNKS)

    def index(self) -> DataFrame:
        return self.store.read("index", INDEX)

    def repo_index_status(self) -> dict:
        s = select.status(self.index()).first()
        last = self.store.read("status", "at string, partial boolean").first()
        return {"ready": s.ready, "filesIndexed": s.files_indexed, "bytesIndexed": s.bytes_indexed, "lastIndexedAt": last.at if last else "", "partial": bool(last and last.partial), "error": self.error}

    def repo_clear_index(self) -> dict:
        with self.lock:
            for t in ("chunks", "index", "status", "edges"):
                self.store.clear(t)
        return {"cleared": True}

    def repo_index_debug(self) -> dict:
        c = self.config
        s = self.repo_index_status()
        lists = {"preferredExts": c.preferred_exts, "allowGlobs": c.allow_globs, "denyGlobs": c.deny_globs, "ignoreDirs": c.ignore_dirs, "ignoreGlobs": c.ignore_globs}
        return {"root": self.root, "storeDir": self.store.dir, "filesIndexed": s["filesIndexed"], "totalBytes": s["bytesIndexed"], "lastError": self.error} | {k: list(v) for k, v in lists.items()}

    def export_chunks(self, path: str) -> None:
        """The index's chunks as JSON lines."""
        write_jsonl(self.chunks(), path)

    def exported_chunks(self, path: str) -> DataFrame:
        return read_jsonl(self.spark, path, chunk.CHUNKS)

    def search_index(self, query: str, max=None, paths: list[str] | None = None) -> list[dict]:
        restrict = None if paths is None else self.spark.createDataFrame([(p,) for p in paths], "path string")
        return [r.asDict() for r in search.search_chunks(self.chunks(), query, whole(max, 20), restrict).collect()]

    # == notes

    def memory_upsert(self, key: str, text: str, tags=None, path: str = "", meta: dict | None = None) -> dict:
        if not isinstance(key, str) or not key.strip():
            raise ValueError("missing key")
        if not isinstance(text, str) or not text.strip():
            raise ValueError("missing text")
        meta = {k: v for k, v in (meta or {}).items() if isinstance(v, str)}
        row = [(1, key, text, strings(tags) or [], path, datetime.now(timezone.utc).replace(microsecond=0), meta)]
        new = self.spark.createDataFrame(row, "seq long, key string, text string, tags array<string>, path string, updated_at timestamp, meta map<string,string>")
        with self.lock:
            self.store.write("notes", notes.merge(self.store.read("notes", notes.SCHEMA), new))
        return self._note(self.store.read("notes", notes.SCHEMA).where(F.col("key") == key.strip()).first())

    def memory_search(self, query: str = "", tags=None, limit=None) -> dict:
        tags = strings(tags) or []
        if not (query or "").strip() and not tags:
            raise ValueError("a query or tags are needed")
        x = notes.search(self.store.read("notes", notes.SCHEMA), query or "", tags, whole(limit, 20))
        return {"notes": [self._note(r) for r in x.collect()]}

    def memory_clear(self) -> dict:
        self.store.clear("notes")
        return {"cleared": True}

    @staticmethod
    def _note(r) -> dict:
        return {"key": r.key, "text": r.text, "tags": r.tags, "path": r.path, "updatedAt": r.updated_at.strftime("%Y-%m-%dT%H:%M:%SZ"), "meta": r.meta}

    # == calls by name

    TOOLS = (
        "memory_clear", "memory_search", "memory_upsert", "repo_clear_index", "repo_context", "repo_index_debug", "repo_index_status", "repo_list_files", "repo_read_file",
        "repo_reindex", "repo_related_files", "repo_search", "repo_switch_workspace",
    )

    #: What a caller may expect of a tool: the rest only reads.
    CHANGES = ("memory_upsert", "repo_reindex", "repo_switch_workspace")
    DELETES = ("memory_clear", "repo_clear_index")

    @classmethod
    def tools(cls) -> list[dict]:
        """Name, arguments and hints of each tool."""
        out = []
        for name in cls.TOOLS:
            hints = {"readOnlyHint": name not in cls.CHANGES + cls.DELETES} | ({"destructiveHint": True} if name in cls.DELETES else {})
            args = [p for p in inspect.signature(getattr(cls, name)).parameters.values() if p.name not in ("self", "symbol_uses")]
            schema = {"type": "object", "properties": {p.name: {} for p in args}, "required": [p.name for p in args if p.default is p.empty]}
            if name != "repo_switch_workspace":
                schema["properties"]["root"] = {"type": "string"}
            out.append({"name": name, "inputSchema": schema, "annotations": hints})
        return out

    def repo_switch_workspace(self, root: str, reindexNow: bool = False) -> dict:
        done = self.switch_workspace(root)
        if reindexNow is True:
            self.repo_reindex()
        return done

    def cancel(self, job: str) -> None:
        """Stops the Spark jobs of the calls that were given this name."""
        self.spark.sparkContext.cancelJobGroup(job)

    def call(self, tool: str, arguments: dict | None = None, job: str | None = None) -> dict:
        """A tool by name, with dots or underscores; `root` picks another workspace for this call. The result as value and as JSON text. job: a name for cancel()."""
        if job is not None:
            self.spark.sparkContext.setJobGroup(job, tool, True)
        try:
            return self._call(tool, arguments)
        finally:
            if job is not None:
                for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                    self.spark.sparkContext.setLocalProperty(k, None)

    def _call(self, tool: str, arguments: dict | None) -> dict:
        name, arguments = tool.replace(".", "_"), dict(arguments or {})
        if name not in self.TOOLS:
            raise ValueError(f"unknown tool: {tool}")
        target = self
        if name != "repo_switch_workspace" and (root := arguments.pop("root", None)):
            target = Engine(self.spark, root, self.base, self.config)
        if self.log:
            text = json.dumps(arguments, ensure_ascii=False, default=str).encode()[:2000].decode("utf-8", "ignore")
            with open(self.log, "a", encoding="utf-8") as f:
                f.write(json.dumps({"tool": name, "arguments": text, "at": datetime.now(timezone.utc).isoformat()}) + "\n")
        value = getattr(target, name)(**arguments)
        return {"structuredContent": value, "content": [{"type": "text", "text": json.dumps(value, ensure_ascii=False)}]}

    def serve(self, lines, write) -> None:
        """JSON-RPC, a request a line: initialize, tools/list, tools/call. Notifications have no answer; an unknown method or a failed call is an error."""
        for line in lines:
            if not line.strip():
                continue
            try:
                ask = json.loads(line)
                number, method, given = ask.get("id"), ask.get("method", ""), ask.get("params") or {}
            except (ValueError, AttributeError):
                write(json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}))
                continue
            if number is None:
                continue
            answer: dict = {"jsonrpc": "2.0", "id": number}
            try:
                if method == "initialize":
                    answer["result"] = {"protocolVersion": given.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "gneiss"}}
                elif method == "tools/list":
                    answer["result"] = {"tools": self.tools()}
                elif method == "tools/call":
                    answer["result"] = self.call(given.get("name", ""), given.get("arguments"), job=f"call-{number}")
                else:
                    answer["error"] = {"code": -32601, "message": f"unknown method: {method}"}
            except Exception as e:  # the caller is told, whatever went wrong
                answer["error"] = {"code": -32000, "message": str(e)}
            write(json.dumps(answer, ensure_ascii=False))


class Watch:
    def __init__(self, engine: Engine, detector: str, checkpoint: str, changed):
        self.engine, self.changed, self.batches, self.error = engine, changed, 0, None
        engine.watching = self
        engine.refresh()
        kind = changes.choose_detector(detector, engine.root)
        stream = changes.change_stream(engine.spark, kind, engine.root, engine.config.flush_ms)
        every = f"{engine.config.git_poll_seconds} seconds" if kind == "git" else f"{engine.config.flush_ms} milliseconds"
        self.query = changes.run_stream(stream, self._flush, checkpoint, every)
        self.done = threading.Event()
        self.poller = None
        if engine.config.poll_seconds > 0 and not changes.is_git(engine.root):
            self.poller = threading.Thread(target=self._poll, daemon=True)
            self.poller.start()

    def _flush(self, add: DataFrame, gone: DataFrame) -> None:
        """Deletes first, then adds; a change batch's paths are few."""
        plus, minus = ([r.path for r in x.collect()] for x in (add, gone))
        if not plus and not minus:
            return
        e = self.engine
        with e.lock:
            new = [r.path for r in select.changed(e.meta(own=True).where(F.col("path").isin(plus)), e.index()).select("path").collect()] if plus else []
            if new or minus:
                e._stale_edges(new, minus)
                e.refresh(new, e.spark.createDataFrame([(p,) for p in minus], "path string") if minus else None)
        self.batches += 1
        if self.changed:
            self.changed(plus, minus)

    def _poll(self) -> None:
        while not self.done.wait(self.engine.config.poll_seconds):
            try:
                self.engine.refresh()
            except Exception as e:  # noqa: BLE001 - the next pass tries again; the status tells
                self.engine.error = str(e)

    def stop(self) -> None:
        self.done.set()
        self.query.stop()
        if self.poller:
            self.poller.join()
        self.engine.watching = None
