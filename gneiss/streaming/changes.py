"""Change streams: file events and git status as sets of paths to add and to delete, in batches of fixed delay."""

from __future__ import annotations

import os
import subprocess
import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..functions import paths as P
from ..functions.batches import slices
from ..sources.tree import walk

CHANGES = "ts timestamp, op string, path string"


def parse_porcelain(blob: str, new_first: bool = False) -> tuple[set[str], set[str]]:
    """(add, del) of `git status --porcelain -z`. Of a rename's two paths the first counts as the old one, unless new_first."""
    add: set[str] = set()
    gone: set[str] = set()
    parts = iter(blob.split("\0"))
    for entry in parts:
        if len(entry) < 4:
            continue
        code, path = entry[:2], entry[3:]
        if "R" in code or "C" in code:
            other = next(parts, "")
            old, new = (other, path) if new_first else (path, other)
            if "R" in code and old:
                gone.add(old)
            if new:
                add.add(new)
        elif "D" in code:
            gone.add(path)
        else:
            add.add(path)
    return add, gone


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("path", T.StringType())])))
def status_paths(blob: pa.Array) -> pa.Array:
    """(op, path) of each status text of a column, by parse_porcelain; of a batch only a slice is in Python objects at a time."""
    parts = []
    for part in slices(pa.RecordBatch.from_arrays([blob], names=["b"])):
        ends, op, path = [0], [], []
        for b in part.column(0).to_pylist():
            add, gone = parse_porcelain(b or "")
            op += ["add"] * len(add) + ["del"] * len(gone)
            path += sorted(add) + sorted(gone)
            ends.append(len(path))
        rows = pa.StructArray.from_arrays([pa.array(op, pa.string()), pa.array(path, pa.string())], names=["op", "path"])
        parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.struct([("op", pa.string()), ("path", pa.string())])))


def event_op(kind: str | Column) -> Column:
    """create, write and chmod add; remove and rename delete; others are null."""
    k = F.lower(P.col(kind))
    return F.when(k.isin("create", "write", "chmod"), "add").when(k.isin("remove", "rename"), "del")


class GitStatusReader(SimpleDataSourceStreamReader):
    """With delayMs, a poll that finds a change it hasn't reported waits so long and looks again: what changes meanwhile comes in the same batch."""

    def __init__(self, options):
        self.root, self.delay, self.before = options["path"], int(options.get("delayMs", 0)) / 1000, None

    def initialOffset(self):
        return {"poll": 0}

    def _status(self) -> tuple[set[str], set[str]]:
        done = subprocess.run(["git", "-C", self.root, *"status --porcelain -z --untracked-files=all".split()], capture_output=True, text=True)
        if done.returncode:
            raise RuntimeError(f"git status failed: {done.stderr.strip()}")
        return parse_porcelain(done.stdout)

    def read(self, start):
        add, gone = self._status()
        if self.delay and (add or gone) and (add, gone) != self.before:
            time.sleep(self.delay)
            more, less = self._status()
            add, gone = add | more, gone | less
        self.before = (add, gone)
        rows = [("add", p) for p in sorted(add)] + [("del", p) for p in sorted(gone)]
        return iter(rows), {"poll": start["poll"] + 1}

    def readBetweenOffsets(self, start, end):
        return iter([])


class GitStatusSource(DataSource):
    """A stream of what git says has changed, polled at each trigger."""

    @classmethod
    def name(cls):
        return "git_status"

    def schema(self):
        return "op string, path string"

    def simpleStreamReader(self, schema):
        return GitStatusReader(self.options)


class TreeChangeReader(SimpleDataSourceStreamReader):
    """Compares the tree with what the poll before saw. A stream that starts anew adds every file once, which an upsert bears.

    With delayMs a batch ends so long after its first event: a poll that finds a change waits and looks again."""

    def __init__(self, options):
        self.root, self.delay, self.seen = options["path"], int(options.get("delayMs", 0)) / 1000, {}

    def initialOffset(self):
        return {"poll": 0}

    def _poll(self) -> dict[str, tuple[int, int]]:
        return {p: (size, at) for p, size, at in walk(self.root)}

    def read(self, start):
        now = self._poll()
        if self.delay and now != self.seen:
            time.sleep(self.delay)
            now = self._poll()
        rows = [("add", p) for p, s in now.items() if self.seen.get(p) != s] + [("del", p) for p in self.seen if p not in now]
        self.seen = now
        return iter(rows), {"poll": start["poll"] + 1}

    def readBetweenOffsets(self, start, end):
        return iter([])


class TreeChangeSource(DataSource):
    """A stream of what has changed in a directory tree, polled at each trigger."""

    @classmethod
    def name(cls):
        return "tree_changes"

    def schema(self):
        return "op string, path string"

    def simpleStreamReader(self, schema):
        return TreeChangeReader(self.options)


def is_git(path: str) -> bool:
    """Whether git can tell the state of this work tree."""
    try:
        return subprocess.run(["git", "-C", path, "rev-parse", "--is-inside-work-tree"], capture_output=True).returncode == 0 and os.path.exists(os.path.join(path, ".git"))
    except OSError:
        return False


def choose_detector(detector: str, path: str) -> str:
    """'git' where git is asked for and can tell, or where the directory can't be listed; otherwise 'fs'."""
    detector = detector.strip().lower()
    if detector == "feed":
        return detector
    listed = os.access(path, os.R_OK | os.X_OK)
    if detector == "git":
        return "git" if is_git(path) else "fs"
    return "fs" if listed or not is_git(path) else "git"


def change_stream(spark: SparkSession, detector: str, path: str, delay_ms: int = 0) -> DataFrame:
    """(op, path) from a git work tree ('git'), from polls of a directory ('fs'), from whichever of the two works ('auto': the directory first), or from a folder of
    JSON event files ('feed'): ts, kind, path. delay_ms: from the first event of a batch to its end."""
    detector = choose_detector(detector, path)
    if detector == "feed":
        x = spark.readStream.schema("ts timestamp, kind string, path string").json(path)
        return x.select("ts", event_op("kind").alias("op"), "path").where("op IS NOT NULL")
    source = TreeChangeSource if detector == "fs" else GitStatusSource
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).option("delayMs", delay_ms).load(path)


def fold_changes(batch: DataFrame, exists: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(add, del) paths of a batch, each once, without ignored ones. A path in both sets is added where it exists."""
    x = batch.where(~P.ignored_change("path")).select("op", "path").distinct()
    add, gone = x.where("op = 'add'").select("path"), x.where("op = 'del'").select("path")
    return (add if exists is None else add.join(exists.select("path"), "path", "left_semi")), gone


def run_stream(changes: DataFrame, flush: Callable[[DataFrame, DataFrame], None], checkpoint: str, delay: str = "500 milliseconds", once: bool = False):
    """Starts the stream: each micro-batch calls flush(add, del), which deletes first and then adds."""

    def each(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            flush(*fold_changes(batch))
        finally:
            batch.unpersist()

    w = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=delay)).start()


def _fixed_delay(key: int, delay_us: int):
    """Over events in the order of key and time, of which the last column is the time: the others with `batch`."""

    def run(batches):
        last, start, n = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, time = batch.column(key), batch.column(batch.num_columns - 1)
            code = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            cut = np.concatenate(([0], np.flatnonzero(np.diff(code)) + 1, [len(code)])).tolist()
            known = time.is_valid().to_numpy(zero_copy_only=False)
            t, out = time.fill_null(0).to_numpy(), np.zeros(batch.num_rows, np.int64)
            for a, b in zip(cut[:-1], cut[1:]):
                if last is None or last[0] != keys[a].as_py():
                    last, start, n = (keys[a].as_py(),), None, 0
                i = a + int(np.count_nonzero(~known[a:b]))  # nulls are first
                while i < b:
                    if start is None or t[i] > start + delay_us:
                        start, n = int(t[i]), n + 1
                    j = i + int(np.searchsorted(t[i:b], start + delay_us, "right"))
                    out[i:j] = n
                    i = j
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=[*batch.schema.names[:-1], "batch"])

    return run


def fixed_delay_batches(events: DataFrame, key: str, ts: str, tie: str, delay_us: int) -> DataFrame:
    """events with `batch`, from 1 in each key: a batch opens with the first pending event and takes all within the delay of it. Events without a time have batch 0.

    Later events don't prolong a batch, so this is no session window: each batch's end depends on its start, a fold over the events of a key in time order. One shuffle;
    a key's events pass through one task as a sorted stream, in bounded memory, a binary search for each batch.
    """
    x = events.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    x = x.repartition(key).sortWithinPartitions(key, "_t", tie)
    return x.mapInArrow(_fixed_delay(events.columns.index(key), delay_us), T.StructType([*events.schema.fields, T.StructField("batch", T.LongType())]))


def replay(batches: DataFrame, by: list[str]) -> DataFrame:
    """State after each batch's flush in order (batch, op, path): a path is there if the last batch that names it adds it."""
    last = batches.groupBy(*by, "path", "batch").agg(F.max(F.when(F.col("op") == "add", 1).otherwise(0)).alias("add"))
    return last.groupBy(*by, "path").agg(F.max_by("add", "batch").alias("present"), F.max("batch").alias("batch"))


def class_flags(path: str | Column) -> dict[str, Column]:
    """Which caches a changed path makes stale."""
    b = P.basename(path)
    e = P.ext(path)
    return {
        "go": (e == ".go") | b.isin("go.mod", "go.sum"),
        "js": e.isin(*P.JS_FAMILY),
        "php": e == ".php",
    }


def refresh_edges(edges: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """Edges with those of touched sources computed anew."""
    return edges.join(touched.select(F.col("path").alias("src")), "src", "left_anti").select(*edges.columns).unionByName(fresh.join(touched.select(F.col("path").alias("src")), "src", "left_semi").select(*edges.columns))
