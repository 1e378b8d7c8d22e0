"""A directory tree as a table: a Python data source. Names that begin with a dot or underscore are files like others.

Directories are listed on the driver (names and sizes only); contents are read by the executors, a batch of files a partition. A filter on `path` for one or several
values is taken by the source: these files are looked at, and no directory is listed. Without `content` no file is opened; with_content() reads the files that are left after filters on metadata.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull

from ..functions.paths import IGNORED_DIRS, OWN_DIR

SCHEMA = "path string, size long, mod_time long, content string"


def _bad(name: str, own: bool, extra: tuple[str, ...]) -> bool:
    return name in IGNORED_DIRS or name in extra or name.startswith(".git") or (own and name == OWN_DIR)


def walk(root: str, own: bool = True, extra: tuple[str, ...] = ()) -> list[tuple[str, int, int]]:
    """(path, size, time in ns) of the files below root, in walk order, without ignored directories. What can't be read is skipped."""
    out: list[tuple[str, int, int]] = []

    def visit(directory: str, prefix: str) -> None:
        try:
            entries = sorted(os.scandir(directory), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            try:
                if e.is_dir(follow_symlinks=False):
                    if not _bad(e.name, own, extra):
                        visit(e.path, f"{prefix}{e.name}/")
                elif e.is_file():
                    s = e.stat()
                    out.append((prefix + e.name, s.st_size, s.st_mtime_ns))
            except OSError:
                continue

    visit(root, "")
    return out


def look(root: str, paths, own: bool = True, extra: tuple[str, ...] = ()) -> list[tuple[str, int, int]]:
    """As walk(), of these paths only; those that aren't files below root, or lie in ignored directories, are left out."""
    out = []
    for p in sorted(paths):
        parts = p.split("/")
        if any(x in ("", ".", "..") for x in parts) or any(_bad(x, own, extra) for x in parts[:-1]):
            continue
        at = root
        try:
            linked = False
            for x in parts[:-1]:
                at = os.path.join(at, x)
                linked |= os.path.islink(at)
            at = os.path.join(root, p)
            if not linked and os.path.isfile(at):
                s = os.stat(at)
                out.append((p, s.st_size, s.st_mtime_ns))
        except OSError:
            continue
    return out


def read_text(root: str, path: str) -> str | None:
    """None: it can't be read."""
    try:
        with open(os.path.join(root, path), encoding="utf-8", errors="replace", newline="") as f:
            return f.read()
    except OSError:
        return None


class _Part(InputPartition):
    def __init__(self, files):
        self.files = files


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.own = options.get("own", "true").lower() == "true"
        self.content = options.get("content", "true").lower() == "true"
        self.extra = tuple(x for x in options.get("ignoreDirs", "").split(",") if x)
        self.most = int(options.get("maxFileBytes", 1 << 62))
        self.bytes = int(options.get("partitionBytes", 8 << 20))
        self.only: set[str] | None = None

    def pushFilters(self, filters):
        """Takes filters that name the paths; yields the others."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("path",):
                names = {x for x in (f.value if isinstance(f, In) else [f.value]) if x is not None}
                self.only = names if self.only is None else self.only & names
            elif not (isinstance(f, IsNotNull) and f.attribute == ("path",)):  # every file has one
                yield f

    def partitions(self):
        parts, now, size = [], [], 0
        found = walk(self.root, self.own, self.extra) if self.only is None else look(self.root, self.only, self.own, self.extra)
        for f in found:
            if f[1] > self.most:
                continue
            now.append(f)
            size += f[1]
            if size >= self.bytes or len(now) >= 5000:
                parts.append(_Part(now))
                now, size = [], 0
        return [*parts, _Part(now)]

    def read(self, partition):
        for i in range(0, len(partition.files), 500):
            rows = []
            for path, size, time in partition.files[i : i + 500]:
                text = read_text(self.root, path) if self.content else None
                if text is not None or not self.content:
                    rows.append((path, size, time, text))
            a, b, c, d = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())], names=["path", "size", "mod_time", "content"])


class TreeSource(DataSource):
    @classmethod
    def name(cls):
        return "tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """files: path, size, mod_time, content. Lets the session hand filters to Python sources."""
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("tree").options(**{k: str(v) for k, v in options.items()}).load(root)


def with_content(files: DataFrame, root: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """files (path, size, mod_time) with the contents, read where the rows are; what can't be read is left out."""

    def run(batches):
        for batch in batches:
            size = batch.column(1).to_pylist()
            at = 0
            while at < batch.num_rows:
                end, held = at, 0
                while end < batch.num_rows and (end == at or held + (size[end] or 0) <= batch_bytes):
                    held += size[end] or 0
                    end += 1
                part = batch.slice(at, end - at)
                text = pa.array([read_text(root, p) for p in part.column(0).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, text], names=["path", "size", "mod_time", "content"]).filter(text.is_valid())
                at = end

    return files.select("path", "size", "mod_time").mapInArrow(run, SCHEMA)
