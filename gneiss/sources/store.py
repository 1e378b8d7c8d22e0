"""Tables of the engine on disk, published at once: what is new is written beside and a small pointer file is replaced.

A reader sees either the old version or the new one; a writer that fails leaves the old one. Missing or broken tables read as empty.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import short_hash


def repo_id(spark: SparkSession, root: str) -> str:
    """128 bits of the hash of the absolute root."""
    return spark.range(1).select(short_hash(F.lit(os.path.abspath(root)))).first()[0]


#: Parts into which a table with a path column is cut by the path's hash.
BUCKETS = 32
#: Tables that aren't cut, though they have a path column.
WHOLE = ("notes",)


class Store:
    """One folder for each repository: isolated by repo_id. A table's pointer lists the folders of its parts, so an update writes those parts only that it touches."""

    def __init__(self, spark: SparkSession, base: str, repo: str):
        self.spark, self.dir = spark, os.path.join(base, repo)
        os.makedirs(self.dir, exist_ok=True)

    def _pointer(self, table: str) -> str:
        return os.path.join(self.dir, f"{table}.version")

    def parts(self, table: str) -> dict[str, str]:
        """Folder of each part ('' for a table that isn't cut)."""
        try:
            with open(self._pointer(table)) as f:
                found = json.load(f)
            return {k: os.path.join(self.dir, v) for k, v in found.items()}
        except (OSError, ValueError, AttributeError, TypeError):
            return {}

    def read(self, table: str, schema: str, buckets=None) -> DataFrame:
        """buckets: of these parts only."""
        parts = [v for k, v in self.parts(table).items() if (buckets is None or k in buckets) and os.path.isdir(v)]
        if parts:
            try:
                return self.spark.read.schema(schema).parquet(*parts)
            except PySparkException:
                pass
        return self.spark.createDataFrame([], schema)

    def _publish(self, table: str, parts: dict[str, str]) -> None:
        old = self.parts(table)
        part = self._pointer(table) + f".{uuid.uuid4().hex}"
        with open(part, "w") as f:
            json.dump({k: os.path.relpath(v, self.dir) for k, v in parts.items()}, f)
        os.replace(part, self._pointer(table))
        for path in set(old.values()) - set(parts.values()):
            self._drop(path)

    def _drop(self, path: str) -> None:
        shutil.rmtree(path, ignore_errors=True)
        above = os.path.dirname(path)
        if above != self.dir and os.path.isdir(above) and not any(e.is_dir() for e in os.scandir(above)):
            shutil.rmtree(above, ignore_errors=True)

    def _write(self, table: str, x: DataFrame) -> dict[str, str]:
        path = os.path.join(self.dir, f"{table}-{uuid.uuid4().hex}")
        if "path" not in x.columns or table in WHOLE:
            x.write.parquet(path)
            return {"": path}
        x = x.withColumn("_bucket", _bucket())
        x.repartition("_bucket").write.partitionBy("_bucket").parquet(path)
        names = [n for n in os.listdir(path) if n.startswith("_bucket=")]
        return {n.removeprefix("_bucket="): os.path.join(path, n) for n in names}

    def write(self, table: str, x: DataFrame) -> None:
        self._publish(table, self._write(table, x))

    def clear(self, table: str) -> None:
        for path in self.parts(table).values():
            self._drop(path)
        if os.path.exists(self._pointer(table)):
            os.remove(self._pointer(table))

    def remove_paths(self, table: str, schema: str, paths: DataFrame) -> None:
        self.upsert_paths(table, schema, self.spark.createDataFrame([], schema), paths)

    def upsert_paths(self, table: str, schema: str, new: DataFrame, paths: DataFrame) -> None:
        """Rows of `paths` are replaced by those of `new`, which has none of other paths. Parts in which no path lies stay as they are."""
        touched = {str(r[0]) for r in paths.select(_bucket()).distinct().collect()}
        if not touched:
            return
        if "" in self.parts(table):  # as yet not cut
            touched = {"", *map(str, range(BUCKETS))}
        kept = self.read(table, schema, touched).join(paths.select("path"), "path", "left_anti")
        fresh = self._write(table, kept.unionByName(new.select(*kept.columns)))
        self._publish(table, {k: v for k, v in self.parts(table).items() if k not in touched} | fresh)


def _bucket():
    return F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int")


def write_jsonl(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines."""
    chunks.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_jsonl wrote; FileNotFoundError where there is nothing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(path)
    return spark.read.schema(schema).json(path)
