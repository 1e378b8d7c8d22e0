"""Keyed notes: the last write of a key wins, at the place of its first one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

SCHEMA = "pos long, key string, text string, tags array<string>, path string, updated_at timestamp, meta map<string,string>"


def normalised(writes: DataFrame) -> DataFrame:
    """Writes with trimmed keys, clean paths ('.' for none) and normal tags; those without key or text are left out."""
    x = writes.withColumns({"key": P.trim_space("key"), "path": P.clean(P.trim_space(F.coalesce("path", F.lit("")))), "tags": P.normalise_tags("tags")})
    return x.where((F.col("key") != "") & (P.trim_space("text") != ""))


def upsert(writes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The notes after all writes (seq, key, text, tags, path, ...): one grouped aggregation. by: columns that keep stores apart."""
    by = by or []
    x = normalised(writes)
    rest = [c for c in x.columns if c not in ("seq", "key", *by)]
    last = F.max_by(F.struct(*rest), "seq")
    return x.groupBy(*by, "key").agg(F.min("seq").alias("pos"), last.alias("n")).select(*by, "pos", "key", *(f"n.{c}" for c in rest))


def merge(notes: DataFrame, writes: DataFrame) -> DataFrame:
    """Stored notes with later writes (seq from 1) on top; new keys come after the old ones."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    rest = [c for c in names if c not in ("pos", "key")]
    new = normalised(writes).groupBy("key").agg(F.min("seq").alias("seq"), F.max_by(F.struct(*rest), "seq").alias("n"))
    most = notes.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("most"))
    old = notes.select("key", "pos", F.struct(*rest).alias("o"))
    x = old.join(new, "key", "full").crossJoin(most)
    return x.select(F.coalesce("pos", F.col("most") + F.col("seq")).alias("pos"), "key", F.coalesce("n", "o").alias("v")).select("pos", "key", *(f"v.{c}" for c in rest)).select(*names)


def search(notes: DataFrame, query: str = "", tags: list[str] | None = None, most: int = 20) -> DataFrame:
    """Notes that hold the query in text, key or path and have all the tags, in the order of their places; most = 0: all, unordered."""
    want = list(dict.fromkeys(t.strip().lower() for t in tags or [] if t.strip()))
    x = notes
    if want:
        x = x.where(F.size(F.array_except(F.array(*map(F.lit, want)), F.coalesce("tags", F.array().cast("array<string>")))) == 0)
    if q := query.strip().lower():
        x = x.where(F.contains(F.lower(F.concat_ws("\n", "text", "key", "path")), F.lit(q)))
    return x.orderBy("pos").limit(most) if most else x
