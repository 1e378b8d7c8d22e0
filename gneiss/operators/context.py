"""Context packs: the best chunks of a target and of its related files, within a budget of bytes.

Works for many targets at once: every table has a `target` column, and windows run within targets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import outline as O
from .related import bonus
from .select import prefix_budget


@dataclass(frozen=True)
class ContextOptions:
    focus: str = ""
    max_files: int = 10
    chunks_per_file: int = 2
    max_bytes: int = 120_000


def resolve_mode(mode: str | None = None, intent: str | None = None) -> dict[str, str | None]:
    """A valid mode wins, then the intent, then auto; what isn't known is ignored."""
    intent = (intent or "").strip()
    by_intent = {"navigate": "outline", "implement": "auto", "review": "auto"}
    if mode in ("full", "auto", "outline", "summary"):
        return {"requestedIntent": intent or None, "requestedMode": mode, "resolvedMode": mode, "strategy": "explicit_mode"}
    strategy = f"intent:{intent}" if intent in by_intent else "default_auto"
    return {"requestedIntent": intent or None, "requestedMode": None, "resolvedMode": by_intent.get(intent, "auto"), "strategy": strategy}


def chunk_score(focus: str) -> Column:
    f = focus.strip().lower()
    hit = F.when(F.contains(F.lower("content"), F.lit(f)), 10 + X.occurrences(F.lower("content"), f)).otherwise(0) if f else F.lit(0)
    return hit + F.when(F.col("start_line") <= 5, 1).otherwise(0)


def best_chunks(chunks: DataFrame, options: ContextOptions = ContextOptions()) -> DataFrame:
    """chunks with `score` and `place`: the first few of each path, by score and then line."""
    w = Window.partitionBy("path").orderBy(F.desc("score"), "start_line")
    x = chunks.withColumn("score", chunk_score(options.focus)).withColumn("place", F.row_number().over(w))
    return x.where(F.col("place") <= options.chunks_per_file)


def file_list(targets: DataFrame, related: DataFrame, options: ContextOptions = ContextOptions(), exclude: DataFrame | None = None) -> DataFrame:
    """(target, path, reasons, place): the target, then its related files in order, without excluded paths, cut to max_files."""
    own = targets.select("target", F.col("target").alias("path"), F.array().cast("array<string>").alias("reasons"), F.lit(0).alias("rank"))
    x = own.unionByName(related.where("target <> path").select("target", "path", "reasons", "rank"))
    if exclude is not None:
        x = x.join(exclude.select("path").distinct(), "path", "left_anti")
    w = Window.partitionBy("target").orderBy("rank")
    x = x.withColumn("place", F.row_number().over(w)).where(F.col("place") <= options.max_files)
    return x.select("target", "path", "reasons", "place")


def full(paths: DataFrame, chunks: DataFrame, options: ContextOptions = ContextOptions()) -> DataFrame:
    """(target, path, file_place, start_line, end_line, content, rank, total, fits) of chunks in rank order; those with fits go out."""
    weight = 2 if options.focus.strip() else 4
    x = best_chunks(chunks, options).join(paths.withColumnRenamed("place", "file_place"), "path")
    own = F.col("path") == F.col("target")
    rank = F.col("score") * F.when(own, weight).otherwise(1) + F.when(own, 0).otherwise(F.when(F.size("reasons") > 0, bonus(F.col("reasons"))).otherwise(0))
    x = x.withColumn("rank", rank).dropDuplicates(["target", "path", "start_line"]).withColumn("bytes", F.octet_length("content"))
    x = prefix_budget(x, options.max_bytes, "bytes", [F.desc("rank"), "path", "start_line"], ["target"])
    return x.select("target", "path", "file_place", "start_line", "end_line", "content", "rank", "total", "fits")


def outline_pack(paths: DataFrame, files: DataFrame, options: ContextOptions = ContextOptions(), summary: bool = False, used: int = 0) -> DataFrame:
    """(target, path, file_place, outline, total, fits) in the order of paths; used: bytes that are taken already."""
    x = paths.withColumnRenamed("place", "file_place").join((O.summaries if summary else O.outlines)(files), "path").where("outline <> ''").withColumn("bytes", F.octet_length("outline"))
    x = prefix_budget(x, options.max_bytes, "bytes", ["file_place"], ["target"], used)
    return x.select("target", "path", "file_place", "outline", "total", "fits")


def auto(paths: DataFrame, files: DataFrame, chunks: DataFrame, options: ContextOptions = ContextOptions()) -> tuple[DataFrame, DataFrame]:
    """(chunks of the targets, which are never cut; outlines of the related files within what they leave)."""
    own = best_chunks(chunks, options).join(paths.where("target = path").withColumnRenamed("place", "file_place"), "path")
    size = own.groupBy("target").agg(F.sum(F.octet_length("content")).alias("own_bytes"))
    rest = outline_pack(paths.where("target <> path"), files, ContextOptions(max_bytes=0))
    rest = rest.join(size, "target", "left").withColumn("total", F.col("total") + F.coalesce("own_bytes", F.lit(0)))
    rest = rest.withColumn("fits", F.col("total") <= options.max_bytes if options.max_bytes > 0 else F.lit(True)).drop("own_bytes")
    return own.select("target", "path", "file_place", "start_line", "end_line", "content", "score", "place"), rest


def follow_up(path: str, focus: str, related: list[str]) -> dict | None:
    """The next call worth making: the first related file in full, without what has been sent."""
    if not related:
        return None
    arguments: dict = {"path": related[0], "mode": "full", "excludePaths": [path, *related[1:]]}
    if focus.strip():
        arguments["focus"] = focus
    return {"name": "repo_context", "arguments": arguments, "reason": "Read the closest related file in full; what was sent already is left out."}
