"""Ranked chunk search, live line search and file reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import paths as P
from ..functions import text as X


def search_chunks(chunks: DataFrame, query: str, most: int = 20, restrict: DataFrame | None = None) -> DataFrame:
    """Chunks that hold the query, in any case: 10, one for each occurrence, 5 where the path holds it too. restrict: paths to look at."""
    q = query.strip().lower()
    if not q:
        raise ValueError("empty query")
    x = chunks if restrict is None else chunks.join(restrict.select("path"), "path", "left_semi")
    hay = F.lower("content")
    score = 10 + X.occurrences(hay, q) + F.when(F.contains(F.lower("path"), F.lit(q)), 5).otherwise(0)
    x = x.where(F.contains(hay, F.lit(q))).withColumn("score", score)
    return x.orderBy(F.desc("score"), "path", "start_line").limit(most) if most else x


def search_lines(files: DataFrame, query: str, most: int = 50, glob: str = "", case_sensitive: bool = False, context: int = 0, cfg: Config = Config()) -> DataFrame:
    """(path, line, snippet): lines that hold the query, with up to `context` lines before each that come after the match before.

    Stays within each file's array of lines: no shuffle but for the order. most = 0: all matches, unordered.
    """
    if query == "":
        raise ValueError("empty query")
    q = query if case_sensitive else query.lower()
    fold = (lambda c: c) if case_sensitive else F.lower
    x = files.where((F.col("size") <= cfg.search_file_bytes) & ~P.in_ignored_dir("path", False) & ~P.ignored_file("path", any_case=False))
    if glob:
        r = P.glob_regex(glob)
        x = x.where(F.col("path").rlike(r) if r else F.lit(False))
    x = x.where(F.contains(fold(F.col("content")), F.lit(q))).select("path", X.lines("content").alias("lines"))
    x = x.withColumn("hits", F.filter(F.sequence(F.lit(1), F.greatest(F.size("lines"), F.lit(1))), lambda i: F.contains(fold(F.try_element_at("lines", i)), F.lit(q))))

    def snippet(h, k):
        before = F.when(k > 0, F.try_element_at("hits", k)).otherwise(0)
        start = F.greatest(before + 1, h - context)
        return F.struct(h.alias("line"), F.array_join(F.slice("lines", start, h - start + 1), "\n").alias("snippet"))

    out = x.select("path", F.inline(F.transform("hits", snippet)))
    return out.orderBy(P.walk_key("path"), "line").limit(most) if most else out


def read_lines(files: DataFrame, path: str, start: int = 0, stop: int = 0, most_bytes: int = 200_000) -> DataFrame:
    """(line, text) of a file's window, up to but not with the line that would go beyond most_bytes."""
    x = files.where(F.col("path") == path).select(F.posexplode(X.lines("content")).alias("i", "text")).select((F.col("i") + 1).alias("line"), "text")
    x = x.where((F.col("line") >= start) & ((F.col("line") <= stop) if stop > 0 else F.lit(True)))
    total = F.sum(F.octet_length("text") + 1).over(Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("total", total).where(F.col("total") <= most_bytes).select("line", "text")
