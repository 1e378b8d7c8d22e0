"""Selection of files, listing, budgets and the difference to what is indexed.

files: path, size, mod_time and, where content is read, content.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions import paths as P


def candidates(files: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Files that a full scan would take: all rules on metadata, before any content is read."""
    return files.where(
        (F.col("size") > 0) & (F.col("size") <= cfg.max_file_bytes)
        & ~P.in_ignored_dir("path", True, cfg.ignore_dirs) & ~P.ignored_file("path", cfg.ignore_globs) & P.should_index("path", cfg)
    )


def changed_candidates(files: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Files that an incremental pass would take: the same without the rules for directories and empty files."""
    return files.where((F.col("size") <= cfg.max_file_bytes) & ~P.ignored_file("path", cfg.ignore_globs) & P.should_index("path", cfg))


def listing(files: DataFrame, glob: str = "", most: int = 2000) -> DataFrame:
    """Paths in walk order, with the tools' rules; glob is matched with the whole path only."""
    x = files.where(~P.in_ignored_dir("path", False) & ~P.ignored_file("path", any_case=False))
    if glob:
        r = P.glob_regex(glob)
        x = x.where(F.col("path").rlike(r) if r else F.lit(False))
    return x.select("path").orderBy(P.walk_key("path")).limit(most)


PRIORITY = {".go": 0, ".ts": 1, ".tsx": 2, ".js": 3, ".jsx": 4, ".php": 5, ".md": 6, ".json": 7, ".yaml": 8, ".yml": 9}


def priority(path, cfg: Config = Config()):
    """Place of the extension in the list; extensions that aren't listed count as the first."""
    order = {e: i for i, e in enumerate(sorted(cfg.preferred_exts, key=lambda e: PRIORITY.get(e, len(PRIORITY))))}
    e = P.ext(path)
    out = F.lit(0)
    for name, i in order.items():
        out = F.when(e == name, i).otherwise(out)
    return out


def _fold(most: int, used: int, keys: int):
    """Over rows in order, of which the first columns are the group's, the last two the size and the bytes given back: the others with `fits`."""

    def run(batches):
        group, total = None, used
        for batch in batches:
            sizes, back = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            now = list(zip(*(batch.column(i).to_pylist() for i in range(keys)))) if keys else [()] * len(sizes)
            fits = []
            for g, n, b in zip(now, sizes, back):
                if g != group:
                    group, total = g, used
                fits.append(n is not None and total + n <= most)
                if fits[-1]:
                    total += n - (b or 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[keys:-2], pa.array(fits, pa.bool_())], names=[*batch.schema.names[keys:-2], "fits"])

    return run


def first_fit(x: DataFrame, most: int, size: str, order: list, by: list[str] | None = None, used: int = 0, back: str | None = None) -> DataFrame:
    """x with column `fits`: in order, a row that would go beyond `most` is skipped and later, smaller ones may still fit. `used`: bytes at the start; `back`: a column of bytes that a row which fits gives back.

    That is sequential by nature: a group (all of x where `by` is empty) is sorted and passes through one task as a stream, in bounded memory. For the order of a full scan, budgeted() does without.
    """
    by = by or []
    add = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    y = x.select(*add, *x.columns, F.col(size).cast("long").alias("_size"), (F.col(back) if back else F.lit(0)).cast("long").alias("_back"))
    y = (y.repartition(*by) if by else y.repartition(1)).sortWithinPartitions(*by, *order)
    return y.mapInArrow(_fold(most, used, len(by)), T.StructType([*x.schema.fields, T.StructField("fits", T.BooleanType())]))


_CUT = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("cut", T.LongType()), T.StructField("take", T.LongType())]))


def _cuts(most: int, used: int):
    """Of each list of (class, size, number) in order: for each class the size from which not all fit, and how many of that size do."""

    def run(bins: pa.Array) -> pa.Array:
        out = []
        for row in bins.to_pylist():
            total, found = used, {}
            for b in row:
                if b["kind"] not in found:
                    if b["size"] > 0:
                        take = min(b["n"], max(0, most - total) // b["size"])
                    else:
                        take = b["n"] if total + b["size"] <= most else 0
                    total += take * b["size"]
                    if take < b["n"]:
                        found[b["kind"]] = {"kind": b["kind"], "cut": b["size"], "take": take}
            out.append(list(found.values()))
        return pa.array(out, pa.list_(pa.struct([("kind", pa.int32()), ("cut", pa.int64()), ("take", pa.int64())])))

    run.__annotations__ = {"bins": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _CUT)


def first_fit_by_class(x: DataFrame, most: int, size: str, kind, ties: list[str], by: list[str] | None = None, used: int = 0) -> DataFrame:
    """first_fit() in the order kind (a whole number), size, ties; sizes aren't null.

    Within a class sizes ascend, so what fits is all below one size, and of that size the first by `ties`. The sizes come from numbers of rows for each class and size, so the list that is folded has at
    most as many items as there are sizes; only rows of the border sizes are sorted in groups. x is evaluated twice.
    """
    by = by or []
    x = x.withColumn("_kind", kind.cast("int"))
    bins = x.groupBy(*by, "_kind", F.col(size).cast("long").alias("_size")).agg(F.count("*").alias("n"))
    bins = bins.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("_kind").alias("kind"), F.col("_size").alias("size"), "n"))).alias("l"))
    cuts = bins.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.inline(_cuts(most, used)("l")))
    on = F.col("_kind") == F.col("kind")
    for i, c in enumerate(by):
        on &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    y = x.join(cuts, on, "left").withColumn("_border", F.coalesce((F.col(size) == F.col("cut")) & (F.col("take") > 0), F.lit(False)))
    # rows beside the border are only spread
    spread = F.when(~F.col("_border"), F.xxhash64(size, *ties))
    nth = F.row_number().over(Window.partitionBy(*by, "_kind", "_border", spread).orderBy(*ties))
    fits = F.when(F.col("_border"), nth <= F.col("take")).otherwise(F.coalesce(F.col(size) < F.col("cut"), F.lit(True)))
    return y.select(*(c for c in x.columns if c != "_kind"), fits.alias("fits"))


def prefix_budget(x: DataFrame, most: int, size: str, order: list, by: list[str] | None = None, used: int = 0) -> DataFrame:
    """x with `total` (running bytes) and `fits`: everything from the first row that would go beyond `most` is cut."""
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.col(size).cast("long")).over(w) + used
    return x.withColumn("total", total).withColumn("fits", F.col("total") <= most if most > 0 else F.lit(True))


def budgeted(files: DataFrame, cfg: Config = Config(), by: list[str] | None = None) -> DataFrame:
    """The candidates with `fits`: by priority, size and path as far as the budget goes."""
    return first_fit_by_class(candidates(files, cfg), cfg.max_total_bytes, "size", priority("path", cfg), ["path"], by)


def deleted(indexed: DataFrame, files: DataFrame, key: list[str] | None = None) -> DataFrame:
    return indexed.join(files.select(*(key or ["path"])), key or ["path"], "left_anti")


def changed(files: DataFrame, indexed: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Files that are new or of which size or time differ from the index."""
    key = key or ["path"]
    old = indexed.select(*key, F.col("size").alias("_size"), F.col("mod_time").alias("_time"))
    same = (F.col("size") == F.col("_size")) & (F.col("mod_time") == F.col("_time"))
    return files.join(old, key, "left").where(~F.coalesce(same, F.lit(False))).drop("_size", "_time")


def index_rows(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of the files index: ids, hashes and numbers of chunks."""
    n = chunks.groupBy("path").agg(F.count("*").cast("int").alias("chunks"))
    x = files.select("path", P.short_hash("path").alias("id"), "size", "mod_time", P.short_hash("content").alias("hash"), P.language("path").alias("language"))
    return x.join(n, "path", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


def status(indexed: DataFrame) -> DataFrame:
    """One row; total bytes are summed anew, so they can't drift."""
    return indexed.agg((F.count("*") > 0).alias("ready"), F.count("*").alias("files_indexed"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_indexed"))
