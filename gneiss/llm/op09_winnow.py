"""Operator 9: line dedup by winnowing over line hashes.

A document is a sequence of line hashes. From each line starts one gram: the fewest lines that hold `gram_words` words.
In each window (the fewest lines from a line on that hold `window_words` words) the gram with the least hash is selected, the
last of ties; a document of fewer words has one. The places of selected grams are joined; from each place a match is extended line by line both ways, and the later of two equal runs
is deleted, for every earlier place of the gram.

All earlier places at once: how far a place can be extended to the right with *some* earlier place is the largest k for which the gram and the k lines after it occurred earlier, and likewise to the
left; so each place looks up these contexts by hash (64 bits, with the gram's), each by its first occurrence, and no two places are ever paired. Contexts needn't be longer than a window: a run of a window's words
and more consists of windows, and equal windows select equal grams. So every run of `window_words` words and more that occurred earlier goes whole, whatever is around it. A shorter one of `gram_words` goes if a gram of
it is selected at both places, as a document of less than a window may not do.

Scale: one pass over the texts gives a row a selected gram with the hashes of its contexts; grams of one place are dropped first. First occurrences are grouped minima with partial aggregation; the
later ones are found by an anti-join on context *and* place, so a passage that is in every document is spread over all tasks. The texts are shuffled once, to be cut.

Order: by doc_id, then (for rows of equal doc_id) by a hash of the text, then by line. A null doc_id is left alone: such rows keep their text. Rows with equal doc_id and text are one document and lose
the same lines; rows with equal doc_id and different texts are documents of their own.

Defined results: null and empty texts stay as they are. Lines are compared by the hash of their bytes. Only lines that were in an earlier run go; the first
occurrence always stays. A document all of whose lines go is dropped (`drop_emptied`), or stays with an empty text. An empty table gives
no rows. Columns besides doc_id and text pass through untouched, but for n_chars.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, _power, blocks, bounded_batches, free_name, materialise, mix, span_hash, string_parts

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class WinnowParams:
    gram_words: int = 25  # matches of fewer words are noise
    window_words: int = 50  # repeated runs of so many words are always found


def line_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each line, its words, index of each document's first line)."""
    brk = np.flatnonzero(raw == 10)
    # a line starts at each document's start and after each line feed
    starts = np.sort(np.concatenate((off[:-1], brk + 1)))
    ends = np.sort(np.concatenate((off[1:], brk)))
    first = np.searchsorted(brk, off) + np.arange(len(off))
    space = _SPACE[raw]
    begins = ~space
    begins[1:] &= space[:-1]
    begins[off[:-1][off[:-1] < len(raw)]] = ~space[off[:-1][off[:-1] < len(raw)]]
    count = np.concatenate(([0], np.cumsum(begins)))
    return span_hash(raw, starts, ends), count[ends] - count[starts], first


def _least(g: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Place of the least of g in each range [start, stop), the last of ties, by a table of doubling ranges."""
    size = stop - start
    table = np.arange(len(g))
    out = np.empty(len(size), np.int64)
    step = 1
    while len(size):
        now = np.flatnonzero((size >= step) & (size < 2 * step))
        a, b = table[start[now]], table[stop[now] - step]
        out[now] = np.where(g[b] <= g[a], b, a)
        if 2 * step > size.max():
            break
        a, b = table[: len(table) - step], table[step:]
        table = np.where(g[b] <= g[a], b, a)
        step *= 2
    return out


def seeds(hashes: np.ndarray, words: np.ndarray, first: np.ndarray, p: WinnowParams) -> tuple[np.ndarray, ...]:
    """Of a block's selected grams: (line, line after, least line of a context to the left, last line after of one to the right, prefix sums and factors for the hashes)."""
    n = len(hashes)
    total = np.concatenate(([0], np.cumsum(words)))
    pw, inv = _power(n + 2)
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(hashes * pw[:n], dtype=U64)))
    size = np.diff(first)
    begin, end = np.repeat(first[:-1], size), np.repeat(first[1:], size)
    gram = np.searchsorted(total, total[:-1] + p.gram_words)
    window = np.searchsorted(total, total[:-1] + p.window_words)
    whole = np.flatnonzero(window <= end)
    start, stop = whole, np.searchsorted(gram, window[whole], "right")
    # documents of less than a window: one gram stands for all
    held = total[first[1:]] - total[first[:-1]]
    short = np.flatnonzero((held >= p.gram_words) & (held < p.window_words))
    start = np.concatenate((start, first[short]))
    stop = np.concatenate((stop, np.searchsorted(gram, first[short + 1], "right")))
    last = np.minimum(gram, n)
    g = span(sums, inv, np.arange(n), last)
    at = np.sort(_least(g, start, stop))
    at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
    after = gram[at]
    # as many lines as hold less than a window's words, not counting the gram's first line (to the right) or last (to the left)
    right = np.minimum(end[at], np.searchsorted(total, total[at + 1] + p.window_words) - 1)
    left = np.maximum(begin[at], np.searchsorted(total, total[after - 1] - p.window_words, "right"))
    return at, after, np.minimum(left, at), np.maximum(right, after), sums, inv


def span(sums: np.ndarray, inv: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the lines from a up to b."""
    return mix((sums[b] - sums[a]) * inv[a] + (b - a).astype(U64) * U64(0xD6E8FEB86659FD93))


_SEEDS = "id long, body long, at int, after int, gram long, lefts array<long>, rights array<long>"


def _seeds(params: WinnowParams):
    def lists(values: np.ndarray, n: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(values.view(np.int64)))

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                raw, off = string_parts(batch.column(2))
                for row, r, o in blocks(raw, off):
                    h, w, first = line_hashes(r, o)
                    at, after, left, right, sums, inv = seeds(h, w, first, params)
                    gram = span(sums, inv, at, after)
                    doc = np.searchsorted(first, at, "right") - 1
                    keys = []
                    for n, salt, side in ((at - left, 0x94D049BB133111EB, 0), (right - after, 0xC2B2AE3D27D4EB4F, 1)):
                        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
                        a, b = np.repeat(at, n), np.repeat(after, n)
                        x = span(sums, inv, a, b + k) if side else span(sums, inv, a - k, b)
                        keys.append(lists(mix(x * U64(salt) + np.repeat(gram, n)), n))
                    take = pa.array(row + doc)
                    line = first[doc]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(take), batch.column(1).take(take), pa.array((at - line).astype(np.int32)), pa.array((after - line).astype(np.int32)),
                            pa.array(gram.view(np.int64)), *keys,
                        ],
                        names=["id", "body", "at", "after", "gram", "lefts", "rights"],
                    )

    return run


def repeated_runs(docs: DataFrame, params: WinnowParams = WinnowParams()) -> DataFrame:
    """(id, body, start, stop): the runs of lines, from 0 and without stop, that repeat an earlier run; body is the hash of the text."""
    bounded_batches(docs.sparkSession)
    x = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("body"), "text").where("id IS NOT NULL AND text <> ''")
    x = materialise(x.mapInArrow(_seeds(params), _SEEDS), "winnow-grams")
    place = ["id", "body", "at"]
    alone = x.groupBy("gram").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("p")).where("n = 1").select("p.*")
    x = x.join(alone, place, "left_anti")
    # side 0: the gram itself; -1, 1: with k lines before, after it
    longer = lambda c, side: F.transform(c, lambda key, k: F.struct(F.lit(side).cast("byte").alias("side"), (k + 1).alias("k"), key.alias("key")))
    own = F.array(F.struct(F.lit(0).cast("byte").alias("side"), F.lit(0).alias("k"), F.col("gram").alias("key")))
    x = x.select(*place, "after", F.explode(F.concat(own, longer("lefts", -1), longer("rights", 1))).alias("c")).select(*place, "after", "c.*")
    x = materialise(x, "winnow-contexts")
    first = x.groupBy("key").agg(F.min(F.struct(*place)).alias("p")).select("key", "p.*")
    later = x.join(first, ["key", *place], "left_anti")
    reach = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("k"))), F.lit(0))
    runs = later.groupBy(*place, "after").agg(reach(-1).alias("before"), reach(1).alias("more"))
    return runs.select("id", "body", (F.col("at") - F.col("before")).alias("start"), (F.col("after") + F.col("more")).alias("stop"))


@F.arrow_udf(T.StringType())
def _without(text: pa.Array, start: pa.Array, stop: pa.Array) -> pa.Array:
    """Each text without its runs of lines; null where no line is left or there are no runs."""
    out = []
    for t, a, b in zip(text.to_pylist(), start.to_pylist(), stop.to_pylist()):
        if t is None:
            out.append(None)
            continue
        lines = t.split("\n")
        gone = np.zeros(len(lines) + 1, np.int64)
        np.add.at(gone, a, 1), np.add.at(gone, b, -1)
        kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()
        out.append("\n".join([lines[i] for i in kept]) if kept else None)
    return pa.array(out, pa.string())


def drop_repeated_lines(docs: DataFrame, params: WinnowParams = WinnowParams(), drop_emptied: bool = True) -> DataFrame:
    """docs, without the lines of later repeated runs. n_chars, if docs has it, becomes the length of the new text."""
    key = free_name(docs.columns, "winnow")
    runs = repeated_runs(docs, params).groupBy("id", "body").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    runs = runs.select(F.col("id").alias(f"{key}_id"), F.col("body").alias(f"{key}_body"), F.col("runs").alias(f"{key}_runs"))
    x = docs.join(runs, (F.col("doc_id").cast("long") == F.col(f"{key}_id")) & (F.xxhash64("text") == F.col(f"{key}_body")), "left")
    hit = F.col(f"{key}_runs").isNotNull()
    x = x.withColumn(key, _without(F.when(hit, F.col("text")), F.col(f"{key}_runs.start"), F.col(f"{key}_runs.stop")))
    if drop_emptied:
        x = x.where(~hit | F.col(key).isNotNull())
    new = {"text": F.when(hit, F.coalesce(key, F.lit(""))).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length(new["text"])).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return x.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))
