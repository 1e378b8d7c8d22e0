"""Operator 6: benchmark decontamination by SimHash of item-sized windows.

Items and documents are sequences of folded words; features are shingles of three words. To compare a window with an item, shingles of the item are weighted by their rarity among all items and others
as much as one that no item has. In each document the windows of an item's size are fingerprinted; a multi-index of the items' fingerprints in four blocks of 16 bits, each item entered under all
values within a quarter of the radius, gives every item within the radius; the exact weighted Jaccard similarity of the shingles decides.

Which windows: similarity s needs shared shingles of weight s x the item's, so only windows whose shingles that occur in any item weigh as
much for the lightest item of their size are fingerprinted. This leaves out no window that could pass.

The radius misses windows near the similarity limit, whose fingerprints are some 17 bits apart. With `every`, as in the query and the pipeline, no fingerprint decides: an inverted index gives
the items that share enough weight with a text, and every window that could pass is verified, so all leaks are found. The distance is reported only.

Scale: one pass over the texts, no shuffle. The items' index goes to the executors as a broadcast; its size is bounded: the items are taken in
portions of `portion_bytes` of text, with one pass over the documents for each (one for any usual set of benchmarks). Weights are counted over all items, so the result doesn't depend on the portions.

Defined results: null and empty texts, and texts or items of fewer than three words, match nothing. A document shorter than an item is one
window as a whole. Equal items match alike, each with its own item_id; rows with equal doc_id are judged each by its text (in the report each pair of ids comes once, with
its best window; of ties the first). Empty tables give no leaks, and every document stays. Other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, blocks, bounded_batches, materialise, mix, string_parts, words

SHINGLE = 3


@dataclass(frozen=True)
class LeakParams:
    radius: int = 15  # of 64 bits
    similarity: float = 0.5  # weighted Jaccard of a window and an item
    every: bool = False  # verify every window that could pass, within the radius or not
    portion_bytes: int = 1 << 20  # an item of 200 bytes takes some 11 KB of index


def shingles(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, index of each text's first)."""
    n = len(h)
    if n < SHINGLE:
        return np.zeros(0, U64), np.zeros(len(first), np.int64)
    s = mix(h[:-2] * U64(0x9E3779B97F4A7C15) + mix(h[1:-1] * U64(0xC2B2AE3D27D4EB4F) + h[2:]))
    keep = np.zeros(n, bool)
    size = np.diff(first)
    # the last two words of each text start none
    keep[: n - 2] = True
    for k in (1, 2):
        at = first[1:][size >= k] - k
        keep[at] = False
    count = np.concatenate(([0], np.cumsum(keep)))
    return s[keep[: n - 2]], count[first]


class Index:
    """Of the items: shingle weights, fingerprints by size, and the multi-index. `counts`: number of all items, their shingles (sorted) and in how many each is; None: these items are all."""

    def __init__(self, ids: list[int | None], texts: list[str], p: LeakParams, counts: tuple[int, np.ndarray, np.ndarray] | None = None):
        self.p = p
        raw, off = string_parts(pa.array(texts, pa.string()))
        with np.errstate(over="ignore"):
            s, first = shingles(*words(raw, off))
        self.ids = pa.array([i for i, n in zip(ids, np.diff(first)) if n], pa.int64())
        self.items = [s[a:b] for a, b in zip(first[:-1], first[1:]) if b > a]
        if counts is None:
            df = np.unique(np.concatenate([np.unique(x) for x in self.items]) if self.items else np.zeros(0, U64), return_counts=True)
            counts = (len(self.items), *df)
        n, self.known, df = counts
        self.weight = np.rint(16 * (np.log((1 + n) / (1 + df)) + 1)).astype(np.int64)
        self.other = int(np.rint(16 * (np.log(1 + n) + 1)))
        self.bitmap = np.zeros(1 << 22, bool)
        self.bitmap[(self.known >> U64(42)).astype(np.int64)] = True
        self.size = np.array([len(x) for x in self.items], np.int64)
        self.total = np.array([self.hits(x).sum() for x in self.items], np.int64)
        self.tables = [dict(zip(*(a.tolist() for a in np.unique(x, return_counts=True)))) for x in self.items]
        self.prints = np.packbits(np.array([self.prefix(x)[-1] >= 0 for x in self.items], bool).reshape(-1, 64), axis=1, bitorder="little").view(U64).ravel()
        #: least weight of shared shingles that an item of each size needs
        self.sizes = np.unique(self.size)
        self.need = np.array([p.similarity * self.total[self.size == k].min() for k in self.sizes])
        if p.every:
            self._inverted()
        else:
            self._multi_index()

    def _inverted(self) -> None:
        """Of each known shingle: the items that have it."""
        own = [np.unique(x) for x in self.items]
        at = np.searchsorted(self.known, np.concatenate(own)) if own else np.zeros(0, np.int64)
        order = np.argsort(at, kind="stable")
        self.entries = np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x in own])[order]
        self.starts = np.searchsorted(at[order], np.arange(len(self.known) + 1))

    def _multi_index(self) -> None:
        """Each item stands in the four blocks' tables under all values within a quarter of the radius: a window looks once into each."""
        flips = np.array([sum(1 << b for b in c) for k in range(self.p.radius // 4 + 1) for c in combinations(range(16), k)], np.int64)
        keys, items = [], []
        for b in range(4):
            block = ((self.prints >> U64(16 * b)) & U64(0xFFFF)).astype(np.int64)
            keys.append(((block[:, None] ^ flips) | b << 16).ravel())
            items.append(np.repeat(np.arange(len(block), dtype=np.int32), len(flips)))
        keys, items = np.concatenate(keys), np.concatenate(items)
        order = np.argsort(keys, kind="stable")
        self.entries, self.starts = items[order], np.searchsorted(keys[order], np.arange((4 << 16) + 1))

    def lookup(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, distance) of the items within the radius; a pair may come more than once."""
        rows, items = [], []
        for b in range(4):
            key = ((prints >> U64(16 * b)) & U64(0xFFFF)).astype(np.int64) | b << 16
            n = self.starts[key + 1] - self.starts[key]
            rows.append(np.repeat(np.arange(len(prints)), n))
            items.append(self.entries[np.repeat(self.starts[key] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        row, item = np.concatenate(rows), np.concatenate(items)
        d = np.bitwise_count(prints[row] ^ self.prints[item])
        ok = d <= self.p.radius
        return row[ok], item[ok], d[ok]

    def hits(self, s: np.ndarray) -> np.ndarray:
        """Weight of the shingles that occur in items; 0 for others."""
        out = np.zeros(len(s), np.int64)
        i = np.flatnonzero(self.bitmap[(s >> U64(42)).astype(np.int64)])
        if len(i):
            at = np.minimum(np.searchsorted(self.known, s[i]), len(self.known) - 1)
            out[i] = np.where(self.known[at] == s[i], self.weight[at], 0)
        return out

    @staticmethod
    def prefix(s: np.ndarray) -> np.ndarray:
        """Running sums of the votes of each bit, from 0 on."""
        bits = np.unpackbits(np.ascontiguousarray(s).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8)
        out = np.zeros((len(s) + 1, 64), np.int32)
        np.cumsum(2 * bits - 1, axis=0, out=out[1:])
        return out

    def similarity(self, item: int, s: np.ndarray) -> float:
        """Weighted Jaccard: shingles of the item weigh by their rarity among all items, others as much as one that no item has."""
        have = self.tables[item]
        u, n = np.unique(s, return_counts=True)
        both = total = 0
        for x, c, w in zip(u.tolist(), n.tolist(), self.hits(u).tolist()):
            if k := have.get(x):
                both += w * min(c, k)
                total += w * c
            else:
                total += self.other * c
        return both / (total + int(self.total[item]) - both)

    def search(self, s: np.ndarray, hit: np.ndarray) -> list[tuple[int, int, float, int]]:
        """(item, first word, similarity, distance) of the best window of each item in one text."""
        run = np.concatenate(([0], np.cumsum(hit)))
        n, best = len(s), {}
        votes = None
        for size, need in zip(self.sizes.tolist(), self.need.tolist()):
            size = min(size, n)
            start = np.flatnonzero(run[size:] - run[: n + 1 - size] >= need - 1e-6)
            if not len(start):
                continue
            if votes is None:
                votes = self.prefix(s)
            right = (self.size == size) if size < n else (self.size >= n)
            for i in range(0, len(start), 4096):
                at = start[i : i + 4096]
                prints = np.packbits(votes[at + size] - votes[at] >= 0, axis=1, bitorder="little").view(U64).ravel()
                row, item, d = self.lookup(prints)
                ok = right[item]
                found = set(zip(row[ok].tolist(), item[ok].tolist(), d[ok].tolist()))
                for r, item, d in sorted(found):
                    a = int(at[r])
                    sim = self.similarity(item, s[a : a + size])
                    if sim >= self.p.similarity and (item not in best or sim > best[item][1]):
                        best[item] = (a, sim, d)
        return [(item, a, sim, d) for item, (a, sim, d) in sorted(best.items())]

    def search_every(self, s: np.ndarray, hit: np.ndarray) -> list[tuple[int, int, float, int]]:
        """As search(), over all windows: an item's shared weight in a window is at most that of the window's shingles that the item has."""
        at = np.flatnonzero(hit)
        k = np.searchsorted(self.known, s[at])
        n = self.starts[k + 1] - self.starts[k]
        item = self.entries[np.repeat(self.starts[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        pos = np.repeat(at, n)
        limit = self.p.similarity
        shared = np.bincount(item, hit[pos], minlength=len(self.items))
        order = np.argsort(item, kind="stable")
        pos, ends = pos[order], np.searchsorted(item[order], np.arange(len(self.items) + 1))
        out, votes = [], None
        for i in np.flatnonzero((shared > 0) & (shared >= limit * self.total - 1e-6)).tolist():
            size = min(int(self.size[i]), len(s))
            p = pos[ends[i] : ends[i + 1]]
            sums = np.concatenate(([0], np.cumsum(hit[p])))
            if (sums[np.searchsorted(p, p + size)] - sums[:-1]).max() < limit * self.total[i] - 1e-6:
                continue
            mine, weigh = np.zeros(len(s), np.int64), np.full(len(s), self.other)
            mine[p] = weigh[p] = hit[p]
            run, total = np.concatenate(([0], np.cumsum(mine))), np.concatenate(([0], np.cumsum(weigh)))
            both, whole = run[size:] - run[:-size], total[size:] - total[:-size]
            most = both / np.maximum(1, whole + self.total[i] - both)
            most[both >= whole + self.total[i]] = 1.0
            best = None
            # the most similar can only be among those that may be more similar than the best so far
            for a in sorted(np.flatnonzero((both > 0) & (most >= limit - 1e-9)).tolist(), key=lambda a: (-most[a], a)):
                if best and most[a] < best[1] - 1e-9:
                    break
                sim = self.similarity(i, s[a : a + size])
                if sim >= limit and (best is None or (sim, -a) > (best[1], -best[0])):
                    best = (a, sim)
            if best:
                if votes is None:
                    votes = self.prefix(s)
                f = np.packbits(votes[best[0] + size] - votes[best[0]] >= 0, bitorder="little").view(U64)[0]
                out.append((i, *best, int(np.bitwise_count(f ^ self.prints[i]))))
        return out

    def scan(self, raw: np.ndarray, off: np.ndarray):
        """(row, found) of the texts with leaks."""
        if not self.items:
            return
        least = self.need.min() - 1e-6
        search = self.search_every if self.p.every else self.search
        for at, r, o in blocks(raw, off):
            s, first = shingles(*words(r, o))
            hit = self.hits(s)
            run = np.concatenate(([0], np.cumsum(hit)))
            for d in np.flatnonzero(run[first[1:]] - run[first[:-1]] >= least):
                if found := search(s[first[d] : first[d + 1]], hit[first[d] : first[d + 1]]):
                    yield at + int(d), found


def _item_shingles(batches):
    """(portion, whether it is the item's first row, shingle): a row for each different shingle of an item."""
    with np.errstate(over="ignore"):
        for batch in batches:
            part = batch.column(1).to_numpy()
            for row, r, o in blocks(*string_parts(batch.column(0))):
                s, first = shingles(*words(r, o))
                kinds = [np.unique(s[a:b]) for a, b in zip(first[:-1], first[1:])]
                n = np.array([len(x) for x in kinds])
                head = np.zeros(n.sum(), bool)
                head[(np.cumsum(n) - n)[n > 0]] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part[row : row + len(n)], n)), pa.array(head), pa.array(np.concatenate([np.zeros(0, U64), *kinds]).view(np.int64))], names=["part", "first", "shingle"]
                )


def indexes(benchmark: DataFrame, params: LeakParams):
    """Broadcast indexes of the items, of bounded size each; weights are by all items, whatever the portions."""
    spark = benchmark.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // params.portion_bytes) + 1
    part = F.pmod(F.xxhash64("text"), F.lit(n))
    if n > 1:
        # portion by portion: a portion's shingles with their counts among all items are bounded as its text is
        own = items.select("text", part.cast("int").alias("part")).mapInArrow(_item_shingles, "part int, first boolean, shingle long")
        own = materialise(own, "leak-shingles")
        total = own.where("first").count()
        df = own.groupBy("shingle").agg(F.count("*").alias("n"))
        counts = materialise(own.select("part", "shingle").distinct().join(df, "shingle"), "leak-counts")
    for k in range(n):
        rows = items.where(part == k).orderBy("i", "text").collect()
        known = None
        if n > 1:
            x = counts.where(F.col("part") == k).select("shingle", "n").toArrow()
            s = x.column(0).to_numpy().view(U64)
            order = np.argsort(s)
            known = total, s[order], x.column(1).to_numpy()[order]
        yield spark.sparkContext.broadcast(Index([r.i for r in rows], [r.text for r in rows], params, known))


def leaks(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """(doc_id, item_id, first_word, similarity, distance) of each document and item with a window that passes. Items without id share a null one."""

    def run(index):
        def batches(it):
            with np.errstate(over="ignore"):
                for batch in it:
                    x = index.value
                    rows = [(r, *f) for r, found in x.scan(*string_parts(batch.column(1))) for f in found]
                    r, item, a, sim, d = (list(c) for c in zip(*rows)) if rows else ([], [], [], [], [])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(r, pa.int64())), x.ids.take(pa.array(item, pa.int64())), pa.array(a, pa.int32()), pa.array(sim, pa.float64()), pa.array(d, pa.int32())],
                        names=["doc_id", "item_id", "first_word", "similarity", "distance"],
                    )

        return batches

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = [x.mapInArrow(run(i), "doc_id long, item_id long, first_word int, similarity double, distance int") for i in indexes(benchmark, params)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = F.max_by(F.struct("first_word", "similarity", "distance"), F.struct("similarity", -F.col("first_word")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def _clean(index):
    def clean(text: pa.Array) -> pa.Array:
        ok = np.ones(len(text), bool)
        with np.errstate(over="ignore"):
            for r, _ in index.value.scan(*string_parts(text)):
                ok[r] = False
        return pa.array(ok)

    clean.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(clean, "boolean")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """docs, without the documents in which an item was found."""
    out = docs
    for index in indexes(benchmark, params):
        out = out.where(_clean(index)(F.col("text")))
    return out
