"""Operator 3: near duplicates by SimHash and anchor-point covering.

A document's fingerprint is a 128-bit SimHash of its distinct words, weighted by the root of their number. On each of its first two
parts of 46 bits stands the covering code: two binary Golay codes side by side, 2^24 anchors, covering radius 3 in each block (6 in all). A fingerprint is
replicated to every anchor within covering radius plus threshold, and fingerprints are compared with those at the same anchor.

How far: with `reach` "whole" both sides go to every anchor within covering radius plus threshold, so each meets the other at that one's nearest anchor. With "half", the default, it is
covering radius plus half the threshold, and gives the same groups: between two values that differ in `threshold` bits lies one that differs from either in half of these;
its anchor lies within covering radius plus half the threshold of both. That is 61 anchors a part for 4 bits, in place of some 1200.

Near duplicates are the pairs with at most `threshold` different bits in either part and at most `whole` among all 128 (which holds
for every pair with up to 2 x threshold + 1 different bits among the 92); groups are their connected components.

Scale: one pass over the texts gives 16 bytes a document. Equal fingerprints are grouped first, so a group of thousands of copies
is one point. Points with their anchors are shuffled by anchor and compared in sorted runs; an anchor gives only the edges that connect its points,
never all pairs. Components are found by joins with rapid shrinking of the edges; each round is written to the shared folder.

Defined results: documents without words (null, empty, only symbols) are never near duplicates. A null doc_id takes no part, and such
rows stay. Rows of equal doc_id are one document. The document that stays is the one with the least doc_id. An empty table gives no rows. Columns besides doc_id and
text pass through.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, blocks, bounded_batches, free_name, materialise, mix, string_parts, words

N, RADIUS = 23, 3
MASK = (1 << N) - 1
PART = U64((1 << 2 * N) - 1)


def parts(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two parts of 46 bits on which the anchors stand."""
    return lo & PART, ((lo >> U64(2 * N)) | (hi << U64(64 - 2 * N))) & PART


@dataclass(frozen=True)
class SimhashParams:
    threshold: int = 4  # of the 46 bits of a part that the anchors cover; even
    whole: int = 20  # of all 128 bits
    reach: str = "half"  # of the threshold, beyond the covering radius: "half" or "whole"

    @property
    def slack(self) -> int:
        return self.threshold if self.reach == "whole" else (self.threshold + 1) // 2  # an odd threshold counts as one more


def fingerprints(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents x 2 words of 64 bits, has words)."""
    n = len(off) - 1
    h, first = words(raw, off)
    doc = np.repeat(np.arange(n, dtype=U64), np.diff(first))
    key = np.sort((doc << U64(44)) | (h >> U64(20)))
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    weight = np.rint(16 * np.sqrt(np.diff(np.append(new, len(key))))).astype(np.float32)
    key = key[new]
    at = np.searchsorted(key >> U64(44), np.arange(n + 1, dtype=U64))
    word = key & U64((1 << 44) - 1)
    bits = np.stack([mix(word * U64(2) + U64(1)), mix(word * U64(2) ^ U64(0xA5A5A5A5A5A5A5A5))], 1)
    out = np.zeros((n, 2), U64)
    for d in range(n):
        for i in range(at[d], at[d + 1], 1 << 16):
            s = slice(i, min(at[d + 1], i + (1 << 16)))
            votes = weight[s].astype(np.float64) @ (np.unpackbits(bits[s].view(np.uint8), axis=1, bitorder="little") * np.float32(2) - np.float32(1))
            total = votes if i == at[d] else total + votes
        if at[d + 1] > at[d]:
            out[d] = np.packbits(total >= 0, bitorder="little").view(U64)
    return out, np.diff(at) > 0


class Golay:
    """The perfect binary code of length 23: every value lies within 3 bits of one code word. A word's number follows from its lower 12 bits, and a value's error pattern from its syndrome of 11 bits."""

    def __init__(self):
        g = 0b101011100011
        self.code = np.zeros(1, np.int64)
        for i in range(12):
            self.code = np.concatenate((self.code, self.code ^ (g << i)))
        self.lower = np.zeros(4096, np.int64)
        self.lower[self.code & 0xFFF] = np.arange(4096)
        e = [0, *(1 << i for i in range(N))]
        errors = np.unique([a ^ b ^ c for a in e for b in e for c in e])
        self.errors = np.full(2048, -1, np.int64)
        self.errors[self.syndrome(errors)] = errors
        assert len(errors) == 2048 and (self.errors >= 0).all()

    def number(self, word: np.ndarray) -> np.ndarray:
        return self.lower[word & 0xFFF]

    def syndrome(self, v: np.ndarray) -> np.ndarray:
        return (v ^ self.code[self.lower[v & 0xFFF]]) >> 12

    def __getitem__(self, v: np.ndarray) -> np.ndarray:
        """Number of the nearest code word."""
        return self.number(v ^ self.errors[self.syndrome(v)])


@lru_cache(1)
def golay() -> tuple[np.ndarray, Golay]:
    """(the 4096 code words, the nearest code word's number of each 23-bit value)."""
    g = Golay()
    return g.code, g


@lru_cache(8)
def near_anchors(slack: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For the error pattern (value xor its code word) of each syndrome, by how many bits beyond the covering radius (0 to slack) other code words lie: for each excess (offsets, code word numbers)."""
    code, near = golay()
    dist = np.bitwise_count(code[None, :] ^ near.errors[:, None]).astype(np.int16)
    excess = np.maximum(dist - RADIUS, 0)
    out = []
    for s in range(slack + 1):
        e, c = np.nonzero(excess == s)
        out.append((np.searchsorted(e, np.arange(2049)), c.astype(np.int32)))
    return out


def anchors(low: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of all anchors within covering radius plus slack, of the first 46 bits of each value."""
    code, near = golay()
    lists = near_anchors(slack)
    a, b = (low & U64(MASK)).astype(np.int64), ((low >> U64(N)) & U64(MASK)).astype(np.int64)
    ea, eb = near.syndrome(a), near.syndrome(b)
    ca, cb = a ^ near.errors[ea], b ^ near.errors[eb]
    rows, keys = [], []
    for i in range(slack + 1):
        for j in range(slack + 1 - i):
            (oa, la), (ob, lb) = lists[i], lists[j]
            na, nb = oa[ea + 1] - oa[ea], ob[eb + 1] - ob[eb]
            n = na * nb
            row = np.repeat(np.arange(len(low)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            x = la[oa[ea[row]] + k // nb[row]]
            y = lb[ob[eb[row]] + k % nb[row]]
            rows.append(row)
            keys.append(near.number(ca[row] ^ code[x]) << 12 | near.number(cb[row] ^ code[y]))
    return np.concatenate(rows), np.concatenate(keys)


def _fingerprint_batches(batches):
    with np.errstate(over="ignore"):
        for batch in batches:
            raw, off = string_parts(batch.column(1))
            for at, r, o in blocks(raw, off):
                f, has = fingerprints(r, o)
                f = f.view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(has)).filter(pa.array(has)), pa.array(f[has, 0]), pa.array(f[has, 1])], names=["id", "lo", "hi"])


def _replicate(slack: int):
    step = 4096 >> max(0, 2 * slack - 4)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                for table, value in enumerate(parts(*(part.column(k).to_numpy().view(U64) for k in (1, 2)))):
                    row, key = anchors(value, slack)
                    yield pa.RecordBatch.from_arrays([pa.array((key | table << 24).astype(np.int32)), *(c.take(pa.array(row)) for c in part.columns)], names=["anchor", "point", "lo", "hi"])

    return run


def within(lo: np.ndarray, hi: np.ndarray, table: np.ndarray, p: SimhashParams) -> np.ndarray:
    """Of the xor of fingerprints, and the part on which they met."""
    a, b = parts(lo, hi)
    return (np.bitwise_count(np.where(table == 0, a, b)) <= p.threshold) & (np.bitwise_count(lo).astype(np.int16) + np.bitwise_count(hi) <= p.whole)


def linked(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, table: int, p: SimhashParams) -> tuple[list[int], list[int]]:
    """Edges that connect the points of one anchor as all its pairs within the threshold do: each point is compared
    with those that no other has reached yet."""
    left = np.argsort(ids, kind="stable")
    src, dst = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            k = queue.pop()
            near = within(lo[left] ^ lo[k], hi[left] ^ hi[k], np.int64(table), p)
            if near.any():
                found = left[near]
                src += [int(ids[k])] * len(found)
                dst += ids[found].tolist()
                queue += found.tolist()
                left = left[~near]
    return src, dst


def _compare(p: SimhashParams):
    def group(anchor, ids, lo, hi):
        size = np.diff(np.append(start := np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(anchor)))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # small runs: neighbours at distance 1, 2, ... for all anchors at once
        small = np.repeat(size <= 48, size)
        i = np.flatnonzero(small)
        step = 1
        while len(i):
            i = i[i + step < len(anchor)]
            i = i[anchor[i] == anchor[i + step]]
            near = within(lo[i] ^ lo[i + step], hi[i] ^ hi[i + step], anchor[i] >> 24, p)
            a.append(ids[i[near]]), b.append(ids[i[near] + step])
            step += 1
        for k in np.flatnonzero(size > 48):
            s = slice(start[k], start[k] + size[k])
            x, y = linked(ids[s], lo[s], hi[s], anchor[start[k]] >> 24, p)
            a.append(np.array(x, np.int64)), b.append(np.array(y, np.int64))
        a, b = np.concatenate(a), np.concatenate(b)
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    def run(batches):
        kept = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(now[0]):
                continue
            kept = now if kept is None else [np.concatenate(x) for x in zip(kept, now)]
            cut = int(np.searchsorted(kept[0], kept[0][-1]))  # the last anchor may go on in the next batch
            if cut:
                part, kept = [x[:cut] for x in kept], [x[cut:] for x in kept]
                yield group(part[0], part[1], part[2].view(U64), part[3].view(U64))
        if kept is not None:
            yield group(kept[0], kept[1], kept[2].view(U64), kept[3].view(U64))

    return run


def near_pairs(points: DataFrame, params: SimhashParams = SimhashParams()) -> DataFrame:
    """Edges (a, b), a < b, between points (point, lo, hi) with different fingerprints: enough to connect all that are within the threshold."""
    # a point becomes some 120 rows: the few MB of points are spread over all tasks first
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = points.select("point", "lo", "hi").repartition(parts, "point").mapInArrow(_replicate(params.slack), "anchor int, point long, lo long, hi long")
    return spread.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare(params), "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each node's component, by alternating large-star and small-star rounds."""
    now = materialise(edges.select("a", "b").where("a <> b"), "components")
    last = None
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: neighbours above a node go to the least of its neighbourhood
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its lower neighbours go to the least of these
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select(F.col("e.a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        now = materialise(small, "components")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicate_groups(docs: DataFrame, params: SimhashParams = SimhashParams()) -> DataFrame:
    """(doc_id, group_id) of the documents in groups of two or more; group_id is the least doc_id of the group."""
    bounded_batches(docs.sparkSession)
    x = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id IS NOT NULL")
    x = x.mapInArrow(_fingerprint_batches, "id long, lo long, hi long")
    x = materialise(x.groupBy("id").agg(F.min(F.struct("lo", "hi")).alias("f")).select("id", "f.lo", "f.hi"), "simhash")
    points = materialise(x.groupBy("lo", "hi").agg(F.min("id").alias("point"), F.count("*").alias("n")), "simhash-points")
    roots = components(near_pairs(points, params))
    point = points.join(roots, points["point"] == roots["node"], "left").select("lo", "hi", "n", F.col("root").isNotNull().alias("linked"), F.coalesce("root", "point").alias("group_id"))
    # a root has no row of its own among the components' nodes
    many = roots.select("root").distinct().withColumn("has", F.lit(True))
    point = point.join(many, point["group_id"] == many["root"], "left").where("n > 1 OR linked OR has").select("lo", "hi", "group_id")
    return x.join(point, ["lo", "hi"]).select(F.col("id").alias("doc_id"), "group_id")


def drop_near_duplicates(docs: DataFrame, params: SimhashParams = SimhashParams()) -> DataFrame:
    """docs, with one document of each group."""
    key = free_name(docs.columns, "simhash_gone")
    gone = near_duplicate_groups(docs, params).where("doc_id <> group_id").select(F.col("doc_id").alias(key))
    return docs.join(gone, docs["doc_id"].cast("long") == gone[key], "left_anti").select(*docs.columns)
