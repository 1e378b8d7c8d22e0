"""Operator 8: language identification by prediction by partial matching.

For each language a context tree over bytes up to `order` is counted on labelled texts and then frozen. A byte costs -log2 of its share in the longest
known context; a byte that this context hasn't seen costs the escape (method C: as many escapes as the context has different bytes) and then what it
costs in the next shorter context, down to one of 256 (without exclusion). A text's code length under a language is the exact sum; the shortest wins.

Training reads a bounded sample: of each language the `train_docs` labelled texts of the least hash of (text, id), taken over the whole table, whole texts, `train_bytes` at most.

Scale: training is one pass over ids and hashes and one over the chosen texts. Scoring is one pass without a shuffle: the trees of all
languages lie in one table for each order, which has the final code length of each known context and byte in every language, so
most bytes need one look-up for all languages. The tables are a broadcast whose size is bounded by the training sample.

Code lengths are whole numbers of 2^-16 bits, so sums don't depend on how rows are batched.

Defined results: a null or empty text has no language (predicted null, lengths null); so has every text when there is no labelled text. Ties go to the name that sorts first.
Null labels aren't trained on. Repeated rows are judged alike. Texts are scored whole. Columns besides doc_id, text and lang pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, free_name, string_parts

ONE = 1 << 16


@dataclass(frozen=True)
class PpmParams:
    order: int = 4
    train_docs: int = 300  # labelled texts of each language, at most
    train_bytes: int = 16 << 20  # of these, from the least hash on as many whole texts as have so many bytes; the first in any case


class Table:
    """Numbers of known keys: open addressing, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(len(keys) * 3 + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.rows = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            place = at[left]
            free = self.keys[place] == -1
            self.keys[place[free]], self.rows[place[free]] = keys[left[free]], left[free]
            left = left[self.keys[place] != keys[left]]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it isn't known."""
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.rows[at], -1)
        left = np.flatnonzero((seen != keys) & (seen != -1))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            seen = self.keys[at]
            hit = seen == keys[left]
            out[left[hit]] = self.rows[at[hit]]
            go = ~hit & (seen != -1)
            left, at = left[go], at[go]
        return out


def grams(raw: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes up to each position as one number; the first n - 1 positions have fewer."""
    x = raw.astype(np.int64)
    key = x.copy()
    for k in range(1, n):
        key[k:] |= x[:-k] << (8 * k) if k < len(x) else 0
    return key


class Trees:
    def __init__(self, texts: dict[str, list[bytes]], order: int):
        self.languages, self.order = sorted(texts), order
        count = [[self._count(texts[g], k + 1) for g in self.languages] for k in range(order + 1)]
        width = len(self.languages)
        self.table, self.cost, self.contexts, self.escape = [], [], [], []
        for k in range(order + 1):
            keys = np.unique(np.concatenate([c[0] for c in count[k]]))
            contexts = np.unique(keys >> 8)
            cost, escape = np.full((len(keys), width), -1, np.int64), np.zeros((len(contexts), width), np.int64)
            for g, (seen, n) in enumerate(count[k]):
                at = np.searchsorted(contexts, seen >> 8)
                total, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
                known = kinds > 0
                escape[known, g] = np.rint(ONE * np.log2((total[known] + kinds[known]) / kinds[known]))
                cost[np.searchsorted(keys, seen), g] = np.rint(ONE * np.log2((total + kinds)[at] / n))
            # what a language hasn't seen in this context it pays for in the shorter one
            shorter = self.cost[-1][np.searchsorted(self._keys, keys & ((1 << 8 * k) - 1))] if k else 8 * ONE
            cost = np.where(cost < 0, escape[np.searchsorted(contexts, keys >> 8)] + shorter, cost)
            self._keys = keys
            self.table.append(Table(keys)), self.cost.append(cost), self.contexts.append(Table(contexts)), self.escape.append(escape)
        del self._keys
        self.columns = [np.ascontiguousarray(self.cost[order][:, g]) for g in range(width)]

    @staticmethod
    def _count(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [grams(np.frombuffer(t, np.uint8), n)[n - 1 :] for t in texts if len(t) >= n]
        return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _costs(self, k: int, keys: np.ndarray) -> np.ndarray:
        """Costs (keys x languages) of the last byte of each key of k + 1 bytes."""
        row = self.table[k].find(keys)
        out = self.cost[k][row] if len(self.cost[k]) else np.zeros((len(keys), len(self.languages)), np.int64)
        lost = np.flatnonzero(row < 0)
        if len(lost):
            context = self.contexts[k].find(keys[lost] >> 8)
            more = np.where(context[:, None] >= 0, self.escape[k][context], 0) if len(self.escape[k]) else 0
            out[lost] = more + (self._costs(k - 1, keys[lost] & ((1 << 8 * k) - 1)) if k else 8 * ONE)
        return out

    def lengths(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code lengths (texts x languages) in units of 2^-16 bits."""
        n, width = len(off) - 1, len(self.languages)
        out = np.zeros((n, width), np.int64)
        if not len(raw):
            return out
        key = grams(raw, self.order + 1)
        size = np.diff(off)
        place = np.arange(len(raw)) - np.repeat(off[:-1], size)
        row = self.table[self.order].find(key)
        early = place < self.order
        odd = (row < 0) | early
        lost = np.flatnonzero(odd)
        doc = np.repeat(np.arange(n), size)[lost]
        costs = np.zeros((len(lost), width), np.int64)
        have = np.minimum(place[lost], self.order)
        for k in range(self.order + 1):
            i = np.flatnonzero(have == k)
            if len(i):
                costs[i] = self._costs(k, key[lost[i]] & ((1 << 8 * (k + 1)) - 1))
        row[lost] = 0
        total = np.zeros(len(raw) + 1, np.int64)
        for g in range(width):
            c = self.columns[g][row] if len(self.columns[g]) else np.zeros(len(row), np.int64)
            c[lost] = 0
            np.cumsum(c, out=total[1:])
            out[:, g] = total[off[1:]] - total[off[:-1]] + np.rint(np.bincount(doc, costs[:, g], n)).astype(np.int64)
        return out


def train(docs: DataFrame, params: PpmParams = PpmParams()) -> Trees | None:
    x = docs.where("lang IS NOT NULL AND text <> ''").select("doc_id", "text", "lang", F.xxhash64("text", "doc_id").alias("h"))
    w = Window.partitionBy("lang").orderBy("h")
    least = x.select("lang", "h", F.octet_length("text").cast("long").alias("n")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= params.train_docs)
    total = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    least = least.withColumn("total", total).where((F.col("total") <= params.train_bytes) | (F.col("r") == 1)).groupBy("lang").agg(F.max("h").alias("most"))
    # repeated rows share a hash: a text is learnt once
    bound = {r["lang"]: r["most"] for r in least.collect()}
    if not bound:
        return None
    near = F.lit(False)
    for lang, most in bound.items():
        near = near | ((F.col("lang") == lang) & (F.col("h") <= most))
    texts: dict[str, dict[int, bytes]] = {g: {} for g in bound}
    for r in x.where(near).select("lang", "h", "text").dropDuplicates(["lang", "h"]).collect():
        texts[r.lang][r.h] = r.text.encode()
    return Trees({g: [t[h] for h in sorted(t)] for g, t in texts.items()}, params.order)


def identify(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """docs with `predicted`, the language of the shortest code, and `code_bits`, the lengths in the order of the languages' names (underscores in front where docs has such columns)."""
    name, lengths = (free_name(docs.columns, n) for n in ("predicted", "code_bits"))
    if trees is None:
        return docs.withColumns({name: F.lit(None).cast("string"), lengths: F.lit(None).cast("array<double>")})
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def bits(text: pa.Array) -> pa.Array:
        raw, off = string_parts(text)
        with np.errstate(over="ignore"):
            parts = [model.value.lengths(r, o) for _, r, o in blocks(raw, off)]
        width = len(model.value.languages)
        x = np.concatenate(parts) if parts else np.zeros((0, width), np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(x) + 1, width), pa.int32()), pa.array(x.ravel() / ONE), mask=pa.array(np.diff(off) == 0))

    bits.__annotations__ = {"text": pa.Array, "return": pa.Array}
    bounded_batches(docs.sparkSession)
    key = free_name(docs.columns, "ppm")
    names = F.array(*(F.lit(g) for g in trees.languages))
    x = docs.withColumn(key, F.arrow_udf(bits, "array<double>")(F.col("text")))
    best = F.element_at(names, F.array_position(F.col(key), F.array_min(key)).cast("int"))
    return x.select(*docs.columns, F.when(F.col(key).isNotNull(), best).alias(name), F.col(key).alias(lengths))
