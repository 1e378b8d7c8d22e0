"""Operator 4: language-model scoring with an Elias-Fano n-gram trie.

Word n-grams up to `order` are counted over all documents and kept in a trie: level 1 is the vocabulary, a node's children on the next level
lie side by side. Each level has Elias-Fano coded pointers (where each parent's children begin) and Elias-Fano coded ids, made
monotone by adding the last value of the parent before; a child is found by a successor search from its parent's base. From level 3 on a word's id is relative to its context: its position among the
children of the word before it on level 2, a small number. Probabilities and back-off weights are 8-bit codes: eighths of a bit of -log2.

Smoothing: absolute discounting, interpolated: p(w | c) = max(n(c w) - D, 0) / n(c) + g(c) p(w | c without its first word), where g(c) is what is left of the
mass. Every word is known (`min_word` 1); n-grams rarer than `min_count` aren't stored, so that what occurs again scores apart. A document's score is the sum of its words' codes, a whole number, so it
doesn't depend on batches.

Scale: counting is local sorting of 64-bit keys in each task, one shuffle of packed runs of keys to as many tasks as the number of words asks for (`part_tokens` each), and merging by sorting: some 9
bytes a distinct n-gram, no row for each. Each level is cut between parents into segments of some `segment` n-grams: ranges of a sort by Spark, each with pointers and ids of its own, each written by its own task in
bounded memory, as are the parts of the vocabulary. The driver sees a row a segment. Files are mapped into memory, so workers share them: where they lie in the shared folder if that is mounted (file:), otherwise from copies
that Spark's file distribution brings to each node once. No count is capped; all grow with the corpus.

Defined results: words are runs of letters, marks and numbers, in lower case. A text without words (null, empty) has 0 words, 0 bits and null perplexity. Repeated rows count as often as they
occur. An empty table gives no rows. Columns besides text pass through. A level with so many nodes that parent and child don't fit in 63 bits is an error.
"""

from __future__ import annotations

import json
import mmap
import re
import uuid
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK, U64, _delete, blocks, bounded_batches, discard, free_name, materialise, mix, new_path, string_parts, words

UNIT = 8  # codes a bit
CHUNK = 1 << 18
#: Text bytes looked up at once: equal questions are asked once a block.
WORK = 2 * BLOCK


@dataclass(frozen=True)
class LmParams:
    order: int = 3
    min_word: int = 1
    min_count: int = 2
    discount: float = 0.75
    segment: int = 1 << 20  # n-grams (or words) that one task writes
    part_tokens: int = 1 << 21  # words of text for each task that merges counts
    copy: bool | None = None  # map copies on each node; None: only where the shared folder isn't mounted


def code(p: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(-np.log2(np.maximum(p, 1e-30)) * UNIT + 0.5), 0, 255).astype(np.uint8)


def value(c: np.ndarray) -> np.ndarray:
    return np.exp2(-c.astype(np.float64) / UNIT)


# == files


def put(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Several arrays in one file, each at a multiple of 8 bytes; it appears whole or not at all."""
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    index, at = {}, 0
    for k, x in arrays.items():
        index[k] = (x.dtype.str, len(x), at)
        at += -(-x.nbytes // 8) * 8
    head = json.dumps(index).encode()
    head += b" " * (-len(head) % 8)
    part = f"{path}/_{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(part, compression=None) as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for x in arrays.values():
            f.write(np.ascontiguousarray(x).tobytes() + bytes(-x.nbytes % 8))
    where.move(part, f"{path}/{name}")


def get(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file: mapped into memory if it is local or mounted, otherwise read."""
    where, path = fs.FileSystem.from_uri(folder)
    if isinstance(where, fs.LocalFileSystem):
        with open(f"{path}/{name}", "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with where.open_input_stream(f"{path}/{name}") as f:
            data = f.read()
    n = int.from_bytes(data[:8], "little")
    return {k: np.frombuffer(data, dtype, size, 8 + n + at) for k, (dtype, size, at) in json.loads(data[8 : 8 + n]).items()}


COPY = "copy:"


def folder(model: str, name: str, train: bool = False) -> str:
    """Of a part of the model: on a node, where its files are."""
    uri = model.removeprefix(COPY)
    full = f"{uri.rsplit('/', 1)[1]}-{name}"
    if model.startswith(COPY) and not train:
        return "file://" + SparkFiles.get(full)
    return f"{uri}/{full}"


class Pieces:
    """An array in pieces; piece s begins with element starts[s]. load(s) gives it."""

    def __init__(self, starts: np.ndarray, load):
        self.starts, self.load = starts, lru_cache(None)(load)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        if len(self.starts) == 1:
            return self.load(0)[i]
        out = None
        for s, at in by_piece(self.starts, i):
            x = self.load(s)[i[at] - self.starts[s]]
            if out is None:
                out = np.zeros(len(i), x.dtype)
            out[at] = x
        return self.load(0)[:0] if out is None else out


def by_piece(starts: np.ndarray, i: np.ndarray):
    """(piece, places in i) for the pieces in which any element lies."""
    piece = np.searchsorted(starts, i, "right") - 1
    order = np.argsort(piece, kind="stable")
    piece = piece[order]
    cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(i)), bool), piece[1:] != piece[:-1], np.ones(min(1, len(i)), bool))))
    for a, b in zip(cut[:-1], cut[1:]):
        yield int(piece[a]), order[a:b]


# == Elias-Fano

_SELECT8 = np.zeros((256, 8), np.int64)
for _b in range(256):
    _at = [i for i in range(8) if _b >> i & 1]
    _SELECT8[_b, : len(_at)] = _at


def elias_fano(name: str, x: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """The arrays of a monotone sequence of values below `universe`."""
    n = len(x)
    bits = max(0, int(np.floor(np.log2(max(1, universe) / max(1, n)))))
    low = []
    for i in range(0, n if bits else 0, 1 << 14):
        b = (x[i : i + (1 << 14), None] >> np.arange(bits)) & 1
        low.append(np.packbits(b.astype(np.uint8).ravel(), bitorder="little"))
    low = np.concatenate([np.zeros(0, np.uint8), *low])
    low = np.concatenate((low, np.zeros(-len(low) % 8 + 16, np.uint8))).view(U64)
    # a zero for each possible upper part, and two more, follow the last one
    bit = np.zeros((n + (universe >> bits) + 3 + 63) // 64 * 64, bool)
    bit[(x >> bits) + np.arange(n)] = True
    high = np.packbits(bit, bitorder="little").view(U64)
    out = {"low": low, "high": high, "meta": np.array([n, universe, bits], np.int64)}
    # ones before each superblock of 8 words: where the next one or zero is far away
    ones = np.bitwise_count(high).astype(np.int64)
    out["sup"] = np.concatenate(([0], np.cumsum(ones)))[::8]
    for kind in (0, 1):  # the word that holds each 64th zero or one, and how many lie before that word
        count = ones if kind else 64 - ones
        upto = np.cumsum(count)
        at = np.searchsorted(upto, np.arange(0, upto[-1], 64), "right")
        out[f"at{kind}"], out[f"rank{kind}"] = at.astype(np.int64), upto[at] - count[at]
    return {f"{name}.{k}": v for k, v in out.items()}


class Ef:
    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        x = {k: arrays[f"{name}.{k}"] for k in ("meta", "low", "high", "sup", "at0", "rank0", "at1", "rank1")}
        self.n, self.universe, self.bits = x["meta"].tolist()
        self.low, self.high = x["low"], x["high"]
        self.before = (np.arange(len(x["sup"])) * 512 - x["sup"], x["sup"])
        self.hints = [(x[f"at{k}"], x[f"rank{k}"]) for k in (0, 1)]

    def select(self, k: np.ndarray, kind: int) -> np.ndarray:
        """Place of the k-th (from 0) one or zero."""
        at, rank = self.hints[kind]
        w = at[k >> 6]
        rem = k - rank[k >> 6]
        word = self.high[w] if kind else ~self.high[w]
        n = np.bitwise_count(word)
        go = np.flatnonzero(rem >= n)
        steps = 0
        while len(go):
            steps += 1
            if steps == 5:  # a long run of the other bit: by binary search to the superblock
                sup = np.searchsorted(self.before[kind], k[go], "right") - 1
                rem[go] = k[go] - self.before[kind][sup]
                w[go] = sup * 8
                word[go] = self.high[w[go]] if kind else ~self.high[w[go]]
                n[go] = np.bitwise_count(word[go])
                go = go[rem[go] >= n[go]]
                continue
            rem[go] -= n[go]
            w[go] += 1
            word[go] = self.high[w[go]] if kind else ~self.high[w[go]]
            n[go] = np.bitwise_count(word[go])
            go = go[rem[go] >= n[go]]
        out = w << 6
        for half in (32, 16, 8):  # narrow down to the byte
            part = word & U64((1 << half) - 1)
            n = np.bitwise_count(part)
            up = rem >= n
            rem -= np.where(up, n, 0)
            out += np.where(up, half, 0)
            word = np.where(up, word >> U64(half), part)
        return out + _SELECT8[word.astype(np.int64), rem]

    def after(self, k: np.ndarray, place: np.ndarray, kind: int) -> np.ndarray:
        """Place of the k-th one or zero, the next one after `place`: mostly in the same word."""
        w, s = place >> 6, (place & 63).astype(U64)
        word = self.high[w] if kind else ~self.high[w]
        word = (word >> s) & ~U64(1)
        out = place + np.bitwise_count((word & (~word + U64(1))) - U64(1))
        far = np.flatnonzero(word == 0)
        if len(far):
            out[far] = self.select(k[far], kind)
        return out

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        bit = i * self.bits
        w, s = bit >> 6, (bit & 63).astype(U64)
        x = self.low[w] >> s
        x |= np.where(s > 0, self.low[w + 1] << ((U64(64) - s) & U64(63)), U64(0))
        return (x & U64((1 << self.bits) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.select(i, 1) - i) << self.bits | self.lows(i)

    def pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at i and at i + 1."""
        a = self.select(i, 1)
        b = self.after(i + 1, a, 1)
        return (a - i) << self.bits | self.lows(i), (b - i - 1) << self.bits | self.lows(i + 1)

    def find(self, x: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Place of x by successor search in [start, stop); -1 where the successor isn't x."""
        h = x >> self.bits
        # the values with this upper part lie between the zeros before and after them
        z = np.full(len(x), -1, np.int64)
        i = np.flatnonzero(h > 0)
        z[i] = self.select(h[i] - 1, 0)
        lo = np.maximum(z + 1 - h, start)
        z[i] = self.after(h[i], z[i], 0)
        if len(i) < len(x):
            j = np.flatnonzero(h == 0)
            z[j] = self.select(h[j], 0)
        end = np.minimum(z - h, stop)
        want = x & ((1 << self.bits) - 1)
        out = np.full(len(x), -1, np.int64)
        # few values share an upper part: halve the long ranges, then look at what is left one by one
        go = np.flatnonzero(lo < end)
        lo, hi, want = lo[go], end[go], want[go]
        while len(go):
            mid = (lo + hi) >> 1
            v = self.lows(mid)
            hit = v == want
            out[go[hit]] = mid[hit]
            lo = np.where(v < want, mid + 1, lo)
            hi = np.where(v > want, mid, hi)
            on = np.flatnonzero(~hit & (lo < hi))
            go, lo, hi, want = go[on], lo[on], hi[on], want[on]
        return out


# == the model


class Level:
    """A level below the vocabulary: children of each parent, in segments."""

    def __init__(self, where: str, k: int):
        meta = get(where, "meta")["starts"].reshape(-1, 2)
        self.parents, self.nodes, self.size = meta[:-1, 0], meta[:-1, 1], int(meta[-1, 1])
        self.segment = lru_cache(None)(lambda s: self._open(get(where, str(s))))
        self.p = Pieces(self.nodes, lambda s: self.segment(s)[2])

    @staticmethod
    def _open(x):
        return Ef(x, "ptr"), Ef(x, "ids"), x["p"], x["g"]

    def _each(self, parent: np.ndarray):
        """(segment, its first parent and node, slice of its parents), of parents in order."""
        cut = [0, *np.searchsorted(parent, self.parents[1:]).tolist(), len(parent)]
        for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
            if b > a:
                yield self.segment(s), int(self.parents[s]), int(self.nodes[s]), slice(a, b)

    def starts(self, parent: np.ndarray) -> np.ndarray:
        """First child of each parent."""
        kinds, place = np.unique(parent, return_inverse=True)
        out = np.zeros(len(kinds), np.int64)
        for (ptr, *_), first, node, at in self._each(kinds):
            out[at] = ptr.get(kinds[at] - first) + node
        return out[place]

    def find(self, parent: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node of each parent's child, or -1; its code, or else the back-off code of the parent).

        Equal questions are asked once, in order, so that the search goes through memory forwards."""
        wide = int(child.max()) + 1 if len(child) else 1
        order = np.argsort(parent * wide + child) if len(child) and (int(parent.max()) + 1) * wide < 1 << 63 else np.lexsort((child, parent))
        p, c = parent[order], child[order]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (c[1:] != c[:-1])
        place = np.empty(len(p), np.int32)
        place[order] = np.cumsum(new) - 1
        p, c = p[new], c[new]
        nodes, codes = np.full(len(p), -1, np.int64), np.zeros(len(p), np.uint8)
        for part, first, node, at in self._each(p):
            x = self._find(*part[:2], p[at] - first, c[at])
            hit = np.flatnonzero(x >= 0)
            y = part[3][p[at] - first]
            y[hit] = part[2][x[hit]]
            x[hit] += node
            nodes[at], codes[at] = x, y
        return nodes[place], codes[place]

    @staticmethod
    def _find(ptr: Ef, ids: Ef, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
        # the parents come in order: each one's range once
        head = np.ones(len(parent), bool)
        head[1:] = parent[1:] != parent[:-1]
        run = np.cumsum(head) - 1
        start, stop = ptr.pair(parent[head])
        base = np.zeros(len(start), np.int64)
        i = np.flatnonzero((start > 0) & (start < stop))
        base[i] = ids.get(start[i] - 1) + 1
        out = np.full(len(child), -1, np.int64)
        x = base[run] + child
        i = np.flatnonzero((start < stop)[run] & (x < ids.universe))
        for a in range(0, len(i), 1 << 16):
            j = i[a : a + (1 << 16)]
            out[j] = ids.find(x[j], start[run[j]], stop[run[j]])
        return out


class Lm:
    """The levels up to `order` of a model."""

    def __init__(self, model: str, order: int):
        where = folder(model, "1")
        meta = get(where, "meta")
        self.size, self.unknown, self.bits, self.per = meta["meta"].tolist()
        self.parts = set(meta["hashes"].tolist())  # segments that have words
        self.hashes = lru_cache(None)(lambda s: [get(where, f"hash{s}")[k] for k in ("hash", "id", "first")])
        self.p1 = Pieces(np.arange(0, max(1, self.size), self.per), lambda s: get(where, f"p{s}")["p"])
        self.levels = {k: Level(folder(model, str(k)), k) for k in range(2, order + 1)}

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Number of each word; the number of words for unknown ones. 16 bits of the hash lead to a short run of sorted hashes."""
        order = np.argsort(h)
        x = h[order]
        new = np.ones(len(x), bool)
        new[1:] = x[1:] != x[:-1]
        place = np.empty(len(x), np.int64)
        place[order] = np.cumsum(new) - 1
        x = x[new]
        out = np.full(len(x), self.size, np.int64)
        cut = np.searchsorted(x, np.arange(1, 1 << self.bits, dtype=U64) << U64(64 - self.bits)) if self.bits else []
        for s, (a, b) in enumerate(zip([0, *cut], [*cut, len(x)])):
            if b > a and s in self.parts:
                hashes, numbers, first = self.hashes(s)
                at = np.searchsorted(hashes, x[a:b]) if len(hashes) < 1 << 12 else self._search(hashes, first, x[a:b])
                i = np.flatnonzero(at < len(hashes))
                i = i[hashes[at[i]] == x[a:b][i]]
                out[a + i] = numbers[at[i]]
        return out[place]

    def _search(self, hashes: np.ndarray, first: np.ndarray, x: np.ndarray) -> np.ndarray:
        top = ((x << U64(self.bits)) >> U64(48)).astype(np.int64)
        lo, hi = first[top], first[top + 1]
        go = np.flatnonzero(lo < hi)
        while len(go):
            mid = (lo[go] + hi[go]) >> 1
            less = hashes[mid] < x[go]
            lo[go[less]] = mid[less] + 1
            hi[go[~less]] = mid[~less]
            go = go[lo[go] < hi[go]]
        return lo

    def nodes(self, h: np.ndarray, first: np.ndarray, order: int, found=None) -> tuple[list[np.ndarray], np.ndarray]:
        """(for each level k the node of the k words from each word on, or -1; of each word and the next, the position of the next among the children).

        found(k, last words, nodes, codes) is called for each level's questions: words after a node of the level above, in the same text."""
        ids = self.ids(h)
        n = len(ids)
        inner = np.ones(n, bool)  # the next word is of the same text
        inner[first[1:][first[1:] > 0] - 1] = False
        known = ids < self.size
        levels, near = [np.where(known, ids, -1)], np.full(n, -1, np.int64)
        none = 1 << 40  # no parent has such a child
        for k in range(2, order + 1):
            node = np.full(n, -1, np.int64)
            i = np.flatnonzero(levels[-1] >= 0)
            i = i[i + k - 1 < n]
            i = i[inner[i + k - 2]]
            child = levels[0][i + 1] if k == 2 else near[i + k - 2]
            if found is None:
                ok = child >= 0
                i, child = i[ok], child[ok]
            if len(i):
                node[i], codes = self.levels[k].find(levels[-1][i], np.where(child < 0, none, child))
                if found:
                    found(k, i + k - 1, node[i], codes)
            if k == 2:
                j = np.flatnonzero(node >= 0)
                near[j] = node[j] - self.levels[2].starts(ids[j])
            levels.append(node)
        return levels, near

    def codes(self, h: np.ndarray, first: np.ndarray, order: int) -> np.ndarray:
        """Code of each word of the texts."""
        steps = []
        levels, _ = self.nodes(h, first, order, lambda *x: steps.append(x[1:]))
        i = np.flatnonzero(levels[0] >= 0)
        out = np.full(len(h), self.unknown, np.int64)
        if len(i):
            out[i] = self.p1[levels[0][i]]
        for at, node, code in steps:
            out[at] = np.where(node >= 0, code, out[at] + code)
        return out


@lru_cache(2)
def _model(model: str, order: int) -> Lm:
    return Lm(model, order)


# == counting

_COUNTS = "part int, keys binary, counts binary"


def _emit(keys: np.ndarray, parts: int):
    """One task's different keys with their numbers, cut by part."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    n, keys = np.diff(np.append(at, len(keys))).astype(np.uint32), keys[at]
    part = (mix(keys) % U64(parts)).astype(np.int32)
    order = np.argsort(part.astype(np.int16) if parts < 1 << 15 else part, kind="stable")  # by digits where 16 bits do
    keys, n, part = keys[order], n[order], part[order]
    cut = np.searchsorted(part, np.arange(parts + 1))
    some = [p for p in range(parts) if cut[p + 1] > cut[p]]
    pack = lambda x: pa.compress(x.tobytes(), "zstd", asbytes=True)
    size = lambda x: len(x).to_bytes(8, "little")
    keys_of = [size(x := keys[cut[p] : cut[p + 1]]) + pack(np.diff(x, prepend=U64(0))) for p in some]
    counts_of = [pack(n[cut[p] : cut[p + 1]]) for p in some]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(keys_of, pa.binary()), pa.array(counts_of, pa.binary())], names=["part", "keys", "counts"])


def _merge(least: int):
    def run(batches):
        keys, counts = [np.zeros(0, U64)], [np.zeros(0, np.uint32)]
        for batch in batches:
            for k, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n = int.from_bytes(k[:8], "little")
                keys.append(np.cumsum(np.frombuffer(pa.decompress(k[8:], 8 * n, "zstd", asbytes=True), U64), dtype=U64))
                counts.append(np.frombuffer(pa.decompress(c, 4 * n, "zstd", asbytes=True), np.uint32))
        k, c = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order].astype(np.int64)
        at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
        total = np.add.reduceat(c, at) if len(at) else c
        keep = total >= least
        k, total = k[at][keep], total[keep]
        rare = int(c.sum() - total.sum())
        for i in range(0, len(k), CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(k[i : i + CHUNK].view(np.int64)), pa.array(total[i : i + CHUNK])], names=["key", "n"])
        if rare:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([rare], pa.int64())], names=["key", "n"])

    return run


def _count(docs: DataFrame, keys_of, least: int, parts: int, name: str) -> DataFrame:
    """(key, n) of the keys that keys_of gives for blocks of words, at least `least` times; key null: how many others there were."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        held, size = [], 0
        with np.errstate(over="ignore"):
            for batch in batches:
                raw, off = string_parts(batch.column(0))
                for _, r, o in blocks(raw, off, WORK):
                    x = keys_of(*words(r, o))
                    held.append(x)
                    size += len(x)
                    if size > 1 << 22:
                        yield _emit(np.concatenate(held), parts)
                        held, size = [], 0
            if size:
                yield _emit(np.concatenate(held), parts)

    x = docs.select("text").mapInArrow(run, _COUNTS).repartitionById(parts, "part").mapInArrow(_merge(least), "key long, n long")
    return materialise(x, name)


def _tasks(df: DataFrame, job) -> list[int]:
    """job(rows as arrays by column) once for each partition with rows, for the file it writes; what the jobs return: a number each."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        out = []
        if held:
            x = pa.Table.from_batches(held)
            with np.errstate(over="ignore"):
                out.append(job({k: x.column(k).to_numpy() for k in x.column_names}))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["done"])

    return [r.done for r in df.mapInArrow(run, "done long").collect()]


def _files(spark, path: str, least=None) -> list:
    """(file, rows, least value of a column) of a sorted table, in order: a row for each task that wrote it."""
    x = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), F.min(F.lit(0) if least is None else least).alias("least"))
    return sorted(x.collect(), key=lambda r: int(re.search(r"part-(\d+)", r.file.rsplit("/", 1)[1])[1]))


def _write_words(model: str, counted: DataFrame, p: LmParams) -> int:
    """The vocabulary: number by frequency, in segments by hash and by number; its size."""
    spark = counted.sparkSession
    rare = int(counted.where("key IS NULL").agg(F.sum("n")).first()[0] or 0)
    path = new_path(spark, "lm-vocabulary")
    counted.where("key IS NOT NULL").orderBy(F.desc("n"), "key").write.parquet(path)
    files = _files(spark, path)
    starts = np.concatenate(([0], np.cumsum([r.n for r in files]))).astype(int).tolist()
    first = spark.createDataFrame([(r.file, a) for r, a in zip(files, starts)], "file string, start long")
    x = spark.read.schema("key long, n long").parquet(path).select("key", "n", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    # a row for each file: bounded by the number of tasks
    x = materialise(x.join(F.broadcast(first), "file").select("key", "n", (F.col("start") + F.col("row")).alias("number")), "lm-words-numbered")
    size, per = starts[-1], p.segment
    total = int(x.agg(F.sum("n")).first()[0] or 0) + rare + 1
    parts = -(-size // per) or 1
    bits = (parts - 1).bit_length()
    where, train = folder(model, "1", True), folder(model, "1t", True)

    def by_number(c):
        s = int(c["number"][0]) // per
        put(where, f"p{s}", {"p": code(c["n"] / total)})
        put(train, str(s), {"n": c["n"]})
        return s

    def by_hash(c):
        h = c["key"].view(U64)
        order = np.argsort(h)
        h = h[order]
        s = int(h[0] >> U64(64 - bits)) if bits else 0
        put(where, f"hash{s}", {"hash": h, "id": c["number"][order], "first": np.searchsorted((h << U64(bits)) >> U64(48), np.arange((1 << 16) + 1, dtype=U64))})
        return s

    part = x.select("number", "n", F.expr(f"CAST(number div {per} AS INT)").alias("part"))
    _tasks(part.repartitionById(parts, "part").sortWithinPartitions("number"), by_number)
    part = x.select("key", "number", (F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)).alias("part"))
    have = _tasks(part.repartitionById(1 << bits, "part"), by_hash)
    unknown = int(code(np.array([(rare + 1) / total]))[0])
    put(where, "meta", {"meta": np.array([size, unknown, bits, per], np.int64), "hashes": np.array(sorted(have), np.int64)})
    _delete(spark, path), discard(x)
    return size


def _write_level(model: str, counted: DataFrame, k: int, bits: int, above: int, p: LmParams) -> int:
    """Level k from its (parent << bits | id, n): pointers, ids, probabilities, and the parents' back-off weights, in segments; its size."""
    spark = counted.sparkSession
    n = counted.count()
    if (max(n, above)).bit_length() + bits > 63:
        raise ValueError(f"level {k} has {n} n-grams: with {bits} bits for a word they don't fit in 63 bits")
    path = new_path(spark, f"lm-level{k}")
    x = counted.withColumn("parent", F.shiftright("key", bits))
    x.repartitionByRange(-(-n // p.segment) or 1, "parent").sortWithinPartitions("key").select("key", "n", "parent").write.parquet(path)
    files = [f for f in _files(spark, path, F.col("parent")) if f.n] if n else []
    nodes = np.concatenate(([0], np.cumsum([f.n for f in files]))).astype(np.int64)
    # a segment's parents go from its first one to the next segment's first one
    parents = np.array([0, *(f.least for f in files[1:]), above], np.int64)
    where, train = folder(model, str(k), True), folder(model, f"{k}t", True)
    if not files:
        nodes = np.zeros(2, np.int64)
    put(where, "meta", {"starts": np.stack([parents, nodes], 1).ravel()})
    per = p.segment

    def job(s: int) -> int:
        if files:
            source, name = fs.FileSystem.from_uri(files[s].file)
            with source.open_input_file(name) as f:
                t = pq.read_table(f, columns=["key", "n"])
            key, count = t.column(0).to_numpy(), t.column(1).to_numpy()
        else:
            key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, stop = int(parents[s]), int(parents[s + 1])
        up = get(folder(model, f"{k - 1}t", True), "meta")["starts"].reshape(-1, 2)[:-1, 1] if k > 2 else np.arange(0, max(1, above), per)
        upper = Pieces(up, lambda i: get(folder(model, f"{k - 1}t", True), str(i))["n"])
        parent, child = (key >> bits) - first, key & ((1 << bits) - 1)
        # value: id plus the last value of the parent before, plus one
        new = np.ones(len(key), bool)
        new[1:] = parent[1:] != parent[:-1]
        head = np.flatnonzero(new)
        ends = np.append(head[1:], len(key))[: len(head)] - 1
        base = np.concatenate(([0], np.cumsum(child[ends] + 1)))
        values = base[np.cumsum(new) - 1] + child
        held = np.bincount(parent, minlength=stop - first)
        share = np.maximum(count - p.discount, 0) / upper[key >> bits] if len(key) else np.zeros(0)
        g = code(np.clip(1 - np.bincount(parent, share, minlength=stop - first), 0, 1))
        if k == 2:
            suffix = child
            lower = _model(model, 1).p1
        else:
            last = Pieces(up, lambda i: get(folder(model, f"{k - 1}t", True), str(i))["suffix"])[key >> bits] if len(key) else child
            below = _model(model, k - 1).levels[k - 1]
            suffix = (below.starts(last) + child if k == 3 else below.find(last, child)[0]) if len(key) else child
            lower = below.p
        out = code(share + value(g[parent]) * value(lower[suffix])) if len(key) else np.zeros(0, np.uint8)
        put(where, str(s), {**elias_fano("ptr", np.concatenate(([0], np.cumsum(held))), len(key) + 1), **elias_fano("ids", values, int(base[-1])), "p": out, "g": g})
        put(train, str(s), {"n": count, "suffix": suffix})
        return s

    n_tasks = len(nodes) - 1
    _tasks(spark.range(0, n_tasks, 1, n_tasks), lambda c: [job(s) for s in c["id"].tolist()][0])
    put(train, "meta", {"starts": np.stack([parents, nodes], 1).ravel()})
    _delete(spark, path)
    return n


def train(docs: DataFrame, params: LmParams = LmParams()) -> str:
    """Counts all documents and writes the trie; its handle."""
    spark = docs.sparkSession
    uri = new_path(spark, "lm")
    copy = params.copy if params.copy is not None else not uri.startswith("file:")
    model = (COPY if copy else "") + uri

    def spread(k: int) -> None:
        if copy:  # to each node once, when first asked for
            spark.sparkContext.addFile(folder(model, str(k), True), recursive=True)

    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = _count(docs, lambda h, first: h, params.min_word, least, "lm-words")
    tokens = int(counted.agg(F.sum("n")).first()[0] or 0)
    parts = max(least, tokens // params.part_tokens)
    above = _write_words(model, counted, params)
    bits = max(1, above.bit_length())
    discard(counted)
    spread(1)

    def keys(k: int):
        def of(h, first):
            levels, near = _model(model, k - 1).nodes(h, first, k - 1)
            node = levels[-1]
            if not len(node):
                return np.zeros(0, U64)
            ok = (node[:-1] >= 0) & (node[1:] >= 0)
            if k == 2:
                ok[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(node))] - 1] = False
            i = np.flatnonzero(ok)
            child = node[i + 1] if k == 2 else near[i + k - 2]
            return node[i].astype(U64) << U64(bits) | child.astype(U64)

        return of

    for k in range(2, params.order + 1):
        counted = _count(docs, keys(k), params.min_count, parts, f"lm-grams{k}")
        above = _write_level(model, counted.where("key IS NOT NULL"), k, bits, above, params)
        discard(counted)
        spread(k)
    for k in range(1, params.order + 1):
        _delete(spark, folder(model, f"{k}t", True))
    return model


_SCORE = T.StructType([T.StructField("words", T.LongType()), T.StructField("code", T.LongType())])


def score(docs: DataFrame, model: str, order: int = LmParams().order) -> DataFrame:
    """docs, with n_words, bits (-log2 of the probability of its words) and perplexity, to 4 places (underscores in front where docs has such columns)."""
    names = [free_name(docs.columns, n) for n in ("n_words", "bits", "perplexity")]

    def run(text: pa.Array) -> pa.Array:
        lm = _model(model, order)
        n, total = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        with np.errstate(over="ignore"):
            for _, r, o in blocks(*string_parts(text), WORK):
                h, first = words(r, o)
                c = np.concatenate(([0], np.cumsum(lm.codes(h, first, order))))
                n.append(np.diff(first)), total.append(c[first[1:]] - c[first[:-1]])
        return pa.StructArray.from_arrays([pa.array(np.concatenate(n)), pa.array(np.concatenate(total))], names=["words", "code"])

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    key = free_name(docs.columns, "lm")
    x = docs.withColumn(key, F.arrow_udf(run, _SCORE)(F.col("text")))
    n, bits = F.col(f"{key}.words"), F.col(f"{key}.code") / UNIT
    return x.select(*docs.columns, *(c.alias(k) for k, c in zip(names, (n, bits, F.when(n > 0, F.round(F.pow(F.lit(2.0), bits / n), 4))))))


def oracle(params: LmParams = LmParams()) -> str:
    code_of = lambda p: f"least(255, greatest(0, floor(-log2({p}) * {UNIT} + 0.5)))"
    value_of = lambda c: f"pow(2.0, -{c} / {UNIT}.0)"
    d = params.discount
    return f"""WITH w AS MATERIALIZED (SELECT doc_id, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS l FROM documents)),
c AS (SELECT w, count(*) AS n FROM w GROUP BY w),
total AS (SELECT count(*) AS n FROM w),
v AS MATERIALIZED (SELECT w, n, {code_of("n / ((SELECT n FROM total) + 1.0)")} AS p FROM c WHERE n >= {params.min_word}),
unknown AS (SELECT {code_of("((SELECT n FROM total) - coalesce((SELECT sum(n) FROM v), 0) + 1.0) / ((SELECT n FROM total) + 1.0)")} AS p),
x AS MATERIALIZED (SELECT w.doc_id, w.i, v.w, lag(v.w) OVER s AS b, lag(v.w, 2) OVER s AS a FROM w LEFT JOIN v USING (w) WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
n2 AS MATERIALIZED (SELECT b, w, count(*) AS n FROM x WHERE b IS NOT NULL AND w IS NOT NULL GROUP BY ALL HAVING count(*) >= {params.min_count}),
s2 AS (SELECT n2.*, greatest(n2.n - {d}, 0) / v.n AS share FROM n2 JOIN v ON v.w = n2.b),
g1 AS MATERIALIZED (SELECT v.w AS b, {code_of("greatest(1e-30, least(1, 1 - coalesce(sum(share), 0)))")} AS g FROM v LEFT JOIN s2 ON s2.b = v.w GROUP BY v.w),
p2 AS MATERIALIZED (SELECT s2.b, s2.w, s2.n, {code_of(f"share + {value_of('g')} * {value_of('v.p')}")} AS p FROM s2 JOIN g1 USING (b) JOIN v ON v.w = s2.w),
n3 AS MATERIALIZED (SELECT a, x.b, x.w, count(*) AS n FROM x JOIN p2 ab ON ab.b = x.a AND ab.w = x.b JOIN p2 bw ON bw.b = x.b AND bw.w = x.w GROUP BY ALL HAVING count(*) >= {params.min_count}),
s3 AS (SELECT n3.*, greatest(n3.n - {d}, 0) / ab.n AS share FROM n3 JOIN p2 ab ON ab.b = n3.a AND ab.w = n3.b),
g2 AS MATERIALIZED (SELECT ab.b AS a, ab.w AS b, {code_of("greatest(1e-30, least(1, 1 - coalesce(sum(share), 0)))")} AS g FROM p2 ab LEFT JOIN s3 ON s3.a = ab.b AND s3.b = ab.w GROUP BY ab.b, ab.w),
p3 AS (SELECT s3.a, s3.b, s3.w, {code_of(f"share + {value_of('g')} * {value_of('bw.p')}")} AS p FROM s3 JOIN g2 USING (a, b) JOIN p2 bw ON bw.b = s3.b AND bw.w = s3.w),
scored AS (SELECT x.doc_id, coalesce(p3.p, coalesce(g2.g, 0) + coalesce(p2.p, coalesce(g1.g, 0) + coalesce(v.p, (SELECT p FROM unknown)))) AS c
  FROM x LEFT JOIN v USING (w) LEFT JOIN g1 ON g1.b = x.b LEFT JOIN p2 ON p2.b = x.b AND p2.w = x.w LEFT JOIN g2 ON g2.a = x.a AND g2.b = x.b LEFT JOIN p3 ON p3.a = x.a AND p3.b = x.b AND p3.w = x.w),
r AS (SELECT doc_id, count(*) AS n, sum(c) AS c FROM scored GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(c, 0) / {UNIT}.0 AS bits, CASE WHEN n > 0 THEN round(pow(2.0, (c / {UNIT}.0) / n), 4) END AS perplexity FROM documents LEFT JOIN r USING (doc_id)"""
