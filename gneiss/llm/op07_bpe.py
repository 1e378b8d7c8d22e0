"""Operator 7: BPE encoding and decoding with a pair occurrence index.

Each pre-token of a partition enters the index once; their symbols lie in one array as linked lists. The index maps each pair that can merge (by the rank of what it becomes) to all
its positions. Active ranks are applied in ascending order, from a heap: a rank's merges are done at all its positions by one pass over arrays, the lists of the pairs that end or begin next to a merge
are updated, and ranks that become active by that are put on the heap. Where a merge makes a pair of a lower rank, that is next; a pre-token in which that happens between two merges of one rank is
merged alone, from left to right.

Scale: no shuffle. A partition is read in portions of `portion_bytes` of text and keeps the pre-tokens it has seen with their ids, so a portion indexes only what is new; with more than `most_words` of
them it starts anew, with the same result. So a task's memory doesn't grow with its partition. The vocabulary is a broadcast of fixed size.

Defined results: a null text has null ids, an empty one none. Texts are encoded whole; strings of special tokens are ordinary text. Decoding gives the exact text
back; ids outside the vocabulary and nulls among them are an error; bytes that aren't UTF-8 become U+FFFD. Added columns take underscores in front where docs
has columns of their names. Empty tables give no rows.
"""

from __future__ import annotations

import base64
import heapq
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, string_parts, trim

NONE = 1 << 30
FEW = 24  # positions up to which a rank's merges are done one by one


@dataclass(frozen=True)
class BpeParams:
    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
    portion_bytes: int = 4 << 20
    most_words: int = 1 << 19  # pre-tokens kept with their ids


def _distinct(x: np.ndarray) -> np.ndarray:
    """By sorting, which for integers is several times as fast as the hashing of np.unique."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Known:
    """Pre-tokens by number, with their ids."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = _Numbers()
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, ids: np.ndarray, at: np.ndarray) -> None:
        self.at = np.concatenate((self.at, self.at[-1] + at[1:]))
        self.ids = np.concatenate((self.ids, ids))


class Bpe:
    def __init__(self, ranks: dict[bytes, int], params: BpeParams):
        self.params = params
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        key = np.array([a << 20 | b for a, b in pairs], np.int64)
        value = np.array(list(pairs.values()), np.int32)
        bits = max(4, int(np.ceil(np.log2(len(key) * 2 + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        at, left = self._slot(key), np.arange(len(key))
        while len(left):  # a round puts at most one pair in each free place; the rest look one further
            place = at[left]
            free = self.keys[place] == -1
            self.keys[place[free]], self.values[place[free]] = key[left[free]], value[left[free]]
            left = left[self.keys[place] != key[left]]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The same table for single pairs, made where it is needed."""
        at = np.flatnonzero(self.keys >= 0)
        return dict(zip(self.keys[at].tolist(), self.values[at].tolist()))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; NONE where there is none."""
        key = a.astype(np.int64) << 20 | b
        at = self._slot(key)
        out = np.full(len(key), NONE, np.int32)
        left = np.arange(len(key))
        while len(left):
            seen = self.keys[at]
            hit = seen == key[left]
            out[left[hit]] = self.values[at[hit]]
            go = ~hit & (seen != -1)
            left, at = left[go], (at[go] + 1) & self.mask
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct pre-tokens."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        begin = np.concatenate(([0], np.cumsum(length)))
        sym = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(sym)
        word = np.repeat(np.arange(len(raw), dtype=np.int32), length)
        nxt = np.arange(1, n + 1, dtype=np.int32)
        prv = np.arange(-1, n - 1, dtype=np.int32)
        nxt[begin[1:][length > 0] - 1] = -1
        prv[begin[:-1][length > 0]] = -1
        alive = np.ones(n, bool)
        rank = np.full(n, NONE, np.int32)
        i = np.flatnonzero(nxt >= 0)
        rank[i] = self.rank(sym[i], sym[i + 1])
        # the index: of each rank the positions where a pair begins that becomes it, many at a time or single ones
        index: dict[int, list[np.ndarray]] = {}
        single: dict[int, list[int]] = {}
        active: list[int] = []
        alone: set[int] = set()
        pairs = self.pairs.get
        one_sym, one_nxt, one_prv, one_rank, one_alive, one_word = map(memoryview, (sym, nxt, prv, rank, alive.view(np.uint8), word))

        def put(i: np.ndarray) -> None:
            r = rank[i]
            i, r = i[r != NONE], r[r != NONE]
            if len(i) <= FEW:
                for k, x in zip(r.tolist(), i.tolist()):
                    put_one(k, x)
                return
            order = np.argsort(r, kind="stable")
            i, r = i[order], r[order]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            for k, x in zip(r[np.concatenate(([0], cut))].tolist(), np.split(i, cut)):
                if k in index:
                    index[k].append(x)
                else:
                    index[k] = [x]
                    heapq.heappush(active, k)

        def put_one(k: int, i: int) -> None:
            if k in single:
                single[k].append(i)
            else:
                single[k] = [i]
                heapq.heappush(active, k)

        def merge_each(k: int, p: list[int]) -> None:
            """From left to right."""
            lower = set()
            for i in p:
                if not one_alive[i] or one_rank[i] != k:
                    continue
                if one_word[i] in lower:
                    alone.add(one_word[i])
                j = one_nxt[i]
                one_sym[i], one_alive[j], one_rank[j] = k, 0, NONE
                after = one_nxt[i] = one_nxt[j]
                if after >= 0:
                    one_prv[after] = i
                for t in (one_prv[i], i):
                    if t >= 0:
                        j = one_nxt[t]
                        r = one_rank[t] = pairs(one_sym[t] << 20 | one_sym[j], NONE) if j >= 0 else NONE
                        if r != NONE:
                            put_one(r, t)
                            if r < k:
                                lower.add(one_word[t])

        def merge_all(k: int, p: np.ndarray) -> None:
            p = p[alive[p] & (rank[p] == k)]
            if not len(p):
                return
            # of occurrences that overlap (aaa), every other one from the left
            chain = np.concatenate(([True], nxt[p[:-1]] != p[1:]))
            if not chain.all():
                first = np.flatnonzero(chain)
                p = p[(np.arange(len(p)) - first[np.cumsum(chain) - 1]) % 2 == 0]
            q = nxt[p]
            side = np.flatnonzero(nxt[q[:-1]] == p[1:])  # merges side by side: the left one is done while the right one's first symbol is there still
            early = side[self.rank(np.full(len(side), k, np.int32), sym[p[side + 1]]) < k] if len(side) else side
            alone.update(word[p[early]].tolist())
            sym[p] = k
            alive[q] = False
            rank[q] = NONE
            after = nxt[q]
            nxt[p] = after
            has = after >= 0
            prv[after[has]] = p[has]
            before = prv[p]
            touched = _distinct(np.concatenate((p, before[before >= 0])))
            rank[touched] = NONE
            t = touched[nxt[touched] >= 0]
            rank[t] = self.rank(sym[t], sym[nxt[t]])
            put(t)
            if len(t) and rank[t].min() < k:
                many = word[p][1:][word[p][1:] == word[p][:-1]]
                alone.update(np.intersect1d(many, word[t[rank[t] < k]]).tolist())

        put(i)
        while active:
            k = heapq.heappop(active)
            arrays, ones = index.pop(k, ()), single.pop(k, ())
            if len(ones) + sum(map(len, arrays)) <= FEW:
                merge_each(k, sorted({*ones, *(i for x in arrays for i in x.tolist())}))
            else:
                merge_all(k, _distinct(np.concatenate([*arrays, np.array(ones, np.int64)])))
        ids, at = sym[alive], np.searchsorted(word[alive], np.arange(len(raw) + 1))
        if alone:
            each = [self._one(raw[w]) if w in alone else ids[at[w] : at[w + 1]] for w in range(len(raw))]
            return np.concatenate(each), np.concatenate(([0], np.cumsum([len(x) for x in each])))
        return ids, at

    def _one(self, raw: bytes) -> np.ndarray:
        """Ids of one pre-token: the leftmost pair of the least rank, one merge at a time."""
        sym = self.of_byte[np.frombuffer(raw, np.uint8)].tolist()
        n = len(sym)
        nxt, prv = [*range(1, n), -1], list(range(-1, n - 1))
        pairs = self.pairs.get
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(sym, sym[1:])) if (r := pairs(a << 20 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = r, -1
            nxt[i] = nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
            for x in (prv[i], i):
                if x >= 0 and nxt[x] >= 0:
                    a, b = sym[x], sym[nxt[x]]
                    r = pairs(a << 20 | b)
                    if r is not None:
                        heapq.heappush(heap, (r, x, a, b))
        return np.array([x for x in sym if x >= 0], np.int32)

    def encode(self, texts: list[str], known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts. known: the pre-tokens of earlier texts, to which those of these are added."""
        known = Known() if known is None else known
        if len(known.number) > self.params.most_words:
            known.clear()
        find, get = regex.compile(self.params.pattern).findall, known.number.__getitem__
        seen = []
        for t in texts:
            found = find(t)
            seen.append(np.fromiter(map(get, found), np.int32, len(found)))
        fresh = list(islice(known.number, len(known.at) - 1, None))
        if fresh:
            known.add(*self.encode_words(fresh))
        ids, at = known.ids, known.at
        size = np.diff(at)
        w = np.concatenate(seen) if seen else np.zeros(0, np.int32)
        n = size[w]
        where = np.repeat(at[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum([len(x) for x in seen]))).astype(np.int64)]
        return ids[where], ends

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.tokens)):
            raise ValueError("id outside the vocabulary")
        get, ids = self.tokens.__getitem__, ids.tolist()
        return [b"".join(map(get, ids[a:b])).decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:])]


def load(spark, params: BpeParams):
    """Broadcast of the vocabulary, which the driver reads."""
    bounded_batches(spark)
    with open(params.vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return spark.sparkContext.broadcast(Bpe(ranks, params))


def encode(docs: DataFrame, params: BpeParams = BpeParams()) -> DataFrame:
    """docs, with token_ids and n_tokens."""
    bpe = load(docs.sparkSession, params)
    at = docs.columns.index("text")
    names = [free_name(docs.columns, n) for n in ("token_ids", "n_tokens")]

    def flush(batches: list[pa.RecordBatch], known: Known):
        with np.errstate(over="ignore"):
            ids, ends = bpe.value.encode([t or "" for b in batches for t in b.column(at).to_pylist()], known)
        trim()
        row = 0
        for b in batches:
            e = ends[row : row + b.num_rows + 1]
            row += b.num_rows
            null = np.array(b.column(at).is_null().to_numpy(zero_copy_only=False), bool)
            lists = pa.ListArray.from_arrays(pa.array(e - e[0], pa.int32()), pa.array(ids[e[0] : e[-1]], pa.int32()), mask=pa.array(null))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(np.diff(e).astype(np.int32), mask=null)], names=[*(f"c{i}" for i in range(b.num_columns)), "ids", "n"])

    def run(it):
        held, size, known = [], 0, Known()
        for batch in it:
            _, off = string_parts(batch.column(at))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(off, off[i] + params.portion_bytes - size, "right")) - 1)
                held.append(batch.slice(i, j - i))
                size += int(off[j] - off[i])
                i = j
                if size >= params.portion_bytes or i < batch.num_rows:
                    yield from flush(held, known)
                    held, size = [], 0
        if held:
            yield from flush(held, known)
        held.clear(), known.clear()
        trim()

    kinds = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)]
    x = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(run, ", ".join([*kinds, "ids array<int>", "n int"]))
    return x.toDF(*docs.columns, *names)


def decode(x: DataFrame, ids: str, name: str, params: BpeParams = BpeParams()) -> DataFrame:
    """x, with the text of its column `ids` as column `name`."""
    bpe = load(x.sparkSession, params)

    def text(column: pa.Array) -> pa.Array:
        null = np.array(column.is_null().to_numpy(zero_copy_only=False), bool)
        values = column.values.to_numpy(zero_copy_only=False)
        return pa.array(bpe.value.decode(values, column.offsets.to_numpy()), pa.string(), mask=null)

    text.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return x.withColumn(name, F.arrow_udf(text, "string")(F.col(ids)))
