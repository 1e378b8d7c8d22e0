import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
import regex

from gneiss.llm import op06_decontaminate as D
from gneiss.llm.common import string_parts, words

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
SCHEMA = "item_id long, text string"


def text(i, n):
    r = np.random.default_rng(i)
    return " ".join("".join(r.choice(list("abcdefgh"), 4)) for _ in range(n))


ITEMS = [(i, text(i, 12 + 3 * (i % 6))) for i in range(20)] + [(50, text(3, 21)), (51, "one two"), (52, None), (53, ""), (54, "")]


def damaged(t, k):
    w = t.split()
    for i in range(k):
        w[(i + 1) * len(w) // (k + 1)] = f"other{i}"
    return " ".join(w)


DOCS = (
    [(i, text(100 + i, 60) + " " + ITEMS[i][1] + " " + text(200 + i, 50)) for i in range(12)]
    + [(20 + i, text(300 + i, 30) + ". " + damaged(ITEMS[i][1], 1).upper() + "! " + text(400 + i, 9)) for i in range(12)]
    + [(40 + i, text(500 + i, 200)) for i in range(20)]
    + [(70, ITEMS[4][1]), (71, " ".join(ITEMS[5][1].split()[:20])), (72, " ".join(ITEMS[5][1].split()[:8]))]
    + [(80, None), (81, ""), (82, "a b"), (None, ITEMS[1][1]), (0, text(100, 60)), (90, text(600, 30_000) + " " + ITEMS[2][1])]
)


def brute(docs, items, p=D.LeakParams()):
    """Every window of every document against every item, over tuples of words, without index or filter."""
    grams = lambda t: [tuple(w[i : i + 3]) for w in [WORD.findall((t or "").lower())] for i in range(len(w) - 2)]
    items = [(i, grams(t)) for i, t in items if grams(t)]
    df = Counter(g for _, item in items for g in set(item))
    other = round(16 * (math.log(1 + len(items)) + 1))
    weight = {g: round(16 * (math.log((1 + len(items)) / (1 + n)) + 1)) for g, n in df.items()}

    def bits(win):
        s = np.array([hash_of(g) for g in win], np.uint64)
        return np.packbits((2 * np.unpackbits(s.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(int) - 1).sum(0) >= 0, bitorder="little").view(np.uint64)[0]

    out = {}
    for doc, t in docs:
        s = grams(t)
        for i, item in items if s else ():
            n, have = min(len(item), len(s)), Counter(item)
            for a in range(len(s) - n + 1):
                win = Counter(s[a : a + n])
                if not win.keys() & have.keys() or np.bitwise_count(bits(s[a : a + n]) ^ bits(item)) > p.radius:
                    continue
                both = sum(weight[x] * min(c, have[x]) for x, c in win.items() if x in have)
                sim = both / (sum((weight[x] if x in have else other) * c for x, c in win.items()) + sum(weight[x] * c for x, c in have.items()) - both)
                if sim >= p.similarity and ((doc, i) not in out or sim > out[doc, i][1]):
                    out[doc, i] = (a, sim)
    return {(d, i, a, round(s, 9)) for (d, i), (a, s) in out.items()}


@lru_cache(None)
def hash_of(gram):
    with np.errstate(over="ignore"):
        return D.shingles(*words(*string_parts(pa.array([" ".join(gram)]))))[0][0]


def frames(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, SCHEMA)


@pytest.mark.parametrize("every", [False, True])
def test_leaks_equal_brute_force_whatever_the_portions(spark, every):
    docs, items = frames(spark)
    want = brute([d for d in DOCS if d[0] != 90], ITEMS, D.LeakParams(radius=64 if every else 15)) | {(90, 2, 30_000, 1.0)}
    every_row = []
    for portion in (1 << 20, 400):
        p = D.LeakParams(portion_bytes=portion, every=every)
        rows = D.leaks(docs, items, p).collect()
        assert {(r.doc_id, r.item_id, r.first_word, round(r.similarity, 9)) for r in rows} == want
        every_row.append(sorted(map(tuple, rows), key=str))
    assert every_row[0] == every_row[1]
    got = {g[:2] for g in want}
    assert {(i, i) for i in range(12)} <= got and len({(20 + i, i) for i in range(12) if i % 6 >= 3} & got) >= (6 if every else 4)
    assert not {g[0] for g in got} & {*range(40, 60), 72, 80, 81, 82} and {(3, 50), (70, 4), (None, 1)} <= got


def test_items_without_id_and_other_scripts(spark):
    a, b, c = text(1, 15), text(2, 15), "Один ДВА три — “Четыре” пять шесть Žena Élan sieben"
    items = spark.createDataFrame([(None, a), (-1, b), (3, c)], SCHEMA)
    docs = spark.createDataFrame([(1, a, "x", 1), (2, b, "y", 2), (3, "und: один два ТРИ «четыре» ПЯТЬ, шесть! žena élan Sieben", "z", 3)], "doc_id long, text string, item_id string, similarity int")
    for portion in (1 << 20, 30):
        p = D.LeakParams(every=True, portion_bytes=portion)
        assert {(r.doc_id, r.item_id) for r in D.leaks(docs, items, p).collect()} == {(1, None), (2, -1), (3, 3)}
        assert D.drop_leaks(docs, items, p).count() == 0 and D.drop_leaks(docs, items, p).columns == docs.columns


def test_drop_leaks(spark):
    docs, items = frames(spark)
    x = docs.selectExpr("*", "1 AS item_id", "2 AS similarity")
    got = D.drop_leaks(x, items)
    assert got.columns == x.columns
    ids = [r.doc_id for r in got.collect()]
    assert {*range(40, 60), 72, 80, 81, 82} <= set(ids) and ids.count(0) == 1 and None not in ids
    assert D.drop_leaks(docs, items.limit(0)).count() == len(DOCS)
    assert D.leaks(docs.limit(0), items).count() == 0 and D.leaks(docs, items.limit(0)).count() == 0


def test_multi_index_finds_all_within_the_radius():
    p = D.LeakParams()
    ix = D.Index([i for i, t in ITEMS[:20]], [t for _, t in ITEMS[:20]], p)
    r = np.random.default_rng(5)
    for k, f in enumerate(ix.prints):
        for _ in range(30):
            g = int(f)
            for bit in r.choice(64, p.radius, replace=False):
                g ^= 1 << int(bit)
            row, item, d = ix.lookup(np.array([g], np.uint64))
            assert (k, p.radius) in set(zip(item.tolist(), d.tolist()))


def test_query_finds_all_without_the_radius(spark, tmp_path):
    from gneiss.llm.queries import op6_leaks

    items = [(i, text(1000 + i, n)) for i, n in enumerate([20, 30, 30, 40, 40, 12] * 3)] + [(90, "a b c " * 8)]
    docs = [(i, text(1100 + i, 40) + " " + damaged(t, i % 5) + " " + text(1200 + i, 30)) for i, t in items[:-1]]
    docs += [(60, damaged(items[3][1], 2)), (61, " ".join(items[4][1].split()[:26])), (62, "a b c " * 5 + text(7, 9) + " a b c" * 4), (63, items[0][1] + " " + text(8, 5) + " " + items[0][1])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, SCHEMA).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id, r.first_word, round(r.similarity, 9)) for r in op6_leaks(spark, str(tmp_path)).collect()}
    want = brute(docs, items, D.LeakParams(radius=64))
    assert got == want and len(want - brute(docs, items)) >= 3  # at least three of them lie beyond the radius
