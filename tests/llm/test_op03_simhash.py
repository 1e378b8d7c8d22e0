import numpy as np
import pyarrow as pa

from gneiss.llm import op03_simhash as S
from gneiss.llm.common import U64, string_parts


def text(i, n=120):
    r = np.random.default_rng(i)
    return " ".join("".join(r.choice(list("abcdefghijklmnop"), 6)) for _ in range(n))


def edit(t, k, seed=0):
    w = t.split()
    for i in np.random.default_rng(seed).choice(len(w), k, replace=False):
        w[i] = f"changed{seed}x{i}"
    return " ".join(w)


def test_golay_is_perfect():
    code, nearest = S.golay()
    assert len(set(code.tolist())) == 4096 and np.bitwise_count(code[1:]).min() == 7
    v = np.random.default_rng(0).integers(0, 1 << 23, 1000)
    assert np.bitwise_count(code[nearest[v]] ^ v).max() <= 3


def test_anchors_meet_at_every_pair_within_the_threshold():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 46, 400).astype(U64)
    for flips in range(5):
        b = a.copy()
        for i in range(len(b)):
            for bit in r.choice(46, flips, replace=False):
                b[i] ^= U64(1 << int(bit))
        (ra, ka), (rb, kb) = S.anchors(a, 2), S.anchors(b, 2)
        for i in range(len(a)):
            assert set(ka[ra == i]) & set(kb[rb == i])


def test_anchor_balls_by_brute_force():
    code, _ = S.golay()
    v = np.random.default_rng(2).integers(0, 1 << 46, 5).astype(U64)
    rows, keys = S.anchors(v, 2)
    for i, x in enumerate(v.astype(np.int64)):
        a = np.maximum(np.bitwise_count(code ^ (x & S.MASK)).astype(int) - 3, 0)
        b = np.maximum(np.bitwise_count(code ^ (x >> 23)).astype(int) - 3, 0)
        want = {(int(p) << 12) | int(q) for p in np.flatnonzero(a <= 2) for q in np.flatnonzero(b <= 2 - a[p])}
        assert set(keys[rows == i].tolist()) == want and (rows == i).sum() == len(want)


def brute(rows, p=S.SimhashParams()):
    """Components of all pairs by comparing every document with every other."""
    ids = sorted({i for i, _ in rows if i is not None})
    first = {i: min(t or "" for j, t in rows if j == i) for i in ids}
    f, has = S.fingerprints(*string_parts(pa.array([first[i] for i in ids])))
    f = f.copy()
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if has[a] and has[b]:
                x = f[a] ^ f[b]
                u, v = S.parts(x[:1], x[1:])
                if min(np.bitwise_count(u)[0], np.bitwise_count(v)[0]) <= p.threshold and int(np.bitwise_count(x).sum()) <= p.whole:
                    i, j = find(ids[a]), find(ids[b])
                    root[max(i, j)] = min(i, j)
    groups = {i: find(i) for i in ids}
    many = {g for i, g in groups.items() if i != g}
    return {(i, g) for i, g in groups.items() if g in many}


def test_groups_equal_brute_force(docs):
    rows = [(i, text(i)) for i in range(60)]
    rows += [(100 + 10 * i + k, edit(text(i), k, k)) for i in range(12) for k in range(1, 7)]
    rows += [(300 + i, text(5)) for i in range(60)]  # ties: exact copies
    rows += [(400 + i, edit(text(7), 1, i)) for i in range(70)]  # a group larger than the small runs
    got = {tuple(r) for r in S.near_duplicate_groups(docs(rows)).collect()}
    assert got == brute(rows) and len(got) > 200


def test_half_and_whole_reach_give_the_same_groups(docs):
    rows = [(i, text(i)) for i in range(25)] + [(100 + 10 * i + k, edit(text(i), k, k)) for i in range(10) for k in (1, 3, 5, 7)] + [(400 + i, edit(text(7), 2, i)) for i in range(55)]
    half, whole = ({tuple(r) for r in S.near_duplicate_groups(docs(rows), S.SimhashParams(reach=x)).collect()} for x in ("half", "whole"))
    assert half == whole == brute(rows) and len(half) > 60


def test_ids_of_any_size(docs):
    big = 1 << 62
    rows = [(big, text(1)), (-big, text(1)), (big - 1, text(2)), (1 << 40, edit(text(2), 1)), (0, text(3))]
    got = {tuple(r) for r in S.near_duplicate_groups(docs(rows)).collect()}
    assert got == {(big, -big), (-big, -big), (big - 1, 1 << 40), (1 << 40, 1 << 40)} == brute(rows)


def test_recall_of_near_copies(docs):
    n = 80
    rows = [(i, text(i, 200)) for i in range(n)] + [(1000 + i, edit(text(i, 200), 4, i)) for i in range(n)]
    g = dict(tuple(r) for r in S.near_duplicate_groups(docs(rows)).collect())
    assert sum(g.get(1000 + i) == i for i in range(n)) >= 0.9 * n
    assert set(g.values()) <= set(range(n))  # unlike documents stay apart


def test_edges(spark, docs):
    t = text(1)
    rows = [(1, t), (1, t), (None, t), (2, t.upper()), (3, None), (4, ""), (5, "!!"), (6, "!!"), (7, t * 200), (8, "word"), (9, "word")]
    x = docs([(*r, "g", 1, 2) for r in rows], "doc_id long, text string, group_id string, lo long, point long")
    got = S.drop_near_duplicates(x)
    assert got.columns == x.columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i) == [1, 1, 3, 4, 5, 6, 8] and None in ids  # the words of 7 are those of 1
    assert S.near_duplicate_groups(docs([])).count() == 0


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in S.components(e).collect()}
    assert got == {i: 0 for i in range(1, 101)} | {201: 200}
