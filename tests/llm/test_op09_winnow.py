import numpy as np
import pyarrow as pa

from gneiss.llm import op09_winnow as W
from gneiss.llm.common import string_parts

P = W.WinnowParams()


def line(i, n=12):
    r = np.random.default_rng(i)
    return " ".join("".join(r.choice(list("abcdefgh"), 5)) for _ in range(n))


def block(i, n):
    return [line(1000 * i + k) for k in range(n)]


def count(lines):
    return sum(len(x.split()) for x in lines)


def all_pairs(rows, least):
    """Of plain lists, none of the operator's code: the lines of all runs of `least` words that occurred at any earlier place."""
    at = [(i, t.split("\n"), k) for i, t in sorted(rows) for k in range(t.count("\n") + 1)]
    by_line = {}
    for i, x, a in at:
        by_line.setdefault(x[a], []).append((i, x, a))
    cut = {}
    for found in by_line.values():
        for i, x, a in found:
            for j, y, b in found:
                if (j, b) < (i, a):
                    n = next((k for k in range(min(len(x) - a, len(y) - b)) if x[a + k] != y[b + k]), min(len(x) - a, len(y) - b))
                    if count(x[a : a + n]) >= least:
                        cut.setdefault(i, set()).update(range(a, a + n))
    return cut


def brute(rows):
    """Every pair of places of a selected gram, extended line by line. Rows have ids and texts of their own."""
    lines = {i: t.split("\n") for i, t in rows if i is not None and t}
    places = {}
    for i in sorted(lines):
        with np.errstate(over="ignore"):
            h, w, first = W.line_hashes(*string_parts(pa.array(["\n".join(lines[i])])))
            assert w.tolist() == [len(x.split()) for x in lines[i]]
            at, after = W.seeds(h, w, first, P)[:2]
        for a, b in zip(at.tolist(), after.tolist()):
            assert P.gram_words <= count(lines[i][a:b]) and count(lines[i][a : b - 1]) < P.gram_words
            places.setdefault(tuple(lines[i][a:b]), []).append((i, a))
    cut = {}
    for found in places.values():
        for i, a in found:
            for j, b in found:
                if (j, b) < (i, a):
                    x, y, s, e = lines[i], lines[j], 0, 0
                    while a - s > 0 and b - s > 0 and x[a - s - 1] == y[b - s - 1]:
                        s += 1
                    while a + e < len(x) and b + e < len(y) and x[a + e] == y[b + e]:
                        e += 1
                    cut.setdefault(i, set()).update(range(a - s, a + e))
    return cut


def result(rows, cut):
    out = []
    for i, t in rows:
        gone = cut.get(i, ())
        if not t or not gone:
            out.append((i, t))
            continue
        left = [x for k, x in enumerate(t.split("\n")) if k not in gone]
        if left:
            out.append((i, "\n".join(left)))
    return sorted(out, key=str)


def run(docs, rows):
    return sorted(((r.doc_id, r.text) for r in W.drop_repeated_lines(docs(rows)).collect()), key=str)


def corpus():
    shared, long_line = block(1, 6), line(5, 60)
    rows = [(i, "\n".join(block(10 + i, 4) + (shared if i % 3 == 0 else []) + block(40 + i, 3))) for i in range(12)]
    rows += [(20, "\n".join([line(7), long_line, line(8)])), (21, "\n".join([line(9), long_line])), (22, long_line)]
    rows += [(30, "\n".join(shared[1:])), (31, "\n".join([line(70)] + shared[:5]))]
    rows += [(40, "\n".join(block(3, 8))), (41, "\n".join(block(3, 8))), (42, "\n".join(block(3, 5) + block(99, 4)))]
    rows += [(50, "\n".join([line(1)] * 40)), (51, "short\nshort\nshort"), (52, "short")]
    return rows


def pool_corpus(seed, n=60):
    """Lines of all lengths in random order: every context occurs with every other."""
    r = np.random.default_rng(seed)
    pool = [line(900 + k, n) for k, n in enumerate([25, 25, 25, 10, 15, 30, 50, 0, 7, 60, 1, 1, 0])]
    return [(i, "\n".join(pool[k] for k in r.integers(0, len(pool), r.integers(2, 12)))) for i in range(n)]


def test_equals_brute_force(docs):
    assert run(docs, corpus()) == result(corpus(), brute(corpus()))


def test_every_run_of_the_window_is_found(docs):
    got = dict((r.doc_id, r.text) for r in W.drop_repeated_lines(docs(corpus()), drop_emptied=False).select("doc_id", "text").collect())
    shared = block(1, 6)
    assert all(x in got[0] for x in shared)  # the first stays
    for i in (3, 6, 9):
        assert not any(x in got[i] for x in shared) and all(x in got[i] for x in block(10 + i, 4))
    assert line(5, 60) in got[20] and line(5, 60) not in got[21] and got[22] == ""
    assert got[41] == "" and got[42] == "\n".join(block(99, 4)) and got[50] == line(1)
    assert got[51] == "short\nshort\nshort" and got[52] == "short"


def test_any_ids(docs):
    """Dense, sparse, negative, and about powers of two."""
    for far in (range(8), [k << 40 for k in range(8)], [65534, 65535, 65536, 65537, 131071, 131072, 1 << 31, 1 << 32], [-(1 << 63), -(1 << 62), -5, -1, 0, 1 << 62, (1 << 63) - 2, (1 << 63) - 1]):
        far = list(far)
        rows = [(far[k], "\n".join(block(10 + k, 4) + block(1, 6) + block(40 + k, 3) + (block(2, 5) if k % 2 else []))) for k in range(len(far))]
        got = run(docs, rows)
        assert got == result(rows, all_pairs(rows, P.window_words)) == result(rows, brute(rows))
        assert [i for i in far if block(1, 6)[0] in dict(got)[i]] == [far[0]] and [i for i in far if block(2, 5)[0] in dict(got)[i]] == [far[1]]


def test_copies_leave_one(docs):
    rows = [((k + 1) << 40, "\n".join(block(6, 9))) for k in range(5)]
    assert run(docs, rows) == [rows[0]]


def test_a_gram_in_other_contexts(docs):
    p, g, q = (line(900 + k, 25) for k in range(3))
    rows = [(1, f"{line(1, 25)}\n{g}\n{line(2, 25)}"), (2, f"{p}\n{g}\n{q}"), (3, f"{line(3, 25)}\n{g}\n{line(4, 25)}"), (4, f"{p}\n{g}\n{q}"), (5, f"{line(5)}\n{g}\n{q}\n{line(6)}")]
    got = dict(run(docs, rows))
    assert 4 not in got and got[5] == f"{line(5)}\n{line(6)}" and got == dict(result(rows, brute(rows)))


def test_runs_of_the_window_go_in_any_context(docs):
    for seed in range(3):
        rows = [(i << 33, t) for i, t in pool_corpus(seed)]
        cut, most, least = brute(rows), all_pairs(rows, P.gram_words), all_pairs(rows, P.window_words)
        assert all(x <= cut.get(i, set()) for i, x in least.items()) and all(x <= most[i] for i, x in cut.items())
        assert run(docs, rows) == result(rows, cut)


def test_rows_of_equal_id_are_judged_by_their_own_text(docs):
    a, b = block(1, 6), block(2, 6)
    rows = [(0, "\n".join(a)), (7, "\n".join(a + block(3, 3))), (7, "\n".join(block(4, 6))), (7, "\n".join(b + block(5, 3))), (7, "\n".join(b + block(5, 3))), (9, "\n".join(b))]
    assert run(docs, rows) == sorted([(0, "\n".join(a)), (7, "\n".join(block(3, 3))), (7, "\n".join(block(4, 6))), *[(7, "\n".join(b + block(5, 3)))] * 2], key=str)


def test_edges(docs):
    t = "\n".join(block(1, 8))
    rows = [(1, t), (1, t), (2, t), (None, t), (3, None), (4, ""), (5, "\n\n\n"), (6, t + "\n" + line(6)), (7, "x " * 50_000)]
    x = docs([(*r, "winnow", "id", None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, winnow string, id string, n_chars long")
    got = W.drop_repeated_lines(x)
    assert got.columns == x.columns
    have = sorted(((r.doc_id, r.text, r.n_chars) for r in got.collect()), key=str)
    kept = [(1, t), (1, t), (None, t), (3, None), (4, ""), (5, "\n\n\n"), (6, line(6)), (7, "x " * 50_000)]
    assert have == sorted(((i, s, None if s is None else len(s)) for i, s in kept), key=str)
    assert W.drop_repeated_lines(docs([])).count() == 0


def test_many_lines_take_linear_time(docs):
    many = "\n".join(f"w{k} x" if k % 3 else "" for k in range(60_000))
    rows = [(1, many), (2, "head\n" + many + "\ntail"), (3, "\n" * 100_000 + "y " * 60)]
    got = dict(run(docs, rows))
    assert got[1] == many and got[2] == "head\ntail" and got[3] == rows[2][1]


def test_least_takes_the_last_of_ties():
    g = np.random.default_rng(0).integers(0, 4, 300).astype(np.uint64)
    start = np.random.default_rng(1).integers(0, 299, 500)
    stop = np.minimum(300, start + np.random.default_rng(2).integers(1, 80, 500))
    assert W._least(g, start, stop).tolist() == [max(range(a, b), key=lambda i: (-int(g[i]), i)) for a, b in zip(start.tolist(), stop.tolist())]


def test_line_kernel():
    texts = ["a b\n\nc", "", "\n", "x", " y  z ", "é\r\n"]
    h, w, first = W.line_hashes(*string_parts(pa.array(texts)))
    assert np.diff(first).tolist() == [3, 1, 2, 1, 1, 2] and w.tolist() == [2, 0, 1, 0, 0, 0, 1, 2, 1, 0]
    assert h[1] == h[3] == h[4] and len(set(h.tolist())) == 6
