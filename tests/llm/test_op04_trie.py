import math
from collections import Counter

import duckdb
import numpy as np
import pytest
import regex

from gneiss.llm import op04_trie as L

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


@pytest.mark.parametrize("n, universe", [(0, 5), (1, 1), (1, 1 << 40), (500, 501), (3000, 1 << 33), (2000, 9000)])
def test_elias_fano(tmp_path, n, universe):
    x = np.sort(np.random.default_rng(n).choice(min(universe, 1 << 20), n, replace=False)) * max(1, universe >> 20)
    L.put(f"file://{tmp_path}", "a", L.elias_fano("x", x, universe))
    ef = L.Ef(L.get(f"file://{tmp_path}", "a"), "x")
    assert ef.get(np.arange(n)).tolist() == x.tolist()
    q = np.unique(np.concatenate((x, np.random.default_rng(1).integers(0, universe, 200))))
    at = {int(v): i for i, v in enumerate(x)}
    got = ef.find(q, np.zeros(len(q), np.int64), np.full(len(q), n))
    assert got.tolist() == [at.get(int(v), -1) for v in q]


def brute(texts, p=L.LmParams()):
    """Codes of each text by dictionaries."""
    docs = [WORD.findall((t or "").lower()) for t in texts]
    code = lambda x: min(255, max(0, math.floor(-math.log2(max(x, 1e-30)) * L.UNIT + 0.5)))
    value = lambda c: 2.0 ** (-c / L.UNIT)
    grams = lambda k: Counter(tuple(d[i : i + k]) for d in docs for i in range(len(d) - k + 1))
    count = [None, {g: c for g, c in grams(1).items() if c >= p.min_word}]
    total = sum(grams(1).values())
    prob, back = [None, {g: code(c / (total + 1)) for g, c in count[1].items()}], [None]
    unknown = code((total - sum(count[1].values()) + 1) / (total + 1))
    for k in range(2, p.order + 1):
        found = {g: c for g, c in grams(k).items() if c >= p.min_count and g[:-1] in count[k - 1] and g[1:] in count[k - 1]}
        share, left = {g: max(c - p.discount, 0) / count[k - 1][g[:-1]] for g, c in found.items()}, Counter()
        for g, s in share.items():
            left[g[:-1]] += s
        back.append({g: code(min(1, max(0, 1 - left[g]))) for g in count[k - 1]})
        prob.append({g: code(s + value(back[-1][g[:-1]]) * value(prob[-1][g[1:]])) for g, s in share.items()})
        count.append(found)
    out = []
    for d in docs:
        total = 0
        for i in range(len(d)):
            c = prob[1].get((d[i],), unknown)
            for k in range(2, min(p.order, i + 1) + 1):
                c = prob[k].get(tuple(d[i - k + 1 : i + 1]), c + back[k - 1].get(tuple(d[i - k + 1 : i]), 0))
            total += c
        out.append((len(d), total / L.UNIT))
    return out


def texts():
    r = np.random.default_rng(3)
    vocabulary = ["the", "of", "and", "a", "cat", "Été", "sat", "on", "mat", "ПРИВЕТ", "ŽENA", "Σας", *(f"w{i}" for i in range(60))]
    weight = 1 / np.arange(1, len(vocabulary) + 1)
    out = [" ".join(r.choice(vocabulary, n, p=weight / weight.sum())) for n in r.integers(1, 60, 120)]
    return [*out, None, "", "!!", "the", "new words only", out[0], out[0], out[1] * 300, "THE. of, AND", "привет — žena “the” σας", "once only, twice never"]


@pytest.mark.parametrize(
    "p",
    [
        L.LmParams(),
        L.LmParams(segment=16, part_tokens=500),  # many segments a level
        L.LmParams(segment=7, copy=True, min_count=1),  # on copies of the files, nothing pruned
        L.LmParams(order=5, segment=100, min_word=3),
        L.LmParams(order=1),
    ],
)
def test_scores_equal_brute_force(docs, p):
    x = docs(texts()).selectExpr("*", "1 AS lm", "'y' AS words", "0 AS Bits")
    model = L.train(x, p)
    assert model.startswith(L.COPY) == bool(p.copy)
    got = L.score(x, model, p.order)
    assert got.columns == [*x.columns, "n_words", "_bits", "perplexity"]
    rows = got.orderBy("doc_id").collect()
    assert [(r.n_words, r._bits) for r in rows] == brute(texts(), p)
    assert all((r.perplexity is None) == (r.n_words == 0) for r in rows)
    likely, random = L.score(docs(["the of and a", "mat w59 w3 unseen"]), model, p.order).orderBy("doc_id").collect()
    assert likely.perplexity < random.perplexity


def test_equals_sql_on_many_scripts(docs):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts())))
    want = {r[0]: r[1:] for r in con.execute("SELECT doc_id, n_words, bits FROM (" + L.oracle() + ")").fetchall()}
    x = docs(texts())
    assert {r.doc_id: (r.n_words, r.bits) for r in L.score(x, L.train(x)).collect()} == want


def test_texts_that_occur_again_score_apart(docs):
    r = np.random.default_rng(8)
    word = lambda: "".join(r.choice(list("abcdefghijklmnop"), 6))
    frequent = [word() for _ in range(300)]
    make = lambda: " ".join(word() if r.random() < 0.3 else r.choice(frequent) for _ in range(60))
    rows = [make() for _ in range(200)]
    twice = set(range(0, 200, 20))
    x = docs([*rows, *(rows[i] for i in sorted(twice))])
    bits = {r.doc_id: r.bits / r.n_words for r in L.score(x, L.train(x)).collect() if r.doc_id < 200}
    assert max(b for i, b in bits.items() if i in twice) < min(b for i, b in bits.items() if i not in twice)


def test_a_level_that_does_not_fit_is_an_error(docs, spark):
    with pytest.raises(ValueError, match="63 bits"):
        L._write_level("file:///nowhere/x", spark.createDataFrame([(1, 2)], "key long, n long"), 2, 40, 1 << 30, L.LmParams())


def test_empty_table(docs):
    assert L.score(docs([]), L.train(docs([]))).count() == 0
    assert [(r.n_words, r.bits) for r in L.score(docs(["a b", None]), L.train(docs([None, ""]))).orderBy("doc_id").collect()] == [(2, 0.0), (0, 0.0)]


def test_counts_over_several_emissions(docs, spark):
    texts = [" ".join(f"x{(i * j) % 97}" for j in range(50)) for i in range(300)]
    for parts in (1, 4, 9):
        got = L._count(docs(texts), lambda h, first: h, 1, parts, "t").where("key IS NOT NULL").groupBy().sum("n").first()[0]
        assert got == 300 * 50


def test_elias_fano_over_long_gaps():
    x = np.sort(np.concatenate((np.arange(3000), 900_000 + np.arange(3000) // 9, [2_000_000] * 5000)))
    ef = L.Ef(L.elias_fano("a", x, 2_500_000), "a")
    assert ef.get(np.arange(len(x))).tolist() == x.tolist()
    high = np.unpackbits(np.asarray(ef.high).view(np.uint8), bitorder="little")
    for kind in (0, 1):
        at = np.flatnonzero(high == kind)
        assert ef.select(np.arange(len(at)), kind).tolist() == at.tolist()
