from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gneiss.llm import op02_mcd as M
from gneiss.llm.common import string_parts

PROSE = "The quick brown fox and the lazy dog went over to the other side of hill number {} where they met {} more friends. "


def prose(i, n=12):
    r = np.random.default_rng(i)
    return "".join(PROSE.format("".join(r.choice(list("abcdefghij"), 5)), "".join(r.choice(list("klmnopq"), 4))) for _ in range(n + i % 5))


JUNK = ["abc$$$ the%%% def### of*** " * 120, "BUY NOW!! " * 200, "word " * 500, "1234567890 " * 150]


def table(docs, extra=()):
    rows = [(i, prose(i), "en", "a", 0) for i in range(90)] + [(100 + i, t, "en", "a", 0) for i, t in enumerate(JUNK)]
    return docs([*rows, *extra])


def test_rejects_junk_and_keeps_prose(docs):
    got = {r.doc_id for r in M.keep_inliers(table(docs)).select("doc_id").collect()}
    assert got >= set(range(90)) and not got & {100, 101, 102, 103}


def test_statistics_by_hand():
    texts = ["Ab ab, 12\n", "", "É é", "a" * 5000]
    x, has = M.statistics(*string_parts(pa.array(texts)))
    assert has.tolist() == [True, False, True, True]
    t, w, c = texts[0], 3 + M.PRIOR_WORDS, 10 + M.PRIOR_CHARS
    want = np.arcsin(np.sqrt([(1 + 0.02 * M.PRIOR_CHARS) / c, (1 + 0.012 * M.PRIOR_CHARS) / c, 2 / c]))
    assert np.abs(x[0, 1:4] / M.ONE - want).max() < 1e-3
    assert abs(x[0, 6] / M.ONE - np.arcsin(np.sqrt(1 / w))) < 1e-3  # "ab" follows "Ab"
    assert abs(x[2, 2] / M.ONE - np.arcsin(np.sqrt((1 + 0.012 * M.PRIOR_CHARS) / (3 + M.PRIOR_CHARS)))) < 1e-3


def test_determinant_is_near_the_least_of_all_subsets(spark, docs):
    """Against every subset of h vectors of a small group."""
    rows = [(i, prose(i, 2), "en", "a", 0) for i in range(11)] + [(20, JUNK[0], "en", "a", 0), (21, JUNK[1], "en", "a", 0)]
    p = M.McdParams(min_group=5, support=0.75, steps=8)
    x = docs(rows)
    v = np.array([r.v for r in x.select(M._vectors("text").alias("v")).collect()]) / M.ONE
    h = int(np.ceil(len(v) * p.support))

    def det(i):
        return np.linalg.slogdet(np.cov(v[list(i)].T, bias=True) + np.diag(M.FLOOR**2))[1]

    best = min(map(det, combinations(range(len(v)), h)))
    low = root(M.fit(M.vectors(x, p), p).first().m)[1]
    have = -2 * np.log(np.abs(np.diag(low))).sum() - M.P * np.log(M.consistency(p.support, M.P))
    assert best - 1e-6 <= have <= best + 0.35


def root(m):
    low = np.zeros((M.P, M.P))
    for (i, j), a in zip(M._PAIRS, m[M.P :]):
        low[i, j] = a
    return np.array(m[: M.P]), low


def test_distance_is_mahalanobis(docs):
    x = table(docs)
    mu, low = root(M.fit(M.vectors(x)).first().m)
    got = M.mahalanobis(x).select("d2", M._vectors("text").alias("v")).collect()
    for r in got:
        assert abs(np.sum((low @ (np.array(r.v) / M.ONE - mu)) ** 2) - r.d2) < 1e-6 * max(1, r.d2)


def plain_mcd(v, p, seed=0, starts=200):
    """By random subsets of P + 1 vectors, concentrated with exactly h vectors until they stay: the distances."""
    r, h = np.random.default_rng(seed), int(np.ceil(len(v) * p.support))
    best = None
    for _ in range(starts):
        at = r.choice(len(v), M.P + 1, replace=False)
        for _ in range(100):
            mu, c = v[at].mean(0), np.cov(v[at].T, bias=True) + np.diag(M.FLOOR**2)
            d2 = np.einsum("ij,ij->i", v - mu, np.linalg.solve(c, (v - mu).T).T)
            new = np.sort(np.argsort(d2, kind="stable")[:h])
            if np.array_equal(new, at):
                break
            at = new
        det = np.linalg.slogdet(c)[1]
        if best is None or det < best[0]:
            best = det, d2
    return best[1] / M.consistency(p.support, M.P)


def test_kept_documents_are_those_of_a_plain_estimate(spark, docs):
    from test_pipeline import prose as other

    # three groups, one with a fifth of outliers, one small (estimated with the other small ones of its language)
    rows = [(i, prose(i, 6), "en", "a", 0) for i in range(150)] + [(200 + i, t[: 400 + 97 * i] + f" {i}", "en", "a", 0) for i, t in enumerate(JUNK * 8)]
    rows += [(300 + i, other(i), "de", "a", 0) for i in range(120)] + [(450 + i, "X9 " * (100 + i), "de", "a", 0) for i in range(6)]
    rows += [(500 + i, other(200 + i), "fr", f"s{i % 4}", 0) for i in range(100)] + [(650 + i, "q#! " * (60 + i), "fr", f"s{i % 4}", 0) for i in range(5)]
    p, x = M.McdParams(), docs(rows)
    got = {r.doc_id for r in M.keep_inliers(x, p).select("doc_id").collect()}
    v = {r.doc_id: np.array(r.v) / M.ONE for r in x.select("doc_id", M._vectors("text").alias("v")).collect()}
    want = set()
    for lang in ("en", "de", "fr"):
        ids = [r[0] for r in rows if r[2] == lang]
        d2 = plain_mcd(np.array([v[i] for i in ids]), p)
        want |= {i for i, d in zip(ids, d2) if d <= M.chi2_quantile(p.quantile, M.P)}
    assert got == want and 330 < len(got) < 371 and not got & {*range(200, 232), *range(450, 456), *range(650, 655)}


def test_groups_spread_over_batches_give_the_same(spark, docs):
    """Partial sums of many batches and partitions, and groups in any order."""
    rows = [(i, prose(i), ["en", "de", None][i % 3], f"s{i % 2}", 0) for i in range(480)] + [(1000 + i, t, "en", "s0", 0) for i, t in enumerate(JUNK)]
    one = {(r.doc_id, r.d2, r.d2_outlier) for r in M.mahalanobis(docs(rows).coalesce(1)).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        many = {(r.doc_id, r.d2, r.d2_outlier) for r in M.mahalanobis(docs(rows[::-1]).repartition(5)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert one == many and len(one) == 484


def test_chi_square():
    assert abs(M.chi2_quantile(0.95, 7) - 14.0671) < 1e-3 and abs(M.chi2_quantile(0.5, 2) - 1.38629) < 1e-4


def test_edges(spark, docs):
    extra = [(200, None, "en", "a", None), (201, "", "en", "a", 0), (202, "!!!", None, None, 0), (203, prose(3), None, None, 0), (None, prose(4), "en", "a", 0), (5, prose(5), "en", "a", 0), (204, "tiny", "xx", "y", 0), (205, "long " + prose(7) * 400, "en", "a", 0)]
    x = table(docs, extra).withColumn("mcd", F.lit(1)).withColumn("gl", F.lit(2)).withColumn("v", F.lit(3))
    got = M.keep_inliers(x)
    assert got.columns == x.columns
    ids = [r.doc_id for r in got.collect()]
    assert not {200, 201, 202} & set(ids) and {203, 204, None} <= set(ids) and ids.count(5) == 2
    assert M.keep_inliers(docs([])).count() == 0
