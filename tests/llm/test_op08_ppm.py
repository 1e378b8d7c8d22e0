import math
import os
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from oracle import SF

from gneiss.llm import op08_ppm as M
from gneiss.llm.common import string_parts


def brute(training, text, order):
    """Code lengths by walking the context tree byte by byte."""
    out = []
    for g in sorted(training):
        seen = [defaultdict(Counter) for _ in range(order + 1)]
        for t in training[g]:
            for i in range(len(t)):
                for k in range(min(i, order) + 1):
                    seen[k][t[i - k : i]][t[i]] += 1
        bits = 0
        for i in range(len(text)):
            for k in range(min(i, order), -1, -1):
                c = seen[k].get(text[i - k : i])
                if c is None:
                    continue
                n, q = sum(c.values()), len(c)
                if text[i] in c:
                    bits += round(M.ONE * math.log2((n + q) / c[text[i]]))
                    break
                bits += round(M.ONE * math.log2((n + q) / q))
            else:
                bits += 8 * M.ONE
        out.append(bits)
    return out


@pytest.mark.parametrize("order", [0, 1, 2, 4])
def test_lengths_equal_brute_force(order):
    training = {"en": [b"the cat sat on the mat", b"a", b""], "fr": ["le chat s'est assis là".encode(), b"oui"], "x": [b"q"]}
    texts = ["the chat", "", "zzz", "l", "là le the", "q" * 50, "日本"]
    with np.errstate(over="ignore"):
        got = M.Trees(training, order).lengths(*string_parts(pa.array(texts)))
    assert got.tolist() == [brute(training, t.encode(), order) for t in texts]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out_accuracy(spark):
    x = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 40")
    learn, rest = x.where("doc_id < 100"), x.where("doc_id >= 100")
    got = M.identify(rest, M.train(learn)).select("lang", "predicted").collect()
    assert np.mean([r.lang == r.predicted for r in got]) > 0.95


def test_training_is_bounded_and_whole(docs):
    rows = [(i, f"text number {i} of many", "en", "s", 0) for i in range(50)] + [(99, "ein Text", "de", "s", 0)]
    t = M.train(docs(rows), M.PpmParams(train_docs=5))
    assert t.languages == ["de", "en"]
    few = M.train(docs(rows), M.PpmParams(order=0, train_docs=5, train_bytes=50))
    sample = lambda n: M.train(docs(rows), M.PpmParams(order=0, train_docs=n))
    text = ["text number of", "ein"]
    with np.errstate(over="ignore"):
        lengths = [m.lengths(*string_parts(pa.array(text))).tolist() for m in (few, sample(2), sample(1))]
    assert lengths[0] == lengths[1] != lengths[2]  # two texts of 22 or 23 bytes
    assert int(M.Trees._count([b"ein Text"], 1)[1].sum()) == 8


def test_edges(docs):
    rows = [(1, "the cat", "en", "s", 0), (2, "le chat", "fr", "s", 0), (3, None, "en", "s", 0), (4, "", None, "s", 0), (5, "unknown 語", None, "s", 0), (1, "the cat", "en", "s", 0), (6, "the cat " * 30_000, None, "s", 0)]
    x = docs(rows).withColumnRenamed("source", "ppm").withColumnRenamed("n_chars", "Predicted")
    got = M.identify(x, M.train(x))
    assert got.columns == [*x.columns, "_predicted", "code_bits"]
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == 7 and by[1]._predicted == "en" and by[6]._predicted == "en" and by[2]._predicted == "fr"
    assert by[3]._predicted is None and by[4]._predicted is None and by[3].code_bits is None and by[5]._predicted
    none = M.identify(x, M.train(docs([])))
    assert {r._predicted for r in none.collect()} == {None}
    assert M.identify(docs([]), M.train(x)).count() == 0
    tie = M.identify(docs([(1, "zz")]), M.Trees({"b": [b"a"], "a": [b"a"]}, 2)).first()
    assert tie.predicted == "a" and tie.code_bits[0] == tie.code_bits[1]
