import importlib
import os
import subprocess
import sys

import numpy as np
import pytest
from test_op02_mcd import JUNK

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as C  # noqa: E402

from gneiss.llm import op07_bpe as B  # noqa: E402
from gneiss.llm.common import written  # noqa: E402
from gneiss.llm.op02_mcd import keep_inliers  # noqa: E402


_R = np.random.default_rng(9)
WORDS = ["".join(_R.choice(list("etaoinshrdlu"), n)) for n in _R.integers(2, 9, 900)]


def prose(i, n=12):
    r = np.random.default_rng(i)
    return " ".join(" ".join(r.choice(WORDS, r.integers(9, 16))).capitalize() + "." for _ in range(n + i % 5 if n > 1 else 2))


def rows():
    out = [(i, prose(i), "en", "a") for i in range(100)]
    out += [(200 + i, t, "en", "a") for i, t in enumerate(JUNK)]
    out += [(300, prose(300) + "\n" + "\n".join(prose(1000 + k, 1) for k in range(4)), "en", "a"), (301, prose(301) + "\n" + "\n".join(prose(1000 + k, 1) for k in range(4)), "en", "a")]
    out += [(400, prose(5), "en", "a"), (401, prose(6).replace(prose(6).split()[7], "mountain", 1), "en", "a"), (402, "Preamble here. " + prose(900, 1) + prose(402), "en", "a")]
    return [(*r, len(r[1])) for r in out]


def test_run_equals_its_stages_by_brute_force(spark, docs, tmp_path):
    from test_op03_simhash import brute as near
    from test_op06_decontaminate import brute as leaks
    from test_op09_winnow import brute as cuts
    from test_op09_winnow import result

    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(7, prose(900, 1))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = written()
    out = C.run(spark, str(tmp_path))
    assert set(written()) - set(before) == {out.written_to}  # only the result is left
    got = {r.doc_id: r.token_ids for r in out.collect()}

    x = spark.read.parquet(f"{tmp_path}/documents.parquet")
    now = [(r.doc_id, r.text) for r in keep_inliers(x).collect()]
    assert not {i for i, _ in now} & {200, 201, 202, 203}
    now = result(now, cuts(now))
    assert 400 not in dict(now)  # nothing of an exact copy is left
    groups = near(now)
    now = [(i, t) for i, t in now if (i, i) in groups or i not in dict(groups)]
    assert 401 not in dict(now)
    bad = {d for d, *_ in leaks(now, items)}
    assert 402 in bad
    now = [(i, t) for i, t in now if i not in bad]
    assert set(got) == set(dict(now)) and set(range(90)) - set(got) == set()
    bpe = B.load(spark, B.BpeParams()).value
    for i, t in now:
        assert got[i] == bpe.encode([t])[0].tolist()


def test_stages_keep_the_columns(spark, docs, tmp_path):
    x = docs([(1, prose(1)), (2, None), (3, "")]).withColumnRenamed("source", "source").selectExpr("*", "1 AS token_ids", "2 AS id")
    spark.createDataFrame([(1, prose(900, 1))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert 4 <= len(C.STAGES) <= 5
    for name, stage in C.STAGES[:-1]:
        y = stage(spark, x, str(tmp_path))
        assert y.columns == x.columns, name
        assert stage(spark, x.limit(0), str(tmp_path)).count() == 0


def test_the_rest_does_without(tmp_path):
    """With the subpackage, its tests and the pipeline gone, the driver's module still imports."""
    root = os.path.dirname(os.path.abspath(C.__file__))
    code = f"""
import sys, importlib.abc
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, *_):
        if name.startswith("gneiss.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
sys.path.insert(0, {root!r})
import __spark_entry__ as e
assert e.queries() and e.oracle_sql() and not any(k.startswith("op") or k == "pipeline" for k in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True)


def test_every_operator_has_one_query():
    e = importlib.import_module("__spark_entry__")
    names = [k.split("_")[0] for k in e.queries() if k.startswith("op")]
    assert sorted(names) == sorted(f"op{n}" for n in range(1, 11)) and "pipeline" in e.queries()


@pytest.mark.parametrize("name", ["localCheckpoint"])
def test_lineage_is_never_cut_in_executor_memory(name):
    root = os.path.dirname(os.path.abspath(C.__file__))
    for folder, _, files in os.walk(f"{root}/gneiss"):
        for f in files:
            if f.endswith(".py"):
                assert f".{name}(" not in open(f"{folder}/{f}").read()
