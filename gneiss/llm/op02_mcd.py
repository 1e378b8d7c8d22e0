"""Operator 2: robust multivariate outliers by minimum-covariance-determinant estimates per language and source.

Each document becomes a vector of transformed text statistics. For each (lang, source) the MCD location and scatter
are found by concentration steps from two deterministic starts; documents whose squared Mahalanobis distance lies above
a chi-square quantile are rejected.

Scale: one pass over the texts writes seven small integers beside each document, so the verdict is read from that table, and the texts aren't shuffled and are met by Python once; all else works on the
vectors alone. A concentration step is two grouped aggregations (a histogram of distances, then exact integer sums of values and products of the h nearest). Each Arrow batch gives partial counts and sums
a group, so a hot group is spread over all tasks and nothing is collected on the driver but whether any group goes on. A group whose determinant no longer falls is settled and its vectors take part
no more. Models are broadcast, up to `MODELS` groups; beyond, they are joined by a shuffle. Sums of fixed-point integers don't depend on the order of rows, so a task that runs again gives the same estimates.
The h nearest are cut at a 64th of an octave of distance: the bin of the h-th stays whole.

Defined results: a null or empty text has no words and no vector: it is rejected. Null lang or source form groups of their
own. Groups with fewer than `min_group` vectors are estimated together with the other small groups of their language; if even
these are fewer, all their documents are kept (distance null). Repeated rows count and are returned as often as they occur.
An empty table gives no rows. Columns besides text, lang and source pass through untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, bounded_batches, code_points, discard, fold, free_name, materialise, span_hash, string_parts, word_spans

#: Fixed-point unit of the transformed statistics.
ONE = 1024
NAMES = ["word_len", "symbols", "upper", "digits", "diversity", "spaces", "repeats"]
#: Spread below which a statistic's variation isn't taken as a sign of anything, in the units of the transform.
FLOOR = np.array([0.04, 0.04, 0.04, 0.04, 0.03, 0.03, 0.04])
P = len(NAMES)
#: Ordinary prose that is mixed into each text's statistics.
PRIOR_WORDS, PRIOR_CHARS = 40, 250
BINS_PER_OCTAVE = 64
#: Groups whose models are broadcast: 1.2 KB each.
MODELS = 50_000


@dataclass(frozen=True)
class McdParams:
    support: float = 0.75  # share of a group's vectors on which the determinant is minimised
    quantile: float = 0.9999  # of chi-square with P degrees of freedom; beyond it a document is rejected
    min_group: int = 64
    steps: int = 30  # concentration steps at most; a group's end when its log-determinant doesn't fall by more than `settled`
    settled: float = 0.001


_KIND = np.zeros((256, 5), np.int64)  # letters' upper case, digits, white space, symbols, characters
_KIND[65:91, 0] = 1
_KIND[48:58, 1] = 1
_KIND[[9, 10, 11, 12, 13, 32], 2] = 1
_KIND[[i for i in range(33, 127) if not chr(i).isalnum()], 3] = 1
_KIND[:, 4] = 1
_KIND[0x80:0xC0, 4] = 0


def statistics(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents x P fixed-point vectors, has a vector)."""
    n = len(off) - 1
    sums = np.zeros((n, 5))
    for k in range(5):
        c = np.concatenate(([0], np.cumsum(_KIND[:, k].astype(np.int32)[raw], dtype=np.int64)))
        sums[:, k] = c[off[1:]] - c[off[:-1]]
    at, _, kind = code_points(raw)  # upper case beyond ASCII
    sums[:, 0] += np.diff(np.searchsorted(at[kind == 3], off))
    raw, off = fold(raw, off)
    starts, ends = word_spans(raw, off)
    first = np.searchsorted(starts, off)
    count = np.diff(first).astype(float)
    doc = np.repeat(np.arange(n), np.diff(first))
    ids = span_hash(raw, starts, ends) >> np.uint64(20)
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | ids)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=n).astype(float)
    again = np.zeros(len(starts))  # a word equal to the one before it
    again[1:] = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])
    again = np.bincount(doc, again, minlength=n)
    has = count > 0
    # pseudo-counts of ordinary prose: the shares of a text of a few words hardly say anything
    w, chars = count + PRIOR_WORDS, sums[:, 4] + PRIOR_CHARS
    angle = lambda x: np.arcsin(np.sqrt(np.clip(x, 0, 1)))
    x = np.stack([
        np.log(np.maximum(sums[:, 4] - sums[:, 2] - sums[:, 3] + 4.8 * PRIOR_WORDS, 1) / w),
        angle((sums[:, 3] + 0.02 * PRIOR_CHARS) / chars),
        angle((sums[:, 0] + 0.012 * PRIOR_CHARS) / chars),
        angle(sums[:, 1] / chars),
        np.log((distinct + PRIOR_WORDS) / w) / np.log(w),
        angle((sums[:, 2] + 0.17 * PRIOR_CHARS) / chars),
        angle(again / w),
    ], 1)
    return np.rint(x * ONE).astype(np.int64), has


@F.arrow_udf(T.ArrayType(T.LongType()))
def _vectors(text: pa.Array) -> pa.Array:
    raw, off = string_parts(text)
    parts = [statistics(r, o) for _, r, o in blocks(raw, off)] or [(np.zeros((0, P), np.int64), np.zeros(0, bool))]
    x, has = (np.concatenate(k) for k in zip(*parts))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, P * len(x) + 1, P), pa.int32()), pa.array(x.ravel()), mask=pa.array(~has))


def chi2_cdf(x: float, k: int) -> float:
    """By the series of the incomplete gamma function."""
    from math import exp, lgamma, log

    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    i = 1
    while term > 1e-17 * total:
        term *= z / (a + i)
        total += term
        i += 1
    return min(1.0, total * exp(a * log(z) - z - lgamma(a)))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return (low + high) / 2


def consistency(support: float, k: int) -> float:
    """Factor by which the scatter of the nearest share underestimates that of normal data."""
    return support / chi2_cdf(chi2_quantile(support, k), k + 2) if support < 1 else 1.0


_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
SIZE = P + len(_PAIRS)  # of a model: location, and the inverse of the scatter's triangular root
_MODEL = T.StructType([
    T.StructField("gl", T.StringType()), T.StructField("gs", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("m", T.ArrayType(T.DoubleType())), T.StructField("logdet", T.DoubleType()),
])


def _row(gl, gs, start, mu, scatter) -> tuple:
    low = np.linalg.cholesky(scatter)
    inv = np.linalg.inv(low)
    return gl, gs, int(start), [*(mu / ONE).tolist(), *(float(inv[i, j]) for i, j in _PAIRS)], float(2 * np.log(np.diag(low)).sum())


def _from_sums(batches):
    """Location and scatter of each group from exact sums (number, values, products), with the floor on the spread."""
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            n, x = float(r.x[0]), np.array(r.x[1:], float)
            mu = x[:P] / n
            c = np.zeros((P, P))
            for (i, j), v in zip(_PAIRS, x[P:]):
                c[i, j] = c[j, i] = v / n - mu[i] * mu[j]
            rows.append(_row(r.gl, r.gs, r.start, mu, c / ONE**2 + np.diag(FLOOR**2)))
        yield pd.DataFrame(rows, columns=_MODEL.names)


def _starts(batches):
    """From medians, MADs and the co-signs about them: a diagonal scatter and one with the signs' correlation."""
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            mu, sd = np.array(r.med, float), 1.4826 * np.array(r.mad, float) / ONE
            sd = np.sqrt(sd**2 + FLOOR**2)
            rows.append(_row(r.gl, r.gs, 0, mu, np.diag(sd**2)))
            c = np.zeros((P, P))
            for (i, j), x in zip(_PAIRS, r.x):
                c[i, j] = c[j, i] = x / r.n
            d = np.sqrt(np.maximum(np.diag(c), 1e-9))
            cor = np.where(np.eye(P) > 0, 1.0, np.sin(np.pi / 2 * np.clip(c / np.outer(d, d), -1, 1)) * 0.9)
            e, u = np.linalg.eigh(cor)
            cor = (u * np.maximum(e, 0.05)) @ u.T
            rows.append(_row(r.gl, r.gs, 1, mu, cor * np.outer(sd, sd)))
        yield pd.DataFrame(rows, columns=_MODEL.names)


def distances(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Squared Mahalanobis distance of each row of fixed-point vectors from its model."""
    x = v / ONE - m[:, :P]
    out = np.zeros(len(v))
    for i in range(P):
        y = np.zeros(len(v))
        for k, (r, j) in enumerate(_PAIRS):
            if r == i:
                y += m[:, P + k] * x[:, j]
        out += y * y
    return out


def _matrix(column, width: int) -> np.ndarray:
    """A list column without nulls, of lists of equal length."""
    return column.flatten().to_numpy().reshape(-1, width)


def _per_group(batch, x: np.ndarray):
    """Sums of the rows of x by the batch's groups (columns gl and gs): (index of a row of each group, sums). A batch with many groups costs one sort."""
    code = np.zeros(batch.num_rows, np.int64)
    for k in (0, 1):
        d = pa.compute.dictionary_encode(batch.column(k))
        code = code * len(d.dictionary) + d.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    head = np.flatnonzero(np.concatenate(([True], code[order][1:] != code[order][:-1])))
    return order[head], np.add.reduceat(x[order], head, axis=0)


def _bins(batches):
    """(gl, gs, start, bin, n): how many vectors lie at each distance from each start's model."""
    for batch in batches:
        if batch.num_rows:
            v, m = _matrix(batch.column(2), P), _matrix(batch.column(3), 2 * SIZE)
            for start in (0, 1):
                b = np.floor(np.log2(distances(v, m[:, start * SIZE : (start + 1) * SIZE]) + 1e-6) * BINS_PER_OCTAVE).astype(np.int64)
                kinds = pa.Table.from_arrays([batch.column(0), batch.column(1), pa.array(b)], names=["gl", "gs", "bin"]).group_by(["gl", "gs", "bin"]).aggregate([([], "count_all")])
                kinds = kinds.combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays(
                    [kinds.column("gl"), kinds.column("gs"), pa.array(np.full(kinds.num_rows, start, np.int32)), kinds.column("bin"), kinds.column("count_all")], names=["gl", "gs", "start", "bin", "n"]
                )


def _moments(batches):
    """(gl, gs, start, x): number and exact sums of the values and products of the vectors up to each start's last bin."""
    for batch in batches:
        if batch.num_rows:
            v, m, last = _matrix(batch.column(2), P), _matrix(batch.column(3), 2 * SIZE), _matrix(batch.column(4), 2)
            products = np.stack([np.ones(len(v), np.int64), *v.T, *(v[:, i] * v[:, j] for i, j in _PAIRS)], 1)
            for start in (0, 1):
                b = np.floor(np.log2(distances(v, m[:, start * SIZE : (start + 1) * SIZE]) + 1e-6) * BINS_PER_OCTAVE).astype(np.int64)
                at, sums = _per_group(batch, products * (b <= last[:, start])[:, None])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.full(len(at), start, np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * (SIZE + 1), pa.int32()), pa.array(sums.ravel()))],
                    names=["gl", "gs", "start", "x"],
                )


def _signs(batches):
    """(gl, gs, x): sums of the products of the signs about the medians."""
    for batch in batches:
        if batch.num_rows:
            s = np.sign(_matrix(batch.column(2), P) - _matrix(batch.column(3), P)).astype(np.int64)
            at, sums = _per_group(batch, np.stack([s[:, i] * s[:, j] for i, j in _PAIRS], 1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * len(_PAIRS), pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), lists], names=["gl", "gs", "x"])


def _summed(partial: DataFrame, keys: list[str]) -> DataFrame:
    """Partial lists x added up, element by element: (keys, x)."""
    each = partial.select(*keys, F.posexplode("x").alias("pos", "v")).groupBy(*keys, "pos").agg(F.sum("v").alias("v"))
    return each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("x")).select(*keys, F.col("x.v").alias("x"))


def _medians(x: DataFrame, value) -> DataFrame:
    """(gl, gs, n, med): number of rows and medians of the values. They are integers of a small range, so an exact percentile keeps a bounded table of counts."""
    return x.groupBy("gl", "gs").agg(F.count("*").alias("n"), F.array(*(F.percentile(value(i), F.lit(0.5)) for i in range(P))).alias("med"))


def _group_names(lang, source):
    name = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.lit("="), c))
    return name(lang), name(source)


def _small(table: DataFrame, groups: int) -> DataFrame:
    """A table of a row a group, broadcast if its size is bounded."""
    return F.broadcast(table) if groups <= MODELS else table


def _with_vectors(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """These columns of docs, with language and source as group names and the vector (null: no words), written."""
    bounded_batches(docs.sparkSession)
    gl, gs = _group_names(F.col("lang"), F.col("source"))
    return materialise(docs.select(*(F.col(c) for c in columns), gl.alias(f"{key}_gl"), gs.alias(f"{key}_gs0"), _vectors(F.col("text")).alias(f"{key}_v")), "mcd-documents")


def _grouped(whole: DataFrame, key: str, params: McdParams) -> tuple[DataFrame, DataFrame, int]:
    """((gl, gs, v) of each vector, (gl, gs0, gs): the group that stands for a source, number of the latter)."""
    x = whole.select(F.col(f"{key}_gl").alias("gl"), F.col(f"{key}_gs0").alias("gs0"), F.col(f"{key}_v").alias("v")).where("v IS NOT NULL")
    groups = x.groupBy("gl", "gs0").count().select("gl", "gs0", F.when(F.col("count") >= params.min_group, F.col("gs0")).otherwise("*").alias("gs"))
    groups = materialise(groups, "mcd-groups")
    n = groups.count()
    x = x.join(_small(groups, n), ["gl", "gs0"]).select("gl", "gs", "v")
    return materialise(x.sortWithinPartitions("gl", "gs"), "mcd-vectors"), groups, n  # a batch then holds few groups


def vectors(docs: DataFrame, params: McdParams = McdParams()) -> DataFrame:
    """(gl, gs, v) of each document with words: its group and its vector."""
    return _grouped(_with_vectors(docs, "mcd", []), "mcd", params)[0]


def fit(x: DataFrame, params: McdParams = McdParams()) -> DataFrame:
    """(gl, gs, m) of each group of vectors() that is large enough."""
    med = materialise(_medians(x, lambda i: F.col("v")[i]).where(F.col("n") >= params.min_group), "mcd-median")
    groups = med.count()
    off = x.join(_small(med.select("gl", "gs", "med"), groups), ["gl", "gs"])
    mad = _medians(off, lambda i: F.abs(F.col("v")[i] - F.col("med")[i])).select("gl", "gs", F.col("med").alias("mad"))
    signs = _summed(off.select("gl", "gs", "v", "med").mapInArrow(_signs, "gl string, gs string, x array<long>"), ["gl", "gs"])
    start = med.join(mad, ["gl", "gs"]).join(signs, ["gl", "gs"]).mapInPandas(_starts, _MODEL)
    model = materialise(start.select("gl", "gs", "start", "m", F.lit(float("inf")).alias("logdet"), F.lit(False).alias("done")), "mcd-start")
    size = med.select("gl", "gs", F.ceil(F.col("n") * params.support).alias("h"))
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("start", c))), lambda y: y[c])
    for _ in range(params.steps):
        now = model.groupBy("gl", "gs").agg(F.flatten(listed("m")).alias("m"), F.bool_and("done").alias("done")).where("NOT done").select("gl", "gs", "m")
        counts = x.join(_small(now, groups), ["gl", "gs"]).select("gl", "gs", "v", "m").mapInArrow(_bins, "gl string, gs string, start int, bin long, n long").groupBy("gl", "gs", "start", "bin").agg(F.sum("n").alias("n"))
        # the bin in which the h-th nearest lies: that bin stays whole, as ties do
        upto = F.sum("n").over(Window.partitionBy("gl", "gs", "start").orderBy("bin"))
        last = counts.withColumn("upto", upto).join(_small(size, groups), ["gl", "gs"]).where(F.col("upto") >= F.col("h")).groupBy("gl", "gs", "start").agg(F.min("bin").alias("last"))
        edge = now.join(last.groupBy("gl", "gs").agg(listed("last").alias("last")), ["gl", "gs"])
        sums = x.join(_small(edge, groups), ["gl", "gs"]).select("gl", "gs", "v", "m", "last").mapInArrow(_moments, "gl string, gs string, start int, x array<long>")
        new = _summed(sums, ["gl", "gs", "start"]).mapInPandas(_from_sums, _MODEL).select("gl", "gs", "start", F.col("m").alias("m2"), F.col("logdet").alias("l2"))
        fell = lambda by: F.coalesce(~F.col("done") & (F.col("l2") < F.col("logdet") - by), F.lit(False))
        new = model.join(new, ["gl", "gs", "start"], "left").select(
            "gl", "gs", "start", F.when(fell(0.0), F.col("m2")).otherwise(F.col("m")).alias("m"), F.when(fell(0.0), F.col("l2")).otherwise(F.col("logdet")).alias("logdet"), (~fell(params.settled)).alias("done")
        )
        new = materialise(new, "mcd-step")
        discard(model)
        model = new
        if not model.where("NOT done").limit(1).count():
            break
    best = model.groupBy("gl", "gs").agg(F.min_by("m", F.struct("logdet", "start")).alias("m"))
    scale = float(1 / np.sqrt(consistency(params.support, P)))
    # written, so that its size is known when it is joined: small, it is broadcast
    return materialise(best.select("gl", "gs", F.transform("m", lambda a, i: F.when(i < P, a).otherwise(a * F.lit(scale))).alias("m")), "mcd-model")


def _distance(v: str, m: str):
    """distances() as a column: it stays in the JVM, beside columns of any size. Null where either is."""
    x = [F.col(v)[i] / F.lit(float(ONE)) - F.col(m)[i] for i in range(P)]
    rows = [[F.col(m)[P + k] * x[j] for k, (r, j) in enumerate(_PAIRS) if r == i] for i in range(P)]
    add = lambda cols: reduce(lambda a, b: a + b, cols)
    return add([add(r) * add(r) for r in rows])


def _judged(docs: DataFrame, params: McdParams, key: str, columns: list[str]) -> DataFrame:
    """These columns of docs, with `key`_d2 and `key`_outlier."""
    whole = _with_vectors(docs, key, columns)
    x, groups, n = _grouped(whole, key, params)
    of = groups.join(_small(fit(x, params), n), ["gl", "gs"]).select(F.col("gl").alias(f"{key}_gl"), F.col("gs0").alias(f"{key}_gs0"), F.col("m").alias(f"{key}_m"))
    y = whole.join(_small(of, n), [f"{key}_gl", f"{key}_gs0"], "left").withColumn(f"{key}_d2", _distance(f"{key}_v", f"{key}_m"))
    out = F.col(f"{key}_v").isNull() | F.coalesce(F.col(f"{key}_d2") > chi2_quantile(params.quantile, P), F.lit(False))
    return y.select(*columns, f"{key}_d2", out.alias(f"{key}_outlier"))


def mahalanobis(docs: DataFrame, params: McdParams = McdParams(), name: str = "d2", columns: list[str] | None = None) -> DataFrame:
    """docs (or these of its columns), with the squared robust distance as column `name` (null: no words, or no group large enough) and `name`_outlier."""
    key, columns = free_name(docs.columns, "mcd"), docs.columns if columns is None else columns
    return _judged(docs, params, key, columns).select(*columns, F.col(f"{key}_d2").alias(name), F.col(f"{key}_outlier").alias(f"{name}_outlier"))


def keep_inliers(docs: DataFrame, params: McdParams = McdParams()) -> DataFrame:
    """The documents that aren't rejected, with docs' columns."""
    key = free_name(docs.columns, "mcd")
    return _judged(docs, params, key, docs.columns).where(f"NOT {key}_outlier").select(*docs.columns)
