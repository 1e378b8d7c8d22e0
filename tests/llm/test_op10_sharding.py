from collections import Counter, defaultdict

import duckdb
import numpy as np

from gneiss.llm import op10_sharding as S


def clusters(n=40, size=25, id_of=lambda i: i):
    r = np.random.default_rng(0)
    rows = []
    for i in range(n * size):
        c = i % n
        lines = [f"shared line of cluster number {c} variant {v}" for v in r.choice(6, 2, replace=False)]
        rows.append((id_of(i), "\n".join([f"a line of its own for document {i}", *lines, *([HOT] if i % 3 == 0 else [])])))
    return rows


HOT = "a line that a third of all documents have"


def by_sql(rows, p):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return dict(con.execute(S.oracle(p)).fetchall())


def by_hand(rows, p):
    """The same rule over plain dictionaries."""
    ids = sorted({i for i, _ in rows if i is not None})
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(line) >= p.min_chars:
                holders[line].add(i)
    lines = defaultdict(list)
    for line, who in holders.items():
        for i in who if len(who) > 1 else ():
            lines[i].append(line)
    h = {i: ((i % S.LOW) * S.MULT + (i // S.LOW % S.MOD) * S.MULT_HIGH) % S.MOD for i in ids}
    label = {i: h[i] * p.shards // S.MOD for i in ids}
    for step in range(p.rounds):
        wish = defaultdict(list)
        for i in ids:
            if (h[i] // 65536 + step) % 2:
                continue
            votes = Counter(label[j] for line in lines[i] for j in holders[line] if j != i)
            if votes:
                to = max(votes, key=lambda s: (votes[s], -s))
                if votes[to] > votes[label[i]]:
                    wish[label[i], to].append((-(votes[to] - votes[label[i]]).bit_length(), h[i], i))
        size, used, new = Counter(label.values()), Counter(), {}
        for a, b in sorted(wish):
            even = min(len(wish[a, b]), len(wish.get((b, a), ())))
            extra = len(wish[a, b]) - even
            room = max(0, len(ids) * (100 + p.slack) // (100 * p.shards) - size[b])
            quota = even + max(0, min(extra, room - used[b]))
            used[b] += extra
            new |= {i: b for *_, i in sorted(wish[a, b])[:quota]}
        label |= new
    return label


def test_equals_sql_and_brings_neighbours_together(docs, spark):
    p = S.ShardParams(shards=8, rounds=6)
    for id_of in (lambda i: i, lambda i: (i - 500) * (1 << 53) + i):
        rows = clusters(id_of=id_of)
        x = docs(rows)
        got = {r.doc_id: r.shard for r in S.shard(x, p).collect()}
        assert got == by_sql(rows, p) == by_hand(rows, p)
        size = Counter(got.values())
        assert len(got) == len(rows) and max(size.values()) <= len(rows) / 8 * 1.05 + 30
        inc = S.groups(x, p)
        labels = spark.createDataFrame(list(got.items()), "doc_id long, shard int")
        before = S.first_shards(x.selectExpr("doc_id AS id"), p).withColumnRenamed("id", "doc_id")
        cut = lambda t: S.cut_weight(t, inc).first()
        assert cut(labels).weight == cut(before).weight
        inside = lambda t: cut(t).weight - cut(t).cut
        assert inside(labels) > 1.3 * inside(before)


def test_a_large_group_of_copies_comes_together(docs):
    same = "\n".join(f"line {k} of a text that many have" for k in range(4))
    rows = [(i << 35, same) if i % 10 == 0 else (i << 35, f"document {i} has a line of its own") for i in range(1500)]
    got = {r.doc_id: r.shard for r in S.shard(docs(rows), S.ShardParams(shards=5, slack=60)).collect()}
    assert got == by_hand(rows, S.ShardParams(shards=5, slack=60))
    assert Counter(s for i, s in got.items() if (i >> 35) % 10 == 0).most_common(1)[0][1] > 120


def test_groups_by_hand(docs):
    a, b, c = "first line that is long enough", "second line that is long enough", "third line that is long enough"
    got = {}
    for r in S.groups(docs([(1, f"{a}\n{b}\n{a}"), (2, f"{b}\n{a}"), (5, c), (9, f"{c}\nshort"), (1 << 62, c), (7, "short"), (11, "short"), (12, "a line that only one document has")])).collect():
        got.setdefault((r.grp, r.weight), set()).add(r.id)
    assert sorted((w, sorted(x)) for (_, w), x in got.items()) == [(1, [5, 9, 1 << 62]), (2, [1, 2])]


def test_any_ids(docs):
    line = "a line that all these documents have"
    far = [-(1 << 63), -(1 << 62), -(1 << 40), -3_500_000_000, -1, 0, 1, 3_500_000_000, 1 << 31, 1 << 40, 1 << 62, (1 << 63) - 1]
    rows, p = [(i, line) for i in far], S.ShardParams(shards=3)
    got = {r.doc_id: r.shard for r in S.shard(docs(rows), p).collect()}
    assert got == by_sql(rows, p) == by_hand(rows, p) and len(got) == len(far)


def test_hash_is_even(spark):
    for ids in (spark.range(20_000), spark.range(20_000).selectExpr("id * (1L << 40) - (1L << 62) AS id"), spark.range(20_000).selectExpr("xxhash64(id) AS id")):
        n = [r["count"] for r in S.first_shards(ids, S.ShardParams()).groupBy("shard").count().collect()]
        assert len(n) == 16 and max(n) < 1.2 * 20_000 / 16


def test_edges(docs):
    long = "this line is certainly long enough"
    x = docs([(1, long), (1, long), (2, long), (None, long), (3, None), (4, ""), (-5, "x" * 200_000)]).withColumnRenamed("lang", "shard").withColumnRenamed("source", "id")
    got = S.shard(x, S.ShardParams(shards=2, rounds=2)).collect()
    assert sorted(r.doc_id for r in got) == [-5, 1, 2, 3, 4] and {r.shard for r in got} <= {0, 1}
    assert S.shard(docs([])).count() == 0
