"""Operator 10: sharding by balanced label propagation.

All documents that share a line are linked, each with each, once a line. Starting from shards of equal size, each round every document of the round's half asks for
the shard in which it has most links; between any two shards as many move one way as the other, the largest gains first (by their power of two), and a shard with
room below its capacity takes more. Cut edges fall, sizes stay even.

Scale: pairs are never formed. Lines held by the same documents (as those of a passage or of copies) count as one group with their number as its weight. A round counts the members of each group by shard and
brings these counts back to the members: a row a group and shard, then a sum a document, less the document itself. A group that is everywhere is counted with partial aggregation, and AQE splits
its join. Movers are ranked by a histogram over gain and hash, at most some 2^18 rows a power of two of gain; only those in the bin in which a quota ends are sorted. What is broadcast has at most
a row for each two shards. Each round's labels are written to the shared folder, and those before are deleted.

Order and ties: everything is decided by counts, then by a multiplicative hash of doc_id, then by doc_id: the result depends on the rows alone. Ids may have any value.

Defined results: a null doc_id has no shard and is left out; rows of equal doc_id are one document. Null and empty texts and documents without links keep their first shard. Lines of
fewer than `min_chars` characters link nothing. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

#: The hash takes the upper and the lower 31 bits of an id by a factor each; no product exceeds 62 bits.
LOW, MOD, MULT, MULT_HIGH = 1 << 31, (1 << 31) - 1, 1327217885, 1103515245


@dataclass(frozen=True)
class ShardParams:
    shards: int = 16
    rounds: int = 6
    slack: int = 5  # per cent by which a shard may be larger than the mean
    min_chars: int = 20

    @property
    def bins(self) -> int:
        """Of the hash, in the histogram of a pair of shards."""
        return 1 << max(0, 18 - 2 * (self.shards - 1).bit_length())


def _hash(div: str) -> str:
    """Of the column id; div is the engine's operator of whole division, used where nothing is left over."""
    low = f"(((id % {LOW}) + {LOW}) % {LOW})"
    return f"(({low} * {MULT} + ((((id - {low}) {div} {LOW}) % {MOD} + {MOD}) % {MOD}) * {MULT_HIGH}) % {MOD})"


HASH = _hash("div")


def groups(docs: DataFrame, params: ShardParams = ShardParams()) -> DataFrame:
    """(grp, id, weight): the groups of documents that have lines in common, and how many; two groups have different members."""
    lines = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), F.explode(F.split("text", "\n", -1)).alias("line"))
    lines = materialise(lines.where(F.length("line") >= params.min_chars).select("id", F.xxhash64("line").alias("line")).distinct(), "shard-lines")
    # the set of a line's documents, by its size, least member and the sum (xor) of their hashes
    held = lines.groupBy("line").agg(F.count("*").alias("n"), F.min("id").alias("m"), F.bit_xor(F.xxhash64("id")).alias("x")).where("n > 1")
    one = held.groupBy(F.xxhash64("n", "m", "x").alias("grp")).agg(F.count("*").alias("weight"), F.min("line").alias("line"))
    return lines.join(one, "line").select("grp", "id", "weight")


def first_shards(ids: DataFrame, params: ShardParams) -> DataFrame:
    """(id, shard): by the hash of the id, which is even for dense and for scattered ids alike."""
    return ids.select("id", F.expr(f"CAST({HASH} * {params.shards} div {MOD} AS INT)").alias("shard"))



def wishes(state: DataFrame, step: int) -> DataFrame:
    """(id, from, to, gain) of the documents of the round's half that have more links in another shard than in their own."""
    member = state.select("id", F.col("shard").alias("from"), F.explode("groups").alias("g")).select("id", "from", "g.grp", "g.weight")
    count = member.groupBy("grp", F.col("from").alias("to")).agg(F.count("*").alias("n"))
    links = F.col("weight") * (F.col("n") - F.when(F.col("to") == F.col("from"), 1).otherwise(0))
    half = member.where(f"({HASH} div 65536 + {step}) % 2 = 0")
    votes = half.join(count.hint("merge"), "grp").groupBy("id", "from", "to").agg(F.sum(links).alias("votes"))
    # the shard with most votes, of ties the first, and the votes for the own one
    best = F.max(F.struct("votes", (-F.col("to")).alias("neg"))).alias("best")
    wish = votes.groupBy("id", "from").agg(best, F.sum(F.when(F.col("to") == F.col("from"), F.col("votes")).otherwise(0)).alias("stay"))
    return wish.select("id", "from", (-F.col("best.neg")).alias("to"), (F.col("best.votes") - F.col("stay")).alias("gain")).where("gain > 0")


def moves(wish: DataFrame, sizes: DataFrame, total: int, params: ShardParams) -> DataFrame:
    """(id, new): the wishes within the quotas."""
    # rank: powers of two of the gain from the largest on, then the hash
    rank = f"(64 - length(bin(gain))) * {params.bins} + {HASH} div {LOW // params.bins}"
    wish = materialise(wish.withColumn("rank", F.expr(rank)), "shard-wishes")
    bins = wish.groupBy("from", "to", "rank").agg(F.count("*").alias("n"))
    bins = bins.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("from", "to").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bins = materialise(bins, "shard-bins")
    flow = bins.groupBy("from", "to").agg(F.sum("n").alias("n"))
    back = flow.select(F.col("from").alias("to"), F.col("to").alias("from"), F.col("n").alias("m"))
    even = flow.join(back, ["from", "to"], "left").withColumn("even", F.least("n", F.coalesce("m", F.lit(0))))
    # room below capacity is shared by the flows into a shard in the order of the shards they come from
    room = sizes.select(F.col("shard").alias("to"), F.greatest(F.lit(0), F.lit(total * (100 + params.slack) // (100 * params.shards)) - F.col("size")).alias("room"))
    extra = F.col("n") - F.col("even")
    taken = F.coalesce(F.sum(extra).over(Window.partitionBy("to").orderBy("from").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = even.join(room, "to").select("from", "to", (F.col("even") + F.greatest(F.lit(0), F.least(extra, F.col("room") - taken))).alias("quota"))
    # the last bin that still takes part: a row for each pair of shards at most
    last = bins.join(quota, ["from", "to"]).where("before < quota").groupBy("from", "to").agg(F.max(F.struct("rank", (F.col("quota") - F.col("before")).alias("take"))).alias("last"))
    x = wish.join(F.broadcast(last) if params.shards <= 256 else last, ["from", "to"]).where(F.col("rank") <= F.col("last.rank"))
    edge = x.where(F.col("rank") == F.col("last.rank")).withColumn("at", F.row_number().over(Window.partitionBy("from", "to").orderBy(F.expr(HASH), "id")))
    sure = x.where(F.col("rank") < F.col("last.rank")).select("id", F.col("to").alias("new"))
    return sure.unionByName(edge.where(F.col("at") <= F.col("last.take")).select("id", F.col("to").alias("new")))


def propagate(ids: DataFrame, incidence: DataFrame, params: ShardParams = ShardParams()) -> DataFrame:
    """(id, shard) of the ids (distinct), given their groups (grp, id, weight)."""
    spark = ids.sparkSession
    owned = incidence.groupBy("id").agg(F.collect_list(F.struct("grp", "weight")).alias("groups"))
    start = materialise(first_shards(ids, params).join(owned, "id", "left"), "shards")
    all_shards = spark.range(params.shards).select(F.col("id").cast("int").alias("shard"))
    state, alone = start.where("groups IS NOT NULL"), start.where("groups IS NULL").select("id", "shard")
    total, fixed, held = start.count(), materialise(alone.groupBy("shard").agg(F.count("*").alias("m")), "shard-fixed"), None
    for step in range(params.rounds):
        sizes = all_shards.join(state.groupBy("shard").agg(F.count("*").alias("n")), "shard", "left").join(fixed, "shard", "left")
        sizes = sizes.select("shard", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("size"))
        new = moves(wishes(state, step), sizes, total, params)
        state = materialise(state.join(new.hint("merge"), "id", "left").select("id", F.coalesce("new", "shard").alias("shard"), "groups"), "shards")
        discard(held)
        held = state
    return state.select("id", "shard").unionByName(alone)


def shard(docs: DataFrame, params: ShardParams = ShardParams()) -> DataFrame:
    """(doc_id, shard) of each document."""
    ids = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id")).distinct()
    return propagate(ids, groups(docs, params), params).select(F.col("id").alias("doc_id"), "shard")


def cut_weight(labels: DataFrame, incidence: DataFrame) -> DataFrame:
    """One row: weight of all links and of those between shards."""
    x = incidence.join(labels.select(F.col("doc_id").alias("id"), "shard"), "id").groupBy("grp", "weight", "shard").agg(F.count("*").alias("n"))
    x = x.groupBy("grp", "weight").agg(F.sum("n").alias("n"), F.sum(F.expr("n * (n - 1) div 2")).alias("inside"))
    whole = F.expr("n * (n - 1) div 2")
    return x.agg(F.sum(F.col("weight") * whole).alias("weight"), F.sum(F.col("weight") * (whole - F.col("inside"))).alias("cut"))


def oracle(params: ShardParams = ShardParams()) -> str:
    """The same in SQL over single lines, a set of common tables for each round."""
    h = _hash("//")
    parts = [
        f"""lines AS (SELECT DISTINCT doc_id AS id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_id IS NOT NULL) WHERE length(line) >= {params.min_chars})""",
        """held AS MATERIALIZED (SELECT id, line FROM lines WHERE line IN (SELECT line FROM lines GROUP BY line HAVING count(*) > 1))""",
        f"""l0 AS MATERIALIZED (SELECT id, {h} AS h, CAST({h} * {params.shards} // {MOD} AS INT) AS shard FROM (SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id IS NOT NULL))""",
    ]
    for k in range(params.rounds):
        parts += [
            f"""c{k} AS MATERIALIZED (SELECT line, shard AS "to", count(*) AS n FROM held JOIN l{k} USING (id) GROUP BY ALL)""",
            f"""v{k} AS (SELECT id, h, l.shard AS "from", c."to", sum(c.n - CASE WHEN c."to" = l.shard THEN 1 ELSE 0 END) AS votes FROM held JOIN l{k} l USING (id) JOIN c{k} c USING (line) WHERE (h // 65536 + {k}) % 2 = 0 GROUP BY ALL)""",
            f"""b{k} AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, "to") AS nth, sum(CASE WHEN "to" = "from" THEN votes ELSE 0 END) OVER (PARTITION BY id) AS stay FROM v{k})""",
            f"""r{k} AS MATERIALIZED (SELECT id, "from", "to", row_number() OVER (PARTITION BY "from", "to" ORDER BY length(bin(CAST(votes - stay AS BIGINT))) DESC, h, id) AS rank FROM b{k} WHERE nth = 1 AND votes > stay)""",
            f"""f{k} AS (SELECT "from", "to", count(*) AS n FROM r{k} GROUP BY ALL)""",
            f"""e{k} AS (SELECT f."from", f."to", f.n, least(f.n, coalesce(b.n, 0)) AS even FROM f{k} f LEFT JOIN f{k} b ON b."from" = f."to" AND b."to" = f."from")""",
            f"""s{k} AS (SELECT t."to", greatest(0, (SELECT count(*) FROM l{k}) * {100 + params.slack} // {100 * params.shards} - count(l.id)) AS room FROM (SELECT unnest(range({params.shards})) AS "to") t LEFT JOIN l{k} l ON l.shard = t."to" GROUP BY t."to")""",
            f"""q{k} AS (SELECT "from", "to", even + greatest(0, least(n - even, room - coalesce(sum(n - even) OVER (PARTITION BY "to" ORDER BY "from" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS quota FROM e{k} JOIN s{k} USING ("to"))""",
            f"""l{k + 1} AS MATERIALIZED (SELECT l.id, l.h, coalesce(m."to", l.shard) AS shard FROM l{k} l LEFT JOIN (SELECT r.id, r."to" FROM r{k} r JOIN q{k} q USING ("from", "to") WHERE r.rank <= q.quota) m USING (id))""",
        ]
    return "WITH " + ",\n".join(parts) + f"\nSELECT id AS doc_id, shard FROM l{params.rounds}"
