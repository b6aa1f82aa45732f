"""Problem 3: one ranking from several differently scaled scores.

Outranking net flow. Each score becomes its mid-rank, so that no scale or outlier counts. Of two items the
one with the higher rank is preferred by a linear preference function: 0 up to an indifference share q of
the items between them, 1 from a preference share p on. An item's flow for a score is its mean preference
over all others minus theirs over it; flows are summed by weight. All pairs are covered exactly without
forming one: with linear preferences the sums over all other items follow from running counts and running
sums of ranks at the thresholds. Ranks are doubled so that mid-ranks, thresholds and sums are whole
numbers, and the result does not depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.ordered import running_sums
from quern.session import read_table, stored

INDIFFERENT, PREFERRED = 0.02, 0.40  # q and p as shares of the items
#: Weights of the scores of page_signals.
WEIGHTS = {"pagerank": 0.35, "quality": 0.40, "inbound_domains": 0.25}


def _score(c: Column) -> Column:
    """As double; NaN and infinite values count as missing."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def score_flows(scores: DataFrame, q: float = INDIFFERENT, p: float = PREFERRED) -> DataFrame:
    """(score, value, flow): net flow in [-1, 1] of each distinct value of each score.

    ``scores`` has (score, value), one row an item, without NULLs. Ties share a flow; a score with one item
    has flow 0.
    """
    distinct = scores.groupBy("score", "value").agg(F.count(F.lit(1)).alias("c"))
    order = [F.col("score"), F.col("value")]
    ranked = running_sums(distinct, order, {"upto": F.col("c")})
    totals = distinct.groupBy("score").agg(F.sum("c").alias("n"))
    # a row a score; items of the scores before come off the running count
    before = totals.select(F.col("score").alias("s2"), F.col("n").alias("n2"))
    base = totals.join(F.broadcast(before), F.col("s2") < F.col("score"), "left").groupBy("score", "n").agg(F.coalesce(F.sum("n2"), F.lit(0)).alias("base"))
    # doubled mid-rank: 2 * (items below) + ties + 1
    r = ranked.join(F.broadcast(base), "score").select("score", "value", "c", "n", (2 * (F.col("upto") - F.col("base") - F.col("c")) + F.col("c") + 1).alias("r"))
    r = stored(r)
    low, high = F.floor(F.col("n") * 2 * q).cast("long"), F.greatest(F.floor(F.col("n") * 2 * p).cast("long"), F.floor(F.col("n") * 2 * q).cast("long") + 1)
    # running counts and rank sums at the item's rank minus and plus each threshold
    big = lambda c: c.cast("decimal(38,0)")
    points = r.select("score", F.col("r").alias("x"), F.lit(1).alias("late"), F.col("value"), F.lit(0).alias("what"), F.col("c"), big(F.col("c") * F.col("r")).alias("cr"))
    asked = r.select("score", "value", F.explode(F.array(*(
        F.struct(x.alias("x"), late.alias("late"), F.lit(k).alias("what")) for k, (x, late) in enumerate([
            (F.col("r") - low, F.lit(0)), (F.col("r") - high, F.lit(2)), (F.col("r") + low, F.lit(2)), (F.col("r") + high, F.lit(0)),
        ], 1)
    ))).alias("a"))
    # sums over ranks < r-q, <= r-p, <= r+q, < r+p
    asked = asked.select("score", F.col("a.x").alias("x"), F.col("a.late").alias("late"), "value", F.col("a.what").alias("what"), F.lit(0).cast("long").alias("c"), big(F.lit(0)).alias("cr"))
    every = points.union(asked)
    summed = running_sums(every, [F.col("score"), F.col("x"), F.col("late"), F.col("what"), F.col("value")], {"cc": F.col("c"), "ss": F.col("cr")}).where("what > 0")
    at = summed.groupBy("score", "value").agg(*(F.max(F.when(F.col("what") == k, F.col(s))).alias(f"{s}{k}") for k in (1, 2, 3, 4) for s in ("cc", "ss")))
    whole = r.groupBy("score").agg(F.sum(big(F.col("c") * F.col("r"))).alias("rsum"))
    olds = before.select("s2", "n2")
    before_sums = whole.select(F.col("score").alias("s2"), F.col("rsum").alias("r2"))
    start = whole.join(F.broadcast(before_sums), F.col("s2") < F.col("score"), "left").groupBy("score", "rsum").agg(F.coalesce(F.sum("r2"), big(F.lit(0))).alias("rbase"))
    del olds
    j = r.join(at, ["score", "value"]).join(F.broadcast(base.select("score", "base")), "score").join(F.broadcast(start), "score")
    d = (high - low).cast("double")
    num = lambda c: c.cast("double")
    # lower items: within (r-p, r-q) the preference rises from 0 at q to 1 at p
    n1, n2 = F.col("cc1") - F.col("base"), F.col("cc2") - F.col("base")
    s1, s2 = F.col("ss1") - F.col("rbase"), F.col("ss2") - F.col("rbase")
    plus = num(n2) + (num(big(n1 - n2) * big(F.col("r") - low)) - num(s1 - s2)) / d
    n3, n4 = F.col("cc3") - F.col("base"), F.col("cc4") - F.col("base")
    s3, s4 = F.col("ss3") - F.col("rbase"), F.col("ss4") - F.col("rbase")
    minus = num(F.col("n") - n4) + (num(s4 - s3) - num(big(n4 - n3) * big(F.col("r") + low))) / d
    flow = F.when(F.col("n") > 1, (plus - minus) / (F.col("n") - 1)).otherwise(0.0)
    return j.select("score", "value", flow.alias("flow"))


def net_flow(items: DataFrame, key: str, weights: Mapping[str, float], q: float = INDIFFERENT, p: float = PREFERRED) -> DataFrame:
    """(key, net_flow, place): the items in one order, the best at place 1.

    An item that occurs several times takes the highest of each of its scores. A missing score (NULL, NaN,
    infinite) is neutral: it adds 0, and the item is no opponent there. Equal net flows are ordered by key.
    Rows without key are left out; empty in, empty out.
    """
    total = float(sum(weights.values()))
    one = items.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(*(F.max(_score(F.col(s))).alias(s) for s in weights))
    one = stored(one)
    long = one.select("k", F.explode(F.array(*(F.struct(F.lit(s).alias("score"), F.col(s).alias("value")) for s in weights))).alias("x")).select("k", "x.score", "x.value").where(F.col("value").isNotNull())
    flows = stored(score_flows(long.select("score", "value"), q, p))
    weight = F.create_map(*(F.lit(x) for s, w in weights.items() for x in (s, w / total)))
    summed = long.join(flows, ["score", "value"]).groupBy("k").agg(*(F.max(F.when(F.col("score") == s, F.col("flow") * weight[F.lit(s)])).alias(f"f_{s}") for s in weights))
    net = sum((F.coalesce(F.col(f"f_{s}"), F.lit(0.0)) for s in weights), F.lit(0.0))
    ordered = one.select("k").join(summed, "k", "left").select("k", F.round(net, 9).alias("net_flow"))
    placed = running_sums(ordered, [F.col("net_flow").desc(), F.col("k")], {}, number="place")
    return placed.select(F.col("k").alias(key), "net_flow", "place")


def ndcg(ranking: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """(queries, ndcg): mean NDCG of ranking each query's judged pages by place; unranked pages stand last."""
    from pyspark.sql import Window

    judged = judgments.where(F.col("query_id").isNotNull() & F.col("url").isNotNull()).groupBy("query_id", "url").agg(F.max(F.coalesce("grade", F.lit(0.0))).cast("double").alias("g"))
    j = judged.join(ranking.select("url", "place"), "url", "left")
    by = lambda *o: Window.partitionBy("query_id").orderBy(*o)
    r = j.withColumn("r", F.row_number().over(by(F.col("place").asc_nulls_last(), "url"))).withColumn("i", F.row_number().over(by(F.col("g").desc(), "url")))
    gain = lambda c: F.sum(F.when(F.col(c) <= k, F.col("g") / F.log2(F.col(c) + 1)).otherwise(0.0))
    per = r.groupBy("query_id").agg(gain("r").alias("dcg"), gain("i").alias("best"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0)), 6).alias("ndcg"))


def p3_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of page_signals in one order."""
    return net_flow(read_table(spark, sf_dir, "page_signals").select("url", *WEIGHTS), "url", WEIGHTS)


def p3_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well that order, and each score's own, agrees with the judgments."""
    signals = read_table(spark, sf_dir, "page_signals").select("url", *WEIGHTS)
    judged = read_table(spark, sf_dir, "judgments")
    out = ndcg(net_flow(signals, "url", WEIGHTS), judged).select(F.lit("net_flow").alias("ranking"), "queries", "ndcg")
    for s in WEIGHTS:
        alone = signals.where(F.col("url").isNotNull()).groupBy("url").agg(F.max(_score(F.col(s))).alias("v"))
        # places may tie here: the score itself, descending, stands for the place
        out = out.union(ndcg(alone.select("url", (-F.col("v")).alias("place")), judged).select(F.lit(s), "queries", "ndcg"))
    return out


QUERIES = {"p3_rank": p3_rank, "p3_ndcg": p3_ndcg}

_PAIR = """greatest(0.0, least(1.0, (a.r - b.r - floor(n.n * 2 * 0.02)) / greatest(1, floor(n.n * 2 * 0.4) - floor(n.n * 2 * 0.02))))"""
_FLOW = " UNION ALL ".join(
    f"""SELECT a.url, {w / sum(WEIGHTS.values())!r} * sum({_PAIR} - {_PAIR.replace('a.r - b.r', 'b.r - a.r')}) / max(n.n - 1) AS f
FROM r_{s} a, r_{s} b, (SELECT count(*) AS n FROM r_{s}) n WHERE a.url <> b.url GROUP BY a.url"""
    for s, w in WEIGHTS.items()
)
ORACLE = {
    "p3_rank": "WITH one AS (SELECT url, "
    + ", ".join(f"max(CASE WHEN isnan(CAST({s} AS DOUBLE)) OR isinf(CAST({s} AS DOUBLE)) THEN NULL ELSE CAST({s} AS DOUBLE) END) AS {s}" for s in WEIGHTS)
    + " FROM page_signals WHERE url IS NOT NULL GROUP BY url),\n"
    + ",\n".join(
        f"r_{s} AS (SELECT url, 2 * (rank() OVER (ORDER BY {s}) - 1) + count(*) OVER (PARTITION BY {s}) + 1 AS r FROM one WHERE {s} IS NOT NULL)"
        for s in WEIGHTS
    )
    + f""",
flows AS ({_FLOW}),
net AS (SELECT one.url, round(coalesce(sum(f), 0.0), 9) AS net_flow FROM one LEFT JOIN flows USING (url) GROUP BY one.url)
SELECT url, net_flow, row_number() OVER (ORDER BY net_flow DESC, url) AS place FROM net
""",
}
