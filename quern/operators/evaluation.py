"""Ranking metrics and outcome reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.urls import canonical_url

RELEVANT = 2.0


def ranking_metrics(results: DataFrame, judgments: DataFrame, k: int = 10, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(*keys, ndcg, rr, p_at_k, weak) of each judged query.

    ``results``: *keys, url, rank from 1; ``judgments``: query_id, url, grade. Gains are linear; unjudged pages
    gain 0; the reciprocal rank is of the first grade of 2 or more; the precision is over the lesser of k and
    the number returned, at least 1. Queries without results score 0. ``weak``: NDCG under 0.5.
    """
    judged = judgments.groupBy("query_id", "url").agg(F.max(F.coalesce("grade", F.lit(0.0))).cast("double").alias("g"))
    order = Window.partitionBy("query_id").orderBy(F.col("g").desc(), "url")
    ideal = judged.withColumn("i", F.row_number().over(order)).groupBy("query_id").agg(F.sum(F.when(F.col("i") <= k, F.col("g") / F.log2(F.col("i") + 1)).otherwise(0.0)).alias("ideal"))
    got = results.join(judged, ["query_id", "url"], "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
    per = got.groupBy(*keys).agg(
        F.sum(F.when(F.col("rank") <= k, F.col("g") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.min(F.when(F.col("g") >= RELEVANT, F.col("rank"))).alias("first"), F.count(F.lit(1)).alias("n"),
        F.sum(((F.col("g") >= RELEVANT) & (F.col("rank") <= k)).cast("int")).alias("hits"),
    )
    extra = [c for c in keys if c != "query_id"]
    base = ideal if not extra else ideal.crossJoin(F.broadcast(results.select(*extra).distinct()))  # a row a configuration
    j = base.join(per, list(keys), "left")
    ndcg = F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0)
    p = F.coalesce(F.col("hits"), F.lit(0)) / F.least(F.lit(k), F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)))
    return j.select(*keys, ndcg.alias("ndcg"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), p.alias("p_at_k"), (ndcg < 0.5).alias("weak"))


def mean_metrics(metrics: DataFrame, *by: str) -> DataFrame:
    """(*by, queries, ndcg, mrr, p_at_k, weak) over queries."""
    r = lambda c: F.round(F.avg(c), 6)
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), r("ndcg").alias("ndcg"), r("rr").alias("mrr"), r("p_at_k").alias("p_at_k"), F.sum(F.col("weak").cast("long")).alias("weak"))


def outcomes(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, kind, outcome) of navigational cases: hit, hit@3, wrong or silent, under canonical addresses.

    ``answers``: case_id, url, rank; ``cases``: case_id, kind, gold.
    """
    a = answers.select("case_id", canonical_url(F.col("url")).alias("c"), "rank")
    j = cases.select("case_id", "kind", canonical_url(F.col("gold")).alias("gold")).join(a, "case_id", "left")
    best = j.groupBy("case_id", "kind").agg(F.count("rank").alias("n"), F.min(F.when(F.col("c") == F.col("gold"), F.col("rank"))).alias("at"))
    out = F.when(F.col("n") == 0, "silent").when(F.col("at") == 1, "hit").when(F.col("at") <= 3, "hit@3").otherwise("wrong")
    return best.select("case_id", "kind", out.alias("outcome"))


def outcome_report(out: DataFrame) -> DataFrame:
    """(kind, cases, hits, success_1, success_3, wrong, silent) by kind."""
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    o = F.col("outcome")
    return out.groupBy("kind").agg(
        F.count(F.lit(1)).alias("cases"), F.sum((o == "hit").cast("long")).alias("hits"), share(o == "hit").alias("success_1"),
        share(o.isin("hit", "hit@3")).alias("success_3"), share(o == "wrong").alias("wrong"), share(o == "silent").alias("silent"),
    )


def latency_report(times: DataFrame, column: str) -> DataFrame:
    """(n, median, p90) of the positive values: the elements at floor(n / 2) and floor(0.9 n), counted from 0."""
    from quern.operators.ordered import running_sums

    some = times.where(F.col(column) > 0).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    placed = running_sums(some, [F.col("v")], {"upto": F.col("c")})
    n = some.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    j = placed.crossJoin(F.broadcast(n))  # one row
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col("v")))
    return j.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), at(0.5).alias("median"), at(0.9).alias("p90"))


def local_suite(results: DataFrame, cases: DataFrame) -> DataFrame:
    """(expect, cases, passed): how many local queries behave as expected.

    ``cases``: query_id, q, expect (local, place, named or decline); ``results``: query_id, name, brand, place,
    kind, rank. local: something is found; place: the place is resolved too; named: a word of the query over
    two characters stands in a name or brand; decline: nothing is found, or the place is a country or state.
    """
    words = F.filter(F.split(F.lower("q"), r"[^\p{L}\p{M}\p{N}]+"), lambda w: (F.length(w) > 2) & ~w.isin("near", "nearest", "closest", "the"))
    j = cases.withColumn("ws", words).join(results, "query_id", "left")
    hay = F.lower(F.concat_ws(" ", "name", "brand"))
    per = j.groupBy("query_id", "expect").agg(
        F.count("rank").alias("n"), F.max("place").alias("place"), F.max(F.col("kind").isin("country", "state")).alias("broad"), F.max(F.exists("ws", lambda w: F.contains(hay, w))).alias("named")
    )
    some = F.col("n") > 0
    ok = F.when(F.col("expect") == "decline", ~some | F.coalesce("broad", F.lit(False))).when(F.col("expect") == "place", some & F.col("place").isNotNull()).when(F.col("expect") == "named", some & F.coalesce("named", F.lit(False))).otherwise(some)
    return per.groupBy("expect").agg(F.count(F.lit(1)).alias("cases"), F.sum(ok.cast("long")).alias("passed"))
