"""Resolving against scoring all pairs of queries and pages."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import resolver

WORDS = ["lake", "garden", "saint", "school", "brellton", "old", "lamp", "lamps", "college", "the", "dunsley", "x1"]
QUERIES = 50


def tables(spark):
    r = random.Random(11)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    urls = [f"https://{r.choice(['', 'www.', 'lamp.', 'st-'])}{r.choice(['lake', 'oldgarden', 'brellton', 'z'])}{i % 40}.{r.choice(['com', 'co.in'])}/{r.choice(['', '', 'a', 'a/b', 'a/b/c/d'])}" for i in range(300)]
    rows = [(u, text(3) if i % 9 else None, text(8) if i % 8 else None, r.choice([0.2, 0.9, 0.9, float("nan"), None])) for i, u in enumerate([*dict.fromkeys(urls), "lake garden", "mailto:old"])] + [(None, "lake garden old", "lake", 0.9)]
    asked = [(q, text(r.randrange(1, 5))) for q in range(QUERIES)] + [(QUERIES, ""), (QUERIES + 1, "zzz"), (QUERIES + 2, "lake lake old"), (QUERIES + 3, "st's garden")]
    q = spark.createDataFrame(asked, "query_id long, q string").withColumn("tokens", resolver.tokens_of(F.col("q"), F.array(F.lit("brellton"), F.lit("dunsley"))))
    return q.select("query_id", "tokens"), spark.createDataFrame(rows, "url string, title string, body string, quality double").repartition(3)


def all_pairs(queries, fetched, limit):
    pages = fetched.where("url IS NOT NULL").where(F.coalesce("quality", F.lit(1.0)) >= resolver.QUALITY_FLOOR)
    forms = F.flatten(F.transform(F.filter("tokens", lambda t: t["kind"].isin("Distinctive", "Place")), lambda t: t["forms"]))
    met = F.arrays_overlap(forms, F.concat(resolver.word_set(F.col("title")), F.split(F.coalesce(resolver.host_of(F.col("url")), F.lit("")), r"[.\-]")))
    organisation = F.exists("tokens", lambda t: t["text"].isin(resolver.ORGANISATION))
    score = resolver.match_score(F.col("tokens"), F.col("title"), F.col("url"), F.col("body")) * resolver.depth_prior(F.col("url"), organisation)
    a = resolver.front_doors(queries.crossJoin(pages).where(met).select("query_id", "url", F.round(score, 6).alias("score"))).where(F.col("score") >= resolver.ANSWER_FLOOR)
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.length("url"), "url")
    return a.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


def test_answers_are_those_of_all_pairs(spark, monkeypatch):
    queries, fetched = (t.cache() for t in tables(spark))
    rows = lambda df: sorted((r.query_id, r["rank"], r.url, r.score) for r in df.select("query_id", "rank", "url", "score").collect())
    for block, limit in ((4096, 5), (7, 2)):
        monkeypatch.setattr(resolver, "QUERY_BLOCK", block)
        got = resolver.resolve(queries, fetched, limit)
        assert rows(got) == rows(all_pairs(queries, fetched, limit))
    assert len(rows(got)) > QUERIES
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # with the numbers of the queries only: pairs with pages are no rows


def test_sites_cut_by_batches(spark):
    queries, fetched = tables(spark)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(resolver.resolve(queries, fetched))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        assert rows(resolver.resolve(queries, fetched)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_scores_are_rounded_as_sql_does(spark):
    values = [0.0690625, 0.5666666666666667, 0.1234565, 1.0, 0.0, 0.4250005]
    want = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 6).alias("v")).collect()]
    import numpy as np

    assert resolver._rounded(np.array(values)).tolist() == want


def test_no_queries_and_no_pages(spark):
    queries, fetched = tables(spark)
    assert resolver.resolve(queries.limit(0), fetched).count() == 0 == resolver.resolve(queries, fetched.where("url = ''")).count()
