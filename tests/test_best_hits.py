"""The best hits of many queries against all hits of all queries."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import best_hits, ranking
from quern.operators.signals import latest_pages
from quern.plans import ranking_queries
from quern.session import read_table

COMMON = ["lake", "garden", "gardens", "street", "lamp", "lamps"]
PAGES, QUERIES = 400, 60


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Pages of which most hold some common words, some a rare one; captures, copies, NULLs and pages without signals."""
    r, d = random.Random(3), str(tmp_path_factory.mktemp("corpus"))
    words = lambda n: " ".join(r.choice([*COMMON, "the", "of", "Old", "x&y", f"n{r.randrange(40)}"]) for _ in range(n))
    pages, signals = [], []
    for i in range(PAGES):
        url = f"https://site{i % 30}.example/{r.choice(['lake', 'lamp', 'a'])}/p{i}"
        body = words(r.randrange(5, 60)) if i % 17 else None
        pages.append((i, url, words(3) if i % 13 else None, body, 100, 200))
        if i % 5 == 0:  # an older capture, and one that failed
            pages += [(PAGES + i, url, "lake lake lake", "lamp", 50, 200), (2 * PAGES + i, url, "street", "street", 200, 404)]
        if i % 7 == 0:  # the same page at another address
            pages.append((3 * PAGES + i, url.replace("https", "http"), *pages[-1][2:4], 100, 200))
        if i % 3:
            signals.append((url, words(2) if i % 4 else None, r.random() / 100 if i % 11 else float("nan"), r.choice([0.1, 0.9, 1.0, float("nan")]), r.randrange(20)))
    asked = [f"{r.choice(['n1', 'n2', 'n3', 'zzz', 'lake', 'street'])} {r.choice(COMMON)} {r.choice(COMMON)}" for _ in range(QUERIES)] + ["", "street lamp", "nowhere"]
    judged = [(q, t, p[1], float(r.randrange(4))) for q, t in enumerate(asked) for p in r.sample(pages, 5)]
    for name, rows, types in (
        ("crawled_pages", pages, "page_id long, url string, title string, body_text string, crawled_at_unix long, status int"),
        ("page_signals", signals, "url string, anchor_text string, pagerank double, quality double, inbound_domains long"),
        ("judgments", judged, "query_id long, query_text string, url string, grade double"),
    ):
        spark.createDataFrame(rows, types).repartition(3).write.parquet(f"{d}/{name}.parquet")
    return d


def all_hits(spark, d, stem):
    s = read_table(spark, d, "page_signals").groupBy("url").agg(F.max("anchor_text").alias("anchor"))
    p = latest_pages(read_table(spark, d, "crawled_pages")).join(s, "url", "left").select(F.col("url").alias("doc"), "title", "anchor", "url", F.col("body_text").alias("body"))
    postings, lengths = ranking.build_index(p, stem)
    terms = ranking.query_terms(read_table(spark, d, "judgments").groupBy("query_id").agg(F.max("query_text").alias("query_text")), stem)
    return ranking.bm25(postings, lengths, p.count(), terms).withColumn("score", F.round("score", 9))


def best(hits, k):
    return sorted((r.query_id, r["rank"], r.doc, round(r.score, 6), r.strict) for r in ranking.top_k(hits.withColumn("score", F.round("score", 9)), k).collect())


@pytest.mark.parametrize(("stem", "common"), [(False, 20), (True, 20), (False, 10**6), (False, 0)])
def test_best_hits_are_those_of_all_hits(spark, corpus, monkeypatch, stem, common):
    monkeypatch.setattr(best_hits, "COMMON_DOCS", common)
    monkeypatch.setattr(best_hits, "PAIRS", 50)  # pairs come in blocks
    some, every = ranking_queries._scored(spark, corpus, stem), all_hits(spark, corpus, stem)
    assert best(some, 10) == best(every, 10)
    if common == 20:  # not all hits of all queries
        assert some.count() < every.count() / 3


@pytest.mark.parametrize("configs", [[("default", ranking.Weights())], ranking.ablations(), ranking.weight_grid(None)], ids=["blend", "ablation", "sweep"])
def test_blended_best_are_those_of_all_hits(spark, corpus, monkeypatch, configs):
    monkeypatch.setattr(best_hits, "COMMON_DOCS", 20)
    some, median = ranking_queries._hits(spark, corpus, [w for _, w in configs])
    every = all_hits(spark, corpus, False).withColumnRenamed("doc", "url").join(ranking_queries._signals(spark, corpus), "url", "left")
    w = Window.partitionBy("config", "query_id").orderBy(F.col("b").desc(), "url")

    def top(hits):
        b = ranking.blend_configs(hits, median, configs).withColumn("b", F.round("blended", 6))
        return sorted(map(tuple, b.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("config", "query_id", "rank", "url", "b").collect()))

    assert top(some) == top(every)
    assert some.count() < every.count()


def test_front_keeps_all_that_may_be_best():
    import numpy as np

    r = np.random.default_rng(5)
    for n, digits in ((3, 6), (500, 6), (2000, 1)):
        x, y = np.round(r.random(n), digits), np.round(r.random(n) * r.integers(0, 2), digits)
        keep = best_hits.front(x, y, 5, 1e-3, 1e-6)
        for a in (0.01, 0.3, 1.0, 7.0):
            f = a * x + y
            assert keep[np.sort(f)[::-1][min(5, n) - 1] + 1e-9 < f].all()
    assert keep.sum() < n / 2


def test_snippets_of_the_best_page(spark, corpus, monkeypatch):
    monkeypatch.setattr(best_hits, "COMMON_DOCS", 20)
    top = {r.query_id: r.doc for r in ranking.top_k(all_hits(spark, corpus, False), 1).collect()}
    df = ranking_queries.snippets(spark, corpus)
    assert {r.query_id: r.url for r in df.collect()} == top
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    window = plan.index("Window")
    assert "LeftSemi" in plan[window:]  # texts of other pages are left out before they are moved


def test_metrics_of_each_query(spark, corpus, monkeypatch):
    monkeypatch.setattr(best_hits, "COMMON_DOCS", 20)
    from quern.operators.evaluation import ranking_metrics

    r = ranking.top_k(all_hits(spark, corpus, False), 10).withColumnRenamed("doc", "url")
    want = ranking_metrics(r, read_table(spark, corpus, "judgments"), 10)
    rounded = lambda df: sorted((x.query_id, round(x.ndcg, 6), round(x.rr, 6), round(x.p_at_k, 6), x.weak) for x in df.collect())
    assert rounded(ranking_queries.ndcg_mrr_p10(spark, corpus)) == rounded(want)
