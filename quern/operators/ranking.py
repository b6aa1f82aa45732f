"""Fielded index, BM25, signal blend, explanations, ablations, snippets; batches of queries at once."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import stem_en, tokens
from quern.functions.urls import url_to_text
from quern.operators.ordered import running_sums

K1, B = 1.2, 0.75
#: Boosts of the fields; the address is not stemmed.
BOOSTS = {"title": 2.5, "anchor": 3.0, "url": 1.5, "body": 1.0}


@dataclass(frozen=True)
class Weights:
    """Weights of the blended signals."""

    text: float = 1.0
    pagerank: float = 0.4
    quality: float = 0.2
    trust: float = 0.3


def saturate(value: Column, half: Column | float) -> Column:
    """0 for values or half points not above 0, else value / (value + half)."""
    h = half if isinstance(half, Column) else F.lit(float(half))
    return F.when((value > 0) & (h > 0), value / (value + h)).otherwise(0.0)


def stemmed(terms: DataFrame, column: str = "term") -> DataFrame:
    """Terms replaced by their stems; the stemmer sees each distinct term once."""
    table = terms.select(column).distinct().withColumn("__stem", stem_en(column))
    return terms.join(table, column).withColumn(column, F.col("__stem")).drop("__stem")


def field_tokens(docs: DataFrame) -> DataFrame:
    """(doc, field, pos, term): words of title, anchor, url and body with their positions.

    ``docs``: doc, title, anchor, url, body; NULL fields are empty.
    """
    named = {"title": F.col("title"), "anchor": F.col("anchor"), "url": url_to_text(F.coalesce("url", F.lit(""))), "body": F.col("body")}
    fields = F.array(*(F.struct(F.lit(k).alias("field"), tokens(c).alias("words")) for k, c in named.items()))
    rows = docs.select("doc", F.explode(fields).alias("f"))
    return rows.select("doc", "f.field", F.posexplode("f.words").alias("pos", "term"))


def build_index(docs: DataFrame, stem: bool = True) -> tuple[DataFrame, DataFrame]:
    """(postings(doc, field, term, tf, positions), lengths(doc, field, len)); write them as Parquet for reuse."""
    words = field_tokens(docs)
    if stem:
        words = stemmed(words.where("field <> 'url'")).select("doc", "field", "pos", "term").union(words.where("field = 'url'"))
    postings = words.groupBy("doc", "field", "term").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return postings, words.groupBy("doc", "field").agg(F.count(F.lit(1)).alias("len"))


def query_terms(queries: DataFrame, stem: bool = True) -> DataFrame:
    """(query_id, term, plain): distinct words of each query; ``plain`` is the word before stemming."""
    t = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query_text")))).alias("plain"))
    return (stemmed(t.withColumn("term", F.col("plain"))) if stem else t.withColumn("term", F.col("plain"))).select("query_id", "term", "plain").distinct()


def bm25(postings: DataFrame, lengths: DataFrame, docs: int, terms: DataFrame, boosts: Mapping[str, float] = BOOSTS) -> DataFrame:
    """(query_id, doc, score, strict): sum over fields and terms of boost * BM25.

    A query's hits are the documents with all of its terms, each in any field; if there are none, those with
    any term. ``strict`` tells which. A query without words has no hits.
    """
    asked = terms.select("query_id", F.col("plain").alias("qterm"), F.array_distinct(F.array("term", "plain")).alias("forms"))
    # the unstemmed address takes the word as typed, the other fields its stem
    wanted = terms.select("query_id", F.col("plain").alias("qterm"), F.explode(F.array(F.struct(F.lit(False).alias("u"), F.col("term").alias("term")), F.struct(F.lit(True).alias("u"), F.col("plain").alias("term")))).alias("x")).select("query_id", "qterm", "x.u", "x.term")
    vocabulary = wanted.select("u", "term").distinct()
    boost = F.create_map(*(F.lit(x) for k, v in boosts.items() for x in (k, float(v))))
    used = postings.where(boost[F.col("field")] > 0).withColumn("u", F.col("field") == "url").join(vocabulary, ["u", "term"], "left_semi").select("doc", "field", "term", "tf", "u")
    df = used.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    avg = lengths.groupBy("field").agg((F.sum("len") / F.lit(float(max(docs, 1)))).alias("avg"))
    idf = F.log(1 + (F.lit(float(docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # df: a row a field and query term; avg: a row a field
    norm = F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg"))
    part = used.join(df, ["field", "term"]).join(F.broadcast(avg), "field").join(lengths, ["doc", "field"])
    part = part.select("doc", "u", "term", (boost[F.col("field")] * idf * F.col("tf") * (K1 + 1) / norm).alias("s"))
    hits = part.join(wanted, ["u", "term"]).groupBy("query_id", "doc").agg(F.sum("s").alias("score"), F.countDistinct("qterm").alias("n"))
    count = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("m"))
    every = hits.join(count, "query_id").withColumn("all", F.col("n") == F.col("m"))
    any_strict = every.groupBy("query_id").agg(F.max("all").alias("strict"))
    return every.join(any_strict, "query_id").where(F.col("all") | ~F.col("strict")).select("query_id", "doc", "score", "strict")


def top_k(scored: DataFrame, k: int, score: str = "score", by: str = "query_id", tie: str = "doc") -> DataFrame:
    """The k best rows of each query with ``rank``; equal scores are ordered by ``tie``."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def phrase_hits(postings: DataFrame, phrases: DataFrame, field: str = "body") -> DataFrame:
    """(query_id, doc, hits): how often the words of a phrase follow each other in a field.

    ``phrases``: query_id, words (array). A word occurrence marks the start the phrase would have; a start
    that all words mark is a hit.
    """
    p = phrases.where(F.size("words") > 0).select("query_id", F.size("words").alias("m"), F.posexplode("words").alias("i", "term"))
    marks = postings.where(F.col("field") == field).join(p, "term").select("query_id", "m", "i", "doc", F.explode("positions").alias("pos"))
    starts = marks.groupBy("query_id", "doc", "m", (F.col("pos") - F.col("i")).alias("start")).agg(F.countDistinct("i").alias("n")).where("n = m")
    return starts.groupBy("query_id", "doc").agg(F.count(F.lit(1)).alias("hits"))


def upper_median(values: DataFrame, column: str) -> float:
    """The element at position floor(n / 2) of the sorted values, counted from 0; 0 without values."""
    some = values.where(F.col(column).isNotNull() & ~F.isnan(column)).select(F.col(column).cast("double").alias("v"))
    n = some.count()
    if n == 0:
        return 0.0
    counts = some.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    placed = running_sums(counts, [F.col("v")], {"upto": F.col("c")})
    return float(placed.where(F.col("upto") > n // 2).agg(F.min("v")).first()[0])


def signal_parts(median_pagerank: float) -> tuple[Column, Column, Column, Column]:
    """Parts of PageRank, trust and quality before weights, and the gate, from pagerank, inbound_domains and quality."""
    q = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(F.col("quality").cast("double"), F.lit(1.0)), F.lit(1.0))))
    pr = F.coalesce(F.nanvl(F.col("pagerank").cast("double"), F.lit(0.0)), F.lit(0.0))
    half = 4 * median_pagerank if median_pagerank > 0 else 1e-6
    trust = saturate(F.coalesce("inbound_domains", F.lit(0)).cast("double"), 8.0)
    return saturate(pr, half), trust, q, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.25 + 0.75 * q))


def blend(hits: DataFrame, median_pagerank: float, weights: Weights = Weights(), by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Adds text, pagerank_boost, trust_boost, quality_boost, gate and blended to scored hits.

    ``hits``: score, pagerank, quality, inbound_domains. The text score is taken against the query's best;
    the sum of the parts is multiplied by a gate of 0.25 to 1 that falls with quality. Missing signals count
    as pagerank 0, quality 1, no domains.
    """
    best = F.max("score").over(Window.partitionBy(*by))
    pr, trust, q, gate = signal_parts(median_pagerank)
    parts = hits.withColumn("text", F.when(best > 0, F.col("score") / best).otherwise(0.0)).select(
        "*", (weights.pagerank * pr).alias("pagerank_boost"), (weights.trust * trust).alias("trust_boost"), (weights.quality * q).alias("quality_boost"), gate.alias("gate")
    )
    total = (weights.text * F.col("text") + F.col("pagerank_boost") + F.col("quality_boost") + F.col("trust_boost")) * F.col("gate")
    return parts.withColumn("blended", total)


def weight_grid(spark: SparkSession, base: Weights = Weights(), pagerank=(0.0, 0.3, 0.6, 1.0, 1.5), trust=(0.0, 0.3, 0.6)) -> list[tuple[str, Weights]]:
    """Named weights of a sweep."""
    return [(f"pr={p:g},trust={t:g}", replace(base, pagerank=p, trust=t)) for p in pagerank for t in trust]


def ablations(base: Weights = Weights()) -> list[tuple[str, Weights]]:
    """The full weights, each signal off by itself, and text alone."""
    off = [(f"no {k}", replace(base, **{k: 0.0})) for k in asdict(base) if k != "text"]
    return [("full", base), *off, ("text only", Weights(base.text, 0.0, 0.0, 0.0))]


def blend_configs(hits: DataFrame, median_pagerank: float, configs: list[tuple[str, Weights]]) -> DataFrame:
    """``blended`` under each of some weights: one pass, as each hit meets the handful of configurations."""
    spark = hits.sparkSession
    table = spark.createDataFrame([(n, *map(float, asdict(w).values())) for n, w in configs], "config string, w_text double, w_pr double, w_q double, w_trust double")
    one = blend(hits, median_pagerank, Weights(1.0, 1.0, 1.0, 1.0)).crossJoin(F.broadcast(table))  # a row a configuration
    total = (F.col("w_text") * F.col("text") + F.col("w_pr") * F.col("pagerank_boost") + F.col("w_q") * F.col("quality_boost") + F.col("w_trust") * F.col("trust_boost")) * F.col("gate")
    return one.withColumn("blended", total)


def snippet(body: Column, words: Column, width: int = 30, chars: int = 180) -> Column:
    """The window of words with most query words, these in <b>; else the first characters. HTML is escaped."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  value is computed once, not wherever f names it
    asked = lambda w: F.array_contains(words, F.lower(F.regexp_replace(w, r"[^\p{L}\p{M}\p{N}]", "")))

    def best(p: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(p["ws"]) - width + 1), F.lit(width // 3))
        return F.array_max(F.transform(starts, lambda s: F.struct(F.aggregate(F.slice(p["hit"], s, width), F.lit(0), lambda a, x: a + x).alias("h"), (-s).alias("s"))))

    def marked(p: Column) -> Column:
        here = F.transform(F.slice(p["ws"], -p["best"]["s"], width), lambda w: F.when(asked(w), F.concat(F.lit("<b>"), escape(w), F.lit("</b>"))).otherwise(escape(w)))
        return F.when(p["best"]["h"] > 0, F.array_join(here, " ")).otherwise(escape(F.substring(F.coalesce(body, F.lit("")), 1, chars)))

    ws = F.split(F.trim(F.regexp_replace(F.coalesce(body, F.lit("")), r"\s+", " ")), " ")
    parts = once(ws, lambda ws: F.struct(ws.alias("ws"), F.transform(ws, lambda w: asked(w).cast("int")).alias("hit")))
    return once(parts, lambda p: once(F.struct(p["ws"].alias("ws"), best(p).alias("best")), marked))


def parse_query(text: str) -> dict[str, list]:
    """Parts of a query as typed: required (+), excluded (-) and plain words, and "phrases" as word lists."""
    import re

    out: dict[str, list] = {"must": [], "must_not": [], "should": [], "phrases": []}
    for sign, phrase, word in re.findall(r'([+-]?)(?:"([^"]*)"|(\S+))', text):
        words = [w.lower() for w in re.findall(r"[^\W_]+", phrase or word)]
        if not words or (not phrase and word in ("AND", "OR", "NOT")):
            continue
        if phrase:
            out["phrases"].append(words)
        else:
            out[{"+": "must", "-": "must_not"}.get(sign, "should")] += words
    return out


def boolean_hits(postings: DataFrame, query: dict[str, list], field: str = "body") -> DataFrame:
    """(doc): documents with all required words and phrases, none of the excluded, and, where nothing is required, any plain word."""
    p = postings.where(F.col("field") == field)
    spark = postings.sparkSession
    docs = lambda words: p.where(F.col("term").isin(words)).groupBy("doc").agg(F.countDistinct("term").alias("n"))
    base = docs(query["must"]).where(F.col("n") == len(set(query["must"]))).select("doc") if query["must"] else None
    for words in query["phrases"]:
        hit = phrase_hits(postings, spark.createDataFrame([(0, words)], "query_id int, words array<string>"), field).select("doc")
        base = hit if base is None else base.join(hit, "doc", "left_semi")
    if base is None:
        base = docs(query["should"]).select("doc") if query["should"] else p.select("doc").limit(0)
    return base.join(docs(query["must_not"]).select("doc"), "doc", "left_anti") if query["must_not"] else base
