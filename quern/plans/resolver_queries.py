"""Queries of the resolver, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.text import quality_score
from quern.operators import ranking, resolver
from quern.operators.signals import latest_pages
from quern.session import read_table

TEXTS = [
    "saint orwins school brellton", "ledgerloft quarry bonds", "the official radio station", "morvane university", "first government college",
    "water tank dunsley", "mount board", "a b", "", "of the in", "st mary's hospital", "technology institute campus news",
]
PLACES = ["brellton", "dunsley", "morvane"]


def _texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS, 1)), "query_id int, q string")


def _tokens(spark):
    return _texts(spark).withColumn("tokens", resolver.tokens_of(F.col("q"), F.array(*map(F.lit, PLACES))))


def query_tokens(spark, sf_dir):
    """Words of the queries with kinds and spellings."""
    t = _tokens(spark).select("query_id", F.posexplode("tokens").alias("i", "t"))
    return t.select("query_id", "i", F.col("t.text").alias("text"), F.col("t.kind").alias("kind"), F.array_join("t.forms", " ").alias("forms"))


def query_splits(spark, sf_dir):
    s = _tokens(spark).select("query_id", F.posexplode(resolver.splits(F.col("tokens"))).alias("i", "s"))
    return s.select("query_id", "i", F.array_join("s.site", " ").alias("site"), F.array_join("s.page", " ").alias("page"))


def _candidates(spark):
    s = _tokens(spark).select("query_id", "tokens", F.posexplode(resolver.splits(F.col("tokens"))).alias("split", "s"))
    site = s.select("query_id", "split", F.filter("tokens", lambda t: F.array_contains(F.col("s.site"), t["text"])).alias("tokens"), F.array(*map(F.lit, ["com", "org", "net", "edu", "in"])).alias("suffixes"))
    return resolver.hostname_candidates(site)


def hostname_candidates(spark, sf_dir):
    """Candidate hosts of every reading."""
    return _candidates(spark)


def host_probe_plan(spark, sf_dir):
    """Hosts to probe by quota, of which the hosts of the crawl are known to answer."""
    return resolver.probe_plan(_candidates(spark))


def _judged(spark, sf_dir):
    q = read_table(spark, sf_dir, "judgments").groupBy("query_id").agg(F.max("query_text").alias("q"))
    return q.withColumn("tokens", resolver.tokens_of(F.col("q"), F.array(*map(F.lit, PLACES))))


def match_scores(spark, sf_dir):
    """Match score of each judged page for its query."""
    j = read_table(spark, sf_dir, "judgments").select("query_id", "url").distinct()
    p = latest_pages(read_table(spark, sf_dir, "crawled_pages")).select("url", "title", "body_text")
    m = j.join(p, "url").join(_judged(spark, sf_dir), "query_id")
    return m.select("query_id", "url", F.round(resolver.match_score(F.col("tokens"), F.col("title"), F.col("url"), F.col("body_text")), 6).alias("score"))


def resolved_answers(spark, sf_dir):
    """Answers to the judged queries among all pages."""
    p = latest_pages(read_table(spark, sf_dir, "crawled_pages")).select("url", "title", F.col("body_text").alias("body"), quality_score(F.col("title"), F.col("body_text")).alias("quality"))
    return resolver.resolve(_judged(spark, sf_dir).select("query_id", "tokens"), p)


def name_match_rank(spark, sf_dir):
    """POI names ranked for names as typed."""
    asked = [(1, "tavrika tea"), (2, "bellamo diamonds store"), (3, "quenlis")]
    q = spark.createDataFrame(asked, "query_id int, q string").withColumn("tokens", resolver.tokens_of(F.col("q"), F.array().cast("array<string>")))
    names = read_table(spark, sf_dir, "poi").select("name").where("name IS NOT NULL").distinct()
    words = q.select("query_id", "tokens", F.explode(F.array_distinct(F.flatten(F.transform("tokens", lambda t: t["forms"])))).alias("w"))
    met = names.select("name", F.explode(resolver.word_set(F.col("name"))).alias("w")).join(words, "w").select("query_id", "tokens", "name").distinct()
    return met.select("query_id", "name", F.round(resolver.name_match(F.col("tokens"), F.col("name")), 6).alias("score")).where("score > 0")


def subpage_rank(spark, sf_dir):
    """Addresses whose path says a word of the crawl's paths."""
    q = spark.createDataFrame([(1, ["food"]), (2, ["weather", "travel"]), (3, ["city", "news"]), (4, ["zzz"])], "query_id int, words array<string>")
    return resolver.best_pages(q, read_table(spark, sf_dir, "crawled_pages").where("url IS NOT NULL"))


def front_doors(spark, sf_dir):
    """Judged pages of each query, one a domain."""
    j = read_table(spark, sf_dir, "judgments").groupBy("query_id", "url").agg(F.max(F.coalesce("grade", F.lit(0.0))).cast("double").alias("score"))
    return resolver.front_doors(j)


def interleave_sources(spark, sf_dir):
    """Two rankings of suppliers by nation in turn."""
    from pyspark.sql import Window

    s = read_table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("query_id"), F.col("s_name").alias("host"), "s_acctbal", "s_suppkey")
    by = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(c, "s_suppkey")) - 1
    return resolver.interleaved(s.withColumn("rank", by(F.col("s_acctbal").desc())), s.withColumn("rank", by(F.col("s_acctbal"))))


def query_suffixes(spark, sf_dir):
    """Suffixes by the country of the most populous place of the gazetteer that a query names."""
    g = read_table(spark, sf_dir, "place_gazetteer")
    named = g.select("name").where("name IS NOT NULL").distinct().select(F.col("name").alias("query_id"), F.lower("name").alias("q"))
    tokens = F.array(F.struct(F.col("q").alias("text"), F.array("q").alias("forms"), F.lit("Place").alias("kind")))
    return resolver.query_suffixes(named.select("query_id", tokens.alias("tokens")), g).select("query_id", F.array_join("suffixes", " ").alias("suffixes"))


def control_highlights(spark, sf_dir):
    """Links of each page as controls, found again by the words of their own text."""
    p = latest_pages(read_table(spark, sf_dir, "crawled_pages")).where(F.size("links") > 0)
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.array_join(F.transform("links", lambda x: F.concat(F.lit("<a href='/x'>"), esc(F.coalesce(x["text"], F.lit(""))), F.lit("</a>"))), " ")
    wanted = p.select(F.col("page_id").alias("query_id"), "url", resolver.tokens_of(F.get("links", F.lit(0))["text"], F.array().cast("array<string>")).alias("words"))
    return resolver.highlights(wanted, p.select("url", html.alias("html")))


def boolean_query(spark, sf_dir):
    """Pages with a required word and a phrase but not an excluded word."""
    docs = latest_pages(read_table(spark, sf_dir, "crawled_pages")).select(F.col("url").alias("doc"), F.lit("").alias("title"), F.lit("").alias("anchor"), F.lit("").alias("url"), F.col("body_text").alias("body"))
    postings, _ = ranking.build_index(docs, False)
    return ranking.boolean_hits(postings, ranking.parse_query('+bridge "the railway gate" -clinic')).select(F.col("doc").alias("url"))


QUERIES = {
    f.__name__: f
    for f in (
        query_suffixes, control_highlights, boolean_query, query_tokens, query_splits, hostname_candidates, host_probe_plan, match_scores, resolved_answers, name_match_rank, subpage_rank, front_doors, interleave_sources,
    )
}
QUERIES["resolver_front_doors"] = QUERIES.pop("front_doors")


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_ROWS = "t(query_id, q) AS (VALUES " + ", ".join(f"({i}, '{q.replace(chr(39), chr(39) * 2)}')" for i, q in enumerate(TEXTS, 1)) + ")"
_KIND = f"CASE WHEN w IN ({_list(resolver.STOP)}) THEN 'Stop' WHEN w IN ({_list(resolver.GENERIC)}) THEN 'Generic' WHEN w IN ({_list(PLACES)}) THEN 'Place' ELSE 'Distinctive' END"
_BOTH = {**resolver.EQUIVALENTS, **{v: k for k, v in resolver.EQUIVALENTS.items()}}
_EQ = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _BOTH.items()) + " END"
_FORMS = f"""list_filter([w, {_EQ}, CASE WHEN w LIKE '%s' THEN CASE WHEN length(w) >= 4 AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) END WHEN length(w) >= 3 THEN w || 's' END], lambda x: x IS NOT NULL)"""


def _words(q: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array(lower({q}), '[^\p{{L}}\p{{M}}\p{{N}}'']+'), lambda w: replace(w, '''', '')), lambda w: w <> '')"


def _set(c: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(replace(lower(coalesce({c}, '')), '''', ''), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: w <> ''))"


_H = r"regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@\s]+)', 1), '^(www\.)+', '')"
_P = r"regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"

_SUFFIX = "CASE cc " + " ".join(f"WHEN '{k}' THEN '{' '.join(v)}'" for k, v in resolver.SUFFIXES.items()) + " ELSE CASE WHEN regexp_full_match(cc, '[a-z]{2}') THEN cc ELSE '' END END"
_BOXES = "CASE " + " ".join(f"WHEN lat BETWEEN {a} AND {b} AND lon BETWEEN {c} AND {d} THEN '{cc}'" for a, b, c, d, cc in resolver.COUNTRY_BOXES) + " END"

ORACLE = {
    "query_suffixes": f"""WITH g AS (SELECT lower(name) AS key, population, coalesce(nullif(lower(country), ''), {_BOXES}) AS cc FROM place_gazetteer WHERE kind IN ({_list(resolver.PLACE_KINDS)}) AND population >= 50000),
b AS (SELECT key, cc FROM g WHERE cc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY population DESC, cc DESC) = 1),
n AS (SELECT DISTINCT name AS query_id, lower(name) AS key FROM place_gazetteer WHERE name IS NOT NULL), j AS (SELECT query_id, coalesce(cc, 'in') AS cc FROM n LEFT JOIN b USING (key)),
x AS (SELECT query_id, {_SUFFIX} AS s FROM j)
SELECT query_id, 'com org net edu' || CASE WHEN s = '' THEN '' ELSE ' ' || array_to_string(list_filter(string_split(s, ' '), lambda z: z <> 'edu'), ' ') END AS suffixes FROM x""",
    "boolean_query": rf"""WITH latest AS (SELECT * FROM crawled_pages WHERE status = 200 AND url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY crawled_at_unix DESC NULLS LAST, page_id DESC NULLS LAST) = 1),
w AS (SELECT url, list_filter(regexp_extract_all(lower(coalesce(body_text, '')), '[\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: strlen(w) <= 40) AS t FROM latest)
SELECT url FROM w WHERE list_contains(t, 'bridge') AND NOT list_contains(t, 'clinic') AND contains(' ' || array_to_string(t, ' ') || ' ', ' the railway gate ')""",
    "query_tokens": f"""WITH {_ROWS}, x AS (SELECT query_id, unnest(ws) AS w, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS i FROM (SELECT query_id, {_words('q')} AS ws FROM t))
SELECT query_id, i, w AS text, {_KIND} AS kind, array_to_string({_FORMS}, ' ') AS forms FROM x""",
    "query_splits": f"""WITH {_ROWS}, u AS (SELECT query_id, list_filter({_words('q')}, lambda w: w NOT IN ({_list(resolver.STOP)})) AS w FROM t),
c AS (
 SELECT query_id, 0 AS o, w AS site, CAST([] AS VARCHAR[]) AS page FROM u WHERE len(w) > 0
 UNION ALL SELECT query_id, k, w[1:k], w[k + 1:] FROM u, range(1, 4) r(k) WHERE k < len(w)
 UNION ALL SELECT query_id, 10 + k, w[len(w) - k + 1:], w[1:len(w) - k] FROM u, range(1, 4) r(k) WHERE k < len(w)),
d AS (SELECT query_id, array_to_string(site, ' ') AS site, array_to_string(page, ' ') AS page, min(o) AS o FROM c GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o) - 1 AS INTEGER) AS i, site, page FROM d""",
    "match_scores": f"""WITH q AS (SELECT query_id, max(query_text) AS q FROM judgments GROUP BY query_id),
tok AS (SELECT query_id, w, {_KIND} AS kind, {_FORMS} AS forms FROM (SELECT query_id, unnest({_words('q')}) AS w FROM q)),
latest AS (SELECT * FROM crawled_pages WHERE status = 200 AND url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY crawled_at_unix DESC NULLS LAST, page_id DESC NULLS LAST) = 1),
pg AS (SELECT url, {_set('title')} AS ti, {_set('substring(body_text, 1, 8000)')} AS bo, {_H} AS ho FROM latest),
m AS (SELECT j.query_id, j.url, kind, len(list_intersect(forms, ti)) > 0 AS a, len(list_filter(forms, lambda f: contains(ho, f))) > 0 AS h, len(list_intersect(forms, bo)) > 0 AS b
  FROM (SELECT DISTINCT query_id, url FROM judgments) j JOIN pg USING (url) JOIN tok USING (query_id)),
s AS (SELECT query_id, url, count(*) FILTER (kind IN ('Distinctive', 'Place')) AS n, count(*) FILTER (kind IN ('Distinctive', 'Place') AND a) AS na, count(*) FILTER (kind IN ('Distinctive', 'Place') AND h) AS nh,
  count(*) FILTER (kind IN ('Distinctive', 'Place') AND b) AS nb, count(*) FILTER (kind = 'Place' AND NOT (a OR h OR b)) AS lost, count(*) FILTER (kind = 'Generic') AS g, count(*) FILTER (kind = 'Generic' AND (a OR h OR b)) AS gh FROM m GROUP BY query_id, url)
SELECT query_id, url, round(CASE WHEN n = 0 THEN 0 ELSE least(1.0::DOUBLE, 0.85::DOUBLE * na / n + 0.1::DOUBLE * nb / n + 0.25::DOUBLE * nh / n) * CASE WHEN lost = 0 THEN 1.0::DOUBLE ELSE 0.25 END
 * CASE WHEN g = 0 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE + 0.3::DOUBLE * gh / g END END, 6) AS score FROM s""",
    "subpage_rank": rf"""WITH q(query_id, ws) AS (VALUES (1, ['food']), (2, ['weather', 'travel']), (3, ['city', 'news']), (4, ['zzz'])),
u AS (SELECT DISTINCT url FROM crawled_pages WHERE url IS NOT NULL),
s AS (SELECT url, list_filter(regexp_split_to_array(lower({_P}), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: length(w) > 1 AND NOT regexp_full_match(w, '[0-9]+')) AS sl FROM u),
x AS (SELECT query_id, url, ws, sl, len(list_filter(ws, lambda w: list_contains(sl, w) OR list_contains(sl, w || 's') OR list_contains(list_transform(sl, lambda z: z || 's'), w))) AS hits FROM q, s WHERE len(sl) > 0),
y AS (SELECT query_id, url, round(least(1.0::DOUBLE, (hits / len(ws)) * (hits / len(ws)) * (0.6::DOUBLE + 0.4::DOUBLE * least(1.0::DOUBLE, len(ws) / len(sl)))
  * CASE WHEN len(ws) > 1 AND contains(' ' || array_to_string(sl, ' ') || ' ', ' ' || array_to_string(ws, ' ') || ' ') THEN 1.25::DOUBLE ELSE 1 END), 6) AS score FROM x)
SELECT query_id, url, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(url), url) AS rank FROM y WHERE score >= 0.35 QUALIFY rank <= 10""",
    "interleave_sources": """WITH r AS (SELECT s_nationkey AS query_id, s_name AS host, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) - 1 AS a,
 row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) - 1 AS b FROM supplier),
k AS (SELECT query_id, host, min(least(2 * a, 2 * b + 1)) AS k FROM r GROUP BY query_id, host)
SELECT query_id, host, row_number() OVER (PARTITION BY query_id ORDER BY k, host) AS place FROM k QUALIFY place <= 8""",
}
