"""Queries of URL functions and corpus signals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import urls
from quern.functions.text import PARKED_MARKERS, quality_score, simhash64
from quern.operators import signals
from quern.session import read_table, stored


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "crawled_pages")


def page_status_filter(spark, sf_dir):
    """Pages with status 200 by declared language."""
    return _pages(spark, sf_dir).where("status = 200").groupBy("lang").agg(F.count(F.lit(1)).alias("pages"))


def registrable_domain(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.registrable_domain(F.col("url")).alias("domain"), urls.host_of(F.col("url")).alias("host"))


def canonical_url(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


def url_shapes(spark, sf_dir):
    u = F.col("url")
    return _pages(spark, sf_dir).select(
        "page_id", urls.url_depth(u).cast("int").alias("depth"), urls.url_to_text(u).alias("url_text"), F.array_join(urls.slug_tokens(u), " ").alias("slug"), urls.looks_like_host(urls.host(u)).alias("is_host")
    )


def shard_counts(spark, sf_dir):
    """Addresses a shard; the hash is an implementation detail, so there is no SQL for it."""
    return _pages(spark, sf_dir).where("url IS NOT NULL").select(urls.shard_for_url(F.col("url"), 8).alias("shard")).groupBy("shard").agg(F.count(F.lit(1)).alias("urls"))


def anchor_phrases(spark, sf_dir):
    """Distinct anchor phrases of each target, from inside and outside its domain."""
    links = signals.links_of(_pages(spark, sf_dir).where("status = 200"))
    return signals.anchor_phrases(links).groupBy("dst").agg(F.count(F.lit(1)).alias("phrases"), F.sum(F.col("internal").cast("long")).alias("internal"), F.max("phrase").alias("last_phrase"))


def anchor_text(spark, sf_dir):
    return signals.anchor_text(signals.links_of(signals.latest_pages(_pages(spark, sf_dir))))


def inbound_domains(spark, sf_dir):
    return signals.inbound_domains(signals.links_of(_pages(spark, sf_dir).where("status = 200")))


def link_degrees(spark, sf_dir):
    nodes, edges = signals.link_graph(signals.latest_pages(_pages(spark, sf_dir)))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out_degree"))
    return nodes.join(out, nodes.url == out.src, "left").select("url", F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


PAGERANK_ROUNDS = 60


def pagerank(spark, sf_dir):
    nodes, edges = signals.link_graph(signals.latest_pages(_pages(spark, sf_dir)))
    return signals.pagerank(nodes, edges, PAGERANK_ROUNDS).select("url", F.round("pagerank", 9).alias("pagerank"))


def quality(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.round(quality_score(F.col("title"), F.col("body_text")), 6).alias("quality"))


def url_duplicates(spark, sf_dir):
    scored = signals.latest_pages(_pages(spark, sf_dir)).select("url", F.round(quality_score(F.col("title"), F.col("body_text")), 6).alias("quality"))
    return signals.canonical_duplicates(scored)


def simhash(spark, sf_dir):
    """SimHash of each page's text."""
    return _pages(spark, sf_dir).select("page_id", simhash64(F.col("body_text")).alias("simhash"))


def near_duplicate_pairs(spark, sf_dir):
    """Pairs of SimHashes of page_signals within three bits."""
    return signals.simhash_pairs(read_table(spark, sf_dir, "page_signals"))


def near_duplicate_flags(spark, sf_dir):
    """Near-duplicates of page_signals after greedy suppression."""
    s = read_table(spark, sf_dir, "page_signals").groupBy("url").agg(F.max("simhash").alias("simhash"), F.max(F.nanvl("quality", F.lit(1.0))).alias("quality"))
    return signals.near_duplicates(s)


def corpus_statistics(spark, sf_dir):
    return signals.corpus_statistics(read_table(spark, sf_dir, "page_signals"))


def pages_with_signals(spark, sf_dir):
    """Pages that an index takes: signals joined from the left with defaults (a quality that is missing or no number is 1), duplicates and poor pages dropped."""
    pages = _pages(spark, sf_dir).where("status = 200").select("page_id", "url")
    s = read_table(spark, sf_dir, "page_signals").groupBy("url").agg(F.max(F.nanvl(F.col("quality").cast("double"), F.lit(1.0))).alias("quality"), F.max("is_duplicate").alias("dup"), F.max("inbound_domains").alias("inbound"))
    j = pages.join(s, "url", "left").select("page_id", F.coalesce("quality", F.lit(1.0)).cast("double").alias("quality"), F.coalesce("dup", F.lit(False)).alias("dup"), F.coalesce("inbound", F.lit(0)).alias("inbound_domains"))
    return j.where("NOT dup AND quality >= 0.15").select("page_id", F.round("quality", 6).alias("quality"), "inbound_domains")


def page_signals(spark, sf_dir):
    """All signals of each address, computed from the pages."""
    return signals.page_signals(stored(_pages(spark, sf_dir)), PAGERANK_ROUNDS)


QUERIES = {
    f.__name__: f
    for f in (
        page_status_filter, registrable_domain, canonical_url, url_shapes, shard_counts, anchor_phrases, anchor_text, inbound_domains, link_degrees,
        pagerank, quality, url_duplicates, simhash, near_duplicate_pairs, near_duplicate_flags, corpus_statistics, pages_with_signals, page_signals,
    )
}
QUERIES["signals_pagerank"] = QUERIES.pop("pagerank")
QUERIES["signals_simhash"] = QUERIES.pop("simhash")

_HOST = r"regexp_extract(lower(trim({u})), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@\s]+)', 1)"


def _host(u: str) -> str:
    return f"nullif({_HOST.format(u=u)}, '')"


def _domain(u: str) -> str:
    h = f"string_split({_host(u)}, '.')"
    n = f"len({h})"
    return (
        f"CASE WHEN {n} >= 3 AND {h}[{n} - 1] IN ('co','com','net','org','gov','ac','edu','res') THEN array_to_string({h}[{n} - 2:], '.') "
        f"WHEN {n} >= 2 THEN array_to_string({h}[{n} - 1:], '.') ELSE {_host(u)} END"
    )


_PATH = r"regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"
_LATEST = """latest AS (SELECT * FROM crawled_pages WHERE status = 200 AND url IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY crawled_at_unix DESC NULLS LAST, page_id DESC NULLS LAST) = 1)"""
_STOPS = ", ".join("'" + s.replace("'", "''") + "'" for s in signals.STOP_ANCHORS)
_CANON = r"""
CASE WHEN host IS NULL THEN lower(regexp_replace(url, '/+$', '')) ELSE regexp_replace(concat('https://', regexp_replace(host, '^www\.', ''),
  regexp_replace(regexp_replace(path, '(index\.html|index\.htm|index\.php|default\.aspx)$', ''), '/+$', ''),
  CASE WHEN qs <> '' THEN concat('?', qs) ELSE '' END), '/+$', '') END"""


def _canonical_from(table: str, columns: str) -> str:
    tracking = ", ".join(f"'{t}'" for t in urls.TRACKING_PARAMETERS)
    return rf"""
parsed AS (SELECT {columns}, url, {_host('url')} AS host, {_PATH} AS path,
  list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '') AS ps FROM {table}),
pairs AS (SELECT *, list_sort(list_filter(list_transform(ps, lambda p: {{'k': url_decode(regexp_extract(p, '^([^=]*)', 1)), 'v': url_decode(regexp_extract(p, '^[^=]*=(.*)$', 1))}}),
  lambda s: s.k NOT IN ({tracking}))) AS kept FROM parsed),
canon AS (SELECT *, array_to_string(list_transform(kept, lambda s: s.k || '=' || s.v), '&') AS qs FROM pairs)"""


_LINKS = """links AS (SELECT src, l.url AS dst, coalesce(l.text, '') AS text FROM (SELECT url AS src, unnest(links) AS l FROM {t}) WHERE l.url IS NOT NULL)"""
_QUALITY = (
    "CASE WHEN "
    + " OR ".join(f"contains(lower(coalesce(title, '')), '{m}') OR contains(lower(substring(coalesce(body_text, ''), 1, 600)), '{m}')" for m in PARKED_MARKERS)
    + r""" THEN 0.0 ELSE least(1.0,
 CASE WHEN length(trim(coalesce(body_text, ''))) < 200 THEN 0.25 WHEN length(trim(coalesce(body_text, ''))) < 600 THEN 0.6 ELSE 1.0 END
 * CASE WHEN trim(coalesce(title, '')) = '' THEN 0.5 WHEN lower(trim(title)) = 'untitled' OR starts_with(lower(trim(title)), 'http') THEN 0.7 ELSE 1.0 END
 * CASE WHEN length(trim(coalesce(body_text, ''))) > 400 AND len(ws) > 50 THEN
     CASE WHEN len(list_distinct(ws)) / len(ws) < 0.12 THEN 0.3 WHEN len(list_distinct(ws)) / len(ws) < 0.25 THEN 0.7 ELSE 1.0 END ELSE 1.0 END) END"""
)
_WS = r"list_filter(regexp_split_to_array(lower(coalesce(body_text, '')), '\s+'), lambda w: w <> '') AS ws"

_RANKS = ",\n".join(
    f"""s{i} AS MATERIALIZED (SELECT e.dst, sum(r.rank / d.deg) AS got FROM edges e JOIN r{i - 1} r ON r.url = e.src JOIN deg d ON d.src = e.src GROUP BY e.dst),
r{i} AS MATERIALIZED (SELECT n.url, 0.15 / c.n + 0.85 * coalesce(s.got, 0) + 0.85 * (1 - (SELECT coalesce(sum(got), 0) FROM s{i})) / c.n AS rank
  FROM nodes n CROSS JOIN cnt c LEFT JOIN s{i} s ON s.dst = n.url)"""
    for i in range(1, PAGERANK_ROUNDS + 1)
)
_GRAPH = f"""WITH {_LATEST}, nodes AS (SELECT DISTINCT url FROM latest), {_LINKS.format(t='latest')},
edges AS (SELECT DISTINCT src, dst FROM links WHERE src <> dst AND dst IN (SELECT url FROM nodes))"""

ORACLE = {
    "page_status_filter": "SELECT lang, count(*) AS pages FROM crawled_pages WHERE status = 200 GROUP BY lang",
    "registrable_domain": f"SELECT page_id, {_domain('url')} AS domain, regexp_replace({_host('url')}, '^(www\\.)+', '') AS host FROM crawled_pages",
    "canonical_url": f"WITH {_canonical_from('crawled_pages', 'page_id')} SELECT page_id, {_CANON} AS canonical FROM canon",
    "url_shapes": rf"""SELECT page_id, CAST(len(list_filter(string_split({_PATH}, '/'), lambda s: s <> '')) AS INTEGER) AS depth,
 array_to_string(list_filter(string_split(translate(url, '/.-_?&=:', '        '), ' '), lambda w: w <> '' AND w NOT IN ('https','http','www','html','php','index')), ' ') AS url_text,
 array_to_string(list_filter(regexp_split_to_array(lower({_PATH}), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) > 1 AND NOT regexp_full_match(w, '[0-9]+')), ' ') AS slug,
 coalesce(regexp_full_match({_host('url')}, '[A-Za-z0-9\-]+(\.[A-Za-z0-9\-]+)*\.[A-Za-z]{{2,}}'), false) AS is_host FROM crawled_pages""",
    "anchor_phrases": rf"""WITH {_LINKS.format(t='(SELECT * FROM crawled_pages WHERE status = 200)')},
p AS (SELECT DISTINCT dst, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS phrase, coalesce({_domain('src')} = {_domain('dst')}, false) AS internal FROM links)
SELECT dst, count(*) AS phrases, CAST(sum(CAST(internal AS INTEGER)) AS BIGINT) AS internal, max(phrase) AS last_phrase FROM p
WHERE phrase <> '' AND phrase NOT IN ({_STOPS}) AND strlen(phrase) <= 120 GROUP BY dst""",
    "inbound_domains": f"""WITH {_LINKS.format(t='(SELECT * FROM crawled_pages WHERE status = 200)')},
d AS (SELECT dst, {_domain('src')} AS s, {_domain('dst')} AS d FROM links)
SELECT dst, count(DISTINCT CASE WHEN s IS DISTINCT FROM d THEN s END) AS inbound_domains FROM d WHERE s IS NOT NULL GROUP BY dst""",
    "link_degrees": _GRAPH + " SELECT n.url, count(e.dst) AS out_degree FROM nodes n LEFT JOIN edges e ON e.src = n.url GROUP BY n.url",
    "signals_pagerank": _GRAPH
    + f""", cnt AS (SELECT count(*) AS n FROM nodes), deg AS (SELECT src, count(*) AS deg FROM edges GROUP BY src),
r0 AS (SELECT url, 1.0 / n AS rank FROM nodes, cnt), {_RANKS} SELECT url, round(rank, 9) AS pagerank FROM r{PAGERANK_ROUNDS}""",
    "quality": f"SELECT page_id, round(CAST({_QUALITY} AS DOUBLE), 6) AS quality FROM (SELECT *, {_WS} FROM crawled_pages)",
    "url_duplicates": f"""WITH {_LATEST}, scored AS (SELECT url, round(CAST({_QUALITY} AS DOUBLE), 6) AS quality FROM (SELECT *, {_WS} FROM latest)), {_canonical_from('scored', 'quality')}
SELECT url, canonical, row_number() OVER (PARTITION BY canonical ORDER BY quality DESC NULLS LAST, length(url), url) > 1 AS is_duplicate
FROM (SELECT url, quality, {_CANON} AS canonical FROM canon)""",
    "near_duplicate_pairs": """WITH h AS (SELECT DISTINCT simhash FROM page_signals WHERE simhash <> 0)
SELECT a.simhash AS a, b.simhash AS b, CAST(bit_count(xor(a.simhash, b.simhash)) AS INTEGER) AS bits FROM h a JOIN h b ON a.simhash < b.simhash
WHERE bit_count(xor(a.simhash, b.simhash)) <= 3""",
    "corpus_statistics": """SELECT count(*) AS pages, count(*) FILTER (is_duplicate) AS duplicates, count(*) FILTER (quality < 0.2) AS poor,
 count(*) FILTER (coalesce(trim(anchor_text), '') <> '') AS with_anchors FROM page_signals""",
    "near_duplicate_flags": """WITH RECURSIVE p AS (SELECT url, max(simhash) AS simhash, max(CASE WHEN isnan(quality) THEN 1.0 ELSE quality END) AS quality FROM page_signals GROUP BY url),
o AS (SELECT *, row_number() OVER (ORDER BY -coalesce(quality, 0.0), length(url), url) AS k FROM p),
f AS (SELECT *, simhash <> 0 AND row_number() OVER (PARTITION BY simhash ORDER BY k) > 1 AS copy FROM o),
h AS (SELECT k, simhash FROM f WHERE simhash <> 0 AND NOT copy),
e AS (SELECT a.k AS w, b.k AS l FROM h a JOIN h b ON a.k < b.k WHERE bit_count(xor(a.simhash, b.simhash)) <= 3),
n AS (SELECT k, row_number() OVER (ORDER BY k) AS i FROM (SELECT w AS k FROM e UNION SELECT l FROM e)),
-- the pages of near pairs one after another: one goes if a better one of its pairs stays
s AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS stay
  UNION ALL SELECT n.i, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.l = n.k AND list_contains(s.stay, e.w)) THEN s.stay ELSE list_append(s.stay, n.k) END FROM s JOIN n ON n.i = s.i + 1),
z AS (SELECT stay FROM s ORDER BY i DESC LIMIT 1)
SELECT f.url, f.copy OR (EXISTS (SELECT 1 FROM n WHERE n.k = (SELECT min(g.k) FROM f g WHERE g.simhash = f.simhash) AND f.simhash <> 0) AND NOT list_contains((SELECT stay FROM z), (SELECT min(g.k) FROM f g WHERE g.simhash = f.simhash))) AS is_duplicate FROM f""",
    "pages_with_signals": """WITH s AS (SELECT url, max(CASE WHEN isnan(quality) THEN 1.0 ELSE CAST(quality AS DOUBLE) END) AS quality, max(is_duplicate) AS dup, max(inbound_domains) AS inbound FROM page_signals GROUP BY url)
SELECT page_id, round(CAST(coalesce(quality, 1.0) AS DOUBLE), 6) AS quality, coalesce(inbound, 0) AS inbound_domains
FROM crawled_pages p LEFT JOIN s USING (url) WHERE status = 200 AND NOT coalesce(dup, false) AND CAST(coalesce(quality, 1.0) AS DOUBLE) >= 0.15""",
}
