"""Queries of readers and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.urls import host
from quern.operators.ordered import running_sums
from quern.operators.signals import latest_pages
from quern.session import ensure_checkpoint_dir, read_table
from quern.sources import geodata, web
from quern.streaming import incremental

ROBOTS = "User-agent: other\nDisallow: /x\nUser-agent: *\nDisallow: /admin # no\nDisallow:\nCrawl-delay: 1\nSitemap: https://a.example/s.xml\nSitemap: https://a.example/t.xml"


def _urls(spark, sf_dir):
    return read_table(spark, sf_dir, "crawled_pages").where("status = 200 AND url IS NOT NULL")


def html_pages(spark, sf_dir):
    """Pages made into HTML and read again: title, text and links come back."""
    p = latest_pages(read_table(spark, sf_dir, "crawled_pages")).where("body_text IS NOT NULL")
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit("<html><head><title>"), esc(F.coalesce("title", F.lit(""))), F.lit("</title><script>var t='</p>'</script></head><body><p>"), esc(F.col("body_text")), F.lit("<style>p{}</style><br><a href='/about#top'>About</a></body>"))
    got = web.pages_from_html(p.select("url", html.alias("html")))
    back = got.join(p.select("url", F.col("body_text").alias("was")), "url")
    flat = lambda c: F.trim(F.regexp_replace(c, r"[\s\x1c-\x1f\x85\xa0]+", " "))
    return back.select("url", (flat(F.col("body_text")) == F.trim(F.concat(flat(F.col("was")), F.lit(" About")))).alias("same_text"), F.size("links").alias("links"))


def cdx_select(spark, sf_dir):
    """Index blocks of ten addresses each that may hold a prefix."""
    surt = F.concat(F.array_join(F.reverse(F.split(host(F.col("url")), r"\.")), ","), F.lit(")"))
    lines = _urls(spark, sf_dir).select(surt.alias("surt")).where("surt IS NOT NULL").distinct()
    numbered = running_sums(lines, [F.col("surt")], {}, number="n").select((F.col("n") - 1).alias("line_no"), "surt", F.lit("f").alias("file"), F.lit(100).alias("length"))
    return web.select_blocks(numbered, ["example,co,", "example,net,v"]).select("line_no", "surt")


def cdx_parse(spark, sf_dir):
    """Index lines made of addresses, parsed, with their byte ranges."""
    u = _urls(spark, sf_dir).select("page_id", "url")
    line = F.concat(F.lit("example,x)/ 20250101 "), F.to_json(F.struct("url", F.lit("200").alias("status"), F.when(F.col("page_id") % 2 == 0, "text/html").otherwise("image/png").alias("mime"), F.col("page_id").cast("string").alias("offset"), F.when(F.col("page_id") % 5 == 0, "bad").otherwise("10").alias("length"))))
    return web.fetchable(web.parse_cdx(u.select(line.alias("value")), ["example,"])).select("url", "offset", "length")


def robots_rules(spark, sf_dir):
    """Addresses that a robots file would allow, by site folder."""
    rules = web.robots(F.lit(ROBOTS), "quern")
    p = F.regexp_extract("url", "^[a-z]+://[^/]+(/[a-z]*)", 1)
    u = _urls(spark, sf_dir).select(F.when(F.col("page_id") % 3 == 0, F.lit("/admin/x")).otherwise(p).alias("path"), rules.alias("r"))
    return u.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max(web.allowed(F.col("r"), F.col("path"))).alias("allowed"), F.max("r.crawl_delay_ms").alias("delay_ms"), F.max(F.size("r.sitemaps")).alias("sitemaps"))


def sitemaps(spark, sf_dir):
    """Addresses read back from a sitemap a host."""
    h = host(F.col("url"))
    u = _urls(spark, sf_dir).select(h.alias("host"), "url").where("host IS NOT NULL").distinct()
    docs = u.groupBy("host").agg(F.concat(F.lit("<urlset>"), F.array_join(F.transform(F.sort_array(F.collect_set("url")), lambda x: F.concat(F.lit("<url><loc> "), F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("\n</loc></url>"))), ""), F.lit("</urlset>")).alias("body"))
    return web.sitemap_urls(docs.select("host", F.lit("s").alias("url"), "body"))


def frontier(spark, sf_dir):
    """Links to addresses not yet fetched."""
    p = _urls(spark, sf_dir)
    rules = p.select(host(F.col("url")).alias("host")).distinct().withColumn("rules", web.robots(F.lit("User-agent: *\nDisallow: /news"), "quern"))
    return web.crawl_frontier(p.select(F.explode("links").alias("l")).select("l.url"), p, rules)


def way_centroids(spark, sf_dir):
    """Orders as ways over parts as nodes; every other way is closed."""
    li = read_table(spark, sf_dir, "lineitem")
    refs = li.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("r"))
    ways = refs.select(F.col("l_orderkey").alias("id"), F.when(F.col("l_orderkey") % 2 == 0, F.concat("r", F.slice("r", 1, 1))).otherwise(F.col("r")).alias("refs"), F.create_map(F.lit("amenity"), F.lit("x")).alias("tags"))
    nodes = read_table(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 90).cast("double").alias("lat"), (F.col("p_partkey") % 180).cast("double").alias("lon"))
    return geodata.way_centroids(ways, nodes).select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def tagged_pois(spark, sf_dir):
    """POIs rebuilt from tag maps."""
    p = read_table(spark, sf_dir, "poi").where("lat IS NOT NULL AND lon IS NOT NULL").select("id", "lat", "lon", F.create_map(F.lit("name"), F.coalesce("name", F.lit("")), F.lit("amenity"), F.coalesce("category", F.lit("yes")), F.lit("brand"), F.coalesce("brand", F.lit("")), F.lit("contact:phone"), F.coalesce("phone", F.lit(""))).alias("tags"))
    return geodata.pois_from_tags(p, "").groupBy("category", "poi_group").agg(F.count(F.lit(1)).alias("pois"), F.sum((F.col("phone") != "").cast("long")).alias("phones"))


def gazetteer_dump(spark, sf_dir):
    """The gazetteer written as a dump and read again."""
    g = read_table(spark, sf_dir, "place_gazetteer")
    cols = [F.lit("1"), F.col("name"), F.lit(""), F.lit("Abcd,पूर,xy"), F.col("lat").cast("string"), F.col("lon").cast("string"), F.lit("P"), F.lit("PPL"), F.lit("IN"), *[F.lit("")] * 5, F.col("population").cast("string")]
    rows = g.where("lat IS NOT NULL AND lon IS NOT NULL AND name IS NOT NULL").select(F.concat_ws("\t", *cols).alias("value"))
    return geodata.gazetteer_from_dump(rows).groupBy("kind", "country").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names"))


def politeness(spark, sf_dir):
    """Captures of a domain that followed each other within two minutes."""
    f = read_table(spark, sf_dir, "crawled_pages").where("url IS NOT NULL").select("url", F.col("crawled_at_unix").alias("at"))
    return incremental.politeness_gaps(f, 120_000).groupBy("domain").agg(F.count(F.lit(1)).alias("too_soon"))


def event_hours(spark, sf_dir):
    """Events by hour."""
    e = read_table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return incremental.arrivals_by_hour(e, "t").select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "n")


def stream_features(spark, sf_dir):
    """Page features kept up to date from a stream of page files."""
    import uuid

    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    read_table(spark, sf_dir, "crawled_pages").select("url", "title", "body_text", "links", "crawled_at_unix", "status").repartition(4).write.json(f"{base}/in")
    incremental.follow_pages(incremental.page_stream(spark, f"{base}/in", 2), f"{base}/out", f"{base}/state").awaitTermination()
    return incremental.current_features(spark, f"{base}/out").select("url", "crawled_at_unix", F.round("quality", 6).alias("quality"))


QUERIES = {
    f.__name__: f
    for f in (html_pages, cdx_select, cdx_parse, robots_rules, sitemaps, frontier, way_centroids, tagged_pois, gazetteer_dump, politeness, event_hours, stream_features)
}
_OKURL = "crawled_pages WHERE status = 200 AND url IS NOT NULL"
_H = r"regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@\s]+)', 1)"
ORACLE = {
    "cdx_select": f"""WITH s AS (SELECT DISTINCT array_to_string(list_reverse(string_split({_H}, '.')), ',') || ')' AS surt FROM {_OKURL} AND {_H} <> ''),
n AS (SELECT surt, row_number() OVER (ORDER BY surt) - 1 AS line_no FROM s), m AS (SELECT *, starts_with(surt, 'example,co,') OR starts_with(surt, 'example,net,v') AS hit FROM n)
SELECT line_no, surt FROM (SELECT *, lead(hit) OVER (ORDER BY line_no) AS nxt FROM m) WHERE hit OR nxt""",
    "cdx_parse": f"SELECT url, page_id AS \"offset\", CAST(10 AS BIGINT) AS length FROM {_OKURL} AND page_id % 2 = 0 AND page_id % 5 <> 0",
    "robots_rules": f"""WITH p AS (SELECT CASE WHEN page_id % 3 = 0 THEN '/admin/x' ELSE regexp_extract(url, '^[a-z]+://[^/]+(/[a-z]*)', 1) END AS path FROM {_OKURL})
SELECT path, count(*) AS n, NOT starts_with(path, '/admin') AS allowed, CAST(1000 AS BIGINT) AS delay_ms, 2 AS sitemaps FROM p GROUP BY path""",
    "sitemaps": f"SELECT DISTINCT {_H} AS host, url FROM {_OKURL} AND {_H} <> ''",
    "frontier": rf"""WITH l AS (SELECT DISTINCT l.url AS url FROM (SELECT unnest(links) AS l FROM {_OKURL}) WHERE l.url IS NOT NULL), h AS (SELECT DISTINCT {_H} AS host FROM {_OKURL})
SELECT url FROM l WHERE url NOT IN (SELECT url FROM {_OKURL}) AND NOT ({_H} IN (SELECT host FROM h) AND starts_with(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/news'))""",
    "way_centroids": """SELECT l_orderkey AS id, round(avg(CAST(l_partkey % 90 AS DOUBLE)), 6) AS lat, round(avg(CAST(l_partkey % 180 AS DOUBLE)), 6) AS lon FROM (
 SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n,
  first_value(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS f FROM lineitem)
WHERE l_partkey % 7 <> 0 AND NOT (l_orderkey % 2 = 1 AND n > 1 AND i = n AND l_partkey = f) GROUP BY l_orderkey""",
    "gazetteer_dump": """WITH g AS (SELECT name, CASE WHEN population >= 100000 THEN 'city' ELSE 'town' END AS kind, population FROM place_gazetteer WHERE lat IS NOT NULL AND lon IS NOT NULL AND name IS NOT NULL AND name <> ''),
n AS (SELECT kind, name FROM g UNION ALL SELECT kind, 'Abcd' FROM g WHERE population >= 200000)
SELECT kind, 'in' AS country, count(*) AS n, count(DISTINCT name) AS names FROM n GROUP BY kind""",
    "event_hours": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, count(*) AS n FROM events GROUP BY 1",
    "politeness": r"""WITH d AS (SELECT url, crawled_at_unix AS a, string_split(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@\s]+)', 1), '.') AS l FROM crawled_pages WHERE url IS NOT NULL),
s AS (SELECT url, a, CASE WHEN len(l) >= 3 AND l[len(l) - 1] IN ('co','com','net','org','gov','ac','edu','res') THEN array_to_string(l[len(l) - 2:], '.') WHEN len(l) >= 2 THEN array_to_string(l[len(l) - 1:], '.') ELSE l[1] END AS domain FROM d),
g AS (SELECT domain, (a - lag(a) OVER (PARTITION BY domain ORDER BY a, url)) * 1000 AS gap FROM s)
SELECT domain, count(*) AS too_soon FROM g WHERE gap < 120000 GROUP BY domain""",
}
