"""Queries from hosts to answers, of map tiles, sinks and lookups, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.functions import geo, urls
from quern.functions.text import quality_score
from quern.operators import answers, places, resolver
from quern.operators.proximity import usable_position
from quern.operators.signals import latest_pages
from quern.plans import places_queries as pq
from quern.plans import resolver_queries as rq
from quern.plans import signals_queries as sq
from quern.session import ensure_checkpoint_dir, read_table
from quern.sources import geodata, web

NOW, TTL = pq.NOW, pq.TTL


def _pages(spark, sf_dir):
    return read_table(spark, sf_dir, "crawled_pages")


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/quern-sink-{uuid.uuid4().hex}"


def title_quality(spark, sf_dir):
    """Fetched pages that are good enough; every other page is given its host as title."""
    host = urls.host_of(F.col("url"))
    p = latest_pages(_pages(spark, sf_dir)).select("url", F.when(F.col("page_id") % 2 == 0, F.concat(F.upper(host), F.lit(" - Home"))).otherwise(F.col("title")).alias("title"), "body_text")
    q = p.select("url", answers.title_is_domain(F.col("title"), F.col("url")).alias("is_domain"), quality_score(F.col("title"), F.col("body_text")).alias("q"), "title")
    return q.where(answers.fetched_quality(F.col("title"), F.col("url"), F.col("q")) >= resolver.QUALITY_FLOOR).select("url", "is_domain", F.round("q", 6).alias("quality"))


def tiles_for_query(spark, sf_dir):
    """Tiles that 3 km circles around the gazetteer's places touch, with their bounds."""
    g = read_table(spark, sf_dir, "place_gazetteer").where(usable_position(F.col("lat"), F.col("lon"))).select("lat", "lon").distinct()
    t = g.select("lat", "lon", F.explode(geo.tiles_for_circle(F.col("lat"), F.col("lon"), F.lit(3000.0))).alias("tile"))
    b = geo.tile_bounds(F.col("tile"))
    return t.select("lat", "lon", "tile", F.round(b["lat"], 6).alias("tile_lat"), F.round(b["lon"], 6).alias("tile_lon"), F.round(b["radius_m"], 2).alias("radius_m"))


def _cities(spark, sf_dir):
    return read_table(spark, sf_dir, "place_gazetteer").where("kind = 'city'").select("lat", "lon", F.lit(3000.0).alias("radius_m"))


def _marks(spark, sf_dir):
    g = read_table(spark, sf_dir, "place_gazetteer").where((F.col("kind") == "city") & usable_position(F.col("lat"), F.col("lon")))
    return g.select(geo.geohash(F.col("lat"), F.col("lon"), 5).alias("tile"), (F.lit(NOW) - F.col("population") % 2 * TTL).cast("long").alias("fetched_at")).distinct()


def seed_plan(spark, sf_dir):
    """Number of tiles around cities to fetch, and the seconds; some centres were fetched before."""
    fresh = places.mark_fetched(spark.createDataFrame([], "tile string, fetched_at long"), _marks(spark, sf_dir))
    return places.seed_plan(_cities(spark, sf_dir), fresh, NOW, TTL, 2)[1]


def mark_regions(spark, sf_dir):
    """Covered regions after some were fetched again: one row a source."""
    r = read_table(spark, sf_dir, "covered_regions")
    new = r.where("fetched_at % 2 = 0").withColumn("fetched_at", F.lit(NOW).cast("long"))
    return places.mark_fetched(r, new, "source").select("source", "fetched_at")


def gazetteer_seeded(spark, sf_dir):
    """The gazetteer with further towns, then cities that replace all of their name."""
    cols = ["name", "kind", "lat", "lon", "population", "country"]
    g = read_table(spark, sf_dir, "place_gazetteer").select(*cols).where("name IS NOT NULL").distinct()
    more = g.where("kind = 'town'").withColumn("kind", F.lit("suburb"))
    better = g.where("kind = 'city'").withColumn("population", F.col("population") + 1)
    return geodata.seeded_gazetteer(g, [more], [better]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("population").alias("people"))


def directory_lookup(spark, sf_dir):
    """Listed brands looked up among POIs with a website."""
    q = read_table(spark, sf_dir, "brand_list").select(F.col("brand_id").alias("query_id"), F.col("brand_name").alias("q"))
    return places.directory_lookup(q, read_table(spark, sf_dir, "poi")).select("query_id", "id", "place")


def embedded_place(spark, sf_dir):
    """Every name of the gazetteer of one word behind another word, looked up near a fixed point."""
    g = read_table(spark, sf_dir, "place_gazetteer")
    asked = g.select("name").where(~F.col("name").rlike(r"\s")).distinct().select("name", F.concat(F.lit("Larkspur "), "name").alias("q"), F.lit(9.0).alias("lat"), F.lit(72.0).alias("lon")).select(F.col("name").alias("query_id"), "q", "lat", "lon")
    return places.embedded_place(asked, g).select("query_id", "kind", F.round("lat", 6).alias("lat"), "radius_m", "subject", "scope_too_broad")


def sub_hosts(spark, sf_dir):
    """Sub-hosts of the crawl's domains that were crawled; domains of few pages answer to any name here."""
    p = _pages(spark, sf_dir).select(urls.registrable_domain(F.col("url")).alias("base"), urls.host(F.col("url")).alias("host")).where("base IS NOT NULL")
    few = p.groupBy(F.col("base").alias("host")).agg(F.count(F.lit(1)).alias("n")).where("n < 5")
    return answers.sub_hosts(p, few, p)


def fetch_budget(spark, sf_dir):
    """Hosts to fetch for judged queries: judged pages' hosts as recorded, hosts of pages linked from them as guesses."""
    j = read_table(spark, sf_dir, "judgments").select("query_id", "url").distinct()
    host = urls.host_of(F.col("url"))
    ranked = lambda d: d.withColumn("rank", F.hash(F.lit(0)) * 0 + F.length("host"))
    recorded = ranked(j.where("query_id % 3 = 0").select("query_id", host.alias("host")).where("host IS NOT NULL").distinct())
    guessed = ranked(j.select("query_id", urls.registrable_domain(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()).withColumn("split", F.lit(1))
    tokens = rq._judged(spark, sf_dir).select("query_id", "tokens")
    return answers.fetch_budget(answers.promoted(guessed, recorded), tokens)


def _scored(spark, sf_dir, page_words):
    j = read_table(spark, sf_dir, "judgments").select("query_id", "url").distinct()
    p = latest_pages(_pages(spark, sf_dir)).select("url", "title", F.col("body_text").alias("body"))
    m = j.join(p, "url").join(rq._judged(spark, sf_dir), "query_id")
    own = resolver.own_site_weight(F.col("url"), F.when(F.col("query_id") % 2 == 0, F.array(urls.registrable_domain(F.col("url")))).otherwise(F.array().cast("array<string>")))
    m = m.withColumn("seeking", resolver.site_seeking(F.col("tokens"), F.lit(None).cast("string"))).withColumn("own", own).withColumn("name_score", F.when(F.col("query_id") % 3 == 0, 0.5)).withColumn("page_words", page_words)
    return answers.answer_scores(m).select("query_id", "url", F.round("score", 6).alias("score"))


def answer_scores(spark, sf_dir):
    """Scores of judged pages as sites: name match, own site, depth and platform."""
    return _scored(spark, sf_dir, F.array().cast("array<string>"))


def page_scores(spark, sf_dir):
    """Scores of judged pages as pages found by their path."""
    return _scored(spark, sf_dir, F.array(F.lit("news"), F.lit("food")))


def control_links(spark, sf_dir):
    """Link texts as labels: shortened, and the address that scrolls to them where they stand in the text."""
    p = latest_pages(_pages(spark, sf_dir)).select("url", "body_text", F.explode("links").alias("l")).select("url", "body_text", F.col("l.text").alias("label")).where("label IS NOT NULL").distinct()
    said = answers.one_line(F.col("label"))
    out = p.select("url", "label", answers.shortened(said).alias("short"), answers.is_control(said).alias("is_control"), F.length(answers.label_link(F.col("url"), F.col("body_text"), F.col("label"))).alias("link_length"))
    return out.groupBy("label", "short", "is_control").agg(F.count("link_length").alias("linked"), F.count(F.lit(1)).alias("pages"))


def label_menu(spark, sf_dir):
    """Labels of each page's links that stand in its text."""
    p = latest_pages(_pages(spark, sf_dir)).select("url", "body_text", F.posexplode("links").alias("place", "l"))
    return answers.label_menu(p.select("url", F.col("l.text").alias("label"), "place", F.col("body_text").alias("page_text")))


def via_text(spark, sf_dir):
    """How answers were found, in words, cut for display."""
    b = read_table(spark, sf_dir, "brand_list")
    source = F.element_at(F.array(*map(F.lit, ["openstreetmap", "wikidata", "crawl"]), F.lit(None)), F.col("brand_id") % 4 + 1)
    text = answers.via(source, F.col("brand_name"), F.lower("brand_name"), F.when(F.col("brand_id") % 8 == 3, F.lit("menu")))
    return b.select("brand_id", text.alias("via"), answers.display_text(text, 30).alias("shown"))


def explain_trace(spark, sf_dir):
    """Per query: candidates guessed, probed, and those whose host was crawled. Candidates come from a table function, so there is no SQL."""
    made = rq._candidates(spark)
    plan = resolver.probe_plan(made)
    known = _pages(spark, sf_dir).select(urls.host_of(F.col("url")).alias("host")).where("host IS NOT NULL")
    n = lambda d, c: d.groupBy("query_id").agg(F.count(F.lit(1)).alias(c))
    out = n(made, "guessed").join(n(plan, "probed"), "query_id", "left").join(n(resolver.live(plan, known), "live"), "query_id", "left")
    return out.select("query_id", "guessed", F.coalesce("probed", F.lit(0)).alias("probed"), F.coalesce("live", F.lit(0)).alias("live"))


def pages_round_trip(spark, sf_dir):
    """Pages written as JSON lines by shard and read again."""
    path = _folder(spark)
    web.write_pages(_pages(spark, sf_dir).select("url", "title", "body_text", "links", "crawled_at_unix", "status").where("url IS NOT NULL"), path, 4)
    p = web.read_pages(spark, path)
    return p.groupBy("url").agg(F.count(F.lit(1)).alias("captures"), F.sum(F.length("body_text")).alias("chars"), F.sum(F.greatest(F.size("links"), F.lit(0))).alias("links"))


def signals_round_trip(spark, sf_dir):
    """Signals written as JSON lines and read again."""
    path = _folder(spark)
    s = read_table(spark, sf_dir, "page_signals")
    once = s.groupBy("url").agg(*(F.max(c).alias(c) for c in s.columns if c != "url")).withColumn("quality", F.nanvl("quality", F.lit(None)))
    web.write_signals(once, path)
    return web.read_signals(spark, path).select("url", "simhash", "inbound_domains", "is_duplicate")


def handoff(spark, sf_dir):
    """Links that belong to other shards, written and read again."""
    path = _folder(spark)
    links = latest_pages(_pages(spark, sf_dir)).select(F.explode("links").alias("l")).select(F.col("l.url").alias("url"))
    web.write_handoff(links, path, 8, -1)  # every address belongs to another shard
    return spark.read.text(path).select(F.col("value").alias("url"))


def places_round_trip(spark, sf_dir):
    """POIs stored by group and read again: the latest row of each."""
    path = _folder(spark)
    p = places.upsert_latest(read_table(spark, sf_dir, "poi"), "id", "ingested_at")
    web.write_table(p.withColumn("part", F.coalesce("poi_group", F.lit("none"))), path, partition_by="part")
    return spark.read.parquet(path).groupBy("poi_group").agg(F.count(F.lit(1)).alias("pois"), F.countDistinct("id").alias("ids"))


def place_kinds(spark, sf_dir):
    """The nine most frequent kinds of gazetteer places."""
    g = read_table(spark, sf_dir, "place_gazetteer").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names"))
    return g.orderBy(F.col("n").desc(), "kind").limit(9)


def document_counts(spark, sf_dir):
    """Documents of each table that is searched."""
    count = lambda t, c: read_table(spark, sf_dir, t).agg(F.countDistinct(c).alias("docs")).select(F.lit(t).alias("index"), "docs")
    return count("crawled_pages", "url").union(count("poi", "id")).union(count("place_gazetteer", "name"))


QUERIES = {
    f.__name__: f
    for f in (
        title_quality, tiles_for_query, seed_plan, mark_regions, gazetteer_seeded, directory_lookup, embedded_place, sub_hosts, fetch_budget, answer_scores, page_scores,
        control_links, label_menu, via_text, explain_trace, pages_round_trip, signals_round_trip, handoff, places_round_trip, place_kinds, document_counts,
    )
}

_LATEST = sq._LATEST
_ALNUM = r"'[^\p{L}\p{N}]', '', 'g'"
_TITLE = "CASE WHEN page_id % 2 = 0 THEN upper({h}) || ' - Home' ELSE title END"


def _line(c: str) -> str:
    return rf"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))"


_SHORT_CUT = r"regexp_replace(regexp_replace(said, '(.)\s*[(\[][^(\[]*$', '\1'), '[,:;\-–—\s]+$', '')"
_SHORT = rf"coalesce(nullif(array_to_string(list_filter(regexp_split_to_array({_SHORT_CUT}, '\s+'), lambda w: w <> '')[1:6], ' '), ''), said)"
_CONTROL = r"NOT (said LIKE '%.') AND NOT regexp_matches(said, '/ | /|\( | \)| ,| :|  ')"
_NX, _NY = 8192, 4096  # cells of five characters around the globe and from pole to pole
#: lat and lon are a circle's centre, i and j a cell's numbers; off is how far the centre is from the cell's.
_TILES = f"""g AS (SELECT DISTINCT lat, lon, 3000.0::DOUBLE AS r FROM place_gazetteer WHERE {pq._OK} {{where}}),
b AS (SELECT *, degrees(r / 6371008.8) AS dlat FROM g), b2 AS (SELECT *, least(180.0, dlat / greatest(1e-6, cos(radians(least(90.0, abs(lat) + dlat))))) AS dlon FROM b),
ys AS (SELECT *, unnest(generate_series(greatest(0, CAST(floor((lat - dlat + 90) / 180 * {_NY}) AS BIGINT) - 1), least({_NY - 1}, CAST(floor((lat + dlat + 90) / 180 * {_NY}) AS BIGINT) + 1))) AS j FROM b2),
xs AS (SELECT *, unnest(generate_series(CAST(floor((lon - dlon + 180) / 360 * {_NX}) AS BIGINT) - 1, CAST(floor((lon + dlon + 180) / 360 * {_NX}) AS BIGINT) + 1)) AS k FROM ys),
c AS (SELECT DISTINCT lat AS clat, lon AS clon, r, -90 + (j + 0.5) * 180.0 / {_NY} AS lat, -180 + (((k % {_NX}) + {_NX}) % {_NX} + 0.5) * 360.0 / {_NX} AS lon FROM xs),
o AS (SELECT *, clon - lon - round((clon - lon) / 360) * 360 AS off FROM c),
t AS (SELECT clat, clon, lat, lon, {pq._hash(5)} AS tile, abs(clat - lat) <= 90.0 / {_NY} AND abs(off) <= 180.0 / {_NX} AS home,
  {pq._dist('clat', '0.0', f'greatest(lat - 90.0 / {_NY}, least(lat + 90.0 / {_NY}, clat))', f'(off - greatest(-180.0 / {_NX}, least(180.0 / {_NX}, off)))')} AS d FROM o),
tiles AS (SELECT clat, clon, lat, lon, tile FROM t WHERE d <= 3000 OR home)"""
_PLATFORM = f"CASE WHEN {sq._domain('url')} IN ({rq._list(resolver.PLATFORMS)}) THEN 0.6::DOUBLE ELSE 1 END"
_DEPTH = f"CASE least(3, len(list_filter(string_split({rq._P}, '/'), lambda s: s <> ''))) " + " ".join(f"WHEN {i} THEN {v}::DOUBLE" for i, v in enumerate(resolver.DEPTH_PRIOR)) + " END"
_SEEKING = f"len(list_intersect({rq._words('q')}, [{rq._list(resolver.ORGANISATION)}])) > 0"
# the match before it is rounded
_MATCH = rq.ORACLE["match_scores"].replace(", 6) AS score FROM s", ", 15) AS score FROM s")
_WEIGHTS = f"CASE WHEN query_id % 2 = 0 THEN 1.25::DOUBLE ELSE 1 END * CASE WHEN {_SEEKING} THEN {_DEPTH} ELSE 1 END * {_PLATFORM}"
_SCORES = f"WITH ms AS ({_MATCH}), js AS (SELECT ms.*, q.q FROM ms JOIN (SELECT query_id, max(query_text) AS q FROM judgments GROUP BY query_id) q USING (query_id))"
_SLUG = rf"list_filter(regexp_split_to_array(lower({rq._P}), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) > 1 AND NOT regexp_full_match(w, '[0-9]+'))"

ORACLE = {
    "title_quality": f"""WITH {_LATEST}, x AS (SELECT url, {_TITLE.format(h=rq._H)} AS title, body_text, {rq._H} AS h FROM latest),
y AS (SELECT *, regexp_replace(lower(h), {_ALNUM}) AS bare, regexp_replace(lower(coalesce(title, '')), {_ALNUM}) AS said, {sq._WS} FROM x),
z AS (SELECT url, bare <> '' AND said <> '' AND starts_with(said, bare) AND strlen(said) <= strlen(bare) + 12 AS is_domain, CAST({sq._QUALITY} AS DOUBLE) AS q FROM y)
SELECT url, is_domain, round(q, 6) AS quality FROM z WHERE NOT is_domain AND q >= {resolver.QUALITY_FLOOR}""",
    "tiles_for_query": f"""WITH {_TILES.format(where='')} SELECT DISTINCT clat AS lat, clon AS lon, tile, round(lat, 6) AS tile_lat, round(lon, 6) AS tile_lon,
 round(1.05 * {pq._dist('lat', 'lon', f'(lat + 90.0 / {_NY})', f'(lon + 180.0 / {_NX})')}, 2) AS radius_m FROM tiles""",
    "seed_plan": f"""WITH {_TILES.format(where="AND kind = 'city'")},
m AS (SELECT {pq._hash(5)} AS tile, max({NOW} - population % 2 * {TTL}) AS seen FROM place_gazetteer WHERE kind = 'city' AND {pq._OK} GROUP BY 1),
n AS (SELECT count(DISTINCT tile) AS tiles FROM tiles WHERE tile NOT IN (SELECT tile FROM m WHERE {NOW} - seen < {TTL}))
SELECT tiles, tiles * 30 AS seconds FROM n""",
    "mark_regions": f"SELECT source, CASE WHEN max(CASE WHEN fetched_at % 2 = 0 THEN 1 ELSE 0 END) = 1 THEN {NOW} ELSE max(fetched_at) END AS fetched_at FROM covered_regions WHERE source IS NOT NULL GROUP BY source",
    "gazetteer_seeded": r"""WITH g AS (SELECT DISTINCT name, kind, lat, lon, population, country, trim(regexp_replace(lower(name), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) AS k FROM place_gazetteer WHERE name IS NOT NULL),
b AS (SELECT * FROM g UNION ALL SELECT * REPLACE ('suburb' AS kind) FROM g WHERE kind = 'town'), a AS (SELECT * REPLACE (population + 1 AS population) FROM g WHERE kind = 'city' AND k <> '')
SELECT kind, count(*) AS n, CAST(sum(population) AS BIGINT) AS people FROM (SELECT * FROM b WHERE k <> '' AND k NOT IN (SELECT k FROM a) UNION ALL SELECT * FROM a) GROUP BY kind""",
    "directory_lookup": rf"""WITH {pq._LATEST}, q AS (SELECT brand_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(brand_name), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: w <> '')) AS ws FROM brand_list),
p AS (SELECT id, concat_ws(' ', name, brand) AS t, list_filter(regexp_split_to_array(lower(concat_ws(' ', name, brand)), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: w <> '') AS ts FROM latest WHERE starts_with(website, 'http'))
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY length(t), id) AS INTEGER) AS place FROM q JOIN p ON list_has_all(ts, ws) WHERE len(ws) > 0 QUALIFY place <= 8""",
    "embedded_place": f"""WITH x AS ({pq.ORACLE['gazetteer_lookup']}),
n AS (SELECT DISTINCT name AS query_id FROM place_gazetteer WHERE name IS NOT NULL AND NOT regexp_matches(name, '\\s')),
co(c, ts) AS (VALUES {pq._values(places.CONCEPTS)}), cat(c) AS (VALUES {', '.join(f"('{c}')" for cs in places.GROUPS.values() for c in cs)}),
w AS (SELECT query_id, regexp_replace(query_id, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') AS token FROM n)
SELECT query_id, kind, lat, CASE kind {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in places.RADIUS_M.items())} ELSE 2500 END AS radius_m, 'Larkspur' AS subject, kind IN ('country', 'state') AS scope_too_broad
FROM w JOIN x USING (query_id) WHERE kind IN ({rq._list(places.SETTLED)}) AND strlen(token) >= 4 AND {pq._sing('lower(token)')} NOT IN (SELECT c FROM co UNION ALL SELECT c FROM cat)""",
    "sub_hosts": f"""WITH p AS (SELECT {sq._domain('url')} AS base, {sq._host('url')} AS host FROM crawled_pages), few AS (SELECT base FROM p WHERE base IS NOT NULL GROUP BY base HAVING count(*) < 5)
SELECT DISTINCT base, s || '.' || base AS host FROM p, (SELECT unnest([{rq._list(answers.SUBDOMAINS)}]) AS s)
WHERE base IS NOT NULL AND base NOT IN (SELECT base FROM few) AND s || '.' || base IN (SELECT host FROM p WHERE host IS NOT NULL)""",
    "fetch_budget": f"""WITH j AS (SELECT DISTINCT query_id, url FROM judgments),
r AS (SELECT DISTINCT query_id, nullif({rq._H}, '') AS host FROM j WHERE query_id % 3 = 0), g AS (SELECT DISTINCT query_id, {sq._domain('url')} AS host FROM j),
b AS (SELECT query_id, host, max(rec) AS rec FROM (SELECT query_id, host, 1 AS rec FROM r UNION ALL SELECT query_id, host, 0 FROM g) WHERE host IS NOT NULL GROUP BY query_id, host),
gs AS (SELECT query_id, host, 1 AS also FROM g WHERE host IS NOT NULL),
o AS (SELECT b.query_id, b.host, rec, row_number() OVER (PARTITION BY b.query_id ORDER BY CASE WHEN rec = 1 THEN length(b.host) END NULLS LAST, CASE WHEN also = 1 THEN length(b.host) END NULLS LAST, b.host) AS place FROM b LEFT JOIN gs USING (query_id, host)),
q AS (SELECT query_id, unnest({rq._words('q')}) AS w FROM (SELECT query_id, max(query_text) AS q FROM judgments GROUP BY query_id)), tok AS (SELECT query_id, {rq._KIND} AS kind, {rq._FORMS} AS forms FROM q),
cover AS (SELECT o.query_id, host, count(*) >= 2 AND bool_and(len(list_filter(forms, lambda f: contains(host, f))) > 0) AS spelt FROM o JOIN tok ON tok.query_id = o.query_id AND kind IN ('Distinctive', 'Place') GROUP BY o.query_id, host),
k AS (SELECT o.*, CASE WHEN rec = 1 THEN 1 WHEN spelt THEN 0 ELSE 2 END AS kind FROM o LEFT JOIN cover USING (query_id, host)),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY place, host) AS r FROM k)
SELECT query_id, host, CAST(row_number() OVER (PARTITION BY query_id ORDER BY kind, r) AS INTEGER) AS place FROM n WHERE r <= CASE kind WHEN 1 THEN 10 WHEN 2 THEN 6 ELSE 16 END QUALIFY place <= 16""",
    "answer_scores": f"{_SCORES} SELECT query_id, url, round(least(1.0::DOUBLE, score * (0.85::DOUBLE + 0.15::DOUBLE * CASE WHEN query_id % 3 = 0 THEN 0.5::DOUBLE ELSE 1 END) * {_WEIGHTS}), 6) AS score FROM js",
    "page_scores": rf"""{_SCORES}, sl AS (SELECT *, {_SLUG} AS s, ['news', 'food'] AS ws FROM js),
h AS (SELECT *, len(list_filter(ws, lambda w: list_contains(s, w) OR list_contains(s, w || 's') OR list_contains(list_transform(s, lambda z: z || 's'), w))) AS hits FROM sl),
k AS (SELECT *, CASE WHEN len(s) = 0 THEN 0 ELSE least(1.0::DOUBLE, (hits / 2) * (hits / 2) * (0.6::DOUBLE + 0.4::DOUBLE * least(1.0::DOUBLE, 2 / len(s))) * CASE WHEN contains(' ' || array_to_string(s, ' ') || ' ', ' news food ') THEN 1.25::DOUBLE ELSE 1 END) END AS slug FROM h)
SELECT query_id, url, round(least(1.0::DOUBLE, score * (0.8::DOUBLE + 0.2::DOUBLE * slug) * {_WEIGHTS}), 6) AS score FROM k""",
    "control_links": rf"""WITH {_LATEST}, l AS (SELECT DISTINCT url, body_text, l.text AS label FROM (SELECT url, body_text, unnest(links) AS l FROM latest) WHERE l.text IS NOT NULL),
x AS (SELECT *, {_line('label')} AS said, {_line('body_text')} AS body FROM l), y AS (SELECT *, {_SHORT} AS short, {_CONTROL} AS is_control FROM x)
SELECT label, short, is_control, count(*) FILTER (said <> '' AND is_control AND contains(body, short)) AS linked, count(*) AS pages FROM y GROUP BY label, short, is_control""",
    "label_menu": rf"""WITH {_LATEST}, l AS (SELECT url, body_text, unnest(links).text AS label, generate_subscripts(links, 1) AS k FROM latest),
x AS (SELECT url, {_line('label')} AS said, {_line('body_text')} AS body, k FROM l), y AS (SELECT url, said AS label, min(k) AS k FROM x WHERE length(said) BETWEEN 3 AND 60 AND {_CONTROL} AND contains(body, said) GROUP BY url, said)
SELECT url, label, CAST(row_number() OVER (PARTITION BY url ORDER BY k, label) AS INTEGER) AS place FROM y QUALIFY place <= 60""",
    "via_text": """WITH x AS (SELECT brand_id, CASE brand_id % 4 WHEN 0 THEN 'OpenStreetMap lists this as ' || brand_name || '''s website' WHEN 1 THEN 'Wikidata lists this as ' || brand_name || '''s official website'
 WHEN 2 THEN 'found in the crawl web index' ELSE CASE WHEN brand_id % 8 = 3 THEN 'read "' || lower(brand_name) || '" as the site and "menu" as the page' ELSE 'guessed the site from "' || lower(brand_name) || '"' END END AS via FROM brand_list)
SELECT brand_id, via, CASE WHEN length(via) <= 30 THEN via ELSE left(via, 29) || '…' END AS shown FROM x""",
    "pages_round_trip": "SELECT url, count(*) AS captures, CAST(sum(length(body_text)) AS BIGINT) AS chars, CAST(sum(coalesce(len(links), 0)) AS BIGINT) AS links FROM crawled_pages WHERE status = 200 AND url IS NOT NULL GROUP BY url",
    "signals_round_trip": "SELECT url, max(simhash) AS simhash, max(inbound_domains) AS inbound_domains, max(is_duplicate) AS is_duplicate FROM page_signals WHERE url IS NOT NULL GROUP BY url",
    "handoff": f"WITH {_LATEST}, l AS (SELECT DISTINCT unnest(links).url AS url FROM latest) SELECT url FROM l WHERE url IS NOT NULL",
    "places_round_trip": f"WITH {pq._LATEST} SELECT poi_group, count(*) AS pois, count(DISTINCT id) AS ids FROM latest GROUP BY poi_group",
    "place_kinds": "SELECT kind, count(*) AS n, count(DISTINCT name) AS names FROM place_gazetteer GROUP BY kind ORDER BY n DESC, kind LIMIT 9",
    "document_counts": "SELECT 'crawled_pages' AS index, count(DISTINCT url) AS docs FROM crawled_pages UNION ALL SELECT 'poi', count(DISTINCT id) FROM poi UNION ALL SELECT 'place_gazetteer', count(DISTINCT name) FROM place_gazetteer",
}
