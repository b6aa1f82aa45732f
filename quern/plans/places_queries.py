"""Queries of geography and places, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import geo
from quern.operators import places
from quern.operators.proximity import great_circle_m, usable_position
from quern.session import read_table

#: Queries as people type them; the words are everyday English.
TEXTS = [
    "cafes near me", "petrol pump", "cheap food nearby", "best coffee shop in town", "Larkspur Dental Institute", "pharmacies around here", "gas station",
    "dry cleaner", "Velmora hospital", "quillbert", "shops in arcade in tesserin", "in ovaldrin", "police station near here", "churches", "bus stand", "glass",
    "new open gym", "Ostrafel Electronics", "hotels walking distance", "24x7 medical store",
]
PLACE_WORDS = ["velmora", "ovaldrin", "tesserin", "town"]
NOW = 1_735_600_000
TTL = 30 * 86_400


def _texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS, 1)), "query_id int, q string")


def _poi(spark, sf_dir):
    return read_table(spark, sf_dir, "poi")


def _placed(spark, sf_dir):
    return _poi(spark, sf_dir).where(usable_position(F.col("lat"), F.col("lon"))).select("id", "lat", "lon").distinct()


def haversine(spark, sf_dir):
    """Distance of each POI from a fixed point."""
    return _placed(spark, sf_dir).select("id", F.round(great_circle_m(F.lit(12.9716), F.lit(77.5946), F.col("lat"), F.col("lon")), 3).alias("distance_m"))


def geohash(spark, sf_dir):
    """Geohashes of 9 and 5 characters, and the centre of the cell of 5."""
    p = _placed(spark, sf_dir).select("id", "lat", "lon", geo.geohash(F.col("lat"), F.col("lon"), 9).alias("g9"), geo.geohash(F.col("lat"), F.col("lon"), 5).alias("g5"))
    box = geo.geohash_box(F.col("g5"))
    return p.select("id", "g9", "g5", F.round(box["lat"], 6).alias("centre_lat"), F.round(box["lon"], 6).alias("centre_lon"), F.element_at(geo.prefixes(F.col("g9")), 2).alias("p4"))


def radius_join(spark, sf_dir):
    """POIs within 5 km of each city and town of the gazetteer, with distance decay."""
    g = read_table(spark, sf_dir, "place_gazetteer").where(F.col("kind").isin("city", "town") & usable_position(F.col("lat"), F.col("lon")))
    q = g.groupBy("name", "kind", "lat", "lon").count().select(F.concat_ws("|", "name", "kind", F.floor(F.col("lat") * 1000), F.floor(F.col("lon") * 1000)).alias("query_id"), F.col("lat").alias("qlat"), F.col("lon").alias("qlon"), F.lit(5000.0).alias("radius_m"), F.lit(geo.precision_for_radius(5000.0, 20.0)).alias("precision"))
    found = places.within_radius(_placed(spark, sf_dir), q, [geo.precision_for_radius(5000.0, 20.0)])
    return found.select("query_id", "id", F.round("distance_m", 3).alias("distance_m"), F.round(geo.distance_decay(F.col("distance_m"), F.lit(2000.0)), 6).alias("decay"))


def category_groups(spark, sf_dir):
    return _poi(spark, sf_dir).groupBy(F.col("category"), places.group_for(F.col("category")).alias("grp")).agg(F.countDistinct("id").alias("pois"))


def categorise_tags(spark, sf_dir):
    """Category from tag maps made of the POIs' categories."""
    tags = F.map_from_arrays(F.array(F.lit("highway"), F.lit("amenity"), F.lit("tourism")), F.array(F.lit("x"), F.coalesce("category", F.lit("yes")), F.coalesce("poi_group", F.lit("yes"))))
    return places.upsert_latest(_poi(spark, sf_dir), "id", "ingested_at").select("id", places.categorise(tags).alias("derived"))


def prominence(spark, sf_dir):
    p = places.upsert_latest(_poi(spark, sf_dir), "id", "ingested_at")
    return p.groupBy(F.round(places.prominence(F.col("website"), F.col("phone"), F.col("opening_hours"), F.col("address")), 2).alias("completeness")).agg(F.count(F.lit(1)).alias("pois"))


def poi_upsert_latest(spark, sf_dir):
    """One row a POI: the latest delivery."""
    return places.upsert_latest(_poi(spark, sf_dir), "id", "ingested_at").select("id", "name", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


def extent(spark, sf_dir):
    """Bounding box and number of tiles of each extract."""
    p = _poi(spark, sf_dir).where(usable_position(F.col("lat"), F.col("lon")))
    return p.groupBy("region_source").agg(*(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lat", "lon")), F.countDistinct(geo.geohash(F.col("lat"), F.col("lon"), 5)).alias("tiles"))


def synonym_expand(spark, sf_dir):
    return _texts(spark).select("query_id", F.array_join(places.expand(F.col("q")), " ").alias("terms"))


def query_intent(spark, sf_dir):
    """Local intent, routing, the query without its markers, and the parts of "in" clauses."""
    c = places.split_in_clause(F.col("q"))
    return _texts(spark).select("query_id", places.has_local_intent(F.col("q")).alias("local"), places.route(F.col("q")).alias("route"), places.strip_local_markers(F.col("q")).alias("stripped"), c["subject"].alias("subject"), c["place"].alias("place"))


def distinctive_filter(spark, sf_dir):
    known = F.array(*map(F.lit, PLACE_WORDS))
    return _texts(spark).select("query_id", F.array_join(places.distinctive_terms(F.col("q"), known), " ").alias("terms"))


def gazetteer_lookup(spark, sf_dir):
    """Every name of the gazetteer looked up near a fixed point."""
    g = read_table(spark, sf_dir, "place_gazetteer")
    asked = g.select("name").distinct().select(F.col("name").alias("query_id"), "name", F.lit(9.0).alias("lat"), F.lit(72.0).alias("lon"))
    return places.gazetteer_lookup(asked, g).select("query_id", "kind", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "population", F.round("score", 3).alias("score"))


def nearby_topk(spark, sf_dir):
    """Searches near points and in named places."""
    g = read_table(spark, sf_dir, "place_gazetteer")
    city = g.where("kind = 'city'").select("name").distinct()
    q = city.select(F.concat(F.lit("cafes in "), "name").alias("query_text"), F.lit(9.0).alias("lat"), F.lit(72.0).alias("lon"), F.lit(None).cast("double").alias("radius_m"))
    q = q.select(F.col("query_text").alias("query_id"), "*").union(spark.createDataFrame([("hotel near me", "hotel near me", 8.75, 71.1, 3000.0), ("petrol pump", "petrol pump", 8.7, 68.7, None)], "query_id string, query_text string, lat double, lon double, radius_m double"))
    return places.nearby(spark, _poi(spark, sf_dir), g, q)


def stale_tiles(spark, sf_dir):
    """Tiles of the gazetteer's places that no fresh region covers."""
    g = read_table(spark, sf_dir, "place_gazetteer").where(usable_position(F.col("lat"), F.col("lon")))
    tiles = g.select(geo.geohash(F.col("lat"), F.col("lon"), 5).alias("tile")).distinct()
    box = geo.geohash_box(F.col("tile"))
    t = tiles.select("tile", box["lat"].alias("lat"), box["lon"].alias("lon"))
    return places.stale_tiles(t, spark.createDataFrame([], "tile string, fetched_at long"), read_table(spark, sf_dir, "covered_regions"), NOW, TTL).select("tile")


def cell_coverings(spark, sf_dir):
    """Cells of 6 characters around each region's corner, counted."""
    r = read_table(spark, sf_dir, "covered_regions")
    return r.select("source", F.size(geo.cells_covering(F.col("min_lat"), F.col("min_lon"), F.lit(800.0), 6)).alias("cells"))


QUERIES = {
    f.__name__: f
    for f in (
        haversine, geohash, radius_join, category_groups, categorise_tags, prominence, poi_upsert_latest, extent, synonym_expand, query_intent,
        distinctive_filter, gazetteer_lookup, nearby_topk, stale_tiles, cell_coverings,
    )
}

_OK = "lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT isnan(lat) AND NOT isnan(lon) AND NOT (lat = 0 AND lon = 0)"


def _dist(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


def _hash(precision: int) -> str:
    nx, ny = (5 * precision + 1) // 2, 5 * precision // 2
    ax = f"CAST(least({(1 << nx) - 1}, greatest(0, ceil((lon + 180.0) / 360.0 * {1 << nx}) - 1)) AS BIGINT)"
    ay = f"CAST(least({(1 << ny) - 1}, greatest(0, ceil((lat + 90.0) / 180.0 * {1 << ny}) - 1)) AS BIGINT)"
    out = []
    for c in range(precision):
        bits = [f"((({ax if t % 2 == 0 else ay}) >> {(nx if t % 2 == 0 else ny) - 1 - t // 2}) & 1)" for t in range(5 * c, 5 * c + 5)]
        value = " + ".join(f"{b} * {1 << (4 - i)}" for i, b in enumerate(bits))
        out.append(f"substr('{geo.BASE32}', CAST({value} AS INTEGER) + 1, 1)")
    return "concat(" + ", ".join(out) + ")"


def _values(d: dict, sep: str = " ") -> str:
    return ", ".join(f"('{k}', '{sep.join(v) if isinstance(v, list) else v}')" for k, v in d.items())


_GROUP = "CASE " + " ".join(f"WHEN category IN ({', '.join(repr(c) for c in cs)}) THEN '{g}'" for g, cs in places.GROUPS.items()) + " ELSE 'other' END"
_LATEST = """latest AS (SELECT * FROM poi WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) = 1)"""
_RANK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in places.RANK.items()) + " ELSE 1 END"
_TEXT_ROWS = "t(query_id, q) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(TEXTS, 1)) + ")"
_QW = r"list_filter(list_transform(regexp_split_to_array(lower(q), '\s+'), lambda w: regexp_replace(w, '^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$', '', 'g')), lambda w: w <> '')"


def _sing(w: str) -> str:
    return f"""CASE WHEN strlen({w}) <= 3 THEN {w} WHEN {w} LIKE '%ies' THEN regexp_replace({w}, 'ies$', 'y') WHEN regexp_matches({w}, '(ch|sh|s|x|z)es$') THEN regexp_replace({w}, 'es$', '')
 WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN regexp_replace({w}, 's$', '') ELSE {w} END"""


_STRIP = "lower(q)"
for _m in places.CUT_MARKERS:
    _STRIP = f"replace({_STRIP}, '{_m}', ' ')"

ORACLE = {
    "haversine": f"SELECT DISTINCT id, round({_dist('12.9716', '77.5946', 'lat', 'lon')}, 3) AS distance_m FROM (SELECT DISTINCT id, lat, lon FROM poi WHERE {_OK})",
    "geohash": f"""WITH p AS (SELECT DISTINCT id, lat, lon FROM poi WHERE {_OK})
SELECT id, {_hash(9)} AS g9, {_hash(5)} AS g5,
 round(-90 + (CAST(least(4095, greatest(0, ceil((lat + 90.0) / 180.0 * 4096) - 1)) AS BIGINT) + 0.5) * 180.0 / 4096, 6) AS centre_lat,
 round(-180 + (CAST(least(8191, greatest(0, ceil((lon + 180.0) / 360.0 * 8192) - 1)) AS BIGINT) + 0.5) * 360.0 / 8192, 6) AS centre_lon, substr({_hash(5)}, 1, 4) AS p4 FROM p""",
    "radius_join": f"""WITH p AS (SELECT DISTINCT id, lat, lon FROM poi WHERE {_OK}),
g AS (SELECT DISTINCT name, kind, lat, lon FROM place_gazetteer WHERE kind IN ('city', 'town') AND {_OK}),
d AS (SELECT concat_ws('|', name, kind, CAST(CAST(floor(g.lat * 1000) AS BIGINT) AS VARCHAR), CAST(CAST(floor(g.lon * 1000) AS BIGINT) AS VARCHAR)) AS query_id, p.id, {_dist('g.lat', 'g.lon', 'p.lat', 'p.lon')} AS d FROM g JOIN p ON abs(g.lat - p.lat) < 0.05)
SELECT query_id, id, round(d, 3) AS distance_m, round(exp(-d / 2000.0), 6) AS decay FROM d WHERE d <= 5000""",
    "category_groups": f"SELECT category, {_GROUP} AS grp, count(DISTINCT id) AS pois FROM poi GROUP BY ALL",
    "categorise_tags": f"WITH {_LATEST} SELECT id, coalesce(nullif(coalesce(category, 'yes'), 'yes'), nullif(coalesce(poi_group, 'yes'), 'yes')) AS derived FROM latest",
    "prominence": f"""WITH {_LATEST} SELECT round(CASE WHEN coalesce(website, '') <> '' THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN coalesce(phone, '') <> '' THEN 0.25 ELSE 0 END
 + CASE WHEN coalesce(opening_hours, '') <> '' THEN 0.20 ELSE 0 END + CASE WHEN coalesce(address, '') <> '' THEN 0.20 ELSE 0 END, 2) AS completeness, count(*) AS pois FROM latest GROUP BY 1""",
    "poi_upsert_latest": f"WITH {_LATEST} SELECT id, name, strftime(ingested_at, '%Y-%m-%d %H:%M:%S') AS at FROM latest",
    "extent": f"""SELECT region_source, min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon, count(DISTINCT {_hash(5)}) AS tiles
FROM poi WHERE {_OK} GROUP BY region_source""",
    "synonym_expand": f"""WITH {_TEXT_ROWS}, w AS (SELECT query_id, {_QW} AS ws FROM t), ph(p, ts) AS (VALUES {_values(places.PHRASES)}), co(c, ts) AS (VALUES {_values(places.CONCEPTS)}),
n AS (SELECT query_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
parts AS (
 SELECT query_id, 1 AS k, i, 0 AS j, ws[i] AS t FROM n
 UNION ALL SELECT query_id, 2, i, generate_subscripts(string_split(ts, ' '), 1), unnest(string_split(ts, ' ')) FROM n JOIN ph ON p = ws[i] || ' ' || ws[i + 1]
 UNION ALL SELECT query_id, 3, i, 0, {_sing('ws[i]')} FROM n
 UNION ALL SELECT query_id, 3, i, generate_subscripts(string_split(ts, ' '), 1), unnest(string_split(ts, ' ')) FROM n JOIN co ON c = {_sing('ws[i]')}),
firsts AS (SELECT query_id, t, min(k * 1000000 + i * 1000 + j) AS o FROM parts WHERE t IS NOT NULL GROUP BY query_id, t)
SELECT query_id, string_agg(t, ' ' ORDER BY o) AS terms FROM firsts GROUP BY query_id""",
    "query_intent": rf"""WITH {_TEXT_ROWS},
x AS (SELECT query_id, q, {' OR '.join(f"contains(lower(q), '{m}')" for m in places.LOCAL_MARKERS)} AS local, regexp_extract(trim(lower(q)), '^in\s+(.+)$', 1) AS lead,
 trim(regexp_extract(trim(lower(q)), '^(.*) in (.+)$', 1)) AS s, trim(regexp_extract(trim(lower(q)), '^(.*) in (.+)$', 2)) AS p FROM t)
SELECT query_id, local, CASE WHEN local OR contains(lower(q), ' in ') THEN 'local' ELSE 'both' END AS route, trim(regexp_replace({_STRIP}, '\s+', ' ', 'g')) AS stripped,
 CASE WHEN lead <> '' AND NOT contains(lead, ' in ') THEN '' WHEN p <> '' THEN s END AS subject, CASE WHEN lead <> '' AND NOT contains(lead, ' in ') THEN trim(lead) WHEN p <> '' THEN p END AS place FROM x""",
    "distinctive_filter": f"""WITH {_TEXT_ROWS}, w AS (SELECT query_id, {_QW} AS ws FROM t), ph(p, ts) AS (VALUES {_values(places.PHRASES)}), co(c, ts) AS (VALUES {_values(places.CONCEPTS)}),
cat(category) AS (VALUES {', '.join(f"('{c}')" for cs in places.GROUPS.values() for c in cs)}),
n AS (SELECT query_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT query_id, i, ws[i] AS t FROM n WHERE coalesce(ws[i] || ' ' || ws[i + 1], '') NOT IN (SELECT p FROM ph) AND (i = 1 OR ws[i - 1] || ' ' || ws[i] NOT IN (SELECT p FROM ph))
 AND strlen(ws[i]) > 2 AND ws[i] NOT IN ({', '.join(repr(m) for m in places.MODIFIERS)}) AND {_sing('ws[i]')} NOT IN (SELECT c FROM co) AND {_sing('ws[i]')} NOT IN (SELECT category FROM cat)
 AND ws[i] NOT IN ({', '.join(repr(m) for m in PLACE_WORDS)}))
SELECT t.query_id, coalesce(string_agg(k.t, ' ' ORDER BY i), '') AS terms FROM t LEFT JOIN k USING (query_id) GROUP BY t.query_id""",
    "gazetteer_lookup": rf"""WITH g AS (SELECT DISTINCT trim(regexp_replace(lower(name), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g')) AS key, name, kind, lat, lon, population FROM place_gazetteer WHERE {_OK}),
a AS (SELECT DISTINCT name AS query_id, trim(regexp_replace(lower(name), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g')) AS key FROM place_gazetteer),
s AS (SELECT query_id, kind, lat, lon, population, round({_RANK} * 1000.0 + sqrt(CAST(coalesce(population, 0) AS DOUBLE)) + 4000 * exp(-{_dist('9.0', '72.0', 'lat', 'lon')} / 50000.0), 6) AS score FROM a JOIN g USING (key) WHERE key <> '')
SELECT query_id, kind, round(lat, 6) AS lat, round(lon, 6) AS lon, population, round(score, 3) AS score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, population DESC, lat, lon, kind) = 1""",
    "stale_tiles": f"""WITH t AS (SELECT DISTINCT {_hash(5)} AS tile,
 -90 + (CAST(least(4095, greatest(0, ceil((lat + 90.0) / 180.0 * 4096) - 1)) AS BIGINT) + 0.5) * 180.0 / 4096 AS tlat,
 -180 + (CAST(least(8191, greatest(0, ceil((lon + 180.0) / 360.0 * 8192) - 1)) AS BIGINT) + 0.5) * 360.0 / 8192 AS tlon FROM place_gazetteer WHERE {_OK})
SELECT tile FROM t WHERE NOT EXISTS (SELECT 1 FROM covered_regions r WHERE {NOW} - fetched_at < {TTL} AND tlat BETWEEN min_lat AND max_lat
 AND CASE WHEN min_lon > max_lon THEN tlon >= min_lon OR tlon <= max_lon ELSE tlon BETWEEN min_lon AND max_lon END)""",
}
