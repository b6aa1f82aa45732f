"""Places: categories, prominence, query words, gazetteer, and searches near a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.geo import cells_covering, distance_decay, geohash, tile_bounds, tiles_for_circle
from quern.functions.text import normalise_name
from quern.operators.proximity import great_circle_m, usable_position
from quern.session import bounded_broadcast

#: Tag keys of places, the most telling first.
PLACE_KEYS = ["amenity", "shop", "tourism", "leisure", "healthcare", "office"]
#: Coarse groups of categories.
GROUPS = {
    "food": ["restaurant", "cafe", "fast_food", "bar", "pub", "food_court", "ice_cream", "bakery", "confectionery"],
    "health": ["hospital", "clinic", "doctors", "pharmacy", "dentist", "veterinary"],
    "money": ["atm", "bank", "bureau_de_change", "money_transfer"],
    "vehicle": ["fuel", "charging_station", "car_repair", "car_wash", "parking"],
    "education": ["school", "college", "university", "library", "kindergarten"],
    "grocery": ["supermarket", "convenience", "grocery", "greengrocer", "mall", "department_store"],
    "stay": ["hotel", "guest_house", "hostel", "motel", "apartment"],
    "civic": ["police", "fire_station", "post_office", "townhall", "courthouse"],
    "transport": ["bus_station", "railway_station", "airport", "taxi", "ferry_terminal"],
    "recreation": ["park", "garden", "playground", "sports_centre", "fitness_centre", "gym", "swimming_pool", "stadium"],
    "worship": ["temple", "place_of_worship", "mosque", "church", "gurudwara"],
    "attraction": ["museum", "attraction", "viewpoint", "zoo", "theme_park", "artwork"],
}
#: Two-word phrases that name one category.
PHRASES = {
    "petrol pump": ["fuel"], "gas station": ["fuel"], "filling station": ["fuel"], "petrol station": ["fuel"],
    "medical store": ["pharmacy"], "medical shop": ["pharmacy"], "coffee shop": ["cafe"],
    "car repair": ["car_repair"], "car mechanic": ["car_repair"], "auto repair": ["car_repair"],
    "dry cleaner": ["laundry", "dry_cleaning"], "dry cleaning": ["laundry", "dry_cleaning"],
    "bus stand": ["bus_station", "bus_stop"], "bus stop": ["bus_station", "bus_stop"],
    "railway station": ["railway_station", "station"], "train station": ["railway_station", "station"],
    "police station": ["police"], "post office": ["post_office"],
    "departmental store": ["department_store", "supermarket"], "department store": ["department_store", "supermarket"],
}
#: Words of queries and the categories they ask for.
CONCEPTS = {
    "coffee": ["cafe", "coffee_shop"], "cafe": ["cafe"], "tea": ["cafe", "tea_house"], "chai": ["cafe", "tea_house"],
    "food": ["restaurant", "fast_food", "cafe", "food_court"], "eat": ["restaurant", "fast_food", "food_court"],
    "hungry": ["restaurant", "fast_food", "food_court"], "lunch": ["restaurant", "fast_food", "food_court"],
    "dinner": ["restaurant", "bar", "pub"], "breakfast": ["cafe", "restaurant", "bakery"], "drinks": ["bar", "pub", "biergarten"],
    "bakery": ["bakery", "pastry"], "sweets": ["confectionery", "bakery"],
    "doctor": ["doctors", "clinic", "hospital"], "physician": ["doctors", "clinic"], "medical": ["pharmacy", "clinic", "doctors", "hospital"],
    "medicine": ["pharmacy", "chemist"], "chemist": ["pharmacy"], "druggist": ["pharmacy"], "drugstore": ["pharmacy"],
    "emergency": ["hospital", "clinic"], "dentist": ["dentist"], "vet": ["veterinary"], "lab": ["laboratory", "clinic"],
    "cash": ["atm", "bank"], "money": ["atm", "bank", "bureau_de_change"], "atm": ["atm"], "exchange": ["bureau_de_change", "bank"],
    "petrol": ["fuel"], "diesel": ["fuel"], "gas": ["fuel"], "fuel": ["fuel"], "charging": ["charging_station"], "ev": ["charging_station"],
    "mechanic": ["car_repair"], "repair": ["car_repair", "electronics_repair"], "garage": ["car_repair"], "stationery": ["stationery", "books"],
    "laundry": ["laundry", "dry_cleaning"], "optician": ["optician"], "jeweller": ["jewelry"], "florist": ["florist"],
    "hardware": ["hardware", "doityourself"], "puncture": ["car_repair", "tyres"], "parking": ["parking"],
    "grocery": ["supermarket", "convenience", "greengrocer"], "groceries": ["supermarket", "convenience", "greengrocer"],
    "kirana": ["convenience", "supermarket"], "supermarket": ["supermarket"], "mall": ["mall", "department_store"],
    "shopping": ["mall", "department_store", "supermarket"], "clothes": ["clothes", "boutique"], "salon": ["hairdresser", "beauty"],
    "barber": ["hairdresser"], "hotel": ["hotel", "guest_house"], "stay": ["hotel", "guest_house", "hostel"],
    "lodge": ["hotel", "guest_house", "hostel"], "bus": ["bus_station", "bus_stop"], "train": ["railway_station", "station"],
    "metro": ["subway", "station"], "airport": ["airport", "aerodrome"], "taxi": ["taxi"], "police": ["police"], "post": ["post_office"],
    "school": ["school"], "college": ["college", "university"], "library": ["library"], "gym": ["fitness_centre", "gym", "sports_centre"],
    "fitness": ["fitness_centre", "gym"], "workout": ["fitness_centre", "gym"], "park": ["park", "garden"],
    "temple": ["place_of_worship", "temple"], "church": ["place_of_worship", "church"], "mosque": ["place_of_worship", "mosque"],
    "gurudwara": ["place_of_worship"], "worship": ["place_of_worship"], "movie": ["cinema"], "cinema": ["cinema"], "museum": ["museum"],
}
#: Words that qualify a place without naming it.
MODIFIERS = [
    "cheap", "best", "good", "top", "great", "nice", "affordable", "budget", "expensive", "luxury", "new", "old", "open", "24x7", "nearby",
    "local", "famous", "popular", "big", "small", "quick", "fast",
]
#: Phrases that ask for something near, and what is cut from such queries.
LOCAL_MARKERS = ["near me", "nearby", "near by", "around me", "close to me", "closest", "nearest", "near here", "in my area", "walking distance", "around here"]
CUT_MARKERS = [*LOCAL_MARKERS, "near", "around"]
#: Search radius and precedence of settlement kinds.
RADIUS_M = {
    "country": 50_000.0, "state": 50_000.0, "city": 12_000.0, "town": 6_000.0, "suburb": 3_000.0, "quarter": 3_000.0, "borough": 3_000.0,
    "neighbourhood": 2_000.0, "city_block": 2_000.0, "village": 2_500.0, "hamlet": 1_500.0, "isolated_dwelling": 1_500.0,
}
RANK = {"country": 11, "state": 10, "city": 9, "town": 8, "suburb": 7, "borough": 6, "quarter": 6, "neighbourhood": 5, "village": 4, "locality": 3, "hamlet": 2}


def _map(d: dict) -> Column:
    return F.create_map(*(F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)) for k, v in d.items() for x in (k, v)))


def group_for(category: Column) -> Column:
    """Coarse group of a category; ``other`` without one."""
    return F.coalesce(_map({c: g for g, cs in GROUPS.items() for c in cs})[category], F.lit("other"))


def categorise(tags: Column) -> Column:
    """Category from a map of tags: the first telling key whose value is not ``yes``; NULL if none."""
    return F.coalesce(*(F.nullif(tags[k], F.lit("yes")) for k in PLACE_KEYS))


def prominence(website: Column, phone: Column, hours: Column, address: Column) -> Column:
    """Completeness of a place's details, 0 to 1; NULL and empty count as missing."""
    has = lambda c, w: F.when(F.coalesce(c, F.lit("")) != "", w).otherwise(0.0)
    return has(website, 0.35) + has(phone, 0.25) + has(hours, 0.20) + has(address, 0.20)


def singular(word: Column) -> Column:
    """Singular of a word of more than three bytes, well enough for the concept table."""
    return (
        F.when(F.octet_length(word) <= 3, word)
        .when(word.endswith("ies"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(ch|sh|s|x|z)es$"), F.regexp_replace(word, "es$", ""))
        .when(word.endswith("s") & ~word.endswith("ss"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def query_words(query: Column) -> Column:
    """Lower-case words of a query without signs at their ends."""
    bare = F.transform(F.split(F.lower(F.coalesce(query, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$", ""))
    return F.filter(bare, lambda w: w != "")


def _pairs(words: Column) -> Column:
    n = F.size(words)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.element_at(words, i), F.get(words, i)))).otherwise(F.array().cast("array<string>"))


def expand(query: Column) -> Column:
    """The query's words, then what its phrases, singulars and concepts add, each once, in that order."""
    words = query_words(query)
    none = F.array().cast("array<string>")
    phrases = F.flatten(F.transform(_pairs(words), lambda p: F.coalesce(_map(PHRASES)[p], none)))
    single = F.flatten(F.transform(words, lambda w: F.concat(F.array(singular(w)), F.coalesce(_map(CONCEPTS)[singular(w)], none))))
    return F.array_distinct(F.concat(words, phrases, single))


def is_category_word(word: Column) -> Column:
    key = singular(F.lower(word))
    return F.map_contains_key(_map(CONCEPTS), key) | (group_for(key) != "other")


def distinctive_terms(query: Column, place_names: Column) -> Column:
    """Words that name a place: no phrase parts, no words of two bytes or less, modifiers, categories or place names."""
    words = query_words(query)
    known = F.map_keys(_map(PHRASES))
    in_phrase = lambda i: F.array_contains(known, F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))) | F.array_contains(known, F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    alone = F.filter(words, lambda w, i: ~F.coalesce(in_phrase(i), F.lit(False)))
    return F.filter(alone, lambda w: (F.octet_length(w) > 2) & ~w.isin(MODIFIERS) & ~is_category_word(w) & ~F.array_contains(place_names, w))


def distinctive_match_ok(name: Column, brand: Column, terms: Column) -> Column:
    """More than half of the terms stand in name and brand; true without terms."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(brand, F.lit(""))))
    return F.when(F.size(terms) == 0, True).otherwise(F.size(F.filter(terms, lambda t: F.contains(hay, t))) / F.size(terms) > 0.5)


def has_local_intent(query: Column) -> Column:
    return F.exists(F.array(*map(F.lit, LOCAL_MARKERS)), lambda m: F.contains(F.lower(query), m))


def strip_local_markers(query: Column) -> Column:
    q = F.lower(query)
    for m in CUT_MARKERS:
        q = F.replace(q, F.lit(m), F.lit(" "))
    return F.trim(F.regexp_replace(q, r"\s+", " "))


def split_in_clause(query: Column) -> Column:
    """struct(subject, place) of "subject in place": the last " in " parts them; a leading "in place" has no subject; NULL without."""
    q = F.trim(F.lower(query))
    lead = F.regexp_extract(q, r"^in\s+(.+)$", 1)
    leading = (lead != "") & ~F.contains(lead, F.lit(" in "))
    s, p = F.trim(F.regexp_extract(q, r"^(.*) in (.+)$", 1)), F.trim(F.regexp_extract(q, r"^(.*) in (.+)$", 2))
    return F.when(leading, F.struct(F.lit("").alias("subject"), F.trim(lead).alias("place"))).when(p != "", F.struct(s.alias("subject"), p.alias("place")))


def default_radius_m(kind: Column) -> Column:
    return F.coalesce(_map(RADIUS_M)[kind], F.lit(2_500.0))


def place_rank(kind: Column) -> Column:
    return F.coalesce(_map(RANK)[kind], F.lit(1))


def gazetteer_lookup(asked: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(query_id, name, kind, lat, lon, population): the place that a name means, near a point where one is given.

    ``asked``: query_id, name, lat, lon (may be NULL). Candidates share the normalised name; the greatest of
    rank * 1000 + sqrt(population) + 4000 e^(-distance / 50 km) wins; equal ones go by population, then position.
    """
    a = asked.select("query_id", normalise_name(F.col("name")).alias("key"), F.col("lat").alias("qlat"), F.col("lon").alias("qlon")).where("key <> ''")
    g = gazetteer.where(usable_position(F.col("lat"), F.col("lon"))).select(normalise_name(F.col("name")).alias("key"), "name", "kind", "lat", "lon", "population").distinct()
    near = F.when(F.col("qlat").isNotNull() & F.col("qlon").isNotNull(), 4000 * distance_decay(great_circle_m(F.col("qlat"), F.col("qlon"), F.col("lat"), F.col("lon")), F.lit(50_000.0))).otherwise(0.0)
    score = place_rank(F.col("kind")) * 1000.0 + F.sqrt(F.coalesce("population", F.lit(0)).cast("double")) + near
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("population").desc(), "lat", "lon", "kind")
    return a.join(g, "key").withColumn("score", F.round(score, 6)).withColumn("r", F.row_number().over(by)).where("r = 1").select("query_id", "name", "kind", "lat", "lon", "population", "score")


def upsert_latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key; of equally late ones the greatest by all columns as text."""
    rest = F.to_json(F.struct(*(c for c in rows.columns)))
    by = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), rest.desc())
    return rows.where(F.col(key).isNotNull()).withColumn("__r", F.row_number().over(by)).where("__r = 1").drop("__r")


def within_radius(points: DataFrame, queries: DataFrame, precisions: list[int]) -> DataFrame:
    """Points within each query's radius, with ``distance_m``.

    ``points``: id, lat, lon and more; ``queries``: query_id, qlat, qlon, radius_m, precision (one of
    ``precisions``) and more. A point has one cell for each precision in use; the equi-join with the cells
    covering the circles leaves little for the exact distance to decide.
    """
    p = points.where(usable_position(F.col("lat"), F.col("lon")))
    cells = F.array(*(F.struct(F.lit(k).alias("precision"), geohash(F.col("lat"), F.col("lon"), k).alias("cell")) for k in precisions))
    p = p.select("*", F.explode(cells).alias("c")).select("*", "c.precision", "c.cell").drop("c")
    cover = F.coalesce(*(F.when(F.col("precision") == k, cells_covering(F.col("qlat"), F.col("qlon"), F.col("radius_m"), k)) for k in precisions))
    q = queries.select("*", F.explode(cover).alias("cell"))
    j = p.join(bounded_broadcast(q, 100_000), ["precision", "cell"])
    d = great_circle_m(F.col("qlat"), F.col("qlon"), F.col("lat"), F.col("lon"))
    return j.withColumn("distance_m", d).where(F.col("distance_m") <= F.col("radius_m")).drop("precision", "cell")


WIDEN = [1.0, 2.5, 5.0]
WIDEST_M = 50_000.0


def nearby(spark: SparkSession, poi: DataFrame, gazetteer: DataFrame, queries: DataFrame, limit: int = 10, enough: int = 3) -> DataFrame:
    """(query_id, id, name, distance_m, score, rank, radius_m, place): places that queries ask for, near a point or in a named place.

    ``queries``: query_id, query_text, lat, lon, radius_m (NULL: the place's own, or 2 500 m). "X in P" is
    searched around P if the gazetteer knows it. The radius is widened by 1, 2.5 and 5, up to 50 km, until
    ``enough`` places are found: one search at the widest radius, from which the factor is read off. Text
    counts words of the expanded query in name and brand (twice) and category and group (once), by the
    share of the query's best; places that lack most of the distinctive words are left out.
    """
    q = queries.select("*", split_in_clause(F.col("query_text")).alias("c"))
    named = gazetteer_lookup(q.where("c IS NOT NULL").select("query_id", F.col("c.place").alias("name"), "lat", "lon"), gazetteer)
    named = named.select("query_id", F.col("name").alias("place"), F.col("lat").alias("plat"), F.col("lon").alias("plon"), default_radius_m(F.col("kind")).alias("pradius"))
    g = gazetteer.select(F.explode(F.split(normalise_name(F.col("name")), " ")).alias("w")).distinct().agg(F.collect_set("w").alias("place_names"))
    known = F.col("place").isNotNull()
    subject = strip_local_markers(F.when(known, F.col("c.subject")).otherwise(F.col("query_text")))
    first = F.least(F.lit(WIDEST_M), F.greatest(F.lit(50.0), F.coalesce("radius_m", "pradius", F.lit(2_500.0))))
    q = q.join(named, "query_id", "left").select(
        "query_id", "place", F.coalesce("plat", "lat").alias("qlat"), F.coalesce("plon", "lon").alias("qlon"), first.alias("first_m"), subject.alias("subject")
    ).crossJoin(F.broadcast(g))  # one row: the gazetteer's words
    q = q.select(
        "query_id", "place", "qlat", "qlon", "first_m", F.least(F.lit(WIDEST_M), F.col("first_m") * WIDEN[-1]).alias("radius_m"), expand(F.col("subject")).alias("terms"),
        distinctive_terms(F.col("subject"), F.col("place_names")).alias("distinctive"), F.lit(4).alias("precision"),
    )
    found = within_radius(upsert_latest(poi, "id", "ingested_at").drop("prominence"), q, [4])
    words = lambda c: query_words(F.regexp_replace(F.coalesce(c, F.lit("")), "_", " "))
    hit = lambda c: F.size(F.array_intersect(F.col("terms"), F.concat(words(F.col(c)), F.array(F.coalesce(F.col(c), F.lit(""))))))
    text = 2.0 * hit("name") + 2.0 * hit("brand") + hit("category") + hit("poi_group")
    found = found.withColumn("text", F.when(F.size("terms") == 0, 1.0).otherwise(text)).where(F.col("text") > 0)
    found = found.where(distinctive_match_ok(F.col("name"), F.col("brand"), F.col("distinctive")))
    ring = F.coalesce(*(F.when(F.col("distance_m") <= F.least(F.lit(WIDEST_M), F.col("first_m") * w), w) for w in WIDEN))
    found = found.withColumn("ring", ring)
    per = found.groupBy("query_id").agg(*(F.sum((F.col("ring") <= w).cast("int")).alias(f"n{i}") for i, w in enumerate(WIDEN)))
    factor = per.select("query_id", F.when(F.col("n0") >= enough, WIDEN[0]).when(F.col("n1") >= enough, WIDEN[1]).otherwise(WIDEN[2]).alias("factor"))
    kept = found.join(factor, "query_id").where(F.col("ring") <= F.col("factor"))
    radius = F.least(F.lit(WIDEST_M), F.col("first_m") * F.col("factor"))
    best = F.max("text").over(Window.partitionBy("query_id"))
    full = prominence(F.col("website"), F.col("phone"), F.col("opening_hours"), F.col("address"))
    score = 0.8 * F.col("text") / best + distance_decay(F.col("distance_m"), F.greatest(0.4 * radius, F.lit(50.0))) + 0.3 * full
    scored = kept.withColumn("used_m", radius).withColumn("score", F.round(score, 6))
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit).select("query_id", "id", "name", F.round("distance_m", 3).alias("distance_m"), "score", "rank", F.col("used_m").alias("radius_m"), "place")


def stale_tiles(tiles: DataFrame, fetched: DataFrame, regions: DataFrame, now: int, ttl: int) -> DataFrame:
    """Tiles (tile, lat, lon) that neither were fetched within ``ttl`` seconds nor lie in a region that was.

    A ttl of 0 is never fresh. Regions are found through the grid join of points and regions.
    """
    from quern.operators.proximity import region_of_points

    fresh = lambda c: (F.lit(now) - F.col(c)) < ttl
    inside = region_of_points(tiles, regions.where(fresh("fetched_at")), "tile", key_col="source")
    recent = fetched.where(fresh("fetched_at")).select("tile")
    return tiles.join(recent, "tile", "left_anti").join(inside.select(F.col("id").alias("tile")), "tile", "left_anti")


SECONDS_A_TILE = 28  # fixed value: what fetching a tile takes


def seed_plan(cities: DataFrame, fetched: DataFrame, now: int, ttl: int, delay_s: int = 0) -> tuple[DataFrame, DataFrame]:
    """((tile, lat, lon, radius_m), (tiles, seconds)): tiles around cities that are to be fetched, and how long that takes.

    ``cities``: lat, lon, radius_m; tiles fetched within ``ttl`` seconds are left out.
    """
    tiles = cities.where(usable_position(F.col("lat"), F.col("lon"))).select(F.explode(tiles_for_circle(F.col("lat"), F.col("lon"), F.col("radius_m"))).alias("tile")).distinct()
    fresh = fetched.where((F.lit(now) - F.col("fetched_at")) < ttl).select("tile").distinct()
    todo = tiles.join(fresh, "tile", "left_anti").select("tile", tile_bounds(F.col("tile")).alias("b")).select("tile", "b.*")
    return todo, todo.agg(F.count(F.lit(1)).alias("tiles"), (F.count(F.lit(1)) * (SECONDS_A_TILE + delay_s)).alias("seconds"))


def mark_fetched(marks: DataFrame, new: DataFrame, key: str = "tile") -> DataFrame:
    """Marks of ``key`` and fetched_at with new ones added: of each key the new one counts, and of several the latest."""
    return upsert_latest(marks.join(new.select(key).distinct(), key, "left_anti").unionByName(new), key, "fetched_at")


def directory_lookup(queries: DataFrame, poi: DataFrame, limit: int = 8) -> DataFrame:
    """(query_id, id, name, website, place): POIs with an http website whose name or brand holds every word of a query.

    ``queries``: query_id, q. POIs meet queries by their words; ordered by the length of name and brand, then id.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    q = queries.select("query_id", F.array_distinct(words(F.col("q"))).alias("ws")).where(F.size("ws") > 0)
    p = poi.where(F.col("id").isNotNull() & F.startswith("website", F.lit("http")))
    p = upsert_latest(p, "id", "ingested_at").select("id", "name", "website", F.concat_ws(" ", "name", "brand").alias("text"))
    met = p.select("id", "name", "website", F.length("text").alias("n"), F.explode(F.array_distinct(words(F.col("text")))).alias("w")).join(q.select("query_id", F.size("ws").alias("all"), F.explode("ws").alias("w")), "w")
    full = met.groupBy("query_id", "id", "name", "website", "n", "all").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") == F.col("all"))
    by = Window.partitionBy("query_id").orderBy("n", "id")
    return full.withColumn("place", F.row_number().over(by)).where(F.col("place") <= limit).select("query_id", "id", "name", "website", "place")


SETTLED = ["city", "town", "suburb", "state", "country"]


def embedded_place(asked: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(query_id, place, kind, lat, lon, radius_m, subject, scope_too_broad): a place named inside a query that has no "in" clause.

    ``asked``: query_id, q, lat, lon. The last word of four bytes or more counts that is no category and names a
    place from suburb to country; queries of one word or with a local marker name none. A state or country
    is too broad a scope; the subject is the query without the word.
    """
    q = asked.where(~has_local_intent(F.col("q")) & split_in_clause(F.col("q")).isNull())
    words = F.filter(F.split(F.col("q"), r"\s+"), lambda w: w != "")
    w = q.select("query_id", "q", "lat", "lon", words.alias("ws")).where(F.size("ws") >= 2).select("*", F.posexplode("ws").alias("at", "word"))
    token = F.regexp_replace("word", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    w = w.withColumn("token", token).where((F.octet_length("token") >= 4) & ~is_category_word(F.col("token")))
    key = F.struct("query_id", "at")
    found = gazetteer_lookup(w.select(key.alias("query_id"), F.col("token").alias("name"), "lat", "lon"), gazetteer).where(F.col("kind").isin(SETTLED))
    last = Window.partitionBy("query_id").orderBy(F.col("at").desc())
    f = found.select("query_id.query_id", "query_id.at", F.col("name").alias("place"), "kind", "lat", "lon").withColumn("r", F.row_number().over(last)).where("r = 1").drop("r")
    j = f.join(w.select("query_id", "at", "ws", "token"), ["query_id", "at"])
    subject = F.array_join(F.filter("ws", lambda x: F.lower(x) != F.lower(F.col("token"))), " ")
    return j.select("query_id", "place", "kind", "lat", "lon", default_radius_m(F.col("kind")).alias("radius_m"), subject.alias("subject"), F.col("kind").isin("country", "state").alias("scope_too_broad"))


def search_bounds(lat: float, lon: float, radius_m: float | None = None, limit: int = 10) -> tuple[float, float, float | None, int]:
    """The arguments of a nearby search: positions out of range are an error, radius and limit are clamped to 50 to 50 000 m and 1 to 100."""
    if not (-90 <= lat <= 90 and -180 <= lon <= 180):  # false for NaN as well
        raise ValueError("a latitude from -90 to 90 and a longitude from -180 to 180 are needed")
    return lat, lon, None if radius_m is None else min(50_000.0, max(50.0, radius_m)), min(100, max(1, limit))


def route(query: Column) -> Column:
    """local for queries that ask for something near or in a place, else both."""
    return F.when(has_local_intent(query) | F.contains(F.lower(query), F.lit(" in ")), "local").otherwise("both")

