"""Operators on small tables, empty ones included."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import evaluation, places, proximity, ranking, resolver, signals
from quern.operators.ordered import running_sums
from quern.operators.places import nearby, upsert_latest
from quern.sources import geodata, web

POINT = "id string, lat double, lon double, g string, band int"


def brute(points, r):
    def d(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371008.8 * math.asin(min(1, math.sqrt(h)))

    return {(min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(points) for b in points[:i] if a[0] != b[0] and d(a, b) <= r}


@pytest.mark.parametrize("centre", [(0.0001, 0.0001), (52.0, 13.0), (10.0, 179.9999), (10.0, -179.9999), (89.9995, 20.0), (-89.9999, -100.0), (90.0, 0.0)])
def test_near_pairs_anywhere(spark, centre):
    rnd = random.Random(1)
    spread = 0.002
    pts = []
    for i in range(60):
        lat = max(-90.0, min(90.0, centre[0] + rnd.uniform(-spread, spread)))
        lon = centre[1] + rnd.uniform(-spread, spread) / max(0.002, math.cos(math.radians(lat)))
        pts.append((f"p{i}", lat, (lon + 180) % 360 - 180))
    df = spark.createDataFrame([(*p, "x", 1) for p in pts], POINT)
    got = {(r.id_a, r.id_b) for r in proximity.near_pairs(df, 40.0).collect()}
    assert got == brute(pts, 40.0)


def test_near_pairs_odd_rows(spark, monkeypatch):
    rows = [("a", 1.0, 1.0), ("a", 1.0, 1.0), ("b", 1.0, 1.0), ("c", None, 1.0), (None, 1.0, 1.0), ("d", float("nan"), 1.0), ("e", 0.0, 0.0), ("f", 0.0, 0.0), ("g", 91.0, 1.0), ("B", 1.0, 1.0)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], POINT)
    want = {("B", "a"), ("B", "b"), ("a", "b")}
    assert {(r.id_a, r.id_b) for r in proximity.near_pairs(df, 40.0).collect()} == want
    monkeypatch.setattr(proximity, "HOT_CELL", 1)  # a crowded cell is split
    assert {(r.id_a, r.id_b) for r in proximity.near_pairs(df, 40.0).collect()} == want
    assert proximity.near_pairs(df.limit(0), 40.0).count() == 0


def test_regions(spark):
    regions = spark.createDataFrame([("w", -10.0, 10.0, 170.0, -170.0, None), ("t", 20.0, 30.0, 20.0, 30.0, [(20.0, 20.0), (20.0, 30.0), (30.0, 20.0)])], "source string, min_lat double, max_lat double, min_lon double, max_lon double, ring array<struct<lat:double,lon:double>>")
    pts = spark.createDataFrame([("a", 0.0, 179.0), ("b", 0.0, -175.0), ("c", 0.0, 100.0), ("d", 21.0, 21.0), ("e", 29.0, 29.0), ("f", 10.0, 170.0), ("g", None, None)], "id string, lat double, lon double")
    assert {(r.id, r.region) for r in proximity.region_of_points(pts, regions).collect()} == {("a", "w"), ("b", "w"), ("d", "t"), ("f", "w")}
    assert proximity.region_of_points(pts, regions.limit(0)).count() == 0


def test_running_sums(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), F.lit(2).cast("long").alias("v"))
    out = running_sums(df, [F.col("k")], {"s": F.col("v")}, number="n")
    assert out.where((F.col("s") != 2 * (F.col("k") + 1)) | (F.col("n") != F.col("k") + 1)).count() == 0
    assert running_sums(df.limit(0), [F.col("k")], {"s": F.col("v")}).count() == 0


LINKS = "src string, dst string, text string"


def test_anchors(spark):
    links = spark.createDataFrame([("https://blog.in/a", "https://irctc.in/", "book  train tickets"), ("https://news.in/b", "https://irctc.in/", "indian railways booking"), ("https://shop.in/home", "https://shop.in/deals", "best deals ever"), ("https://a.in/x", "https://b.in/", "click here"), ("https://a.in/x", "https://c.in/", None)], LINKS)
    text = {r.dst: r.anchor_text for r in signals.anchor_text(links.na.fill("")).collect()}
    assert text["https://irctc.in/"] == "indian railways booking book train tickets" and text["https://shop.in/deals"] == "best deals ever" and "https://b.in/" not in text
    n = {r.dst: r.inbound_domains for r in signals.inbound_domains(links).collect()}
    assert n == {"https://irctc.in/": 2, "https://shop.in/deals": 0, "https://b.in/": 1, "https://c.in/": 1}
    tight = spark.createDataFrame([("https://a.in/", "https://t.in/", "external words"), ("https://t.in/x", "https://t.in/", "internal words here")], LINKS)
    assert signals.anchor_text(tight, 16).first().anchor_text == "external words"


def ranks(spark, edges, n=200):
    e = spark.createDataFrame(edges, "src string, dst string").distinct()
    nodes = e.select(F.col("src").alias("url")).union(e.select("dst")).distinct()
    return {r.url: r.pagerank for r in signals.pagerank(nodes, e, n).collect()}


def test_pagerank(spark):
    r = ranks(spark, [("a", "b"), ("c", "b"), ("b", "a")], 20)
    assert r["b"] > r["c"]
    r = ranks(spark, [("a", "b"), ("a", "c"), ("b", "c")], 30)
    assert sum(r.values()) == pytest.approx(1, abs=1e-6)
    assert signals.pagerank(spark.createDataFrame([], "url string"), spark.createDataFrame([], "src string, dst string")).count() == 0


def test_near_duplicates_follow_the_order(spark):
    # a - b - c: a beats b; c is no neighbour of a and stays
    rows = [("u1", 0.9, 0b0111), ("u2", 0.8, 0b0111 ^ 0b111000), ("u3", 0.7, 0b0111 ^ 0b111000 ^ 0b111000000), ("u4", 0.5, 0), ("u5", 0.5, 0), ("u6", 0.1, 0b0111)]
    got = {r.url: r.is_duplicate for r in signals.near_duplicates(spark.createDataFrame(rows, "url string, quality double, simhash long")).collect()}
    assert got == {"u1": False, "u2": True, "u3": False, "u4": False, "u5": False, "u6": True}


def test_blend(spark):
    rows = [(1, "spam", 82.0, 0.0004, 1.0, 0), (1, "right", 50.0, 0.009, 1.0, 30)]
    h = spark.createDataFrame(rows, "query_id int, doc string, score double, pagerank double, quality double, inbound_domains long")
    b = {r.doc: r.blended for r in ranking.blend(h, 0.0003).collect()}
    assert b["right"] > b["spam"]
    parked = spark.createDataFrame([(1, "p", 50.0, 0.0, 0.0, 0), (1, "r", 50.0, 0.0, 1.0, 0)], h.schema)
    b = {r.doc: r.blended for r in ranking.blend(parked, 0.0).collect()}
    assert b["r"] > 1.5 * b["p"]


def test_metrics(spark):
    res = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "c", 1), (3, "x", 1)], "query_id long, url string, rank int")
    j = spark.createDataFrame([(1, "a", 3.0), (1, "b", 2.0), (1, "c", 1.0), (2, "a", 3.0), (3, "x", None), (4, "a", 1.0)], "query_id long, url string, grade double")
    m = {r.query_id: (r.ndcg, r.rr) for r in evaluation.ranking_metrics(res, j).collect()}
    assert m[1] == (1.0, 1.0) and m[2] == (0.0, 0.0) and m[3] == (0.0, 0.0) and m[4] == (0.0, 0.0)


def test_resolver(spark):
    t = resolver.tokens_of(F.lit("saint orwins school brellton"), F.array(F.lit("brellton")))
    row = spark.range(1).select(t.alias("t"), resolver.splits(t).alias("s")).first()
    assert [x.kind for x in row.t] == ["Distinctive", "Distinctive", "Generic", "Place"] and row.s[0].page == []
    hosts = resolver.host_candidates([(x.text, x.forms, x.kind) for x in row.t], ["in", "com"])
    assert "storwinsbrellton.in" in hosts and len(hosts) <= 240
    pages = [
        ("https://storwins.in/", "St. Orwin's School, Brellton", "A school in Brellton", 1.0), ("https://news.in/", "Brellton Herald", "St. Orwin's School Brellton won", 1.0),
        ("https://saintorwins.org/", "Saint Orwins Church", "A chapel in another country", 1.0), (None, None, None, None),
    ]
    p = spark.createDataFrame(pages, "url string, title string, body string, quality double")
    s = {r.url: r.s for r in p.select("url", resolver.match_score(t, F.col("title"), F.col("url"), F.col("body")).alias("s")).collect()}
    assert s["https://storwins.in/"] > 0.85 and s["https://news.in/"] < 0.5 and s["https://saintorwins.org/"] < 0.4 and s[None] == 0
    q = spark.range(1).select(F.lit(1).alias("query_id"), t.alias("tokens"))
    assert [r.url for r in resolver.resolve(q, p).collect()] == ["https://storwins.in/"]
    enc = spark.range(1).select(resolver.fragment_url(F.lit("https://a.in/x#y"), F.lit("Customer Service-*~"))).first()[0]
    assert enc == "https://a.in/x#:~:text=Customer%20Service%2D%2A~"
    plan = spark.createDataFrame([('```json {"start_url":"https://a.in","steps":[{"find":"x"},{"find":"y"}]}```',), ('[{"find":"z"}]',), ("no",)], "r string").select(resolver.parse_plan(F.col("r")).alias("p")).collect()
    assert len(plan[0].p.steps) == 2 and len(plan[1].p.steps) == 1 and plan[2].p is None


def test_web_sources(spark):
    title, body, links = web.parse_html("https://example.in/", "<title>Hi</title><body><h1>A</h1><script>x</script><style>y</style><p>B <a href='/next#f'>n</a><b>open<br>")
    assert (title, body, links) == ("Hi", "A B n open", [("https://example.in/next", "n")])
    rec = b"WARC/1.0\r\nx: y\r\n\r\nHTTP/1.1 404 No\r\nh: v\r\n\r\n<title>T</title><body>text</body>"
    assert web.parse_archive_record(rec)[0] == 404 and web.parse_archive_record(None) == (0, "") and web.parse_archive_record(b"\x1f\x8bzz") == (0, "")
    r = spark.range(1).select(web.robots(F.lit("User-agent: *\nDisallow: /admin\nCrawl-delay: 1\nSitemap: a\nSitemap: b"), "us").alias("r"), web.robots(F.lit(None).cast("string"), "us").alias("n")).first()
    assert (r.r.disallow, r.r.crawl_delay_ms, r.r.sitemaps) == (["/admin"], 1000, ["a", "b"]) and r.n.crawl_delay_ms == 500
    loc = spark.range(1).select(web.sitemap_locations(F.lit("<loc>b&amp;c</loc><loc> a </loc><loc>cut"))).first()[0]
    assert loc == ["a", "b&c"]


def test_geodata_sources(spark):
    body = '{"elements":[{"type":"node","id":1,"lat":1.0,"lon":2.0,"tags":{"name":"Cafe X","amenity":"cafe","phone":"123"}},{"type":"node","id":2,"lat":1.0,"lon":2.0,"tags":{"amenity":"cafe"}},{"type":"node","id":3,"lat":1.0,"lon":2.0,"tags":{"name":"Road","highway":"x"}},{"type":"node","id":4,"lat":1.0,"lon":2.0,"tags":{"brand":"B","shop":"yes","tourism":"museum"}}]}'
    got = {r.id: (r.name, r.category, r.poi_group, r.phone) for r in geodata.pois_from_reply(spark.createDataFrame([(body,), ("junk",)], "body string")).collect()}
    assert got == {"n1": ("Cafe X", "cafe", "food", "123"), "n4": ("B", "museum", "attraction", "")}
    line = "\t".join(["1", "Bombaý", "Bombay", "Mumbai,मुंबई,B", "19.0", "72.8", "P", "PPL", "IN", "", "", "", "", "", "12000000"])
    names = {r.name for r in geodata.gazetteer_from_dump(spark.createDataFrame([(line,), ("short\tline",)], "value string")).collect()}
    assert names == {"Bombaý", "Bombay", "Mumbai"}


def test_nearby_and_upsert(spark):
    cols = "id string, name string, brand string, category string, poi_group string, lat double, lon double, address string, phone string, website string, opening_hours string, prominence float, ingested_at timestamp"
    poi = spark.createDataFrame([("a", "Blue Cafe", None, "cafe", "food", 10.0, 70.001, None, None, None, None, 0.0, None), ("a", "Blue Cafe", None, "cafe", "food", 10.0, 70.001, "x", None, None, None, 0.0, None), ("b", "Red Hotel", None, "hotel", "stay", 10.0, 70.001, None, None, None, None, 0.0, None), ("c", "Far Cafe", None, "cafe", "food", 10.05, 70.0, None, None, None, None, 0.0, None)], cols)
    assert upsert_latest(poi, "id", "ingested_at").count() == 3
    gaz = spark.createDataFrame([("Lalpur", "town", 10.0, 70.0, 100, ""), ("Lalpur", "village", 50.0, 7.0, 10, "")], "name string, kind string, lat double, lon double, population long, country string")
    q = spark.createDataFrame([("q1", "cafes in lalpur", None, None, None), ("q2", "zzzz near me", 10.0, 70.0, 500.0)], "query_id string, query_text string, lat double, lon double, radius_m double")
    got = [(r.query_id, r.id) for r in nearby(spark, poi, gaz, q).orderBy("query_id", "rank").collect()]
    assert got == [("q1", "a"), ("q1", "c")]


def test_join_spread(spark, monkeypatch):
    from quern.operators import skew

    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 100), (None, 101), (3, 102)], "k int, v int")
    table = spark.createDataFrame([(1, "a", 50), (2, "b", 1), (None, "c", 1)], "k int, x string, n long")
    want = {(1, i, "a") for i in range(50)} | {(2, 100, "b")}
    for part in (1_000, 7):
        got = skew.join_spread(rows, table, ["k"], "n", "v", part_rows=part)
        assert got.columns == ["k", "v", "x"] and sorted(map(tuple, got.collect())) == sorted(want)
        left = skew.join_spread(rows, table, ["k"], "n", "v", "left", part)
        assert left.count() == 53 and left.where("x IS NULL").count() == 2
    assert skew.join_spread(rows.limit(0), table, ["k"], "n", "v").count() == 0 and skew.join_spread(rows, table.limit(0), ["k"], "n", "v").count() == 0


def test_answers(spark):
    from quern.operators import answers

    one = lambda *c: tuple(spark.range(1).select(*(x.alias(f"c{i}") for i, x in enumerate(c))).first())
    d = lambda t, u: answers.title_is_domain(F.lit(t), F.lit(u))
    assert one(d("Moor-Gate.example", "https://www.moorgate.example/x"), d("Moorgate.example - mills, looms and yarn", "https://moorgate.example"), d("", "https://a.example"), d("x", "no address"), d(None, None)) == (True, False, False, False, False)
    s = lambda x: answers.shortened(F.lit(x))
    assert one(s("Prices (all halls)"), s("One two three four five six seven"), s("Read more:"), s("(x)")) == ("Prices", "One two three four five six", "Read more", "(x)")
    link = lambda t, x: answers.label_link(F.lit("https://a.example/#z"), F.lit(t), F.lit(x))
    assert one(link("All  our\nPrices here", "Prices (new)"), link("Prices", "Gone"), link("Ends.", "Ends."), link(None, None)) == ("https://a.example/#:~:text=Prices", None, None, None)
    assert one(answers.display_text(F.lit("abcdef"), 4), answers.display_text(F.lit("abcd"), 4), answers.strip_signs(F.lit("«Hall!»"))) == ("abc…", "abcd", "hall")
    hosts = spark.createDataFrame([("a.example",), ("b.example",), (None,)], "base string")
    live = spark.createDataFrame([("blog.a.example",), ("www.b.example",), ("odd.a.example",)], "host string")
    got = answers.sub_hosts(hosts, spark.createDataFrame([("b.example",)], "host string"), live).collect()
    assert [tuple(r) for r in got] == [("a.example", "blog.a.example")] and answers.sub_hosts(hosts.limit(0), live, live).count() == 0
    guessed = spark.createDataFrame([(1, f"g{i:02}.example", 3, i) for i in range(20)] + [(1, "rec.example", 2, 30)], "query_id int, host string, split int, rank int")
    recorded = spark.createDataFrame([(1, "rec.example", 0)] + [(1, f"r{i:02}.example", i + 1) for i in range(12)], "query_id int, host string, rank int")
    p = answers.promoted(guessed, recorded)
    first = p.where("place = 1").first()
    assert (first.host, first.split, first.recorded) == ("rec.example", 2, True) and p.count() == 33
    q = spark.createDataFrame([(1, "moor gate")], "query_id int, q string").withColumn("tokens", resolver.tokens_of(F.col("q"), F.array().cast("array<string>")))
    budget = [r.host for r in answers.fetch_budget(p, q).orderBy("place").collect()]
    assert len(budget) == 16 and budget[0] == "rec.example" and sum(h.startswith("g") for h in budget) == 6
    menu = spark.createDataFrame([("u", "Open  hours", 2, "Open hours and more"), ("u", "Open hours", 1, "Open hours and more"), ("u", "ab", 0, "ab"), ("u", None, 3, None)], "url string, label string, place int, page_text string")
    assert [tuple(r) for r in answers.label_menu(menu).collect()] == [("u", "Open hours", 1)]


def test_place_plans(spark):
    none = spark.createDataFrame([], "tile string, fetched_at long")
    city = spark.createDataFrame([(10.0, 179.99, 4000.0), (None, 1.0, 4000.0)], "lat double, lon double, radius_m double")
    todo, plan = places.seed_plan(city, none, 1000, 100, 2)
    tiles = [r.tile for r in todo.collect()]
    assert plan.first().seconds == 30 * len(tiles) and {t[0] for t in tiles} == {"x", "8"}  # across the 180th meridian
    marks = places.mark_fetched(none, spark.createDataFrame([(tiles[0], 950), (tiles[0], 10), (tiles[1], 10)], "tile string, fetched_at long"))
    assert {r.tile: r.fetched_at for r in marks.collect()} == {tiles[0]: 950, tiles[1]: 10}
    assert places.seed_plan(city, marks, 1000, 100)[1].first().tiles == len(tiles) - 1
    with pytest.raises(ValueError):
        places.search_bounds(float("nan"), 0.0)
    assert places.search_bounds(1.0, 2.0, 1e9, 0) == (1.0, 2.0, 50_000.0, 1)
    g = spark.createDataFrame([("Velmora", "city", 1.0, 2.0, 10, ""), ("Ovaldrin", "state", 3.0, 4.0, 10, ""), ("Tess", "village", 1.0, 1.0, 5, "")], "name string, kind string, lat double, lon double, population long, country string")
    asked = spark.createDataFrame([(1, "Larkspur mill, Velmora!", 0.0, 0.0), (2, "mills Ovaldrin", 0.0, 0.0), (3, "Velmora", 0.0, 0.0), (4, "mills Tess", 0.0, 0.0), (5, "mill near me Velmora", 0.0, 0.0), (6, None, None, None)], "query_id int, q string, lat double, lon double")
    got = {r.query_id: (r.place, r.subject, r.scope_too_broad) for r in places.embedded_place(asked, g).collect()}
    assert got[2] == ("Ovaldrin", "mills", True) and set(got) == {1, 2} and got[1][0] == "Velmora"
