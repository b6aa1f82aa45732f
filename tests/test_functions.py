"""Scalar functions against known values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import geo, text, urls
from quern.operators import places
from quern.operators.ranking import saturate


def one(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_canonical_url(spark):
    c = lambda u: urls.canonical_url(F.lit(u))
    got = one(
        spark, c("http://www.moorgate.in/topic/harvest"), c("https://moorgate.in/topic/harvest/"), c("https://x.in/p?utm_source=fb&b=2&a=1"), c("https://x.in/p?a=1&b=2"),
        c("https://x.in/index.html#top"), c("https://x.in/A"), c("not a url"), c("https://x.in/p?id=1"), c("https://x.in/p?id=2"), urls.canonical_url(F.lit(None).cast("string")),
    )
    assert got[0] == got[1] and got[2] == got[3] and got[4] == "https://x.in" and got[5] == "https://x.in/A" and got[6] == "not a url" and got[7] != got[8] and got[9] is None


def test_registrable_domain(spark):
    d = lambda u: urls.registrable_domain(F.lit(u))
    assert one(spark, d("https://www.foo.co.in/x"), d("https://a.b.example.com"), d("http://larkfield.in:80/"), d("junk"), d("http://localhost/")) == ["foo.co.in", "example.com", "larkfield.in", None, "localhost"]


def test_quality(spark):
    q = lambda t, b: text.quality_score(F.lit(t), F.lit(b))
    monsoon = "The monsoon reached the coast on Tuesday and farmers in several districts began to plant rice after weeks of waiting for rain to arrive. " * 1
    body = " ".join(f"{monsoon} Report {i} of district {i * 7} and village {i * 13}." for i in range(6))
    got = one(spark, q("example.in - Domain For Sale", "Buy this domain"), q("Monsoon", body), q("Loans", "cheap loans " * 300), q(None, None))
    assert got[0] == 0.0 and got[1] > 0.6 and got[2] < 0.5 and got[3] == pytest.approx(0.125)


def test_simhash():
    a = "the quick brown fox jumps over the lazy dog near the river bank on a sunny day"
    h = text.simhash_of
    assert bin(h(a) ^ h(a + "!")).count("1") <= 3 < bin(h(a) ^ h("completely different words about parliament and monsoon budgets in new places")).count("1")
    assert h("") == 0 and h(None) == 0 and h(" ,;") == 0
    assert text.fnv1a([b"", b"a"]).tolist() == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C]


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("running", "run"), ("national", "nation"), ("happy", "happi"), ("sky", "sky"), ("generously", "generous"), ("hopeful", "hope"), ("is", "is")])
def test_stem(word, stem):
    assert text.stem(word) == stem


def test_geo(spark):
    d = geo.great_circle_m(F.lit(12.9716), F.lit(77.5946), F.lit(13.0827), F.lit(80.2707))
    assert one(spark, d / 1000)[0] == pytest.approx(290, abs=15)
    h = geo.geohash(F.lit(57.64911), F.lit(10.40744), 9)
    box = geo.geohash_box(F.lit("u4pruydqq"))
    got = one(spark, h, box["lat"], box["lon"], geo.geohash_box(F.lit("aa!")), F.size(geo.prefixes(h)))
    assert got[0].startswith("u4pruydq") and got[1] == pytest.approx(57.649, abs=1e-2) and got[3] is None and got[4] == 7
    assert geo.precision_for_radius(800, 13) >= 5


def test_covering_finds_every_point(spark):
    pts = spark.range(441).select(((F.col("id") % 21 - 10) / 2000 + 12.97).alias("lat"), (F.floor(F.col("id") / 21) / 2000 - 0.005 + 77.59).alias("lon"))
    p = geo.precision_for_radius(500, 13)
    cells = geo.cells_covering(F.lit(12.97), F.lit(77.59), F.lit(500.0), p)
    near = pts.where(geo.great_circle_m(F.lit(12.97), F.lit(77.59), F.col("lat"), F.col("lon")) <= 500)
    assert near.count() > 100 and near.where(~F.array_contains(cells, geo.geohash(F.col("lat"), F.col("lon"), p))).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.floats(-90, 90), st.floats(-180, 180)), min_size=1, max_size=20))
def test_geohash_cell_holds_its_point(spark, points):
    df = spark.createDataFrame(points, "lat double, lon double")
    box = geo.geohash_box(geo.geohash(F.col("lat"), F.col("lon"), 7))
    bad = df.where((F.abs(box["lat"] - F.col("lat")) > box["half_lat"] + 1e-9) | (F.abs(box["lon"] - F.col("lon")) > box["half_lon"] + 1e-9))
    assert bad.count() == 0


def test_places(spark):
    s = lambda w: places.singular(F.lit(w))
    assert one(spark, s("cafes"), s("pharmacies"), s("churches"), s("bus"), s("glass")) == ["cafe", "pharmacy", "church", "bus", "glass"]
    e = lambda q: places.expand(F.lit(q))
    got = one(spark, e("petrol pump"), e("chemist"), e("gas station"), e("quillbert"))
    assert "fuel" in got[0] and "pharmacy" in got[1] and "fuel" in got[2] and got[3] == ["quillbert"]
    t = lambda q: places.distinctive_terms(F.lit(q), F.array(F.lit("bangalore")))
    assert one(spark, t("IIM Bangalore"), t("Christian Medical College"), t("cheap food")) == [["iim"], ["christian"], []]
    c = lambda q: places.split_in_clause(F.lit(q))
    got = one(spark, c("bakeries in velmora"), c("in ovaldrin"), c("stalls in arcade in tesserin"), c("inlet"))
    assert tuple(got[0]) == ("bakeries", "velmora") and tuple(got[1]) == ("", "ovaldrin") and got[2].place == "tesserin" and got[3] is None
    assert one(spark, saturate(F.lit(8.0), 8.0), saturate(F.lit(-1.0), 8.0), saturate(F.lit(1.0), 0.0)) == [0.5, 0.0, 0.0]
