"""Readers of map data: nodes and ways with tags, query replies, gazetteer dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.places import categorise, group_for, prominence

#: Tag selectors of a map query.
SELECTORS = ["amenity", "shop", "tourism", "leisure", "healthcare", "office"]


def _tag(tags: Column, *keys: str) -> Column:
    return F.coalesce(*(F.nullif(tags[k], F.lit("")) for k in keys), F.lit(""))


def pois_from_tags(nodes: DataFrame, id_prefix: str = "n") -> DataFrame:
    """POIs of (id, lat, lon, tags): named or branded ones with a category; places (``place`` tag) are none."""
    t = F.col("tags")
    name = F.coalesce(F.nullif(t["name"], F.lit("")), F.nullif(t["brand"], F.lit("")))
    rows = nodes.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & name.isNotNull() & t["place"].isNull()).withColumn("category", categorise(t)).where("category IS NOT NULL")
    address = F.concat_ws(", ", *(F.nullif(t[k], F.lit("")) for k in ("addr:housenumber", "addr:street", "addr:suburb", "addr:city")))
    out = rows.select(
        F.concat(F.lit(id_prefix), F.col("id").cast("string")).alias("id"), name.alias("name"), _tag(t, "brand", "operator").alias("brand"), "category", group_for(F.col("category")).alias("poi_group"),
        "lat", "lon", address.alias("address"), _tag(t, "phone", "contact:phone").alias("phone"), _tag(t, "website", "contact:website").alias("website"), _tag(t, "opening_hours").alias("opening_hours"),
    )
    return out.withColumn("prominence", prominence(F.col("website"), F.col("phone"), F.col("opening_hours"), F.col("address")).cast("float"))


def places_from_tags(nodes: DataFrame, country: str = "") -> DataFrame:
    """Gazetteer rows of nodes with a ``place`` tag and a name."""
    t = F.col("tags")
    rows = nodes.where(t["place"].isNotNull() & (_tag(t, "name") != "") & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return rows.select(t["name"].alias("name"), t["place"].alias("kind"), "lat", "lon", F.coalesce(F.regexp_replace(_tag(t, "population"), "[^0-9]", "").try_cast("bigint"), F.lit(0)).alias("population"), F.lit(country).alias("country"))


def way_centroids(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, lat, lon, tags): mean position of each way's nodes, the closing repeat of the first left out.

    ``ways``: id, refs, tags; an inner repeat counts twice; a way without any known node is left out.
    """
    n = F.size("refs")
    closed = (n > 1) & (F.element_at("refs", 1) == F.element_at("refs", -1))
    refs = ways.where(n > 0).select("id", F.explode(F.when(closed, F.slice("refs", F.lit(1), n - 1)).otherwise(F.col("refs"))).alias("ref"))
    pos = nodes.select(F.col("id").alias("ref"), "lat", "lon")
    means = refs.join(pos, "ref").groupBy("id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return means.join(ways.select("id", "tags"), "id")


def pois_from_reply(replies: DataFrame) -> DataFrame:
    """POIs of JSON replies (column ``body``) with elements of type, id, lat, lon and tags."""
    schema = "struct<elements:array<struct<type:string,id:long,lat:double,lon:double,tags:map<string,string>>>>"
    return pois_from_tags(replies.select(F.explode(F.from_json("body", schema)["elements"]).alias("e")).select("e.id", "e.lat", "e.lon", "e.tags"))


def map_query(lat: float, lon: float, radius_m: float, limit: int) -> str:
    """Text of a map query for named and branded places around a point."""
    parts = "".join(f'node(around:{radius_m:.0f},{lat},{lon})["{k}"]["{n}"];' for k in SELECTORS for n in ("name", "brand"))
    return f"[out:json][timeout:60];({parts});out body {limit};"


def gazetteer_from_dump(lines: DataFrame) -> DataFrame:
    """(name, kind, lat, lon, population, country) of a tab-separated gazetteer dump (column ``value``).

    Lines of fewer than 15 columns or without position are left out. Names are given as such, in ASCII where
    that differs, and for places of 200 000 people or more under their ASCII alternates of four bytes or more.
    """
    c = F.split("value", "\t")
    rows = lines.where(F.size(c) >= 15).select(
        F.get(c, F.lit(1)).alias("name"), F.get(c, F.lit(2)).alias("ascii"), F.get(c, F.lit(3)).alias("alternates"), F.get(c, F.lit(4)).try_cast("double").alias("lat"), F.get(c, F.lit(5)).try_cast("double").alias("lon"),
        F.lower(F.get(c, F.lit(8))).alias("country"), F.coalesce(F.get(c, F.lit(14)).try_cast("bigint"), F.lit(0)).alias("population"),
    ).where("lat IS NOT NULL AND lon IS NOT NULL")
    extra = F.filter(F.split("alternates", ","), lambda a: a.rlike(r"^[\x20-\x7e]+$") & (F.octet_length(a) >= 4) & a.rlike("[A-Za-z]"))
    names = F.array_distinct(F.concat(F.array("name"), F.when(F.col("ascii") != "", F.array("ascii")).otherwise(F.array().cast("array<string>")), F.when(F.col("population") >= 200_000, extra).otherwise(F.array().cast("array<string>"))))
    kind = F.when(F.col("population") >= 100_000, "city").otherwise("town")
    return rows.select(F.explode(names).alias("name"), kind.alias("kind"), "lat", "lon", "population", "country").where("name <> ''")


def seeded_gazetteer(base: DataFrame, added: list[DataFrame], authoritative: list[DataFrame]) -> DataFrame:
    """``base`` with tables that add to a name's places, then tables that replace all of a name's, in their order."""
    out = base
    for more in added:
        out = out.unionByName(more.where("name <> ''"))
    for better in authoritative:
        out = merge_gazetteer(out, better)
    return out


def merge_gazetteer(base: DataFrame, authoritative: DataFrame) -> DataFrame:
    """``authoritative`` rows replace all of their name; the others stay."""
    from quern.functions.text import normalise_name

    key = lambda d: d.withColumn("__k", normalise_name(F.col("name"))).where("__k <> ''")
    a = key(authoritative)
    return key(base).join(a.select("__k").distinct(), "__k", "left_anti").unionByName(a).drop("__k")
