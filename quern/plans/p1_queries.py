"""Queries of the proximity operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.proximity import near_pairs, region_of_points
from quern.session import read_table

RADIUS_M = 40.0


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of POIs at most 40 m apart."""
    return near_pairs(read_table(spark, sf_dir, "poi"), RADIUS_M).select("id_a", "id_b")


def p1_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The covered region around each POI."""
    found = region_of_points(read_table(spark, sf_dir, "poi"), read_table(spark, sf_dir, "covered_regions"))
    return found.select("id", F.col("region").alias("source"))


_POSITIONS = """
pts AS (SELECT DISTINCT id, lat, lon FROM poi
        WHERE id IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180
          AND NOT isnan(lat) AND NOT isnan(lon) AND NOT (lat = 0 AND lon = 0))
"""

QUERIES = {"p1_found": p1_found, "p1_region": p1_region}

ORACLE = {
    "p1_found": f"""
WITH {_POSITIONS}
SELECT DISTINCT a.id AS id_a, b.id AS id_b
FROM pts a JOIN pts b ON a.id < b.id AND abs(a.lat - b.lat) < 0.0004
WHERE 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
      + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 40.0
""",
    "p1_region": f"""
WITH {_POSITIONS}
SELECT DISTINCT p.id, r.source
FROM pts p JOIN covered_regions r ON p.lat BETWEEN r.min_lat AND r.max_lat
 AND CASE WHEN r.min_lon > r.max_lon THEN p.lon >= r.min_lon OR p.lon <= r.max_lon
          ELSE p.lon BETWEEN r.min_lon AND r.max_lon END
""",
}
