"""Points near other points, and the region around each point.

Grid. The globe is cut into bands of latitude as high as the radius. Each band is cut into
cells of longitude that are at least as wide as the radius anywhere in the band, counted
modulo the number of cells, so that the 180th meridian is no edge; near a pole a band has
one cell. A point has one home cell and probes the cells of its own and of the next band
that its circle can reach; the equi-join of homes and probes finds each pair of points
once, and the exact great-circle distance decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import bounded_broadcast, stored

EARTH_RADIUS_M = 6_371_008.8  # fixed value: mean Earth radius in metres
HOT_CELL = 2_000  # points of one cell that one join task may pair; beyond, the cell is split
MOST_CROWDED = 200_000  # cells, and pieces of regions, that are sent to every task


def usable_position(lat: Column, lon: Column) -> Column:
    """True where both coordinates are finite, in range, and not exactly 0/0; never NULL."""
    ok = (
        lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
        & lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0) & ~((lat == 0.0) & (lon == 0.0))
    )
    return F.coalesce(ok, F.lit(False))


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in metres."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


class Grid:
    """Cells for a radius; see the module's text."""

    def __init__(self, radius_m: float):
        if not 0 < radius_m < EARTH_RADIUS_M:
            raise ValueError("the radius must be positive and under the Earth's radius")
        self.step = math.degrees(radius_m / EARTH_RADIUS_M) * (1 + 1e-9)  # degrees of latitude

    def band(self, lat: Column) -> Column:
        return F.floor((lat + 90.0) / self.step).cast("long")

    def cells_in(self, band: Column) -> Column:
        """Cells of a band: as many as are at least a radius wide where the band is narrowest."""
        low, high = band * self.step - 90.0, (band + 1) * self.step - 90.0
        far = F.least(F.lit(90.0), F.greatest(F.abs(low), F.abs(high)))
        return F.greatest(F.lit(1).cast("long"), F.floor(F.cos(F.radians(far)) * (360.0 / self.step)).cast("long"))

    def home(self, lat: Column, lon: Column) -> Column:
        b = self.band(lat)
        n = self.cells_in(b)
        c = F.pmod(F.floor((lon + 180.0) / 360.0 * n).cast("long"), n)
        return F.struct(b.alias("band"), c.alias("cell"))

    def probes(self, lat: Column, lon: Column) -> Column:
        """Cells of the own and the next band that the circle around the point can reach."""
        b = self.band(lat)

        def of(band: Column) -> Column:
            n = self.cells_in(band)
            reach = F.abs(lat) + 2 * self.step  # the circle and the whole next band
            wide = F.when(
                reach < 89.999,
                F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(self.step))) / F.cos(F.radians(F.least(F.lit(89.9999), reach)))))),
            ).otherwise(F.lit(180.0))
            first = F.floor((lon - wide + 180.0) / 360.0 * n).cast("long")
            last = F.least(F.floor((lon + wide + 180.0) / 360.0 * n).cast("long"), first + n - 1)
            return F.transform(F.sequence(first, last), lambda c: F.struct(band.alias("band"), F.pmod(c, n).alias("cell")))

        return F.concat(of(b), of(b + 1))


def near_pairs(points: DataFrame, radius_m: float, id_col: str = "id", lat_col: str = "lat", lon_col: str = "lon") -> DataFrame:
    """(id_a, id_b, distance_m): each pair of different ids at most ``radius_m`` apart, id_a < id_b.

    Rows without id or usable position are left out. An id that occurs with several positions is
    near another if any of its positions is; the least distance counts. Repeated rows count once.
    Further columns of ``points`` are ignored. Empty in, empty out. Cells with more than HOT_CELL
    points are split by a hash of the id and the probing rows repeated for each part, so that no
    task pairs an unbounded group; nothing is dropped.
    """
    grid = Grid(radius_m)
    pts = (
        points.select(F.col(id_col).cast("string").alias("id"), F.col(lat_col).cast("double").alias("lat"), F.col(lon_col).cast("double").alias("lon"))
        .where(F.col("id").isNotNull() & usable_position(F.col("lat"), F.col("lon")))
        .distinct()
    )
    homes = pts.select("id", "lat", "lon", grid.home(F.col("lat"), F.col("lon")).alias("g")).select("id", "lat", "lon", "g.band", "g.cell")
    # parts of a crowded cell; a table of crowded cells only, empty as a rule, that goes to every task. It has at
    # most MOST_CROWDED rows: if more cells than that are crowded, the limit is raised until they are not.
    full = stored(homes.groupBy("band", "cell").count().where(F.col("count") > HOT_CELL))
    limit = HOT_CELL
    while full.where(F.col("count") > limit).limit(MOST_CROWDED + 1).count() > MOST_CROWDED:
        limit *= 2
    crowded = F.broadcast(full.where(F.col("count") > limit).select("band", "cell", F.ceil(F.col("count") / limit).cast("int").alias("parts")))
    parts = F.coalesce(F.col("parts"), F.lit(1))
    left = homes.join(crowded, ["band", "cell"], "left").select(
        "band", "cell", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.col("id").alias("id1"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1")
    )
    probes = pts.select("id", "lat", "lon", grid.band(F.col("lat")).alias("own"), F.explode(F.array_distinct(grid.probes(F.col("lat"), F.col("lon")))).alias("g"))
    right = (
        probes.select(F.col("id").alias("id2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "own", "g.band", "g.cell")
        .join(crowded, ["band", "cell"], "left")
        .select("band", "cell", "own", "id2", "lat2", "lon2", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    )
    joined = left.join(right, ["band", "cell", "part"]).where(
        # within a band each pair meets from both sides, across bands only from the lower one
        ((F.col("own") < F.col("band")) & (F.col("id1") != F.col("id2"))) | (F.col("id1") < F.col("id2"))
    )
    d = great_circle_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return (
        joined.select(F.least("id1", "id2").alias("id_a"), F.greatest("id1", "id2").alias("id_b"), d.alias("distance_m"))
        .where(F.col("distance_m") <= radius_m)
        .groupBy("id_a", "id_b")
        .agg(F.min("distance_m").alias("distance_m"))
    )


def _in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd rule over a ring of (lat, lon) corners; the ring need not repeat its first corner."""
    n = F.size(ring)
    crossed = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when(
            (F.element_at(ring, i)["lat"] > lat) != (F.element_at(ring, F.when(i == n, 1).otherwise(i + 1))["lat"] > lat),
            F.when(
                lon
                < F.element_at(ring, i)["lon"]
                + (F.element_at(ring, F.when(i == n, 1).otherwise(i + 1))["lon"] - F.element_at(ring, i)["lon"])
                * (lat - F.element_at(ring, i)["lat"])
                / (F.element_at(ring, F.when(i == n, 1).otherwise(i + 1))["lat"] - F.element_at(ring, i)["lat"]),
                1,
            ).otherwise(0),
        ).otherwise(0),
    )
    return F.pmod(F.aggregate(crossed, F.lit(0), lambda acc, x: acc + x), F.lit(2)) == 1


def region_of_points(points: DataFrame, regions: DataFrame, id_col: str = "id", lat_col: str = "lat", lon_col: str = "lon", key_col: str = "source", cell_deg: float = 1.0) -> DataFrame:
    """(id, region): each point with each region that contains it; edges count as inside.

    ``regions`` has min_lat, max_lat, min_lon, max_lon (a box whose min_lon exceeds its max_lon runs
    across the 180th meridian) and may have ``ring``, an array of struct(lat, lon), which then decides
    within the box. Regions are laid on a grid of ``cell_deg`` degrees, joined with the points' cells
    by equality, and verified exactly. Regions with a NULL in key or box match nothing; points without
    usable position are left out; repeated rows count once.
    """
    pts = (
        points.select(F.col(id_col).alias("id"), F.col(lat_col).cast("double").alias("lat"), F.col(lon_col).cast("double").alias("lon"))
        .where(F.col("id").isNotNull() & usable_position(F.col("lat"), F.col("lon")))
        .distinct()
    )
    cell = lambda x, low: F.floor((x - low) / cell_deg).cast("long")
    columns = int(math.ceil(360.0 / cell_deg))
    has_ring = "ring" in regions.columns
    box = ["min_lat", "max_lat", "min_lon", "max_lon"]
    west = F.col("min_lon") > F.col("max_lon")
    lons = F.when(
        west,
        F.concat(F.sequence(cell(F.col("min_lon"), -180.0), F.lit(columns - 1).cast("long")), F.sequence(F.lit(0).cast("long"), cell(F.col("max_lon"), -180.0))),
    ).otherwise(F.sequence(cell(F.col("min_lon"), -180.0), cell(F.greatest("min_lon", "max_lon"), -180.0)))
    laid = (
        regions.select(F.col(key_col).alias("region"), *box, *(["ring"] if has_ring else []))
        .dropna(subset=["region", *box])
        .where((F.col("min_lat") <= F.col("max_lat")))
        .select("*", F.explode(F.sequence(cell(F.col("min_lat"), -90.0), cell(F.col("max_lat"), -90.0))).alias("cy"))
        .select("*", F.explode(F.array_distinct(F.transform(lons, lambda c: F.least(c, F.lit(columns - 1).cast("long"))))).alias("cx"))
    )
    homes = pts.select("id", "lat", "lon", cell(F.col("lat"), -90.0).alias("cy"), F.least(cell(F.col("lon"), -180.0), F.lit(columns - 1).cast("long")).alias("cx"))
    inside_lon = F.when(west, (F.col("lon") >= F.col("min_lon")) | (F.col("lon") <= F.col("max_lon"))).otherwise(F.col("lon").between(F.col("min_lon"), F.col("max_lon")))
    found = homes.join(bounded_broadcast(laid, MOST_CROWDED), ["cy", "cx"]).where(F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & inside_lon)
    if has_ring:
        found = found.where(F.col("ring").isNull() | _in_ring(F.col("lat"), F.col("lon"), F.col("ring")))
    return found.select("id", "region").distinct()
