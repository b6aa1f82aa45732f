"""Geohash cells, coverings and tiles as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.operators.proximity import EARTH_RADIUS_M, great_circle_m

BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"  # fixed value: the geohash alphabet
METRES_PER_DEGREE = 111_320.0


def _axis(x: Column, low: float, high: float, bits: int) -> Column:
    """Cell number along an axis; a coordinate on a boundary belongs to the lower cell."""
    n = 1 << bits
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.ceil((x - low) / (high - low) * n) - 1)).cast("long")


def _bits(precision: int) -> tuple[int, int]:
    return (5 * precision + 1) // 2, 5 * precision // 2  # longitude first


def _name(ix: Column, iy: Column, precision: int) -> Column:
    nx, ny = _bits(precision)
    chars = []
    for c in range(precision):
        value = F.lit(0).cast("long")
        for t in range(5 * c, 5 * c + 5):
            cell, size = (ix, nx) if t % 2 == 0 else (iy, ny)
            bit = F.shiftright(cell, size - 1 - t // 2).bitwiseAND(1)
            value = value * 2 + bit
        chars.append(F.substring(F.lit(BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


def geohash(lat: Column, lon: Column, precision: int) -> Column:
    """Geohash of 1 to 12 characters."""
    p = min(12, max(1, precision))
    nx, ny = _bits(p)
    return _name(_axis(lon, -180.0, 180.0, nx), _axis(lat, -90.0, 90.0, ny), p)


def geohash_box(cell: Column) -> Column:
    """struct(lat, lon, half_lat, half_lon) of a geohash's cell; NULL on another character."""
    digits = F.transform(F.filter(F.split(F.lower(cell), ""), lambda c: c != ""), lambda c: F.position(c, F.lit(BASE32)) - 1)
    start = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).alias("t"), F.lit(False).alias("bad"))

    def step(acc: Column, d: Column) -> Column:
        x, y = acc["x"], acc["y"]
        even = acc["t"] % 2 == 0
        bit = lambda k: F.shiftright(d, 4 - k).bitwiseAND(1).cast("long")
        xs, ys = [bit(0), bit(2), bit(4)], [bit(1), bit(3)]
        three = lambda v, b: ((v * 2 + b[0]) * 2 + b[1]) * 2 + b[2]
        two = lambda v, b: (v * 2 + b[0]) * 2 + b[1]
        return F.struct(F.when(even, three(x, xs)).otherwise(two(x, ys)).alias("x"), F.when(even, two(y, ys)).otherwise(three(y, xs)).alias("y"), (acc["t"] + 5).alias("t"), (acc["bad"] | (d < 0)).alias("bad"))

    s = F.aggregate(digits, start, step)
    nx, ny = F.ceil(s["t"] / 2), F.floor(s["t"] / 2)
    w, h = F.lit(360.0) / F.pow(F.lit(2.0), nx), F.lit(180.0) / F.pow(F.lit(2.0), ny)
    box = F.struct((-90 + (s["y"] + 0.5) * h).alias("lat"), (-180 + (s["x"] + 0.5) * w).alias("lon"), (h / 2).alias("half_lat"), (w / 2).alias("half_lon"))
    return F.when(~s["bad"] & (F.length(cell) > 0), box)


def prefixes(cell: Column, shortest: int = 3) -> Column:
    """Leading parts of a cell's name, from ``shortest`` characters on."""
    return F.transform(F.sequence(F.lit(shortest), F.length(cell)), lambda n: F.substring(cell, F.lit(1), n))


def cell_size_m(precision: int, lat: float) -> tuple[float, float]:
    """(height, width) of a cell in metres at a latitude."""
    nx, ny = _bits(precision)
    metre = math.pi * EARTH_RADIUS_M / 180
    return 180 / (1 << ny) * metre, 360 / (1 << nx) * metre * math.cos(math.radians(lat))


def precision_for_radius(radius_m: float, lat: float) -> int:
    """The finest precision, 9 at most, whose cells are at least a radius high and wide; 1 if none is."""
    return next((p for p in range(9, 0, -1) if min(cell_size_m(p, lat)) >= radius_m), 1)


def cells_covering(lat: Column, lon: Column, radius_m: Column, precision: int) -> Column:
    """Distinct cells of a precision that touch the square around a circle; longitudes wrap."""
    nx, ny = _bits(precision)
    width = 360.0 / (1 << nx)
    dlat = F.degrees(radius_m / EARTH_RADIUS_M)
    dlon = F.least(F.lit(180.0), dlat / F.greatest(F.lit(1e-6), F.cos(F.radians(F.least(F.lit(90.0), F.abs(lat) + dlat)))))
    y0, y1 = _axis(F.greatest(F.lit(-90.0), lat - dlat), -90.0, 90.0, ny), _axis(F.least(F.lit(90.0), lat + dlat), -90.0, 90.0, ny)
    x0, x1 = F.floor((lon - dlon + 180.0) / width).cast("long") - 1, F.floor((lon + dlon + 180.0) / width).cast("long")
    x1 = F.least(x1, x0 + (1 << nx) - 1)
    grid = F.flatten(F.transform(F.sequence(y0, y1), lambda y: F.transform(F.sequence(x0, x1), lambda x: _name(F.pmod(x, F.lit(1 << nx)), y, precision))))
    return F.array_distinct(grid)


def cell_size(precision: int, lat: Column) -> Column:
    """struct(height_m, width_m) of a cell at a latitude."""
    nx, ny = _bits(precision)
    metre = math.pi * EARTH_RADIUS_M / 180
    return F.struct(F.lit(180 / (1 << ny) * metre).alias("height_m"), (F.lit(360 / (1 << nx) * metre) * F.cos(F.radians(lat))).alias("width_m"))


def tiles_for_circle(lat: Column, lon: Column, radius_m: Column, precision: int = 5) -> Column:
    """Distinct cells that a circle touches, the centre's among them; NULL where a number is."""
    cells = cells_covering(lat, lon, radius_m, precision)

    def touches(cell: Column) -> Column:
        box = cell["box"]
        # across the 180th meridian the near side counts
        off = lon - box["lon"]
        off = off - F.round(off / 360) * 360
        nearest = F.greatest(-box["half_lat"], F.least(box["half_lat"], lat - box["lat"])) + box["lat"]
        beside = off - F.greatest(-box["half_lon"], F.least(box["half_lon"], off))
        return great_circle_m(lat, F.lit(0.0), nearest, beside) <= radius_m

    boxed = F.transform(cells, lambda c: F.struct(c.alias("cell"), geohash_box(c).alias("box")))
    return F.array_distinct(F.concat(F.transform(F.filter(boxed, touches), lambda x: x["cell"]), F.array(geohash(lat, lon, precision))))


def tile_bounds(cell: Column) -> Column:
    """struct(lat, lon, radius_m): the centre of a cell, and 1.05 times the distance of its corner."""

    def bounds(box: Column) -> Column:
        corner = great_circle_m(box["lat"], box["lon"], box["lat"] + box["half_lat"], box["lon"] + box["half_lon"])
        return F.when(box.isNotNull(), F.struct(box["lat"].alias("lat"), box["lon"].alias("lon"), (1.05 * corner).alias("radius_m")))

    return F.get(F.transform(F.array(geohash_box(cell)), bounds), F.lit(0))  # the box is worked out once


def distance_decay(distance_m: Column, scale_m: Column) -> Column:
    """exp(-distance / scale); 0 for a scale that is not positive."""
    return F.when(scale_m > 0, F.exp(-distance_m / scale_m)).otherwise(0.0)


__all__ = ["BASE32", "cell_size", "cell_size_m", "cells_covering", "distance_decay", "geohash", "geohash_box", "great_circle_m", "precision_for_radius", "prefixes", "tile_bounds", "tiles_for_circle"]
