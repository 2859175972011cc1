"""Geometry on latitude and longitude as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Twice the earth's radius in metres, and metres per degree of the flat metric.
DIAMETER, X_SCALE, Y_SCALE = 12_742_000.0, 90_000.0, 111_320.0


def meters(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; null if a coordinate is."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(DIAMETER) * F.asin(F.when(h > 1, 1.0).otherwise(F.sqrt(h)))


def project(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """struct(t, distance): where the point falls on the segment (0 to 1, in the
    flat metric; a segment without length has t = 0) and how far away it is."""
    x, y = (lon2 - lon1) * X_SCALE, (lat2 - lat1) * Y_SCALE
    px, py = (lon - lon1) * X_SCALE, (lat - lat1) * Y_SCALE
    square = x * x + y * y
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * x + py * y) / F.when(square == 0, 1.0).otherwise(square)))
    return F.struct(t.alias("t"), meters(lat, lon, lat1 + (lat2 - lat1) * t, lon1 + (lon2 - lon1) * t).alias("distance"))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Degrees from north, 0 to 360."""
    dlon = F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def mercator(lat, lon, zoom: int) -> Column:
    """struct(x, y): Web-Mercator pixels of 256-pixel tiles."""
    size = float(256 << zoom)
    return F.struct(((lon + 180) / 360 * size).alias("x"), ((1 - F.asinh(F.tan(F.radians(lat))) / F.lit(3.141592653589793)) / 2 * size).alias("y"))


def half_up(x: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(x + 0.5)


def cells(low: Column, high: Column, step: float) -> Column:
    """Array of the grid cells from low to high, both included."""
    return F.sequence(F.floor(low / step), F.floor(high / step))


def width_scale(band, height: float) -> Column:
    """Metres of a degree of longitude at the poleward edge of a latitude band of
    `height` degrees, where it is shortest; at least a thousandth of that at 0."""
    edge = F.greatest(F.abs(band * height), F.abs((band + 1) * height))
    return F.greatest(F.cos(F.radians(F.least(edge, F.lit(90.0)))), F.lit(0.001)) * Y_SCALE


def block(lat, lon, width: float) -> Column:
    """Number of the square of about `width` metres that a place lies in."""
    height = width / Y_SCALE
    y = F.floor(lat / height)
    return y * (1 << 32) + F.floor(lon * width_scale(y, height) / width)
