"""Spatial joins by grid cells, nearest streets, polygons and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopwise.functions import geo


def near_edges(points: DataFrame, edges: DataFrame, most: float) -> DataFrame:
    """Every point(lat, lon, ...) with every edge(lat1, lon1, lat2, lon2, ...) at
    most `most` metres away: both go to grid cells wider than that in metres at
    their latitude (each band of latitude has its own columns), points look into
    their own cell and edges stand in all cells that they come near to."""
    cell = (most + 50) / geo.Y_SCALE
    x_cell = F.lit(most + 50) / geo.width_scale(F.col("__y"), cell)
    p = points.withColumn("__y", F.floor(F.col("lat") / cell)).withColumn("__x", F.floor(F.col("lon") / x_cell))
    e = edges.withColumn("__y", F.explode(geo.cells(F.least("lat1", "lat2") - cell, F.greatest("lat1", "lat2") + cell, cell)))
    e = e.withColumn("__x", F.explode(F.sequence(F.floor((F.least("lon1", "lon2") - x_cell) / x_cell), F.floor((F.greatest("lon1", "lon2") + x_cell) / x_cell))))
    met = p.join(e, ["__y", "__x"]).drop("__y", "__x")
    met = met.withColumn("on", geo.project(*map(F.col, ["lat", "lon", "lat1", "lon1", "lat2", "lon2"])))
    return met.where(F.col("on.distance") <= most)


def snap(points: DataFrame, id: str, edges: DataFrame, most: float = 100.0) -> DataFrame:
    """The nearest edge of each point within `most` metres (ties: the smallest
    edge_id), where on it and how far; null for a point without one."""
    best = near_edges(points, edges, most).groupBy(id).agg(F.min(F.struct(F.col("on.distance").alias("distance"), "edge_id", F.col("on.t").alias("t"))).alias("best"))
    out = points.join(best, id, "left").select(id, F.col("best.edge_id").alias("edge_id"), F.col("best.t").alias("t"), F.col("best.distance").alias("distance"))
    return out.withColumn("place", F.when(F.col("t") < 0.001, "start").when(F.col("t") > 0.999, "end").when(F.col("t").isNotNull(), "inside").otherwise("none"))


def edges_near_points(edges: DataFrame, points: DataFrame, most: float) -> DataFrame:
    """edge_id of the edges of which an end or the middle lies within `most`
    metres of any point(lat, lon)."""
    middle = F.struct(((F.col("lat1") + F.col("lat2")) / 2).alias("lat"), ((F.col("lon1") + F.col("lon2")) / 2).alias("lon"))
    ends = [F.struct(F.col(f"lat{i}").alias("lat"), F.col(f"lon{i}").alias("lon")) for i in (1, 2)]
    tried = edges.select("edge_id", F.explode(F.array(ends[0], middle, ends[1])).alias("p")).select("edge_id", "p.lat", "p.lon")
    spots = points.select(*[F.col(c).alias(f"{c}{i}") for i in (1, 2) for c in ("lat", "lon")])
    return near_edges(tried, spots, most).select("edge_id").distinct()


def inside(points: DataFrame, id: str, rings: DataFrame) -> DataFrame:
    """(id, poly_id) for points in polygons; `rings(poly_id, ring, hole, lat1,
    lon1, lat2, lon2)` holds one row per side.  A point on an outer side is in, in
    or on a hole it is out.  Sides stand in the latitude bands that they cross."""
    band = 0.01
    p = points.withColumn("__y", F.floor(F.col("lat") / band))
    e = rings.withColumn("__y", F.explode(geo.cells(F.least("lat1", "lat2"), F.greatest("lat1", "lat2"), band)))
    met = p.join(e, "__y")
    across = (F.col("lon2") - F.col("lon1")) * (F.col("lat") - F.col("lat1")) - (F.col("lat2") - F.col("lat1")) * (F.col("lon") - F.col("lon1"))
    on = (F.abs(across) <= 1e-12) & F.col("lat").between(F.least("lat1", "lat2"), F.greatest("lat1", "lat2")) & F.col("lon").between(F.least("lon1", "lon2") - 1e-12, F.greatest("lon1", "lon2") + 1e-12)
    crosses = ((F.col("lat1") > F.col("lat")) != (F.col("lat2") > F.col("lat"))) & (F.col("lon") < F.col("lon1") + (F.col("lon2") - F.col("lon1")) * F.try_divide(F.col("lat") - F.col("lat1"), F.col("lat2") - F.col("lat1")))
    per_ring = met.groupBy(id, "poly_id", "ring", "hole").agg(F.bool_or(on).alias("edge"), (F.count_if(crosses) % 2 == 1).alias("odd"))
    within = F.col("edge") | F.col("odd")
    per_poly = per_ring.groupBy(id, "poly_id").agg(F.bool_or(within & ~F.col("hole")).alias("outer"), F.bool_or(within & F.col("hole")).alias("cut"))
    return per_poly.where("outer and not cut").select(id, "poly_id")


def tile_keys(boxes: DataFrame, step: float = 0.05) -> DataFrame:
    """The tiles (ty, tx) that each box(south, west, north, east) overlaps."""
    tall = boxes.withColumn("ty", F.explode(geo.cells(F.col("south"), F.col("north"), step)))
    return tall.withColumn("tx", F.explode(geo.cells(F.col("west"), F.col("east"), step)))


def packed_way(ways: DataFrame) -> DataFrame:
    """Delta code of `ways(way_id, pos, ref, lat7, lon7)`: the first value, then
    differences, in order of pos."""
    w = Window.partitionBy("way_id").orderBy("pos")
    delta = lambda c: F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))
    return ways.select("way_id", "pos", delta("ref").alias("ref"), delta("lat7").alias("lat7"), delta("lon7").alias("lon7"))


def unpacked_way(packed: DataFrame) -> DataFrame:
    """Inverse of `packed_way`, in whole numbers."""
    w = Window.partitionBy("way_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return packed.select("way_id", "pos", *[F.sum(c).over(w).alias(c) for c in ("ref", "lat7", "lon7")])


def merged(parts: DataFrame, keys: list[str], part: str) -> DataFrame:
    """One row per key, that of the last part; parts may repeat elements."""
    w = Window.partitionBy(*keys).orderBy(F.col(part).desc())
    return parts.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
