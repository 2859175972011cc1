"""What routes made of arcs pass: segments, facilities, shape, signature."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopwise.functions import geo

_KEPT = ["physical_id", "name", "highway", "crossing", "steps", "surface", "lit", "width", "bridge", "tunnel", "motor_allowed", "street", "boulevard", "signal"]


def segments(arcs: DataFrame, edges: DataFrame) -> DataFrame:
    """The segments of `arcs(request_id, route_id, seq, edge_id, length, lat1, lon1,
    lat2, lon2)` with at (metres before each), from_m and to_m on the physical
    edge, and what `edges` record."""
    w = Window.partitionBy("route_id").orderBy("seq")
    rows = arcs.withColumn("at", F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    physical = [f"physical_{c}" for c in ("lat1", "lon1", "lat2", "lon2")]
    met = rows.join(edges.select("edge_id", *_KEPT, *physical, "physical_length"), "edge_id")
    on = lambda lat, lon: geo.project(F.col(lat), F.col(lon), *map(F.col, physical))["t"] * F.col("physical_length")
    return met.withColumn("from_m", on("lat1", "lon1")).withColumn("to_m", on("lat2", "lon2")).drop(*physical, "physical_length")


def points(arcs: DataFrame) -> DataFrame:
    """route_id, i, lat, lon of the corners of each route."""
    rest = arcs.select("route_id", F.col("seq").cast("long").alias("i"), F.col("lat2").alias("lat"), F.col("lon2").alias("lon"))
    w = Window.partitionBy("route_id").orderBy("seq")
    first = arcs.withColumn("n", F.row_number().over(w)).where("n = 1").select("route_id", (F.col("seq") - 1).cast("long").alias("i"), F.col("lat1").alias("lat"), F.col("lon1").alias("lon"))
    return first.union(rest)


def facilities(rows: DataFrame, edge_pois: DataFrame, most: float = 50.0, again: float = 100.0) -> DataFrame:
    """(route_id, poi_id, kind, offset_m, hits) of the facilities within `most`
    metres of the segments `rows` whose edges know them; hits: metres along the
    route, of which one counts only over `again` metres after the last."""
    met = rows.select("route_id", "seq", "edge_id", "at", "length", "lat1", "lon1", "lat2", "lon2").join(edge_pois, "edge_id")
    met = met.withColumn("on", geo.project(*map(F.col, ["poi_lat", "poi_lon", "lat1", "lon1", "lat2", "lon2"]))).where(F.col("on.distance") <= most)
    hit = F.struct("seq", (F.col("at") + F.col("on.t") * F.col("length")).alias("m"))
    per = met.groupBy("route_id", "poi_id", "kind").agg(F.min("on.distance").alias("offset_m"), F.array_sort(F.collect_list(hit)).alias("h"))
    kept = F.aggregate("h", F.array().cast("array<double>"), lambda s, x: F.when((F.size(s) == 0) | (x["m"] - F.element_at(s, -1) > again), F.concat(s, F.array(x["m"]))).otherwise(s))
    return per.select("route_id", "poi_id", "kind", "offset_m", F.when(F.size("h") > 0, kept).alias("hits"))


def supply(lengths: DataFrame, found: DataFrame) -> DataFrame:
    """Per route of `lengths(route_id, length)`: shops, water and max_gap_m, the
    longest way without passing any facility, start and end included."""
    counts = found.groupBy("route_id").agg(F.count_if(F.col("kind") == "shop").alias("shops"), F.count_if(F.col("kind") == "water").alias("water"))
    ends = lengths.select("route_id", F.explode(F.array(F.lit(0.0), F.col("length"))).alias("m"))
    at = ends.union(found.select("route_id", F.explode("hits")))
    gap = F.col("m") - F.lag("m").over(Window.partitionBy("route_id").orderBy("m"))
    gaps = at.withColumn("gap", gap).groupBy("route_id").agg(F.max("gap").alias("max_gap_m"))
    return lengths.select("route_id").join(gaps, "route_id", "left").join(counts, "route_id", "left").fillna(0, ["shops", "water"]).fillna(0.0, ["max_gap_m"])


def measured(rows: DataFrame) -> DataFrame:
    """Per route of the segments `rows`: length, street_ratio, boulevard_ratio,
    steps_m and repeat_ratio (metres beyond the longest pass of each edge)."""
    m = lambda c: F.sum(F.when(F.col(c), F.col("length")).otherwise(0.0))
    sums = rows.groupBy("request_id", "route_id").agg(F.sum("length").alias("length"), m("street").alias("street"), m("boulevard").alias("boulevard"), m("steps").alias("steps_m"))
    uses = rows.groupBy("route_id", "edge_id").agg(F.sum("length").alias("total"), F.max("length").alias("longest")).groupBy("route_id").agg(F.sum(F.col("total") - F.col("longest")).alias("repeated"))
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("length")), F.lit(0.0))
    return sums.join(uses, "route_id").select("request_id", "route_id", "length", share("street").alias("street_ratio"), share("boulevard").alias("boulevard_ratio"), "steps_m", share("repeated").alias("repeat_ratio"))


def usage_overlap(rows: DataFrame) -> DataFrame:
    """(request_id, a, b, overlap) of two routes of a request that share an edge:
    the lesser of their metres on each, as a share of the lesser total."""
    per = rows.groupBy("request_id", "route_id", "edge_id").agg(F.sum("length").alias("m"))
    totals = per.groupBy("route_id").agg(F.sum("m").alias("total"))
    a = per.select("request_id", "edge_id", F.col("route_id").alias("a"), F.col("m").alias("ma"))
    b = per.select("request_id", "edge_id", F.col("route_id").alias("b"), F.col("m").alias("mb"))
    shared = a.join(b, ["request_id", "edge_id"]).where("a < b").groupBy("request_id", "a", "b").agg(F.sum(F.least("ma", "mb")).alias("shared"))
    both = shared.join(totals.select(F.col("route_id").alias("a"), F.col("total").alias("ta")), "a").join(totals.select(F.col("route_id").alias("b"), F.col("total").alias("tb")), "b")
    return both.select("request_id", "a", "b", F.coalesce(F.try_divide(F.col("shared"), F.least("ta", "tb")), F.lit(0.0)).alias("overlap"))


def used_edges(rows: DataFrame) -> DataFrame:
    """(route_id, edge_set): a hash of the set of edges that a route uses, by which
    routes for a short list are told apart."""
    per = rows.select("request_id", "route_id", "edge_id").distinct().groupBy("request_id", "route_id")
    return per.agg(F.sha2(F.array_join(F.array_sort(F.collect_set("edge_id")).cast("array<string>"), "|"), 256).alias("edge_set"))


def signatures(at: DataFrame) -> DataFrame:
    """(route_id, signature) of `at(route_id, i, lat, lon)`: a hash of the ordered
    corners to seven decimals, halves up."""
    place = F.struct("i", F.concat_ws(",", *[F.floor(F.col(c) * 1e7 + 0.5).cast("string") for c in ("lat", "lon")]).alias("p"))
    rows = at.groupBy("route_id").agg(F.array_sort(F.collect_list(place)).alias("s"))
    return rows.select("route_id", F.sha2(F.array_join(F.col("s.p"), ";"), 256).alias("signature"))


def first_of_each(routes: DataFrame, *keys: str, order: str = "route_id") -> DataFrame:
    """The first row by `order` of the routes that agree in `keys`."""
    return routes.withColumn("first_", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("first_ = 1").drop("first_")


def shapes(at: DataFrame, repeat: DataFrame) -> DataFrame:
    """(route_id, shape): outback if the corners read the same backwards (an odd
    number, three at least, within half a metre), loop if at most 8 % repeats,
    else partial; `repeat(route_id, repeat_ratio)`."""
    w = Window.partitionBy("route_id").orderBy("i")
    rows = at.withColumn("n", F.row_number().over(w)).withColumn("of", F.count("*").over(Window.partitionBy("route_id")))
    other = rows.select("route_id", (F.col("of") + 1 - F.col("n")).alias("n"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    far = rows.join(other, ["route_id", "n"]).groupBy("route_id", "of").agg(F.max(geo.meters(*map(F.col, ["lat", "lon", "lat2", "lon2"]))).alias("far"))
    same = (F.col("of") >= 3) & (F.col("of") % 2 == 1) & (F.col("far") < 0.5)
    out = repeat.select("route_id", "repeat_ratio").join(far, "route_id", "left")
    return out.select("route_id", F.when(F.coalesce(same, F.lit(False)), "outback").when(F.col("repeat_ratio") <= 0.08, "loop").otherwise("partial").alias("shape"))
