"""Short routes made whole by one excursion on streets that they don't use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopwise import store
from loopwise.functions import evidence as E
from loopwise.functions import geo
from loopwise.operators import network as N
from loopwise.operators import paths
from loopwise.operators.explore import Streets

# Anchors that are tried, excursions that are kept for each route.
ANCHORS, KEPT = 12, 2
METHOD = "one-unused-path-outback"

_ARC = ["edge_id", "from_node", "to_node", "length", "lat1", "lon1", "lat2", "lon2"]


def quiet(edges: DataFrame) -> DataFrame:
    """Edges that an excursion may use: walkable both ways, no crossing, no steps,
    neither unlit nor unpaved on record; what is unknown is allowed."""
    return edges.where((F.col("direction") == 0) & ~F.col("crossing") & ~F.col("steps") & ~F.coalesce(F.col("lit") == "no", F.lit(False)) & ~F.coalesce(F.col("surface").isin(E.UNPAVED), F.lit(False)))


def completed(arcs: DataFrame, routes: DataFrame, s: Streets, net: N.Network) -> tuple[DataFrame, DataFrame]:
    """(proposals, arcs) for the `routes(route_id, request_id, length, distance)` that
    miss their distance by 10 metres to 300 metres or a twentieth of it.

    An excursion leaves a route at one of its nodes (the first visit of each; of
    more than twelve, twelve evenly), goes half of what is missing along quiet edges
    that the route doesn't use, and comes back.  Those with the most recorded
    benefit come first (ties: the earlier node); an excursion inside a crossing is
    left out, as it would make two of it.  proposals: route_id, place (1, 2), at_m,
    added_m, anchors (how many nodes were tried), method.  arcs: route_id, place, seq
    and the arcs of the whole new route."""
    missing = F.col("distance") - F.col("length")
    short = routes.withColumn("missing", missing).where(missing.between(10 - 0.01, 1e9) & (missing <= F.least(F.lit(300.0), F.col("distance") * 0.05) + 0.01))
    short, _ = store.written(short.select("route_id", "request_id", "missing", (F.col("missing") / 2).alias("half")), "short")
    rows = arcs.join(short.select("route_id"), "route_id", "left_semi")
    w = Window.partitionBy("route_id").orderBy("seq")
    rows = rows.withColumn("k", F.row_number().over(w)).withColumn("done", F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows, _ = store.written(rows.select("route_id", "request_id", "k", "done", *_ARC), "short-arcs")
    plain = ["edge_id", "physical_id", "crossing"]
    every = s.edges.select(*plain, F.lit(None).cast("long").alias("owner")).union(s.own_edges.select(*plain, F.col("request_id").cast("long")))
    used = rows.join(every.drop("owner"), "edge_id").select("route_id", "request_id", "physical_id").distinct()
    banned = used.join(every, "physical_id").where("owner is null or owner = request_id").groupBy("route_id").agg(F.collect_set("edge_id").alias("banned"))
    quiet_net = N.Network(s.nodes, quiet(s.edges), net.pois, net.edge_pois)
    ways, _ = store.written(N.arcs(quiet_net, ["balanced"]), "quiet-arcs")
    own = N.arcs(N.Network(s.nodes, quiet(s.own_edges), net.pois, net.edge_pois), ["balanced"])
    own, _ = store.written(own.join(s.own_edges.select("edge_id", "request_id"), "edge_id"), "quiet-own-arcs")
    cut = s.starts.select("request_id", F.col("edge_id").alias("cut_edge"))
    tried, _ = store.written(short.join(banned, "route_id").join(cut, "request_id", "left"), "tried")

    def leaving(at: DataFrame) -> DataFrame:
        """`at(request_id, node, banned, cut_edge, ...)` with the quiet arcs that
        leave each node and are not banned."""
        out = at.join(ways.select(F.col("u").alias("node"), "v", "edge_id", F.col("length").alias("arc_m")), "node").where("cut_edge is null or edge_id <> cut_edge")
        mine = at.join(own.select(F.col("u").alias("node"), "v", "edge_id", F.col("length").alias("arc_m"), "request_id"), ["node", "request_id"])
        return out.unionByName(mine).where("not array_contains(banned, edge_id)")

    # Where the route really reaches a node, at its first visit.
    first = rows.where("k = 1").select("route_id", F.lit(0).alias("k"), F.col("from_node").alias("node"), F.col("lat1").alias("lat"), F.col("lon1").alias("lon"), F.lit(0.0).alias("at_m"))
    visits = first.union(rows.select("route_id", "k", "to_node", "lat2", "lon2", "done"))
    places = s.nodes.select(F.col("node_id").alias("node"), F.col("lat").alias("nlat"), F.col("lon").alias("nlon")).union(s.starts.where("node < 0").select("node", "start_lat", "start_lon"))
    visits = visits.join(places, "node").where(geo.meters(*map(F.col, ["lat", "lon", "nlat", "nlon"])) < 0.05)
    anchors = visits.groupBy("route_id", "node").agg(F.min(F.struct("k", "at_m")).alias("f")).select("route_id", "node", "f.k", "f.at_m")
    anchors = anchors.join(tried, "route_id")
    free = leaving(anchors).select("route_id", "node").distinct()
    anchors = anchors.join(free, ["route_id", "node"], "left_semi")
    n = F.count("*").over(Window.partitionBy("route_id"))
    anchors = anchors.withColumn("n", n).withColumn("i", F.row_number().over(Window.partitionBy("route_id").orderBy("k")) - 1)
    picked = F.exists(F.sequence(F.lit(0), F.lit(ANCHORS - 1)), lambda j: F.floor(j * (F.col("n") - 1) / (ANCHORS - 1) + 0.5) == F.col("i"))
    anchors = anchors.where((F.col("n") <= ANCHORS) | picked).withColumn("tree_id", F.xxhash64("route_id", "node"))
    anchors, _ = store.written(anchors, "anchors")
    trees = anchors.select("tree_id", F.col("node").alias("start"), F.lit("balanced").alias("profile"), F.col("half").alias("max_length"), F.lit(True).alias("avoid_steps"), "request_id", "cut_edge", "banned")
    labels, _ = paths.shortest_trees(ways, trees, own, paths.blocks(s.nodes))
    reached = labels.select("tree_id", F.col("node").alias("target"), F.col("length").alias("out_m"))
    there, _ = paths.paths(labels, reached.select("tree_id", "target"))
    sides = s.edges.select("edge_id", "u", "v", "length", "lat1", "lon1", "lat2", "lon2", "physical_id").union(s.own_edges.select("edge_id", "u", "v", "length", "lat1", "lon1", "lat2", "lon2", "physical_id"))
    on_way = there.join(sides.select("edge_id", "physical_id"), "edge_id").groupBy("tree_id", "target").agg(F.collect_set("physical_id").alias("on_way"))
    known = anchors.select("tree_id", "route_id", "request_id", "k", "at_m", "half", "banned", "cut_edge")
    ends = reached.join(known, "tree_id").join(on_way, ["tree_id", "target"], "left").withColumn("node", F.col("target"))
    last = leaving(ends).join(sides.select("edge_id", "physical_id"), "edge_id").where("out_m + arc_m >= half - 0.01 and (on_way is null or not array_contains(on_way, physical_id))")
    last = last.select("route_id", "tree_id", "target", "k", "at_m", "half", "edge_id", F.col("node").alias("u"), "v", F.xxhash64("tree_id", "target", "edge_id", "v").alias("trip"))
    last, _ = store.written(last, "last-arcs")
    # The arcs of each trip, cut where half of what is missing is walked.
    legs = last.select("trip", "tree_id", "target", "half").join(there, ["tree_id", "target"]).select("trip", "half", (-F.col("back")).alias("leg"), "edge_id", "u", "v")
    legs = legs.union(last.select("trip", "half", F.lit(1).alias("leg"), "edge_id", "u", "v"))
    legs = legs.join(sides.withColumnsRenamed({"u": "eu", "v": "ev"}).drop("physical_id"), "edge_id")
    forward = F.col("u") == F.col("eu")
    flip = {"lat1": ("lat1", "lat2"), "lon1": ("lon1", "lon2"), "lat2": ("lat2", "lat1"), "lon2": ("lon2", "lon1")}
    legs = legs.withColumns({c: F.when(forward, F.col(a)).otherwise(F.col(b)) for c, (a, b) in flip.items()}).drop("eu", "ev")
    w = Window.partitionBy("trip").orderBy("leg")
    left = F.col("half") - F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("length")
    legs = legs.withColumn("left", left).where("left > 0.001").withColumn("m", F.least("left", "length"))
    f = F.col("m") / F.col("length")
    legs = legs.withColumns({"lat2": F.col("lat1") + f * (F.col("lat2") - F.col("lat1")), "lon2": F.col("lon1") + f * (F.col("lon2") - F.col("lon1"))})
    facts = s.edges.select("edge_id", "highway", "crossing", "steps", "motor_allowed", "surface", "lit", "width", "n_pois").union(s.own_edges.select("edge_id", "highway", "crossing", "steps", "motor_allowed", "surface", "lit", "width", "n_pois"))
    bonus = E.edge_bonus({c: F.col(c) for c in facts.columns}, "balanced")
    legs = legs.join(facts, "edge_id").withColumn("worth", 2 * F.col("m") * bonus)
    legs, _ = store.written(legs.select("trip", "leg", "edge_id", F.col("u").alias("from_node"), F.col("v").alias("to_node"), F.col("m").alias("length"), "lat1", "lon1", "lat2", "lon2", "worth"), "legs")
    trips = legs.groupBy("trip").agg(F.sum("worth").alias("worth"), F.array_sort(F.collect_list(F.struct("leg", "edge_id", "to_node"))).alias("legs"))
    crossing = rows.join(every.select("edge_id", "crossing"), "edge_id").select("route_id", "k", "crossing")
    before = crossing.where("crossing").select("route_id", "k")
    after = crossing.where("crossing").select("route_id", (F.col("k") - 1).alias("k"))
    ranked = last.join(trips, "trip").join(before.join(after, ["route_id", "k"]), ["route_id", "k"], "left_anti")
    key = F.xxhash64("route_id", "k", F.col("legs.edge_id"), F.col("legs.to_node"))
    order = [(-F.floor(F.col("worth") * 1e6 + 0.5)), F.col("at_m"), F.col("trip")]
    ranked = ranked.withColumn("once", F.row_number().over(Window.partitionBy("route_id", key).orderBy(*order))).where("once = 1")
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("route_id").orderBy(*order))).where(F.col("place") <= KEPT)
    counts = anchors.groupBy("route_id").agg(F.count("*").alias("anchors"))
    kept, _ = store.written(ranked.select("route_id", "place", "at_m", "k", "trip").join(short.select("route_id", F.col("missing").alias("added_m")), "route_id").join(counts, "route_id"), "proposals")
    base = kept.select("route_id", "place", F.col("k").alias("at")).join(rows.select("route_id", "k", *_ARC), "route_id")
    base = base.select("route_id", "place", F.when(F.col("k") <= F.col("at"), F.lit(0)).otherwise(2).alias("part"), F.col("k").alias("n"), *_ARC)
    mine = kept.select("route_id", "place", "trip").join(legs, "trip")
    out = mine.select("route_id", "place", F.lit(1).alias("part"), F.col("leg").alias("n"), *_ARC)
    back = mine.select("route_id", "place", F.lit(1).alias("part"), (1_000_000 - F.col("leg")).alias("n"), "edge_id", F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node"), "length", F.col("lat2").alias("lat1"), F.col("lon2").alias("lon1"), F.col("lat1").alias("lat2"), F.col("lon1").alias("lon2"))
    seq = F.row_number().over(Window.partitionBy("route_id", "place").orderBy("part", "n"))
    whole = base.unionByName(out).unionByName(back).withColumn("seq", seq.cast("long")).drop("part", "n")
    proposals = kept.select("route_id", F.col("place").cast("long").alias("place"), "at_m", "added_m", "anchors", F.lit(METHOD).alias("method"))
    return proposals, whole


def merged_completions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Completions(parent, at_m, method, ...) of both; of those that agree in these
    three the later counts."""
    rows = old.withColumn("part", F.lit(0)).unionByName(new.withColumn("part", F.lit(1)))
    w = Window.partitionBy("parent", "at_m", "method").orderBy(F.col("part").desc())
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("part", "nth")
