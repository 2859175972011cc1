"""Other starts within a short walk: places with better streets, routes from them,
and which of these are worth the walk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopwise import store
from loopwise.functions import evidence as E
from loopwise.functions import geo
from loopwise.operators import evaluate, explore, paths, results, sequence
from loopwise.operators import network as N
from loopwise.operators.explore import Exploration, Streets

# Metres of access and between starts, and what a proposal must reach.
LEAST_ACCESS, MOST_ACCESS, SPACING, STARTS = 80.0, 300.0, 100.0, 4
RUN_ERROR, SCORE_GAIN, RATIO_GAIN, PER_100_M, PROPOSALS = 0.05, 10.0, 0.2, 1.0, 2
STRATEGIES = ["balanced", "flow"]
LONG_COMMON = 0.9

_RATIOS = {"paved": "paved_walk_m", "lit": "lit_walk_m", "wide": "wide_walk_m"}


def _ways(s: Streets, net: N.Network) -> tuple[DataFrame, DataFrame]:
    """Arcs of the network and of what the requests add to it."""
    arcs = N.arcs(N.Network(s.nodes, s.edges, net.pois, net.edge_pois), ["distance"])
    own = N.arcs(N.Network(s.nodes, s.own_edges, net.pois, net.edge_pois), ["distance"])
    return store.written(arcs, "distance-arcs")[0], store.written(own.join(s.own_edges.select("edge_id", "request_id"), "edge_id"), "distance-own-arcs")[0]


def spaced(candidates: DataFrame, most: int = STARTS, apart: float = SPACING) -> DataFrame:
    """Of `candidates(request_id, rank, lat, lon, ...)` those that a pick by rank
    keeps: none within `apart` metres of one kept before, `most` at most, with
    place.  A request's candidates lie around its start, so they are few."""
    rest = [c for c in candidates.columns if c not in ("request_id", "rank")]
    item = F.struct("rank", *rest)
    rows = candidates.groupBy("request_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    near = lambda s, x: F.exists(s, lambda y: geo.meters(y["lat"], y["lon"], x["lat"], x["lon"]) < apart)
    kept = F.aggregate("items", F.slice("items", 1, 0), lambda s, x: F.when((F.size(s) >= most) | near(s, x), s).otherwise(F.concat(s, F.array(x))))
    return rows.select("request_id", F.posexplode(kept).alias("i", "x")).select("request_id", (F.col("i") + 1).cast("long").alias("place"), *[F.col(f"x.{c}").alias(c) for c in rest])


def access(s: Streets, net: N.Network) -> DataFrame:
    """request_id, place, node, lat, lon, bonus, and out_ and in_ m, steps_m and
    crossings: the starts near those of `s`, as a written table.

    A start is a node 80 to 300 metres away along streets that may be walked, which
    a street with recorded benefit leaves, at which a request would start and from
    which a way of at most 300 metres leads back.  The most benefit comes first, then
    the longer way; of two within 100 metres the first stays; four at most."""
    arcs, own = _ways(s, net)
    at, _ = store.written(paths.blocks(s.nodes), "blocks")
    ok = s.starts.where("state = 'ok'").select(F.col("request_id").cast("long").alias("request_id"), "node", "avoid_steps", F.col("edge_id").alias("cut_edge"))
    tree = ok.select(F.col("request_id").alias("tree_id"), F.col("node").alias("start"), F.lit("distance").alias("profile"), F.lit(MOST_ACCESS).alias("max_length"), "avoid_steps", "request_id", "cut_edge")
    there, _ = paths.shortest_trees(arcs, tree, own, at)
    turned = lambda df: df.withColumns({"u": F.col("v"), "v": F.col("u")})
    # Who gets back: one tree against the direction of the streets for each request.
    home, _ = paths.shortest_trees(turned(arcs), tree, turned(own), at)
    facts = ("highway", "crossing", "steps", "motor_allowed", "surface", "lit", "width", "n_pois")
    bonus = s.edges.select("edge_id", E.edge_bonus({c: F.col(c) for c in facts}, "balanced").alias("b"))
    bonus = arcs.join(bonus, "edge_id").groupBy(F.col("u").alias("node")).agg(F.max("b").alias("bonus")).where("bonus > 0")
    near = there.where(F.col("length").between(LEAST_ACCESS, MOST_ACCESS)).join(home.select("tree_id", "node"), ["tree_id", "node"], "left_semi")
    near = near.join(bonus, "node").join(s.nodes.withColumnRenamed("node_id", "node"), "node")
    near, _ = store.written(near.select(F.col("tree_id").alias("request_id"), "node", "node_seq", "lat", "lon", "bonus", F.col("length").alias("out_m")), "near-nodes")
    nodes = near.select(F.col("node").alias("request_id"), "lat", "lon").distinct()
    again = explore.starts(nodes, N.Network(s.nodes, s.edges, net.pois, net.edge_pois)).where("state = 'ok' and node = request_id")
    near = near.join(again.select("node"), "node", "left_semi")
    rank = F.struct((-F.col("bonus")).alias("bonus"), (-F.col("out_m")).alias("m"), "node_seq")
    kept, _ = store.written(spaced(near.select("request_id", rank.alias("rank"), "node", "lat", "lon", "bonus", "out_m")), "near-starts")
    kept = kept.join(ok.withColumnRenamed("node", "home"), "request_id")
    out, _ = paths.paths(there, kept.select(F.col("request_id").alias("tree_id"), F.col("node").alias("target")))
    out = out.join(kept.select(F.col("request_id").alias("tree_id"), F.col("node").alias("target"), "request_id", "place"), ["tree_id", "target"]).withColumn("way", F.lit(0))
    back = kept.select((F.col("request_id") * (2 * STARTS) + F.col("place")).alias("tree_id"), F.col("node").alias("start"), F.lit("distance").alias("profile"), F.lit(MOST_ACCESS).alias("max_length"), "avoid_steps", "request_id", "cut_edge", F.col("home").alias("goal"), "place")
    labels, _ = paths.shortest_trees(arcs, back.drop("place"), own, at)
    come, _ = paths.paths(labels, back.select("tree_id", F.col("goal").alias("target")))
    come = come.join(back.select("tree_id", "request_id", "place"), "tree_id").withColumn("way", F.lit(1))
    columns = ["request_id", "place", "way", "back", "edge_id", "u", "v"]
    both = out.select(columns).unionByName(come.select(columns)).withColumn("route_id", F.col("request_id") * 16 + F.col("place") * 2 + F.col("way")).withColumn("seq", -F.col("back"))
    every = s.edges.unionByName(s.own_edges.drop("request_id", "parent"))
    passed, _ = store.written(evaluate.segments(explore._placed(both, every.select("edge_id", "u", "v", "length", "direction", "lat1", "lon1", "lat2", "lon2")), every), "access-segments")
    groups = sequence.crossing_groups(passed).select("route_id", F.col("n_crossings").alias("crossings"))
    sums = passed.groupBy("route_id", "request_id", "place", "way").agg(F.sum("length").alias("m"), F.sum(F.when(F.col("steps"), F.col("length")).otherwise(0.0)).alias("steps_m"))
    sums = sums.join(groups, "route_id", "left").fillna(0, ["crossings"])
    side = lambda way, name: sums.where(F.col("way") == way).select("request_id", "place", *[F.col(c).alias(f"{name}_{c}") for c in ("m", "steps_m", "crossings")])
    rows = kept.drop("out_m", "avoid_steps", "cut_edge", "home").join(side(0, "out"), ["request_id", "place"]).join(side(1, "in"), ["request_id", "place"])
    return store.written(rows, "near-access")[0]


def qualified(rows: DataFrame) -> DataFrame:
    """`rows` of routes (length, distance, final_score, steps_m, n_crossings, walk
    metres), of their baselines (the same with base_) and of their access (out_, in_)
    with every gate, and qualified where all are open.

    gain is what the score gains less a point for 100 metres of walking; reasons
    name the shares (paved, lit, wide) of recorded walks that grow by a fifth."""
    c = F.col
    walk = c("out_m") + c("in_m")
    gains = {name: c(m) / c("length") - c(f"base_{m}") / c("base_length") for name, m in _RATIOS.items()}
    rows = rows.withColumns({
        "walk_m": walk,
        "near_distance": F.abs(c("length") - c("distance")) / c("distance") <= RUN_ERROR + 1e-8,
        "short_access": (c("out_m") <= MOST_ACCESS) & (c("in_m") <= MOST_ACCESS),
        "no_more_steps": c("steps_m") + c("out_steps_m") + c("in_steps_m") <= c("base_steps_m") + 0.1,
        "no_more_crossings": c("n_crossings") + c("out_crossings") + c("in_crossings") <= c("base_n_crossings"),
        "gain": c("final_score") - c("base_final_score") - walk / 100 * PER_100_M,
        "reasons": F.array_compact(F.array(*[F.when(g >= RATIO_GAIN - 1e-8, F.lit(name)) for name, g in gains.items()])),
    })
    gates = [c("near_distance"), c("short_access"), c("no_more_steps"), c("no_more_crossings"), c("gain") >= SCORE_GAIN, F.size("reasons") > 0]
    every = gates[0]
    for g in gates[1:]:
        every = every & g
    return rows.withColumn("worth", c("gain") >= SCORE_GAIN).withColumn("qualified", F.coalesce(every, F.lit(False)))


def chosen(proposals: DataFrame, pairs: DataFrame, most: int = PROPOSALS) -> DataFrame:
    """Of `proposals(request_id, place, route_id, gain)`, at most one for each of
    four starts, those that a pick by gain (ties: the start's place) keeps: none that
    shares nine tenths of the longer route with one kept before."""
    long = pairs.where(F.col("shared_m") >= LONG_COMMON * F.greatest("total_a", "total_b"))
    long = long.select("a", "b").union(long.select("b", "a"))
    close = proposals.join(long, F.col("route_id") == F.col("a"), "left").groupBy("request_id", "place", "route_id", "gain").agg(F.collect_set("b").alias("close"))
    items = F.array_sort(F.collect_list(F.struct((-F.col("gain")).alias("g"), "place", "route_id", "close")))
    kept = F.aggregate("items", F.slice("items", 1, 0), lambda s, x: F.when((F.size(s) >= most) | F.exists(s, lambda y: F.array_contains(x["close"], y["route_id"])), s).otherwise(F.concat(s, F.array(x))))
    rows = close.groupBy("request_id").agg(items.alias("items"))
    return rows.select("request_id", F.posexplode(kept).alias("i", "x")).select("request_id", (F.col("i") + 1).cast("long").alias("proposal"), F.col("x.place").alias("place"), F.col("x.route_id").alias("route_id"))


@dataclass
class Nearby:
    """access: the starts of each request; routes: the leaders of the families found
    there, with every gate; proposals: request_id, proposal, place, route_id."""

    access: DataFrame
    routes: DataFrame
    proposals: DataFrame


def _leaders(r: results.Results, x: Exploration) -> DataFrame:
    crossings = sequence.crossing_groups(x.segments).select("route_id", "n_crossings")
    rows = r.routes.drop("n_crossings").join(r.families.where("place = 1").select("route_id"), "route_id").join(crossings, "route_id", "left").fillna(0, ["n_crossings"])
    return rows.select("request_id", "route_id", "length", "distance", "final_score", "error", "steps_m", "n_crossings", *_RATIOS.values())


def nearby_starts(net: N.Network, requests: DataFrame, x: Exploration, r: results.Results) -> Nearby:
    """Routes from other starts for requests explored as `x` with results `r`: a
    second wave of requests, whose ids are eight times those of the first plus the
    place of the start (1 to 4), is explored by two strategies and compared with the
    best family leader of the first."""
    order = Window.partitionBy("request_id").orderBy(F.col("final_score").desc(), "error", "route_id")
    first = _leaders(r, x).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "error", "distance", "route_id")
    base, _ = store.written(first.select("request_id", *[F.col(c).alias(f"base_{c}") for c in first.columns if c != "request_id"]), "baselines")
    near = access(x.streets, net).join(base.select("request_id"), "request_id", "left_semi")
    asked = requests.select(F.col("request_id").cast("long").alias("request_id"), "distance", "avoid_steps")
    second = near.join(asked, "request_id").select((F.col("request_id") * (2 * STARTS) + F.col("place")).alias("request_id"), "lat", "lon", "distance", "avoid_steps")
    second, _ = store.written(second, "second-requests")
    y = explore.explored(net, second, STRATEGIES, variants=1)
    s = results.results(y)
    exact = y.streets.starts.where("state = 'ok' and offset_m <= 0.1").select("request_id")
    rows = _leaders(s, y).join(exact, "request_id", "left_semi").withColumn("place", F.pmod("request_id", F.lit(2 * STARTS))).withColumn("request_id", F.floor(F.col("request_id") / (2 * STARTS)))
    routes, _ = store.written(qualified(rows.join(base, "request_id").join(near, ["request_id", "place"])), "nearby-routes")
    each = Window.partitionBy("request_id", "place").orderBy(F.col("final_score").desc(), "error", "route_id")
    best = routes.where("qualified").withColumn("n", F.row_number().over(each)).where("n = 1").select("request_id", "place", "route_id", "gain")
    best, _ = store.written(best, "nearby-best")
    mine = y.segments.drop("request_id").join(best.select("route_id", "request_id"), "route_id")
    pairs = sequence.similar_pairs(sequence.coverage_sweep(mine))
    return Nearby(near, routes, chosen(best, pairs))
