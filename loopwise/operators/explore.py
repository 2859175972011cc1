"""Closed routes for batches of requests: snapping, targets, ways out and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopwise import store
from loopwise.functions import geo
from loopwise.operators import evaluate, paths, ranking, sequence, spatial
from loopwise.operators import network as N

# Searches, sectors and distances of the generation.
STRATEGIES = ["distance", "balanced", "flow", "boulevard", "supply"]
VARIANTS, SECTORS = 2, 16
RATIOS = [0.24, 0.34, 0.43, 0.53, 0.66]
PENALTIES = [2.5, 8.0]
#: Numbers for the routes of one search.
IDS = 10_000

_PLACES = ["lat1", "lon1", "lat2", "lon2"]


@dataclass
class Streets:
    """The network with what each request adds to it: a start inside an edge is a
    node of its own (-1 - request_id), and the halves of that edge have the ids
    -1 - 2 * request_id and the one before."""

    starts: DataFrame
    nodes: DataFrame
    edges: DataFrame
    edge_pois: DataFrame
    own_edges: DataFrame


def starts(requests: DataFrame, net: N.Network, most: float = 100.0) -> DataFrame:
    """`requests(request_id, lat, lon, ...)` with state: ok, invalid (no place) or
    far (no street without steps within `most` metres); and for those that are ok
    node, start_lat, start_lon, offset_m and, if the start splits an edge, edge_id
    and t."""
    known = requests.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    edges = net.edges.where("not steps").select("edge_id", "u", "v", *_PLACES)
    best = spatial.near_edges(known.select("request_id", "lat", "lon"), edges, most).groupBy("request_id").agg(F.min(F.struct(F.col("on.distance").alias("distance"), "edge_id", F.col("on.t").alias("t"), "u", "v", *_PLACES)).alias("s"))
    t = F.col("s.t")
    end = F.when(t < 0.001, F.struct(F.col("s.u").alias("node"), F.col("s.lat1").alias("lat"), F.col("s.lon1").alias("lon"))).when(t > 0.999, F.struct(F.col("s.v").alias("node"), F.col("s.lat2").alias("lat"), F.col("s.lon2").alias("lon")))
    split = F.struct((-1 - F.col("request_id").cast("long")).alias("node"), (F.col("s.lat1") + t * (F.col("s.lat2") - F.col("s.lat1"))).alias("lat"), (F.col("s.lon1") + t * (F.col("s.lon2") - F.col("s.lon1"))).alias("lon"))
    # On a split the offset is the distance of the projection, else of the node.
    rows = requests.join(best, "request_id", "left").withColumn("end", end).withColumn("at", F.when(F.col("s").isNotNull(), F.coalesce("end", split)))
    offset = F.when(F.col("end").isNotNull(), geo.meters(F.col("lat"), F.col("lon"), F.col("at.lat"), F.col("at.lon"))).otherwise(F.col("s.distance"))
    bad = F.col("lat").isNull() | F.col("lon").isNull() | F.isnan("lat") | F.isnan("lon")
    state = F.when(bad, "invalid").when(F.col("s").isNull(), "far").otherwise("ok")
    inside = F.col("end").isNull() & F.col("s").isNotNull()
    return rows.select(*requests.columns, state.alias("state"), F.col("at.node").alias("node"), F.col("at.lat").alias("start_lat"), F.col("at.lon").alias("start_lon"), offset.alias("offset_m"), F.when(inside, F.col("s.edge_id")).alias("edge_id"), F.when(inside, t).alias("t"))


def streets(net: N.Network, requests: DataFrame) -> Streets:
    """The written network and starts of `requests(request_id, lat, lon, distance,
    avoid_steps)`, with split edges for starts inside one."""
    edges, _ = store.written(net.edges.withColumns({"physical_length": F.col("length"), **{f"physical_{c}": F.col(c) for c in _PLACES}}), "edges")
    nodes, _ = store.written(N.nodes_of(edges), "nodes")
    edge_pois, _ = store.written(net.edge_pois.join(net.pois, "poi_id").select("edge_id", "poi_id", "kind", F.col("lat").alias("poi_lat"), F.col("lon").alias("poi_lon")), "edge-pois")
    found, _ = store.written(starts(requests, N.Network(nodes, edges, net.pois, net.edge_pois)), "starts")
    cut = found.where("edge_id is not null").select("request_id", "edge_id", "node", "t", "start_lat", "start_lon")
    halves = cut.join(edges, "edge_id").withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    first = F.col("half") == 0
    share = F.when(first, F.col("t")).otherwise(1 - F.col("t"))
    pick = lambda a, b: F.when(first, a).otherwise(b)
    changed = {
        "u": pick(F.col("u"), F.col("node")),
        "v": pick(F.col("node"), F.col("v")),
        "length": F.col("length") * share,
        "cross_fraction": F.col("cross_fraction") * share,
        "lat1": pick(F.col("lat1"), F.col("start_lat")),
        "lon1": pick(F.col("lon1"), F.col("start_lon")),
        "lat2": pick(F.col("start_lat"), F.col("lat2")),
        "lon2": pick(F.col("start_lon"), F.col("lon2")),
    }
    own = halves.withColumns(changed).withColumn("parent", F.col("edge_id")).withColumn("edge_id", -1 - 2 * F.col("request_id").cast("long") - F.col("half"))
    own, _ = store.written(own.drop("node", "t", "start_lat", "start_lon", "half"), "own-edges")
    pois = edge_pois.union(own.select("edge_id", F.col("parent").alias("p")).join(edge_pois.withColumnRenamed("edge_id", "p"), "p").drop("p"))
    return Streets(found, nodes, edges, pois, own)


def _targets(labels: DataFrame, s: Streets, variants: int = VARIANTS) -> DataFrame:
    """run_id, variant, place (order) and node: in each of the sectors around the
    start and for each ratio the node whose way out is nearest to that share of
    the distance."""
    # The start's own node comes after all others.
    far = labels.join(s.nodes, "node_id").where("length >= distance * 0.17")
    turn = F.atan2((F.col("lon") - F.col("start_lon")) * F.cos(F.radians("start_lat")), F.col("lat") - F.col("start_lat")) + 2 * 3.141592653589793 + F.col("variant") % 4 * (3.141592653589793 / 32)
    sector = F.pmod(F.floor(turn / (2 * 3.141592653589793) * SECTORS), F.lit(SECTORS))
    each = far.withColumn("variant", F.explode(F.array(*map(F.lit, range(variants))))).withColumn("sector", sector)
    each = each.select("run_id", "variant", "sector", "node_id", "node_seq", "length", "distance", F.posexplode(F.array(*map(F.lit, RATIOS))).alias("r", "ratio"))
    best = each.groupBy("run_id", "variant", "sector", "r").agg(F.min(F.struct(F.abs(F.col("length") - F.col("distance") * F.col("ratio")).alias("gap"), "node_seq", "node_id", "length")).alias("s"))
    once = best.groupBy("run_id", "variant", F.col("s.node_id").alias("target"), F.col("s.length").alias("out_m")).agg(F.min(F.col("sector") * len(RATIOS) + F.col("r")).alias("first"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("run_id", "variant").orderBy("first"))).drop("first")


def candidates(net: N.Network, requests: DataFrame, strategies: list[str] = STRATEGIES, variants: int = VARIANTS) -> tuple[DataFrame, DataFrame, Streets]:
    """(arcs, targets, streets): the arcs of all candidate routes of `requests(
    request_id, lat, lon, distance, avoid_steps)` under each strategy and variant.

    arcs: request_id, strategy, variant, place, kind, seq, edge_id, from_node,
    to_node, length, lat1, lon1, lat2, lon2.  For each target (place) there are
    routes out and back of 80, 100 and 120 % of the distance (kind 0 to 2) and the
    way there with returns that pay 2.5 and 8 times on edges of the way there
    (kind 3 and 4).  Requests outside 1 to 12 km or without a start have none."""
    s = streets(net, requests)
    ok = s.starts.where("state = 'ok' and distance between 1000 and 12000")
    arcs, _ = store.written(N.arcs(N.Network(s.nodes, s.edges, net.pois, net.edge_pois), strategies), "arcs")
    own_net = N.Network(s.nodes, s.own_edges, net.pois, net.edge_pois)
    owner = s.own_edges.select("edge_id", "request_id")
    own_arcs, _ = store.written(N.arcs(own_net, strategies).join(owner, "edge_id"), "own-arcs")
    runs = ok.select("request_id", "distance", "avoid_steps", F.col("edge_id").alias("cut_edge"), "node", "start_lat", "start_lon", F.posexplode(F.array(*map(F.lit, strategies))).alias("n", "profile"))
    runs, _ = store.written(runs.withColumn("run_id", F.col("request_id").cast("long") * len(strategies) + F.col("n")), "runs")
    trees = runs.select(F.col("run_id").alias("tree_id"), F.col("node").alias("start"), "profile", (F.col("distance") * 1.2 * 0.7).alias("max_length"), "avoid_steps", "request_id", "cut_edge")
    at, _ = store.written(paths.blocks(s.nodes), "blocks")
    out, _ = paths.shortest_trees(arcs, trees, own_arcs, at)
    reached = out.select(F.col("tree_id").alias("run_id"), F.col("node").alias("node_id"), "length").join(runs.drop("cut_edge", "node", "n"), "run_id")
    targets, _ = store.written(_targets(reached, s, variants), "targets")
    ends = targets.select(F.col("run_id").alias("tree_id"), "target").distinct()
    there, _ = paths.paths(out, ends)
    there = there.withColumnRenamed("tree_id", "run_id")
    w = Window.partitionBy("run_id", "target").orderBy(F.col("back").desc())
    there, _ = store.written(there.withColumn("seq", F.row_number().over(w)).drop("back"), "there")
    used = there.groupBy("run_id", "target").agg(F.collect_set("edge_id").alias("penalized"))
    lengths = targets.select("run_id", "target", "out_m").distinct()
    home = runs.join(lengths, "run_id").join(used, ["run_id", "target"]).withColumn("k", F.explode(F.array(*map(F.lit, range(len(PENALTIES))))))
    home = home.withColumn("tree_id", F.xxhash64("run_id", "target", "k")).withColumn("penalty", F.element_at(F.array(*map(F.lit, PENALTIES)), F.col("k") + 1))
    home, _ = store.written(home, "home")
    trees = home.select("tree_id", F.col("target").alias("start"), "profile", (F.col("distance") * 1.2 - F.col("out_m")).alias("max_length"), "avoid_steps", "request_id", "cut_edge", "penalty", "penalized", F.col("node").alias("goal"))
    back, _ = paths.shortest_trees(arcs, trees, own_arcs, at)
    came, _ = paths.paths(back, home.select("tree_id", F.col("node").alias("target")))
    came = came.drop("target").join(home.select("tree_id", "run_id", "target", "k"), "tree_id")
    places = s.edges.select("edge_id", "u", "v", "length", "direction", *_PLACES).union(s.own_edges.select("edge_id", "u", "v", "length", "direction", *_PLACES))
    placed = lambda rows: _placed(rows, places)
    there_at, _ = store.written(placed(there.select("run_id", "target", "seq", "edge_id", "u", "v")), "there-arcs")
    turns = _outbacks(there_at, lengths.join(runs.select("run_id", "distance"), "run_id"))
    both = there_at.join(came.select("run_id", "target", "k").distinct(), ["run_id", "target"])
    w = Window.partitionBy("tree_id").orderBy(F.col("back").desc())
    came_at = placed(came.withColumn("seq", F.row_number().over(w) + 1_000_000).select("run_id", "target", "k", "seq", "edge_id", "u", "v"))
    returns = both.unionByName(came_at).withColumn("kind", F.col("k") + 3).drop("k", "direction")
    rows = turns.unionByName(returns.withColumn("seq", F.col("seq").cast("long")))
    w = Window.partitionBy("run_id", "target", "kind").orderBy("seq")
    rows = rows.withColumn("seq", F.row_number().over(w))
    rows, _ = store.written(rows, "candidate-arcs")
    owned = targets.join(runs.select("run_id", "request_id", F.col("profile").alias("strategy")), "run_id")
    rows = owned.join(rows, ["run_id", "target"]).select("request_id", "strategy", "variant", "place", "kind", "seq", "edge_id", F.col("u").alias("from_node"), F.col("v").alias("to_node"), "length", *_PLACES)
    return rows, owned, s


def _placed(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Arcs (edge_id, u, v) with length, direction and the places of both ends."""
    sides = places.withColumnsRenamed({"u": "eu", "v": "ev"})
    met = rows.join(sides, "edge_id")
    forward = F.col("u") == F.col("eu")
    flip = {"lat1": ("lat1", "lat2"), "lon1": ("lon1", "lon2"), "lat2": ("lat2", "lat1"), "lon2": ("lon2", "lon1")}
    return met.withColumns({c: F.when(forward, F.col(a)).otherwise(F.col(b)) for c, (a, b) in flip.items()}).drop("eu", "ev")


def _outbacks(there: DataFrame, lengths: DataFrame) -> DataFrame:
    """Out and back on the way there of `there(run_id, target, seq, edge_id, u, v,
    length, direction, places)`: cut where half the total is walked, then mirrored.
    None on edges that are one-way on foot, or where the way is shorter."""
    totals = F.array(F.col("distance") * (1 - 0.2), F.col("distance") * 1.0, F.col("distance") * (1 + 0.2))
    wanted = lengths.select("run_id", "target", "out_m", F.posexplode(totals).alias("kind", "total")).withColumn("half", F.col("total") / 2).where("out_m >= half")
    w = Window.partitionBy("run_id", "target", "kind").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = there.join(wanted, ["run_id", "target"]).withColumn("done", F.sum("length").over(w))
    rows = rows.withColumn("left", F.col("half") - F.col("done") + F.col("length")).where("left > 0.001")
    cut = F.least("left", "length")
    f = cut / F.col("length")
    rows = rows.withColumns({"lat2": F.col("lat1") + f * (F.col("lat2") - F.col("lat1")), "lon2": F.col("lon1") + f * (F.col("lon2") - F.col("lon1")), "length": cut})
    whole = Window.partitionBy("run_id", "target", "kind")
    rows = rows.withColumn("oneway", F.max(F.col("direction") != 0).over(whole)).withColumn("sum", F.sum("length").over(whole)).where("not oneway and half - sum <= 0.1")
    keep = ["run_id", "target", "kind", "seq", "edge_id", "u", "v", "length", *_PLACES]
    out = rows.select(keep)
    back = rows.select("run_id", "target", "kind", (2_000_000 - F.col("seq")).alias("seq"), "edge_id", F.col("v").alias("u"), F.col("u").alias("v"), "length", F.col("lat2").alias("lat1"), F.col("lon2").alias("lon1"), F.col("lat1").alias("lat2"), F.col("lon1").alias("lon2"))
    return out.union(back.select(keep)).withColumn("seq", F.col("seq").cast("long")).withColumn("kind", F.col("kind").cast("int"))


@dataclass
class Exploration:
    """routes: request_id, route_id, candidate, length, error, closure_m, signature,
    n_searches; searches: which strategies and variants found each route;
    batches: eligible, unique and attempted per request, strategy and variant;
    segments and points of the routes; streets; completions: which routes are
    short ones (parent) made whole by an excursion at at_m of added_m metres."""

    routes: DataFrame
    searches: DataFrame
    batches: DataFrame
    segments: DataFrame
    points: DataFrame
    streets: Streets
    completions: DataFrame


def _eligible(arcs: DataFrame, requests: DataFrame) -> DataFrame:
    """Closed routes of `arcs` within the bounds, with length, error and signature."""
    at = evaluate.points(arcs)
    lengths = arcs.groupBy("request_id", "strategy", "variant", "route_id").agg(F.sum("length").alias("length"))
    lengths = lengths.join(requests.select("request_id", "distance"), "request_id").withColumn("error", F.abs(F.col("length") - F.col("distance")) / F.col("distance"))
    valid = ranking.within_bounds(lengths.join(sequence.closures(at), "route_id"))
    return store.written(valid.join(evaluate.signatures(at), "route_id"), "eligible")[0]


def _completions(arcs: DataFrame, valid: DataFrame, s: Streets, net: N.Network) -> tuple[DataFrame, DataFrame]:
    """(arcs, found): the short routes of each search made whole, as further routes
    of that search.  Routes of several searches are completed once."""
    from loopwise.operators import completions

    once = valid.withColumn("parent", F.min("route_id").over(Window.partitionBy("request_id", "signature")))
    mine = F.row_number().over(Window.partitionBy("request_id", "strategy", "variant", "signature").orderBy("route_id"))
    copies = once.withColumn("n", mine).where("n = 1").select("request_id", "strategy", "variant", "route_id", "parent")
    firsts = once.where("route_id = parent").select("route_id", "request_id", "length", "distance")
    proposals, whole = completions.completed(arcs.join(firsts.select("route_id"), "route_id", "left_semi"), firsts, s, net)
    # Behind all routes of the same search, in their order.
    number = F.floor(F.col("route_id") / IDS) * IDS + 1000 + F.col("route_id") % IDS * 2 + F.col("nth") - 1
    found = copies.join(proposals.select(F.col("route_id").alias("parent"), F.col("place").alias("nth"), "at_m", "added_m", "method"), "parent").withColumn("route_id", number)
    found, _ = store.written(found, "completions")
    more = found.join(whole.select(F.col("route_id").alias("parent"), F.col("place").alias("nth"), "seq", "edge_id", "from_node", "to_node", "length", *_PLACES), ["parent", "nth"])
    return more.select("request_id", "strategy", "variant", "route_id", "seq", "edge_id", "from_node", "to_node", "length", *_PLACES), found


def explored(net: N.Network, requests: DataFrame, strategies: list[str] = STRATEGIES, variants: int = VARIANTS, complete: bool = True) -> Exploration:
    """All closed routes of the requests (see `candidates`) within 20 % of the
    distance: of routes with the same corners the first counts, in the order of
    variants, strategies, targets and kinds, and is named candidate-0001 and on.
    Those that miss a little of the distance are made whole by an excursion as well
    (`complete`), as the last routes of the search that found them."""
    arcs, targets, s = candidates(net, requests, strategies, variants)
    n = len(strategies)
    number = F.array_position(F.array(*map(F.lit, strategies)), F.col("strategy")) - 1
    # Eighty targets at most, five kinds: the number keeps the order of search.
    route_id = ((F.col("request_id").cast("long") * variants + F.col("variant")) * n + number) * IDS + F.col("place") * 10 + F.col("kind")
    arcs, _ = store.written(arcs.withColumn("route_id", route_id), "route-arcs")
    valid = _eligible(arcs, requests)
    made = None
    if complete:
        more, made = _completions(arcs, valid, s, net)
        arcs, _ = store.written(arcs.select(more.columns).unionByName(more.withColumn("seq", F.col("seq").cast(arcs.schema["seq"].dataType))), "all-arcs")
        valid, _ = store.written(valid.unionByName(_eligible(arcs.join(made.select("route_id"), "route_id", "left_semi"), requests)), "all-eligible")
    first = F.min("route_id").over(Window.partitionBy("request_id", "signature"))
    named = valid.withColumn("first", first)
    searches = named.select("request_id", F.col("first").alias("route_id"), "strategy", "variant").distinct()
    routes = named.where("route_id = first").withColumn("n", F.row_number().over(Window.partitionBy("request_id").orderBy("route_id")))
    counts = searches.groupBy("route_id").agg(F.count("*").alias("n_searches"))
    routes, _ = store.written(routes.join(counts, "route_id").select("request_id", "route_id", F.concat(F.lit("candidate-"), F.lpad(F.col("n").cast("string"), 4, "0")).alias("candidate"), "distance", "length", "error", "closure_m", "signature", "n_searches"), "routes")
    found = valid.groupBy("request_id", "strategy", "variant").agg(F.count("*").alias("eligible"), F.countDistinct("signature").alias("unique"))
    tried = targets.groupBy("request_id", "strategy", "variant").agg((F.count("*") * len(PENALTIES)).alias("attempted"))
    batches = tried.join(found, ["request_id", "strategy", "variant"], "left").fillna(0, ["eligible", "unique"])
    kept = arcs.join(routes.select("route_id"), "route_id", "left_semi")
    every = s.edges.unionByName(s.own_edges.drop("request_id", "parent"))
    segments, _ = store.written(evaluate.segments(kept, every).withColumn("seq", F.col("seq").cast("long")), "segments")
    points, _ = store.written(evaluate.points(kept), "points")
    columns = ["request_id", "route_id", "parent", "at_m", "added_m", "method"]
    if made is None:
        made = routes.limit(0).select("request_id", "route_id", F.col("route_id").alias("parent"), F.col("length").alias("at_m"), F.col("length").alias("added_m"), F.col("candidate").alias("method"))
    else:
        made = made.join(named.select("route_id", "first"), "route_id").withColumn("route_id", F.col("first"))
    return Exploration(routes, searches, batches, segments, points, s, made.select(columns).distinct())


def broken(routes: DataFrame) -> DataFrame:
    """One row: how many routes break the promises of a search: an error above 20 %
    or an open end."""
    return routes.agg(F.count_if((F.col("error") > 0.2 + 1e-8) | (F.col("closure_m") > 0.1)).alias("n_broken"))
