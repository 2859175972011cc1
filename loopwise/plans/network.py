"""Registered queries over the street network."""

from __future__ import annotations

from pyspark.sql import functions as F

from loopwise.operators import completions, evaluate, explore, nearby, network, results, sequence
from loopwise.plans.base import query, rounded
from loopwise.sources import routes as R
from loopwise.sources import streets as S
from loopwise.sources import tiles


@query(S.SQL + " select physical_id, u, v, round(length, 6) length, street, crossing, signal, boulevard, round(cross_fraction, 6) cross_fraction, direction::bigint direction, n_pois from net")
def network_edges(spark, d):
    edges = network.build(S.elements(spark, d)).edges
    return rounded(edges.select("physical_id", "u", "v", "length", "street", "crossing", "signal", "boulevard", "cross_fraction", "direction", "n_pois"))


@query(S.SQL + " select (select count(*) from (select u from net union select v from net)) n_nodes, (select count(*) from net) n_edges, (select count(*) from pois where poi_id % 2 = 0 and poi_id % 10 <> 9) n_shops, (select count(*) from pois where poi_id % 2 = 1 and poi_id % 10 <> 9) n_water")
def network_stats(spark, d):
    return network.stats(network.build(S.elements(spark, d)))


def _requests(spark, d, distance: float = 1000.0):
    """One request for each region, off the streets by some metres."""
    k = F.col("r_regionkey")
    return spark.read.parquet(f"{d}/region.parquet").select(k.alias("request_id"), (36.0004 + k * F.lit(0.0007)).alias("lat"), (129.3031 + k * F.lit(0.0012)).alias("lon"), F.lit(distance).alias("distance"), (k % 2 == 0).alias("avoid_steps"))


def _heights(spark, x):
    """Heights of all routes over a raster of slopes, which knows every pixel."""
    x0, y0, width, height = tiles.terrain_window((35.9, 129.2, 36.1, 129.4), 12)
    grid = spark.range(width * height).select((F.col("id") % width).alias("ix"), F.floor(F.col("id") / width).alias("iy"))
    return results.heights(x, grid.withColumn("value", (F.col("ix") * 3.0 + F.col("iy") * 5.0) % 40), 12, x0, y0)


def _places(spark, d):
    """One request for each nation, every 30 metres or so along the lattice."""
    k = F.col("n_nationkey")
    return spark.read.parquet(f"{d}/nation.parquet").select(k.cast("long").alias("request_id"), (36.0004 + k * F.lit(0.00031)).alias("lat"), (129.3031 + k * F.lit(0.00047)).alias("lon"), F.lit(1000.0).alias("distance"), (k % 2 == 0).alias("avoid_steps"))


@query()
def explored_routes(spark, d):
    """All closed routes that the searches find for each region's request, with
    what they pass and how they repeat."""
    x = explore.explored(network.build(S.elements(spark, d)), _requests(spark, d))
    found = evaluate.facilities(x.segments, x.streets.edge_pois)
    measured = evaluate.measured(x.segments)
    rows = x.routes.select("route_id", "candidate", "error", "signature", "n_searches").join(measured, "route_id").join(evaluate.supply(x.routes, found), "route_id").join(evaluate.shapes(x.points, measured), "route_id")
    return rounded(rows)


@query()
def recommended_courses(spark, d):
    """The main query: courses found for each region's request, with the reasons to
    recommend them and their families."""
    x = explore.explored(network.build(S.elements(spark, d)), _requests(spark, d))
    r = results.results(x, _heights(spark, x))
    cards = r.cards.select("route_id", "reasons")
    place = r.families.select("route_id", "cluster", "place")
    rows = r.routes.select("request_id", "route_id", "candidate", "length", "final_score", "shape", "n_signals", "n_unknown").join(place, "route_id").join(cards, "route_id", "left")
    return rounded(rows)


@query()
def nearby_access(spark, d):
    """Starts with better streets around each nation's place, with the ways there
    and back."""
    net = network.build(S.elements(spark, d))
    return rounded(nearby.access(explore.streets(net, _places(spark, d)), net))


@query()
def nearby_starts(spark, d):
    """Routes from starts near each region's own: the leaders found there, with
    every gate and, for those that are proposed, their place."""
    net, requests = network.build(S.elements(spark, d)), _requests(spark, d)
    x = explore.explored(net, requests)
    n = nearby.nearby_starts(net, requests, x, results.results(x))
    rows = n.routes.select("request_id", "place", "route_id", "length", "walk_m", "gain", "near_distance", "short_access", "no_more_steps", "no_more_crossings", "worth", F.array_join("reasons", ",").alias("reasons"), "qualified")
    return rounded(rows.join(n.proposals.drop("place"), ["request_id", "route_id"], "left"))


@query()
def search_batches(spark, d):
    """How many routes each search of each request tried, found and kept."""
    return explore.explored(network.build(S.elements(spark, d)), _requests(spark, d)).batches


@query()
def completed_routes(spark, d):
    """Excursions that make short routes whole."""
    net = network.build(S.elements(spark, d))
    arcs, _, s = explore.candidates(net, _requests(spark, d))
    key = F.xxhash64("request_id", "strategy", "variant", "place", "kind")
    arcs = arcs.withColumn("route_id", key)
    routes = arcs.groupBy("route_id", "request_id").agg(F.sum("length").alias("length")).withColumn("distance", F.lit(1000.0))
    return rounded(completions.completed(arcs, routes, s, net)[0])


@query(""", rw as (select s1.route_id, min(request_id) request_id, max(case when of >= 3 and of % 2 = 1 and far < 0.5 then 'outback' else 'other' end) shape from segments s1 join (select a.route_id, max(a.of) of, max(""" + S._METERS.format("a.lat", "b.lat", "a.lon", "b.lon") + """) far
  from (select *, row_number() over w n, count(*) over (partition by route_id) of from points window w as (partition by route_id order by i)) a join (select *, row_number() over w n from points window w as (partition by route_id order by i)) b on b.route_id = a.route_id and b.n = a.of + 1 - a.n group by 1) q on q.route_id = s1.route_id group by 1),
ru as (select route_id, sum(total - longest) / sum(total) r from (select route_id, physical_id, sum(length) total, max(length) longest from segments group by 1, 2) group by 1)
select request_id, count(*) filter (shape <> 'outback' and r <= 0.08) n_loop, count(*) filter (shape <> 'outback' and r > 0.08) n_partial, count(*) filter (shape = 'outback') n_outback from rw join ru using (route_id) group by 1""")
def shape_counts(spark, d):
    rows = R.segments(spark, d)
    usage = sequence.edge_usage(rows).select("route_id", (F.col("repeated_m") / F.col("length")).alias("repeat_ratio"))
    return results.shape_counts(evaluate.shapes(R.points(spark, d), usage).join(rows.select("request_id", "route_id").distinct(), "route_id"))
