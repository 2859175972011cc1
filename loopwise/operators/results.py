"""From explored routes to what a request is shown."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwise import store
from loopwise.operators import elevation, evaluate, families, ranking, sequence
from loopwise.operators.explore import Exploration


@dataclass
class Results:
    """routes: every route with its evidence, scores, passages and shape; cards and
    pending reasons of each request; families: every route's family and place in it;
    family_stats; variants: how a member differs from the one that leads."""

    routes: DataFrame
    cards: DataFrame
    pending: DataFrame
    families: DataFrame
    family_stats: DataFrame
    variants: DataFrame


def results(x: Exploration, heights: DataFrame | None = None) -> Results:
    """All routes are scored against each other, whatever their family; without
    `heights(route_id, elevation_known, range_m)` no profile is known.  Passages
    count a way back over a crossing again, by what the network knows of it."""
    asked = x.routes.select("route_id", "distance", "candidate")
    evidence = sequence.route_evidence(x.segments).join(asked, "route_id")
    pairs, _ = store.written(sequence.similar_pairs(sequence.coverage_sweep(x.segments)), "pairs")
    scored = ranking.subset_penalty(ranking.scored(evidence, F.col("distance")), pairs, F.col("distance"))
    signals = x.segments.where("crossing").groupBy("physical_id").agg(F.max_by("signal", "edge_id").alias("signal"))
    passed = sequence.crossing_passages(x.segments, signals)
    measured = evaluate.measured(x.segments)
    shape = evaluate.shapes(x.points, measured)
    if heights is None:
        heights = x.routes.select("route_id", F.lit(False).alias("elevation_known"), F.lit(None).cast("double").alias("range_m"))
    rows = scored.join(passed, "route_id").join(shape, "route_id").join(heights, "route_id", "left").fillna(False, ["elevation_known"])
    routes, _ = store.written(ranking.rank_score(rows), "scored-routes")
    members, stats = families.clusters(routes.select("request_id", "route_id"), pairs)
    groups = sequence.crossing_groups(x.segments).select("route_id", "n_crossings")
    burden = sequence.recorded_burden(x.segments).join(groups, "route_id", "left").fillna(0, ["n_crossings"])
    decided = families.completions_decided(members, routes, pairs, burden, F.col("distance"))
    ranked, _ = store.written(families.representatives(members, routes, decided), "families")
    return Results(routes, ranking.recommend(routes), ranking.pending(routes), ranked, stats, families.variants(ranked, pairs))


def heights(x: Exploration, terrain: DataFrame, zoom: int, x0: int, y0: int) -> DataFrame:
    """elevation_known and range_m of every route over a raster (see
    `elevation.profile`); bridges and tunnels are unknown."""
    shut = x.segments.select("route_id", F.col("seq").alias("i"), "bridge", "tunnel")
    line = x.points.join(shut, ["route_id", "i"], "left")
    return elevation.ranges(elevation.profile(line, terrain, zoom, x0, y0), "route_id")


def shape_counts(shapes: DataFrame) -> DataFrame:
    """Loops, partial ones and outbacks of each request."""
    return shapes.groupBy("request_id").agg(*[F.count_if(F.col("shape") == s).alias(f"n_{s}") for s in ("loop", "partial", "outback")])
