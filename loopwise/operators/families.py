"""Families of similar routes, and short lists that differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopwise import store
from loopwise.operators import ranking, sequence

# Least mean and least single similarity within a family.
MEAN, FLOOR, SLACK = 0.65, 0.50, 1e-9
#: Fixed value: routes of a short list overlap by less.
DIVERSE = 0.78


def clusters(routes: DataFrame, pairs: DataFrame, mean: float = MEAN, floor: float = FLOOR) -> tuple[DataFrame, DataFrame]:
    """(members, stats) of average linkage with a floor: of `routes(request_id,
    route_id)` and the similarities `pairs(request_id, a, b, dice)`, where absent
    pairs are 0, the most similar clusters are merged as long as their mean is at
    least `mean` and no pair of theirs is below `floor`.

    members: request_id, route_id, cluster (its smallest route_id).  stats: per
    cluster n_pairs, mean_similarity, min_similarity and last_merge (1 for a
    single route).

    Every round merges all pairs of clusters that are each other's best; merging
    others never brings either a better one, so the order among them is free.
    Only sums, counts and minima of the pairs of clusters are kept, and a pair of
    clusters with an absent pair is dropped: it can't merge any more."""
    spark = routes.sparkSession
    wrong = pairs.where("dice is null or isnan(dice) or dice < 0 or dice > 1 + 1e-8")
    if not wrong.isEmpty():
        raise ValueError("similarities lie between 0 and 1")
    sizes = routes.select("request_id", F.col("route_id").alias("cluster"), F.lit(1).cast("long").alias("n"), F.lit(1.0).alias("last_merge"))
    near = pairs.where(F.col("dice") >= floor - SLACK).select("request_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("dice", F.lit(1.0)).alias("sum"), F.lit(1).cast("long").alias("count"), F.least("dice", F.lit(1.0)).alias("least"))
    sizes, sizes_at = store.written(sizes, "clusters")
    near, near_at = store.written(near, "near")
    member = routes.select("request_id", "route_id", F.col("route_id").alias("cluster"))
    member, member_at = store.written(member, "members")
    while True:
        n = lambda c: sizes.select("request_id", F.col("cluster").alias(c), F.col("n").alias(f"n{c}"))
        able = near.join(n("a"), ["request_id", "a"]).join(n("b"), ["request_id", "b"]).where("count = na * nb").withColumn("mean", F.col("sum") / F.col("count"))
        able = able.where((F.col("mean") >= mean - SLACK) & (F.col("least") >= floor - SLACK))
        order = F.struct((-F.col("mean")).alias("minus"), "a", "b")
        each = able.select("request_id", order.alias("o"), F.explode(F.array("a", "b")).alias("c"))
        best = each.groupBy("request_id", "c").agg(F.min("o").alias("o"))
        merged = best.groupBy("request_id", "o").agg(F.count("*").alias("k")).where("k = 2").select("request_id", F.col("o.a").alias("into"), F.col("o.b").alias("b"), (-F.col("o.minus")).alias("score"))
        merged, merged_at = store.written(merged, "merged")
        if merged.isEmpty():
            store.drop(spark, merged_at)
            break
        to = merged.select("request_id", F.col("b").alias("cluster"), "into")
        new = F.coalesce("into", "cluster").alias("cluster")
        member, fresh = store.written(member.join(to, ["request_id", "cluster"], "left").select("request_id", "route_id", new), "members")
        last = merged.select("request_id", F.col("into").alias("cluster"), "score")
        sized = sizes.join(to, ["request_id", "cluster"], "left").select("request_id", new, "n", F.when(F.col("into").isNull(), F.col("last_merge")).alias("last_merge"))
        sized = sized.groupBy("request_id", "cluster").agg(F.sum("n").alias("n"), F.max("last_merge").alias("last_merge"))
        sizes, fresh_sizes = store.written(sized.join(last, ["request_id", "cluster"], "left").select("request_id", "cluster", "n", F.coalesce("score", "last_merge").alias("last_merge")), "clusters")
        ends = near
        for c in ("a", "b"):
            ends = ends.join(to.select("request_id", F.col("cluster").alias(c), F.col("into").alias(f"to_{c}")), ["request_id", c], "left").withColumn(c, F.coalesce(f"to_{c}", c)).drop(f"to_{c}")
        ends = ends.where("a <> b").groupBy("request_id", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.min("least").alias("least"))
        near, fresh_near = store.written(ends.withColumnsRenamed({"x": "a", "y": "b"}), "near")
        store.drop(spark, member_at, sizes_at, near_at, merged_at)
        member_at, sizes_at, near_at = fresh, fresh_sizes, fresh_near
    inside = pairs.select("request_id", "a", "b", F.least("dice", F.lit(1.0)).alias("dice")).join(member.select("request_id", F.col("route_id").alias("a"), "cluster"), ["request_id", "a"])
    inside = inside.join(member.select("request_id", F.col("route_id").alias("b"), F.col("cluster").alias("other")), ["request_id", "b"]).where("cluster = other")
    sums = inside.groupBy("request_id", "cluster").agg(F.sum("dice").alias("sum"), F.min("dice").alias("low"))
    count = F.col("n") * (F.col("n") - 1) / 2
    stats = sizes.join(sums, ["request_id", "cluster"], "left")
    stats = stats.select("request_id", "cluster", "n", count.cast("long").alias("n_pairs"), F.when(F.col("n") > 1, F.col("sum") / count).otherwise(1.0).alias("mean_similarity"), F.coalesce("low", F.lit(1.0)).alias("min_similarity"), "last_merge")
    return member, stats


def completions_decided(members: DataFrame, routes: DataFrame, pairs: DataFrame, burden: DataFrame, target) -> DataFrame:
    """(cluster, winner, loser, shorter, full, added) for members of one family of
    which the shorter misses the target (metres or a column) by little and the full
    one, within a metre of it, contains it: more recorded burden lets the shorter
    win."""
    wanted = routes.select("route_id", "length", F.lit(target).alias("target_m"))
    inside = members.join(wanted, "route_id")
    missing = F.col("target_m") - F.col("length")
    short = ranking.small_deficit(inside, F.col("target_m")).select("request_id", "cluster", F.col("route_id").alias("shorter"), F.col("length").alias("short_m"))
    full = inside.where(F.abs(missing) <= 1).select("request_id", "cluster", F.col("route_id").alias("full"), F.col("length").alias("full_m"))
    each = pairs.select(F.col("a").alias("shorter"), F.col("b").alias("full"), "shared_m", F.least("total_a", "total_b").alias("least"))
    each = each.union(pairs.select("b", "a", "shared_m", F.least("total_a", "total_b")))
    met = short.join(full, ["request_id", "cluster"]).where("full_m > short_m + 0.5").join(each, ["shorter", "full"]).where("shared_m >= 0.999 * least")
    added = sequence.added_burden(met.withColumnRenamed("full", "longer"), burden).withColumnRenamed("longer", "full")
    worse = F.size("added") > 0
    pick = lambda a, b: F.when(worse, F.col(a)).otherwise(F.col(b))
    return added.select("request_id", "cluster", pick("shorter", "full").alias("winner"), pick("full", "shorter").alias("loser"), "shorter", "full", "added")


def representatives(members: DataFrame, routes: DataFrame, decided: DataFrame) -> DataFrame:
    """(request_id, cluster, route_id, place) of all members by final_score, error
    and id, led (place 1) by the first that lost no decision, or by the first."""
    lost = decided.select(F.col("loser").alias("route_id"), F.lit(True).alias("lost")).distinct()
    rows = members.join(routes.select("route_id", "final_score", "error"), "route_id").join(lost, "route_id", "left")
    rank = Window.partitionBy("request_id", "cluster").orderBy(F.col("final_score").desc(), "error", "route_id")
    rows = rows.withColumn("rank", F.row_number().over(rank)).withColumn("free", F.when(F.col("lost").isNull(), F.col("rank")))
    lead = F.coalesce(F.min("free").over(Window.partitionBy("request_id", "cluster")), F.lit(1))
    rows = rows.withColumn("led", F.col("rank") != lead)
    place = F.row_number().over(Window.partitionBy("request_id", "cluster").orderBy("led", "rank"))
    return rows.select("request_id", "cluster", "route_id", place.cast("long").alias("place"))


def variants(ranked: DataFrame, pairs: DataFrame) -> DataFrame:
    """How the other members differ from their representative (`variation` of the
    pair; without shared metres: path), by family."""
    lead = ranked.where("place = 1").select("request_id", "cluster", F.col("route_id").alias("lead"))
    rest = ranked.where("place > 1").join(lead, ["request_id", "cluster"])
    kinds = sequence.variation(pairs).select("a", "b", "variation")
    both = kinds.union(kinds.select("b", "a", "variation")).withColumnsRenamed({"a": "lead", "b": "route_id"})
    return rest.join(both, ["lead", "route_id"], "left").select("request_id", "cluster", "route_id", F.coalesce("variation", F.lit("path")).alias("variation"))


def ranked(routes: DataFrame, profile: str) -> DataFrame:
    """`routes(request_id, route_id, n_crossings, shops, water, bonus, error,
    length)` with rank under a profile: flow by fewest crossings, supply by most
    facilities up to four, then by bonus, error and length; values are compared to
    eight decimals."""
    key = lambda c: F.floor(c * 1e8 + 0.5)
    first = {"flow": [key(F.col("n_crossings"))], "supply": [key(-F.least(F.lit(4), F.col("shops") + F.col("water")))]}.get(profile, [])
    w = Window.partitionBy("request_id").orderBy(*first, key(-F.col("bonus")), "error", "length", "route_id")
    return routes.withColumn("rank", F.row_number().over(w))


def selected(routes: DataFrame, overlaps: DataFrame, shape: str = "mixed", limit: int = 3) -> DataFrame:
    """(request_id, route_id, place): a short list of `routes(request_id, route_id,
    rank, shape, repeat_ratio)` of which no two overlap by DIVERSE or more.

    mixed: the best, then one of each shape that is missing, then by rank.  loop:
    loops by rank, then partial ones by how little repeats, then outbacks.
    outback: outbacks, partial ones, loops.  Each step adds, for all requests at
    once, the first route that may still be added."""
    spark = routes.sparkSession
    close = overlaps.where(F.col("overlap") >= DIVERSE)
    close, close_at = store.written(close.select("a", "b").union(close.select("b", "a")), "close")
    routes, routes_at = store.written(routes.select("request_id", "route_id", "rank", "shape", "repeat_ratio"), "ranked")
    if shape == "mixed":
        steps = [("first", None)] + [("missing", s) for s in ("loop", "partial", "outback")] + [("any", None)] * (limit - 1)
    else:
        order = ("loop", "partial", "outback") if shape == "loop" else ("outback", "partial", "loop")
        steps = [("of", s) for s in order for _ in range(limit)]
    chosen, at = store.written(routes.limit(0).select("request_id", "route_id", "shape", F.lit(0).alias("place")), "chosen")
    for n, (how, kind) in enumerate(steps):
        full = chosen.groupBy("request_id").agg(F.count("*").alias("k")).where(F.col("k") >= limit)
        barred = chosen.join(close, F.col("a") == F.col("route_id")).select(F.col("b").alias("route_id")).union(chosen.select("route_id"))
        left = routes.join(full, "request_id", "left_anti").join(barred, "route_id", "left_anti")
        if kind:
            left = left.where(F.col("shape") == kind)
        if how == "first":
            left = left.where("rank = 1")
        if how == "missing":
            left = left.join(chosen.where(F.col("shape") == kind), "request_id", "left_anti")
        key = F.struct("repeat_ratio", "rank") if shape == "loop" and kind == "partial" else F.struct("rank")
        best = left.groupBy("request_id").agg(F.min_by(F.struct("route_id", "shape"), key).alias("s")).select("request_id", "s.route_id", "s.shape", F.lit(n).alias("place"))
        chosen, fresh = store.written(chosen.union(best), "chosen")
        store.drop(spark, at)
        at = fresh
    w = Window.partitionBy("request_id").orderBy("place")
    return chosen.select("request_id", "route_id", F.row_number().over(w).cast("long").alias("place"))
