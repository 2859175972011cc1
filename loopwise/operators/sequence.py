"""Operators over the ordered segments of each route."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopwise.functions import geo
from loopwise.functions.evidence import PAVED, UNPAVED, WEIGHTS, walking

_COLUMNS = ["highway", "steps", "crossing", "surface", "lit", "width", "motor_allowed"]


def _columns() -> dict:
    return {c: F.col(c) for c in _COLUMNS}


#: Metres of a street on which routes are compared together.
STRETCH = 50.0


def route_evidence(segments: DataFrame) -> DataFrame:
    """Metres of each kind of evidence per route, the longest walk and the bonus
    that they earn; what is unknown counts for nothing."""
    on, length = walking(_columns()), F.col("length")

    def total(condition):
        return F.sum(F.when(condition, length).otherwise(0.0))

    paved, lit, wide = F.col("surface").isin(PAVED), F.col("lit") == "yes", F.col("width") >= 3
    sums = segments.groupBy("request_id", "route_id").agg(
        F.sum("length").alias("length"),
        total(on).alias("walk_m"),
        total(paved).alias("paved_m"),
        total(F.col("surface").isin(UNPAVED)).alias("unpaved_m"),
        total(F.col("surface").isNotNull()).alias("surface_known_m"),
        total(lit).alias("lit_yes_m"),
        total(F.col("lit") == "no").alias("lit_no_m"),
        total(F.col("lit").isin("yes", "no")).alias("lit_known_m"),
        total(F.col("width").isNotNull()).alias("width_known_m"),
        total(wide).alias("wide_m"),
        total(on & paved).alias("paved_walk_m"),
        total(on & lit).alias("lit_walk_m"),
        total(on & wide).alias("wide_walk_m"),
        total(F.col("steps")).alias("steps_m"),
    )
    rows = sums.join(longest_walk(segments), "route_id", "left").fillna(0.0, ["longest_walk_m"])
    return rows.withColumn("bonus", _benefit_sum())


def _benefit_parts() -> dict:
    """Column of each benefit's bonus, by name."""
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("length")), F.lit(0.0))
    parts = {name.removesuffix("_m"): weight * share(name) for name, weight in WEIGHTS.items()}
    walk = F.col("longest_walk_m")
    return parts | {"continuous": F.when(walk >= 500, 10 * F.least(F.lit(1.0), walk / 2000)).otherwise(0.0)}


def _benefit_sum():
    first, *rest = _benefit_parts().values()
    return sum(rest, first)


def benefits(evidence: DataFrame) -> DataFrame:
    """The benefits of each route of `route_evidence`, the greatest first (place
    1); those that give nothing are left out."""
    each = F.array(*[F.struct(F.lit(name).alias("benefit"), bonus.alias("bonus"), F.lit(i).alias("i")) for i, (name, bonus) in enumerate(_benefit_parts().items())])
    rows = evidence.select("request_id", "route_id", F.inline(F.filter(each, lambda x: x["bonus"] > 0)))
    place = F.row_number().over(Window.partitionBy("route_id").orderBy(F.col("bonus").desc(), "i"))
    return rows.withColumn("place", place).drop("i")


def unknowns(evidence: DataFrame) -> DataFrame:
    """Percent of each route without surface, light or width on record, halves
    up; what is known but for 10 cm is left out."""
    each = F.array(*[F.struct(F.lit(c).alias("what"), (1 - F.try_divide(F.col(f"{c}_known_m"), F.col("length"))).alias("share"), (F.col(f"{c}_known_m") < F.col("length") - 0.1).alias("open")) for c in ("surface", "lit", "width")])
    rows = evidence.select("route_id", F.inline(F.filter(each, lambda x: x["open"])))
    return rows.select("route_id", "what", F.floor(F.col("share") * 100 + 0.5).cast("long").alias("percent"))


def crossing_groups(segments: DataFrame) -> DataFrame:
    """Runs of crossing segments per route, by the best known signal of each."""
    w = Window.partitionBy("route_id").orderBy("seq")
    start = F.col("crossing") & ~F.coalesce(F.lag("crossing").over(w), F.lit(False))
    runs = segments.withColumn("run", F.sum(start.cast("int")).over(w)).where("crossing")
    held = runs.groupBy("route_id", "run").agg(*[F.bool_or(F.col("signal") == s).alias(s) for s in ("tagged", "nearby", "unknown")])
    return held.groupBy("route_id").agg(
        F.count("*").alias("n_crossings"),
        F.count_if(F.col("tagged") | F.col("nearby")).alias("n_signals"),
        F.count_if(~F.col("tagged") & F.col("nearby")).alias("n_inferred"),
        F.count_if(~F.col("tagged") & ~F.col("nearby") & F.col("unknown")).alias("n_unknown"),
    )


def condition_runs(segments: DataFrame) -> DataFrame:
    """Intervals of steps, unpaved and unlit metres; adjacent ones are joined."""
    kinds = F.array_compact(F.array(F.when(F.col("steps"), F.lit("steps")), F.when(F.col("surface").isin(UNPAVED), F.lit("unpaved")), F.when(F.col("lit") == "no", F.lit("unlit"))))
    each = segments.select("route_id", F.explode(kinds).alias("kind"), F.col("at").alias("start_m"), (F.col("at") + F.col("length")).alias("end_m"))
    w = Window.partitionBy("route_id", "kind").orderBy("start_m", "end_m")
    fresh = F.coalesce(F.col("start_m") - F.lag("end_m").over(w) >= 0.1, F.lit(True))
    return each.withColumn("run", F.sum(fresh.cast("int")).over(w)).groupBy("route_id", "kind", "run").agg(F.min("start_m").alias("start_m"), F.max("end_m").alias("end_m")).drop("run")


def _islands(segments: DataFrame, inside) -> DataFrame:
    """The segments of a kind, with `island`: a number for each unbroken run of
    them in a route."""
    w = Window.partitionBy("route_id").orderBy("seq")
    return segments.withColumn("inside", inside).withColumn("island", F.sum((~F.col("inside")).cast("int")).over(w)).where("inside").drop("inside")


def longest_walk(segments: DataFrame) -> DataFrame:
    """Longest stretch of walking segments per route; other segments and metres
    that the stretch has walked before begin it anew.  Only unbroken runs of
    walking segments are gathered; routes without one have 0."""
    one = F.struct("seq", "length", "physical_id", F.least("from_m", "to_m").alias("lo"), F.greatest("from_m", "to_m").alias("hi"))
    rows = _islands(segments, walking(_columns())).groupBy("route_id", "island").agg(F.array_sort(F.collect_list(one)).alias("parts"))
    pid = dict(segments.dtypes)["physical_id"]
    held = f"array<struct<pid:{pid},lo:double,hi:double>>"
    zero = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("most"), F.array().cast(held).alias("seen"))

    def step(s, x):
        again = F.exists(s["seen"], lambda y: (y["pid"] == x["physical_id"]) & (F.least(y["hi"], x["hi"]) - F.greatest(y["lo"], x["lo"]) > 0.05))
        run = F.when(again, 0.0).otherwise(s["run"]) + x["length"]
        place = F.struct(x["physical_id"].alias("pid"), x["lo"].alias("lo"), x["hi"].alias("hi"))
        seen = F.concat(F.when(again, F.array().cast(held)).otherwise(s["seen"]), F.when(x["physical_id"].isNull(), F.array().cast(held)).otherwise(F.array(place)))
        return F.struct(run.alias("run"), F.greatest(s["most"], run).alias("most"), seen.alias("seen"))

    runs = rows.select("route_id", F.aggregate("parts", zero, step, lambda s: s["most"]).alias("m"))
    return segments.select("route_id").distinct().join(runs.groupBy("route_id").agg(F.max("m").alias("longest_walk_m")), "route_id", "left").fillna(0.0, ["longest_walk_m"])


def passages(segments: DataFrame, signals: DataFrame) -> DataFrame:
    """Crossings as walked, in order per route: a run of crossing segments is one
    passage, but the same physical segment in the other direction opens another.
    `signals(physical_id, signal)` says what is known of each; a segment without
    a row is unknown.  at: metres before it."""
    known = segments.where("crossing").select("route_id", "seq", "at", "physical_id", F.signum(F.col("to_m") - F.col("from_m")).cast("int").alias("way"))
    islands = _islands(segments.select("route_id", "seq", "crossing"), F.col("crossing")).select("route_id", "seq", "island")
    parts = known.join(islands, ["route_id", "seq"]).join(signals.dropDuplicates(["physical_id"]), "physical_id", "left").withColumn("signal", F.coalesce("signal", F.lit("unknown")))
    rows = parts.groupBy("route_id", "island").agg(F.array_sort(F.collect_list(F.struct("seq", "at", "physical_id", "way", "signal"))).alias("parts"))
    pid = dict(segments.dtypes)["physical_id"]
    held = f"array<struct<pid:{pid},way:int>>"
    zero = F.struct(F.lit(0).alias("n"), F.array().cast(held).alias("seen"), F.array().cast("array<int>").alias("out"))

    def step(s, x):
        back = F.exists(s["seen"], lambda y: (y["pid"] == x["physical_id"]) & (y["way"] != x["way"]))
        fresh = (s["n"] == 0) | back
        others = F.filter(s["seen"], lambda y: y["pid"] != x["physical_id"])
        own = F.array(F.struct(x["physical_id"].alias("pid"), x["way"].alias("way")))
        n = s["n"] + fresh.cast("int")
        return F.struct(n.alias("n"), F.when(fresh, own).otherwise(F.concat(others, own)).alias("seen"), F.concat(s["out"], F.array(n)).alias("out"))

    each = rows.select("route_id", "island", F.explode(F.arrays_zip("parts", F.aggregate("parts", zero, step, lambda s: s["out"]).alias("no"))).alias("x"))
    types = [F.bool_or(F.col("x.parts.signal") == s).alias(s) for s in ("tagged", "nearby", "unknown")]
    found = each.groupBy("route_id", "island", F.col("x.no").alias("no")).agg(F.min("x.parts.at").alias("at"), *types)
    signal, inferred = F.col("tagged") | F.col("nearby"), ~F.col("tagged") & F.col("nearby")
    return found.select("route_id", "at", signal.alias("signal"), inferred.alias("inferred"), (~signal & F.col("unknown")).alias("unknown"))


def crossing_passages(segments: DataFrame, signals: DataFrame) -> DataFrame:
    """Passages, signals, inferred signals and unknown ones of every route."""
    counts = passages(segments, signals).groupBy("route_id").agg(
        F.count("*").alias("n_passages"), F.count_if("signal").alias("n_signals"), F.count_if("inferred").alias("n_inferred"), F.count_if("unknown").alias("n_unknown")
    )
    return segments.select("route_id").distinct().join(counts, "route_id", "left").fillna(0)


def coverage_sweep(segments: DataFrame) -> DataFrame:
    """Per route and physical segment: disjoint intervals and how often each is
    walked.  Segments without a place are skipped."""
    known = segments.where("physical_id is not null and from_m is not null and to_m is not null")
    ends = F.explode(F.array(F.struct(F.least("from_m", "to_m").alias("x"), F.lit(1).alias("d")), F.struct(F.greatest("from_m", "to_m").alias("x"), F.lit(-1).alias("d"))))
    events = known.select("request_id", "route_id", "physical_id", ends.alias("e")).groupBy("request_id", "route_id", "physical_id", F.col("e.x").alias("lo")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy("request_id", "route_id", "physical_id").orderBy("lo")
    return events.withColumn("times", F.sum("d").over(w)).withColumn("hi", F.lead("lo").over(w)).where("times > 0 and hi > lo").select("request_id", "route_id", "physical_id", "lo", "hi", "times")


def similar_pairs(coverage: DataFrame) -> DataFrame:
    """Shared metres and Dice similarity of every two routes of one request that
    share any; pairs that share none don't appear.

    Intervals meet by stretches of a segment, and two of them count in the stretch
    where the later one begins: users of one long street meet only where they are
    near each other on it."""
    metres = (F.col("hi") - F.col("lo")) * F.col("times")
    totals = coverage.groupBy("route_id").agg(F.sum(metres).alias("total"))
    stretch = F.explode(geo.cells(F.col("lo"), F.col("hi"), STRETCH)).alias("stretch")
    a = coverage.select("request_id", "physical_id", stretch, F.col("route_id").alias("a"), "lo", "hi", "times")
    b = coverage.select("request_id", "physical_id", stretch, F.col("route_id").alias("b"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("times").alias("times2"))
    met = a.join(b, ["request_id", "physical_id", "stretch"]).where("a < b and lo < hi2 and lo2 < hi").where(F.floor(F.greatest("lo", "lo2") / STRETCH) == F.col("stretch"))
    shared = met.groupBy("request_id", "a", "b").agg(F.sum((F.least("hi", "hi2") - F.greatest("lo", "lo2")) * F.least("times", "times2")).alias("shared_m"))
    both = shared.join(totals.select(F.col("route_id").alias("a"), F.col("total").alias("total_a")), "a").join(totals.select(F.col("route_id").alias("b"), F.col("total").alias("total_b")), "b")
    return both.withColumn("dice", F.least(F.lit(1.0), 2 * F.col("shared_m") / (F.col("total_a") + F.col("total_b"))))


def closures(points: DataFrame) -> DataFrame:
    """closure_m of each route of `points(route_id, i, lat, lon)`: metres between
    its first and its last point."""
    at = F.struct("lat", "lon")
    ends = points.groupBy("route_id").agg(F.min_by(at, "i").alias("a"), F.max_by(at, "i").alias("b"))
    return ends.select("route_id", geo.meters(*map(F.col, ["a.lat", "a.lon", "b.lat", "b.lon"])).alias("closure_m"))


def edge_usage(segments: DataFrame) -> DataFrame:
    """Per route: how many physical segments it uses, its metres, and the metres
    beyond the longest single traversal of each."""
    per_edge = segments.groupBy("route_id", "physical_id").agg(F.sum("length").alias("total"), F.max("length").alias("longest"))
    return per_edge.groupBy("route_id").agg(F.count("*").alias("n_edges"), F.sum("total").alias("length"), F.sum(F.col("total") - F.col("longest")).alias("repeated_m"))


def recorded_burden(segments: DataFrame) -> DataFrame:
    """Metres of crossings, steps, unpaved and unlit segments per route."""
    parts = {"crossing_m": F.col("crossing"), "steps_m": F.col("steps"), "unpaved_m": F.col("surface").isin(UNPAVED), "unlit_m": F.col("lit") == "no"}
    return segments.groupBy("route_id").agg(*[F.sum(F.when(c, F.col("length")).otherwise(0.0)).alias(n) for n, c in parts.items()])


def added_burden(pairs: DataFrame, burden: DataFrame) -> DataFrame:
    """`pairs(shorter, longer)` with added: the kinds of which the longer route
    records over 10 cm more or, for crossings, a larger number of them; `burden`
    has the columns of `recorded_burden` and n_crossings."""
    keys = ["crossing_m", "steps_m", "unpaved_m", "unlit_m", "n_crossings"]
    a = burden.select(F.col("route_id").alias("shorter"), F.struct(*keys).alias("x"))
    b = burden.select(F.col("route_id").alias("longer"), F.struct(*keys).alias("y"))
    more = {k: F.col(f"y.{k}") > F.col(f"x.{k}") + 0.1 for k in keys[:4]}
    more["crossing_m"] = more["crossing_m"] | (F.col("y.n_crossings") > F.col("x.n_crossings"))
    added = F.array_compact(F.array(*[F.when(c, F.lit(k.removesuffix("_m"))) for k, c in more.items()]))
    return pairs.join(a, "shorter").join(b, "longer").withColumn("added", added).drop("x", "y")


def variation(pairs: DataFrame) -> DataFrame:
    """How two routes that share metres differ: in `direction` (each contains
    the other), in `distance` (the longer contains the shorter) or in `path`."""
    has_a, has_b = F.col("shared_m") >= 0.999 * F.col("total_a"), F.col("shared_m") >= 0.999 * F.col("total_b")
    extends = (has_b & (F.col("total_a") > F.col("total_b") + 0.5)) | (has_a & (F.col("total_b") > F.col("total_a") + 0.5))
    return pairs.withColumn("variation", F.when(has_a & has_b, "direction").when(extends, "distance").otherwise("path"))
