"""The registered queries over the route tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loopwise import store
from loopwise.functions import evidence, geo
from loopwise.operators import elevation, paths, ranking, sequence, spatial
from loopwise.plans.base import query, rounded as _rounded
from loopwise.sources import elements
from loopwise.sources import routes as R

#: Metres that the requests ask for.
TARGET = 2000.0


_HAVERSINE = "12742000.0::double * asin(least(1.0, sqrt(power(sin(radians({1} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({1})) * power(sin(radians({3} - {2}) / 2), 2))))"
_T = "greatest(0.0, least(1.0, ((lon - lon1) * 90000 * (lon2 - lon1) * 90000 + (lat - lat1) * 111320 * (lat2 - lat1) * 111320) / (power((lon2 - lon1) * 90000, 2) + power((lat2 - lat1) * 111320, 2))))"
_ON = _HAVERSINE.format("lat", "(lat1 + (lat2 - lat1) * t)", "lon", "(lon1 + (lon2 - lon1) * t)")

_PAVED, _UNPAVED = (f"surface in ({', '.join(map(repr, names))})" for names in (evidence.PAVED, evidence.UNPAVED))
_m = lambda condition, name: f"sum(case when {condition} then length else 0 end) {name}"
_WALK = """, seg as (select *, coalesce(highway in ('footway', 'pedestrian'), false) and not crossing and not steps and not motor_allowed "on" from segments),
walked(route_id, seq, run, most, seen) as (
  select route_id, 0::bigint, 0.0::double, 0.0::double, []::struct(p bigint, lo double, hi double)[] from (select distinct route_id from segments)
  union all
  select route_id, seq, run, greatest(most, run), case when "on" then list_append(case when again then []::struct(p bigint, lo double, hi double)[] else seen end, {'p': physical_id, 'lo': lo, 'hi': hi}) else [] end
  from (select *, case when not "on" then 0.0::double when again then length else before + length end run from (
    select seg.*, least(from_m, to_m) lo, greatest(from_m, to_m) hi, t.run before, most, seen, len(list_filter(seen, lambda y: y.p = physical_id and least(y.hi, greatest(from_m, to_m)) - greatest(y.lo, least(from_m, to_m)) > 0.05)) > 0 again
    from seg join walked t on t.route_id = seg.route_id and seg.seq = t.seq + 1))),
lw as (select route_id, max(most) longest_walk_m from walked group by 1)"""
_EVIDENCE = _WALK + f""", ev as (select request_id, route_id, sum(length) length, {_m('"on"', 'walk_m')}, {_m(_PAVED, 'paved_m')}, {_m(_UNPAVED, 'unpaved_m')}, {_m('surface is not null', 'surface_known_m')},
    {_m("lit = 'yes'", 'lit_yes_m')}, {_m("lit = 'no'", 'lit_no_m')}, {_m("lit in ('yes', 'no')", 'lit_known_m')}, {_m('width is not null', 'width_known_m')}, {_m('width >= 3', 'wide_m')},
    {_m(f'"on" and {_PAVED}', 'paved_walk_m')}, {_m("\"on\" and lit = 'yes'", 'lit_walk_m')}, {_m('"on" and width >= 3', 'wide_walk_m')}, {_m('steps', 'steps_m')}
  from seg group by 1, 2),
bo as (select ev.*, longest_walk_m, 20 * (walk_m / length) w, 30 * (paved_walk_m / length) p, 15 * (lit_walk_m / length) l, 15 * (wide_walk_m / length) d, case when longest_walk_m >= 500 then 10 * least(1.0, longest_walk_m / 2000) else 0 end c from ev join lw using (route_id)),
sc as (select *, bonus - 30 * error score from (select * exclude (w, p, l, d, c), w + p + l + d + c bonus, abs(length - 2000) / 2000 error from bo))"""
_CROSSINGS = """, cr as (select route_id, count(*) n_crossings, count(*) filter (tagged or nearby) n_signals, count(*) filter (not tagged and nearby) n_inferred, count(*) filter (not tagged and not nearby and unknown) n_unknown
  from (select route_id, run, bool_or(signal = 'tagged') tagged, bool_or(signal = 'nearby') nearby, bool_or(signal = 'unknown') unknown
    from (select *, sum((crossing and not before)::int) over (partition by route_id order by seq) run from (select *, coalesce(lag(crossing) over (partition by route_id order by seq), false) before from segments)) where crossing group by 1, 2) group by 1)"""
_PASSAGES = """, kn as (select s.route_id, s.seq, "at", crossing, s.physical_id, sign(to_m - from_m)::bigint way, coalesce(sgn.signal, 'unknown') known from segments s left join sgn on sgn.physical_id = s.physical_id),
pa(route_id, seq, n, seen) as (
  select route_id, 0::bigint, 0::bigint, []::struct(p bigint, w bigint)[] from (select distinct route_id from segments)
  union all
  select route_id, seq, n + (crossing and fresh)::bigint, case when not crossing then [] when fresh then [{'p': physical_id, 'w': way}] else list_append(list_filter(seen, lambda y: y.p <> physical_id), {'p': physical_id, 'w': way}) end
  from (select kn.*, n, seen, len(seen) = 0 or len(list_filter(seen, lambda y: y.p = physical_id and y.w <> way)) > 0 fresh from kn join pa on pa.route_id = kn.route_id and kn.seq = pa.seq + 1)),
pg as (select route_id, n, min("at") "at", bool_or(known = 'tagged') tagged, bool_or(known = 'nearby') nearby, bool_or(known = 'unknown') unk from kn join pa using (route_id, seq) where crossing group by 1, 2),
pc as (select route_id, count(n) n_passages, count(*) filter (tagged or nearby) n_signals, count(*) filter (not tagged and nearby) n_inferred, count(*) filter (not tagged and not nearby and unk) n_unknown from (select distinct route_id from segments) left join pg using (route_id) group by 1)"""
_SWEEP = """, ev0 as (select request_id, route_id, physical_id, x lo, sum(d) d from (select request_id, route_id, physical_id, least(from_m, to_m) x, 1 d from segments union all select request_id, route_id, physical_id, greatest(from_m, to_m), -1 from segments) group by all),
cov as (select request_id, route_id, physical_id, lo, hi, times from (select *, sum(d) over w times, lead(lo) over w hi from ev0 window w as (partition by request_id, route_id, physical_id order by lo)) where times > 0 and hi > lo),
tot as (select route_id, sum((hi - lo) * times) total from cov group by 1),
prs as (select a.request_id, a.route_id a, b.route_id b, sum((least(a.hi, b.hi) - greatest(a.lo, b.lo)) * least(a.times, b.times)) shared_m
  from cov a join cov b on a.request_id = b.request_id and a.physical_id = b.physical_id and a.route_id < b.route_id and a.lo < b.hi and b.lo < a.hi group by 1, 2, 3),
sim as (select prs.*, x.total total_a, y.total total_b, least(1.0, 2 * shared_m / (x.total + y.total)) dice from prs join tot x on x.route_id = a join tot y on y.route_id = b)"""


@query(_EVIDENCE + " select * exclude (error, score) replace (round(bonus, 9) as bonus) from sc")
def segment_evidence(spark, d):
    return _rounded(sequence.route_evidence(R.segments(spark, d)), 9)


@query(_CROSSINGS + " select * from cr")
def crossing_groups(spark, d):
    return sequence.crossing_groups(R.segments(spark, d))


@query("""select route_id, kind, min(start_m) start_m, max(end_m) end_m from (select *, sum((end_before is null or start_m - end_before >= 0.1)::int) over (partition by route_id, kind order by start_m, end_m) run
  from (select *, lag(end_m) over (partition by route_id, kind order by start_m, end_m) end_before from (
    select route_id, 'steps' kind, "at" start_m, "at" + length end_m from segments where steps union all select route_id, 'unpaved', "at", "at" + length from segments where """ + _UNPAVED + """
    union all select route_id, 'unlit', "at", "at" + length from segments where lit = 'no'))) group by route_id, kind, run""")
def condition_runs(spark, d):
    return sequence.condition_runs(R.segments(spark, d))


@query(_SWEEP + " select request_id, route_id, physical_id, lo, hi, times::bigint times from cov")
def coverage_sweep(spark, d):
    return sequence.coverage_sweep(R.segments(spark, d))


@query(_SWEEP + " select request_id, a, b, shared_m, total_a, total_b, round(dice, 6) dice from sim")
def similar_pairs(spark, d):
    return _rounded(sequence.similar_pairs(sequence.coverage_sweep(R.segments(spark, d))))


def _scored(spark, d):
    return ranking.scored(sequence.route_evidence(R.segments(spark, d)), TARGET)


_PENALTY = """, ea as (select a route_id, b peer, shared_m, total_b peer_total from sim union all select b, a, shared_m, total_a from sim),
pk as (select ea.route_id, peer, p.length peer_length, row_number() over (partition by ea.route_id order by greatest(0, p.length - 2000), abs(p.length - 2000), peer) n
  from ea join sc r on r.route_id = ea.route_id join sc p on p.route_id = peer where r.length > p.length + 0.5 and shared_m >= 0.999 * peer_total),
fi as (select sc.*, peer, case when peer is null then 0.0 else 150 * greatest(0, length - greatest(2000, peer_length)) / 2000 end penalty from sc left join pk on pk.route_id = sc.route_id and n = 1)"""


def _finals(spark, d, segments=None):
    """Routes with their scores less the penalty for metres beyond a subset."""
    if segments is None:
        segments, _ = store.written(R.segments(spark, d), "segments")
    pairs = sequence.similar_pairs(sequence.coverage_sweep(segments))
    return ranking.subset_penalty(ranking.scored(sequence.route_evidence(segments), TARGET), pairs, TARGET)


@query(_EVIDENCE + _SWEEP + _PENALTY + " select request_id, route_id, coalesce(peer, -1) peer, round(penalty, 9) penalty, round(score - penalty, 9) final_score from fi")
def subset_penalty(spark, d):
    return _rounded(_finals(spark, d).select("request_id", "route_id", F.coalesce("peer", F.lit(-1)).alias("peer"), "penalty", "final_score"), 9)


_SAMPLES = """, le as (select route_id, sum(length) length from segments group by 1),
p0 as (select route_id, length, unnest(range(0, greatest(floor((length - 1.000001) / 50)::bigint, 0) + 1)) i from le),
p1 as (select route_id, i, i * 50.0::double "at" from p0 where not (i > 0 and i = greatest(floor((length - 1.000001) / 50)::bigint, 0) and length - i * 50 < 25)),
p2 as (select * from p1 union all select route_id, (select max(i) from p1 where p1.route_id = le.route_id) + 1, length from le),
sa as (select *, case when (route_id + i) % 17 <> 0 then (route_id * 7 + i * 13) % 37 * 1.0::double end elevation from p2)"""
_ALL = _EVIDENCE + _PASSAGES + _SWEEP + _PENALTY + _SAMPLES + """, er as (select route_id, count(*) = count(elevation) elevation_known, max(elevation) - min(elevation) range_m from sa group by 1),
al as (select fi.*, score - penalty rs, n_signals, n_unknown, elevation_known, range_m from fi join pc using (route_id) join er using (route_id))"""


def _samples(spark, d):
    lengths = R.segments(spark, d).groupBy("route_id").agg(F.sum("length").alias("length"))
    each = lengths.select("route_id", F.posexplode(elevation.sample_positions(F.col("length"))).alias("i", "at"))
    return each.withColumn("elevation", F.when((F.col("route_id") + F.col("i")) % 17 != 0, (F.col("route_id") * 7 + F.col("i") * 13) % 37 * 1.0))


def _ranked(spark, d):
    """All that `recommend` reads, with the segments made and written once."""
    segments, _ = store.written(R.segments(spark, d), "segments")
    heights = elevation.ranges(_samples(spark, d), "route_id")
    rows = _finals(spark, d, segments).join(sequence.crossing_passages(segments, R.signals(spark, d)), "route_id").join(heights, "route_id")
    return ranking.rank_score(rows)


@query(_ALL + """, pi as (select request_id, route_id, rs, 0 rank, 'best' reason, row_number() over (partition by request_id order by rs desc, error, route_id) n from al
  union all select request_id, route_id, rs, 1, 'elevation', row_number() over (partition by request_id order by range_m, rs desc, error, route_id) from al where elevation_known
  union all select request_id, route_id, rs, 2, 'signals', row_number() over (partition by request_id order by n_signals, rs desc, error, route_id) from al where n_unknown = 0)
select request_id, route_id, round(max(rs), 9) score, string_agg(reason, '+' order by rank) reasons from pi where n = 1 group by 1, 2""")
def recommend(spark, d):
    return _rounded(ranking.recommend(_ranked(spark, d)), 9)


@query(_ALL + """ select request_id, reason from (select request_id, unnest(['elevation', 'signals']) reason, unnest([count(*) filter (elevation_known), count(*) filter (n_unknown = 0)]) n from al group by 1) where n = 0""")
def pending_reasons(spark, d):
    return ranking.pending(_ranked(spark, d))


@query(_EVIDENCE + """ select request_id, route_id, benefit, round(bonus, 9) bonus, row_number() over (partition by route_id order by bonus desc, i) place
from (select request_id, route_id, unnest(['walk', 'paved_walk', 'lit_walk', 'wide_walk', 'continuous']) benefit, unnest([w, p, l, d, c]) bonus, unnest(range(5)) i from bo) where bonus > 0""")
def route_benefits(spark, d):
    return _rounded(sequence.benefits(sequence.route_evidence(R.segments(spark, d))), 9)


@query(_EVIDENCE + """ select route_id, what, floor((1 - known / length) * 100 + 0.5)::bigint percent from (select route_id, length, unnest(['surface', 'lit', 'width']) what, unnest([surface_known_m, lit_known_m, width_known_m]) known from sc) where known < length - 0.1""")
def unknown_shares(spark, d):
    return sequence.unknowns(sequence.route_evidence(R.segments(spark, d)))


@query(_PASSAGES + """ select * from pc""")
def crossing_passages(spark, d):
    return sequence.crossing_passages(R.segments(spark, d), R.signals(spark, d))


@query(_WALK + " select * from lw")
def longest_walk(spark, d):
    return sequence.longest_walk(R.segments(spark, d))


@query(f"select edge_id, round({_HAVERSINE.format('lat1', 'lat2', 'lon1', 'lon2')}, 6) metres from edges")
def haversine(spark, d):
    return R.edges(spark, d).select("edge_id", F.round(geo.meters(*map(F.col, ["lat1", "lon1", "lat2", "lon2"])), 6).alias("metres"))


@query(f"select poi_id, edge_id, round({_ON}, 6) distance from (select *, {_T} t from pois, edges) where {_ON} <= 50")
def poi_edges(spark, d):
    return spatial.near_edges(R.pois(spark, d), R.edges(spark, d), 50.0).select("poi_id", "edge_id", F.round("on.distance", 6).alias("distance"))


# The same streets at other latitudes, as wide in metres.
_LATITUDES = {0: 0.8090169943749475, 36: 1.0, 60: 1.6180339887498949, 79: 4.239942131217364}
_MOVED = "mv as (select * from (values {}) v(deg, wider)), mp as (select poi_id, deg, lat - 36 + deg lat, 129 + (lon - 129) * wider lon from pois, mv), me as (select edge_id, deg, lat1 - 36 + deg lat1, 129 + (lon1 - 129) * wider lon1, lat2 - 36 + deg lat2, 129 + (lon2 - 129) * wider lon2 from edges, mv)".format(", ".join(f"({k}, {v})" for k, v in _LATITUDES.items()))


@query(f", {_MOVED} select deg::bigint deg, poi_id, edge_id, round({_ON}, 6) distance from (select *, {_T} t from mp join me using (deg) where abs(lat - (lat1 + lat2) / 2) < 0.005) where {_ON} <= 120")
def poi_edges_by_latitude(spark, d):
    """Streets near facilities with the whole map moved to four latitudes."""
    deg = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("deg"), F.lit(v).alias("wider")) for k, v in _LATITUDES.items()])).alias("m")

    def moved(df, id, *ends):
        lat = [(F.col(f"lat{e}") - 36 + F.col("m.deg")).alias(f"lat{e}") for e in ends]
        lon = [(129 + (F.col(f"lon{e}") - 129) * F.col("m.wider")).alias(f"lon{e}") for e in ends]
        return df.select("*", deg).select(F.struct("m.deg", id).alias(id), *lat, *lon)

    met = spatial.near_edges(moved(R.pois(spark, d), "poi_id", ""), moved(R.edges(spark, d), "edge_id", "1", "2"), 120.0).where("poi_id.deg = edge_id.deg")
    return met.select("poi_id.deg", "poi_id.poi_id", "edge_id.edge_id", F.round("on.distance", 6).alias("distance"))


@query(f"""select poi_id, edge_id, round(t, 6) t, round(dist, 6) distance, case when t < 0.001 then 'start' when t > 0.999 then 'end' when t is not null then 'inside' else 'none' end place
from pois left join (select poi_id, edge_id, t, dist, row_number() over (partition by poi_id order by dist, edge_id) n from (select *, {_ON} dist from (select *, {_T} t from pois, edges)) where dist <= 100) on poi_id = poi_id_ and n = 1""".replace("(select poi_id, edge_id, t, dist, row", "(select poi_id poi_id_, edge_id, t, dist, row"))
def snap_start(spark, d):
    return _rounded(spatial.snap(R.pois(spark, d), "poi_id", R.edges(spark, d)))


@query("select count(*)::bigint n_edges, (select count(*) from nodes)::bigint n_nodes, (select count(*) from pois where kind = 'shop')::bigint n_shops, (select count(*) from pois where kind = 'water')::bigint n_water from edges")
def graph_stats(spark, d):
    kinds = R.pois(spark, d).agg(F.count_if(F.col("kind") == "shop").alias("n_shops"), F.count_if(F.col("kind") == "water").alias("n_water"))
    one = R.edges(spark, d).agg(F.count("*").alias("n_edges")).join(R.nodes(spark, d).agg(F.count("*").alias("n_nodes")))  # one row each
    return one.join(kinds)


_BOX = "select r_regionkey, 36.0::double + r_regionkey * 0.031::double south, 129.3::double + r_regionkey * 0.017::double west from region"


@query(f"select r_regionkey, y ty, x tx from (select *, unnest(range(floor(west / 0.05::double)::bigint, floor((west + 0.11::double) / 0.05::double)::bigint + 1)) x from (select *, unnest(range(floor(south / 0.05::double)::bigint, floor((south + 0.13::double) / 0.05::double)::bigint + 1)) y from ({_BOX})))")
def tile_keys(spark, d):
    k = F.col("r_regionkey")
    boxes = spark.read.parquet(f"{d}/region.parquet").select(k, (36.0 + k * F.lit(0.031)).alias("south"), (129.3 + k * F.lit(0.017)).alias("west"))
    boxes = boxes.withColumn("north", F.col("south") + F.lit(0.13)).withColumn("east", F.col("west") + F.lit(0.11))
    return spatial.tile_keys(boxes).select("r_regionkey", "ty", "tx")


@query("select l_orderkey way_id, pos, l_partkey + 4294967296 ref, (l_suppkey * 1000003 % 900000000)::bigint lat7, (l_partkey * 7919)::bigint lon7 from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) pos from lineitem)")
def tile_codec_roundtrip(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("l_orderkey").orderBy(*R._ORDER)
    ways = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("way_id"), F.row_number().over(by).cast("long").alias("pos"), (F.col("l_partkey") + 4294967296).alias("ref"), (F.col("l_suppkey") * 1000003 % 900000000).alias("lat7"), (F.col("l_partkey") * 7919).alias("lon7"))
    return spatial.unpacked_way(spatial.packed_way(ways))


@query("select l_partkey id, l_suppkey part, max(l_quantity) q from (select *, row_number() over (partition by l_partkey order by l_suppkey desc) n from (select l_partkey, l_suppkey, max(l_quantity) l_quantity from lineitem group by 1, 2)) where n = 1 group by 1, 2")
def merge_tiles(spark, d):
    parts = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("part")).agg(F.max("l_quantity").alias("q"))
    return spatial.merged(parts, ["id"], "part")


@query("select p_partkey, p_size % 3 <> 0 and p_size % 4 <> 1 as usable, width from (select *, case when p_size % 5 = 0 then null when p_size % 5 = 1 then p_size + 0.5 when p_size > 0 then p_size end::double width from part)")
def usable_ways(spark, d):
    size = F.col("p_size")
    tags = F.map_filter(F.create_map(F.lit("highway"), F.when(size % 3 == 0, "motorway").otherwise("footway"), F.lit("access"), F.when(size % 4 == 1, "private")), lambda _, v: v.isNotNull())
    said = F.when(size % 5 == 0, F.lit("wide")).when(size % 5 == 1, F.concat(size.cast("string"), F.lit(".5 m"))).otherwise(F.concat(F.lit(" "), size.cast("string"), F.lit("m")))
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", tags.alias("tags"), said.alias("said"))
    return rows.select("p_partkey", evidence.usable(F.col("tags")).alias("usable"), evidence.numeric_width(F.col("said")).alias("width"))


_RINGS = [(0, False, [(36.002, 129.302), (36.02, 129.302), (36.02, 129.32), (36.002, 129.32)]), (1, True, [(36.006, 129.306), (36.012, 129.306), (36.012, 129.315), (36.006, 129.315)])]


@query("select node_id, 0 poly_id from nodes where lat between 36.001999 and 36.020001 and lon between 129.301999 and 129.320001 and not (lat between 36.005999 and 36.012001 and lon between 129.305999 and 129.315001)".replace("0 poly_id", "0::bigint poly_id"))
def point_in_polygon(spark, d):
    sides = [(0, ring, hole, *a, *b) for ring, hole, at in _RINGS for a, b in zip(at, at[1:] + at[:1], strict=True)]
    rings = spark.createDataFrame(sides, "poly_id long, ring int, hole boolean, lat1 double, lon1 double, lat2 double, lon2 double")
    points = R.nodes(spark, d).select("node_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))
    return spatial.inside(points, "node_id", rings)


@query(""", te as (select ix, iy, case when (ix + iy) % 11 <> 0 then ix * 3 + iy * 5 end v from (select unnest(range(0, 60)) ix), (select unnest(range(0, 60)) iy)),
pt as (select c_custkey, c_custkey % 50 + (c_custkey % 4) * 0.25::double x, c_custkey // 50 % 50 + (c_custkey % 3) * 0.5::double y from customer)
select c_custkey, round((1 - (x - floor(x))) * (1 - (y - floor(y))) * a.v + (1 - (x - floor(x))) * (y - floor(y)) * b.v + (x - floor(x)) * (1 - (y - floor(y))) * c.v + (x - floor(x)) * (y - floor(y)) * e.v, 6) elevation
from pt left join te a on a.ix = floor(x) and a.iy = floor(y) left join te b on b.ix = floor(x) and b.iy = floor(y) + 1 left join te c on c.ix = floor(x) + 1 and c.iy = floor(y) left join te e on e.ix = floor(x) + 1 and e.iy = floor(y) + 1""")
def terrain_bilinear(spark, d):
    k = F.col("c_custkey")
    points = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", (k % 50 + (k % 4) * 0.25).alias("x"), (F.floor(k / 50) % 50 + (k % 3) * 0.5).alias("y"))
    grid = spark.range(3600).select((F.col("id") % 60).alias("ix"), F.floor(F.col("id") / 60).alias("iy"))
    terrain = grid.withColumn("value", F.when((F.col("ix") + F.col("iy")) % 11 != 0, F.col("ix") * 3.0 + F.col("iy") * 5))
    return _rounded(elevation.bilinear(points, "c_custkey", terrain))


@query(_SAMPLES + """ select route_id, i, "at", floor(coalesce((lag(elevation) over w + elevation + lead(elevation) over w) / 3, elevation) * 10 + 0.5) / 10 elevation from sa window w as (partition by route_id order by i)""")
def elevation_samples(spark, d):
    return _rounded(elevation.smoothed(_samples(spark, d), "route_id"))


_INTERVALS = _SAMPLES + """, iv as (select *, rise * 100 / (end_m - start_m) grade from (select route_id, i, "at" start_m, lead("at") over w end_m, lead(elevation) over w - elevation rise from sa window w as (partition by route_id order by i)) where end_m > start_m)"""


@query(_INTERVALS + """ select route_id, round(known / total, 6) coverage, round(case when known > 0 then coalesce(gentle_m, 0) / known end, 6) gentle_ratio, round(max_grade, 6) max_grade
from (select route_id, sum(end_m - start_m) total, coalesce(sum(end_m - start_m) filter (grade is not null), 0) known, sum(end_m - start_m) filter (abs(grade) <= 4) gentle_m, max(abs(grade)) max_grade from iv group by 1)""")
def elevation_grades(spark, d):
    return _rounded(elevation.grades(_samples(spark, d), "route_id"))


@query(_INTERVALS + """, hl as (select route_id, run, min(start_m) start_m, max(end_m) end_m, sum(rise) rise from (
    select *, sum((up and not before)::int) over (partition by route_id order by i) run from (select *, coalesce(lag(up) over (partition by route_id order by i), false) before from (select *, coalesce(grade >= 3, false) up from iv))) where up group by 1, 2)
select route_id, start_m, end_m, rise, place from (select *, row_number() over (partition by route_id order by rise desc, start_m) place from hl where end_m - start_m >= 100) where place <= 3""")
def hills(spark, d):
    return _rounded(elevation.hills(_samples(spark, d), "route_id"))


@query(_SAMPLES + """ select route_id, low, greatest(high, low + 10) high from (select route_id, coalesce(floor(min(elevation) / 10) * 10, 0)::bigint low, coalesce(ceil(max(elevation) / 10) * 10, 10)::bigint high from sa group by 1)""")
def height_range(spark, d):
    return elevation.height_range(_samples(spark, d), "route_id")


@query(" select route_id, count(*) n_edges, sum(total) length, sum(total - longest) repeated_m from (select route_id, physical_id, sum(length) total, max(length) longest from segments group by 1, 2) group by 1")
def edge_usage(spark, d):
    return sequence.edge_usage(R.segments(spark, d))


@query(" select route_id, sum(case when crossing then length else 0 end) crossing_m, sum(case when steps then length else 0 end) steps_m, " + _m(_UNPAVED, "unpaved_m") + ", sum(case when lit = 'no' then length else 0 end) unlit_m from segments group by 1")
def recorded_burden(spark, d):
    return sequence.recorded_burden(R.segments(spark, d))


@query(_SWEEP + """ select a, b, case when shared_m >= 0.999::double * total_a and shared_m >= 0.999::double * total_b then 'direction'
  when (shared_m >= 0.999::double * total_b and total_a > total_b + 0.5) or (shared_m >= 0.999::double * total_a and total_b > total_a + 0.5) then 'distance' else 'path' end variation from sim""")
def route_variation(spark, d):
    return sequence.variation(sequence.similar_pairs(sequence.coverage_sweep(R.segments(spark, d)))).select("a", "b", "variation")


@query(_EVIDENCE + " select request_id, route_id, length, 1600.0::double least_m, 2400.0::double most_m from sc join (select route_id, sum(case way when 0 then 1 when 2 then -1 else 0 end) r, sum(case way when 1 then 1 when 3 then -1 else 0 end) c from segments group by 1) using (route_id) where error <= 0.2 + 1e-8 and ((r = 0 and c = 0) or route_id % 3 = 0)")
def valid_candidates(spark, d):
    closed = sequence.closures(R.points(spark, d))
    rows = ranking.within_bounds(_scored(spark, d).join(closed, "route_id"))
    return ranking.distance_bounds(rows, TARGET).select("request_id", "route_id", "length", "least_m", "most_m")


@query(_EVIDENCE + " select request_id, route_id, 2000 - length missing_m from sc where 2000 - length between 9.99 and 100.01")
def small_deficits(spark, d):
    return ranking.small_deficit(_scored(spark, d), TARGET).select("request_id", "route_id", "missing_m")


@query(" select c_custkey id, case when c_custkey % 2 = 0 then 'crossing,name' else 'crossing' end keys, c_mktsegment crossing, case when c_custkey % 3 = 0 then 1 else 0 end::bigint was_unclean from customer")
def sanitized_elements(spark, d):
    k, name = F.col("c_custkey"), F.col("c_name")
    tags = F.create_map(F.lit("crossing"), F.col("c_mktsegment"), F.lit("name"), F.when(k % 2 == 0, name), F.lit("phone"), F.when(k % 3 == 0, name), F.lit("contact:email"), F.when(k % 6 == 0, name))
    rows = spark.read.parquet(f"{d}/customer.parquet").select(k.alias("id"), F.when(k % 9 == 0, name).alias("user"), F.map_filter(tags, lambda _, v: v.isNotNull()).alias("tags"))
    was = elements.unclean(rows).select("id", F.lit(1).cast("long").alias("was_unclean"))
    clean = elements.sanitized(rows).join(was, "id", "left").fillna(0, ["was_unclean"])
    return clean.select("id", F.array_join(F.array_sort(F.map_keys("tags")), ",").alias("keys"), F.col("tags")["crossing"].alias("crossing"), "was_unclean")


_TRIED = "select edge_id, unnest([lat1, (lat1 + lat2) / 2, lat2]) la, unnest([lon1, (lon1 + lon2) / 2, lon2]) lo from edges"


@query(f" select distinct edge_id from ({_TRIED}), pois where {_HAVERSINE.format('la', 'lat', 'lo', 'lon')} <= 30")
def signal_edges(spark, d):
    return spatial.edges_near_points(R.edges(spark, d), R.pois(spark, d), 30.0)


@query(_SAMPLES + """, sm as (select route_id, i, floor(coalesce((lag(elevation) over w + elevation + lead(elevation) over w) / 3, elevation) * 10 + 0.5) / 10 elevation from sa window w as (partition by route_id order by i)),
cl(route_id, i, spot, up, down) as (
  select route_id, -1::bigint, null::double, 0.0::double, 0.0::double from le
  union all
  select route_id, i, case when elevation is null then null when spot is null or abs(elevation - spot) >= 3 then elevation else spot end, up + case when elevation - spot >= 3 then elevation - spot else 0 end, down + case when spot - elevation >= 3 then spot - elevation else 0 end
  from (select sm.*, spot, up, down from sm join cl on cl.route_id = sm.route_id and sm.i = cl.i + 1))
select route_id, round(max(up), 6) ascent, round(max(down), 6) descent from cl group by 1""")
def ascent(spark, d):
    return _rounded(elevation.climbs(elevation.smoothed(_samples(spark, d), "route_id"), "route_id"))


@query("""select run_id, node, cost from (
  with recursive ar as (select u, v, length from edges union all select v, u, length from edges),
  t(run_id, v, d) using key (run_id, v) as (select n_nationkey::bigint, n_nationkey::bigint * 4, 0.0::double from nation union all
    select t.run_id, ar.v, min(t.d + ar.length) from t join ar on ar.u = t.v left join recurring.t o on o.run_id = t.run_id and o.v = ar.v where t.d + ar.length <= 1200 and (o.d is null or t.d + ar.length < o.d) group by 1, 2)
  select run_id, v node, d cost from t)""")
def shortest_tree(spark, d):
    e = R.edges(spark, d)
    arcs = e.select("u", "v", "edge_id", "length").union(e.select("v", "u", "edge_id", "length")).select("*", F.lit("distance").alias("profile"), F.col("length").alias("cost"), F.lit(False).alias("steps"))
    trees = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("tree_id"), (F.col("n_nationkey").cast("bigint") * 4).alias("start"), F.lit("distance").alias("profile"), F.lit(1200.0).alias("max_length"))
    labels, _ = paths.shortest_trees(arcs, trees)
    return labels.select(F.col("tree_id").alias("run_id"), "node", "cost")


@query(""", nt as (select n_nationkey::bigint run, n_nationkey::bigint * 4 at0 from nation),
ar as (select edge_id, u, v, length, edge_id % 13 = 0 steps from edges union all select edge_id, v, u, length, edge_id % 13 = 0 from edges),
lab(run, v, cost, len, prev, edge, it) as (select run, at0, 0.0::double, 0.0::double, null::bigint, null::bigint, 0 from nt union all
  select run, v, s.cost, s.len, s.prev, s.edge, it from (
    select t.run, ar.v, min(struct_pack(cost := t.cost + case when ar.edge_id % 7 = t.run % 7 then ar.length * 2.5::double else ar.length end, edge := ar.edge_id, prev := t.v, len := t.len + ar.length)) s, t.it + 1 it
    from lab t join ar on ar.u = t.v join nt on nt.run = t.run where it < 40 and ar.v <> at0 and t.len + ar.length <= 900 and not (steps and t.run % 2 = 0) and ar.edge_id % 31 <> t.run % 31 group by t.run, ar.v, t.it
    union all select nt.run, at0, struct_pack(cost := 0.0::double, edge := null::bigint, prev := null::bigint, len := 0.0::double), it + 1 from (select distinct run, it from lab where it < 40) r join nt on nt.run = r.run))
select run run_id, v node, round(cost, 6) cost, round(len, 6) length, prev, edge edge_id from lab where it = 40""")
def search_trees(spark, d):
    """Trees from each nation's node with dear and banned edges, some without steps,
    across blocks of streets; a label counts by the length of the cheapest way."""
    e = R.edges(spark, d).select(F.col("edge_id").cast("long").alias("edge_id"), "u", "v", "length")
    both = e.select("u", "v", "edge_id", "length").union(e.select("v", "u", "edge_id", "length"))
    arcs = both.select("*", F.lit("plain").alias("profile"), F.col("length").alias("cost"), (F.col("edge_id") % 13 == 0).alias("steps"))
    run = F.col("n_nationkey").cast("long")
    trees = spark.read.parquet(f"{d}/nation.parquet").select(run.alias("tree_id"), (run * 4).alias("start"), F.lit("plain").alias("profile"), F.lit(900.0).alias("max_length"), (run % 2 == 0).alias("avoid_steps"), F.lit(2.5).alias("penalty"))
    of = lambda m, name: e.groupBy((F.col("edge_id") % m).alias("r")).agg(F.collect_list("edge_id").alias(name))
    trees = trees.join(of(7, "penalized"), F.col("tree_id") % 7 == F.col("r"), "left").drop("r").join(of(31, "banned"), F.col("tree_id") % 31 == F.col("r"), "left").drop("r")
    none = F.array().cast("array<long>")
    trees = trees.withColumns({c: F.coalesce(c, none) for c in ("penalized", "banned")})
    labels, _ = paths.shortest_trees(arcs, trees, None, paths.blocks(R.nodes(spark, d)))
    return _rounded(labels.select(F.col("tree_id").alias("run_id"), "node", "cost", "length", "prev", "edge_id"))
