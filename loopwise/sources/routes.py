"""Route tables made of star-schema tables, by fixed rules.

Each order is a candidate route, each of its lines a segment of it, and each
customer a request; customers stand on a lattice of streets and suppliers are
facilities.  `SQL` says the same for other engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loopwise.functions.evidence import PAVED, UNPAVED

#: Every surface, then four unknown ones.
_SURFACES = [*PAVED, *UNPAVED, *[None] * 4]
_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, route_id, seq, at (metres before it), length, physical_id,
    from_m, to_m and what is recorded about the segment, null where unknown."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    by = Window.partitionBy("l_orderkey").orderBy(*_ORDER)
    rows = lines.withColumn("seq", F.row_number().over(by)).withColumn("length", F.col("l_quantity") * 20.0)
    rows = rows.withColumn("at", F.sum("length").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    start = (F.col("l_suppkey") % 5) * 50.0
    forward = F.col("seq") % 2 == 1
    highway = F.element_at(F.array(*map(F.lit, ["footway", "residential", "path", "pedestrian", "steps"])), (F.col("l_partkey") % 5 + 1).cast("int"))
    return rows.select(
        F.col("o_custkey").alias("request_id"),
        F.col("l_orderkey").alias("route_id"),
        F.col("seq").cast("long").alias("seq"),
        "at",
        "length",
        (F.col("l_partkey") % 50).alias("physical_id"),
        F.when(forward, start).otherwise(start + F.col("length")).alias("from_m"),
        F.when(forward, start + F.col("length")).otherwise(start).alias("to_m"),
        highway.alias("highway"),
        (highway == "steps").alias("steps"),
        (F.col("l_linenumber") % 4 == 2).alias("crossing"),
        F.element_at(F.array(*map(F.lit, _SURFACES)), ((F.col("l_partkey") + F.col("l_suppkey")) % len(_SURFACES) + 1).cast("int")).alias("surface"),
        F.when(F.col("l_linestatus") == "O", "yes").when(F.col("l_linenumber") % 3 == 0, "no").alias("lit"),
        F.when(F.col("l_suppkey") % 4 == 0, 3.5).when(F.col("l_suppkey") % 4 == 1, 2.0).alias("width"),
        F.element_at(F.array(*map(F.lit, ["tagged", "nearby", "none", "unknown"])), (F.col("l_partkey") % 4 + 1).cast("int")).alias("signal"),
        (F.col("l_suppkey") % 7 == 3).alias("motor_allowed"),
        (F.col("l_partkey") % 23 == 4).alias("bridge"),
        (F.col("l_partkey") % 29 == 7).alias("tunnel"),
        F.when(F.col("l_partkey") % 9 != 0, F.concat(F.lit("road "), F.col("l_partkey") % 9)).alias("name"),
        (F.col("l_partkey") % 4).alias("way"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """physical_id and its signal, of some physical segments."""
    p = F.col("p_partkey")
    return spark.read.parquet(f"{sf_dir}/part.parquet").where(p < 45).select(p.alias("physical_id"), F.element_at(F.array(*map(F.lit, ["tagged", "none", "nearby", "none", "unknown"])), (p % 5 + 1).cast("int")).alias("signal"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """route_id, i, lat, lon and what is recorded about the segment from the point
    before: each line of an order goes one step on a lattice of streets, and every
    third order comes back the way it went."""
    rows = segments(spark, sf_dir)
    w = Window.partitionBy("route_id").orderBy("seq")
    dr, dc = F.when(F.col("way") == 0, 1).when(F.col("way") == 2, -1).otherwise(0), F.when(F.col("way") == 1, 1).when(F.col("way") == 3, -1).otherwise(0)
    more = ["highway", "crossing", "bridge", "tunnel", "name"]
    moved = rows.select("route_id", "seq", F.sum(dr).over(w).alias("r"), F.sum(dc).over(w).alias("c"), F.count("*").over(Window.partitionBy("route_id")).alias("n"), *more)
    start = moved.where("seq = 1").select("route_id", F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("c"), "n", *[F.lit(None).cast(t).alias(c) for c, t in moved.dtypes if c in more])
    there = moved.union(start)
    # On the way back segment k of n is segment n + 1 - k, from its end to its start.
    back = there.where("route_id % 3 = 0 and seq < n").select("route_id", (2 * F.col("n") - F.col("seq")).alias("seq"), "r", "c", "n")
    back = back.join(moved.select("route_id", (2 * F.col("n") - F.col("seq") + 1).alias("seq"), *more), ["route_id", "seq"])
    both = there.union(back.select(there.columns))
    return both.select("route_id", F.col("seq").alias("i"), (36.0 + F.col("r") * F.lit(0.001)).alias("lat"), (129.3 + F.col("c") * F.lit(0.001)).alias("lon"), *more)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, lat, lon, r, c of a lattice of 40 columns."""
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("node_id"), F.floor(k / 40).alias("r"), (k % 40).alias("c"), "c_mktsegment")
    return rows.select("node_id", "r", "c", (36.0 + F.col("r") * F.lit(0.001)).alias("lat"), (129.3 + F.col("c") * F.lit(0.001)).alias("lon"), "c_mktsegment")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_id, u, v with their places and length: right and lower neighbours."""
    n = nodes(spark, sf_dir).select("node_id", "lat", "lon", "c")
    step = F.explode(F.array(F.lit(1), F.lit(40)))
    u = n.select(F.col("node_id").alias("u"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), "c", step.alias("step")).where("not (step = 1 and c = 39)")
    v = n.select(F.col("node_id").alias("v"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    both = u.withColumn("v", F.col("u") + F.col("step")).join(v, "v")
    return both.select((F.col("u") * 2 + (F.col("step") == 40).cast("int")).alias("edge_id"), "u", "v", "lat1", "lon1", "lat2", "lon2", (100.0 + (F.col("u") + F.col("v")) % 7).alias("length"))


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """poi_id, lat, lon, kind."""
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        k.alias("poi_id"), (36.0002 + F.floor(k * 7 % 1500 / 40) * F.lit(0.001)).alias("lat"), (129.3003 + (k * 7 % 40) * F.lit(0.001)).alias("lon"), F.when(k % 2 == 0, "shop").otherwise("water").alias("kind")
    )


SQL = """
segments as (select o_custkey request_id, l_orderkey route_id, seq, "at", length, l_partkey % 50 physical_id,
    case when seq % 2 = 1 then start else start + length end from_m, case when seq % 2 = 1 then start + length else start end to_m,
    highway, highway = 'steps' steps, l_linenumber % 4 = 2 crossing,
    ({surfaces})[(l_partkey + l_suppkey) % {n} + 1] surface,
    case when l_linestatus = 'O' then 'yes' when l_linenumber % 3 = 0 then 'no' end lit,
    case l_suppkey % 4 when 0 then 3.5::double when 1 then 2.0::double end width,
    (['tagged', 'nearby', 'none', 'unknown'])[l_partkey % 4 + 1] signal, l_suppkey % 7 = 3 motor_allowed, l_partkey % 23 = 4 bridge, l_partkey % 29 = 7 tunnel,
    case when l_partkey % 9 <> 0 then 'road ' || (l_partkey % 9) end "name", l_partkey % 4 way
  from (select *, row_number() over w seq, l_quantity * 20.0::double length, sum(l_quantity * 20.0::double) over (w rows unbounded preceding) - l_quantity * 20.0::double "at",
      (l_suppkey % 5) * 50.0::double start, (['footway', 'residential', 'path', 'pedestrian', 'steps'])[l_partkey % 5 + 1] highway
    from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate)) x
  join orders on l_orderkey = o_orderkey),
nodes as (select c_custkey node_id, c_custkey // 40 r, c_custkey % 40 c, 36.0::double + (c_custkey // 40) * 0.001::double lat, 129.3::double + (c_custkey % 40) * 0.001::double lon from customer),
edges as (select a.node_id * 2 + (step = 40)::int edge_id, a.node_id u, b.node_id v, a.lat lat1, a.lon lon1, b.lat lat2, b.lon lon2, 100.0::double + (a.node_id + b.node_id) % 7 length
  from (select *, unnest([1, 40]) step from nodes) a join nodes b on b.node_id = a.node_id + step where not (step = 1 and a.c = 39)),
sgn as (select p_partkey physical_id, (['tagged', 'none', 'nearby', 'none', 'unknown'])[p_partkey % 5 + 1] signal from part where p_partkey < 45),
moved as (select route_id, seq, sum(case way when 0 then 1 when 2 then -1 else 0 end) over (w rows unbounded preceding) r, sum(case way when 1 then 1 when 3 then -1 else 0 end) over (w rows unbounded preceding) c, count(*) over (partition by route_id) n,
    highway, crossing, bridge, tunnel, "name" from segments window w as (partition by route_id order by seq)),
there as (select * from moved union all select route_id, 0, 0, 0, n, null, null, null, null, null from moved where seq = 1),
points as (select route_id, seq i, 36.0::double + r * 0.001::double lat, 129.3::double + c * 0.001::double lon, highway, crossing, bridge, tunnel, "name" from (
  select * from there union all select t.route_id, 2 * t.n - t.seq, t.r, t.c, t.n, m.highway, m.crossing, m.bridge, m.tunnel, m."name" from there t join moved m on m.route_id = t.route_id and m.seq = t.seq + 1 where t.route_id % 3 = 0 and t.seq < t.n)),
pois as (select s_suppkey poi_id, 36.0002::double + (s_suppkey * 7 % 1500 // 40) * 0.001::double lat, 129.3003::double + (s_suppkey * 7 % 40) * 0.001::double lon, case when s_suppkey % 2 = 0 then 'shop' else 'water' end kind from supplier)
""".replace("{surfaces}", str([x or "" for x in _SURFACES])).replace("{n}", str(len(_SURFACES))).replace("''", "null")
