"""Place names: an index, searches in it, and merging with online results."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loopwise.functions import evidence as E
from loopwise.functions import geo
from loopwise.operators import spatial

# What a search leaves out, streets that are no places, presets.
REGION_WORDS = ["대한민국", "경상북도", "포항시", "포항"]
NO_PLACES = ["motorway", "motorway_link", "trunk", "trunk_link", "construction"]
CENTER = (36.021, 129.337)
PRESETS = [("preset-forest", "철길숲 주변", 36.021, 129.337, "철길숲 포항 철길숲"), ("preset-postech", "POSTECH 주변", 36.0135, 129.325, "포스텍 포항공과대학교 포항공대 POSTECH")]

INDEX = "place_id string, place_seq long, name string, lat double, lon double, source string, is_road boolean, text string"


@F.arrow_udf(T.StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


def normal(value: Column) -> Column:
    """Compatibility form in lower case without blanks, commas, dots, brackets and
    hyphens; null is empty."""
    return F.regexp_replace(F.lower(_nfkc(F.coalesce(value, F.lit("")))), r"[\s,·.()\-]", "")


def search_term(value: Column) -> Column:
    """`normal` without the names of the region."""
    return F.regexp_replace(normal(value), "|".join(REGION_WORDS), "")


def in_coverage(lat: Column, lon: Column, bbox: tuple[float, float, float, float] | None) -> Column:
    """Whether a known place lies in the box (south, west, north, east); never
    without a box."""
    if not bbox:
        return F.lit(False)
    south, west, north, east = bbox
    return F.coalesce(lat.between(south, north) & lon.between(west, east) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def place_index(elements: DataFrame, bbox: tuple[float, float, float, float] | None) -> DataFrame:
    """INDEX of the presets and the named elements inside the box, each at the
    middle one of its points inside; of streets of one name the nearest to CENTER
    counts (ties: the first)."""
    spark = elements.sparkSession
    tag = lambda key: E.tag("tags", key)
    name = F.coalesce(F.nullif(tag("name:ko"), F.lit("")), F.nullif(tag("name"), F.lit("")))
    road = F.coalesce(tag("highway") != "", F.lit(False))
    own = F.array(F.struct("lat", "lon"))
    at = F.filter(F.when(F.col("type") == "node", own).otherwise(F.coalesce("geometry", F.array().cast("array<struct<lat:double,lon:double>>"))), lambda p: in_coverage(p["lat"], p["lon"], bbox))
    rows = elements.where(name.isNotNull() & ~F.coalesce(tag("highway").isin(NO_PLACES), F.lit(False))).withColumn("at", at).where(F.size("at") > 0)
    rows = rows.withColumn("p", F.get("at", F.floor(F.size("at") / 2).cast("int")))
    address = F.concat_ws(" ", F.nullif(tag("addr:street"), F.lit("")), F.nullif(tag("addr:housenumber"), F.lit("")))
    words = F.concat_ws(" ", name, *[F.nullif(tag(k), F.lit("")) for k in ("name:en", "alt_name", "short_name")], F.nullif(address, F.lit("")))
    rows = rows.select(F.concat_ws("/", "type", "id").alias("place_id"), (F.col("ordinal") + len(PRESETS)).alias("place_seq"), name.alias("name"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"), F.lit("map").alias("source"), road.alias("is_road"), search_term(words).alias("text"))
    far = geo.meters(F.col("lat"), F.col("lon"), F.lit(CENTER[0]), F.lit(CENTER[1]))
    roads = rows.where("is_road").groupBy("name").agg(F.min_by(F.struct(*rows.columns), F.struct(far.alias("far"), F.col("place_seq").alias("seq"))).alias("s")).select("s.*")
    presets = spark.createDataFrame([(i, n, name_, lat, lon, aliases) for n, (i, name_, lat, lon, aliases) in enumerate(PRESETS)], "place_id string, place_seq long, name string, lat double, lon double, aliases string")
    presets = presets.select("place_id", "place_seq", "name", "lat", "lon", F.lit("preset").alias("source"), F.lit(False).alias("is_road"), search_term(F.concat_ws(" ", "name", "aliases")).alias("text"))
    return presets.union(rows.where("not is_road")).union(roads.select(rows.columns))


def search(index: DataFrame, queries: DataFrame, limit: int = 6) -> DataFrame:
    """The `limit` best places of the INDEX for each of `queries(query_id, query)`,
    with their place: the term in their text; the same name first, then presets,
    names that begin with it, others; then by length of name and order of the index.
    Queries without a term find nothing.

    Texts stand under their runs of up to three characters, and a term looks under
    its first."""
    terms = queries.select("query_id", search_term(F.col("query")).alias("q")).where("q <> ''").withColumn("key", F.substring("q", 1, 3))
    n = F.length("text")
    runs = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(F.col("text"), i, F.lit(k)))
    keys = index.where("text <> ''").withColumn("key", F.explode(F.array_distinct(F.concat(runs(1), runs(2), runs(3)))))
    met = keys.join(terms, "key").where(F.contains(F.col("text"), F.col("q")))
    name = search_term(F.col("name"))
    rank = F.when(name == F.col("q"), 0).when(F.col("source") == "preset", 1).when(name.startswith(F.col("q")), 2).otherwise(3)
    w = Window.partitionBy("query_id").orderBy("rank", F.length("name"), "place_seq")
    rows = met.withColumn("rank", rank).withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    return rows.select("query_id", F.col("place").cast("long").alias("place"), "place_id", "name", F.col("rank").cast("long").alias("rank"))


#: The part of an online answer that is read.
PHOTON = "struct<features:array<struct<geometry:struct<type:string,coordinates:array<double>>,properties:map<string,string>>>>"


def parsed_answers(answers: DataFrame, bbox: tuple[float, float, float, float] | None) -> DataFrame:
    """The places in `answers(query_id, body)`, JSON of an online geocoder, in their
    order: points in range that have a name or a street; outside marks those not in
    the box.  An answer that can't be read raises."""
    rows = answers.select("query_id", F.from_json("body", PHOTON, {"mode": "PERMISSIVE"}).alias("a"))
    rows = rows.select("query_id", F.when(F.col("a.features").isNull(), F.raise_error(F.lit("an answer has no features"))).otherwise(F.col("a.features")).alias("f"))
    each = rows.select("query_id", F.posexplode("f").alias("n", "f")).select("query_id", "n", F.col("f.properties").alias("t"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    each = each.where((F.col("kind") == "Point") & (F.size("c") == 2) & (F.abs(F.get("c", 0)) <= 180) & (F.abs(F.get("c", 1)) <= 90))
    tag = lambda key: F.nullif(F.try_element_at(F.col("t"), F.lit(key)), F.lit(""))
    name = F.coalesce(tag("name"), F.nullif(F.concat_ws(" ", tag("street"), tag("housenumber")), F.lit("")))
    description = F.array_join(F.array_distinct(F.array_compact(F.array(*[tag(k) for k in ("state", "city", "district", "locality", "street", "housenumber")]))), " ")
    out = each.withColumn("name", name).where(F.trim("name") != "")
    place_id = F.concat_ws("/", F.lit("online"), F.coalesce(tag("osm_type"), F.lit("place")), F.coalesce(tag("osm_id"), F.col("n").cast("string")))
    lat, lon = F.get("c", 1), F.get("c", 0)
    return out.select("query_id", F.col("n").cast("long").alias("n"), place_id.alias("place_id"), "name", lat.alias("lat"), lon.alias("lon"), F.coalesce(tag("type") == "street", F.lit(False)).alias("is_road"), description.alias("description"), (~in_coverage(lat, lon, bbox)).alias("outside"))


def merged(local: DataFrame, online: DataFrame, limit: int = 10, near: float = 120.0) -> DataFrame:
    """Places of each query: those of `local(query_id, n, name, lat, lon)`, then
    those of `online(..., outside)` that no earlier one of the same name stands
    within `near` metres of; those inside first, `limit` at most.

    Only places of one query and name are compared, in order."""
    a = local.select("query_id", F.lit(0).alias("part"), F.col("n").cast("long").alias("n"), "name", "lat", "lon", F.lit(False).alias("outside"))
    b = online.select("query_id", F.lit(1).alias("part"), F.col("n").cast("long").alias("n"), "name", "lat", "lon", F.coalesce("outside", F.lit(False)).alias("outside"))
    item = F.struct("part", "n", "name", "lat", "lon", "outside")
    groups = a.union(b).groupBy("query_id", normal(F.col("name")).alias("key")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = "array<struct<part:int,n:bigint,name:string,lat:double,lon:double,outside:boolean>>"
    kept = F.aggregate("items", F.array().cast(kind), lambda s, x: F.when((x["part"] == 1) & F.exists(s, lambda y: geo.meters(y["lat"], y["lon"], x["lat"], x["lon"]) < near), s).otherwise(F.concat(s, F.array(x))))
    rows = groups.select("query_id", F.inline(kept))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("outside", "part", "n"))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= limit).drop("part", "n")


def named_roads(elements: DataFrame) -> DataFrame:
    """road_seq, name, lat1, lon1, lat2, lon2: the segments of named ways, over
    points that aren't known but not over breaks (see `tiles`)."""
    ways = elements.where("type = 'way' and size(geometry) > 1").where(F.coalesce(E.tag("tags", "highway") != "", F.lit(False)) & F.coalesce(E.tag("tags", "name") != "", F.lit(False)))
    paired = F.coalesce(F.size("nodes") == F.size("geometry"), F.lit(False))
    g = F.filter("geometry", lambda p, i: p.isNotNull() | (paired & F.get("nodes", i).isNull()))
    part = F.transform(F.sequence(F.lit(1), F.greatest(F.size("g") - 1, F.lit(1))), lambda i: F.struct(i.alias("pos"), F.get("g", i - 1).alias("p"), F.get("g", i).alias("q")))
    rows = ways.withColumn("g", g).where("size(g) > 1").select("ordinal", E.tag("tags", "name").alias("name"), F.inline(part)).where("p is not null and q is not null")
    return rows.select((F.col("ordinal") * (1 << 20) + F.col("pos")).alias("road_seq"), "name", F.col("p.lat").alias("lat1"), F.col("p.lon").alias("lon1"), F.col("q.lat").alias("lat2"), F.col("q.lon").alias("lon2"))


def nearby_roads(points: DataFrame, id: str, roads: DataFrame, most: float = 250.0) -> DataFrame:
    """The nearest named road of each point(lat, lon) within `most` metres and how
    far it is to tens of metres; null for points without one."""
    best = spatial.near_edges(points.select(id, "lat", "lon"), roads, most).groupBy(id).agg(F.min(F.struct(F.col("on.distance").alias("m"), "road_seq", "name")).alias("s"))
    return points.select(id).join(best, id, "left").select(id, F.col("s.name").alias("road"), (F.floor(F.col("s.m") / 10 + 0.5) * 10).cast("long").alias("about_m"))


def map_link(lat: Column, lon: Column, name: Column) -> Column:
    """Address of a point on an online map."""
    return F.concat(F.lit("https://map.kakao.com/link/map/"), F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")), F.lit(","), F.format_string("%.7f", lat), F.lit(","), F.format_string("%.7f", lon))
