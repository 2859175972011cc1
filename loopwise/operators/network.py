"""A walkable network out of map elements.

`elements(type, id, ordinal, tags, lat, lon, nodes, geometry, bounds)` are nodes
and ways as in a map extract; ordinal is their place in it.  Ways connect only by
the node ids that they share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwise import store
from loopwise.functions import evidence as E
from loopwise.functions import geo
from loopwise.operators import spatial

#: Metres: a crossing near a signal, a path along a main road, facilities by a path.
NEAR_SIGNAL, ALONG_ROAD, BY_PATH = 28.0, 35.0, 50.0
#: Segments of one way fit below this.
_WAY = 1 << 20


@dataclass
class Network:
    """nodes(node_id, node_seq, lat, lon); edges, one row per walkable segment,
    keyed by edge_id in element order, with its ends u and v; pois; edge_pois(
    edge_id, poi_id) for facilities within BY_PATH of an edge."""

    nodes: DataFrame
    edges: DataFrame
    pois: DataFrame
    edge_pois: DataFrame


def _inside(lat, lon, bbox):
    if not bbox:
        return F.lit(True)
    south, west, north, east = bbox
    return F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))


def _segments(ways: DataFrame) -> DataFrame:
    """way_id, ordinal, tags, pos, a, b (node ids), lat1, lon1, lat2, lon2 of
    neighbouring points of which both places are known, and way_m, the length of
    the whole way."""
    size = F.coalesce(F.size("geometry"), F.lit(0))
    meters = lambda p, q: F.coalesce(geo.meters(p["lat"], p["lon"], q["lat"], q["lon"]), F.lit(0.0))
    way_m = F.when(size > 1, F.aggregate(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), F.lit(0.0), lambda s, i: s + meters(F.get("geometry", i - 1), F.get("geometry", i)))).otherwise(0.0)
    several = ways.where((F.size("nodes") > 1) & (size > 1)).withColumn("way_m", way_m)
    part = F.transform(F.sequence(F.lit(1), F.size("nodes") - 1), lambda i: F.struct(i.alias("pos"), F.get("nodes", i - 1).alias("a"), F.get("nodes", i).alias("b"), F.get("geometry", i - 1).alias("p"), F.get("geometry", i).alias("q")))
    rows = several.select(F.col("id").alias("way_id"), "ordinal", "tags", "way_m", F.inline(part)).where("p is not null and q is not null")
    return rows.select("way_id", "ordinal", "tags", "way_m", "pos", "a", "b", F.col("p.lat").alias("lat1"), F.col("p.lon").alias("lon1"), F.col("q.lat").alias("lat2"), F.col("q.lon").alias("lon2"))


def build(elements: DataFrame, bbox: tuple[float, float, float, float] | None = None) -> Network:
    """The network of the elements within `bbox` (south, west, north, east; both
    ends of a segment must lie in it).

    Segments end at nodes that stop walkers and count from 10 cm on.  signal, for
    crossings: tagged (said on the way or an end), nearby (a signal within 28 m of
    an end or the middle, unless said to have none), none or unknown."""
    node_tags = elements.where("type = 'node' and size(tags) > 0").select("id", "tags")
    ways = elements.where("type = 'way'")
    rows = _segments(ways.where(E.usable(F.col("tags"))))
    rows = rows.where(_inside(F.col("lat1"), F.col("lon1"), bbox) & _inside(F.col("lat2"), F.col("lon2"), bbox))
    rows = rows.join(node_tags.select(F.col("id").alias("a"), F.col("tags").alias("ta")), "a", "left").join(node_tags.select(F.col("id").alias("b"), F.col("tags").alias("tb")), "b", "left")
    rows = rows.where(~E.blocked(F.col("ta")) & ~E.blocked(F.col("tb"))).withColumn("length", geo.meters(*map(F.col, ["lat1", "lon1", "lat2", "lon2"]))).where("length >= 0.1")
    tags = F.col("tags")
    is_ = lambda t, key, value: F.coalesce(E.tag(t, key) == value, F.lit(False))
    anyone = lambda key, value: is_("tags", key, value) | is_("ta", key, value) | is_("tb", key, value)
    crossing = is_("tags", "footway", "crossing") | is_("tags", "cycleway", "crossing") | is_("ta", "highway", "crossing") | is_("tb", "highway", "crossing")
    base = rows.select(
        (F.col("ordinal") * _WAY + F.col("pos")).alias("edge_id"),
        F.concat_ws(":", "way_id", "a", "b").alias("physical_id"),
        "way_id",
        F.col("a").alias("u"),
        F.col("b").alias("v"),
        "lat1",
        "lon1",
        "lat2",
        "lon2",
        "length",
        E.tag(tags, "highway").alias("highway"),
        F.coalesce(E.tag(tags, "name"), F.lit("")).alias("name"),
        F.coalesce(E.tag(tags, "highway").isin(E.LOCAL), F.lit(False)).alias("street"),
        crossing.alias("crossing"),
        (anyone("crossing:signals", "yes") | anyone("crossing", "traffic_signals")).alias("said"),
        (anyone("crossing:signals", "no") | anyone("crossing", "uncontrolled")).alias("denied"),
        is_("tags", "highway", "steps").alias("steps"),
        F.nullif(E.tag(tags, "surface"), F.lit("")).alias("surface"),
        F.nullif(E.tag(tags, "lit"), F.lit("")).alias("lit"),
        E.numeric_width(E.tag(tags, "width")).alias("width"),
        E.said_yes(tags, "bridge").alias("bridge"),
        E.said_yes(tags, "tunnel").alias("tunnel"),
        E.motor_allowed(tags).alias("motor_allowed"),
        F.when(crossing, F.col("length") / F.greatest("way_m", "length")).otherwise(0.0).alias("cross_fraction"),
        E.foot_direction(tags).alias("direction"),
    )
    # Five joins and all later stages read these.
    base, _ = store.written(base, "street-segments")
    signals = elements.where("type = 'node'").where(E.signal_node(F.col("tags"))).select("lat", "lon")
    near = spatial.edges_near_points(base.where("crossing and not denied"), signals, NEAR_SIGNAL).withColumn("near", F.lit(True))
    roads = _segments(ways.where(F.coalesce(E.tag("tags", "highway").isin(E.MAJOR), F.lit(False)))).select("lat1", "lon1", "lat2", "lon2")
    middle = base.where("not street and not crossing").select("edge_id", ((F.col("lat1") + F.col("lat2")) / 2).alias("lat"), ((F.col("lon1") + F.col("lon2")) / 2).alias("lon"))
    along = spatial.near_edges(middle, roads, ALONG_ROAD).select("edge_id").distinct().withColumn("boulevard", F.lit(True))
    pois = _pois(elements, bbox)
    edge_pois = spatial.near_edges(pois, base.select("edge_id", "lat1", "lon1", "lat2", "lon2"), BY_PATH).select("edge_id", "poi_id").distinct()
    edge_pois, _ = store.written(edge_pois, "pois-of-edges")
    counts = edge_pois.groupBy("edge_id").agg(F.count("*").alias("n_pois"))
    edges = base.join(near, "edge_id", "left").join(along, "edge_id", "left").join(counts, "edge_id", "left").fillna(False, ["near", "boulevard"]).fillna(0, ["n_pois"])
    signal = F.when(~F.col("crossing"), F.lit(None)).when(F.col("said"), "tagged").when(F.col("near"), "nearby").when(F.col("denied"), "none").otherwise("unknown")
    edges = edges.withColumn("signal", signal).drop("said", "denied", "near")
    return Network(nodes_of(edges), edges, pois, edge_pois)


def nodes_of(edges: DataFrame) -> DataFrame:
    """node_id, node_seq, lat, lon: a node stands where its first segment has it."""
    ends = edges.select(F.explode(F.array(*[F.struct(F.col(n).alias("node_id"), F.struct(F.col("edge_id"), F.lit(i).alias("end")).alias("first"), F.col(f"lat{i + 1}").alias("lat"), F.col(f"lon{i + 1}").alias("lon")) for i, n in enumerate("uv")])).alias("e")).select("e.*")
    return ends.groupBy("node_id").agg(F.min(F.struct("first", "lat", "lon")).alias("s")).select("node_id", (F.col("s.first.edge_id") * 2 + F.col("s.first.end")).alias("node_seq"), "s.lat", "s.lon")


def _pois(elements: DataFrame, bbox) -> DataFrame:
    """poi_id, lat, lon, kind, name, opening_hours of shops and water that walkers
    may use; a way stands at the middle of its bounds."""
    lat = F.when(F.col("type") == "node", F.col("lat")).otherwise((F.col("bounds.minlat") + F.col("bounds.maxlat")) / 2)
    lon = F.when(F.col("type") == "node", F.col("lon")).otherwise((F.col("bounds.minlon") + F.col("bounds.maxlon")) / 2)
    rows = elements.select(F.concat_ws("/", "type", "id").alias("poi_id"), lat.alias("lat"), lon.alias("lon"), E.facility(F.col("tags")).alias("kind"), E.tag("tags", "name").alias("name"), E.tag("tags", "opening_hours").alias("opening_hours"))
    return rows.where("kind is not null and lat is not null and lon is not null").where(_inside(F.col("lat"), F.col("lon"), bbox))


def stats(network: Network) -> DataFrame:
    """One row: numbers of nodes, edges, shops and water."""
    counted = [network.nodes.select(F.lit("nodes").alias("what")), network.edges.select(F.lit("edges")), network.pois.select("kind")]
    rows = counted[0].union(counted[1]).union(counted[2])
    return rows.agg(*[F.count_if(F.col("what") == w).alias(f"n_{n}") for w, n in (("nodes", "nodes"), ("edges", "edges"), ("shop", "shops"), ("water", "water"))])


def arcs(network: Network, profiles: list[str]) -> DataFrame:
    """profile, edge_id, u, v, forward, length, cost, steps for each direction in
    which an edge may be walked and each profile."""
    columns = {c: F.col(c) for c in ("highway", "crossing", "steps", "motor_allowed", "surface", "lit", "width", "n_pois", "length", "cross_fraction")}
    each = F.array(*[F.struct(F.lit(p).alias("profile"), E.edge_cost(columns, p).alias("cost")) for p in profiles])
    ways = F.array(F.struct(F.col("u").alias("from"), F.col("v").alias("to"), F.lit(True).alias("forward")), F.struct(F.col("v").alias("from"), F.col("u").alias("to"), F.lit(False).alias("forward")))
    ways = F.filter(ways, lambda w: F.when(w["forward"], F.col("direction") != -1).otherwise(F.col("direction") != 1))
    rows = network.edges.select("edge_id", "length", "steps", F.inline(each), ways.alias("ways"))
    return rows.select("profile", "edge_id", "length", "cost", "steps", F.inline("ways")).withColumnsRenamed({"from": "u", "to": "v"})
