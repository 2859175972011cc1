"""Access rules and evidence about ways and segments as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags that decide access and surfaces.
ACCESS = ["no", "private", "customers", "permit", "destination", "use_sidepath"]
FOOT_OK = ["yes", "designated", "permissive", "official"]
WALK = ["footway", "pedestrian", "path", "steps"]
LOCAL = ["residential", "living_street", "service", "unclassified"]
MAJOR = ["primary", "secondary", "tertiary"]
PAVED = ["asphalt", "concrete", "concrete:plates", "concrete:lanes", "paved", "paving_stones"]
UNPAVED = ["unpaved", "gravel", "fine_gravel", "ground", "dirt", "earth", "sand", "mud", "grass", "woodchips"]
# What the bonus of a route gives per share of its metres.
WEIGHTS = {"walk_m": 20, "paved_walk_m": 30, "lit_walk_m": 15, "wide_walk_m": 15}


def _in(value: Column, names: list[str]) -> Column:
    return F.coalesce(value.isin(names), F.lit(False))


def _said(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def tag(tags, name: str) -> Column:
    return F.try_element_at(tags, F.lit(name))


def restricted(tags) -> Column:
    """Whether a way or node keeps walkers out; null tags don't."""
    foot = tag(tags, "foot")
    return _in(foot, ACCESS) | (~_in(foot, FOOT_OK) & _in(tag(tags, "access"), ACCESS)) | _said(tag(tags, "access:conditional")) | _said(tag(tags, "foot:conditional"))


def usable(tags) -> Column:
    """Whether a way can be walked on."""
    highway = tag(tags, "highway")
    kind = _in(highway, WALK + LOCAL) | (_in(highway, ["cycleway", "track"]) & _in(tag(tags, "foot"), FOOT_OK))
    return kind & ~restricted(tags) & ~_in(tag(tags, "area"), ["yes"]) & ~_said(tag(tags, "construction"))


def numeric_width(value) -> Column:
    """Metres of a width tag such as `3`, `2.5 m`; null if it is anything else or 0."""
    width = F.try_to_number(F.regexp_extract(F.trim(value), r"^(\d+(?:\.\d+)?)\s*m?$", 1), F.lit("999999999D999999")).cast("double")
    return F.when(width > 0, width)


def walking(s: dict[str, Column]) -> Column:
    """A segment for walkers alone: no crossing, steps or motor traffic."""
    return _in(s["highway"], ["footway", "pedestrian"]) & ~s["crossing"] & ~s["steps"] & ~s["motor_allowed"]


def motor_allowed(tags) -> Column:
    """Whether a way's tags let motor traffic in."""
    return _in(tag(tags, "motor_vehicle"), ["yes", "designated"]) | _in(tag(tags, "motorcar"), ["yes", "designated"])


def said_yes(tags, name: str) -> Column:
    """A tag with any value but `no`, as of bridges and tunnels."""
    return _said(tag(tags, name)) & ~_in(tag(tags, name), ["no"])


def blocked(tags) -> Column:
    """Whether a node stops walkers: closed to them, a wall or fence, or another
    barrier that isn't said to be open on foot."""
    barrier = tag(tags, "barrier")
    return restricted(tags) | _in(barrier, ["wall", "fence"]) | (_said(barrier) & ~_in(tag(tags, "foot"), FOOT_OK))


def foot_direction(tags) -> Column:
    """1 or -1 for a way that is one-way on foot, else 0."""
    way = tag(tags, "oneway:foot")
    return F.when(_in(way, ["-1"]), -1).when(_in(way, ["yes", "1", "true"]), 1).otherwise(0)


def facility(tags) -> Column:
    """shop, water or null; closed ones are none."""
    water = (_in(tag(tags, "amenity"), ["drinking_water"]) | _in(tag(tags, "drinking_water"), ["yes"])) & ~_in(tag(tags, "drinking_water"), ["no"])
    return F.when(restricted(tags), F.lit(None)).when(_in(tag(tags, "shop"), ["convenience"]), "shop").when(water, "water")


def signal_node(tags) -> Column:
    return _in(tag(tags, "highway"), ["traffic_signals"]) | _in(tag(tags, "crossing:signals"), ["yes"]) | _in(tag(tags, "crossing"), ["traffic_signals"])


def edge_cost(s: dict[str, Column], profile: str) -> Column:
    """Cost of a segment under a profile; `flow` adds up to 300 for a crossing.
    Steps that are to be avoided are left out of the arcs instead."""
    cost = s["length"] / (1 + edge_bonus(s, profile))
    return cost + F.when(s["crossing"], s["cross_fraction"] * 300).otherwise(0.0) if profile == "flow" else cost


def display_mode(value) -> Column:
    """A for the value A, else B."""
    return F.when(_in(value, ["A"]), "A").otherwise("B")


def asked_distance(metres) -> Column:
    """Whether a request's distance may be asked for: 1 to 12 km in half
    kilometres."""
    return F.coalesce(metres.between(1000, 12000) & (metres % 500 == 0), F.lit(False))


def edge_bonus(s: dict[str, Column], profile: str) -> Column:
    """Attraction of a segment under a profile: distance, balanced, flow,
    boulevard or supply (which adds for facilities)."""
    if profile == "distance":
        return F.lit(0.0)
    on = walking(s)
    bonus = F.when(on, 0.2 + F.when(_in(s["surface"], PAVED), 0.3).otherwise(0.0) + F.when(_in(s["lit"], ["yes"]), 0.15).otherwise(0.0) + F.when(F.coalesce(s["width"] >= 3, F.lit(False)), 0.15).otherwise(0.0)).otherwise(0.0)
    if profile == "boulevard":
        return bonus * 1.6
    return bonus + F.when(s["n_pois"] > 0, 0.3).otherwise(0.0) if profile == "supply" else bonus
