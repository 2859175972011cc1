"""The registered route queries against their SQL and plain loops."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from loopwise.functions import evidence, geo
from loopwise.operators import elevation, ranking, sequence, spatial
from loopwise.registry import ORACLES, QUERIES
from loopwise.sources import elements, routes

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()


def rows(records):
    return sorted((tuple(None if v is None or v != v else v for v in r) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(f'"{c}"' for c in columns)} from ({ORACLES[name]})").fetchall()
    assert rows(map(tuple, got.select(*columns).collect())) == rows(want)


def by_route(spark):
    out = {}
    for r in routes.segments(spark, SF).orderBy("route_id", "seq").collect():
        out.setdefault(r.route_id, []).append(r)
    return out


def test_longest_walk(spark):
    want = {}
    for route, parts in by_route(spark).items():
        run = most = 0.0
        seen = []
        for s in parts:
            if s.highway in ("footway", "pedestrian") and not s.crossing and not s.steps and not s.motor_allowed:
                lo, hi = sorted((s.from_m, s.to_m))
                if any(p == s.physical_id and min(h, hi) - max(a, lo) > 0.05 for p, a, h in seen):
                    run, seen = 0.0, []
                seen.append((s.physical_id, lo, hi))
                run += s.length
                most = max(most, run)
            else:
                run, seen = 0.0, []
        want[route] = most
    assert {r.route_id: r.longest_walk_m for r in QUERIES["longest_walk"](spark, SF).collect()} == want


def test_crossing_passages(spark):
    want = {}
    for route, parts in by_route(spark).items():
        n, way = 0, None
        for s in parts:
            if not s.crossing:
                way = None
                continue
            d = (s.to_m > s.from_m) - (s.to_m < s.from_m)
            if way is None or way.get(s.physical_id, d) != d:
                n, way = n + 1, {}
            way[s.physical_id] = d
        want[route] = n
    assert {r.route_id: r.n_passages for r in QUERIES["crossing_passages"](spark, SF).collect()} == want


def test_climbs_forget_at_gaps_and_skip_small_moves(spark):
    profile = [0.0, 2.9, 0.0, 5.0, None, 20.0, 18.0, 10.0]
    df = spark.createDataFrame([(1, i, e) for i, e in enumerate(profile)], "k int, i int, elevation double")
    r = elevation.climbs(df, "k").first()
    assert (r.ascent, r.descent) == (5.0, 10.0)


@pytest.mark.parametrize(("length", "want"), [(1.0, [0, 1]), (74.0, [0, 74]), (75.0, [0, 50, 75]), (100.5, [0, 50, 100.5])])
def test_sample_positions(spark, length, want):
    got = spark.createDataFrame([(length,)], "length double").select(elevation.sample_positions(F.col("length")).alias("x")).first().x
    assert got == [float(x) for x in want]


def ranked(spark, rows):
    """Winners and open reasons of routes (id, score, range, signals, unknown[, error])."""
    table = [(1, i, float(s), e[0] if e else 0.0, None if r is None else float(r), r is not None, n, u) for i, s, r, n, u, *e in rows]
    df = spark.createDataFrame(table, "request_id int, route_id int, final_score double, error double, range_m double, elevation_known boolean, n_signals int, n_unknown int")
    df = ranking.rank_score(df)
    return {r.route_id: r.reasons for r in ranking.recommend(df).collect()}, sorted(r.reason for r in ranking.pending(df).collect())


def test_winners_outside_the_best_three(spark):
    assert ranked(spark, [(1, 100, 40, 4, 0), (2, 95, 39, 4, 0), (3, 90, 38, 4, 0), (4, 80, 5, 3, 0), (5, 70, 30, 1, 0)]) == ({1: "best", 4: "elevation", 5: "signals"}, [])


def test_unknown_is_not_zero(spark):
    assert ranked(spark, [(1, 100, None, 0, 2), (2, 90, 30, 3, 0)]) == ({1: "best", 2: "elevation+signals"}, [])


def test_reasons_without_a_route_are_pending(spark):
    assert ranked(spark, [(1, 100, None, 0, 1)]) == ({1: "best"}, ["elevation", "signals"])


def test_a_range_of_zero_wins(spark):
    assert ranked(spark, [(1, 100, 10, 1, 0), (2, 90, 0, 2, 0)])[0] == {1: "best+signals", 2: "elevation"}


def test_ties_go_to_error_and_id(spark):
    assert ranked(spark, [(1, 50, 9, 1, 0, 0.1), (3, 50, 9, 1, 0, 0.0), (2, 50, 9, 1, 0, 0.0)])[0] == {2: "best+elevation+signals"}


def test_the_first_known_score_counts(spark):
    df = spark.createDataFrame([(1, None, 0.0, 9.0), (2, 5.0, 7.0, 9.0), (3, None, None, 4.0), (4, None, None, None)], "id int, final_score double, score double, bonus double")
    assert [r.rank_score for r in ranking.rank_score(df).orderBy("id").collect()] == [0.0, 5.0, 4.0, 0.0]


def test_access_rules(spark):
    cases = [({"highway": "footway"}, True), ({"highway": "footway", "access": "private"}, False), ({"highway": "footway", "access": "private", "foot": "yes"}, True), ({"highway": "track"}, False), ({"highway": "track", "foot": "designated"}, True), ({"highway": "path", "area": "yes"}, False), (None, False)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, tags map<string,string>")
    got = {r.i: r.u for r in df.select("i", evidence.usable(F.col("tags")).alias("u")).collect()}
    assert got == {i: u for i, (_, u) in enumerate(cases)}


@pytest.mark.parametrize("degrees", [0, 36, 60, 79])
def test_near_edges_equals_all_pairs(spark, degrees):
    """At the equator and far north, on streets as wide in metres."""
    wider = math.cos(math.radians(36)) / math.cos(math.radians(degrees))
    there = lambda df: df.withColumns({c: F.col(c) - 36 + degrees if c.startswith("lat") else 129 + (F.col(c) - 129) * wider for c in df.columns if c[:3] in ("lat", "lon")})
    p, e = there(routes.pois(spark, SF)), there(routes.edges(spark, SF))
    got = {(r.poi_id, r.edge_id) for r in spatial.near_edges(p, e, 140.0).collect()}
    want = set()
    for a in p.collect():
        for b in e.collect():
            x, y = (b.lon2 - b.lon1) * 90000, (b.lat2 - b.lat1) * 111320
            t = max(0, min(1, ((a.lon - b.lon1) * 90000 * x + (a.lat - b.lat1) * 111320 * y) / (x * x + y * y)))
            la, lo = b.lat1 + (b.lat2 - b.lat1) * t, b.lon1 + (b.lon2 - b.lon1) * t
            h = math.sin(math.radians(la - a.lat) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(a.lat)) * math.sin(math.radians(lo - a.lon) / 2) ** 2
            if 12742000 * math.asin(min(1, math.sqrt(h))) <= 140:
                want.add((a.poi_id, b.edge_id))
    assert got == want


def test_empty_tables(spark):
    none = routes.segments(spark, SF).limit(0)
    assert sequence.crossing_groups(none).count() == sequence.longest_walk(none).count() == sequence.similar_pairs(sequence.coverage_sweep(none)).count() == 0
    assert [spark.range(1).select(geo.half_up(F.lit(x)).alias("x")).first().x for x in (-2.5, 2.5, 2.4)] == [-2, 3, 2]


def test_sanitising_twice_changes_nothing(spark):
    rows = spark.createDataFrame([(1, "u", {"phone": "1", "crossing": "yes"}), (2, None, None), (3, None, {"email": "e"}), (4, None, {})], "id long, user string, tags map<string,string>")
    assert sorted(r.id for r in elements.unclean(rows).collect()) == [1, 3]
    once = elements.sanitized(rows)
    assert once.columns == ["id", "tags"] and elements.unclean(once).isEmpty()
    assert sorted((r.id, r.tags) for r in once.collect()) == sorted((r.id, r.tags) for r in elements.sanitized(once).collect())
    assert {r.id: r.tags for r in once.collect()} == {1: {"crossing": "yes"}, 2: None, 3: {}, 4: {}}


def test_requests_and_modes(spark):
    df = spark.createDataFrame([(1000.0, "A"), (950.0, "B"), (12000.0, None), (12500.0, "x"), (1250.0, "a"), (None, "A")], "m double, mode string")
    got = df.select(evidence.asked_distance(F.col("m")).alias("ok"), evidence.display_mode(F.col("mode")).alias("mode")).collect()
    assert [r.ok for r in got] == [True, False, True, False, False, False] and [r["mode"] for r in got] == ["A", "B", "B", "B", "B", "A"]


def test_distance_of_an_unknown_place_is_unknown(spark):
    r = spark.range(1).select(geo.meters(F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("a"), geo.meters(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("b")).first()
    assert r.a is None and r.b == pytest.approx(12742000 * math.pi / 2)


def test_no_penalty_without_a_contained_route(spark):
    routes_ = spark.createDataFrame([(1, 3000.0, 10.0), (2, 2500.0, 10.0), (3, 2600.0, 10.0)], "route_id long, length double, score double")
    pairs = spark.createDataFrame([(2, 3, 2500.0, 2500.0, 2600.0)], "a long, b long, shared_m double, total_a double, total_b double")
    got = {r.route_id: r.penalty for r in ranking.subset_penalty(routes_, pairs, 2000.0).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: pytest.approx(150 * 100 / 2000)}


def test_pairs_on_a_long_street(spark):
    """Routes far apart on one street share nothing; overlaps across stretches count once."""
    rows = [(1, "s", i, lo, hi, t) for i, (lo, hi, t) in enumerate([(0.0, 120.0, 1), (50.0, 60.0, 2), (49.0, 1000.0, 2), (990.0, 2000.0, 1), (1000.0, 1000.0, 1), (100.0, 150.0, 1), (2500.0, 2600.0, 1)])] + [(2, "s", 9, 0.0, 3000.0, 1)]
    got = {(r.a, r.b): r.shared_m for r in sequence.similar_pairs(spark.createDataFrame(rows, "request_id long, physical_id string, route_id long, lo double, hi double, times int")).collect()}
    want = {}
    for q, _, a, lo, hi, t in rows:
        for q2, _, b, lo2, hi2, t2 in rows:
            if q == q2 and a < b and lo < hi2 and lo2 < hi:
                want[a, b] = (min(hi, hi2) - max(lo, lo2)) * min(t, t2)
    assert got == want
