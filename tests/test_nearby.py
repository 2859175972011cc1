"""Starts near a request's own, their gates and their choice, against plain loops."""

import math

import pytest
from pyspark.sql import functions as F

from loopwise.functions import evidence
from loopwise.operators import explore, nearby, network
from loopwise.sources import streets
from tests.test_network import SF, meters, project, tree, way_to


def test_access_equals_a_plain_search(spark):
    net = network.build(streets.elements(spark, SF))
    asked = [(1, 36.0004, 129.3031, True), (2, 36.0011, 129.3093, False), (3, 36.002, 129.325, True), (4, 36.5, 129.3, True)]
    requests = spark.createDataFrame([(*r, 1000.0) for r in asked], "request_id long, lat double, lon double, avoid_steps boolean, distance double")
    s = explore.streets(net, requests)
    got = {(r.request_id, r.place): (r.node, round(r.bonus, 6), round(r.out_m, 6), round(r.in_m, 6), round(r.out_steps_m, 6), r.out_crossings > 0, r.in_crossings > 0) for r in nearby.access(s, net).collect()}
    nodes = {r.node_id: (r.node_seq, (r.lat, r.lon)) for r in s.nodes.collect()}
    facts = ("highway", "crossing", "steps", "motor_allowed", "surface", "lit", "width", "n_pois")
    edges = {r.edge_id: r for r in s.edges.withColumn("bonus", evidence.edge_bonus({c: F.col(c) for c in facts}, "balanced")).collect()}
    crossing = {e: r.crossing for e, r in edges.items()} | {r.edge_id: r.crossing for r in s.own_edges.collect()}
    steps = {e: r.steps for e, r in edges.items()} | {r.edge_id: r.steps for r in s.own_edges.collect()}
    base = network.arcs(network.Network(s.nodes, s.edges, net.pois, net.edge_pois), ["distance"]).collect()
    own = {r.edge_id: r.request_id for r in s.own_edges.collect()}
    extra = network.arcs(network.Network(s.nodes, s.own_edges, net.pois, net.edge_pois), ["distance"]).collect()
    bonus = {}
    for r in base:
        bonus[r.u] = max(bonus.get(r.u, 0.0), edges[r.edge_id].bonus)

    def snapped(p):
        best = min(((project(p, (e.lat1, e.lon1), (e.lat2, e.lon2))[2], i) for i, e in edges.items() if not e.steps), default=(1e9, 0))
        t = project(p, (edges[best[1]].lat1, edges[best[1]].lon1), (edges[best[1]].lat2, edges[best[1]].lon2))[0]
        return None if best[0] > 100 else edges[best[1]].u if t < 0.001 else edges[best[1]].v if t > 0.999 else "inside"

    want = {}
    for at in s.starts.collect():
        if at.state != "ok":
            continue
        adj = {}
        for r in [*(r for r in base if r.edge_id != at.edge_id), *(r for r in extra if own[r.edge_id] == at.request_id)]:
            adj.setdefault(r.u, []).append((r.v, r.edge_id, r.length, r.cost, r.steps))
        out = tree(adj, at.node, 300.0, at.avoid_steps)
        near = sorted(((-bonus.get(v, 0.0), -m, nodes[v][0], v) for v, (_, _, _, m) in out.items() if v in nodes and 80 <= m <= 300 and bonus.get(v, 0.0) > 0))
        kept = []
        for b, m, _, v in near:
            if len(kept) == 4 or any(meters(nodes[k][1], nodes[v][1]) < 100 for k in kept) or snapped(nodes[v][1]) != v:
                continue
            back = tree(adj, v, 300.0, at.avoid_steps)
            if at.node not in back:
                continue
            kept.append(v)
            ways = [[e for e, _, _ in way_to(out, at.node, v)], [e for e, _, _ in way_to(back, v, at.node)]]
            length = {e: x for es in adj.values() for _, e, x, _, _ in es}
            want[at.request_id, len(kept)] = (v, round(-b, 6), round(-m, 6), round(back[at.node][3], 6), round(sum(length[e] for e in ways[0] if steps[e]), 6), any(crossing[e] for e in ways[0]), any(crossing[e] for e in ways[1]))
    assert want and got == want and max(p for _, p in want) >= 2


@pytest.mark.parametrize("seed", [1, 2])
def test_spacing_keeps_the_first_of_neighbours(spark, seed):
    import random

    draw = random.Random(seed)
    rows = [(r, draw.random(), i, 60 + draw.random() / 200, 129.3 + draw.random() / 100) for r in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "request_id long, rank double, node long, lat double, lon double")
    got = {(r.request_id, r.place): r.node for r in nearby.spaced(df).collect()}
    want = {}
    for request in range(3):
        kept = []
        for _, _, i, la, lo in sorted(r for r in rows if r[0] == request):
            if len(kept) < 4 and all(meters(k, (la, lo)) >= 100 for k in kept):
                kept.append((la, lo))
                want[request, len(kept)] = i
    assert got == want


def test_every_gate_counts(spark):
    """A route that passes all, and one that fails each gate alone."""
    good = {"request_id": 1, "route_id": 1, "length": 1040.0, "distance": 1000.0, "final_score": 50.0, "steps_m": 0.0, "n_crossings": 1, "paved_walk_m": 600.0, "lit_walk_m": 0.0, "wide_walk_m": 500.0,
            "base_length": 1000.0, "base_final_score": 30.0, "base_steps_m": 0.0, "base_n_crossings": 2, "base_paved_walk_m": 350.0, "base_lit_walk_m": 0.0, "base_wide_walk_m": 450.0,
            "out_m": 200.0, "in_m": 220.0, "out_steps_m": 0.0, "in_steps_m": 0.05, "out_crossings": 1, "in_crossings": 0}
    bad = [{"length": 1051.0}, {"in_m": 301.0}, {"in_steps_m": 0.2}, {"in_crossings": 1}, {"final_score": 44.1}, {"paved_walk_m": 560.0, "wide_walk_m": 480.0}]
    rows = [good, *[good | {"route_id": i + 2} | b for i, b in enumerate(bad)]]
    names = list(good)
    df = spark.createDataFrame([tuple(float(r[c]) if isinstance(good[c], float) else r[c] for c in names) for r in rows], ", ".join(f"{c} {'double' if isinstance(good[c], float) else 'long'}" for c in names))
    found = {r.route_id: r for r in nearby.qualified(df).collect()}
    gates = ["near_distance", "short_access", "no_more_steps", "no_more_crossings", "worth"]
    assert found[1].qualified and found[1].reasons == ["paved"] and found[1].gain == pytest.approx(50 - 30 - 4.2)
    for i, gate in enumerate(gates):
        assert not found[i + 2].qualified and [g for g in gates if not found[i + 2][g]] == [gate]
    assert not found[7].qualified and found[7].reasons == []


def test_proposals_differ(spark):
    """The second best is left out as it shares nine tenths with the best."""
    rows = [(1, 1, 10, 20.0), (1, 2, 11, 30.0), (1, 3, 12, 25.0), (1, 4, 13, 20.0), (2, 1, 20, 12.0)]
    df = spark.createDataFrame(rows, "request_id long, place long, route_id long, gain double")
    pairs = spark.createDataFrame([(11, 12, 900.0, 1000.0, 950.0), (10, 11, 899.0, 1000.0, 900.0), (10, 13, 990.0, 1000.0, 1000.0)], "a long, b long, shared_m double, total_a double, total_b double")
    got = {(r.request_id, r.proposal): r.route_id for r in nearby.chosen(df, pairs).collect()}
    assert got == {(1, 1): 11, (1, 2): 10, (2, 1): 20}
    assert nearby.chosen(df.limit(0), pairs).collect() == []


def test_proposals_of_a_small_map(spark):
    """The whole way for one request: two proposals at most, all gates open."""
    net = network.build(streets.elements(spark, SF))
    requests = spark.createDataFrame([(1, 36.0004, 129.3031, 1000.0, False)], "request_id long, lat double, lon double, distance double, avoid_steps boolean")
    x = explore.explored(net, requests, ["distance"], variants=1)
    from loopwise.operators import results

    n = nearby.nearby_starts(net, requests, x, results.results(x))
    routes = {r.route_id: r for r in n.routes.collect()}
    assert routes and {r.request_id for r in routes.values()} == {1} and {r.place for r in routes.values()} <= {1, 2, 3, 4}
    found = n.proposals.collect()
    assert len(found) <= 2 and all(routes[r.route_id].qualified for r in found)
    for place in {r.place for r in routes.values() if r.qualified}:
        best = max(r.final_score for r in routes.values() if r.qualified and r.place == place)
        assert all(routes[r.route_id].final_score == best for r in found if r.place == place)
    assert all(math.isclose(r.walk_m, r.out_m + r.in_m) for r in routes.values())
