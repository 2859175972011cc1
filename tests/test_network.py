"""Networks, searches, families and lines against plain Python."""

import heapq
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loopwise import store
from loopwise.operators import completions, elevation, evaluate, explore, families, guide, network, paths, places, ranking, sequence
from loopwise.sources import routes, streets, tiles

SF = "/root/testdata/sf0.001"


def meters(a, b):
    y, x = math.radians(b[0] - a[0]), math.radians(b[1] - a[1])
    return 12742000 * math.asin(min(1, math.sqrt(math.sin(y / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(x / 2) ** 2)))


def project(p, a, b):
    x, y = (b[1] - a[1]) * 90000, (b[0] - a[0]) * 111320
    t = max(0, min(1, ((p[1] - a[1]) * 90000 * x + (p[0] - a[0]) * 111320 * y) / (x * x + y * y or 1)))
    q = (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
    return t, q, meters(p, q)


def node(i, lat, lon, **tags):
    return ("node", i, 1000 + i, {k.replace("__", ":"): v for k, v in tags.items()}, lat, lon, None, None, None)


def way(i, ids, at, **tags):
    return ("way", i, i, {"highway": "footway", **{k.replace("__", ":"): v for k, v in tags.items()}}, None, None, ids, [dict(lat=a, lon=b) for a, b in at], None)


def test_network_of_hand_made_elements(spark):
    """Ways that cross without a node, one-way, walls and gates, signals, steps."""
    y, x = 36.0, 129.3
    p = lambda r, c: (y + r * 0.001, x + c * 0.001)
    rows = [
        way(1, [1, 2, 3], [p(0, 0), p(0, 1), p(0, 2)], surface="asphalt", lit="yes", width="3 m", name="a"),
        way(2, [4, 5], [p(-1, 0.5), p(1, 0.5)]),  # crosses way 1, shares no node
        way(3, [3, 6], [p(0, 2), p(1, 2)], oneway__foot="-1", highway="steps"),
        way(4, [6, 7, 8], [p(1, 2), p(1, 1), p(1, 0)]),
        way(5, [8, 1], [p(1, 0), p(0, 0)], footway="crossing"),
        way(6, [9, 10], [p(3, 0), p(3, 1)], footway="crossing", crossing__signals="no"),
        way(7, [11, 12], [p(5, 0), p(5, 1)], footway="crossing", crossing="traffic_signals"),
        way(8, [13, 14], [p(7, 0), p(7, 0.0000001)]),
        way(9, [15, 16], [p(9, 0), p(9, 1)], access="private"),
        way(10, [17, 18], [p(11, 0), p(11, 1)], highway="primary"),
        way(11, [19, 20], [p(11.2, 0), p(11.2, 1)], highway="path", motorcar="yes", bridge="yes"),
        node(2, *p(0, 1), barrier="gate", foot="yes"),
        node(7, *p(1, 1), barrier="wall", foot="yes"),
        node(50, y + 0.0005 + 27 / 111320, x, highway="traffic_signals"),
        node(51, *p(3, 0), highway="traffic_signals"),
        node(60, y + 0.0002, x + 0.0005, shop="convenience"),
        node(61, y + 0.0002, x + 0.0005, amenity="drinking_water", access="no"),
    ]
    net = network.build(spark.createDataFrame(rows, streets.ELEMENTS))
    edges = {r.physical_id: r for r in net.edges.collect()}
    assert set(edges) == {"1:1:2", "1:2:3", "2:4:5", "3:3:6", "5:8:1", "6:9:10", "7:11:12", "11:19:20"}
    assert {k: r.signal for k, r in edges.items() if r.crossing} == {"5:8:1": "nearby", "6:9:10": "none", "7:11:12": "tagged"}
    assert edges["11:19:20"].boulevard and edges["11:19:20"].motor_allowed and edges["11:19:20"].bridge and not edges["1:1:2"].boulevard
    assert edges["1:1:2"].n_pois == 1 and edges["1:1:2"].width == 3.0 and edges["3:3:6"].direction == -1
    arcs = {(r.profile, r.u, r.v): (r.cost, r.length) for r in network.arcs(net, ["distance", "balanced", "flow", "supply"]).collect()}
    assert ("distance", 6, 3) in arcs and ("distance", 3, 6) not in arcs
    cost, length = arcs["balanced", 1, 2]
    assert cost == pytest.approx(length / 1.8) and arcs["supply", 1, 2][0] == pytest.approx(length / 2.1) and arcs["flow", 8, 1][0] == pytest.approx(arcs["flow", 8, 1][1] + 300)
    assert network.build(spark.createDataFrame(rows, streets.ELEMENTS), (y - 0.0001, x - 0.0001, y + 0.0001, x + 0.0011)).edges.count() == 1
    assert network.stats(network.build(spark.createDataFrame([], streets.ELEMENTS))).first().n_edges == 0


def test_starts(spark):
    at = [way(1, [1, 2], [(36.0, 129.3), (36.0, 129.302)]), way(2, [2, 3], [(36.0, 129.302), (36.002, 129.302)], highway="steps")]
    net = network.build(spark.createDataFrame(at, streets.ELEMENTS))
    m = 1 / 111320
    asked = [(1, 36.0, 129.301), (2, 36.0, 129.29995), (3, 36.0 + 99 * m, 129.301), (4, 36.0 + 101 * m, 129.301), (5, None, 1.0), (6, 36.0015, 129.302)]
    got = {r.request_id: r for r in explore.starts(spark.createDataFrame(asked, "request_id long, lat double, lon double"), net).collect()}
    assert [got[i].state for i in range(1, 7)] == ["ok", "ok", "ok", "far", "invalid", "far"]
    assert got[1].node == -2 and got[1].t == pytest.approx(0.5) and got[2].node == 1 and got[2].edge_id is None and got[2].offset_m == pytest.approx(meters((36, 129.29995), (36, 129.3)))


def tree(adj, start, most, avoid, penalty=1.0, dear=()):
    """Settled labels (cost, edge, from node, length); ties as in the operator."""
    best, done, heap = {start: (0.0, -1, -1, 0.0)}, set(), [(0.0, -1, -1, 0.0, start)]
    while heap:
        cost, e, f, m, u = heapq.heappop(heap)
        if u in done or best[u] != (cost, e, f, m):
            continue
        done.add(u)
        for v, edge, length, c, steps in adj.get(u, []):
            if m + length > most or avoid and steps or v == start:
                continue
            label = (cost + c * (penalty if edge in dear else 1.0), edge, u, m + length)
            if v not in best or label < best[v]:
                best[v] = label
                heapq.heappush(heap, (*label, v))
    return best


def way_to(best, start, target):
    out, u = [], target
    while u != start:
        _, e, f, _ = best[u]
        out.append((e, f, u))
        u = f
    return out[::-1]


@pytest.mark.parametrize("block, trees", [(2500.0, 256), (450.0, 40)])
def test_candidates_equal_a_plain_search(spark, monkeypatch, block, trees):
    """In one block, and across many blocks that several tasks settle."""
    monkeypatch.setattr(paths, "BLOCK", block)
    monkeypatch.setattr(paths, "TREES", trees)
    monkeypatch.setattr(paths, "LABELS", 3000 if trees == 40 else 100_000)
    net = network.build(streets.elements(spark, SF))
    asked = [(1, 36.0004, 129.3031, 1000.0, True), (2, 36.0011, 129.3043, 1200.0, False), (3, 36.5, 129.3, 1000.0, True), (4, 36.0, 129.3, 500.0, True)]
    requests = spark.createDataFrame(asked, "request_id long, lat double, lon double, distance double, avoid_steps boolean")
    arcs, _, s = explore.candidates(net, requests, ["distance", "flow"])
    got = {}
    for r in arcs.orderBy("seq").collect():
        got.setdefault((r.request_id, r.strategy, r.variant, r.place, r.kind), []).append((r.edge_id, r.from_node, r.to_node, round(r.length, 6)))
    seq = {r.node_id: (r.node_seq, (r.lat, r.lon)) for r in s.nodes.collect()}
    starts = {r.request_id: r for r in s.starts.collect()}
    want = {}
    for profile in ("distance", "flow"):
        base = network.arcs(network.Network(s.nodes, s.edges, net.pois, net.edge_pois), [profile]).collect()
        own = {r.edge_id: r.request_id for r in s.own_edges.collect()}
        extra = network.arcs(network.Network(s.nodes, s.own_edges, net.pois, net.edge_pois), [profile]).collect()
        oneway = {r.edge_id for r in s.edges.select("edge_id", "direction").union(s.own_edges.select("edge_id", "direction")).collect() if r.direction}
        for i, _, _, d, avoid in asked:
            at = starts[i]
            if at.state != "ok" or not 1000 <= d <= 12000:
                continue
            adj = {}
            for r in [*(r for r in base if r.edge_id != at.edge_id), *(r for r in extra if own[r.edge_id] == i)]:
                adj.setdefault(r.u, []).append((r.v, r.edge_id, r.length, r.cost, r.steps))
            length = {(u, e): m for u, es in adj.items() for _, e, m, _, _ in es}
            out = tree(adj, at.node, d * 1.2 * 0.7, avoid)
            for variant in range(2):
                buckets = {}
                for v, (_, _, _, m) in out.items():
                    if v in seq and m >= d * 0.17:
                        q = seq[v][1]
                        a = math.atan2((q[1] - at.start_lon) * math.cos(math.radians(at.start_lat)), q[0] - at.start_lat) + 2 * math.pi + variant % 4 * (math.pi / 32)
                        buckets.setdefault(math.floor(a / (2 * math.pi) * 16) % 16, []).append(v)
                targets = list(dict.fromkeys(min(buckets[k], key=lambda v, x=x: (abs(out[v][3] - d * x), seq[v][0])) for k in sorted(buckets) for x in (0.24, 0.34, 0.43, 0.53, 0.66)))
                for place, t in enumerate(targets, 1):
                    there = way_to(out, at.node, t)
                    for kind, total in enumerate((d * 0.8, d * 1.0, d * 1.2)):
                        left, half = total / 2, []
                        if out[t][3] < total / 2:
                            continue
                        for e, f, u in there:
                            if left <= 0.001 or half is None:
                                break
                            half = None if e in oneway else [*half, (e, f, u, min(left, length[f, e]))]
                            left -= length[f, e] if left > length[f, e] else left
                        if half and left <= 0.1:
                            want[i, profile, variant, place, kind] = [(e, f, u, round(m, 6)) for e, f, u, m in half] + [(e, u, f, round(m, 6)) for e, f, u, m in reversed(half)]
                    dear = {e for e, _, _ in there}
                    for kind, penalty in ((3, 2.5), (4, 8.0)):
                        back = tree(adj, t, d * 1.2 - out[t][3], avoid, penalty, dear)
                        if at.node in back:
                            want[i, profile, variant, place, kind] = [(e, f, u, round(length[f, e], 6)) for e, f, u in there + way_to(back, t, at.node)]
    assert want and got == want and {k[0] for k in got} == {1, 2}


def test_explored_routes_keep_the_promises(spark):
    net = network.build(streets.elements(spark, SF))
    requests = spark.createDataFrame([(1, 36.0004, 129.3031, 1000.0, True)], "request_id long, lat double, lon double, distance double, avoid_steps boolean")
    x = explore.explored(net, requests, ["balanced", "supply"])
    rows = x.routes.orderBy("route_id").collect()
    assert rows and explore.broken(x.routes).first().n_broken == 0 and [r.candidate for r in rows] == [f"candidate-{i + 1:04d}" for i in range(len(rows))]
    assert len({r.signature for r in rows}) == len(rows) and sum(r.n_searches for r in rows) == x.searches.count() == sum(r.unique for r in x.batches.collect())
    found = {(r.route_id, r.poi_id): r.hits for r in evaluate.facilities(x.segments, x.streets.edge_pois).collect()}
    pois = {r.poi_id: (r.poi_lat, r.poi_lon) for r in x.streets.edge_pois.collect()}
    known = Counter((r.edge_id, r.poi_id) for r in x.streets.edge_pois.collect())
    want, gaps, usage = {}, {}, {}
    for r in x.segments.orderBy("route_id", "seq").collect():
        for p, at in pois.items():
            if (r.edge_id, p) in known:
                t, _, far = project(at, (r.lat1, r.lon1), (r.lat2, r.lon2))
                if far <= 50:
                    hits = want.setdefault((r.route_id, p), [])
                    if not hits or r.at + t * r.length - hits[-1] > 100:
                        hits.append(r.at + t * r.length)
        usage.setdefault(r.route_id, {}).setdefault(r.edge_id, []).append(r.length)
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)
    for r in evaluate.supply(x.routes, evaluate.facilities(x.segments, x.streets.edge_pois)).collect():
        total = sum(map(sum, usage[r.route_id].values()))
        at = sorted([0.0, total, *(h for (i, _), hits in want.items() if i == r.route_id for h in hits)])
        gaps[r.route_id] = r.max_gap_m
        assert r.max_gap_m == pytest.approx(max(b - a for a, b in zip(at, at[1:], strict=False)))
    for r in evaluate.measured(x.segments).collect():
        parts = usage[r.route_id].values()
        assert r.repeat_ratio == pytest.approx(sum(sum(p) - max(p) for p in parts) / sum(map(sum, parts)))


def linkage(ids, sim, mean=0.65, floor=0.5):
    groups = {i: [i] for i in ids}
    s = lambda a, b: sim.get((min(a, b), max(a, b)), 0.0)
    while True:
        best = None
        for a in sorted(groups):
            for b in sorted(groups):
                if a < b:
                    v = [s(x, y) for x in groups[a] for y in groups[b]]
                    m = sum(v) / len(v)
                    if m + 1e-9 >= mean and min(v) + 1e-9 >= floor and (best is None or m > best[0]):
                        best = m, a, b
        if not best:
            return {x: g for g, members in groups.items() for x in members}
        groups[best[1]] += groups.pop(best[2])


@pytest.mark.parametrize("seed", range(3))
def test_families_equal_plain_average_linkage(spark, seed):
    import random

    chance = random.Random(seed)
    ids = list(range(24))
    sim = {(a, b): round(1.0 - min(1.0, abs(chance.gauss(0, 0.25)) + (0.1 if a % 4 != b % 4 else 0)), 6) for a in ids for b in ids if a < b and chance.random() < 0.8}
    sim |= {(0, 1): 0.8, (1, 2): 0.8, (0, 2): 0.4}
    pairs = spark.createDataFrame([(1, a, b, v) for (a, b), v in sim.items()], "request_id int, a long, b long, dice double")
    members, stats = families.clusters(spark.createDataFrame([(1, i) for i in ids], "request_id int, route_id long"), pairs)
    got = {r.route_id: r.cluster for r in members.collect()}
    assert got == linkage(ids, sim)
    for r in stats.collect():
        inside = [i for i in ids if got[i] == r.cluster]
        v = [sim[a, b] for a in inside for b in inside if a < b]
        assert r.n_pairs == len(v) and r.mean_similarity == pytest.approx(sum(v) / len(v) if v else 1) and r.min_similarity == (min(v) if v else 1.0)
    with pytest.raises(ValueError):
        families.clusters(members.select("request_id", "route_id"), spark.createDataFrame([(1, 1, 2, 1.5)], pairs.schema))


def test_representatives(spark):
    """A contained route that falls a little short wins if the rest adds stairs."""
    members = spark.createDataFrame([(1, 10, 1), (1, 10, 2), (1, 10, 3), (1, 20, 4)], "request_id int, cluster long, route_id long")
    scores = spark.createDataFrame([(1, 950.0, 5.0, 0.05), (2, 1000.0, 9.0, 0.0), (3, 900.0, 8.0, 0.1), (4, 1000.0, 1.0, 0.0)], "route_id long, length double, final_score double, error double")
    pairs = spark.createDataFrame([(1, 2, 950.0, 950.0, 1000.0)], "a long, b long, shared_m double, total_a double, total_b double")
    for stairs, lead in ((100.0, 3), (0.0, 2)):
        burden = spark.createDataFrame([(i, 0.0, stairs if i == 2 else 0.0, 0.0, 0.0, 0) for i in range(1, 5)], "route_id long, crossing_m double, steps_m double, unpaved_m double, unlit_m double, n_crossings int")
        decided = families.completions_decided(members, scores, pairs, burden, 1000.0)
        assert [(r.winner, r.loser, r.added) for r in decided.collect()] == [(1, 2, ["steps"]) if stairs else (2, 1, [])]
        ranked = families.representatives(members, scores, decided)
        assert {r.cluster: r.route_id for r in ranked.where("place = 1").collect()} == {10: lead, 20: 4} and ranked.count() == 4
        assert {r.route_id for r in families.variants(ranked, pairs).collect()} == {1, 2, 3} - {lead}


@pytest.mark.parametrize("shape", ["mixed", "loop", "outback"])
def test_short_lists_differ(spark, shape):
    rows = [(1, i, i, ("loop", "partial", "outback")[k], 0.01 * (9 - i)) for i, k in enumerate([1, 1, 0, 2, 2, 0, 1], 1)]
    close = {(1, 2), (3, 6), (4, 5)}
    df = spark.createDataFrame(rows, "request_id int, route_id long, rank int, shape string, repeat_ratio double")
    over = spark.createDataFrame([(1, a, b, 0.8) for a, b in close] + [(1, 1, 3, 0.7)], "request_id int, a long, b long, overlap double")
    got = [r.route_id for r in families.selected(df, over, shape).orderBy("place").collect()]
    picked = []

    def add(i):
        ok = len(picked) < 3 and i not in picked and not any((min(i, j), max(i, j)) in close for j in picked)
        picked.extend([i] if ok else [])
        return ok

    of = {i: s for _, i, _, s, _ in rows}
    ids = sorted(of)
    if shape == "mixed":
        add(1)
        for s in ("loop", "partial", "outback"):
            if not any(of[i] == s for i in picked):
                any(add(i) for i in ids if of[i] == s)
        [add(i) for i in ids]
    else:
        for s in ("loop", "partial", "outback") if shape == "loop" else ("outback", "partial", "loop"):
            group = [i for i in ids if of[i] == s]
            [add(i) for i in (sorted(group, key=lambda i: 9 - i) if shape == "loop" and s == "partial" else group)]
    assert got == picked


def test_profile_ranks(spark):
    df = spark.createDataFrame([(1, 1, 2, 0, 0, 9.0, 0.1, 5.0), (1, 2, 1, 3, 2, 5.0, 0.0, 5.0), (1, 3, 1, 1, 0, 5.0 + 1e-10, 0.1, 5.0)], "request_id int, route_id int, n_crossings int, shops int, water int, bonus double, error double, length double")
    order = lambda p: [r.route_id for r in families.ranked(df, p).orderBy("rank").collect()]
    assert order("balanced") == [1, 2, 3] and order("flow") == [2, 3, 1] and order("supply") == [2, 3, 1]


def corners(spark, limit=60):
    out = {}
    for r in routes.points(spark, SF).where(f"route_id < {limit}").orderBy("route_id", "i").collect():
        out.setdefault(r.route_id, []).append(r)
    return out


def along(ds, pts, at):
    i = 1
    while i < len(ds) - 1 and ds[i] < at:
        i += 1
    f = max(0, min(1, (at - ds[i - 1]) / (ds[i] - ds[i - 1] or 1)))
    return tuple(pts[i - 1][k] + (pts[i][k] - pts[i - 1][k]) * f for k in (0, 1))


def test_guides_equal_a_plain_walk(spark):
    bearing = lambda a, b: (math.degrees(math.atan2((b[1] - a[1]) * math.cos(math.radians(a[0])), b[0] - a[0])) + 360) % 360
    want = {}
    for route, rows in corners(spark).items():
        pts, ds = [(r.lat, r.lon) for r in rows], [0.0]
        for a, b in zip(pts, pts[1:], strict=False):
            ds.append(ds[-1] + meters(a, b))
        n = len(pts)
        back = n % 2 == 1 and all(meters(p, pts[n - 1 - i]) < 0.5 for i, p in enumerate(pts))
        end, last = (n - 1) // 2 if back else n - 1, 0.0
        said = [(0.0, "start")]
        for i in range(1, end):
            at = ds[i]
            if at < 12 or ds[end] - at < 12:
                continue
            turn = (bearing(pts[i], along(ds, pts, min(ds[end], at + 12))) - bearing(along(ds, pts, max(0, at - 12)), pts[i]) + 540) % 360 - 180
            here, ahead = rows[i], rows[i + 1]
            enters, named = ahead.crossing and not here.crossing, bool(ahead.name) and ahead.name != here.name
            bend = abs(turn) >= 50 and at - last >= 18
            if enters or named or bend or at - last >= 500:
                said.append((at, "crossing" if enters else ("turn" if abs(turn) > 145 else "right" if turn > 0 else "left") if bend else "continue"))
                last = at
        want[route] = said + ([(ds[end], "turnaround")] if back else []) + [(ds[-1], "finish")]
    got = {}
    for r in guide.guides(routes.points(spark, SF).where("route_id < 60")).orderBy("route_id", "step").collect():
        got.setdefault(r.route_id, []).append((r.at, r.kind, r.next_m))
    assert got.keys() == want.keys()
    for k, said in want.items():
        assert [x[1] for x in got[k]] == [x[1] for x in said] and [x[0] for x in got[k]] == pytest.approx([x[0] for x in said])
        assert [x[2] for x in got[k]] == pytest.approx([b[0] - a[0] for a, b in zip(said, said[1:], strict=False)] + [0.0])


def test_profiles_and_colours_equal_plain_ones(spark):
    x0, y0, width, height = tiles.terrain_window((35.9, 129.2, 36.1, 129.4))
    value = lambda x, y: None if (x + y) % 11 == 0 else (x * 3.0 + y * 5.0) % 40
    grid = spark.createDataFrame([(x, y, value(x, y)) for x in range(width) for y in range(height)], "ix long, iy long, value double")
    points = routes.points(spark, SF).where("route_id < 60")
    samples, _ = store.written(elevation.profile(points, grid, 12, x0, y0), "profile")
    got, stretches = {}, {}
    for r in samples.orderBy("route_id", "i").collect():
        got.setdefault(r.route_id, []).append((r.at, r.elevation))
    for r in guide.colored_segments(points, samples).orderBy("route_id", "at").collect():
        stretches.setdefault(r.route_id, []).append(r)
    size = 256 * 2**12
    for route, rows in corners(spark).items():
        pts, ds = [(r.lat, r.lon) for r in rows], [0.0]
        for a, b in zip(pts, pts[1:], strict=False):
            ds.append(ds[-1] + meters(a, b))
        total, at = ds[-1], []
        while len(at) * 50 < total - 1:
            at.append(len(at) * 50.0)
        at = (at[:-1] if len(at) > 1 and total - at[-1] < 25 else at) + [total]
        shut = [bool(r.bridge or r.tunnel) for r in rows[1:]]
        raw = []
        for m in at:
            j = next((i for i in range(1, len(ds)) if ds[i] >= m), len(ds) - 1)
            y, x = along(ds, pts, m)
            px = (x + 180) / 360 * size - 0.5 - x0
            py = (1 - math.asinh(math.tan(math.radians(y))) / math.pi) / 2 * size - 0.5 - y0
            ix, iy = math.floor(px), math.floor(py)
            four = [value(ix + a, iy + b) for b in (0, 1) for a in (0, 1)]
            fx, fy = px - ix, py - iy
            raw.append(None if shut[j - 1] or None in four else (four[0] * (1 - fx) + four[1] * fx) * (1 - fy) + (four[2] * (1 - fx) + four[3] * fx) * fy)
        gap = [False] * len(at)
        for i in range(1, len(at)):
            if any(s and ds[k + 1] > at[i - 1] and ds[k] < at[i] for k, s in enumerate(shut)):
                gap[i - 1] = gap[i] = True
        raw = [None if g else v for v, g in zip(raw, gap, strict=True)]
        smooth = [None if v is None else math.floor((sum(raw[i - 1 : i + 2]) / 3 if 0 < i < len(raw) - 1 and None not in raw[i - 1 : i + 2] else v) * 10 + 0.5) / 10 for i, v in enumerate(raw)]
        assert [a for a, _ in got[route]] == pytest.approx(at) and [e for _, e in got[route]] == smooth
        ways = {}
        key = lambda p: tuple(math.floor(c * 1e6 + 0.5) for c in p)
        for a, b in zip(pts, pts[1:], strict=False):
            ways.setdefault(frozenset((key(a), key(b))), set()).add((key(a), key(b)))
        for r, i in zip(stretches[route], range(1, len(at)), strict=True):
            on = [k for k in range(len(shut)) if ds[k + 1] > at[i - 1] and ds[k] < at[i]]
            bad = None in smooth[i - 1 : i + 1] or any(shut[k] for k in on)
            assert r.unknown == bad and (r.color == guide.UNKNOWN_COLOR) == bad and r.offset == any(len(ways[frozenset((key(pts[k]), key(pts[k + 1])))]) > 1 for k in on)
            assert r.corners == 2 + sum(at[i - 1] + 0.001 < m < at[i] - 0.001 for m in ds)
    state = {r.route_id: r for r in elevation.summaries(samples, "route_id").collect()}
    for route, s in got.items():
        known = [e for _, e in s if e is not None]
        assert state[route].state == ("unknown" if not known else "estimated" if len(known) == len(s) else "partial") and (state[route].ascent is None) == (len(known) < len(s))


def test_colours(spark):
    rows = [(None, 1.0, "#8d929b"), (3.0, 1.0, "#899297"), (12.0, 1.0, "rgb(174,44,54)"), (-30.0, 1.0, "rgb(35,94,163)"), (7.5, 1.0, "rgb(201,105,110)"), (1.0, None, "#8d929b")]
    df = spark.createDataFrame(rows, "grade double, e double, want string")
    assert all(r.got == r.want for r in df.select("want", guide.segment_color("B", F.col("e"), F.col("grade"), F.lit(0.0), F.lit(10.0)).alias("got")).collect())
    a = df.limit(2).select(guide.segment_color("A", F.lit(5.0), F.lit(0.0), F.lit(0.0), F.lit(10.0)).alias("c")).first().c
    assert a == "rgb(198,88,105)"


def test_facilities_once(spark):
    rows = [(1, "water", "w", 36.0, 129.0, 1), (1, "water", "w", 36.1, 129.0, 2), (1, "shop", None, 36.0, 129.0, 3), (1, "shop", None, 36.0000001, 129.0, 4), (1, "shop", "s", None, 129.0, 5)]
    df = spark.createDataFrame(rows, "route_id int, kind string, poi_id string, lat double, lon double, n int")
    assert sorted(r.n for r in guide.distinct_facilities(df).collect()) == [1, 3]


def test_merged_places_keep_the_order(spark):
    local = [(1, 0, "A-b", 36.0, 129.0), (1, 1, "c", 36.0, 129.0)]
    online = [(1, 0, "ab", 36.0005, 129.0, False), (1, 1, "ＡＢ", 36.002, 129.0, True), (1, 2, "a.b", 36.0025, 129.0, False), (1, 3, "a b", 36.0032, 129.0, False)]
    got = places.merged(spark.createDataFrame(local, "query_id int, n int, name string, lat double, lon double"), spark.createDataFrame(online, "query_id int, n int, name string, lat double, lon double, outside boolean"))
    # The second stays, so the third is too near to it; the fourth isn't.
    assert [r.name for r in got.orderBy("place").collect()] == ["A-b", "c", "a b", "ＡＢ"]


def test_answers_that_cannot_be_read_raise(spark):
    with pytest.raises(Exception, match="no features"):
        places.parsed_answers(spark.createDataFrame([(1, "{}")], "query_id int, body string"), None).collect()


def test_decoded_ways(spark):
    bad = "type string, id long, ordinal long, tags map<string,string>, lat double, lon double, refs array<long>, coords array<long>, bounds struct<minlat:double,minlon:double,maxlat:double,maxlon:double>"
    one = ("way", 1, 1, {}, None, None, [12345678901, -1, 55], [375432101, 1270332101, 13, -52, -20, 45], None)
    r = tiles.decoded(spark.createDataFrame([one], bad)).first()
    assert r.nodes == [12345678901, 12345678900, 12345678955] and [(p.lat, p.lon) for p in r.geometry] == [(37.5432101, 127.0332101), (37.5432114, 127.0332049), (37.5432094, 127.0332094)]
    assert tuple(r.bounds) == (37.5432094, 127.0332049, 37.5432114, 127.0332101)
    packed = tiles.packed(tiles.decoded(spark.createDataFrame([one], bad))).first()
    assert (packed.refs, packed.coords) == (one[6], one[7])
    for refs, coords in (([1, 2], [1, 2, 3]), ([1 << 60], [1, 2]), (None, [1, 2])):
        with pytest.raises(Exception, match="coordinates|large"):
            tiles.decoded(spark.createDataFrame([("way", 1, 1, {}, None, None, refs, coords, None)], bad)).collect()


def test_packs_are_published_whole(spark, tmp_path):
    path = f"file://{tmp_path}/pack"
    elements = streets.elements(spark, SF)
    dirty = elements.withColumn("user", F.lit("u")).withColumn("tags", F.map_concat("tags", F.create_map(F.lit("phone"), F.lit("1"))))
    tiles.publish(dirty, path, "7")
    assert tiles.check_pack(spark, path) == tiles.manifest(spark, path).count() > 0 and tiles.manifest(spark, path).first().version == "7-public-v1"
    with pytest.raises(Exception):
        tiles.publish(elements.withColumn("ordinal", F.raise_error(F.lit("broken")).cast("long")), path, "8")
    assert tiles.manifest(spark, path).first().version == "7-public-v1" and {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")} == {"pack"}
    rows, bbox = tiles.load_region(spark, path, 36.001, 129.305, 1.0)
    assert rows.count() > 0 and tiles.valid(rows) and bbox == tiles.region_bounds(36.001, 129.305, 1.0)
    with pytest.raises(ValueError):
        tiles.load_region(spark, path, 10.0, 129.305, 1.0)
    with pytest.raises(ValueError):
        tiles.load_region(spark, path, 85.0, 129.305, 1.0)
    (tmp_path / "pack.lock").mkdir()
    with pytest.raises(RuntimeError):
        tiles.publish(elements, path, "9")
    # A changed tile no longer fits its checksum, a missing one fails the read.
    import glob
    import shutil

    folder = glob.glob(f"{tmp_path}/pack/tiles/ty=*/tx=*")[0]
    shutil.rmtree(folder)
    with pytest.raises(ValueError):
        tiles.check_pack(spark, path)


def test_scope_keeps_tiles_near_the_polygons(spark):
    square = [(36.0, 129.0), (36.0, 130.0), (37.0, 130.0), (37.0, 129.0)]
    sides = [(0, 0, False, *a, *b) for a, b in zip(square, square[1:] + square[:1], strict=True)]
    rings = spark.createDataFrame(sides, "poly_id long, ring int, hole boolean, lat1 double, lon1 double, lat2 double, lon2 double")
    rows = [(730, 2590), (719, 2590), (716, 2590), (717, 2577), (730, 2570), (765, 2590)]
    got = {(r.ty, r.tx) for r in tiles.in_scope(spark.createDataFrame(rows, "ty long, tx long"), rings).collect()}
    inside = lambda y, x: y * 0.05 - 0.1 <= 37 and (y + 1) * 0.05 + 0.1 >= 36 and x * 0.05 - 0.13 <= 130 and (x + 1) * 0.05 + 0.13 >= 129
    assert got == {(y, x) for y, x in rows if inside(y, x)}


def test_a_json_extract_is_read_in_its_order(spark, tmp_path):
    import json

    body = {"raw": {"elements": [{"type": "way", "id": 5, "tags": {"highway": "path"}, "nodes": [1, 12345678901], "geometry": [{"lat": 1.5, "lon": 2.5}, None]}, {"type": "node", "id": 1, "lat": 1.5, "lon": 2.5}]}}
    (tmp_path / "map.json").write_text(json.dumps(body))
    rows = tiles.read_sample(spark, f"file://{tmp_path}/map.json").orderBy("ordinal").collect()
    assert [(r.type, r.id, r.ordinal) for r in rows] == [("way", 5, 0), ("node", 1, 1)] and rows[0].nodes == [1, 12345678901] and rows[0].geometry[1] is None


def test_bounds_need_a_closed_route(spark):
    df = spark.createDataFrame([(1, 0.2, 0.0), (2, 0.2001, 0.0), (3, 0.0, 0.2), (4, 0.0, None)], "route_id int, error double, closure_m double")
    assert [r.route_id for r in ranking.within_bounds(df).collect()] == [1]


def test_paths_of_trees(spark):
    arcs = spark.createDataFrame([("p", 1, 2, 10, 1.0, 1.0, False), ("p", 2, 3, 11, 1.0, 1.0, False), ("p", 1, 3, 12, 5.0, 1.5, False), ("p", 3, 4, 13, 1.0, 1.0, True)], "profile string, u long, v long, edge_id long, length double, cost double, steps boolean")
    trees = spark.createDataFrame([(1, 1, "p", 9.0, False), (2, 1, "p", 4.0, True)], "tree_id long, start long, profile string, max_length double, avoid_steps boolean")
    labels, _ = paths.shortest_trees(arcs, trees)
    got = {(r.tree_id, r.node): (r.cost, r.length, r.edge_id) for r in labels.collect()}
    assert got == {(1, 1): (0.0, 0.0, None), (1, 2): (1.0, 1.0, 10), (1, 3): (1.5, 5.0, 12), (1, 4): (2.5, 6.0, 13), (2, 1): (0.0, 0.0, None), (2, 2): (1.0, 1.0, 10), (2, 3): (2.0, 2.0, 11)}
    ends = spark.createDataFrame([(1, 4), (2, 3), (2, 4), (1, 1)], "tree_id long, target long")
    found, _ = paths.paths(labels, ends)
    assert {(r.tree_id, r.target, r.back, r.edge_id) for r in found.collect()} == {(1, 4, 0, 13), (1, 4, 1, 12), (2, 3, 0, 11), (2, 3, 1, 10)}


def test_long_paths_take_few_rounds(spark, monkeypatch):
    """A way of 1,000 arcs through five blocks, with a dear bridge across each."""
    nodes = spark.createDataFrame([(i, 36.0 + i * 10 / 111_320, 129.3) for i in range(1001)], "node_id long, lat double, lon double")
    hops = [(i, i + 1, i, 10.0, 10.0) for i in range(1000)] + [(i, i + 20, 5000 + i, 190.0, 500.0) for i in range(0, 980, 20)]
    arcs = spark.createDataFrame([("p", u, v, e, m, c, False) for a, b, e, m, c in hops for u, v in ((a, b), (b, a))], "profile string, u long, v long, edge_id long, length double, cost double, steps boolean")
    trees = spark.createDataFrame([(1, 0, "p", 20_000.0, 1.0, [], None, []), (2, 1000, "p", 20_000.0, 3.0, list(range(1000)), 0, []), (3, 0, "p", 9_600.0, 1.0, [], None, [7])], "tree_id long, start long, profile string, max_length double, penalty double, penalized array<long>, goal long, banned array<long>")
    rounds, written = [], store.written
    monkeypatch.setattr(store, "written", lambda df, name, **k: rounds.append(name) or written(df, name, **k))
    labels, _ = paths.shortest_trees(arcs, trees, None, paths.blocks(nodes))
    found, _ = paths.paths(labels, spark.createDataFrame([(1, 1000), (2, 0), (3, 1000)], "tree_id long, target long"))
    assert rounds.count("block-labels") <= 8 and rounds.count("path-arcs") <= 8
    got = {}
    for r in found.collect():
        got.setdefault(r.tree_id, []).append((r.back, r.edge_id, r.u, r.v))
    assert sorted(got[1]) == [(999 - i, i, i, i + 1) for i in range(999, -1, -1)]
    # The way back pays thrice on the plain arcs, and so takes the bridges.
    assert [e for _, e, _, _ in sorted(got[2])][:2] == [5000, 5020] and len(got[2]) == 69
    # Without arc 7 the first bridge; what it costs in length leaves the end out of reach or not.
    assert [e for _, e, _, _ in sorted(got.get(3, []))][-1:] in ([5000], [])
    reach = {r.node: (r.cost, r.length) for r in labels.where("tree_id = 3").collect()}
    want = tree({u: [(v, e, m, c, False) for a, b, e, m, c in hops for u2, v in ((a, b), (b, a)) if u2 == u and e != 7] for u in range(1001)}, 0, 9_600.0, False)
    assert reach == {v: (c, m) for v, (c, _, _, m) in want.items()}


def test_added_burden(spark):
    keys = "route_id long, crossing_m double, steps_m double, unpaved_m double, unlit_m double, n_crossings int"
    burden = spark.createDataFrame([(1, 5.0, 0.0, 10.0, 0.0, 1), (2, 5.0, 0.05, 10.2, 0.0, 2)], keys)
    pairs = spark.createDataFrame([(1, 2), (2, 1)], "shorter long, longer long")
    assert {(r.shorter, tuple(r.added)) for r in sequence.added_burden(pairs, burden).collect()} == {(1, ("crossing", "unpaved")), (2, ())}


def test_short_routes_are_completed(spark):
    """A loop of 976 m with three dead ends: paved, unlit, and across a crossing."""
    y, x = 36.0, 129.3
    p = lambda r, c: (y + r * 0.001, x + c * 0.001)
    good = {"surface": "asphalt", "lit": "yes"}
    rows = [
        way(1, [1, 2, 3, 4, 1], [p(0, 0), p(0, 2.71), p(2.19, 2.71), p(2.19, 0), p(0, 0)]),
        way(2, [2, 5], [p(0, 2.71), p(0, 3.4)], **good),
        way(3, [3, 6], [p(2.19, 2.71), p(2.19, 3.4)], lit="no"),
        way(4, [4, 7], [p(2.19, 0), p(2.19, -0.5)], footway="crossing"),
        way(5, [1, 8], [p(0, 0), p(-0.5, 0)]),
    ]
    net = network.build(spark.createDataFrame(rows, streets.ELEMENTS))
    requests = spark.createDataFrame([(1, *p(0, 0), 1000.0, False)], "request_id long, lat double, lon double, distance double, avoid_steps boolean")
    s = explore.streets(net, requests)
    arcs = s.edges.where("way_id = 1").select(F.lit(7).cast("long").alias("route_id"), F.lit(1).cast("long").alias("request_id"), F.col("edge_id").alias("seq"), "edge_id", F.col("u").alias("from_node"), F.col("v").alias("to_node"), "length", "lat1", "lon1", "lat2", "lon2")
    length = arcs.agg(F.sum("length")).first()[0]
    routes_ = spark.createDataFrame([(7, 1, length, 1000.0), (8, 1, 1000.0, 1000.0)], "route_id long, request_id long, length double, distance double")
    ex = explore.explored(net, requests, ["distance"], variants=1)
    found = {r.route_id: r for r in ex.routes.collect()}
    made = ex.completions.collect()
    assert made and all(r.route_id in found and found[r.route_id].length == pytest.approx(1000) and 950 <= found[r.parent].length < 991 for r in made)
    assert all(found[r.parent].candidate < found[r.route_id].candidate and r.added_m == pytest.approx(1000 - found[r.parent].length) for r in made)
    short = [r for r in found.values() if 950 <= r.length <= 990]
    assert short and {r.route_id for r in short} <= {r.parent for r in made}
    plain = explore.explored(net, requests, ["distance"], variants=1, complete=False)
    assert {r.signature for r in plain.routes.collect()} == {r.signature for r in found.values()} - {found[r.route_id].signature for r in made}
    proposals, whole = completions.completed(arcs, routes_, s, net)
    got = proposals.orderBy("place").collect()
    assert 950 <= length <= 990 and [(r.route_id, r.place, r.anchors) for r in got] == [(7, 1, 2), (7, 2, 2)]
    assert got[0].at_m == pytest.approx(meters(p(0, 0), p(0, 2.71))) and got[1].at_m == 0 and got[0].added_m == pytest.approx(1000 - length)
    for place in (1, 2):
        part = whole.where(f"place = {place}").orderBy("seq").collect()
        assert sum(r.length for r in part) == pytest.approx(1000) and all(meters((a.lat2, a.lon2), (b.lat1, b.lon1)) < 0.01 for a, b in zip(part, part[1:], strict=False))
        assert (part[0].lat1, part[0].lon1) == (part[-1].lat2, part[-1].lon2) and len(part) == 6
    old = spark.createDataFrame([("r", 1.0, "m", 1), ("r", 2.0, "m", 1)], "parent string, at_m double, method string, v int")
    assert sorted((r.at_m, r.v) for r in completions.merged_completions(old, old.where("at_m = 1").withColumn("v", F.lit(2))).collect()) == [(1.0, 2), (2.0, 1)]
