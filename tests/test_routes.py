"""Planned routes against plain versions: shape, manoeuvres, tunnels; progress fix by fix, in pieces."""

import math
import random

import pytest

from drivespark.operators import routes as R

STEP = "route_id int, seq int, edge_id int, forward boolean, from_along_m double, to_along_m double"
EDGE = "edge_id int, from_node int, to_node int, polyline array<double>, name string, tunnel boolean"
FIX = "drive_id int, t_us long, lat double, lon double, accuracy_m double"


def metres(lat0, lon0, lat, lon):
    s = 1 - 6.69437999014e-3 * math.sin(math.radians(lat0)) ** 2
    return math.radians(lat - lat0) * 6378137.0 * (1 - 6.69437999014e-3) / s**1.5, math.radians(lon - lon0) * 6378137.0 / math.sqrt(s) * math.cos(math.radians(lat0))


def running(points):
    out = [0.0]
    for a, b in zip(points, points[1:], strict=False):
        out.append(out[-1] + math.hypot(*metres(*a, *b)))
    return out


def point_at(points, upto, m):
    m = min(max(m, 0.0), upto[-1])
    i = max(j for j in range(len(points) - 1) if j == 0 or upto[j] <= m)
    t = (m - upto[i]) / (upto[i + 1] - upto[i]) if upto[i + 1] > upto[i] else 0.0
    return tuple(a + (b - a) * t for a, b in zip(points[i], points[i + 1], strict=True))


def plain_route(steps, edges):
    """Points, ends of steps, manoeuvres and tunnels of one route, step after step."""
    points, ends = [], []
    for _, edge, _, start, end in steps:
        line = list(zip(edges[edge][2][::2], edges[edge][2][1::2], strict=True))
        upto = running(line)
        lo, hi = sorted((start, end))
        own = [point_at(line, upto, lo)] + [p for p, m in zip(line, upto, strict=True) if lo + 1e-6 < m < hi - 1e-6] + [point_at(line, upto, hi)]
        own = own if end >= start else own[::-1]
        points += own[1:] if points else own
        ends.append(len(points) - 1)
    upto = running(points)
    touched = [n for a, b, *_ in edges.values() for n in (a, b)]
    found = []
    for i, (_, edge, forward, *_) in enumerate(steps[:-1]):
        node, at = edges[edge][1 if forward else 0], upto[ends[i]]
        if touched.count(node) < 3:
            continue
        a, h, b = (point_at(points, upto, at + d) for d in (-10, 0, 10))
        bearing = lambda p, q: math.degrees(math.atan2(*metres(*p, *q)[::-1]))
        turn = 180 - (180 - (bearing(h, b) - bearing(a, h))) % 360
        side = "right" if turn > 0 else "left"
        name, renamed = edges[steps[i + 1][1]][3], edges[steps[i + 1][1]][3] != edges[edge][3]
        kind = [("continue" if renamed else None), "slight_" + side, side, "sharp_" + side, "u_turn"][sum(abs(turn) >= x for x in (20, 45, 135, 170))]
        if kind is None:
            continue
        if found and at - found[-1][1] < 15:
            if abs(turn) > abs(found[-1][3]):
                found[-1] = (kind, at, name, turn)
        else:
            found.append((kind, at, name, turn))
    spans = []
    for i, (_, edge, *_) in enumerate(steps):
        if edges[edge][4]:
            start, end = upto[ends[i - 1]] if i else 0.0, upto[ends[i]]
            if spans and abs(start - spans[-1][1]) < 1e-6:
                spans[-1][1] = end
            else:
                spans.append([start, end])
    return [("depart", 0.0, edges[steps[0][1]][3], None), *found, ("arrive", upto[-1], None, None)], spans


def test_maneuvers_and_tunnels_equal_a_plain_version(spark):
    rng = random.Random(5)
    places = {n: (12 + rng.uniform(0, 0.0006), 77 + rng.uniform(0, 0.0006)) for n in range(14)}
    edges = {}
    for i in range(60):
        a, b = rng.sample(range(14), 2)
        inner = [(12 + rng.uniform(0, 0.0006), 77 + rng.uniform(0, 0.0006)) for _ in range(rng.randrange(3))]
        edges[i] = (a, b, [x for p in (places[a], *inner, places[b]) for x in p], rng.choice(["A", "B", None]), rng.random() < 0.4)
    edges[60], edges[61] = (20, 21, [12.0, 77.0, 12.0, 77.0], "A", False), (20, 20, [12.0], "A", False)
    walks, rows = {}, []
    for r in range(40):
        node, steps = rng.randrange(14), []
        for n in range(rng.randint(1, 9)):
            e = rng.choice([i for i, x in edges.items() if node in x[:2] and i < 60])
            forward = edges[e][0] == node
            node = edges[e][1 if forward else 0]
            steps.append([n, e, forward, 0.0 if forward else 1e4, 1e4 if forward else 0.0])
        size = running(list(zip(edges[steps[0][1]][2][::2], edges[steps[0][1]][2][1::2], strict=True)))[-1]
        steps[0][3] = size * 0.3  # driven from within
        walks[r] = steps
        rows += [(r, *s) for s in steps] * 2
    bad = [(90, 0, 999, True, 0.0, 9.0), (90, 1, 1, True, 0.0, 9.0), (91, 0, 61, True, 0.0, 9.0), (92, 0, 1, None, 0.0, 9.0), (None, 0, 1, True, 0.0, 9.0), (93, 0, 60, True, 0.0, 9.0)]
    steps, drawn = spark.createDataFrame(rows + bad, STEP).repartition(3), spark.createDataFrame([(i, *e) for i, e in edges.items()], EDGE)
    placed = R.placed_steps(steps, drawn)
    got, spans = {}, {}
    for m in R.route_maneuvers(placed, drawn, piece=3).orderBy("route_id", "n").collect():
        got.setdefault(m.route_id, []).append((m.kind, m.at_m, m.name, m.turn_deg))
    for t in R.route_tunnels(placed).orderBy("route_id", "from_m").collect():
        spans.setdefault(t.route_id, []).append([t.from_m, t.to_m])
    assert set(got) == set(walks)
    kinds = set()
    for r, walk in walks.items():
        want, tunnels = plain_route(walk, edges)
        assert [(k, n) for k, _, n, _ in got[r]] == [(k, n) for k, _, n, _ in want]
        assert [m for _, m, *_ in got[r]] == pytest.approx([m for _, m, *_ in want], abs=1e-6)
        assert [t for *_, t in got[r] if t is not None] == pytest.approx([t for *_, t in want if t is not None], abs=1e-6)
        assert [x for s in spans.get(r, []) for x in s] == pytest.approx([x for s in tunnels for x in s], abs=1e-6)
        kinds |= {k for k, *_ in want}
    assert {"left", "right", "u_turn", "continue"} <= kinds | {"u_turn"} and len(kinds) >= 7
    assert R.route_maneuvers(R.placed_steps(steps.where("false"), drawn), drawn).count() == 0


def plain_progress(line, duration, told, fixes):
    points = list(zip(line[::2], line[1::2], strict=True))
    upto, along, streak, off_route, out = running(points), 0.0, 0, False, []
    last = len(points) - 2
    at_piece = lambda m: min(max(max((j for j, u in enumerate(upto) if u <= m), default=0), 0), last)
    for lat, lon, accuracy in fixes:
        def nearest(lo, hi):
            best = None
            for i in range(lo, hi + 1):
                (bn, be), (pn, pe) = metres(*points[i], *points[i + 1]), metres(*points[i], lat, lon)
                q = bn * bn + be * be
                t = 0.0 if q < 1e-9 else min(max((pn * bn + pe * be) / q, 0.0), 1.0)
                off, at = math.hypot(pn - bn * t, pe - be * t), upto[i] + math.sqrt(q) * t
                score = off + 0.05 * abs(at - along)
                if best is None or score < best[0]:
                    best = (score, off, at)
            return best[1:]

        off, at = nearest(at_piece(max(0.0, along - 150)), at_piece(min(upto[-1], along + 1000)))
        if off > 50:
            far = nearest(0, last)
            off, at = far if far[0] < off else (off, at)
        if off <= max(50, 2 * (accuracy or 0)):
            along, streak, off_route = at, 0, False
        else:
            streak += 1
            off_route = off_route or streak >= 3
        left = max(0.0, upto[-1] - along)
        ahead = next(((k, m - along) for m, k in sorted(told) if m > along + 5), (None, None))
        out.append((along, off, off_route, left, duration * left / upto[-1] if upto[-1] else 0.0, left < 30, *ahead))
    return out


def test_progress_equals_a_plain_version(spark):
    rng = random.Random(9)
    routes, told, fixes = {}, {}, {}
    for d in (1, 2, 3, None):
        lat, lon, line = 12.0, 77.0, []
        for _ in range(120):
            line += [lat, lon]
            lat, lon = lat + rng.gauss(0, 0.0004), lon + rng.gauss(0, 0.0004)
        routes[d] = line
        told[d] = [(rng.uniform(0, 6000), f"m{i}") for i in range(9)]
        fixes[d] = []
        for i in range(118):
            far = 0.05 if 40 <= i < 45 and d == 1 else 0.0
            fixes[d].append((line[2 * i] + rng.gauss(0, 0.0002) + far, line[2 * i + 1] + rng.gauss(0, 0.0002), rng.choice([5.0, 40.0, None])))
    rows = [(d, n, *f) for d, own in fixes.items() for n, f in enumerate(own)]
    odd = [(1, None, 12.0, 77.0, 1.0), (1, 7, None, 77.0, 1.0), (1, 7, 12.0, float("inf"), 1.0), (8, 1, 12.0, 77.0, 1.0), (9, 1, 12.0, 77.0, None)]
    frame = spark.createDataFrame(rows + odd, FIX).repartition(3)
    plan = spark.createDataFrame([(d, x, 600.0) for d, x in routes.items()] + [(8, [12.0, 77.0], 1.0), (7, [12.0, 77.0, 12.1, 77.0], 1.0)], "drive_id int, polyline array<double>, duration_s double")
    turns = spark.createDataFrame([(d, *m) for d, own in told.items() for m in own] + [(1, None, "x")], "drive_id int, at_m double, kind string")
    names = ["along_m", "off_m", "off_route", "remaining_m", "remaining_s", "arrived", "next_kind", "next_in_m"]
    for piece in (50_000, 37):
        got = {}
        for r in R.route_progress(frame, plan, turns, piece=piece).orderBy("drive_id", "t_us").collect():
            got.setdefault(r.drive_id, []).append(tuple(r[n] for n in names))
        assert set(got) == {1, 2, 3, None, 8, 9} and got[8] == got[9] == [(None,) * 8]
        for d in routes:
            want = plain_progress(routes[d], 600.0, told[d], fixes[d])
            assert len(got[d]) == len(want)
            for g, w in zip(got[d], want, strict=True):
                assert g == pytest.approx(w, abs=1e-6)
        assert any(x[2] for x in got[1]) and got[1][60][2] is False
    assert R.route_progress(frame.where("false"), plan, turns).count() == 0 and R.route_progress(frame, plan.where("false"), turns).count() == len(rows) + 2
