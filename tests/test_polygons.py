"""Areas out of lines, zones and regions against plain geometry."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wegloom.operators import polygons, zones
from wegloom.plans.shared import Scratch

LINES = "key int, line array<struct<x:double,y:double>>"
RINGS = "kind string, rings array<array<struct<x:double,y:double>>>"


def found(spark, lines):
    scratch = Scratch(spark)
    cut = polygons.noded(polygons.pieces(spark.createDataFrame(lines, LINES), ["key"]), ["key"])
    rings, loose = polygons.faces(cut, ["key"], scratch)
    return rings, {r["key"]: (r["n_loose"], r["n_sides"]) for r in loose.collect()}


def test_faces_of_lines(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    lines = [
        (1, square[:3]), (1, [square[0], square[3], square[2]]), (1, [(0.0, 0.0), (4.0, 4.0)]),  # a diagonal halves it
        (2, square), (2, [(2.0, -1.0), (2.0, 5.0)]),  # a line across, whose ends are loose
        (3, square), (3, [(10.0, 0.0), (14.0, 0.0), (12.0, 3.0), (10.0, 0.0)]), (3, [(4.0, 0.0), (10.0, 0.0)]),  # a bridge between two
        (4, square), (4, [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]),  # one in another
        (5, [(0.0, 0.0), (1.0, 1.0)]), (6, [(0.0, 0.0), (0.0, 0.0)]), (7, square), (7, square[::-1]), (8, [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]),
    ]
    rings, loose = found(spark, lines)
    rows = rings.collect()
    areas = {k: sorted(round(r["area"], 6) for r in rows if r["key"] == k) for k in range(1, 9)}
    assert areas == {1: [-16, 8, 8], 2: [-16, 8, 8], 3: [-16, -6, 6, 16], 4: [-16, -0.5, 0.5, 16], 5: [], 6: [], 7: [-16, 16], 8: [-8, 4, 4]}
    assert loose == {1: (0, 5), 2: (2, 9), 3: (1, 8), 4: (0, 7), 5: (1, 1), 7: (0, 4), 8: (0, 6)}
    for r in rows:
        ring = [tuple(p) for p in r["ring"]]
        assert ring[0] == ring[-1] and sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2 == pytest.approx(r["area"])
    united = {k: sorted(r["area"] for r in polygons.union(rings, ["key"]).collect() if r["key"] == k) for k in (1, 3, 4, 8)}
    assert united == {1: [16], 3: [6, 16], 4: [16], 8: [8]}


def test_long_face_in_order(spark):
    """A ring of 700 corners, in pieces of mixed order and direction."""
    n, rng = 700, random.Random(1)
    at = [(1000 * math.cos(2 * math.pi * i / n), 1000 * math.sin(2 * math.pi * i / n)) for i in range(n)]
    lines = [[at[i], at[(i + 1) % n]][:: rng.choice((1, -1))] for i in range(n)]
    rng.shuffle(lines)
    rings, _ = found(spark, [(1, x) for x in lines])
    inner = next(r for r in rings.collect() if r["area"] > 0)
    first = at.index(tuple(inner["ring"][0]))
    assert [tuple(p) for p in inner["ring"]] == [at[(first + i) % n] for i in range(n + 1)]


def test_simple_rings(spark):
    rows = [(1, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 0.0)]), (2, [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)]), (3, [(0.0, 0.0), (2.0, 0.0), (0.0, 0.0), (0.0, 0.0)]),
            (4, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 0.0), (0.0, 4.0), (0.0, 0.0)]), (5, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (3.0, 3.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]), (6, [(0.0, 0.0), (1.0, 0.0), (1.0, 0.0), (2.0, 2.0), (0.0, 0.0)])]
    assert {r["key"]: r["ok"] for r in polygons.simple(spark.createDataFrame(rows, LINES), ["key"]).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True}


# plain geometry


def distance_to_side(p, a, b):
    d = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
    f = max(0.0, min(1.0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / d)) if d else 0.0
    return math.dist(p, (a[0] + f * (b[0] - a[0]), a[1] + f * (b[1] - a[1])))


def in_zone(p, rings, r):
    inside, near = False, False
    for ring in rings:
        for a, b in zip(ring, ring[1:] or ring):
            near = near or distance_to_side(p, a, b) <= r
            if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
                inside = not inside
    return near or inside


def share_in_zone(a, b, shapes, steps=500):
    at = lambda i: (a[0] + (b[0] - a[0]) * (i + 0.5) / steps, a[1] + (b[1] - a[1]) * (i + 0.5) / steps)
    return sum(any(in_zone(at(i), rings, r) for rings, r in shapes) for i in range(steps)) / steps


STAR = [(1000 + (700 if i % 2 else 300) * math.cos(math.pi * i / 7), 1000 + (700 if i % 2 else 300) * math.sin(math.pi * i / 7)) for i in range(14)]
STAR += STAR[:1]
HOLE = [(900.0, 900.0), (900.0, 1100.0), (1100.0, 1100.0), (1100.0, 900.0), (900.0, 900.0)]
BIG = [(-5000.0, 4000.0), (9000.0, 4000.0), (9000.0, 9000.0), (-5000.0, 9000.0), (-5000.0, 4000.0)]


def test_exposure_to_areas(spark):
    rng = random.Random(2)
    features = [("school", [STAR, HOLE]), ("school", [[(2500.0, 1000.0)]]), ("mall", [BIG]), ("school", None), ("school", [[]]), ("other", [BIG]), ("mall", [[(float("nan"), 0.0)]])]
    edges = [(i, rng.uniform(-500, 3000), rng.uniform(-500, 3000)) for i in range(16)]
    edges = [(i, x, y, x + rng.uniform(-1500, 1500), y + rng.uniform(-1500, 1500)) for i, x, y in edges]
    edges += [(100, 950.0, 1000.0, 1050.0, 1000.0), (101, -3000.0, 6000.0, 7000.0, 7000.0), (102, 0.0, 3700.0, 0.0, 3900.0), (103, 500.0, 1000.0, 500.0, 1000.0), (104, 1000.0, 1000.0, 2000.0, 1000.0), (105, float("inf"), 0.0, 0.0, 0.0)]
    rows = [(i, a, b, c, d, math.hypot(c - a, d - b), False) for i, a, b, c, d in edges] + [(999, 0.0, 5000.0, 100.0, 5000.0, 100.0, True)]
    got = zones.exposure(spark.createDataFrame(rows, "id int, ax double, ay double, bx double, by double, length_m double, separated boolean"), spark.createDataFrame(features, RINGS), spark.createDataFrame([("school", 100.0), ("mall", 200.0)], "kind string, radius double"))
    got = {(r["id"], r["kind"]): r["covered"] for r in got.collect()}
    assert not any(i in (103, 105, 999) for i, _ in got)
    for i, a, b, c, d in edges:
        if i in (103, 105):
            continue
        long = math.hypot(c - a, d - b)
        for kind, shapes in (("school", [([STAR, HOLE], 100.0), ([[(2500.0, 1000.0)]], 100.0)]), ("mall", [([BIG], 200.0)])):
            assert got.get((i, kind), 0.0) == pytest.approx(long * share_in_zone((a, b), (c, d), shapes), abs=long / 200), (i, kind)
    # exact: a line through the middle of the mall is covered as a whole, one that ends at its border for the radius
    assert got[101, "mall"] == pytest.approx(math.hypot(10000, 1000)) and got[102, "mall"] == pytest.approx(100) and got[100, "school"] == pytest.approx(100 * share_in_zone((950.0, 1000.0), (1050.0, 1000.0), [([STAR, HOLE], 100.0)], 20000), abs=0.02)


@pytest.mark.parametrize("reach", [0.0, 250.0, 2600.0])
def test_region(spark, reach):
    rng = random.Random(3)
    lines = [(i, x := rng.uniform(-4000, 5000), y := rng.uniform(-4000, 5000), x + rng.uniform(-800, 800), y + rng.uniform(-800, 800)) for i in range(25)]
    lines.append((99, 1e9, 0.0, 1e9, 5.0))
    df = spark.createDataFrame(lines, "id int, x0 double, y0 double, x1 double, y1 double")
    index = zones.region_index(spark.createDataFrame([([STAR, HOLE],), ([[(2000.0, -500.0), (3000.0, -500.0), (3000.0, 500.0), (2000.0, -500.0)]],)], "rings array<array<struct<x:double,y:double>>>"), reach)
    got = {r["id"]: r["share"] for r in zones.covered_share(df, index, reach, ["id"]).collect()}
    shapes = [([STAR, HOLE], reach), ([[(2000.0, -500.0), (3000.0, -500.0), (3000.0, 500.0), (2000.0, -500.0)]], reach)]
    for i, *q in lines:
        assert got.get(i, 0.0) == pytest.approx(share_in_zone(q[:2], q[2:], shapes, 300), abs=7e-3), i
    assert {r["id"] for r in zones.covered(df, index, reach, ["id"]).collect()} == {i for i, s in got.items() if s > 1 - 1e-6}
