"""Nearest nodes: cells as small as nodes are dense, and rings for points that are far from all."""

import math
import random

from wegloom.functions import geo
from wegloom.operators import network


def test_cells_by_density(spark, monkeypatch):
    rng = random.Random(5)
    nodes = [(i, float(rng.randint(0, 300)), float(rng.randint(0, 300))) for i in range(2000)] + [(5000, 900.0, 900.0)]
    points = [(i, rng.uniform(-200, 1300), rng.uniform(-200, 1300)) for i in range(300)] + [(900, 90000.0, 0.0)]
    sizes, cells = [], geo.cells
    monkeypatch.setattr(geo, "cells", lambda *a: sizes.append(a[4]) or cells(*a))
    got = network.nearest_nodes(spark.createDataFrame(points, "point_id int, px double, py double"), spark.createDataFrame(nodes, "node int, x double, y double"), 1000.0).collect()
    assert sizes[0] < 40 and len(got) == len(points)
    for r in got:
        gap, node = min((math.dist((x, y), (r["px"], r["py"])), i) for i, x, y in nodes)
        assert r["road_node"] == node and abs(r["gap_m"] - gap) < 1e-9
