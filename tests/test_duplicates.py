"""Duplicates of hospitals: as by a list of keepers that grows row by row, and without pairs of all close rows."""

import math
import random

from wegloom.functions import constants as C
from wegloom.operators import hospitals


def metres(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return C.EARTH_M * 2 * math.asin(min(1.0, math.sqrt(h)))


def test_as_row_by_row(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["relation", "way", "node"]), str(i), rng.choice(["a", "b"]), 110 + rng.uniform(0, 0.012), -7.8 + rng.uniform(0, 0.012)) for i in range(300)]
    kept, want = {"a": [], "b": []}, {}
    for kind, i, key, *at in sorted(rows, key=lambda r: (["relation", "way", "node"].index(r[0]), r[1])):
        close = [k for k in kept[key] if metres(k[1], at) <= C.DUPLICATE_M]
        if close:
            want[kind, i] = close[0][0]
        else:
            kept[key].append((f"{kind}/{i}", at))
    got = hospitals.duplicates(spark.createDataFrame(rows, "osm_type string, id string, key string, lon double, lat double"))
    assert {(r["osm_type"], r["id"]): r["merged_into"] for r in got.collect()} == want


def test_crowd(spark):
    """60,000 rows of one name within 250 m, 1.8 billion pairs, that are never made."""
    rows = spark.range(60_000).selectExpr("'node' osm_type", "lpad(id, 6, '0') id", "'a' key", "110 + id % 100 / 100000.0D lon", "-7.8D + id % 97 / 100000.0D lat")
    got = hospitals.duplicates(rows)
    assert got.count() == 59_999 and got.select("merged_into").distinct().first()[0] == "node/000000"
