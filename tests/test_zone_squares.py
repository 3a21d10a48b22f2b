"""Zones of areas over squares: sides through the middle of a cell, and areas over one another that make no more rows."""

from pyspark.sql import functions as F

from wegloom.operators import zones

RINGS = "kind string, rings array<array<struct<x:double,y:double>>>"
EDGES = "id int, ax double, ay double, bx double, by double, length_m double, separated boolean"


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def test_side_through_the_middle(spark):
    features = spark.createDataFrame([("a", [box(250.0, -300.0, 900.0, 800.0)]), ("b", [box(-300.0, 250.0, 800.0, 900.0)])], RINGS)
    edges = spark.createDataFrame([(1, 260.0, 100.0, 460.0, 100.0, 200.0, False), (2, 240.0, 100.0, 40.0, 100.0, 200.0, False), (3, 100.0, 260.0, 100.0, 460.0, 200.0, False)], EDGES)
    got = zones.exposure(edges, features, spark.createDataFrame([("a", 1.0), ("b", 1.0)], "kind string, radius double"))
    assert {(r["id"], r["kind"]): round(r["covered"], 6) for r in got.collect()} == {(1, "a"): 200.0, (3, "b"): 200.0}


def test_areas_over_one_another(spark):
    n = 60
    rings = spark.createDataFrame([("a", [box(i - 700.0, -700.0, i + 700.0, 700.0 + i)]) for i in range(n)], RINGS)
    outline = zones.sides(rings.withColumn("feature", F.xxhash64("rings")), ["kind", "feature"])
    ends = [F.col(c) for c in zones.ENDS]
    around = outline.select("kind", F.lit(100.0).alias("radius"), *ends, F.explode(zones.geo.line_cells(*ends, 100.0, 500.0)).alias("c"))
    own = zones.Scratch(spark)
    held = zones.parts(around, zones.interior(outline, ["kind", "feature"], 500.0, own), 500.0)
    # the middle is one square a cell; where sides are many, squares are small and most of them are filled
    assert held.where("c.cx in (-1, 0) and c.cy in (-1, 0)").select(F.bool_and("whole"), F.count("*")).first() == (True, 4)
    cells = held.select("c").distinct().count()
    assert held.count() < 16 * cells and held.where("whole").count() > 50
