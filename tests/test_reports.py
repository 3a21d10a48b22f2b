"""Reviews of features, searches and blocked ways, on cases laid by hand."""

from pyspark.sql import functions as F

from wegloom.operators import polygons, reports, turns

OBJECT = "osm_type string, id bigint, kind string, name string, tags map<string,string>"


def test_outlines_of_open_ways(spark):
    area = {"type": "multipolygon"}
    objects = spark.createDataFrame([("relation", i, "mall", "m", area) for i in (1, 2, 3)], OBJECT)
    members = spark.createDataFrame([(1, 1, 10, "outer"), (1, 1, 11, ""), (2, 1, 10, "outer"), (3, 1, 10, "outer"), (3, 1, 11, "outer"), (3, 1, 12, "inner")], "id bigint, mtype int, mid bigint, role string")
    refs = [(10, 0, 1), (10, 1, 2), (10, 2, 3), (11, 0, 3), (11, 1, 4), (11, 2, 1), (12, 0, 1), (12, 1, 3)]
    at = spark.createDataFrame([(1, 0.0, 0.0), (2, 400.0, 0.0), (3, 400.0, 400.0), (4, 0.0, 400.0)], "node bigint, x double, y double")
    good, bad = polygons.areas(objects, members, spark.createDataFrame(refs, "way bigint, pos int, node bigint"), at)
    assert {r["id"]: sorted(len(x) for x in r["rings"]) for r in good.collect()} == {1: [5]}
    assert {r["id"]: r["reason"] for r in bad.collect()} == {2: "outer_does_not_close", 3: "inner_does_not_close"}
    assert {tuple(r) for r in reports.poi_counts(good, bad).collect()} == {("mall", 1, 2)} and reports.poi_counts(good.limit(0), bad.limit(0)).count() == 0


def test_unresolved_review(spark):
    lost = [("node", 1, "mall"), ("node", 9, "mall"), ("way", 5, "school"), ("relation", 7, "mall"), ("relation", 8, "mall"), ("relation", 8, "mall")]
    members = spark.createDataFrame([(7, 1, 5, "outer"), (8, 0, 1, "label"), (8, 2, 7, "outer")], "id bigint, mtype int, mid bigint, role string")
    refs = spark.createDataFrame([(5, 0, 2), (5, 1, 3), (5, 2, 99)], "way bigint, pos int, node bigint")
    at = spark.createDataFrame([(1, 500.0, 0.0), (2, 500.0, 0.0), (3, 50.0, 50.0), (4, None, 0.0)], "node bigint, x double, y double")
    d = reports.unresolved_review(spark.createDataFrame(lost, "osm_type string, id bigint, kind string"), members, refs, at, (F.col("x") < 100) & (F.col("y") < 100))
    got = sorted((r["osm_type"], r["id"], r["vertices"], r["review"]) for r in d.collect())
    assert got == [("node", 1, 1, "elsewhere"), ("node", 9, 0, "unknown"), ("relation", 7, 2, "in_region"), ("relation", 8, 1, "elsewhere"), ("relation", 8, 1, "elsewhere"), ("way", 5, 2, "in_region")]


def test_blocked_frontier(spark):
    edges = spark.createDataFrame([("ab", "a", "b", 1), ("bc", "b", "c", 1), ("bd", "b", "d", 2), ("xy", "x", "y", 3)], "id string, u string, v string, way_id bigint")
    rules = spark.createDataFrame([(1, 2, "b", "no_left_turn")], "from_way bigint, to_way bigint, via string, restriction string")
    blocked = spark.createDataFrame([("1", "c", "gate"), ("2", "d", "gate"), ("3", "x", "gate"), ("4", "n", "gate")], "id string, u string, blocked_nodes string")
    starts = spark.createDataFrame([(1, "a"), (2, "x"), (3, "n"), (4, None)], "query_id bigint, start string")
    got = lambda r: {(x["query_id"], x["id"]) for x in reports.blocked_frontier(edges, turns.transitions(edges, r), starts, blocked).collect()}
    assert got(rules) == {(1, "1"), (2, "3"), (3, "4")} and got(None) == {(1, "1"), (1, "2"), (2, "3"), (3, "4")}


def test_blocked_frontiers(spark):
    # a-b-g leads to the goal; x-y and y-x don't, nor does a turn that a rule forbids (p-q, q-g by way 6 from way 5)
    ways = [("ab", "a", "b", 1), ("bg", "b", "g", 1), ("xy", "x", "y", 3), ("yx", "y", "x", 3), ("pq", "p", "q", 5), ("qg", "q", "g", 6), ("gh", "g", "h", 7), ("rs", "r", "s", 8)]
    edges = spark.createDataFrame(ways, "id string, u string, v string, way_id bigint")
    rules = spark.createDataFrame([(5, 6, "q", "no_left_turn")], "from_way bigint, to_way bigint, via string, restriction string")
    blocked = spark.createDataFrame([("1", "y"), ("2", "x"), ("3", "q"), ("4", "b"), ("5", "h"), ("6", "p")], "id string, u string")
    goals = spark.createDataFrame([("g",), ("g",)], "node string")
    got = lambda e, r: {(x["start"], x["id"]) for x in reports.blocked_frontiers(e, turns.transitions(e, r), goals, blocked).collect()}
    around = {("x", "1"), ("x", "2"), ("y", "1"), ("y", "2")}
    assert got(edges, rules) == around | {("p", "3"), ("p", "6")} and got(edges, None) == around and got(edges.limit(0), rules) == set()


def test_validation_summary(spark):
    rows = [(q, "pagi", a, c, n) for q, two in enumerate([(1.0, 1.0), (None, None), (2.0, None), (1.0, 1.5)]) for a, c, n in zip(("ucs", "astar"), two, (7, 3))]
    d = reports.validation_summary(spark.createDataFrame(rows, "query_id int, scenario string, algorithm string, cost_s double, expanded_states bigint"))
    assert [tuple(r) for r in d.collect()] == [("pagi", 4, 8, 1, 2, 7)]
