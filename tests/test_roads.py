"""Unit facts of the road engine: policies, turns, costs, exposure, projection, search, overlay, files."""

import math
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from wegloom.functions import constants as C
from wegloom.functions import geo, tags, text
from wegloom.operators import catalog, costs, hospitals, network, origin, places, poi, polygons, search, turns
from wegloom.operators.components import components
from wegloom.sources import files, osm_pbf
from wegloom.streaming.dispatch import dispatch


def maps(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, tags map<string,string>")


def values(spark, rows, column):
    return [r[0] for r in maps(spark, rows).orderBy("i").select(column).collect()]


def test_policies(spark):
    t = F.col("tags")
    rows = [
        ({"highway": "primary"}, "allowed"), ({"highway": "primary", "access": "private"}, "restricted_access"), ({"highway": "primary", "width": "2.8"}, "width_below_3m"), ({"highway": "residential"}, "local_width_missing"),
        ({"highway": "residential", "width": "3.5"}, "allowed"), ({"highway": "primary", "oneway": "reversible"}, "oneway_ambiguous"), ({"highway": "footway"}, "excluded_class"), ({"highway": "primary", "area": "yes"}, "excluded_class"),
        ({"highway": "primary", "access:conditional": "no"}, "conditional_or_directional_access_review"), ({"highway": "primary", "width": "broad"}, "width_unparsed_review"), ({"highway": "primary", "maxheight": "3"}, "vehicle_dimensions_review"),
        ({"highway": "primary", "surface": "mud"}, "surface_review"), ({"highway": "service"}, "service_requires_access_audit"), ({"highway": "primary", "proposed": "yes"}, "construction"), ({"highway": "primary", "access": "no", "motorcar": "yes"}, "allowed"), ({}, "excluded_class"),
    ]
    assert values(spark, [r for r, _ in rows], tags.road_policy(t)) == [w for _, w in rows]
    access = [({"highway": "residential"}, "allowed"), ({"highway": "service"}, "allowed"), ({"highway": "residential", "width": "2"}, "width_below_3m"), ({"highway": "service", "access": "private"}, "restricted_access"), ({"highway": "service", "service": "parking_aisle"}, "service_subtype_review"), ({"highway": "residential", "name": "Gang Melati"}, "named_alley")]
    assert values(spark, [r for r, _ in access], tags.access_policy(t)) == [w for _, w in access]
    ways = [({"highway": "primary", "oneway": "-1"}, [-1]), ({"highway": "primary", "junction": "roundabout"}, [1]), ({"highway": "primary", "junction": "roundabout", "oneway": "no"}, [1, -1]), ({"highway": "primary"}, [1, -1]), ({"highway": "motorway"}, [1])]
    assert values(spark, [r for r, _ in ways], tags.directions(t)) == [w for _, w in ways]
    nodes = [
        ({"barrier": "gate", "access": "permissive"}, True), ({"barrier": "swing_gate", "motor_vehicle": "yes", "access": "no"}, True), ({"barrier": "lift_gate"}, False), ({"barrier": "gate", "access": "no"}, False), ({"barrier": "gate", "motorcar": "no", "motor_vehicle": "yes"}, False),
        ({"barrier": "gate", "access": "yes", "locked": "yes"}, False), ({"barrier": "gate", "access": "yes", "opening_hours": "08-17"}, False), ({}, True), ({"width": "2"}, False),
    ]
    assert values(spark, [r for r, _ in nodes], tags.node_allowed(t)) == [w for _, w in nodes]


def test_speeds(spark):
    rows = [{"highway": "primary"}, {"highway": "primary", "maxspeed": "30"}, {"highway": "primary", "maxspeed": "20 mph"}, {"highway": "primary", "maxspeed": "walk"}, {"highway": "primary", "maxspeed:backward": "bad"}]
    assert values(spark, rows, tags.edge_speed(F.col("tags"), F.lit(1))) == [40.0, 30.0, pytest.approx(32.18688), None, 40.0]
    assert values(spark, rows[-1:], tags.edge_speed(F.col("tags"), F.lit(-1))) == [None]


def test_projection_and_geometry(spark):
    one = spark.range(1)
    p = one.select(geo.utm_forward(F.lit(110.373906361), F.lit(-7.766067024)).alias("p")).first()["p"]
    assert (p["x"], p["y"]) == (pytest.approx(430964.89833165903, abs=1e-4), pytest.approx(9141512.686175067, abs=1e-4))
    assert one.select(geo.utm_forward(F.lit(107.0), F.lit(-7.0)).alias("p")).first()["p"] is None
    with pytest.raises(Exception, match="108-114"):
        one.select(geo.utm_forward(F.lit(110.0), F.lit(1.0), True)).collect()
    with pytest.raises(ValueError):
        geo.transformer(4326, 32749)
    assert geo.transformer("EPSG:4326", 32749, True) is geo.utm_forward
    s = one.select(geo.project_segment(*[F.lit(float(v)) for v in (600, 3, 0, 0, 1000, 0)]).alias("s"), geo.project_segment(*[F.lit(float(v)) for v in (3, 4, 0, 0, 0, 0)]).alias("z")).first()
    assert (s["s"]["gap"], s["s"]["f"], s["z"]["gap"], s["z"]["f"]) == (3.0, 0.6, 5.0, 0.0)
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))])
    assert one.select(geo.ring_contains(F.lit(5.0), F.lit(5.0), ring), geo.ring_contains(F.lit(15.0), F.lit(5.0), ring)).first()[:] == (True, False)


def test_exposure(spark):
    line = "id string, ax double, ay double, bx double, by double, length_m double, separated boolean"
    e = spark.createDataFrame([("a", -20.0, 5.0, 200.0, 5.0, 220.0, False), ("b", -20.0, 5.0, 72.0, 5.0, 92.0, False), ("c", 72.0, 5.0, 200.0, 5.0, 128.0, False)], line)
    boxes = spark.createDataFrame([(0.0, 0.0, 100.0, 10.0), (50.0, 0.0, 150.0, 10.0)], "x0 double, y0 double, x1 double, y1 double")
    got = {r["id"]: r["covered"] for r in poi.box_exposure(e, boxes).collect()}
    assert got["a"] == pytest.approx(150) and got["b"] + got["c"] == pytest.approx(150)
    through = spark.createDataFrame([("l", -500.0, 0.0, 500.0, 0.0, 1000.0, False), ("t", -500.0, 0.0, 500.0, 0.0, 1000.0, True), ("far", 5000.0, 0.0, 5100.0, 0.0, 100.0, False)], line)
    for n in (1, 2):
        sites = spark.createDataFrame([("school", 0.0, 0.0)] * n, "kind string, x double, y double")
        assert [(r["id"], r["kind"], pytest.approx(200)) for r in poi.exposure(through, sites).collect()] == [("l", "school", 200)]
    full = {r["id"]: r["exposure_m"] for r in poi.with_exposure(through, sites).collect()}
    assert full["far"] == {"school": 0.0, "market": 0.0, "mall": 0.0} and full["t"]["school"] == 0


def test_edge_costs(spark):
    e = spark.createDataFrame([("e", "u", "v", 200.0, "primary", {"school": 100.0, "market": 50.0, "mall": 25.0})], "id string, u string, v string, length_m double, highway string, exposure_m map<string,double>")
    got = {r["scenario"]: (r["base_s"], r["poi_s"]) for r in costs.edge_costs(e).collect()}
    assert {k: (pytest.approx(18), p) for k, (_, p) in got.items()} == got and [got[s][1] for s in C.SCENARIOS] == [36.25, 28.75, 18.75, 5.0]
    bad = e.withColumn("length_m", F.lit(50.0))
    with pytest.raises(Exception, match="valid speed"):
        costs.edge_costs(bad).collect()
    assert all(r["cost_s"] is None for r in costs.edge_costs(bad, strict=False).collect())
    nodes = spark.createDataFrame([("u", 0.0, 0.0), ("v", 300.0, 0.0)], "id string, x double, y double")
    assert [r["fault"] for r in network.graph_faults(e, nodes).collect()] == ["length is below the straight distance"]


def test_demo_and_detour(spark):
    d = files.demo(spark)
    c = costs.edge_costs(d["edges"])
    q = spark.createDataFrame([(1, "pagi", "S"), (2, "pagi", "A"), (3, "pagi", "nowhere")], "query_id bigint, scenario string, start string")
    allowed = turns.transitions(d["edges"])
    got = {r["query_id"]: (r["goal"], r["cost_s"]) for r in search.cheapest_goal(c, allowed, q, d["goals"]).collect()}
    assert got == {1: ("B", pytest.approx(27)), 2: ("A", 0.0), 3: (None, None)}
    nodes = spark.createDataFrame([("a", 0.0, 0.0), ("b", 100.0, 0.0), ("c", 200.0, 0.0), ("d", 100.0, 100.0)], "id string, x double, y double")
    edges = spark.createDataFrame([("ab", "a", "b", "1", 100.0), ("bc", "b", "c", "2", 100.0), ("bd", "b", "d", "3", 100.0), ("dc", "d", "c", "4", 150.0)], "id string, u string, v string, way_id string, length_m double").withColumn("highway", F.lit("primary"))
    rule = spark.createDataFrame([("1", "2", "b", "no_right_turn")], "from_way string, to_way string, via string, restriction string")
    goal = spark.createDataFrame([("c", ["C"])], "node string, hospitals array<string>")
    c = costs.edge_costs(edges)
    start = spark.createDataFrame([(1, "pagi", "a")], "query_id bigint, scenario string, start string")
    allowed = turns.transitions(edges, rule)
    best = search.cheapest_goal(c, allowed, start, goal).first()
    assert (best["goal"], best["cost_s"], best["first_edge"]) == ("c", pytest.approx(31.5), "ab")
    first = start.join(c.select("scenario", F.col("u").alias("start"), F.col("id").alias("node"), F.col("cost_s").alias("cost")), ["scenario", "start"]).select("query_id", "scenario", "node", "cost")
    states = search.relax(search.edge_arcs(c, allowed), first, ["query_id", "scenario"])
    path = search.walk_back(states, spark.createDataFrame([(1, "pagi", "dc")], "query_id bigint, scenario string, node string"), ["query_id", "scenario"])
    parts = search.path_parts(path, c, ["query_id", "scenario"]).first()
    assert parts["edges"] == ["ab", "bd", "dc"] and parts["length_m"] == 350
    whole = search.routes(c, allowed, start, goal).first()
    assert whole["edges"] == ["ab", "bd", "dc"] and whole["base_s"] == pytest.approx(31.5) and whole["start"] == "a"
    core = spark.createDataFrame([("d",)], "node string")
    steps = search.running_cost(path, c, core, ["query_id", "scenario"]).orderBy(F.desc("step")).collect()
    assert [r["entered_core"] for r in steps] == [False, True, True] and steps[-1]["cost_so_far"] == pytest.approx(31.5)


def test_relaxation_of_a_long_chain(spark):
    """Many rounds, merged tables on the way, and paths by doubling: against the sums of a chain's weights."""
    n = 21
    arcs = spark.createDataFrame([(i, i + 1, float(i % 5 + 1)) for i in range(n)] + [(0, n, 1000.0), (3, 1, 0.0)], "src bigint, dst bigint, weight double")
    states = search.relax(arcs, spark.createDataFrame([(0, 0.0)], "node bigint, cost double"))
    got = {r["node"]: (r["cost"], r["parent"]) for r in states.collect()}
    assert got == {i: (float(sum(k % 5 + 1 for k in range(i))), i - 1 if i else None) for i in range(n + 1)}
    path = search.walk_back(states, spark.createDataFrame([(n,), (5,)], "node bigint").withColumn("end", F.col("node")), ["end"], [])
    steps = {}
    for r in path.collect():
        steps.setdefault(r["end"], []).append((r["step"], r["node"]))
    assert {k: sorted(v) for k, v in steps.items()} == {e: [(i, e - i) for i in range(e + 1)] for e in (n, 5)}
    ends = spark.createDataFrame([(str(n),)], "node string")
    edges = arcs.where("src > 0").selectExpr("string(src) u", "string(dst) v")
    assert search.reachable(edges, ends, backwards=True).count() == n


def test_turn_rules(spark):
    edges = spark.createDataFrame([("e1", "a", "b", "1"), ("back", "b", "a", "1"), ("on", "b", "c", "1"), ("side", "b", "d", "2")], "id string, u string, v string, way_id string")

    def after(kind, to):
        r = spark.createDataFrame([("1", to, "b", kind)], "from_way string, to_way string, via string, restriction string")
        return {x["e2"] for x in turns.transitions(edges, r).where("e1 = 'e1'").collect()}

    assert after("no_u_turn", "1") == {"on", "side"}
    assert after("only_right_turn", "2") == {"side"}
    assert after("no_straight_on", "1") == {"side"}
    assert after("only_u_turn", "1") == {"back"}


def test_components_and_reach(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7)]
    par = list(range(60))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in {y for p in pairs for y in p}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    e = spark.createDataFrame([("a", "b", False), ("c", "goal", False), ("x", "c", True)], "u string, v string, closed boolean")
    goal = spark.createDataFrame([("goal",)], "node string")
    assert {r["node"] for r in search.reachable(e, goal, backwards=True).collect()} == {"c", "goal"}


def test_hospitals(spark):
    names = ["Apotek Rumah Sakit Contoh", "Rumah Sakit Mata Contoh", "RSUD Sleman", "", "Toko", "RS Universitas Islam Indonesia", "Rumah Sakit Universitas Islam Indonesia"]
    d = maps(spark, [{"name": n} for n in names]).orderBy("i").select(text.classify_hospital(F.col("tags"))["decision"].alias("d"), text.canonical(F.col("tags")["name"]).alias("c")).collect()
    assert [r["d"] for r in d[:5]] == ["exclude", "exclude", "include", "review", "review"] and d[5]["c"] == d[6]["c"]
    rows = [("node", 1, {"name": "RS A"}, 110.0, -7.8, False), ("way", 2, {"name": "Rumah Sakit A"}, 110.001, -7.8, False), ("node", 3, {"name": "RS A"}, 110.01, -7.8, False), ("node", 4, {"name": "RS A"}, 110.0028, -7.8, False)]
    a = hospitals.audited(spark.createDataFrame(rows, "osm_type string, id bigint, tags map<string,string>, lon double, lat double, boundary_review boolean"))
    got = {r["id"]: (r["decision"], r["merged_into"]) for r in a.collect()}
    assert got == {"2": ("include", None), "1": ("duplicate", "way/2"), "4": ("duplicate", "way/2"), "3": ("include", None)}
    assert hospitals.decisions(a).first().asDict() == {"include": 2, "exclude": 0, "review": 0, "duplicate": 2}
    assert [r["source_objects"] for r in hospitals.keepers(a).where("id = '2'").collect()] == [["way/2", "node/1", "node/4"]]


def test_places(spark):
    p = spark.createDataFrame([(0, "Jl. Kaliurang", "road", -7.75, 110.38, None, None), (1, "Kost Melati", "place", -7.76, 110.37, "Indekos Melati", None), (2, "Jalan Kaliurang", "road", -7.75, 110.38, None, None), (3, "RS Melati", "place", -7.8, 110.4, None, "Jl. Mawar")], "seq bigint, name string, kind string, lat double, lon double, aliases string, address string")
    i = places.index(p)
    assert [r["seq"] for r in places.search(i, "jalan kaliurang").collect()] == [0]
    assert [r["seq"] for r in places.search(i, "Kos Melati").collect()] == [1]
    assert [r["seq"] for r in places.search(i, "melati").collect()] == [3, 1]
    assert places.search(i, "mawar").first()["total"] == 1 and places.search(i, "unknown").count() == 0
    with pytest.raises(ValueError):
        places.search(i, "x")
    assert text.key_of(spark, text.place_key, "Jl. Café  RSUD") == "jalan cafe rumah sakit umum daerah" and text.key_of(spark, text.plain_key, "CAFÉ-Ｒｓ") == "cafe rs"
    named = spark.createDataFrame([(0, "Warung", "place", -7.7, 110.3, "Tempat;CAFÉ Béta", None), (1, "Café Béta dua", "place", -7.7, 110.31, None, None)], p.schema)
    assert [r["seq"] for r in places.search(places.index(named), "cafe beta").collect()] == [0, 1]
    assert [r["seq"] for r in places.quick_search(places.window_places(p), "kos").collect()] == [1]
    assert places.exact(p, "RS Melati").first()["seq"] == 3


def test_catalog_and_route_points(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, {}), (2, 600.0, 0.0, {}), (3, 1200.0, 0.0, {"barrier": "gate"})], "id bigint, x double, y double, tags map<string,string>")
    ways = spark.createDataFrame([(10, [1, 2], {"highway": "residential", "name": "Jl. A", "width": "4"}), (11, [2, 3], {"highway": "residential"})], "id bigint, refs array<bigint>, tags map<string,string>")
    cat = catalog.build_catalog(ways, nodes)
    assert {r["kind"]: r["n"] for r in catalog.usable_counts(cat).collect()} == {"usable_segments": 1, "blocked_segments": 1}
    catalog.write_catalog(cat, str(tmp_path / "cat"))
    cells = catalog.read_catalog(spark, str(tmp_path / "cat"))
    assert [r["segment_id"] for r in catalog.in_radius(cells, 550.0, 0.0, 100.0).collect()] == ["10:0", "11:0"]
    edges, audit = network.build_edges(ways.where("id = 10"), nodes)
    assert edges.count() == 2 and audit.count() == 0
    c = costs.edge_costs(edges)
    goal = spark.createDataFrame([("2", ["H"])], "node string, hospitals array<string>")
    access = catalog.celled(origin.segment_structs(cat))
    strict = catalog.celled(origin.strict_segments(edges.withColumns({k: F.col(k).cast("string") for k in ("u", "v", "way_id")}), nodes.withColumn("id", F.col("id").cast("string")), ways.select(F.col("id").cast("string").alias("way_id"), "tags")))
    p = spark.createDataFrame([(1, 300.0, 5.0), (2, 9000.0, 9000.0)], "point_id bigint, px double, py double")
    got = origin.route_points(p, access, strict, c, goal).collect()
    ok = [r for r in got if r["point_id"] == 1]
    assert len(ok) == 4 and all(r["status"] == "ok" and r["agree"] for r in ok) and ok[0]["cost_s"] == pytest.approx(300 / (20 / 3.6))
    assert {r["status"] for r in got if r["point_id"] == 2} == {"no road in reach"}
    chosen = catalog.choose_origins(catalog.celled(cat), p).orderBy("point_id").collect()
    assert (chosen[0]["x"], chosen[0]["y"], chosen[1]["gap"]) == (300.0, 0.0, None)
    near = search.nearest_start(p, edges, nodes).orderBy("point_id").collect()
    assert [r["status"] for r in near] == ["too far from the network"] * 2


def vint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def pb(key, value):
    return vint(key << 3) + vint(value) if isinstance(value, int) else vint(key << 3 | 2) + vint(len(value)) + value


def zz(n):
    return (n << 1) ^ (n >> 63)


def deltas(values):
    return b"".join(vint(zz(b - a)) for a, b in zip([0, *values], values))


def blob(kind, raw):
    z = zlib.compress(raw)
    body = pb(2, len(raw)) + pb(3, z)
    head = pb(1, kind) + pb(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def test_pbf(spark, tmp_path):
    strings = [b"", b"amenity", b"hospital", b"highway", b"primary", b"from", b"restriction", b"type"]
    table = b"".join(pb(1, s) for s in strings)
    dense = pb(1, deltas([5, 6])) + pb(8, deltas([-77000000, -77000001])) + pb(9, deltas([1104000000, 1104000001])) + pb(10, vint(1) + vint(2) + vint(0) + vint(0))
    way = pb(1, 9) + pb(2, vint(3)) + pb(3, vint(4)) + pb(8, deltas([5, 6]))
    rel = pb(1, 3) + pb(2, vint(7)) + pb(3, vint(6)) + pb(8, vint(5)) + pb(9, deltas([9])) + pb(10, vint(1))
    data = pb(1, table) + pb(2, pb(2, dense)) + pb(2, pb(3, way)) + pb(2, pb(4, rel))
    path = tmp_path / "x.pbf"
    path.write_bytes(blob(b"OSMHeader", pb(4, b"DenseNodes")) + blob(b"OSMData", data))
    nodes, ways, rels = osm_pbf.split(osm_pbf.read(spark, str(path)))
    n = nodes.orderBy("id").collect()
    assert [(r["id"], r["lat"], r["tags"]) for r in n] == [(5, pytest.approx(-7.7), {"amenity": "hospital"}), (6, pytest.approx(-7.7000001), {})] and n[0]["lon"] == pytest.approx(110.4)
    assert [(r["refs"], r["tags"]) for r in ways.collect()] == [([5, 6], {"highway": "primary"})]
    assert [[tuple(m) for m in r["members"]] for r in rels.collect()] == [[(1, 9, "from")]]
    assert osm_pbf.nodes_come_first(osm_pbf.read(spark, str(path))).first()["ok"]
    assert osm_pbf.read(spark, str(path), "way").count() == 1
    with open(path, "rb") as f:
        assert len(list(osm_pbf.walk(f))) == 2
    for bad in (path.read_bytes()[:-2], blob(b"OSMHeader", pb(4, b"HistoricalInformation")), blob(b"OSMData", data), b"", b"\0\0"):
        (tmp_path / "bad.pbf").write_bytes(bad)
        with open(tmp_path / "bad.pbf", "rb") as f, pytest.raises(osm_pbf.PbfError):
            list(osm_pbf.walk(f))
    assert osm_pbf.numbers([bytes([20, 5]), bytes([8])], True, True) == [10, 7, 11]


def test_pbf_blocks_left_out(spark, tmp_path):
    """A block for each of nodes, ways with a road, ways without tags, and relations: those that can't matter aren't read."""
    strings = [b"", b"amenity", b"hospital", b"highway", b"primary", b"from", b"restriction", b"type"]
    table = pb(1, b"".join(pb(1, x) for x in strings))
    dense = lambda a: pb(1, deltas([a, a + 1])) + pb(8, deltas([-77000000] * 2)) + pb(9, deltas([1104000000] * 2)) + pb(10, vint(1) + vint(2) + vint(0) + vint(0))
    way = lambda i, tagged: pb(1, i) + (pb(2, vint(3)) + pb(3, vint(4)) if tagged else b"") + pb(8, deltas([5, 6]))
    rel = pb(1, 3) + pb(2, vint(7)) + pb(3, vint(6)) + pb(8, vint(5)) + pb(9, deltas([9])) + pb(10, vint(1))
    parts = [pb(2, pb(2, dense(5))), pb(2, pb(2, dense(900))), pb(2, pb(3, way(9, True))), pb(2, pb(3, way(10, False))), pb(2, pb(4, rel))]
    path, stats = str(tmp_path / "y.pbf"), str(tmp_path / "stats")
    (tmp_path / "y.pbf").write_bytes(blob(b"OSMHeader", pb(4, b"DenseNodes")) + b"".join(blob(b"OSMData", table + p) for p in parts))
    osm_pbf.save_statistics(spark, path, stats)

    def blocks(**options):
        return [b.index for b in osm_pbf.PbfReader({"path": path, "stats": stats, **options}).partitions()]

    every = blocks()
    assert len(every) == 5 and every == [b.index for b in osm_pbf.PbfReader({"path": path}).partitions()]
    assert blocks(entity="way") == every[2:4] and blocks(entity="way,relation") == every[2:] and blocks(entity="node", ids="100..9999") == every[1:2] and blocks(ids="9..9") == every[2:3]
    assert blocks(keys="highway") == every[2:3] and blocks(keys="amenity,type") == [every[0], every[1], every[4]] and blocks(keys="shop") == []
    for r in (osm_pbf.read(spark, path), osm_pbf.read(spark, path, stats=stats), osm_pbf.read(spark, "file://" + path, stats="file://" + stats)):
        assert r.where("kind = 'way' and id > 9").count() == 1 and r.where("kind = 'node'").count() == 4 and r.count() == 7
    assert [x["id"] for x in osm_pbf.read(spark, path, keys=["highway"], stats=stats).collect()] == [9] == [x["id"] for x in osm_pbf.read(spark, path, keys=["highway"]).collect()]
    assert sorted(x["id"] for x in osm_pbf.read(spark, path, ids=(6, 9), stats=stats).collect()) == [6, 9] == sorted(x["id"] for x in osm_pbf.read(spark, path, ids=(6, 9)).collect())
    with open(path, "ab") as f:
        f.write(blob(b"OSMData", table + parts[0]))
    with pytest.raises(osm_pbf.PbfError):
        osm_pbf.PbfReader({"path": path, "stats": stats}).partitions()


def test_restrictions(spark):
    kinds = "id bigint, tags map<string,string>, members array<struct<mtype:int,mid:bigint,role:string>>"
    ok = [(1, 1, "from"), (0, 5, "via"), (1, 2, "to")]
    r = spark.createDataFrame([(1, {"restriction": "no_left_turn"}, ok), (2, {"restriction": "no_left_turn", "except": "bus;motorcar"}, ok), (3, {"restriction": "no_entry"}, ok), (4, {"restriction": "no_left_turn"}, [(1, 99, "from"), *ok[1:]]), (5, {"restriction": "only_u_turn"}, [ok[0], (1, 7, "via"), ok[2]])], kinds)
    rules, audit = network.split_restrictions(r, spark.createDataFrame([(1,), (2,)], "id bigint"))
    assert [(x["from_way"], x["to_way"], x["via"], x["restriction"]) for x in rules.collect()] == [("1", "2", "5", "no_left_turn")]
    assert {x["action"]: x["n"] for x in turns.rule_actions(audit).collect()} == {"turn_state_rule": 1, "exclude_from_ways_conservatively": 2}


def test_areas(spark):
    objects = spark.createDataFrame([("node", 1, "school", "a", {}), ("way", 2, "school", "b", {}), ("way", 3, "mall", "c", {}), ("relation", 4, "mall", "d", {"type": "multipolygon"}), ("relation", 5, "mall", "e", {"type": "site"}), ("node", 99, "mall", "f", {})], "osm_type string, id bigint, kind string, name string, tags map<string,string>")
    members = spark.createDataFrame([(4, 1, 2, "outer"), (4, 1, 3, "balcony"), (5, 1, 2, "outer")], "id bigint, mtype int, mid bigint, role string")
    refs = spark.createDataFrame([(2, i, n) for i, n in enumerate([1, 10, 11, 1])] + [(3, 0, 1), (3, 1, 10)], "way bigint, pos int, node bigint")
    at = spark.createDataFrame([(1, 0.0, 0.0), (10, 1.0, 0.0), (11, 1.0, 1.0)], "node bigint, x double, y double")
    good, bad = polygons.areas(objects, members, refs, at)
    assert {r["id"]: len(r["rings"][0]) for r in good.collect()} == {1: 1, 2: 4, 4: 4}
    assert {r["id"]: r["reason"] for r in bad.collect()} == {3: "open_way_not_area", 5: "relation_not_multipolygon", 99: "missing_nodes"}


def test_files_and_stream(spark, tmp_path):
    import json

    import zstandard

    doc = {"nodes": {"a": [0, 0], "b": [100, 0]}, "edges": [{"id": "ab", "u": "a", "v": "b", "way_id": "1", "length_m": 100, "highway": "primary"}], "turn_restrictions": [], "goals": ["b"], "goal_hospitals": {"b": ["H"]}}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    (tmp_path / "g.json.zst").write_bytes(zstandard.ZstdCompressor().compress(json.dumps(doc).encode()))
    for t in (files.read_graph(spark, str(tmp_path / "g.json")), files.read_graph_zstd(spark, str(tmp_path / "g.json.zst"))):
        assert t["nodes"].count() == 2 and t["goals"].first()["hospitals"] == ["H"] and t["rules"].count() == 0
    c, allowed = costs.edge_costs(t["edges"]).cache(), turns.transitions(t["edges"])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"query_id": 1, "scenario": "pagi", "start": "a"}\n')
    q = dispatch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), lambda b: search.cheapest_goal(c, allowed, b, t["goals"]))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("cost_s is not null").count() == 1
    df = spark.range(3)
    files.stage(df, str(tmp_path / "s"), {"size": 1})
    assert files.stage(spark.range(9), str(tmp_path / "s"), {"size": 1}).count() == 3
    with pytest.raises(ValueError):
        files.stage(df, str(tmp_path / "s"), {"size": 2})
    files.archive(df, str(tmp_path / "a"))
    assert spark.read.parquet(files.current(spark, str(tmp_path / "a"))).count() == 3
