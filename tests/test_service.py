"""Requests of the service over a small network, by the dispatcher and by WSGI."""

import gzip
import io
import json

import pytest
from pyspark.sql import functions as F

from wegloom.functions import geo
from wegloom.operators import catalog, costs, network, origin, places, search, turns
from wegloom.plans import batch, service

X, Y = 430964.9, 9141512.7


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    place = [(1, 0.0, 0.0, {}), (2, 600.0, 0.0, {}), (3, 600.0, 500.0, {})]
    nodes = spark.createDataFrame([(i, X + x, Y + y, t) for i, x, y, t in place], "id bigint, x double, y double, tags map<string,string>")
    ways = spark.createDataFrame([(10, [1, 2], {"highway": "primary", "name": "Jl. A"}), (11, [2, 3], {"highway": "tertiary", "name": "Jl. B"})], "id bigint, refs array<bigint>, tags map<string,string>")
    cat = catalog.build_catalog(ways, nodes)
    text_nodes = nodes.withColumn("id", F.col("id").cast("string"))
    edges = network.build_edges(ways, nodes)[0].withColumns({k: F.col(k).cast("string") for k in ("u", "v", "way_id")})
    c = costs.edge_costs(edges).cache()
    goals = spark.createDataFrame([("3", ["RS Satu"])], "node string, hospitals array<string>")
    folder = str(tmp_path_factory.mktemp("catalog"))
    catalog.write_catalog(origin.segment_structs(cat), f"{folder}/access")
    catalog.write_major(cat, f"{folder}/major")
    read = lambda path: catalog.read_catalog(spark, path)
    strict = catalog.celled(origin.strict_segments(edges, text_nodes, ways.select(F.col("id").cast("string").alias("way_id"), "tags")))
    index = places.index(spark.createDataFrame([(0, "Pasar Satu", "place", -7.77, 110.37, "Café", None)], "seq bigint, name string, kind string, lat double, lon double, aliases string, address string"))
    tail = search.to_goals(c, turns.transitions(edges), goals)
    return service.Service(spark, read(f"{folder}/access"), read(f"{folder}/major"), strict, text_nodes, goals, index, c, tail)


def ask(served, path, **body):
    return service.dispatch(served, "POST", path, json.dumps(body).encode())


def test_reads(served):
    assert service.dispatch(served, "GET", "/api/health") == (200, {"ok": True})
    status, start = service.dispatch(served, "GET", "/api/bootstrap")
    assert status == 200 and len(start["roads"]) == 2 and start["goal_count"] == 1 and start["hospitals"][0]["name"] == "RS Satu"
    assert {x["name"] for x in start["labels"]} == {"Jl. A", "Jl. B"}
    assert service.dispatch(served, "GET", "/api/none")[0] == 404 and service.dispatch(served, "GET", "/api/health", origin_="http://a", host="b")[0] == 403
    near, far = ask(served, "/api/map-view", x=X, y=Y, width=900, height=400)[1], ask(served, "/api/map-view", x=X, y=Y, width=9000, height=400)[1]
    assert not near["overview"] and near["radius"] == 585 and far["overview"] and len(far["roads"]) == 2
    assert ask(served, "/api/map", x=X + 9e4, y=Y)[1]["roads"] == []
    at = ask(served, "/api/coordinate", x=X, y=Y)[1]
    assert at["lon"] == pytest.approx(110.3739, abs=1e-3) and ask(served, "/api/coordinate", x=0, y=0)[0] == 422
    found = ask(served, "/api/locations", query="cafe")[1]
    assert found["total"] == found["indexed"] == 1 and found["results"][0]["name"] == "Pasar Satu" and "key" not in found["results"][0]
    assert ask(served, "/api/locations", query="x")[0] == 422 and ask(served, "/api/locations", query="unknown")[1]["total"] == 0
    assert ask(served, "/api/map", x="nan", y=0)[0] in (422, 500) and ask(served, "/api/none")[0] == 404 and service.dispatch(served, "POST", "/api/map", b"x" * 5000)[0] == 422


def test_routes(served, spark):
    p = spark.range(1).select(geo.utm_inverse(F.lit(X + 100.0), F.lit(Y + 2.0)).alias("p")).first()["p"]
    status, got = ask(served, "/api/route", lat=p["lat"], lon=p["lon"], scenario="pagi")
    assert status == 200 and got["route"]["goal"] == "3" and got["route"]["cost_s"] == pytest.approx(500 / (40 / 3.6) + 500 / (30 / 3.6), rel=1e-6)
    assert got["route"]["edges"] == ["snap:10:0:1", "11:0:1"] and got["route"]["length_m"] == pytest.approx(1000) and got["route"]["road_name"] == "Jl. A" and got["route"]["hospital"] == "RS Satu"
    assert ask(served, "/api/route", lat=p["lat"], lon=p["lon"], scenario="never")[0] == 422 and ask(served, "/api/route", lat=-7.0, lon=110.0, scenario="pagi")[0] == 422
    with served._busy:
        assert ask(served, "/api/route", lat=p["lat"], lon=p["lon"], scenario="pagi")[0] == 409


def test_wsgi(served):
    sent = {}
    app = service.wsgi(served)
    body = json.dumps({"query": "pasar"}).encode()
    env = {"REQUEST_METHOD": "POST", "PATH_INFO": "/api/locations", "CONTENT_LENGTH": str(len(body)), "wsgi.input": io.BytesIO(body)}
    data = b"".join(app(env, lambda status, headers: sent.update(status=status, headers=dict(headers))))
    assert sent["status"] == "200 OK" and json.loads(data)["total"] == 1 and sent["headers"]["Content-Length"] == str(len(data))
    large, headers = service.encode({"x": "y" * 60_000})
    assert dict(headers)["Content-Encoding"] == "gzip" and json.loads(gzip.decompress(large))["x"][:2] == "yy"
    with pytest.raises(ValueError):
        service.encode({"x": float("nan")})


def test_batch(served, spark):
    c = spark.range(1).select(geo.utm_inverse(F.lit(X + 100.0), F.lit(Y + 2.0)).alias("p")).first()["p"]
    index = spark.createDataFrame([(0, "Pasar Satu", -7.0, 110.0), (1, "Pasar Satu", c["lat"], c["lon"])], "seq bigint, name string, lat double, lon double")
    specs = [(0, "here", c["lat"], c["lon"], None), (1, "Pasar Satu", None, None, c["lat"]), (2, "Nowhere", None, None, None)]
    specs = spark.createDataFrame(specs, "point_id bigint, name string, lat double, lon double, near_lat double")
    features = spark.createDataFrame([("school", [[(X + 300.0, Y)]]), ("school", [[(X + 9e4, Y)]])], "kind string, rings array<array<struct<x:double,y:double>>>")
    extra = spark.createDataFrame([("2", "Override")], "node string, name string")
    none = spark.createDataFrame([], "from_way string, to_way string, via string, restriction string")
    school = F.when(F.col("way_id") == "10", F.create_map(*[F.lit(x) for kv in {"pagi": 40.0, "siang": 30.0, "sore": 10.0, "malam": 0.0}.items() for x in kv])[F.col("scenario")]).otherwise(0.0)
    priced = served.costs.withColumns({"poi_s": F.col("poi_s") + school, "cost_s": F.col("cost_s") + school})  # the whole way's 200 m in the zone
    got = batch.cases(specs, index, served.access, served.strict, priced, served.goals, [none, none], extra, features).collect()
    at = {(r["point_id"], r["scenario"]): r for r in got}
    assert len(got) == 12 and {r["case_id"] for r in got} == {f"U{i:02d}" for i in range(1, 13)} and at[1, "siang"]["case_id"] == "U06" and at[1, "siang"]["location_id"] == "L02"
    assert at[0, "pagi"]["source"] == "given" and at[1, "pagi"]["source"] == "place" and at[1, "pagi"]["to_road_m"] == pytest.approx(2, abs=0.01)
    assert {(r["status"], r["goal"], r["agree"]) for r in got if r["point_id"] < 2} == {("ok", "2", True)} and {r["status"] for r in got if r["point_id"] == 2} == {"no such place"}
    # 500 m of primary road and, by the scenario's price, the 200 m of it in the school's zone
    assert at[0, "malam"]["cost_s"] == pytest.approx(500 / (40 / 3.6)) and at[0, "pagi"]["cost_s"] == pytest.approx(500 / (40 / 3.6) + 2 * 20)
