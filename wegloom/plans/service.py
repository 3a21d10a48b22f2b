"""Requests of a service, answered from tables: health, start-up map, viewport, places, coordinates, routes."""

from __future__ import annotations

import gzip
import json
import math
import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wegloom.functions import constants as C
from wegloom.functions import geo
from wegloom.operators import catalog, origin, places

MOST_BODY, GZIP_FROM, OVERVIEW_FROM_M, MAP_RADIUS_M = 4096, 50_000, 6500.0, 1800.0


class BadRequest(ValueError):
    pass


@dataclass
class Service:
    """Tables kept by the session, and a router that takes one request at a time.

    costs: the graph's priced edges; tail: its saved distances to the goals (search.to_goals); rules: turn rules; features
    and radii: what the overlay of a point is exposed to.
    """

    spark: SparkSession
    access: DataFrame
    major: DataFrame
    strict: DataFrame
    nodes: DataFrame
    goals: DataFrame
    place_index: DataFrame
    costs: DataFrame
    tail: DataFrame | None = None
    rules: DataFrame | None = None
    features: DataFrame | None = None
    radii: DataFrame | None = None
    centre: tuple[float, float] = (430964.9, 9141512.7)
    _busy: threading.Lock = field(default_factory=threading.Lock)

    def segments(self, x: float, y: float, radius: float, overview: bool) -> DataFrame:
        return catalog.in_radius(self.major, x, y, radius, C.MAJOR_CELL_M) if overview else catalog.in_radius(self.access, x, y, radius)

    def map(self, x: float, y: float, radius: float = MAP_RADIUS_M, overview: bool = False) -> dict:
        """A viewport: roads, the nearest labels, goals in sight. Answers are as large as the viewport."""
        s = self.segments(x, y, radius, overview)
        near = self.goals.join(self.nodes.select(F.col("id").alias("node"), "x", "y"), "node").where(geo.distance(F.col("x"), F.col("y"), F.lit(x), F.lit(y)) < radius * 1.5)
        return {
            "center": [x, y], "radius": radius, "overview": overview, "roads": [r.asDict() for r in catalog.road_map(s).collect()], "labels": [r.asDict() for r in catalog.labels(s, x, y).collect()],
            "hospitals": [{"xy": [r["x"], r["y"]], "name": ", ".join(r["hospitals"])} for r in near.collect()], "goal_count": self.goals.count(),
        }

    def viewport(self, x: float, y: float, width: float, height: float) -> dict:
        size = max(width, height)
        return self.map(x, y, max(500.0, 0.65 * size), size > OVERVIEW_FROM_M)

    def locations(self, query: str) -> dict:
        found = places.search(self.place_index, query).collect()  # at most twelve
        return {"results": [{k: v for k, v in r.asDict().items() if k not in ("key", "name_key", "alias_keys", "total")} for r in found], "total": found[0]["total"] if found else 0, "indexed": self.place_index.count()}

    def coordinate(self, x: float, y: float) -> dict:
        r = self.spark.range(1).select(geo.utm_inverse(F.lit(x), F.lit(y)).alias("p")).first()["p"]
        if r is None:
            raise BadRequest("outside the zone")
        return {"lon": r["lon"], "lat": r["lat"]}

    def route(self, lat: float, lon: float, scenario: str) -> dict:
        if not (math.isfinite(lat) and math.isfinite(lon)) or scenario not in C.SCENARIOS:
            raise BadRequest("coordinate or scenario is not valid")
        p = self.spark.range(1).select(F.lit(0).cast("bigint").alias("point_id"), geo.utm_forward(F.lit(lon), F.lit(lat)).alias("p")).select("point_id", F.col("p.x").alias("px"), F.col("p.y").alias("py"))
        found = origin.route_points(p, self.access, self.strict, self.costs, self.goals, self.rules, self.features, self.radii, self.tail)
        r = found.where(F.col("scenario") == scenario).first().asDict(True)  # one row
        if r["status"] != "ok":
            raise BadRequest(r["status"])
        if not r["agree"]:
            raise RuntimeError("the path's edges don't add up to its cost")
        return {"scenario": scenario, "route": r, "algorithms": [{"algorithm": "relaxation", "cost_s": r["cost_s"]}]}


def origin_ok(origin_: str | None, host: str | None) -> bool:
    return origin_ is None or (host is not None and origin_.split("://")[-1] == host)


def dispatch(service: Service, method: str, path: str, body: bytes = b"", origin_: str | None = None, host: str | None = None) -> tuple[int, dict]:
    """(status, answer) of a request; one route at a time, others get 409."""
    try:
        if not origin_ok(origin_, host):
            return 403, {"error": "another origin"}
        if method == "GET":
            if path == "/api/health":
                return 200, {"ok": True}
            if path == "/api/bootstrap":
                return 200, service.map(*service.centre)
            return 404, {"error": "no such path"}
        if not 0 < len(body) <= MOST_BODY:
            raise BadRequest("a body has 1 to 4096 bytes")
        d = json.loads(body)
        if path == "/api/map-view":
            v = [float(d[k]) for k in ("x", "y", "width", "height")]
            if not all(map(math.isfinite, v)):
                raise BadRequest("numbers have to be finite")
            return 200, service.viewport(*v)
        if path == "/api/locations":
            return 200, service.locations(str(d["query"]))
        if path == "/api/map":
            return 200, service.map(float(d["x"]), float(d["y"]))
        if path == "/api/coordinate":
            return 200, service.coordinate(float(d["x"]), float(d["y"]))
        if path == "/api/route":
            if not service._busy.acquire(blocking=False):
                return 409, {"error": "a route is being computed"}
            try:
                return 200, service.route(float(d["lat"]), float(d["lon"]), d["scenario"])
            finally:
                service._busy.release()
        return 404, {"error": "no such path"}
    except (ValueError, KeyError, TypeError) as e:
        return 422, {"error": str(e)}
    except Exception as e:
        return 500, {"error": str(e)}


def encode(answer: dict, accepts_gzip: bool = True) -> tuple[bytes, list[tuple[str, str]]]:
    """JSON bytes and headers; large answers are compressed, not-a-number is an error."""
    data = json.dumps(answer, ensure_ascii=False, allow_nan=False).encode()
    headers = [("Content-Type", "application/json; charset=utf-8"), ("Cache-Control", "no-store"), ("X-Content-Type-Options", "nosniff")]
    if accepts_gzip and len(data) > GZIP_FROM:
        data = gzip.compress(data)
        headers.append(("Content-Encoding", "gzip"))
    return data, [*headers, ("Content-Length", str(len(data)))]


def wsgi(service: Service):
    """A WSGI application over dispatch."""
    names = {200: "OK", 403: "Forbidden", 404: "Not Found", 409: "Conflict", 422: "Unprocessable Entity", 500: "Internal Server Error"}

    def app(env, start):
        size = int(env.get("CONTENT_LENGTH") or 0)
        body = env["wsgi.input"].read(min(size, MOST_BODY + 1)) if size else b""
        status, answer = dispatch(service, env["REQUEST_METHOD"], env["PATH_INFO"], body, env.get("HTTP_ORIGIN"), env.get("HTTP_HOST"))
        data, headers = encode(answer, "gzip" in env.get("HTTP_ACCEPT_ENCODING", ""))
        start(f"{status} {names[status]}", headers)
        return [data]

    return app
