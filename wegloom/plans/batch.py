"""A batch of places by all scenarios: places are looked up by name, moved onto a road, and routed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wegloom.functions import constants as C
from wegloom.functions import geo
from wegloom.operators import catalog, network, origin, poi, turns


def located(specs: DataFrame, places: DataFrame) -> DataFrame:
    """specs (point_id, name, lat, lon, near_lat) with the coordinates given, or else those of the first place (seq,
    name, lat, lon) of exactly this name, of several that nearest to near_lat; source is 'given', 'place' or null
    where there is none."""
    near = F.coalesce(F.abs(F.col("p_lat") - F.col("near_lat")), F.lit(0.0))
    p = places.select("name", "seq", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    asked = specs.where("lat is null or lon is null")
    first = asked.join(p, "name").groupBy("point_id").agg(F.min(F.struct(near.alias("far"), "seq", "p_lat", "p_lon")).alias("b"))
    given = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    d = specs.join(first, "point_id", "left").withColumn("source", F.when(given, "given").when(F.col("b").isNotNull(), "place"))
    return d.withColumns({"lat": F.when(given, F.col("lat")).otherwise(F.col("b.p_lat")), "lon": F.when(given, F.col("lon")).otherwise(F.col("b.p_lon"))}).drop("b")


def origins(points: DataFrame, access: DataFrame) -> DataFrame:
    """located points with px, py: coordinates given stay; places move onto the nearest open road within 350 m."""
    xy = geo.utm_forward(F.col("lon"), F.col("lat"))
    p = points.where("source is not null").withColumns({"px": xy["x"], "py": xy["y"]}).where("px is not null")
    moved = catalog.choose_origins(access, p.where("source = 'place'").select("point_id", "px", "py")).select("point_id", "x", "y", F.col("gap").alias("to_road_m"))
    d = p.join(moved, "point_id", "left")
    return d.select("point_id", F.coalesce("x", "px").alias("px"), F.coalesce("y", "py").alias("py"), "to_road_m")


def prepared(
    points: DataFrame, access: DataFrame, strict: DataFrame, costs: DataFrame, goals: DataFrame, rules: list[DataFrame], overrides: DataFrame | None = None, features: DataFrame | None = None,
    radius: float = C.ACCESS_RADIUS_M, most_gap: float = C.PREPARE_SNAP_M,
) -> DataFrame:
    """Routes of points with all that belongs to them: the catalog near them, zones of the features (kind, rings), rules of
    all sources once, and goals with the overrides. costs: priced with the exposure to the same features."""
    if overrides is not None:
        goals = network.override_goals(goals, overrides, costs)
    radii = poi.radii(points.sparkSession) if features is not None else None
    return origin.route_points(points, access, strict, costs, goals, turns.merged_rules(*rules) if rules else None, features, radii, radius=radius, most_gap=most_gap)


def cases(specs: DataFrame, places: DataFrame, access: DataFrame, strict: DataFrame, costs: DataFrame, goals: DataFrame, rules: list[DataFrame], overrides: DataFrame | None = None, features: DataFrame | None = None) -> DataFrame:
    """A row for each spec and scenario, with case ids U01, U02, ... by point_id, from 0 on, and the order of scenarios.

    Columns: case_id, location_id, point_id, name, scenario, lat, lon, source, to_road_m, goal, hospital, cost_s,
    length_m, agree, status: 'no such place' where neither coordinates nor a place are known.
    """
    at = located(specs, places)
    start = origins(at, access)
    found = prepared(start.select("point_id", "px", "py"), access, strict, costs, goals, rules, overrides, features)
    every = specs.sparkSession.createDataFrame(list(enumerate(C.SCENARIOS)), "ordinal int, scenario string")
    numbered = at.withColumn("n", F.col("point_id") + 1).crossJoin(F.broadcast(every))  # the scenarios are four
    d = numbered.join(start.select("point_id", "to_road_m"), "point_id", "left").join(found.select("point_id", "scenario", "goal", "hospital", "cost_s", "length_m", "agree", F.col("status").alias("_status")), ["point_id", "scenario"], "left")
    label = lambda letter, n: F.concat(F.lit(letter), F.lpad(n.cast("string"), F.greatest(F.lit(2), F.length(n.cast("string"))), F.lit("0")))
    status = F.when(F.col("source").isNull(), "no such place").otherwise(F.coalesce("_status", F.lit("outside the zone")))
    return d.select(
        label("U", (F.col("n") - 1) * len(C.SCENARIOS) + F.col("ordinal") + 1).alias("case_id"), label("L", F.col("n")).alias("location_id"), "point_id", "name", "scenario", "lat", "lon", "source", "to_road_m", "goal", "hospital", "cost_s", "length_m", "agree", status.alias("status"),
    )
