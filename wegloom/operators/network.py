"""From ways, nodes and restrictions to the directed, cleaned road graph, with an audit of all that is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wegloom.functions import constants as C
from wegloom.functions import geo, tags
from wegloom.operators import zones
from wegloom.operators.components import components
from wegloom.plans.shared import materialize


def classified(ways: DataFrame, policy: tags.Policy = tags.road_policy) -> DataFrame:
    """ways (id, refs, tags) with `reason`; policy is any function from a tag map to a reason."""
    return ways.withColumn("reason", policy(F.col("tags")))


def policy_counts(ways: DataFrame, policy: tags.Policy = tags.road_policy) -> DataFrame:
    return classified(ways, policy).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def ways_touching(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways with at least one of the nodes."""
    refs = ways.select("id", F.explode("refs").alias("node"))
    return ways.join(refs.join(nodes.select(F.col("id").alias("node")), "node", "left_semi").select("id"), "id", "left_semi")


def in_box(nodes: DataFrame, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> DataFrame:
    return nodes.where(F.col("lon").between(min_lon, max_lon) & F.col("lat").between(min_lat, max_lat))


def segments(ways: DataFrame) -> DataFrame:
    """way_id, segment_index, a, b, tags for each pair of consecutive refs."""
    n = F.size("refs")
    return ways.where(n > 1).select(F.col("id").alias("way_id"), "tags", F.posexplode(F.expr("transform(sequence(1, size(refs) - 1), i -> struct(element_at(refs, i) a, element_at(refs, i + 1) b))")).alias("segment_index", "p")).select("way_id", "segment_index", F.col("p.a").alias("a"), F.col("p.b").alias("b"), "tags")


def located(segs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Segments with the coordinates and tags of both ends; null where a node is missing."""
    side = lambda s: nodes.select(F.col("id").alias(s), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"), F.col("tags").alias(f"{s}_tags"))
    return segs.join(side("a"), "a", "left").join(side("b"), "b", "left")


def segment_reason(inside: Column | None = None) -> Column:
    """Why a located segment is dropped, in order; null if it stays."""
    covered = F.lit(True) if inside is None else inside
    return (
        F.when(F.col("ax").isNull() | F.col("bx").isNull(), "segment_missing_outside_bbox")
        .when(tags.node_blocked(F.col("a_tags")) | tags.node_blocked(F.col("b_tags")), "barrier_or_node_access")
        .when(~covered, "outside_buffer")
        .when(geo.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= 0, "zero_length")
    )


def directed(kept: DataFrame) -> DataFrame:
    """One row for each allowed direction of the segments, with `reason` set where the speed tag can't be read."""
    d = kept.withColumn("direction", F.explode(tags.directions(F.col("tags"))))
    fwd = F.col("direction") == 1
    d = d.withColumns({
        "u": F.when(fwd, F.col("a")).otherwise(F.col("b")), "v": F.when(fwd, F.col("b")).otherwise(F.col("a")),
        "end_tags": F.when(fwd, F.col("b_tags")).otherwise(F.col("a_tags")), "speed_kmh": tags.edge_speed(F.col("tags"), F.col("direction")),
    })
    return d.withColumn("reason", F.when(F.col("speed_kmh").isNull(), "edge_unparsed_maxspeed").when(F.col("speed_kmh") <= 0, "no_speed"))


def edge_columns(d: DataFrame, *more: Column) -> DataFrame:
    return d.select(
        F.concat_ws(":", F.col("way_id").cast("string"), F.col("segment_index").cast("string"), F.col("direction").cast("string")).alias("id"),
        "u", "v", "way_id", "segment_index", "direction", geo.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("length_m"), tags.tag(F.col("tags"), "highway").alias("highway"), "speed_kmh",
        tags.signal(F.col("end_tags")).alias("signal_at_end"), tags.level_crossing(F.col("end_tags"), F.col("tags")).alias("rail_at_end"), *more,
    )


def split_restrictions(restrictions: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turn rules, audit) of restriction relations (id, tags, members).

    Relations with one from-way, one via-node and one to-way of a supported kind become rules; others ban their
    from-ways. Relations without a from-way among `ways`, without a kind, or with an exception for cars, are left out.
    """
    t = F.col("tags")
    pick = lambda kind, role: F.transform(F.filter("members", lambda m: (m["mtype"] == kind) & (m["role"] == role)), lambda m: m["mid"])
    r = restrictions.select("id", "tags", pick(1, "from").alias("fr"), pick(1, "to").alias("to"), pick(0, "via").alias("via"), pick(1, "via").alias("via_ways"))
    known = r.select("id", F.explode(F.col("fr").cast("array<string>")).alias("way")).join(ways.select(F.col("id").cast("string").alias("way")), "way", "left_semi").select("id").distinct()
    kind = tags.first_tag(t, "restriction:motorcar", "restriction:motor_vehicle", "restriction")
    excepted = F.arrays_overlap(F.split(tags.tag(t, "except", ""), ";"), F.array(*[F.lit(x) for x in C.TURN_EXCEPTIONS]))
    r = r.join(known, "id", "left_semi").withColumn("kind", kind).where(F.col("kind").isNotNull() & ~excepted)
    simple = (F.size("fr") == 1) & (F.size("to") == 1) & (F.size("via") == 1) & F.col("kind").isin(*C.TURN_KINDS) & ~tags.any_key(t, "conditional") & (F.size("via_ways") == 0)
    text = lambda c: F.element_at(c, 1).cast("string")
    rules = r.where(simple).select(text("fr").alias("from_way"), text("to").alias("to_way"), text("via").alias("via"), F.col("kind").alias("restriction"), F.col("id").cast("string").alias("osm_relation"))
    audit = r.select(F.col("id").cast("string").alias("id"), F.when(simple, "turn_state_rule").otherwise("exclude_from_ways_conservatively").alias("action"), F.when(~simple, F.col("fr")).alias("from"))
    return rules, audit


def in_region(placed: DataFrame, index: DataFrame, reach: float) -> DataFrame:
    """Located segments with `covered`: whether all of a segment is in a region or within `reach` of it (the index of
    zones.region_index). Segments with a missing end are not covered."""
    ends = [F.col(c).alias(n) for c, n in (("ax", "x0"), ("ay", "y0"), ("bx", "x1"), ("by", "y1"))]
    found = zones.covered(placed.select("way_id", "segment_index", *ends), index, reach, ["way_id", "segment_index"])
    return placed.join(found.withColumn("covered", F.lit(True)), ["way_id", "segment_index"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def build_edges(ways: DataFrame, nodes: DataFrame, banned: DataFrame | None = None, inside: Column | None = None, region: tuple[DataFrame, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, audit counts). ways: allowed ways (id, refs, tags); nodes: id, x, y, tags; banned: way ids; region: index
    and reach as for in_region, segments outside are dropped, or else inside: a condition of one's own."""
    if banned is not None:
        ways = ways.join(banned.select("id").distinct(), "id", "left_anti")
    placed = located(segments(ways), nodes)
    if region is not None:
        placed, inside = materialize(in_region(placed, *region), "placed"), F.col("covered")
    whole = placed.withColumn("reason", segment_reason(inside))
    rows = directed(whole.where("reason is null").drop("reason"))
    audit = whole.where("reason is not null").select("reason").union(rows.where("reason = 'edge_unparsed_maxspeed'").select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return edge_columns(rows.where("reason is null")), audit


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("v").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))


def weak_components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node), size."""
    c = components(edges, "u", "v")
    return c.join(c.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component")


def main_component(weak: DataFrame) -> DataFrame:
    """Nodes of the largest component; of equal ones that with the smallest node."""
    top = weak.select("component", "size").distinct().orderBy(F.desc("size"), "component").limit(1)
    return weak.join(top.select("component"), "component", "left_semi").select("node")


def nearest_nodes(points: DataFrame, nodes: DataFrame, reach: float = C.HOSPITAL_GAP_M) -> DataFrame:
    """points (point_id, px, py, ...) with their nearest node (node, x, y): road_node, gap_m; the smaller node of ties.

    Nodes are met over grid cells of a size of which each has two on average (`reach` at most), so only pairs in
    neighbouring cells are made, few for each point however many nodes there are; points without a node so near are met,
    in rings of cells four times as wide, until each has one. Saved tables are small for what they hold in memory, so none
    is left to be broadcast by its estimate.
    """
    found, left = None, points
    spread = points.agg(F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1")).crossJoin(nodes.agg(F.min("x").alias("a0"), F.max("x").alias("a1"), F.min("y").alias("b0"), F.max("y").alias("b1"), F.count("x").alias("n"))).first()
    if spread is None or spread["x0"] is None or spread["a0"] is None:
        return points.withColumns({"road_node": F.lit(None).cast(dict(nodes.dtypes)["node"]), "gap_m": F.lit(None).cast("double")})
    span = max(spread["x1"], spread["a1"]) - min(spread["x0"], spread["a0"]) + max(spread["y1"], spread["b1"]) - min(spread["y0"], spread["b0"])
    size = (2 * (spread["a1"] - spread["a0"]) * (spread["b1"] - spread["b0"]) / spread["n"]) ** 0.5
    size = max(reach / 64, size) if size < reach else reach
    while left is not None:
        around = left.select("*", F.explode(geo.cells(F.col("px") - size, F.col("px") + size, F.col("py") - size, F.col("py") + size, size)).alias("c"))
        own = nodes.select("node", "x", "y", F.struct(geo.cell(F.col("x"), size).alias("cx"), geo.cell(F.col("y"), size).alias("cy")).alias("c"))
        gap = geo.distance(F.col("px"), F.col("py"), F.col("x"), F.col("y"))
        near = around.join(own.hint("merge"), "c").withColumn("gap", gap).where(F.col("gap") <= size).groupBy("point_id").agg(F.min(F.struct("gap", "node")).alias("best"))
        got = materialize(near.select("point_id", F.col("best.node").alias("road_node"), F.col("best.gap").alias("gap_m")), "near")
        found = got if found is None else found.unionByName(got)
        if size > span:
            break
        size *= 4
        left = materialize(left.join(got.hint("merge"), "point_id", "left_anti"), "left")
        if not left.limit(1).count():
            break
    return points.join(found.hint("merge"), "point_id", "left")


def map_hospitals(hospitals: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """hospitals (point_id, name, px, py) with road_node, gap_m (to 2 digits), in_largest_component and status."""
    used = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().join(nodes.select(F.col("id").alias("node"), "x", "y"), "node")
    near = nearest_nodes(hospitals, used)
    main = main_component(weak_components(edges)).withColumn("main", F.lit(True))
    d = near.join(main.withColumnRenamed("node", "road_node"), "road_node", "left").join(in_degree(edges).withColumnRenamed("node", "road_node"), "road_node", "left")
    good = (F.col("gap_m") <= C.HOSPITAL_GAP_M) & F.col("main").isNotNull() & (F.coalesce("in_degree", F.lit(0)) > 0)
    return d.select("point_id", "name", "road_node", geo.rounded(F.col("gap_m"), 2).alias("gap_m"), F.when(good, "road_point_proxy").otherwise("requires_review").alias("status"), F.col("main").isNotNull().alias("in_largest_component"))


def goals(mapping: DataFrame) -> DataFrame:
    """node, hospitals: names in the order of point_id."""
    m = mapping.where("status = 'road_point_proxy'")
    return m.groupBy(F.col("road_node").alias("node")).agg(F.transform(F.sort_array(F.collect_list(F.struct("point_id", "name"))), lambda s: s["name"]).alias("hospitals"))


def override_goals(goal: DataFrame, overrides: DataFrame, edges: DataFrame) -> DataFrame:
    """Goals with overrides (node, name) added; running it again changes nothing. A node without incoming edge is an
    error when the rows are read."""
    checked = overrides.join(in_degree(edges), "node", "left").select("node", F.when(F.col("in_degree").isNull(), F.raise_error(F.lit("goal override has no incoming edge")).cast("string")).otherwise(F.col("name")).alias("name"))
    rows = goal.select("node", F.posexplode("hospitals").alias("i", "name")).unionByName(checked.select("node", F.lit(1 << 30).alias("i"), "name"))
    first = rows.groupBy("node", "name").agg(F.min("i").alias("i"))
    return first.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "name"))), lambda s: s["name"]).alias("hospitals"))


def network_report(edges: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """One row of counts over the graph."""
    weak = weak_components(edges)
    a = edges.agg(F.count(F.lit(1)).alias("directed_edges"), F.countDistinct("way_id").alias("ways"))
    b = weak.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("component").alias("weak_components"), F.max("size").alias("largest_component_nodes"))
    out = a.crossJoin(b)  # one row each
    if mapping is not None:
        out = out.crossJoin(mapping.agg(F.count(F.lit(1)).alias("hospital_candidates"), F.count_if(F.col("status") == "road_point_proxy").alias("hospital_road_proxies"), F.count_if(F.col("status") == "requires_review").alias("hospitals_need_review")))
    return out


def graph_faults(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, fault for each breach: repeated ids, bad coordinates, lengths under the chord, unknown classes."""
    side = lambda s: nodes.select(F.col("id").alias(s), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"))
    e = edges.join(side("u"), "u", "left").join(side("v"), "v", "left").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("id")))
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    fault = (
        F.when(F.col("_n") > 1, "edge id is not unique")
        .when(bad("ux") | bad("uy") | bad("vx") | bad("vy"), "coordinates are no finite pair")
        .when(~F.col("highway").isin(*C.SPEED_KMH), "unknown road class")
        .when(bad("length_m") | (F.col("length_m") < 0), "length is not valid")
        .when(F.col("length_m") + 1e-8 < geo.distance(F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy")), "length is below the straight distance")
    )
    return e.select("id", fault.alias("fault")).where("fault is not null")
