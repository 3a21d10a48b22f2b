"""A road network derived from the part, orders, lineitem, supplier and customer tables, for queries over them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wegloom.functions import tags
from wegloom.operators import costs, network, poi
from wegloom.plans.shared import materialize

CLASSES = {"1-URGENT": "primary", "2-HIGH": "secondary", "3-MEDIUM": "tertiary", "4-NOT SPECIFIED": "residential", "5-LOW": "service"}
GOAL_SIZE = 11


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tag_map(**values) -> "F.Column":
    """A map of the values that are not null."""
    entries = F.array(*[F.struct(F.lit(k.replace("__", ":")).alias("key"), v.alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, tags from parts."""
    p, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        p.alias("id"), ((p * 7919) % 10007).cast("double").alias("x"), ((p * 104729) % 10009).cast("double").alias("y"),
        tag_map(
            highway=F.when(F.col("p_brand") == "Brand#1", "traffic_signals"), railway=F.when((F.col("p_type") == "PROMO") & (size <= 10), "level_crossing"),
            barrier=F.when(size == 7, "gate").when(size == 8, "bollard"), access=F.when(size == 9, "private"),
        ).alias("tags"), F.col("p_name").alias("name"), size.alias("size"),
    )


def way_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, tags from orders."""
    c = F.col("o_custkey")
    highway = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])[F.col("o_orderpriority")]
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        tag_map(
            highway=highway, oneway=F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "no").otherwise("-1"), name=F.concat(F.lit("Jl. "), F.lpad((c % 97).cast("string"), 2, "0")),
            width=F.when(c % 5 == 0, "3.5").when(c % 5 == 1, "2.8 m").when(c % 5 == 2, "wide"), access=F.when(c % 13 == 0, "private"), access__conditional=F.when(c % 17 == 0, "no @ night"), surface=F.when(c % 19 == 0, "mud"),
            maxheight=F.when(c % 23 == 0, "3"), construction=F.when(c % 29 == 0, "minor"), maxspeed=F.when(c % 7 == 0, "30").when(c % 7 == 1, "20 mph").when(c % 7 == 2, "walk"), bridge=F.when(c % 11 == 0, "yes"),
        ).alias("tags"),
    )


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, refs, tags: an order's parts in the order of its lines."""
    keys = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    refs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct(*keys))), lambda s: s["l_partkey"]).alias("refs"))
    return way_tags(spark, sf_dir).join(refs, "id").select("id", "refs", "tags")


def allowed_ways(spark: SparkSession, sf_dir: str, policy: tags.Policy = tags.road_policy) -> DataFrame:
    return network.classified(ways(spark, sf_dir), policy).where("reason = 'allowed'").drop("reason")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.build_edges(allowed_ways(spark, sf_dir), nodes(spark, sf_dir))[0]


def saved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(edges(spark, sf_dir), "edges")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, x, y from suppliers."""
    return sites_of(table(spark, sf_dir, "supplier")).select("kind", "x", "y")


def sites_of(suppliers: DataFrame) -> DataFrame:
    s = F.col("s_suppkey")
    kind = F.element_at(F.array(F.lit("school"), F.lit("market"), F.lit("mall")), F.col("s_nationkey") % 3 + 1)
    return suppliers.select(s, kind.alias("kind"), ((s * 6151) % 10007).cast("double").alias("x"), ((s * 3079) % 10009).cast("double").alias("y"))


def shaped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with the coordinates of their ends and whether they are on a bridge or in a tunnel."""
    at = lambda n, s: nodes(spark, sf_dir).select(F.col("id").alias(n), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"))
    apart = way_tags(spark, sf_dir).select(F.col("id").alias("way_id"), tags.grade_separated(F.col("tags")).alias("separated"))
    return saved_edges(spark, sf_dir).join(at("u", "a"), "u").join(at("v", "b"), "v").join(apart, "way_id")


def priced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge costs by scenario, exposure included."""
    return costs.edge_costs(poi.with_exposure(shaped_edges(spark, sf_dir), sites(spark, sf_dir)))


def goals(spark: SparkSession, sf_dir: str, e: DataFrame) -> DataFrame:
    """node, hospitals: parts of one size that edges lead to."""
    return nodes(spark, sf_dir).where(F.col("size") == GOAL_SIZE).select(F.col("id").alias("node"), F.array("name").alias("hospitals")).join(e.select(F.col("v").alias("node")).distinct(), "node")


def turn_rules(e: DataFrame) -> DataFrame:
    """from_way, to_way, via, restriction for every seventh pair of a way and its node."""
    to = e.groupBy(F.col("u").alias("via")).agg(F.min("way_id").alias("to_way"))
    r = e.select(F.col("v").alias("via"), F.col("way_id").alias("from_way")).distinct().where((F.col("via") + F.col("from_way")) % 7 == 0).join(to, "via")
    k = F.col("from_way") % 4
    kind = F.when(k == 0, "no_left_turn").when(k == 1, "no_u_turn").when(k == 2, "only_right_turn").otherwise("no_straight_on")
    return r.select("from_way", F.when(k == 1, F.col("from_way")).otherwise(F.col("to_way")).alias("to_way"), "via", kind.alias("restriction"))


def area_objects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(objects, members, way_refs, locations) as polygons.areas takes them, from customers: rectangles whose outlines
    are cut into open ways, of either direction, with holes; and one of every fault, by c_custkey % 19."""
    c = F.col("c_custkey")
    k = c % 19
    x, y, w, h = (c % 1000) * 200, F.floor(c / 1000) * 200, 40 + c % 7 * 10, 30 + c % 5 * 10
    at = lambda a, b: F.struct(a.cast("bigint").alias("x"), b.cast("bigint").alias("y"))

    def halves(x, y, w, h, role: str):
        """A rectangle as two open ways, both from the first corner to the third."""
        a, b, c, d = at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h)
        return [F.struct(F.lit(role).alias("role"), F.array(a, b, c).alias("line")), F.struct(F.lit(role).alias("role"), F.array(a, d, c).alias("line"))]

    def ring(x, y, w, h, role: str):
        return F.struct(F.lit(role).alias("role"), F.array(at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h), at(x, y)).alias("line"))

    one = lambda role, *points: F.struct(F.lit(role).alias("role"), F.array(*points).alias("line"))
    outer, inner = halves(x, y, w, h, "outer"), halves(x + 5, y + 5, F.lit(10), F.lit(10), "inner")
    tail = one("outer", at(x + w, y + h), at(x + w + 5, y + h + 5))
    cases = {
        0: [*outer, *inner], 1: outer[::-1], 2: [*outer, tail], 3: outer[:1], 4: [*outer, *halves(x + w - 5, y + 5, F.lit(10), F.lit(10), "inner")], 5: [*outer, inner[0]],
        6: [*outer, ring(x, y, w, h, "inner")], 7: [*outer, one("entrance", at(x, y), at(x + 1, y))], 8: outer, 9: [*outer, one("outer", at(x, y), at(F.lit(-1), F.lit(-1)))], 10: [ring(x, y, w, h, "")],
        11: [one("", at(x, y), at(x + w, y + h), at(x + w, y), at(x, y + h), at(x, y))], 12: [one("", at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h))], 13: outer, 14: [*outer, ring(x + w / 2, y + h / 2, w, h, "")],
        15: [*outer, *inner, one("inner", at(x + 15, y + 15), at(x + 17, y + 17))], 16: inner, 17: [], 18: [*outer, ring(x + 1, y + 1, F.lit(3), F.lit(3), "outer"), one("balcony", at(x, y), at(x + 9, y + 9))],
    }
    empty = F.array().cast("array<struct<role:string,line:array<struct<x:bigint,y:bigint>>>>")
    kind = F.when(k == 17, "node").when(k.between(10, 12), "way").otherwise("relation")
    customers = table(spark, sf_dir, "customer")
    parts = [customers.where(k == i).select(c.alias("c"), k.alias("k"), kind.alias("osm_type"), x.alias("x"), y.alias("y"), (F.array(*v) if v else empty).alias("lines")) for i, v in cases.items()]
    d = materialize(functools.reduce(DataFrame.union, parts), "areas")
    node = lambda p: p["x"] * 10_000_000 + p["y"]
    way = d.select("c", "osm_type", "k", F.posexplode("lines").alias("j", "l"))
    way_id = F.when(F.col("osm_type") == "way", F.col("c")).otherwise(-(F.col("c") * 10 + F.col("j")))
    objects = d.select("osm_type", F.when(F.col("k") == 17, F.col("x") * 10_000_000 + F.col("y")).otherwise(F.col("c")).alias("id"), F.element_at(F.array(F.lit("school"), F.lit("market"), F.lit("mall")), (F.col("c") % 3 + 1).cast("int")).alias("kind"), F.col("c").cast("string").alias("name"), tag_map(type=F.when(F.col("k") == 13, "site").otherwise("multipolygon")).alias("tags"))
    members = way.where("osm_type = 'relation'").select(F.col("c").alias("id"), F.lit(1).alias("mtype"), way_id.alias("mid"), F.col("l.role").alias("role"), F.col("j").alias("pos"))
    members = members.unionByName(d.where("k = 8").select(F.col("c").alias("id"), F.lit(2).alias("mtype"), F.col("c").alias("mid"), F.lit("outer").alias("role"), F.lit(9).alias("pos")))
    refs = way.select(way_id.alias("way"), F.posexplode("l.line").alias("pos", "p")).select("way", "pos", node(F.col("p")).alias("node"), F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    own = d.where("k = 17").select((F.col("x") * 10_000_000 + F.col("y")).alias("node"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    locations = refs.where("px >= 0").select("node", F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y")).union(own).distinct()
    return objects, members, refs.select("way", "pos", "node"), locations


def wide_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, rings from suppliers: rectangles, most of them wider than their kind's radius."""
    s = F.col("s_suppkey")
    w, h = (200 + s % 7 * 150).cast("double"), (150 + s % 5 * 200).cast("double")
    d = sites_of(table(spark, sf_dir, "supplier")).withColumns({"w": w, "h": h})
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y = F.col("x"), F.col("y")
    ring = F.array(at(x, y), at(x + F.col("w"), y), at(x + F.col("w"), y + F.col("h")), at(x, y + F.col("h")), at(x, y))
    return d.select("kind", F.array(ring).alias("rings"))


REGION, REGION_REACH = (2000.0, 2500.0, 7000.0, 8000.0), 700.0


def region(spark: SparkSession) -> DataFrame:
    """One rectangle."""
    x0, y0, x1, y1 = REGION
    return spark.createDataFrame([([[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]],)], "rings array<array<struct<x:double,y:double>>>")


_CASES = "\n".join(f"        WHEN '{k}' THEN '{v}'" for k, v in CLASSES.items())
#: The same tables in SQL: nodes, ways, refs, seg, policy, edges.
SQL = f"""
nodes AS (SELECT p_partkey id, ((p_partkey * 7919) % 10007)::DOUBLE x, ((p_partkey * 104729) % 10009)::DOUBLE y, p_name AS name, p_size AS size, p_size IN (7, 8, 9) AS blocked, p_brand = 'Brand#1' AS signal, p_type = 'PROMO' AND p_size <= 10 AS rail FROM part),
ways AS (SELECT o_orderkey id, o_custkey c, CASE o_orderpriority
{_CASES} END highway, CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' ELSE '-1' END oneway FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
refs AS (SELECT l_orderkey way_id, l_partkey node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS pos FROM lineitem),
seg AS (SELECT way_id, pos AS segment_index, node AS a, lead(node) OVER (PARTITION BY way_id ORDER BY pos) AS b FROM refs),
policy AS (SELECT *, CASE WHEN c % 17 = 0 THEN 'conditional_or_directional_access_review' WHEN c % 13 = 0 THEN 'restricted_access' WHEN c % 29 = 0 THEN 'construction' WHEN c % 5 = 2 THEN 'width_unparsed_review' WHEN c % 5 = 1 THEN 'width_below_3m'
    WHEN c % 23 = 0 THEN 'vehicle_dimensions_review' WHEN c % 19 = 0 THEN 'surface_review' WHEN highway = 'service' THEN 'service_requires_access_audit' WHEN highway = 'residential' AND c % 5 <> 0 THEN 'local_width_missing' ELSE 'allowed' END AS reason FROM ways),
placed AS (SELECT s.*, w.highway, w.oneway, w.c, na.x ax, na.y ay, nb.x bx, nb.y by_, na.blocked OR nb.blocked AS shut, sqrt((na.x - nb.x) * (na.x - nb.x) + (na.y - nb.y) * (na.y - nb.y)) AS length_m, na.signal AS a_signal, nb.signal AS b_signal, na.rail AS a_rail, nb.rail AS b_rail
    FROM seg s JOIN policy w ON w.id = s.way_id AND w.reason = 'allowed' JOIN nodes na ON na.id = s.a JOIN nodes nb ON nb.id = s.b),
dirs AS (SELECT p.*, d.direction, CASE WHEN d.direction = 1 THEN a ELSE b END u, CASE WHEN d.direction = 1 THEN b ELSE a END v, CASE highway WHEN 'primary' THEN 40.0 WHEN 'secondary' THEN 35.0 WHEN 'tertiary' THEN 30.0 WHEN 'residential' THEN 20.0 END::DOUBLE AS top
    FROM placed p JOIN (VALUES (1), (-1)) d(direction) ON (oneway = 'no' OR (oneway = 'yes' AND d.direction = 1) OR (oneway = '-1' AND d.direction = -1)) WHERE NOT shut AND length_m > 0),
edges AS (SELECT way_id || ':' || segment_index || ':' || direction AS id, u, v, way_id, segment_index, direction, length_m, highway, CASE WHEN c % 7 = 0 THEN least(top, 30.0) WHEN c % 7 = 1 THEN least(top, 20 * 1.609344) ELSE top END::DOUBLE AS speed_kmh,
    CASE WHEN direction = 1 THEN b_signal ELSE a_signal END AS signal_at_end, CASE WHEN direction = 1 THEN b_rail ELSE a_rail END AND c % 11 <> 0 AS rail_at_end, c % 11 = 0 AS separated, CASE WHEN direction = 1 THEN ax ELSE bx END ax, CASE WHEN direction = 1 THEN ay ELSE by_ END ay, CASE WHEN direction = 1 THEN bx ELSE ax END bx, CASE WHEN direction = 1 THEN by_ ELSE ay END AS by_ FROM dirs WHERE c % 7 <> 2)"""
