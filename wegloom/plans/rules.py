"""Queries that hold the smaller rules (turn restrictions, candidates, goals, gates, starts, views) against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wegloom.functions import tags
from wegloom.operators import catalog, hospitals, network, places, polygons, reports, search, turns
from wegloom.plans import derived as D
from wegloom.plans.queries import BARRED, GOALS, MAPPED, MAPPING, RULES, barred, hospital_mapping, query, r4
from wegloom.plans.shared import materialize

INSIDE_X = 6000


def _restrictions(spark: SparkSession, sf: str) -> DataFrame:
    """id, tags, members: a relation for every order, with one or two from-ways, and with faults of every kind."""
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    kinds = F.array(*[F.lit(k) for k in ("no_left_turn", "no_u_turn", "only_straight_on", "no_entry", None, "no_right_turn")])
    member = lambda kind, mid, role: F.struct(F.lit(kind).alias("mtype"), mid.cast("bigint").alias("mid"), F.lit(role).alias("role"))
    parts = F.array(member(1, i, "from"), F.when(c % 9 == 0, member(1, i + 7, "from")), F.when(c % 10 != 3, member(0, c + 1, "via")), F.when(c % 11 == 0, member(1, i + 2, "via")), member(1, i + 1, "to"))
    values = {"restriction": kinds[(c % 6).cast("int")], "restriction__motorcar": F.when(c % 8 == 0, "only_left_turn"), "except": F.when(c % 7 == 0, "bicycle;motorcar").when(c % 7 == 1, "bus"), "restriction__conditional": F.when(c % 13 == 0, "no_left_turn @ (07:00-09:00)")}
    return D.table(spark, sf, "orders").select(i.alias("id"), D.tag_map(**values).alias("tags"), F.filter(parts, lambda m: m.isNotNull()).alias("members"))


RELATIONS = """kept AS (SELECT id FROM policy WHERE reason = 'allowed'),
rel AS (SELECT o_orderkey AS id, o_custkey AS c, CASE WHEN o_custkey % 8 = 0 THEN 'only_left_turn' ELSE CASE o_custkey % 6 WHEN 0 THEN 'no_left_turn' WHEN 1 THEN 'no_u_turn' WHEN 2 THEN 'only_straight_on' WHEN 3 THEN 'no_entry' WHEN 5 THEN 'no_right_turn' END END AS kind FROM orders),
used AS (SELECT *, kind <> 'no_entry' AND c % 9 <> 0 AND c % 10 <> 3 AND c % 11 <> 0 AND c % 13 <> 0 AS simple FROM rel WHERE kind IS NOT NULL AND c % 7 <> 0 AND (id IN (SELECT id FROM kept) OR (c % 9 = 0 AND id + 7 IN (SELECT id FROM kept)))),
audit AS (SELECT id, c, CASE WHEN simple THEN 'turn_state_rule' ELSE 'exclude_from_ways_conservatively' END AS action FROM used)"""


@query(RELATIONS + " SELECT id::VARCHAR AS id, action FROM audit")
def restriction_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of each restriction that speaks of an allowed way."""
    return network.split_restrictions(_restrictions(spark, sf), D.allowed_ways(spark, sf))[1].select("id", "action")


@query(RELATIONS + " SELECT id::VARCHAR AS from_way, (id + 1)::VARCHAR AS to_way, (c + 1)::VARCHAR AS via, kind AS restriction, id::VARCHAR AS osm_relation FROM used WHERE simple")
def restriction_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The turn rules of the restrictions that are plain enough."""
    return network.split_restrictions(_restrictions(spark, sf), D.allowed_ways(spark, sf))[0]


@query(RELATIONS + " SELECT action, count(*) AS n FROM audit GROUP BY action")
def restriction_actions(spark: SparkSession, sf: str) -> DataFrame:
    return turns.rule_actions(network.split_restrictions(_restrictions(spark, sf), D.allowed_ways(spark, sf))[1])


@query(RELATIONS + """, banned AS (SELECT id FROM used WHERE NOT simple UNION SELECT id + 7 FROM used WHERE NOT simple AND c % 9 = 0)
    SELECT id, u, v FROM edges WHERE way_id NOT IN (SELECT id FROM banned)""")
def edges_without_banned(spark: SparkSession, sf: str) -> DataFrame:
    """The network without the ways that a restriction of an unsupported form starts from."""
    ways = D.allowed_ways(spark, sf)
    banned = network.split_restrictions(_restrictions(spark, sf), ways)[1].where("`from` is not null").select(F.explode("from").alias("id"))
    return network.build_edges(ways, D.nodes(spark, sf), banned=banned)[0].select("id", "u", "v")


def _tagged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """objects, members, way_refs, locations: parts, orders and customers as nodes, ways and relations of a customer's
    orders; a third of them each is tagged in one of two ways and not at all, parts of one size have no place."""
    mark = lambda i: D.tag_map(amenity=F.when(i % 3 == 0, "hospital").when(i % 3 == 2, "clinic"), healthcare=F.when(i % 3 == 1, "hospital"))
    rows = lambda table, key, kind: D.table(spark, sf, table).select(F.lit(kind).alias("osm_type"), F.col(key).cast("bigint").alias("id"), mark(F.col(key)).alias("tags"))
    objects = rows("part", "p_partkey", "node").unionByName(rows("orders", "o_orderkey", "way")).unionByName(rows("customer", "c_custkey", "relation"))
    c = F.col("c_custkey").cast("bigint")
    customers = D.table(spark, sf, "customer")
    members = D.table(spark, sf, "orders").select(F.col("o_custkey").cast("bigint").alias("id"), F.lit(1).alias("mtype"), F.col("o_orderkey").cast("bigint").alias("mid"))
    members = members.unionByName(customers.where(c % 5 == 0).select(c.alias("id"), F.lit(0).alias("mtype"), c.alias("mid"))).unionByName(customers.where(c % 11 == 0).select(c.alias("id"), F.lit(2).alias("mtype"), (c + 1).alias("mid")))
    refs = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("bigint").alias("way"), F.col("l_partkey").cast("bigint").alias("node"))
    return objects, members, refs, D.nodes(spark, sf).where("size != 13").select(F.col("id").cast("bigint").alias("node"), "x", "y")


TAGGED = f"""obj AS (SELECT 'node' AS osm_type, p_partkey AS id FROM part UNION ALL SELECT 'way', o_orderkey FROM orders UNION ALL SELECT 'relation', c_custkey FROM customer),
vert AS (SELECT 'node' AS osm_type, p_partkey AS id, p_partkey AS node FROM part UNION SELECT 'way', l_orderkey, l_partkey FROM lineitem UNION SELECT 'relation', o_custkey, l_partkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey UNION SELECT 'relation', c_custkey, c_custkey FROM customer WHERE c_custkey % 5 = 0),
per AS (SELECT v.osm_type, v.id, avg(n.x) AS lon, avg(n.y) AS lat, count(n.x) AS located, count(*) - count(n.x) AS missing, bool_or(n.x < {INSIDE_X}) AS any_in, bool_and(coalesce(n.x < {INSIDE_X}, false)) AS whole FROM vert v LEFT JOIN (SELECT * FROM nodes WHERE size <> 13) n ON n.id = v.node GROUP BY ALL),
judged AS (SELECT o.osm_type, o.id, lon, lat, coalesce(located, 0) AS vertices, any_in, whole, lon IS NULL OR missing > 0 OR (o.osm_type = 'relation' AND o.id % 11 = 0) AS bad FROM obj o LEFT JOIN per USING (osm_type, id) WHERE o.id % 3 <> 2)"""


def _candidates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    objects, members, refs, at = _tagged(spark, sf)
    return hospitals.candidates(objects, members, refs, at.select("node", F.col("x").alias("lon"), F.col("y").alias("lat")), F.col("lon") < INSIDE_X)


@query(TAGGED + " SELECT osm_type, id, round(lon, 4) AS lon, round(lat, 4) AS lat, NOT whole AS boundary_review FROM judged WHERE NOT bad AND any_in")
def hospital_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Tagged objects with the mean of their distinct vertices, those with a vertex in the region."""
    return _candidates(spark, sf)[0].select("osm_type", "id", r4("lon").alias("lon"), r4("lat").alias("lat"), "boundary_review")


@query(TAGGED + " SELECT osm_type, id, vertices, CASE WHEN vertices = 0 THEN 'unknown' WHEN any_in THEN 'in_region' ELSE 'elsewhere' END AS review FROM judged WHERE bad")
def unresolved_hospitals(spark: SparkSession, sf: str) -> DataFrame:
    """Tagged objects that couldn't be placed (a vertex missing, a nested relation, none at all), and whether what is known
    of them lies in the region."""
    _, members, refs, at = _tagged(spark, sf)
    return reports.unresolved_review(_candidates(spark, sf)[1], members, refs, at, F.col("x") < INSIDE_X).select("osm_type", "id", "vertices", "review")


@query("""WITH c AS (SELECT c_custkey AS c, c_custkey % 19 AS k FROM customer) SELECT CASE c % 3 WHEN 0 THEN 'school' WHEN 1 THEN 'market' ELSE 'mall' END AS kind,
    count(*) FILTER (k IN (0, 1, 10, 14, 17, 18)) AS features, count(*) FILTER (k NOT IN (0, 1, 10, 14, 17, 18)) AS unresolved FROM c GROUP BY 1""", base=False)
def area_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many areas of each kind were built, and how many were not."""
    return reports.poi_counts(*polygons.areas(*D.area_objects(spark, sf)))


@query(MAPPED + ", mapped AS (" + MAPPING + """), named AS (SELECT road_node AS node, point_id AS i, name FROM mapped WHERE status = 'road_point_proxy' UNION ALL SELECT DISTINCT v, 1 << 30, 'Override ' || v % 4 FROM edges WHERE v % 50 = 0),
    once AS (SELECT node, name, min(i) AS i FROM named GROUP BY node, name) SELECT node, string_agg(name, '|' ORDER BY i, name) AS names FROM once GROUP BY node""")
def goal_names(spark: SparkSession, sf: str) -> DataFrame:
    """The goals with their hospitals' names in order, overrides added twice over."""
    e = D.saved_edges(spark, sf)
    more = e.where("v % 50 = 0").select(F.col("v").alias("node"), F.concat(F.lit("Override "), (F.col("v") % 4).cast("string")).alias("name")).distinct()
    g = network.override_goals(network.override_goals(network.goals(hospital_mapping(spark, sf)), more, e), more, e)
    return g.select("node", F.array_join("hospitals", "|").alias("names"))


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    return D.table(spark, sf, "customer").select(c.alias("point_id"), ((c * 3571) % 10007).cast("double").alias("px"), ((c * 7907) % 10009).cast("double").alias("py"))


CUSTOMERS = "pts AS (SELECT c_custkey AS id, ((c_custkey * 3571) % 10007)::DOUBLE px, ((c_custkey * 7907) % 10009)::DOUBLE py FROM customer)"


@query(CUSTOMERS + """, used AS (SELECT id, x, y FROM nodes WHERE id IN (SELECT u FROM edges UNION SELECT v FROM edges)), near AS (SELECT p.id AS point_id, arg_min(n.id, (sqrt((px - x) * (px - x) + (py - y) * (py - y)), n.id)) AS road_node, min(sqrt((px - x) * (px - x) + (py - y) * (py - y))) AS gap FROM pts p, used n GROUP BY p.id)
    SELECT point_id, road_node, round(gap, 4) AS gap_m, CASE WHEN gap > 50 THEN 'too far from the network' WHEN road_node NOT IN (SELECT u FROM edges) THEN 'no edge out' ELSE 'ok' END AS status FROM near""")
def nearest_starts(spark: SparkSession, sf: str) -> DataFrame:
    """For each customer's point the nearest node of the network, and whether a route may start there."""
    return search.nearest_start(_customers(spark, sf), D.saved_edges(spark, sf), D.nodes(spark, sf)).select("point_id", "road_node", r4("gap_m").alias("gap_m"), "status")


@query("goal AS (SELECT id, x, y FROM nodes WHERE size = 11 AND id IN (SELECT v FROM edges)) SELECT n.id AS node, round(min(sqrt((n.x - g.x) * (n.x - g.x) + (n.y - g.y) * (n.y - g.y))) / (60 / 3.6), 4) AS h FROM nodes n, goal g GROUP BY n.id")
def goal_heuristic(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds in a straight line at the largest speed from every node to its nearest goal."""
    return search.heuristic(D.nodes(spark, sf), D.goals(spark, sf, D.saved_edges(spark, sf))).select("node", r4("h").alias("h"))


@query("""box AS (SELECT way_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM refs JOIN nodes ON id = node GROUP BY way_id)
    SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, greatest(x1 - x0, y1 - y0) AS extent, round(least(4000.0, greatest(1000.0, greatest(x1 - x0, y1 - y0) * 0.65 + 250)), 4)::DOUBLE AS radius FROM box""")
def way_views(spark: SparkSession, sf: str) -> DataFrame:
    """The box of each way, and the radius of the map that shows it."""
    line = D.ways(spark, sf).select(F.col("id").alias("way_id"), F.explode("refs").alias("node")).join(D.nodes(spark, sf).select(F.col("id").alias("node"), "x", "y"), "node")
    return catalog.path_view(line, ["way_id"]).withColumn("radius", r4("radius"))


def _gated(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog where every second gate lets cars through."""
    n = D.nodes(spark, sf)
    free = (F.col("size") == 7) & (F.col("id") % 2 == 0)
    n = n.withColumn("tags", F.when(free, F.map_concat("tags", F.create_map(F.lit("access"), F.lit("yes")))).otherwise(F.col("tags")))
    return catalog.build_catalog(D.allowed_ways(spark, sf, tags.access_policy), n)


GATED = """gated AS (SELECT s.way_id, s.segment_index, s.a, s.b, w.oneway, w.highway, na.size = 7 AS ga, nb.size = 7 AS gb, na.size IN (8, 9) OR (na.size = 7 AND s.a % 2 = 1) AS sa, nb.size IN (8, 9) OR (nb.size = 7 AND s.b % 2 = 1) AS sb, na.x ax, na.y ay, nb.x bx, nb.y by_
    FROM seg s JOIN ways w ON w.id = s.way_id JOIN nodes na ON na.id = s.a JOIN nodes nb ON nb.id = s.b WHERE (na.x <> nb.x OR na.y <> nb.y) AND c % 17 <> 0 AND c % 13 <> 0 AND c % 29 <> 0 AND c % 5 NOT IN (1, 2) AND c % 23 <> 0 AND c % 19 <> 0 AND c % 7 <> 2)"""


@query(GATED + """ SELECT way_id || ':' || segment_index || ':' || d.direction AS id, sa OR sb AS blocked, concat_ws('|', CASE WHEN sa THEN a::VARCHAR END, CASE WHEN sb THEN b::VARCHAR END) AS blocked_nodes,
    CASE WHEN CASE WHEN d.direction = 1 THEN gb AND NOT sb ELSE ga AND NOT sa END THEN 10.0 ELSE 0.0 END::DOUBLE AS gate_wait_s, CASE WHEN d.direction = 1 AND gb THEN b::VARCHAR WHEN d.direction = -1 AND ga THEN a::VARCHAR END AS gate_node_at_end
    FROM gated JOIN (VALUES (1), (-1)) d(direction) ON (oneway = 'no' OR (oneway = 'yes' AND d.direction = 1) OR (oneway = '-1' AND d.direction = -1))""")
def catalog_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Each edge of the catalog with its gate, the wait there, and the nodes that bar it."""
    e = _gated(spark, sf).select(F.explode("edges").alias("e"))
    return e.select("e.id", "e.blocked", F.array_join("e.blocked_nodes", "|").alias("blocked_nodes"), "e.gate_wait_s", "e.gate_node_at_end")


@query(GATED + " SELECT way_id || ':' || segment_index AS segment_id, highway IN ('primary', 'secondary', 'tertiary') AS major, sa OR sb AS blocked FROM gated")
def road_map(spark: SparkSession, sf: str) -> DataFrame:
    """Segments as the map draws them."""
    return catalog.road_map(_gated(spark, sf)).select("segment_id", "major", "blocked")


@query(GATED + ", " + CUSTOMERS + """, proj AS (SELECT id, px, py, way_id || ':' || segment_index AS segment_id, ax, ay, bx, by_, greatest(0.0, least(1.0, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS f FROM pts, gated WHERE NOT sa AND NOT sb AND least(ax, bx) - 350 <= px AND greatest(ax, bx) + 350 >= px AND least(ay, by_) - 350 <= py AND greatest(ay, by_) + 350 >= py),
    gap AS (SELECT *, sqrt((px - ax - f * (bx - ax)) * (px - ax - f * (bx - ax)) + (py - ay - f * (by_ - ay)) * (py - ay - f * (by_ - ay))) AS gap FROM proj), best AS (SELECT *, CASE WHEN f BETWEEN 0.01 AND 0.99 THEN f WHEN f < 0.5 THEN 0.02 ELSE 0.98 END AS g FROM gap WHERE gap <= 350 QUALIFY row_number() OVER (PARTITION BY id ORDER BY gap, segment_id) = 1)
    SELECT p.id AS point_id, round(coalesce(ax + (bx - ax) * g, p.px), 3) AS x, round(coalesce(ay + (by_ - ay) * g, p.py), 3) AS y, round(gap, 3) AS gap FROM pts p LEFT JOIN best USING (id)""")
def chosen_origins(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's point moved to the nearest open road within 350 m, off its junctions."""
    return catalog.choose_origins(_gated(spark, sf), _customers(spark, sf)).select("point_id", *[F.round(c, 3).alias(c) for c in ("x", "y", "gap")])


def _wide_places(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as places over three degrees, each of them twice."""
    k = F.col("p_partkey")
    p = D.table(spark, sf, "part").select(k.cast("bigint").alias("seq"), F.initcap("p_name").alias("name"), (-9 + (k % 3000) / 1000.0).alias("lat"), (109 + (k % 2500) / 1000.0).alias("lon"), F.lit(None).cast("string").alias("aliases"), F.concat(F.lit("No. "), (k % 7).cast("string")).alias("address"))
    return p.unionByName(p.withColumn("seq", F.col("seq") + 100_000_000_000))


WINDOW = """WITH p AS (SELECT p_partkey AS seq, p_name AS key, -9 + (p_partkey % 3000) / 1000.0::DOUBLE AS lat, 109 + (p_partkey % 2500) / 1000.0::DOUBLE AS lon FROM part),
w AS (SELECT seq, key || ' no ' || seq % 7 AS search_key, key FROM p WHERE lat > -8.5 AND lat < -7 AND lon > 109.5 AND lon < 111 QUALIFY row_number() OVER (PARTITION BY key, round(lat, 5), round(lon, 5) ORDER BY seq) = 1)"""


@query(WINDOW + " SELECT seq, search_key FROM w", base=False)
def window_places(spark: SparkSession, sf: str) -> DataFrame:
    """The places of the province's window, each once, with the key that the simple search looks in."""
    return places.window_places(_wide_places(spark, sf)).select("seq", "search_key")


@query(WINDOW + " SELECT key AS name FROM w WHERE contains(search_key, 'red') AND contains(search_key, 'w') ORDER BY NOT starts_with(search_key, 'red w'), length(key), key LIMIT 15", base=False)
def quick_search(spark: SparkSession, sf: str) -> DataFrame:
    """The fifteen best places for 'RED-w' by the simple ranking."""
    return places.quick_search(places.window_places(_wide_places(spark, sf)), "RED-w").select(F.lower("name").alias("name"))


MAIN = ", ".join(["main AS (SELECT * FROM edges WHERE highway = 'primary')", RULES.replace("edges", "main"), GOALS.replace("edges", "main"), BARRED])


@query(MAIN + """, live AS (SELECT id FROM main WHERE v IN (SELECT node FROM goals) UNION SELECT e1 FROM live JOIN turn ON e2 = id),
served AS (SELECT u FROM main JOIN live USING (id) UNION SELECT node FROM goals), lost AS (SELECT u AS start, id AS state, v FROM main WHERE u NOT IN (SELECT u FROM served) UNION SELECT start, e2, e.v FROM lost JOIN turn ON e1 = state JOIN main e ON e.id = e2),
come AS (SELECT start, v AS u FROM lost UNION SELECT start, start FROM lost) SELECT DISTINCT start, bar.id FROM come JOIN bar USING (u)""")
def blocked_frontiers(spark: SparkSession, sf: str) -> DataFrame:
    """In the network of primary roads, for every node without a route to a goal, the blocked edges that bar its way."""
    e = materialize(D.edges(spark, sf).where("highway = 'primary'"), "edges")
    return reports.blocked_frontiers(e, materialize(turns.transitions(e, D.turn_rules(e)), "turns"), D.goals(spark, sf, e), barred(spark, sf)).select("start", "id")
