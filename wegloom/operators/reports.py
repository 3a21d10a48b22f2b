"""Reviews of results: features and what could not be built, what two searches agree on, what bars the unreachable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wegloom.operators import search
from wegloom.plans.shared import Scratch, materialize

NODE, WAY = 0, 1  # member types of relations


def poi_counts(features: DataFrame, unresolved: DataFrame) -> DataFrame:
    """kind, features, unresolved: how many of each kind were built and how many were not; kinds with neither have no row."""
    one = lambda df, built: df.select("kind", F.lit(built).alias("built"))
    return one(features, True).unionByName(one(unresolved, False)).groupBy("kind").agg(F.count_if("built").alias("features"), F.count_if(~F.col("built")).alias("unresolved"))


def unresolved_review(unresolved: DataFrame, members: DataFrame, way_refs: DataFrame, locations: DataFrame, inside: Column) -> DataFrame:
    """unresolved (osm_type, id, ...) with vertices (how many of its nodes have a place) and review: 'in_region' if any
    of them is inside, 'elsewhere' if none is, 'unknown' without any.

    members, way_refs, locations: as in polygons.areas; inside: condition on the columns x and y of a place. A repeated
    object is reviewed each time that it occurs.
    """
    of = lambda kind: unresolved.where(F.col("osm_type") == kind).select("osm_type", "id").distinct()
    part = of("relation").join(members.select("id", "mtype", "mid"), "id")
    ways = of("way").withColumn("way", F.col("id")).unionByName(part.where(F.col("mtype") == WAY).select("osm_type", "id", F.col("mid").alias("way")))
    nodes = of("node").withColumn("node", F.col("id")).unionByName(part.where(F.col("mtype") == NODE).select("osm_type", "id", F.col("mid").alias("node")))
    nodes = nodes.unionByName(ways.join(way_refs.select("way", "node"), "way").select("osm_type", "id", "node")).distinct()
    found = nodes.join(locations.where("x is not null and y is not null"), "node").groupBy("osm_type", "id").agg(F.count(F.lit(1)).alias("vertices"), F.coalesce(F.bool_or(inside), F.lit(False)).alias("any_inside"))
    d = unresolved.join(found, ["osm_type", "id"], "left").withColumn("vertices", F.coalesce("vertices", F.lit(0)))
    return d.withColumn("review", F.when(F.col("vertices") == 0, "unknown").when(F.col("any_inside"), "in_region").otherwise("elsewhere")).drop("any_inside")


def reached_states(edges: DataFrame, allowed: DataFrame, starts: DataFrame) -> DataFrame:
    """query_id, state: all edges that a way from a query's start (query_id, start) can lead along, turn rules kept."""
    first = starts.select("query_id", F.col("start").alias("u")).distinct().join(edges.select("u", "id"), "u")
    arcs = allowed.select(F.col("e1").alias("src"), F.col("e2").alias("dst"), F.lit(0.0).alias("weight"))
    return search.relax(arcs, first.select("query_id", F.col("id").alias("node"), F.lit(0.0).alias("cost")), ["query_id"]).select("query_id", F.col("node").alias("state"))


def blocked_frontier(edges: DataFrame, allowed: DataFrame, queries: DataFrame, blocked: DataFrame) -> DataFrame:
    """query_id and the blocked edges (id, u, ...) that begin where the query has come to: what bars the way of a query
    (query_id, start) without a route. A query's own start counts as reached."""
    on = reached_states(edges, allowed, queries).join(edges.select(F.col("id").alias("state"), F.col("v").alias("u")), "state").select("query_id", "u")
    there = on.unionByName(queries.select("query_id", F.col("start").alias("u"))).distinct()
    return there.join(blocked, "u")


def blocked_from(edges: DataFrame, rules: DataFrame | None, starts: DataFrame, blocked: DataFrame) -> DataFrame:
    """The blocked edges (id, u, ...), each once, that begin where ways from any of the starts (start) can lead, turn rules
    kept; starts count as reached. Searched over the states of search.junctions, so without a row for each turn."""
    scratch = Scratch(edges.sparkSession)
    ends, outs, places = search.junctions(edges, rules, scratch)
    on = outs.join(ends.select("id", F.col("state").alias("to")), "id").select(F.col("state").alias("u"), F.col("to").alias("v"))
    first = places.where("hub").join(starts.select(F.col("start").alias("node")).distinct(), "node").select(F.col("state").alias("node"))
    there = search.reachable(on, first).withColumnRenamed("node", "state").join(places, "state").select(F.col("node").alias("u"))
    found = materialize(blocked.join(there.unionByName(starts.select(F.col("start").alias("u"))).distinct(), "u", "left_semi"), "frontier")
    scratch.drop()
    return found


def blocked_frontiers(edges: DataFrame, allowed: DataFrame, goals: DataFrame, blocked: DataFrame) -> DataFrame:
    """start and the blocked edges (id, u, ...) that bar its way, for every node with an edge out that has no route to a
    goal (node). A start that nothing bars (its roads end) has no row; goals are no starts.

    From such a start only states that lead to no goal can be come to, so these alone are searched: what most starts
    have, a route, is found by one search backwards for all.
    """
    scratch = Scratch(edges.sparkSession)
    at_goal = edges.join(goals.select(F.col("node").alias("v")).distinct(), "v", "left_semi").select(F.col("id").alias("node"))
    live = scratch.keep(search.reachable(allowed.select(F.col("e1").alias("u"), F.col("e2").alias("v")), at_goal, backwards=True).select(F.col("node").alias("id")), "live")
    dead = scratch.keep(edges.join(live, "id", "left_anti"), "dead")
    on = allowed.join(dead.select(F.col("id").alias("e1")), "e1", "left_semi")
    served = edges.join(live, "id", "left_semi").select("u").unionByName(goals.select(F.col("node").alias("u")))
    starts = dead.select("u").distinct().join(served, "u", "left_anti").select(F.col("u").alias("query_id"), F.col("u").alias("start"))
    found = materialize(blocked_frontier(dead, on, starts, blocked).withColumnRenamed("query_id", "start"), "frontiers")
    scratch.drop()
    return found


def breaches(tail: DataFrame, costs: DataFrame, allowed: DataFrame, goals: DataFrame) -> DataFrame:
    """scenario, kind, n: what keeps the distances to the goals (search.to_goals) from being the least ones.

    They are the least if no turn makes a state cheaper (`shorter`), states at goals cost nothing (`goal`), and every other
    one costs what its next state and the edge there cost (`parent`). This looks at all turns once, however they were
    searched.
    """
    t = tail.select("scenario", "node", "cost", "parent")
    w = costs.select("scenario", F.col("id").alias("e2"), "cost_s")
    far = lambda e, c: t.select("scenario", F.col("node").alias(e), F.col("cost").alias(c))
    turn = allowed.join(w, "e2").join(far("e2", "ahead"), ["scenario", "e2"]).join(far("e1", "here"), ["scenario", "e1"], "left")
    shorter = turn.where("here is null or cost_s + ahead < here - 1e-6").select("scenario", F.lit("shorter").alias("kind"))
    at = costs.join(goals.select(F.col("node").alias("v")).distinct(), "v").select("scenario", F.col("id").alias("node")).join(t, ["scenario", "node"], "left")
    wrong = at.where("cost is null or cost != 0").select("scenario", F.lit("goal").alias("kind"))
    on = t.where("cost > 0 or parent is not null").select("scenario", "node", "cost", F.col("parent").alias("e2")).join(w, ["scenario", "e2"], "left").join(far("e2", "ahead"), ["scenario", "e2"], "left")
    loose = on.where("ahead is null or cost_s is null or abs(cost_s + ahead - cost) > 1e-6").select("scenario", F.lit("parent").alias("kind"))
    return shorter.union(wrong).union(loose).groupBy("scenario", "kind").agg(F.count(F.lit(1)).alias("n"))


def validation_summary(results: DataFrame) -> DataFrame:
    """scenario, query_pairs, search_runs, unreachable, disagreements, most_states of results of both algorithms
    (query_id, scenario, algorithm, cost_s, expanded_states); two costs agree within 1e-6."""
    one = results.groupBy("scenario", "query_id").agg(F.count(F.lit(1)).alias("runs"), F.count("cost_s").alias("found"), (F.max("cost_s") - F.min("cost_s")).alias("gap"), F.max("expanded_states").alias("states"))
    differ = ((F.col("found") > 0) & (F.col("found") < F.col("runs"))) | F.coalesce(F.col("gap") > 1e-6, F.lit(False))
    return one.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("query_pairs"), F.sum("runs").alias("search_runs"), F.count_if(F.col("found") == 0).alias("unreachable"), F.count_if(differ).alias("disagreements"), F.max("states").alias("most_states"),
    )


def sampled(rows: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """n of the rows, drawn by the smallest hashes of their keys and the seed: the same ones however the rows are dealt,
    and a larger n only adds to them. Rows of the same keys are drawn in any order."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)
