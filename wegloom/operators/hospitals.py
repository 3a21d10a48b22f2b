"""Hospitals: from tagged objects to a cleaned list with an audit of every decision."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wegloom.functions import constants as C
from wegloom.functions import geo, tags, text
from wegloom.plans.shared import Scratch, materialize


PART = 250_000


def candidates(objects: DataFrame, members: DataFrame, way_refs: DataFrame, locations: DataFrame, inside: Column) -> tuple[DataFrame, DataFrame]:
    """(candidates, unresolved). objects: osm_type, id, tags; members: id, mtype, mid; way_refs: way, node; locations:
    node, lon, lat; inside: whether a vertex (lon, lat) is in the region.

    An object's point is the mean of its distinct vertices; it is one of the region if any vertex is inside, and
    marked boundary_review unless all are. Objects without coordinates, with a missing vertex or a nested relation are
    unresolved.
    """
    h = objects.where(tags.is_hospital(F.col("tags")))
    direct = h.where("osm_type = 'node'").select("osm_type", "id", F.col("id").alias("node"))
    # vertices hardly repeat: to make them distinct before they are shuffled would hold a whole input split in memory, so the
    # parts that they are shuffled to, bounded in their rows, do that, and again for the rows of an object
    parts = max(int(h.sparkSession.conf.get("spark.sql.shuffle.partitions")), (way_refs.count() + members.count()) // PART + 1)
    refs = way_refs.repartition(parts, "way")
    of_way = h.where("osm_type = 'way'").join(refs.withColumnRenamed("way", "id"), "id").select("osm_type", "id", "node")
    rel = h.where("osm_type = 'relation'").select("osm_type", "id").join(members, "id")
    via = rel.where("mtype = 1").join(refs.withColumnRenamed("way", "mid"), "mid", "left").select("osm_type", "id", "node")
    nodes = rel.where("mtype = 0").select("osm_type", "id", F.col("mid").alias("node"))
    nested = rel.where("mtype = 2").select("osm_type", "id").distinct().withColumn("nested", F.lit(True))
    vertices = direct.unionByName(of_way).unionByName(via).unionByName(nodes).repartition(parts, "node").distinct().join(locations.repartition(parts, "node"), "node", "left")
    per = vertices.drop("node").repartition(parts, "osm_type", "id").groupBy("osm_type", "id").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.count_if(F.col("lon").isNull()).alias("missing"), F.bool_or(inside).alias("some"), F.bool_and(F.coalesce(inside, F.lit(False))).alias("all"))
    d = h.join(per, ["osm_type", "id"], "left").join(nested, ["osm_type", "id"], "left")
    bad = F.col("lon").isNull() | (F.col("missing") > 0) | F.col("nested").isNotNull()
    good = d.where(~bad & F.col("some")).select("osm_type", "id", "tags", "lon", "lat", (~F.col("all")).alias("boundary_review"))
    return good, d.where(bad).select("osm_type", "id", "tags")


def audited(found: DataFrame) -> DataFrame:
    """osm_type, id, name, lon, lat, decision, reason, merged_into, distance_m for every candidate.

    In the order relation, way, node and then of the id as text, an included hospital with the canonical name of an
    earlier keeper within 250 m is its duplicate, of the first such keeper; a duplicate is no keeper.
    """
    d = found.withColumns({"name": tags.tag(F.col("tags"), "name"), "_c": text.classify_hospital(F.col("tags"), F.col("boundary_review"))})
    d = d.select("osm_type", F.col("id").cast("string").alias("id"), "name", "lon", "lat", F.col("_c.decision").alias("decision"), F.col("_c.reason").alias("reason"))
    d = materialize(d, "hospitals")
    names = d.where("decision = 'include'").withColumn("key", text.canonical(F.col("name")))
    out = d.join(duplicates(names), ["osm_type", "id"], "left")
    again = F.col("merged_into").isNotNull()
    return out.withColumns({"decision": F.when(again, "duplicate").otherwise(F.col("decision")), "reason": F.when(again, "same name within 250 m").otherwise(F.col("reason"))})


HIGH = math.degrees(C.DUPLICATE_M / C.EARTH_M) * 1.001


def _wide(band: Column) -> Column:
    """Degrees of longitude of a cell: all rows of a band measure alike, by the end of the band and its neighbours that is
    nearest to a pole."""
    worst = F.greatest(F.abs(band * HIGH), F.abs((band + 1) * HIGH))
    return HIGH / F.greatest(F.cos(F.radians(F.least(worst, F.lit(89.9)))), F.lit(1e-3))


def _own(rows: DataFrame) -> DataFrame:
    """rows (lon, lat) with their cell (band, col) in a grid of degrees, at least DUPLICATE_M high and wide."""
    d = rows.withColumn("band", F.floor(F.col("lat") / HIGH).cast("bigint"))
    return d.withColumn("col", F.floor(F.col("lon") / _wide(F.col("band"))).cast("bigint"))


def _around(rows: DataFrame) -> DataFrame:
    """rows (lon, lat), each with all cells (band, col) that what is within DUPLICATE_M of it can be in."""
    band = F.floor(F.col("lat") / HIGH).cast("bigint")
    d = rows.withColumn("band", F.explode(F.array(band - 1, band, band + 1)))
    at = F.floor(F.col("lon") / _wide(F.col("band"))).cast("bigint")
    return d.withColumn("col", F.explode(F.array(at - 1, at, at + 1)))


def duplicates(names: DataFrame) -> DataFrame:
    """osm_type, id, merged_into, distance_m of the rows (osm_type, id, key, lon, lat) that repeat an earlier keeper.

    In rounds: the first open row of a cell keeps if no cell around it has an earlier open row, and all open rows in its
    reach are its duplicates. So rows meet the few keepers around them, never one another. The first open row of all is
    decided in every round.
    """
    scratch = Scratch(names.sparkSession)
    rank = F.when(F.col("osm_type") == "relation", 0).when(F.col("osm_type") == "way", 1).otherwise(2)
    cell = ["key", "band", "col"]
    named = names.select("osm_type", "id", "key", "lon", "lat", F.struct(rank.alias("rank"), "id").alias("me"))
    rows = scratch.keep(_own(named.where(F.col("key").isNotNull())), "named")
    placed = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    open_, kept = scratch.keep(rows.where(placed).select("me", *cell, "lon", "lat"), "open"), []
    metres = geo.haversine(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))
    near = metres <= C.DUPLICATE_M
    spread = lambda k: _around(k.select("key", "lon", "lat", F.col("me").alias("a"))).withColumnsRenamed({"lon": "lon2", "lat": "lat2"})
    while True:
        seen = Observation()
        first = scratch.keep(open_.groupBy(*cell).agg(F.min(F.struct("me", "lon", "lat")).alias("m")).select(*cell, "m.*").observe(seen, F.count(F.lit(1)).alias("n")), "first")
        if not seen.get["n"]:
            break
        least = _around(first.select("key", "lon", "lat", "me")).join(first.select(*cell, F.col("me").alias("other")).hint("merge"), cell).groupBy("key", "me", "lon", "lat").agg(F.min("other").alias("least"))
        new = scratch.keep(least.where("me = least").select("key", "me", "lon", "lat"), "kept")
        kept.append(new)
        gone = open_.join(spread(new).hint("merge"), cell).where((F.col("a") == F.col("me")) | near).select("me")
        open_ = scratch.keep(open_.join(gone.hint("merge"), "me", "left_anti"), "open")
    k = functools.reduce(DataFrame.unionByName, kept) if kept else rows.select("key", "me", "lon", "lat").limit(0)
    met = rows.join(spread(k).hint("merge"), cell).where("a < me").where(near).withColumn("metres", metres)
    one = met.groupBy("osm_type", "id", "me").agg(F.min(F.struct("a", "metres")).alias("k"))
    kind = F.element_at(F.array(F.lit("relation"), F.lit("way"), F.lit("node")), F.col("k.a.rank") + 1)
    out = materialize(one.select("osm_type", "id", F.concat_ws("/", kind, "k.a.id").alias("merged_into"), geo.rounded(F.col("k.metres"), 2).alias("distance_m")), "duplicates")
    scratch.drop()
    return out


def keepers(audit: DataFrame) -> DataFrame:
    """The hospitals that stay, by name, with the objects merged into each."""
    own = F.concat_ws("/", "osm_type", "id")
    k = audit.where("decision = 'include'").withColumn("_own", own)
    merged = audit.where("merged_into is not null").groupBy(F.col("merged_into").alias("_own")).agg(F.sort_array(F.collect_list(own)).alias("_more"))
    return k.join(merged, "_own", "left").select("osm_type", "id", "name", "lon", "lat", F.concat(F.array("_own"), F.coalesce("_more", F.array().cast("array<string>"))).alias("source_objects")).orderBy(text.norm(F.col("name")))


def decisions(audit: DataFrame) -> DataFrame:
    return audit.agg(*[F.count_if(F.col("decision") == d).alias(d) for d in ("include", "exclude", "review", "duplicate")])


