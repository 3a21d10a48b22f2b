"""Areas out of lines, as tables of half-edges.

Lines are cut where they meet. Every piece is two half-edges; around each node they are ordered by angle, and the one
clockwise next to a half-edge's twin is where its face goes on, so that bounded faces are walked anticlockwise. Faces are
told apart, and their corners put in order, by pointer doubling: after k rounds a half-edge knows the least half-edge
among the 2**k that follow and how far off that is. Half-edges of a key never lead out of it, so this is done for many keys
at once in one task, and by joins for keys with too many half-edges (faces()). A piece with the same face on both sides bounds nothing: such pieces
are left over. The outline of all faces of a connected part is the face that is walked clockwise, the other way around.

All tables are keyed: lines of different keys never meet. A key's lines are met over cells of its own size, twice the
mean length of its pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wegloom.functions import geo
from wegloom.plans.shared import Scratch, materialize

POINT = "struct<x:double,y:double>"
MOST = 200_000


def point(x: str, y: str) -> Column:
    return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))


def pieces(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, p, q (p < q), n: the sides of the lines (keys, line: array of x, y), without direction, each once with the
    number of times that it occurs; sides without length are left out."""
    n = F.size("line")
    side = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.element_at("line", i).alias("a"), F.element_at("line", i + 1).alias("b")))
    d = lines.where(n > 1).select(*keys, F.explode(side).alias("s")).select(*keys, F.least("s.a", "s.b").cast(POINT).alias("p"), F.greatest("s.a", "s.b").cast(POINT).alias("q"))
    return d.where("p != q").groupBy(*keys, "p", "q").agg(F.count(F.lit(1)).alias("n"))


def turn(a: Column, b: Column, c: Column) -> Column:
    """Positive where c is left of the line from a to b."""
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def between(a: Column, b: Column, c: Column) -> Column:
    """Whether c, on the line through a and b, is between them."""
    return c["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & c["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))


def meetings(p: Column, q: Column, r: Column, s: Column) -> Column:
    """The points, at most two, in which the sides p-q and r-s meet: where they cross, or their ends on the other."""
    a, b, c, d = turn(p, q, r), turn(p, q, s), turn(r, s, p), turn(r, s, q)
    crossing = (((a > 0) & (b < 0)) | ((a < 0) & (b > 0))) & (((c > 0) & (d < 0)) | ((c < 0) & (d > 0)))
    at = c / F.nullif(c - d, F.lit(0.0))
    inner = F.struct((p["x"] + at * (q["x"] - p["x"])).alias("x"), (p["y"] + at * (q["y"] - p["y"])).alias("y"))
    none = F.lit(None).cast(POINT)
    ends = [F.when((t == 0) & between(u, v, e), e).otherwise(none) for t, u, v, e in ((a, p, q, r), (b, p, q, s), (c, r, s, p), (d, r, s, q))]
    return F.when(crossing, F.array(inner)).otherwise(F.array_distinct(F.array_compact(F.array(*ends))))


def noded(sides: DataFrame, keys: list[str]) -> DataFrame:
    """pieces cut where they meet others of their key; n adds up where cut pieces lie on one another."""
    size = sides.groupBy(*keys).agg(F.avg(geo.distance(F.col("p.x"), F.col("p.y"), F.col("q.x"), F.col("q.y")) * 2).alias("size"))
    cell = geo.line_cells(F.col("p.x") / F.col("size"), F.col("p.y") / F.col("size"), F.col("q.x") / F.col("size"), F.col("q.y") / F.col("size"), 0.0, 1.0)
    # one shuffle serves both sides of the join
    spread = sides.join(size, keys).select(*keys, "p", "q", F.explode(cell).alias("c")).repartition(*keys, "c")
    other = spread.select(*keys, "c", F.col("p").alias("r"), F.col("q").alias("s"))
    # sides that meet in several cells give the same cuts again: pairs aren't made distinct
    met = spread.join(other, [*keys, "c"]).where(F.struct("p", "q") < F.struct("r", "s")).select(*keys, "p", "q", "r", "s", F.explode(meetings(*[F.col(c) for c in "pqrs"])).alias("m"))
    both = F.array(F.struct("p", "q"), F.struct(F.col("r").alias("p"), F.col("s").alias("q")))
    cuts = met.select(*keys, "m", F.explode(both).alias("e")).select(*keys, "e.p", "e.q", "m").where("m != p and m != q")
    cuts = cuts.groupBy(*keys, "p", "q").agg(F.collect_set("m").alias("cuts"))
    # along a side points are in the order of x, or of y where it is upright: that of p < q
    stops = F.array_sort(F.concat(F.array("p", "q"), F.coalesce("cuts", F.array().cast(f"array<{POINT}>"))))
    whole = sides.join(cuts, [*keys, "p", "q"], "left").select(*keys, "n", stops.alias("line"))
    part = F.transform(F.sequence(F.lit(1), F.size("line") - 1), lambda i: F.struct(F.element_at("line", i).alias("p"), F.element_at("line", i + 1).alias("q")))
    return whole.select(*keys, "n", F.explode(part).alias("s")).select(*keys, "s.p", "s.q", "n").where("p != q").groupBy(*keys, "p", "q").agg(F.sum("n").alias("n"))


def half_edges(sides: DataFrame, keys: list[str]) -> DataFrame:
    """keys, h, twin, next, a (where h begins), b: two rows a side. sides: keys, p, q, piece (a number)."""
    one, two = F.col("piece") * 2, F.col("piece") * 2 + 1
    d = sides.select(*keys, F.explode(F.array(F.struct(one.alias("h"), two.alias("twin"), F.col("p").alias("a"), F.col("q").alias("b")), F.struct(two.alias("h"), one.alias("twin"), F.col("q").alias("a"), F.col("p").alias("b")))).alias("e")).select(*keys, "e.*")
    around = Window.partitionBy(*keys, "a").orderBy("angle", "h")
    whole = Window.partitionBy(*keys, "a")
    d = d.withColumn("angle", F.atan2(F.col("b.y") - F.col("a.y"), F.col("b.x") - F.col("a.x")))
    d = d.withColumn("before", F.coalesce(F.lag("h").over(around), F.max_by("h", F.struct("angle", "h")).over(whole)))
    # a face that comes in along the twin goes out along the half-edge clockwise next to it
    return d.select(*keys, F.col("twin").alias("h"), F.col("h").alias("twin"), F.col("b").alias("a"), F.col("a").alias("b"), F.col("before").alias("next"))


def walked(halves: DataFrame, scratch: Scratch) -> DataFrame:
    """h, face (its least half-edge), left (how many steps it is away from there): by pointer doubling."""
    state = scratch.keep(halves.select("h", F.col("h").alias("face"), F.lit(0).cast("bigint").alias("left"), F.col("next").alias("jump")), "faces")
    size = 1
    while True:
        seen = Observation()
        ahead = state.select(F.col("h").alias("jump"), F.col("face").alias("f"), (F.col("left") + size).alias("l"), F.col("jump").alias("j"))
        nearer = F.col("f") < F.col("face")
        d = state.join(ahead, "jump").select("h", F.when(nearer, F.col("f")).otherwise(F.col("face")).alias("face"), F.when(nearer, F.col("l")).otherwise(F.col("left")).alias("left"), F.col("j").alias("jump"), nearer.alias("moved"))
        state = scratch.keep(d.observe(seen, F.count_if("moved").alias("n")), "faces").drop("moved")
        size *= 2
        # windows that no longer fall meet all around the face
        if not seen.get["n"]:
            return state.select("h", "face", "left")


def _around(jump: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """walked() for half-edges 0, 1, ... and the places of those that follow them."""
    face, left, size = np.arange(len(jump)), np.zeros(len(jump), np.int64), 1
    while True:
        nearer = face[jump] < face
        if not nearer.any():
            return face, left
        face, left, jump, size = np.where(nearer, face[jump], face), np.where(nearer, left[jump] + size, left), jump[jump], 2 * size


def _settled(t: pa.Table) -> pa.Table:
    """Half-edges of whole keys with open (whether their piece bounds no face), and face and left without such pieces."""
    h = t.column("h").to_numpy()
    order = np.argsort(h)
    t, h = t.take(order), h[order]
    follow, twin = (np.searchsorted(h, t.column(c).to_numpy()) for c in ("next", "twin"))
    face, _ = _around(follow)
    shut = face == face[twin]
    # around the node on to the first half-edge that stays; pieces left over only follow themselves
    ahead, pending = follow.copy(), np.flatnonzero(~shut)
    while len(pending := pending[shut[ahead[pending]]]):
        ahead[pending] = follow[twin[ahead[pending]]]
    ahead[shut] = np.flatnonzero(shut)
    face, left = _around(ahead)
    return t.drop_columns(["bucket", "next", "twin"]).append_column("open", pa.array(shut)).append_column("face", pa.array(h[face])).append_column("left", pa.array(left))


def settled(numbered: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """As _settled(), by joins: for keys with any number of half-edges. numbered: keys, p, q, piece."""
    halves = scratch.keep(half_edges(numbered, keys), "halves")
    of = walked(halves, scratch)
    pair = halves.select("h", "twin").join(of.select("h", "face"), "h").join(of.select(F.col("h").alias("twin"), F.col("face").alias("other")), "twin")
    marked = scratch.keep(pair.where("h % 2 = 0").select((F.col("h") / 2).cast("bigint").alias("piece"), (F.col("face") == F.col("other")).alias("open")), "marked")
    closed = scratch.keep(half_edges(numbered.join(marked.where("not open").select("piece"), "piece", "left_semi"), keys), "halves")
    kept = closed.join(walked(closed, scratch), "h").select(*keys, "h", "a", "b", F.lit(False).alias("open"), "face", "left")
    over = numbered.join(marked.where("open").select("piece"), "piece", "left_semi").select(*keys, F.explode(F.array(F.col("piece") * 2, F.col("piece") * 2 + 1)).alias("h"), F.col("p").alias("a"), F.col("q").alias("b"), F.lit(True).alias("open"))
    return kept.unionByName(over.select("*", F.col("h").alias("face"), F.lit(0).cast("bigint").alias("left")))


def faces(sides: DataFrame, keys: list[str], scratch: Scratch, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(rings, loose). rings: keys, face, ring (closed array of points), area (negative for the outline of a connected
    part), anticlockwise faces and outlines; loose: keys of the sides that bound no face, with n_loose and the number of
    all sides. sides: noded, keys, p, q.

    Keys are dealt over buckets, each settled in one task; a bucket with more than `most` sides is settled by joins.
    """
    numbered = scratch.keep(sides.select(*keys, "p", "q").withColumn("piece", F.monotonically_increasing_id()), "sides")
    buckets = numbered.count() * 4 // most + 1
    dealt = numbered.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    crowded = [r["bucket"] for r in dealt.groupBy("bucket").count().where(F.col("count") > most).collect()]  # a few numbers
    few = dealt.where(~F.col("bucket").isin(crowded)) if crowded else dealt
    kinds = dict(numbered.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"h bigint, a {POINT}, b {POINT}, open boolean, face bigint, left bigint"])
    near = half_edges(few.repartition("bucket"), ["bucket", *keys]).select("bucket", *keys, "h", "twin", "a", "b", "next").groupBy("bucket").applyInArrow(_settled, schema)
    if crowded:
        near = near.unionByName(settled(dealt.where(F.col("bucket").isin(crowded)).drop("bucket"), keys, scratch))
    step = scratch.keep(near, "halves")
    loose = step.where("h % 2 = 0").groupBy(*keys).agg(F.count_if("open").alias("n_loose"), F.count(F.lit(1)).alias("n_sides"))
    wedge = F.col("a.x") * F.col("b.y") - F.col("b.x") * F.col("a.y")
    corners = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("left")).alias("i"), "a"))), lambda s: s["a"])
    ring = step.where("not open").groupBy(*keys, "face").agg(corners.alias("open_ring"), (F.sum(wedge) / 2).alias("area"))
    closed = F.concat("open_ring", F.slice("open_ring", 1, 1))
    return scratch.keep(ring.select(*keys, "face", closed.alias("ring"), "area"), "rings"), loose


def crossings(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether a ray to the right of a point crosses a side."""
    return F.coalesce(((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / F.nullif(by - ay, F.lit(0.0)) + ax), F.lit(False))


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))


def union(rings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, face, ring, area: the outlines of the union of all faces, anticlockwise; one that lies inside another of its
    key is left out. rings: as of faces()."""
    out = rings.where("area < 0").select(*keys, "face", F.reverse("ring").alias("ring"), (-F.col("area")).alias("area")).withColumn("box", bounds(F.col("ring")))
    out = out.withColumn("parts", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    single, out = out.where("parts = 1"), out.where("parts > 1")
    # outlines of different parts don't meet: one corner tells
    inner = out.select(*keys, "face", "box", F.element_at("ring", 1).alias("at"))
    around = out.select(*keys, F.col("face").alias("other"), "ring", F.col("box").alias("wide"))
    pairs = inner.join(around, keys).where("face != other and wide.x0 <= box.x0 and wide.x1 >= box.x1 and wide.y0 <= box.y0 and wide.y1 >= box.y1")
    hidden = pairs.where(geo.ring_contains(F.col("at.x"), F.col("at.y"), F.col("ring"))).select(*keys, "face").distinct()
    return out.join(hidden, [*keys, "face"], "left_anti").select(single.columns).union(single).drop("box", "parts")


def uncovered(inner: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """keys (distinct) where a part of the inner outlines is outside the outer ones. inner, outer: keys, ring."""
    side = lambda d: pieces(d.select(*keys, F.col("ring").alias("line")), keys)
    rim = side(outer.join(inner.select(*keys).distinct(), keys, "left_semi")).withColumn("k", F.lit(1)).drop("n")
    both = noded(side(inner).withColumn("k", F.lit(0)).drop("n").unionByName(rim).select(*keys, "p", "q", F.when(F.col("k") == 0, 1 << 20).otherwise(1).cast("bigint").alias("n")).groupBy(*keys, "p", "q").agg(F.sum("n").alias("n")), keys)
    # n tells who owns a piece: inner ones count 2**20 each, outer ones 1
    alone = both.where(f"n >= {1 << 20} and n % {1 << 20} = 0").select(*keys, "p", "q", ((F.col("p.x") + F.col("q.x")) / 2).alias("mx"), ((F.col("p.y") + F.col("q.y")) / 2).alias("my"))
    ray = crossings(F.col("mx"), F.col("my"), F.col("r.x"), F.col("r.y"), F.col("s.x"), F.col("s.y"))
    met = alone.join(rim.select(*keys, F.col("p").alias("r"), F.col("q").alias("s")), keys, "left").groupBy(*keys, "p", "q").agg(F.count_if(ray).alias("crossed"))
    return met.where("crossed % 2 = 0").select(*keys).distinct()


def simple(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ok: whether a closed line (keys, line; one a key) is a ring that neither crosses, touches nor covers itself."""
    cut = noded(pieces(lines, keys), keys)
    ends = cut.select(*keys, F.explode(F.array("p", "q")).alias("node"), "n").groupBy(*keys, "node").agg(F.sum("n").alias("d"))
    fair = ends.groupBy(*keys).agg(F.bool_and(F.col("d") == 2).alias("two"), F.count(F.lit(1)).alias("corners"))
    once = cut.groupBy(*keys).agg(F.bool_and(F.col("n") == 1).alias("once"))
    return fair.join(once, keys).select(*keys, (F.col("two") & F.col("once") & (F.col("corners") >= 3)).alias("ok"))


def areas(objects: DataFrame, members: DataFrame, way_refs: DataFrame, locations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features, unresolved) of tagged objects.

    objects: osm_type, id, kind, name, tags; members: id, mtype, mid, role of relations, in the order of the column pos
    where there is one; way_refs: way, pos, node; locations: node, x, y. features: osm_type, id, kind, name, rings,
    notes; unresolved: with the reason of the first check that fails instead of rings.

    A node is a point, a closed way of four refs or more a ring if it is simple, and a multipolygon relation what its
    outer lines enclose without what its inner ones do: rings are outlines of both, so that a point is inside where it is
    inside an odd number of them. Lines of a relation may cross, and are put together whatever their order and direction.
    """
    scratch = Scratch(objects.sparkSession)
    pos = F.col("pos") if "pos" in members.columns else F.lit(0)
    m = members.select("id", "mtype", "mid", "role", pos.alias("at"))
    placed = way_refs.join(locations, "node", "left").groupBy("way").agg(F.sort_array(F.collect_list(F.struct("pos", "node", "x", "y"))).alias("p"), F.count_if(F.col("x").isNull()).alias("missing"))
    closed = (F.size("p") >= 4) & (F.element_at("p", 1)["node"] == F.element_at("p", -1)["node"])
    line = scratch.keep(placed.select("way", F.transform("p", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).cast(f"array<{POINT}>").alias("line"), (F.col("missing") > 0).alias("gap"), closed.alias("closed")), "lines")

    points = objects.where("osm_type = 'node'").join(locations.select(F.col("node").alias("id"), "x", "y"), "id", "left")
    pts = points.select("osm_type", "id", "kind", "name", F.when(F.col("x").isNotNull(), F.array(F.array(point("x", "y")))).cast(f"array<array<{POINT}>>").alias("rings"), F.array().cast("array<string>").alias("notes"), F.when(F.col("x").isNull(), "missing_nodes").alias("reason"))

    ways = objects.where("osm_type = 'way'").join(line.withColumnRenamed("way", "id"), "id", "left")
    fine = simple(ways.where("line is not null and not gap and closed").select("id", "line").dropDuplicates(["id"]), ["id"])
    ways = ways.join(fine, "id", "left")
    why = F.when(F.col("line").isNull() | F.col("gap"), "missing_nodes").when(~F.col("closed"), "open_way_not_area").when(~F.coalesce("ok", F.lit(False)), "invalid_geometry")
    way_rows = ways.select("osm_type", "id", "kind", "name", F.when(why.isNull(), F.array(F.when(signed_area(F.col("line")) < 0, F.reverse("line")).otherwise(F.col("line")))).alias("rings"), F.array().cast("array<string>").alias("notes"), why.alias("reason"))

    rel = objects.where("osm_type = 'relation'")
    typed = F.coalesce(F.try_element_at("tags", F.lit("type")), F.lit("")).isin("multipolygon", "boundary")
    side = F.when(F.col("role") == "inner", "inner").otherwise("outer")
    fault = F.when(F.col("mtype") == 2, "nested_relation").when((F.col("mtype") != 1) | (F.col("role") == "balcony"), None).when(~F.col("role").isin("", "outer", "inner"), "unknown_role").when(F.col("line").isNull() | F.col("gap"), "missing_nodes")
    d = scratch.keep(m.join(rel.where(typed).select("id").distinct(), "id", "left_semi").join(line.withColumnRenamed("way", "mid"), "mid", "left").select("id", "at", "mtype", "role", "line", side.alias("side"), fault.alias("fault")), "members")
    used = (F.col("mtype") == 1) & (F.col("role") != "balcony")
    per = d.groupBy("id").agg(F.min(F.when(F.col("fault").isNotNull(), F.struct("at", "fault")))["fault"].alias("fault"), F.count_if(used & (F.col("side") == "outer")).alias("outer"), F.count_if(used & (F.col("side") == "inner")).alias("inner"), F.max((F.col("mtype") == 1) & (F.col("role") == "balcony")).alias("balcony"))
    sound = per.where("fault is null and outer > 0").select("id")
    keys = ["id", "side"]
    cut = noded(pieces(d.where(used).join(sound, "id", "left_semi").select(*keys, "line"), keys), keys)
    rings, loose = faces(cut, keys, scratch)
    whole = scratch.keep(union(rings, keys), "union")
    bounded = rings.where("area > 0").select(*keys).distinct().withColumn("some", F.lit(True))
    of = lambda t, s, *c: t.where(F.col("side") == s).select("id", *[F.col(x).alias(f"{s}_{x}") for x in c])
    state = per.join(of(loose, "outer", "n_loose"), "id", "left").join(of(loose, "inner", "n_loose"), "id", "left").join(of(bounded, "outer", "some"), "id", "left").join(of(bounded, "inner", "some"), "id", "left")
    outside = uncovered(whole.where("side = 'inner'").select("id", "ring"), whole.where("side = 'outer'").select("id", "ring"), ["id"]).withColumn("outside", F.lit(True))
    # outer outlines first; inner ones the other way around, so that areas add up
    turned = whole.select("id", "face", "side", "area", F.when(F.col("side") == "inner", F.reverse("ring")).otherwise(F.col("ring")).alias("ring"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((F.col("side") == "inner").alias("inner"), "face", "ring"))), lambda s: s["ring"])
    shape = turned.groupBy("id").agg(F.sum(F.when(F.col("side") == "outer", F.col("area")).otherwise(-F.col("area"))).alias("area"), F.sum(F.when(F.col("side") == "outer", F.col("area"))).alias("full"), listed.alias("rings"))
    r = rel.join(state.join(outside, "id", "left").join(shape, "id", "left"), "id", "left")
    reason = (
        F.when(~typed, "relation_not_multipolygon").when(F.col("fault").isNotNull(), F.col("fault")).when(F.coalesce("outer", F.lit(0)) == 0, "no_outer")
        .when(F.col("outer_some").isNull(), "outer_does_not_close").when(F.col("outer_n_loose") > 0, "unclosed_outer_fragment")
        .when((F.col("inner") > 0) & F.col("inner_some").isNull(), "inner_does_not_close").when(F.col("inner_n_loose") > 0, "unclosed_inner_fragment")
        .when(F.col("outside"), "inner_outside_outer").when(F.col("area") <= 1e-12 * F.col("full"), "invalid_geometry")
    )
    note = F.when(F.col("balcony"), F.array(F.lit("balcony member ignored"))).otherwise(F.array().cast("array<string>"))
    rel_rows = r.select("osm_type", "id", "kind", "name", F.when(reason.isNull(), F.col("rings")).alias("rings"), note.alias("notes"), reason.alias("reason"))
    every = materialize(pts.unionByName(way_rows).unionByName(rel_rows), "areas")
    scratch.drop()
    return every.where("reason is null").drop("reason"), every.where("reason is not null").drop("rings", "notes")


def signed_area(ring: Column) -> Column:
    """Positive for an anticlockwise ring; corners are taken from the first, which keeps large coordinates exact."""
    at = lambda i: F.element_at(ring, i)
    wedge = lambda i: (at(i)["x"] - at(1)["x"]) * (at(i + 1)["y"] - at(1)["y"]) - (at(i + 1)["x"] - at(1)["x"]) * (at(i)["y"] - at(1)["y"])
    return F.when(F.size(ring) > 3, F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(0.0), lambda s, i: s + wedge(i)) / 2).otherwise(F.lit(0.0))


def area(rings: Column) -> Column:
    """Square metres of a feature's rings: outer ones run anticlockwise, inner ones clockwise."""
    return F.aggregate(rings, F.lit(0.0), lambda s, r: s + signed_area(r))
