"""Zones of features: all that is inside a feature or within a radius of its outlines, measured along edges.

Around each side of an outline the zone is a capsule, which cuts one interval out of a straight edge. What is inside the
outlines comes from an index of grid cells: a cell without sides is inside as a whole or outside as a whole; of one with
sides (border) it is known whether its middle is inside, and the crossings of an edge with the cell's sides are
the places where the edge goes in and out. The covered length of an edge is that of the union of all its intervals, summed
over squares of a quadtree: those that a zone covers, those that few sides reach, and the smallest there are.

For a region with a reach of many cells the cells themselves are told apart first: cells so near to a border cell that
any point of theirs is in reach are inside, cells too far from all are outside, and only the ring between them needs
sides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wegloom.functions import constants as C
from wegloom.functions import geo
from wegloom.plans.shared import Scratch

ENDS = ("x0", "y0", "x1", "y1")
MOST_CELLS = 1 << 20  # of one side or edge: a coordinate that is off by continents


def sides(features: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x0, y0, x1, y1: the sides of all rings; a ring of one point is a side without length."""
    n = F.size("ring")
    each = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(F.element_at("ring", i).alias("a"), F.element_at("ring", F.least(i + 1, n)).alias("b")))
    return features.select(*keys, F.explode("rings").alias("ring")).where(n > 0).select(*keys, F.explode(each).alias("s")).select(*keys, F.col("s.a.x").alias("x0"), F.col("s.a.y").alias("y0"), F.col("s.b.x").alias("x1"), F.col("s.b.y").alias("y1"))


def interior(border: DataFrame, keys: list[str], size: float, scratch: Scratch) -> DataFrame:
    """keys, c (cell), middle (whether its middle is inside), sides (array; null where the cell has none).

    border: sides. Cells that are outside as a whole are left out. Rows of cells are gone through along their middle
    line: between its crossings with the sides, taken in pairs, the middles are inside.
    """
    held = scratch.keep(border.where(geo.distance(*[F.col(c) for c in ENDS]) > 0), "border")
    ay, by = F.least("y0", "y1"), F.greatest("y0", "y1")
    # the middle lines, (k + 0.5) * size, with ay <= line < by: a middle on a side counts as right of it, or above it (flips)
    first, last = F.ceil(ay / size - 0.5).cast("bigint"), F.ceil(by / size - 0.5).cast("bigint") - 1
    rows = held.where(last >= first).select(*keys, *ENDS, F.explode(F.sequence(first, last)).alias("cy")).withColumn("y", (F.col("cy") + 0.5) * size)
    rows = rows.where((F.col("y0") > F.col("y")) != (F.col("y1") > F.col("y")))
    x = F.col("x0") + (F.col("y") - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    w = Window.partitionBy(*keys, "cy").orderBy("x")
    pairs = rows.select(*keys, "cy", x.alias("x")).select(*keys, "cy", "x", F.lead("x").over(w).alias("to"), F.row_number().over(w).alias("i")).where("i % 2 = 1 and to is not null")
    begin, end = F.ceil(F.col("x") / size - 0.5).cast("bigint"), F.ceil(F.col("to") / size - 0.5).cast("bigint") - 1
    middles = pairs.where(end >= begin).select(*keys, F.explode(F.sequence(begin, end)).alias("cx"), "cy").select(*keys, F.struct("cx", "cy").alias("c"), F.lit(True).alias("middle")).distinct()
    crossed = held.select(*keys, *ENDS, F.explode(geo.line_cells(*[F.col(c) for c in ENDS], 0.0, size)).alias("c")).groupBy(*keys, "c").agg(F.collect_list(F.struct(*ENDS)).alias("sides"))
    return middles.join(crossed, [*keys, "c"], "full").select(*keys, "c", F.coalesce("middle", F.lit(False)).alias("middle"), "sides")


def flips(sides: np.ndarray, px, py, qx, qy) -> int:
    """How many sides (rows x0, y0, x1, y1) are crossed from p along x and then along y to q. A point on a side counts as
    a little right of it, or else above it, as interior() has it."""
    if not len(sides):
        return 0
    x0, y0, x1, y1 = sides.T
    with np.errstate(divide="ignore", invalid="ignore"):
        at, slope = x0 + (py - y0) / (y1 - y0) * (x1 - x0), (y1 - y0) / (x1 - x0)
        up = y0 + (qx - x0) * slope
    along = ((y0 > py) != (y1 > py)) & ((at <= px) != (at <= qx))
    below = lambda y: (up < y) | ((up == y) & (slope <= 0))
    return int(along.sum() + (((x0 > qx) != (x1 > qx)) & (below(py) != below(qy))).sum())


def gaps(x, y, s: np.ndarray):
    """Distances of points from the sides s, which are broadcast against one another."""
    x0, y0, x1, y1 = s.T
    dx, dy = x1 - x0, y1 - y0
    long = dx * dx + dy * dy
    t = np.clip(((x - x0) * dx + (y - y0) * dy) / np.where(long > 0, long, 1.0), 0.0, 1.0)
    return np.hypot(x - x0 - t * dx, y - y0 - t * dy)


def quarters(x: float, y: float, side: float, r: float, near: np.ndarray, own: list, few: int, finest: float) -> list:
    """[(x, y, side, near, own)]: the squares of a quadtree in a square that a kind's zone covers (near is None) or meets
    in few sides, or the smallest ones. near: sides that may be in reach; own: (middle, sides) of each feature with sides."""
    half = side / 2
    cx, cy, away = x + half, y + half, half * 2**0.5
    near = near[gaps(cx, cy, near) <= r + away * (1 + 1e-9)]
    corner = np.array([(x, y), (x + side, y), (x, y + side), (x + side, y + side)])
    if any(m and not len(s) for m, s in own) or (len(near) and (gaps(corner[:, :1], corner[:, 1:], near) <= r).all(0).any()):
        return [(x, y, side, None, [])]
    own = [(m, s) for m, s in own if len(s)]
    if not len(near) and not own:
        return []
    if side <= finest or (len(near) <= few and not own):
        return [(x, y, side, near, own)]
    out = []
    for i in (0, 1):
        for j in (0, 1):
            kx, ky = x + i * half, y + j * half
            mx, my = kx + half / 2, ky + half / 2
            inner = [(bool(m) != bool(flips(s, cx, cy, mx, my) % 2), s[gaps(mx, my, s) <= away / 2 * (1 + 1e-9)]) for m, s in own]
            out.append(quarters(kx, ky, half, r, near, inner, few, finest))
    if all(len(o) == 1 and o[0][2] == half and o[0][3] is None for o in out):
        return [(x, y, side, None, [])]
    return [p for o in out for p in o]


FINEST, FEW = 3, 8  # a cell is halved up to so many times, until no more sides are in reach
SIDES = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
PART = f"x double, y double, side double, r double, whole boolean, near {SIDES}, own array<struct<middle:boolean,sides:{SIDES}>>"


def _rows(sides: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list of sides as rows."""
    flat = sides.combine_chunks() if isinstance(sides, pa.ChunkedArray) else sides
    return np.stack([f.to_numpy(zero_copy_only=False).astype(float) for f in flat.flatten()], 1) if len(flat) else np.zeros((0, 4))


def _lists(values: pa.Array) -> list:
    """A column of lists of sides as arrays of rows; null: none."""
    at, flat = values.offsets.to_numpy() - values.offsets[0].as_py(), _rows(values.flatten())
    return [flat[a:b] for a, b in zip(at, at[1:])] if len(values) else []


def _sides_of(rows: np.ndarray) -> list:
    return [dict(zip(ENDS, map(float, s))) for s in rows]


def parts(near: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """kind, c and PART: the squares of each cell that a kind's zone covers or meets. near: kind, radius, c, and the sides
    in reach of the cell; cells: kind, c, middle, sides of features, as of interior()."""
    schema = near.select("kind", "c").schema.simpleString()[7:-1]

    def cut(a: pa.Table, b: pa.Table) -> pa.Table:
        some = a if a.num_rows else b
        c = some.column("c")[0].as_py()
        r = a.column("radius")[0].as_py() if a.num_rows else 0.0
        sides = np.stack([a.column(e).to_numpy() for e in ENDS], 1) if a.num_rows else np.zeros((0, 4))
        own = list(zip(b.column("middle").to_pylist(), _lists(b.column("sides").combine_chunks()))) if b.num_rows else []
        found = quarters(c["cx"] * size, c["cy"] * size, size, r, np.unique(sides, axis=0), own, FEW, size / (1 << FINEST))
        rows = [{"kind": some.column("kind")[0].as_py(), "c": c, "x": x, "y": y, "side": s, "r": r, "whole": n is None, "near": _sides_of(n) if n is not None else [], "own": [{"middle": bool(m), "sides": _sides_of(q)} for m, q in o]} for x, y, s, n, o in found]
        return pa.Table.from_pylist(rows, OUT)

    side = pa.list_(pa.struct([(e, pa.float64()) for e in ENDS]))
    OUT = pa.schema([("kind", pa.string()), ("c", pa.struct([("cx", pa.int64()), ("cy", pa.int64())])), *[(n, pa.float64()) for n in ("x", "y", "side", "r")], ("whole", pa.bool_()), ("near", side), ("own", pa.list_(pa.struct([("middle", pa.bool_()), ("sides", side)])))])
    return near.groupBy("kind", "c").cogroup(cells.groupBy("kind", "c")).applyInArrow(cut, f"kind string, c struct<cx:bigint,cy:bigint>, {PART}")


def inner_parts(line: tuple, lo: float, hi: float, middle: bool, sides: np.ndarray, cx: float, cy: float) -> list:
    """[(lo, hi)]: what of a line, within a square, is inside a feature with sides there; middle: whether the square's
    middle, cx, cy, is."""
    ax, ay, bx, by = line
    dx, dy = bx - ax, by - ay
    x0, y0, x1, y1 = sides.T
    u, v = dx * (y0 - ay) - dy * (x0 - ax), dx * (y1 - ay) - dy * (x1 - ax)
    met = (u > 0) != (v > 0)
    k = u[met] / (u[met] - v[met])
    mx, my = x0[met] + k * (x1[met] - x0[met]), y0[met] + k * (y1[met] - y0[met])
    t = (mx - ax) / dx if abs(dx) >= abs(dy) and dx else (my - ay) / dy if dy else np.zeros(0)
    stops = [lo, *sorted(t[(t > lo) & (t < hi)].tolist()), hi]
    m = (stops[0] + stops[1]) / 2
    inside = bool(middle) != bool(flips(sides, cx, cy, ax + m * dx, ay + m * dy) % 2)
    return [(p, q) for i, (p, q) in enumerate(zip(stops, stops[1:])) if inside == (i % 2 == 0)]


def _clips(begin, d, low, high):
    """The shares of lines at which begin + share * d is between low and high; an empty one where that is never so."""
    with np.errstate(divide="ignore", invalid="ignore"):
        s, t = (low - begin) / d, (high - begin) / d
    still = d == 0
    inside = (begin >= low) & (begin < high)
    return np.where(still, np.where(inside, 0.0, 2.0), np.minimum(s, t)), np.where(still, 1.0, np.maximum(s, t))


def _shares(lines: np.ndarray, px: float, py: float, side: float, r: float, whole: bool, near: np.ndarray, own: list) -> np.ndarray:
    """How much of each line lies in a square and in its zone; a line along a border belongs to one square."""
    ax, ay = lines[:, 0], lines[:, 1]
    dx, dy = lines[:, 2] - ax, lines[:, 3] - ay
    (l0, h0), (l1, h1) = _clips(ax, dx, px, px + side), _clips(ay, dy, py, py + side)
    lo, hi = np.maximum(0.0, np.maximum(l0, l1)), np.minimum(1.0, np.minimum(h0, h1))
    out = np.zeros(len(lines))
    at = np.flatnonzero(hi > lo)
    if whole:
        out[at] = hi[at] - lo[at]
        return out
    for some in np.array_split(at, len(at) * max(len(near), 1) // 1_000_000 + 1):
        out[some] = _union(lines[some], lo[some], hi[some], px + side / 2, py + side / 2, r, near, own)
    return out


def _union(lines: np.ndarray, lo, hi, cx: float, cy: float, r: float, near: np.ndarray, own: list) -> np.ndarray:
    """For each line the length of the union of what capsules around the sides near and features cut out of lo to hi."""
    n, (ax, ay) = len(lines), lines.T[:2, :, None]
    dx, dy = lines.T[2][:, None] - ax, lines.T[3][:, None] - ay
    x0, y0, x1, y1 = near.T
    long = np.hypot(x1 - x0, y1 - y0)
    a = dx * dx + dy * dy
    first, last = np.full((n, len(near)), np.inf), np.full((n, len(near)), -np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        for sx, sy in ((x0, y0), (x1, y1)):
            fx, fy = ax - sx, ay - sy
            b, c = dx * fx + dy * fy, fx * fx + fy * fy - r * r
            root = np.sqrt(np.maximum(b * b - a * c, 0.0))
            s, t = np.where(a > 0, (-b - root) / a, 0.0), np.where(a > 0, (-b + root) / a, 1.0)
            ok = np.where(a > 0, b * b > a * c, c <= 0)
            first, last = np.where(ok, np.minimum(first, s), first), np.where(ok, np.maximum(last, t), last)
        ux, uy = (x1 - x0) / long, (y1 - y0) / long
        gx, gy = ax - x0, ay - y0
        (s0, t0), (s1, t1) = _clips(gx * ux + gy * uy, dx * ux + dy * uy, 0.0, long), _clips(gx * uy - gy * ux, dx * uy - dy * ux, -r, r)
        s, t = np.maximum(s0, s1), np.minimum(t0, t1)
        ok = (long > 0) & (t > s)
    # a capsule is convex: what its parts cut out is one interval
    first, last = np.where(ok, np.minimum(first, s), first), np.where(ok, np.maximum(last, t), last)
    first, last = np.maximum(first, lo[:, None]), np.minimum(last, hi[:, None])
    row, k = np.nonzero(last > first)
    begin, end = first[row, k], last[row, k]
    if own:
        more = [(i, *p) for i in range(n) for m, s in own for p in inner_parts(tuple(lines[i]), lo[i], hi[i], m, s, cx, cy)]
        if more:
            i, p, q = map(np.array, zip(*more))
            row, begin, end = np.concatenate([row, i]), np.concatenate([begin, p]), np.concatenate([end, q])
    order = np.lexsort((begin, row))
    row, begin, end = row[order], begin[order], end[order]
    # the furthest end before, of a row's intervals: shares are below 2, so rows don't mix
    to = np.maximum.accumulate(end + 2.0 * row) - 2.0 * row if len(row) else end
    to = np.where(np.r_[True, row[1:] != row[:-1]], -1.0, np.r_[-1.0, to[:-1]]) if len(row) else to
    return np.bincount(row, np.maximum(0.0, end - np.maximum(begin, to)), n)


SALTS = 4  # a cell's lines are measured in so many groups


def measured(lines: DataFrame, squares: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind, share: how much of each line (keys, x0, y0, x1, y1, with a row for each cell c) is in the zone of a kind;
    squares: kind, c, PART. A line is measured cell by cell over the cell's squares, and squares don't overlap, so no row
    is made of a line and a side."""
    types = dict(lines.dtypes)
    held = squares.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = lines.select(*dict.fromkeys([*keys, *ENDS]), "c", F.pmod(F.xxhash64(*ENDS), F.lit(SALTS)).cast("int").alias("salt"))

    def share(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            at = np.stack([a.column(e).to_numpy() for e in ENDS], 1)
            kinds, near = np.array(b.column("kind").to_pylist()), _lists(b.column("near").combine_chunks())
            own = [[(o["middle"], np.array([[q[e] for e in ENDS] for q in o["sides"]]).reshape(-1, 4)) for o in v] for v in b.column("own").to_pylist()]
            x, y, side, r, whole = (b.column(c).to_pylist() for c in ("x", "y", "side", "r", "whole"))
            for kind in dict.fromkeys(kinds.tolist()):
                sums = np.zeros(len(at))
                for i in np.flatnonzero(kinds == kind).tolist():
                    sums += _shares(at, x[i], y[i], side[i], r[i], whole[i], near[i], own[i])
                some = np.flatnonzero(sums > 0)
                out.append(pa.table([*[a.column(k).take(some) for k in keys], pa.array([kind] * len(some), pa.string()), pa.array(sums[some])], names=[*keys, "kind", "share"]))
        return pa.concat_tables(out) if out else pa.table([*[a.column(k).slice(0, 0) if a.num_columns else [] for k in keys], pa.array([], pa.string()), pa.array([], pa.float64())], names=[*keys, "kind", "share"])

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", kind string, share double"
    return rows.groupBy("c", "salt").cogroup(held.groupBy("c", "salt")).applyInArrow(share, schema).groupBy(*keys, "kind").agg(F.sum("share").alias("share"))


def celled(edges: DataFrame, size: float) -> DataFrame:
    """edges (x0, y0, x1, y1) with a row for each cell that they pass."""
    return edges.withColumn("c", F.explode(geo.line_cells(*[F.col(c) for c in ENDS], 0.0, size)))


def fair(*c: str) -> Column:
    """Whether coordinates are finite and no more than MOST_CELLS cells apart."""
    bad = [F.col(x).isNull() | F.isnan(x) | (F.abs(x) == float("inf")) for x in c]
    ok = ~bad[0]
    for b in bad[1:]:
        ok = ok & ~b
    return ok & (F.abs(F.col(c[0]) - F.col(c[2])) + F.abs(F.col(c[1]) - F.col(c[3])) < C.CELL_M * MOST_CELLS)


def exposure(edges: DataFrame, features: DataFrame, radii: DataFrame, size: float = C.CELL_M) -> DataFrame:
    """edge id, kind, covered: metres of each edge inside a kind's features or within its radius of them.

    edges: id, ax, ay, bx, by, length_m, separated (those over or under others have no exposure); features: kind, rings
    (a point is a ring of one); radii: kind, radius. Kinds without a radius, empty rings, edges without length and edges
    whose ends are no fair coordinates give nothing. Edges of the same ends are measured once.
    """
    scratch = Scratch(edges.sparkSession)
    a, b = (F.struct(F.col(f"{s}x").alias("x"), F.col(f"{s}y").alias("y")) for s in "ab")
    e = edges.where("not separated").select("id", "length_m", F.struct(F.least(a, b).alias("p"), F.greatest(a, b).alias("q")).alias("shape"))
    lines = e.where("shape.p != shape.q").select("shape").distinct().select("shape", *[F.col(f"shape.{s}.{c}").alias(n) for s, c, n in (("p", "x", "x0"), ("p", "y", "y0"), ("q", "x", "x1"), ("q", "y", "y1"))]).where(fair(*ENDS))
    lines = scratch.keep(celled(lines, size), "lines")
    whole = features.join(F.broadcast(radii), "kind").withColumn("feature", F.xxhash64("rings"))
    outline = scratch.keep(sides(whole, ["kind", "radius", "feature"]).where(fair(*ENDS)).distinct(), "sides")
    # sides that two features share count once for each radius
    around = outline.select("kind", "radius", *ENDS).distinct().select("kind", "radius", *ENDS, F.explode(geo.line_cells(*[F.col(c) for c in ENDS], F.col("radius"), size)).alias("c"))
    cells = interior(outline.select("kind", "feature", *ENDS), ["kind", "feature"], size, scratch)
    held = scratch.keep(parts(around, cells, size), "parts")
    share = measured(lines, held, list(ENDS))
    ends = F.struct(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")).alias("p"), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")).alias("q"))
    share = share.where("share > 1e-12").select(ends.alias("shape"), "kind", "share")
    return e.join(share, "shape").select("id", "kind", (F.least(F.lit(1.0), "share") * F.col("length_m")).alias("covered"))


def region_index(rings: DataFrame, reach: float, size: float = C.CELL_M) -> DataFrame:
    """c, inside (as a whole), middle, sides, near: the cells of a region (column rings; rows are united) and of what is
    within `reach` of it. near: the sides within reach of a cell that is not inside as a whole."""
    scratch = Scratch(rings.sparkSession)
    region = rings.select(F.xxhash64("rings").alias("feature"), "rings")
    outline = scratch.keep(sides(region, ["feature"]).where(fair(*ENDS)), "sides")
    own = scratch.keep(interior(outline, ["feature"], size, scratch), "cells")
    border = outline.select(*ENDS, F.explode(geo.line_cells(*[F.col(c) for c in ENDS], 0.0, size)).alias("b")).distinct()
    k = int(reach // size) + 1
    spread = F.flatten(F.transform(F.sequence(F.lit(-k), F.lit(k)), lambda i: F.transform(F.sequence(F.lit(-k), F.lit(k)), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    gap = lambda v: F.greatest(F.abs(v) - 1, F.lit(0))
    wide = lambda v: F.abs(v) + 1
    far = lambda f: F.sqrt(f(F.col("o.i")) * f(F.col("o.i")) + f(F.col("o.j")) * f(F.col("o.j"))) * size
    pairs = border.select("b").distinct().select("b", F.explode(spread).alias("o")).where(far(gap) <= reach)
    pairs = scratch.keep(pairs.select("b", F.struct((F.col("b.cx") + F.col("o.i")).alias("cx"), (F.col("b.cy") + F.col("o.j")).alias("cy")).alias("c"), (far(wide) <= reach).alias("all")), "pairs")
    marks = pairs.groupBy("c").agg(F.bool_or("all").alias("all"))
    plain = own.where("middle and sides is null").select("c").distinct().withColumn("within", F.lit(True))
    state = marks.join(plain, "c", "full").select("c", (F.coalesce("all", F.lit(False)) | F.coalesce("within", F.lit(False))).alias("inside"))
    loose = state.where("not inside").select("c")
    near = pairs.join(loose, "c", "left_semi").join(border, "b").groupBy("c").agg(F.collect_set(F.struct(*ENDS)).alias("near"))
    # what cells with sides hold inside, feature by feature
    held = own.join(loose, "c", "left_semi").groupBy("c").agg(F.collect_list(F.struct("middle", "sides")).alias("own"))
    out = scratch.keep(state.join(near, "c", "left").join(held, "c", "left"), "region")
    scratch.drop(but=1)
    return out


def covered_share(lines: DataFrame, index: DataFrame, reach: float, keys: list[str], size: float = C.CELL_M) -> DataFrame:
    """keys, share: how much of each line (x0, y0, x1, y1) is in the region or within reach of it; lines that have none
    are left out."""
    on = celled(lines.where(fair(*ENDS)).select(*dict.fromkeys([*keys, *ENDS])), size).join(index.select("c", "inside"), "c")
    lo, hi = F.lit(0.0), F.lit(1.0)
    for v in "xy":
        begin, d, low = F.col(f"{v}0"), F.nullif(F.col(f"{v}1") - F.col(f"{v}0"), F.lit(0.0)), F.col(f"c.c{v}") * size
        s, t = (low - begin) / d, (low + size - begin) / d
        # a line along a cell's border is in one cell
        lo, hi = F.greatest(lo, F.coalesce(F.least(s, t), F.when((begin >= low) & (begin < low + size), 0.0).otherwise(2.0))), F.least(hi, F.coalesce(F.greatest(s, t), F.lit(1.0)))
    full = on.where("inside").select(*keys, F.greatest(hi - lo, F.lit(0.0)).alias("share")).where("share > 0")
    none = F.array().cast(SIDES)
    own = F.transform(F.coalesce("own", F.array().cast(f"array<struct<middle:boolean,sides:{SIDES}>>")), lambda o: F.struct(o["middle"].alias("middle"), F.coalesce(o["sides"], none).alias("sides")))
    rim = index.where("not inside").select(F.lit("").alias("kind"), "c", (F.col("c.cx") * size).alias("x"), (F.col("c.cy") * size).alias("y"), F.lit(size).alias("side"), F.lit(float(reach)).alias("r"), F.lit(False).alias("whole"), F.coalesce("near", none).alias("near"), own.alias("own"))
    part = measured(on.where("not inside"), rim, keys).select(*keys, "share")
    return full.unionByName(part).groupBy(*keys).agg(F.least(F.lit(1.0), F.sum("share")).alias("share"))


def covered(lines: DataFrame, index: DataFrame, reach: float, keys: list[str], size: float = C.CELL_M) -> DataFrame:
    """keys of the lines that are covered from end to end: up to a millionth of their length. Only lines with both ends in
    cells of the index are measured."""
    for i in "01":
        at = F.struct(geo.cell(F.col(f"x{i}"), size).alias("cx"), geo.cell(F.col(f"y{i}"), size).alias("cy"))
        lines = lines.join(index.select(F.col("c").alias("_c")), at == F.col("_c"), "left_semi")
    return covered_share(lines, index, reach, keys, size).where(F.col("share") >= 1 - 1e-6).select(*keys)
