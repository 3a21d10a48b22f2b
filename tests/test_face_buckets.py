"""Faces of many keys settled in one task, or by joins where a bucket is crowded: the same; and pairs of sides that only touch
at their ends are never shuffled."""

import random
import re

import pytest

from wegloom.operators import polygons
from wegloom.plans.shared import Scratch

LINES = "key int, line array<struct<x:double,y:double>>"


def lines_of(seed):
    """Random lines that cross, bridges, trees and rings in rings, of 12 keys."""
    rng = random.Random(seed)
    return [(k, [(float(rng.randrange(9)), float(rng.randrange(9))) for _ in range(rng.randrange(2, 6))]) for k in range(12) for _ in range(k + 1)]


@pytest.mark.parametrize("seed", [3, 4])
def test_buckets_as_joins(spark, seed):
    scratch = Scratch(spark)
    cut = scratch.keep(polygons.noded(polygons.pieces(spark.createDataFrame(lines_of(seed), LINES), ["key"]), ["key"]), "cut")

    def of(most):
        rings, loose = polygons.faces(cut, ["key"], scratch, most)
        return sorted((r["key"], round(r["area"], 6), sorted(map(tuple, r["ring"][1:]))) for r in rings.collect()), sorted(map(tuple, loose.collect()))

    rings, loose = of(polygons.MOST)
    assert (rings, loose) == of(1) and len(rings) > 20 and any(r[1] for r in loose)
    # what the faces of a key enclose is what its outlines do
    for k in range(12):
        assert sum(r[1] for r in rings if r[0] == k) == pytest.approx(0, abs=1e-4)


def test_only_cuts_are_shuffled(spark):
    plan = polygons.noded(polygons.pieces(spark.createDataFrame(lines_of(1), LINES), ["key"]), ["key"])._jdf.queryExecution().optimizedPlan().toString()
    keyed = re.findall(r"Aggregate \[([^\]]*)\]", plan)
    assert keyed and not [x for x in keyed if re.search(r"\br#", x)]
