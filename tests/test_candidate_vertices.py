"""Vertices of candidates are made distinct where they have been shuffled to, not in memory before that."""

from pyspark.sql import functions as F

from wegloom.operators import hospitals

OBJECTS = "osm_type string, id bigint, tags map<string,string>"


def test_distinct_after_the_shuffle(spark):
    tag = {"amenity": "hospital"}
    objects = spark.createDataFrame([("node", 1, tag), ("way", 7, tag), ("relation", 9, tag), ("relation", 10, tag), ("way", 8, {})], OBJECTS)
    members = spark.createDataFrame([(9, 1, 7), (9, 0, 1), (9, 1, 8), (10, 2, 9), (10, 0, 1)], "id bigint, mtype int, mid bigint")
    refs = spark.createDataFrame([(7, 1), (7, 2), (7, 3), (7, 1), (8, 3), (8, 4)], "way bigint, node bigint")
    at = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 0.0), (3, 6.0, 3.0), (4, 9.0, 9.0)], "node bigint, lon double, lat double")
    good, bad = hospitals.candidates(objects, members, refs, at, F.col("lon") < 5)
    assert sorted(tuple(r) for r in good.drop("tags").collect()) == [("node", 1, 0.0, 0.0, False), ("relation", 9, 4.5, 3.0, True), ("way", 7, 3.0, 1.0, True)]
    assert [(r["osm_type"], r["id"]) for r in bad.collect()] == [("relation", 10)]
    lines = good._jdf.queryExecution().executedPlan().toString().splitlines()
    at = [i for i, x in enumerate(lines) if "HashAggregate(keys=[" in x and all(f"{c}#" in x.split("]")[0] for c in ("osm_type", "id", "node"))]
    assert len(at) == 2 and at[1] == at[0] + 1
