"""Results that are replaced at once: failed writes, versions, archives, and index parts that are refreshed by source."""

import os

import pytest
from pyspark.sql import functions as F

from wegloom.operators import catalog
from wegloom.sources import files


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_failed_write_keeps_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        files.current(spark, path)
    put = lambda df: files.publish(spark, path, lambda folder: df.write.parquet(folder))
    put(spark.range(3))
    held = spark.read.parquet(files.current(spark, path))
    bad = spark.range(9).select(F.when(F.col("id") > 5, F.raise_error(F.lit("broken")).cast("bigint")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception):
        put(bad)
    assert ids(spark.read.parquet(files.current(spark, path))) == [0, 1, 2]
    put(spark.range(5))
    assert ids(spark.read.parquet(files.current(spark, path))) == [0, 1, 2, 3, 4] and ids(held) == [0, 1, 2]
    for n in (6, 7, 8):
        put(spark.range(n))
    assert len(ids(spark.read.parquet(files.current(spark, path)))) == 8 and len([x for x in os.listdir(f"{path}/versions") if not x.startswith(".")]) == 2
    assert not [x for x in os.listdir(path) if x.startswith(files.POINTER + ".")]


def test_archive_and_catalog(spark, tmp_path):
    path = str(tmp_path / "runs")
    first = files.archive(spark.range(2), path)
    bad = spark.range(3).select(F.raise_error(F.lit("broken")).cast("bigint").alias("id"))
    with pytest.raises(Exception):
        files.archive(bad, path)
    assert files.current(spark, path).endswith(first) and ids(spark.read.parquet(files.current(spark, path))) == [0, 1]
    nodes = spark.createDataFrame([(1, 0.0, 0.0, {}), (2, 600.0, 0.0, {})], "id bigint, x double, y double, tags map<string,string>")
    ways = spark.createDataFrame([(10, [1, 2], {"highway": "primary"})], "id bigint, refs array<bigint>, tags map<string,string>")
    cat = catalog.build_catalog(ways, nodes)
    catalog.write_catalog(cat, str(tmp_path / "cat"))
    with pytest.raises(Exception):
        catalog.write_catalog(cat.withColumn("minx", F.raise_error(F.lit("broken")).cast("double")), str(tmp_path / "cat"))
    assert [r["segment_id"] for r in catalog.in_radius(catalog.read_catalog(spark, str(tmp_path / "cat")), 300.0, 0.0, 50.0).collect()] == ["10:0"]


def test_parts_refreshed_by_source(spark, tmp_path):
    for name, text in (("a", '{"id": 1}\n'), ("b", '{"id": 2}\n')):
        (tmp_path / f"{name}.json").write_text(text)
    sources = {n: str(tmp_path / f"{n}.json") for n in "abc"}
    loaded = []

    def load(name, path):
        loaded.append(name)
        return spark.read.schema("id bigint").json(path)

    got = lambda: ids(files.refreshed(spark, str(tmp_path / "index"), sources, load))
    assert got() == [1, 2] and loaded == ["a", "b"]
    assert got() == [1, 2] and loaded == ["a", "b"]
    (tmp_path / "b.json").write_text('{"id": 2}\n{"id": 22}\n')
    assert got() == [1, 2, 22] and loaded == ["a", "b", "b"]
    (tmp_path / "a.json").unlink()
    (tmp_path / "b.json").write_text("version https://git-lfs.github.com/spec/v1\noid sha256:0\nsize 9\n")
    (tmp_path / "c.json").write_text('{"id": 3}\n')
    assert got() == [1, 2, 3, 22] and loaded == ["a", "b", "b", "c"]
    with pytest.raises(FileNotFoundError):
        files.refreshed(spark, str(tmp_path / "none"), {"x": str(tmp_path / "x.json")}, load)


def test_sinks_and_reports(spark, tmp_path):
    import json

    from wegloom.operators import reports

    files.write_sinks({"edges": spark.range(3), "audit": spark.createDataFrame([("zero_length", 2)], "reason string, n int")}, str(tmp_path / "net"))
    got = files.read_sinks(spark, str(tmp_path / "net"), "edges", "audit")
    assert ids(got["edges"]) == [0, 1, 2] and got["audit"].first()["n"] == 2
    square, hole, far = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0), (0.0, 0.0)], [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (1.0, 1.0)], [(20.0, 0.0), (22.0, 0.0), (22.0, 2.0), (20.0, 0.0)]
    rows = [("mall", "a", [square, far, hole]), ("school", 'b "x"', [[(3.0, 4.0)]])]
    features = spark.createDataFrame(rows, "kind string, name string, rings array<array<struct<x:double,y:double>>>")
    files.write_features(features, str(tmp_path / "poi"))
    lines = sorted((json.loads(r["value"]) for r in spark.read.text(files.current(spark, str(tmp_path / "poi"))).collect()), key=lambda f: f["properties"]["kind"])
    as_lists = lambda ring: [list(p) for p in ring]
    assert lines[0]["geometry"] == {"type": "MultiPolygon", "coordinates": [[as_lists(square), as_lists(hole)], [as_lists(far)]]}
    assert lines[1] == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [3.0, 4.0]}, "properties": {"kind": "school", "name": 'b "x"'}}
    files.write_report(spark, str(tmp_path / "report.md"), "Net", {"Audit": spark.createDataFrame([("b|c", 2), ("a", None)], "reason string, n int"), "Ids": spark.range(5)}, most=3)
    text = (tmp_path / "report.md").read_text()
    assert text.startswith("# Net\n\n## Audit\n\n| reason | n |\n|-|-|\n| a |  |\n| b\\|c | 2 |\n") and text.endswith("| 2 |\n\nMore than 3 rows; these are the first.\n")
    few, more = (ids(reports.sampled(spark.range(100).repartition(k), ["id"], n, 7)) for k, n in ((3, 10), (5, 20)))
    assert len(few) == 10 and set(few) < set(more) and few != ids(reports.sampled(spark.range(100), ["id"], 10, 8))
