"""Graphs, features and places from JSON, and results to files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wegloom.operators import polygons

EDGE = "struct<id:string,u:string,v:string,way_id:string,segment_index:int,direction:int,length_m:double,highway:string,speed_kmh:double,signal_at_end:boolean,rail_at_end:boolean,closed:boolean,exposure_m:map<string,double>,gate_wait_s:double>"
GRAPH = f"nodes map<string,array<double>>, edges array<{EDGE}>, turn_restrictions array<struct<from_way:string,to_way:string,via:string,restriction:string>>, goals array<string>, goal_hospitals map<string,array<string>>, start string"
FEATURES = "type string, features array<struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
PLACES = "items array<struct<id:string,name:string,kind:string,lat:double,lon:double,aliases:string,address:string>>"


def tables(doc: DataFrame) -> dict[str, DataFrame]:
    """A graph document as nodes, edges, rules and goals."""
    names = F.coalesce(F.try_element_at("goal_hospitals", F.col("node")), F.array().cast("array<string>"))
    return {
        "nodes": doc.select(F.explode("nodes").alias("id", "p")).select("id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y")),
        "edges": doc.select(F.explode("edges").alias("e")).select("e.*"),
        "rules": doc.select(F.explode("turn_restrictions").alias("r")).select("r.*"),
        "goals": doc.select("goal_hospitals", F.explode("goals").alias("node")).select("node", names.alias("hospitals")),
    }


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return tables(spark.read.schema(GRAPH).json(path, multiLine=True))


def read_graph_zstd(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The same from a zstd file, read whole by one task."""
    import zstandard

    raw = spark.read.format("binaryFile").load(path).select("content")

    def run(frames):
        for f in frames:
            f["text"] = [zstandard.ZstdDecompressor().stream_reader(bytes(c)).read().decode() for c in f["content"]]
            yield f[["text"]]

    return tables(raw.mapInPandas(run, "text string").select(F.from_json("text", GRAPH).alias("g")).select("g.*"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """type, coordinates (JSON text), properties of a feature collection."""
    f = spark.read.schema(FEATURES).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return f.select(F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """lon, lat, properties of the points of a feature collection."""
    p = F.from_json("coordinates", "array<double>")
    return read_features(spark, path).where("type = 'Point'").select(p[0].alias("lon"), p[1].alias("lat"), "properties")


def region(spark: SparkSession, path: str, osm_id: int) -> DataFrame:
    """ring: the outer rings (arrays of struct x, y in degrees) of one object in a geocoder's answer."""
    kinds = "osm_id bigint, geojson struct<type:string,coordinates:string>"
    r = spark.read.schema(kinds).json(path, multiLine=True).where(F.col("osm_id") == osm_id)
    ring = F.when(F.col("geojson.type") == "Polygon", F.array(F.from_json("geojson.coordinates", "array<array<array<double>>>")[0])).otherwise(F.transform(F.from_json("geojson.coordinates", "array<array<array<array<double>>>>"), lambda p: p[0]))
    return r.select(F.explode(ring).alias("ring")).select(F.transform("ring", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring"))


def read_places(spark: SparkSession, *paths: str) -> DataFrame:
    """Places of one or more index files, numbered in their order."""
    out = None
    for k, path in enumerate(paths):
        p = spark.read.schema(PLACES).json(path, multiLine=True).select(F.posexplode("items").alias("i", "p")).select((F.col("i").cast("bigint") + (k << 40)).alias("seq"), "p.*").drop("id")
        out = p if out is None else out.unionByName(p)
    return out


def demo(spark: SparkSession) -> dict[str, DataFrame]:
    """Two goals: the nearer one is behind a signal and a level crossing."""
    nodes = spark.createDataFrame([("S", 0.0, 0.0), ("A", 100.0, 0.0), ("B", 0.0, 300.0)], "id string, x double, y double")
    edges = spark.createDataFrame([("SA", "S", "A", "SA", 100.0, "primary", True, True), ("SB", "S", "B", "SB", 300.0, "primary", False, False)], "id string, u string, v string, way_id string, length_m double, highway string, signal_at_end boolean, rail_at_end boolean")
    return {"nodes": nodes, "edges": edges, "goals": spark.createDataFrame([("A", ["A"]), ("B", ["B"])], "node string, hospitals array<string>")}


def stage(df: DataFrame, path: str, signature: dict) -> DataFrame:
    """df written at path, or read from there if it was written under the same signature; another one is an error."""
    spark, text = df.sparkSession, json.dumps(signature, sort_keys=True)
    p = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p):
        old = spark.read.text(path + ".signature").first()[0]
        if old != text:
            raise ValueError("the stage was written from another source; use a new folder")
    else:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path + ".signature")
    return spark.read.parquet(path)


POINTER = "CURRENT"


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file with this text, in place at once: it is written beside and renamed over the old one."""
    jvm = spark._jvm
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    conf = spark._jsc.hadoopConfiguration()
    out = beside.getFileSystem(conf).create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), conf)
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, target, over)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def publish(spark: SparkSession, path: str, write: Callable[[str], None], keep: int = 2) -> str:
    """Let `write` write a new version below path, then point to it: readers see the old version or the new one, whole.

    A write that fails leaves the old version as it is. The `keep` newest versions stay, for readers that are under way;
    returns the version's folder. Two writers at once each write a version, and the last to end is pointed to.
    """
    name = f"v{datetime.now(timezone.utc).strftime('%Y%m%dT%H%M%S%f')}-{uuid.uuid4().hex[:8]}"
    folder = f"{path}/versions/{name}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write(folder)
    except BaseException:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(p, name), True)  # a part of a version is none
        raise
    _put(spark, f"{path}/{POINTER}", f"versions/{name}")
    for old in sorted(x.getPath().getName() for x in fs.listStatus(p))[:-keep]:
        if old < name:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(p, old), True)
    return folder


def current(spark: SparkSession, path: str) -> str:
    """The folder that is pointed to at path, looked up once; an error where nothing has been published."""
    if not _exists(spark, f"{path}/{POINTER}"):
        raise FileNotFoundError(f"nothing has been published at {path}")
    return f"{path}/{spark.read.text(f'{path}/{POINTER}', wholetext=True).first()[0].strip()}"


def archive(df: DataFrame, path: str, now: datetime | None = None) -> str:
    """Keep df under the time of the run, and point to it as the latest result (current); returns the run's name."""
    run = (now or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%S%fZ")
    df.write.mode("errorifexists").parquet(f"{path}/runs/run={run}")
    _put(df.sparkSession, f"{path}/{POINTER}", f"runs/run={run}")
    return run


def stamp(spark: SparkSession, *paths: str) -> str:
    """The paths with their files' sizes and times of change, as JSON; `absent` for a path that isn't there."""
    out = {}
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        out[path] = sorted([x.getPath().getName(), x.getLen(), x.getModificationTime()] for x in (fs.listStatus(p) if fs.exists(p) else [])) or "absent"
    return json.dumps(out, sort_keys=True)


def refreshed(spark: SparkSession, path: str, sources: dict[str, str], load: Callable[[str, str], DataFrame]) -> DataFrame:
    """Rows of all sources (name: path), as load(name, path) gives them, from the parts kept at path.

    Each source's part has a stamp. A source whose stamp has changed is loaded anew, and no other; where its file is
    absent or a pointer of a large-file store in place of its content, its old part is used. Parts are published, so a
    load that fails leaves the old ones; a source that was never there has no rows.
    """
    out = None
    for name, source in sources.items():
        part, now = f"{path}/{name}", stamp(spark, source)
        old = f"{current(spark, part)}" if _exists(spark, f"{part}/{POINTER}") else None
        known = spark.read.text(f"{old}/stamp", wholetext=True).first()[0].strip() if old else None
        here = _exists(spark, source) and not is_pointer(spark, source)
        if here and known != now:

            def write(folder: str, source=source, name=name, now=now) -> None:
                load(name, source).write.option("compression", "zstd").parquet(f"{folder}/rows")
                spark.createDataFrame([(now,)], "value string").coalesce(1).write.text(f"{folder}/stamp")

            old = publish(spark, part, write)
        if old:
            rows = spark.read.parquet(f"{old}/rows")
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError("no source is there, and none was before")
    return out


def is_pointer(spark: SparkSession, path: str) -> bool:
    """Whether a file is the pointer that a large-file store leaves in place of its content."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.getFileStatus(p).isFile() or fs.getFileStatus(p).getLen() > 1024:
        return False
    return spark.read.text(path, wholetext=True).first()[0].startswith("version https://git-lfs")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_graph(tables_: dict[str, DataFrame], path: str) -> None:
    for name, df in tables_.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of the files at path."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_sinks(tables_: dict[str, DataFrame], path: str) -> str:
    """Publish several results together (edges, way attributes, audits, mappings, features, zones, ...), each a folder of
    Parquet; readers see all of one version. Returns the version's folder."""
    spark = next(iter(tables_.values())).sparkSession

    def write(folder: str) -> None:
        for name, df in tables_.items():
            df.write.option("compression", "zstd").parquet(f"{folder}/{name}")

    return publish(spark, path, write)


def read_sinks(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """Results of the version last published at path."""
    folder = current(spark, path)
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def feature_collection(features: DataFrame) -> DataFrame:
    """value: a GeoJSON feature a row, of features with rings (polygons.areas; outer rings anticlockwise, a point is a ring
    of one) and further columns, which become properties. A hole goes to the outer ring before it that is around it."""
    pair = lambda p: F.array(p["x"], p["y"])
    ring = lambda r: F.transform(r, pair)
    point = F.size(F.element_at("rings", 1)) == 1
    outer = F.filter("rings", lambda r: polygons.signed_area(r) > 0)
    holes = lambda o: F.filter("rings", lambda r: (polygons.signed_area(r) < 0) & polygons.geo.ring_contains(F.element_at(r, 1)["x"], F.element_at(r, 1)["y"], o))
    shapes = F.transform(outer, lambda o: F.concat(F.array(ring(o)), F.transform(holes(o), ring)))
    properties = F.struct(*[c for c in features.columns if c != "rings"])
    own = F.when(point, F.to_json(F.struct(F.lit("Point").alias("type"), pair(F.element_at("rings", 1)[0]).alias("coordinates")))).otherwise(F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), shapes.alias("coordinates"))))
    return features.select(F.concat(F.lit('{"type":"Feature","geometry":'), own, F.lit(',"properties":'), F.to_json(properties), F.lit("}")).alias("value"))


def write_features(features: DataFrame, path: str) -> str:
    """Publish features as text, a GeoJSON feature a line."""
    return publish(features.sparkSession, path, lambda folder: feature_collection(features).write.text(folder))


def markdown(title: str, parts: dict[str, DataFrame], most: int = 200) -> str:
    """A report: a heading, and each part as a table of its first `most` rows, in the order of its columns; a part with
    more says so."""
    out = [f"# {title}"]
    for name, df in parts.items():
        rows = df.orderBy(*df.columns).limit(most + 1).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows[:most]]
        out += [f"\nMore than {most} rows; these are the first."] if len(rows) > most else []
    return "\n".join(out) + "\n"


def write_report(spark: SparkSession, path: str, title: str, parts: dict[str, DataFrame], most: int = 200) -> None:
    """Put the report in place at once, as a file at path."""
    _put(spark, path, markdown(title, parts, most))
