"""OSM PBF files as a Spark data source: format("osm_pbf"), option path (and entity), one partition a data block.

The driver walks the block headers alone; executors read, inflate and decode their blocks. The path is a local one, or a
URI that Arrow's file systems open (file, hdfs, s3, gs). Rows: kind ('node', 'way', 'relation'), id, lon, lat, tags, refs,
members, block.

With saved statistics of the blocks (option stats, written by save_statistics) those that can't hold a row asked for are
not read: by the options entity (a kind), ids (first..last) and keys (rows with one of these tag keys), for which a block
has a Bloom filter. Options, not conditions that Spark pushes down: Spark 4.1 keeps a Python source's pushed conditions for
all further uses of the same frame.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow.fs
import pyarrow.parquet
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "kind string, id bigint, lon double, lat double, tags map<string,string>, refs array<bigint>, members array<struct<mtype:int,mid:bigint,role:string>>, block bigint"
MOST_HEADER, MOST_BLOB = 1 << 16, 32 << 20
FEATURES = {b"OsmSchema-V0.6", b"DenseNodes"}


class PbfError(ValueError):
    """The file isn't one that can be read."""


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while shift < 70:
        b = data[at]
        at += 1
        out |= (b & 0x7F) << shift
        if not b & 0x80:
            return out, at
        shift += 7
    raise PbfError("a varint is too long")


def zigzag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def signed64(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def message(data: bytes) -> dict[int, list]:
    """Field number -> its values in order: integers, or bytes of the other wire types."""
    out: dict[int, list] = {}
    at = 0
    while at < len(data):
        key, at = read_varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = read_varint(data, at)
        else:
            if wire == 2:
                size, at = read_varint(data, at)
            elif wire in (1, 5):
                size = 8 if wire == 1 else 4
            else:
                raise PbfError(f"wire type {wire} is not supported")
            value = data[at : at + size]
            if len(value) < size:
                raise PbfError("a field is cut short")
            at += size
        out.setdefault(key >> 3, []).append(value)
    return out


def numbers(chunks: list, signed: bool = False, delta: bool = False) -> list[int]:
    """A packed field: all its chunks together, zigzag and running sums as asked."""
    data, out, at = b"".join(chunks), [], 0
    while at < len(data):
        v, at = read_varint(data, at)
        out.append(zigzag(v) if signed else v)
    return list(accumulate(out)) if delta else out


def inflate(blob: bytes) -> bytes:
    m = message(blob)
    if 1 in m:
        raw = m[1][0]
    elif 3 in m:
        raw = zlib.decompress(m[3][0])
    else:
        raise PbfError("only raw and zlib blobs are supported")
    if 2 in m and m[2][0] != len(raw):
        raise PbfError("a blob hasn't the size that it gives")
    return raw


def walk(f) -> Iterator[tuple[bytes, int, int]]:
    """Kind, offset and size of each blob; checks frames, the header block and its required features."""
    first = True
    while size_bytes := f.read(4):
        if len(size_bytes) < 4:
            raise PbfError("the file is cut short in a frame")
        size = struct.unpack(">I", size_bytes)[0]
        if not 0 < size < MOST_HEADER:
            raise PbfError("a block header's size is out of bounds")
        head = message(f.read(size))
        kind, blob = head[1][0], head[3][0]
        if not 0 < blob <= MOST_BLOB:
            raise PbfError("a blob's size is out of bounds")
        if first and kind != b"OSMHeader":
            raise PbfError("the file doesn't begin with a header block")
        first = False
        at = f.tell()
        if kind == b"OSMHeader":
            data = f.read(blob)
            if len(data) < blob:
                raise PbfError("a blob is cut short")
            more = set(message(inflate(data)).get(4, ())) - FEATURES
            if more:
                raise PbfError(f"required features are not supported: {sorted(more)}")
        else:
            f.seek(0, 2)
            if f.tell() < at + blob:
                raise PbfError("a blob is cut short")
        f.seek(at + blob)
        yield kind, at, blob
    if first:
        raise PbfError("the file is empty")


def decode(raw: bytes, block: int = 0, wanted: set[str] | None = None) -> Iterator[tuple]:
    """The rows of a data block."""
    m = message(raw)
    strings = [s.decode() for s in message(m[1][0]).get(1, ())]
    grain = m.get(17, [100])[0]
    lat0, lon0 = signed64(m.get(19, [0])[0]), signed64(m.get(20, [0])[0])
    degrees = lambda lon, lat: ((lon0 + grain * lon) * 1e-9, (lat0 + grain * lat) * 1e-9)
    want = lambda k: wanted is None or k in wanted

    def tag_map(p: dict) -> dict[str, str]:
        return {strings[k]: strings[v] for k, v in zip(numbers(p.get(2, [])), numbers(p.get(3, [])), strict=True)}

    for group in m.get(2, ()):
        g = message(group)
        for data in g.get(1, ()) if want("node") else ():
            p = message(data)
            yield "node", zigzag(p[1][0]), *degrees(zigzag(p[9][0]), zigzag(p[8][0])), tag_map(p), None, None, block
        for data in g.get(2, ()) if want("node") else ():
            p = message(data)
            pairs = iter(numbers(p.get(10, [])))
            for i, lat, lon in zip(*(numbers(p.get(k, []), True, True) for k in (1, 8, 9)), strict=True):
                own = {}
                for k in pairs:
                    if not k:
                        break
                    own[strings[k]] = strings[next(pairs)]
                yield "node", i, *degrees(lon, lat), own, None, None, block
        for data in g.get(3, ()) if want("way") else ():
            p = message(data)
            yield "way", p[1][0], None, None, tag_map(p), numbers(p.get(8, []), True, True), None, block
        for data in g.get(4, ()) if want("relation") else ():
            p = message(data)
            parts = zip(numbers(p.get(10, [])), numbers(p.get(9, []), True, True), numbers(p.get(8, [])), strict=True)
            yield "relation", p[1][0], None, None, tag_map(p), None, [(t, i, strings[r]) for t, i, r in parts], block


BLOOM_BITS = 4096


def bit_of(key: str) -> int:
    return zlib.crc32(key.encode()) % BLOOM_BITS


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


class Block(InputPartition):
    def __init__(self, offset: int, size: int, index: int):
        super().__init__((offset, size, index))
        self.offset, self.size, self.index = offset, size, index


class PbfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.stats = options["path"], options.get("stats")
        entity, keys = options.get("entity"), options.get("keys")
        self.wanted = set(entity.split(",")) if entity else None
        self.keys = set(keys.split(",")) if keys else None
        self.low, self.high = map(int, options["ids"].split("..")) if options.get("ids") else (-math.inf, math.inf)

    def may_hold(self, r: dict) -> bool:
        """Whether a block can hold rows asked for: r has its kinds (kind, low, high) and the bits of its tag keys."""
        if self.keys is not None and not any(bit_of(k) in r["bits"] for k in self.keys):
            return False
        return any((self.wanted is None or k["kind"] in self.wanted) and k["low"] <= self.high and k["high"] >= self.low for k in r["kinds"])

    def partitions(self) -> list[Block]:
        fs, path = opened(self.path)
        with fs.open_input_file(path) as f:
            if self.stats is None:
                return [Block(at, size, i) for i, (kind, at, size) in enumerate(walk(f)) if kind == b"OSMData"]
            whole = f.size()
        own, folder = opened(self.stats)
        rows = pyarrow.parquet.read_table(folder, filesystem=own).to_pylist()
        if any(r["file_size"] != whole for r in rows):
            raise PbfError("the statistics are those of another file")
        rows = [{**r, "bits": set(r["bits"])} for r in sorted(rows, key=lambda r: r["block"])]
        return [Block(r["offset"], r["size"], r["block"]) for r in rows if self.may_hold(r)]

    def read(self, partition: Block) -> Iterator[tuple]:
        fs, path = opened(self.path)
        with fs.open_input_file(path) as f:
            f.seek(partition.offset)
            rows = decode(inflate(f.read(partition.size)), partition.index, self.wanted)
            for r in rows:
                if (self.keys is None or self.keys & r[4].keys()) and self.low <= r[1] <= self.high:
                    yield r


def save_statistics(spark: SparkSession, path: str, folder: str) -> None:
    """Write block, offset, size, file_size, kinds (kind, low, high) and bits (of the tag keys) of each block to folder."""
    fs, p = opened(path)
    with fs.open_input_file(p) as f:
        whole = f.size()
        placed = [(i, at, size, whole) for i, (kind, at, size) in enumerate(walk(f)) if kind == b"OSMData"]
    rows = read(spark, path)
    kinds = rows.groupBy("block", "kind").agg(F.min("id").alias("low"), F.max("id").alias("high")).groupBy("block").agg(F.collect_list(F.struct("kind", "low", "high")).alias("kinds"))
    bits = rows.select("block", F.explode(F.map_keys("tags")).alias("key")).select("block", (F.crc32(F.encode("key", "UTF-8")) % BLOOM_BITS).cast("int").alias("bit")).groupBy("block").agg(F.collect_set("bit").alias("bits"))
    d = spark.createDataFrame(placed, "block bigint, offset bigint, size bigint, file_size bigint").join(kinds, "block", "left").join(bits, "block", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    d.select("block", "offset", "size", "file_size", empty("kinds", "array<struct<kind:string,low:bigint,high:bigint>>"), empty("bits", "array<int>")).write.parquet(folder)


class PbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PbfReader:
        return PbfReader(self.options)


def read(spark: SparkSession, path: str, entity: str | None = None, keys: list[str] | None = None, ids: tuple[int, int] | None = None, stats: str | None = None) -> DataFrame:
    """Rows of the file: of one kind (entity), with one of the tag keys, with ids from the first to the last of two; stats:
    the folder of save_statistics."""
    spark.dataSource.register(PbfSource)
    r = spark.read.format("osm_pbf").option("path", path)
    for name, value in (("entity", entity), ("keys", ",".join(keys) if keys else None), ("ids", "..".join(map(str, ids)) if ids else None), ("stats", stats)):
        r = r.option(name, value) if value else r
    return r.load()


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, ways, relations) with their own columns."""
    return (
        rows.where("kind = 'node'").select("id", "lon", "lat", "tags"),
        rows.where("kind = 'way'").select("id", "refs", "tags"),
        rows.where("kind = 'relation'").select("id", "tags", "members"),
    )


def nodes_come_first(rows: DataFrame) -> DataFrame:
    """One row: whether no node comes in a later block than a way."""
    ends = rows.agg(F.max(F.when(F.col("kind") == "node", F.col("block"))).alias("n"), F.min(F.when(F.col("kind") == "way", F.col("block"))).alias("w"))
    return ends.select((F.col("n").isNull() | F.col("w").isNull() | (F.col("n") <= F.col("w"))).alias("ok"))


def region_roads(nodes: DataFrame, ways: DataFrame, box: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """Nodes inside the box with zone coordinates (id, x, y, tags), and the tagged ways that touch them."""
    from wegloom.functions import geo
    from wegloom.operators.network import in_box, ways_touching

    inside = in_box(nodes, *box).withColumn("_p", geo.utm_forward(F.col("lon"), F.col("lat"))).select("id", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"), "tags")
    return inside, ways_touching(ways.where(F.map_contains_key("tags", "highway")), inside)


def members_of(objects: DataFrame, ways: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, way_refs, locations) that tagged objects (osm_type, id, tags, members) need, by semi-joins."""
    m = objects.where("members is not null").select("id", F.posexplode("members").alias("pos", "m")).select("id", F.col("m.mtype").alias("mtype"), F.col("m.mid").alias("mid"), F.col("m.role").alias("role"), "pos")
    needed = m.where("mtype = 1").select(F.col("mid").alias("id")).union(objects.where("osm_type = 'way'").select("id")).distinct()
    refs = ways.join(needed, "id", "left_semi").select(F.col("id").alias("way"), F.posexplode("refs").alias("pos", "node"))
    wanted = refs.select("node").union(m.where("mtype = 0").select("mid")).union(objects.where("osm_type = 'node'").select("id")).distinct()
    at = nodes.select(F.col("id").alias("node"), "lon", "lat").join(wanted, "node", "left_semi")
    return m, refs, at
