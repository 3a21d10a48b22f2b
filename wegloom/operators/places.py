"""Place names: an index of roads, places and goals, and ranked search in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wegloom.functions import geo, tags, text
from wegloom.sources import files

KEY = text.place_key
ROAD_CELL_M = 2000.0


def road_places(catalog: DataFrame, key=KEY) -> DataFrame:
    """A named road once for each 2 km cell, at the middle of its first segment there."""
    d = catalog.withColumn("name", F.trim(tags.tag(F.col("tags"), "name", ""))).where("name != ''")
    d = d.withColumns({"x": (F.col("ax") + F.col("bx")) / 2, "y": (F.col("ay") + F.col("by")) / 2, "name_key": key(F.col("name"))})
    first = d.groupBy("name_key", geo.cell(F.col("x"), ROAD_CELL_M).alias("cx"), geo.cell(F.col("y"), ROAD_CELL_M).alias("cy")).agg(F.min(F.struct("segment_id", "name", "x", "y")).alias("b"))
    at = geo.utm_inverse(F.col("b.x"), F.col("b.y"))
    return first.select(F.col("b.name").alias("name"), F.lit("road").alias("kind"), at["lat"].alias("lat"), at["lon"].alias("lon"), F.lit(None).cast("string").alias("aliases"), F.lit(None).cast("string").alias("address"))


def goal_places(goals: DataFrame, nodes: DataFrame) -> DataFrame:
    d = goals.select("node", F.explode("hospitals").alias("name")).join(nodes.select(F.col("id").alias("node"), "x", "y"), "node")
    at = geo.utm_inverse(F.col("x"), F.col("y"))
    return d.select("name", F.lit("hospital road point").alias("kind"), at["lat"].alias("lat"), at["lon"].alias("lon"), F.lit(None).cast("string").alias("aliases"), F.lit(None).cast("string").alias("address"))


def index(places: DataFrame, key=KEY, extra: DataFrame | None = None) -> DataFrame:
    """places (seq, name, kind, lat, lon, aliases, address) without later ones of the same key; with key, name_key and
    alias_keys (those of the parts between semicolons).

    Roads are the same within a 2 km cell, others within 4 digits of a degree.
    """
    p = places if extra is None else places.unionByName(extra, allowMissingColumns=True)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    xy = geo.utm_forward(F.col("lon"), F.col("lat"))
    road = F.col("kind") == "road"
    where = F.when(road, F.concat_ws(":", geo.cell(xy["x"], ROAD_CELL_M).cast("string"), geo.cell(xy["y"], ROAD_CELL_M).cast("string"))).otherwise(F.concat_ws(":", F.bround("lat", 4).cast("string"), F.bround("lon", 4).cast("string")))
    d = p.withColumn("name_key", key(F.col("name"))).withColumn("_at", where)
    w = Window.partitionBy("name_key", (F.when(F.col("kind") == "road", 1).otherwise(0)), "_at").orderBy("seq")
    d = d.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_at")
    d = d.withColumn("alias_keys", F.transform(F.split(text.unmarked(blank("aliases")), ";"), text.joined_words))
    return d.withColumn("key", key(F.concat_ws(" ", F.col("name"), blank("aliases"), blank("address"))))


def search(indexed: DataFrame, query: str, most: int = 12) -> DataFrame:
    """The best `most` places, with the number of all that match; an error for a query under 2 or over 100 letters."""
    q = text.key_of(indexed.sparkSession, text.place_key, query)
    if not 2 <= len(q) <= 100:
        raise ValueError("a query has 2 to 100 letters")
    return ranked(indexed, q, most)


def ranked(indexed: DataFrame, q: str, most: int) -> DataFrame:
    words = q.split()
    alias = F.array_contains("alias_keys", q)
    found = indexed.where(text.contains_all(F.col("key"), words))
    order: list[Column] = [F.col("name_key") != q, ~alias, ~F.col("name_key").startswith(q), ~text.contains_all(F.col("name_key"), words), F.length("name"), F.col("name"), F.col("lat")]
    top = found.orderBy(*order).limit(most)
    return top.crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("total"))))  # one row


GRAM, BUCKETS, RAREST = 3, 64, 4


def write_postings(indexed: DataFrame, path: str, buckets: int = BUCKETS) -> str:
    """Publish an index (index(); seq tells rows apart) at path, with a posting (gram, seq) for each run of one to GRAM
    letters of its keys, in folders by a hash of the gram and sorted by it; returns the version's folder."""
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("key") - (n - 1), F.lit(1))), lambda i: F.substring(F.col("key"), i, F.lit(n)))
    grams = F.explode(F.array_distinct(F.concat(*[runs(n) for n in range(1, GRAM + 1)])))
    posts = indexed.where("key != ''").select(grams.alias("gram"), "seq").withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    rows = indexed.withColumn("part", F.pmod(F.xxhash64("seq"), F.lit(buckets)).cast("int"))

    def write(folder: str) -> None:
        posts.repartition(buckets, "bucket").sortWithinPartitions("bucket", "gram", "seq").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{folder}/postings")
        rows.repartition(buckets, "part").sortWithinPartitions("part", "seq").write.partitionBy("part").option("compression", "zstd").parquet(f"{folder}/places")
        indexed.sparkSession.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{folder}/about")

    return files.publish(indexed.sparkSession, path, write)


def grams_of(key: str) -> list[str]:
    """The grams that a key holds if it contains each word of this one: a word's runs of GRAM letters, or a short word."""
    return sorted({w[i : i + GRAM] for w in key.split() for i in range(max(1, len(w) - GRAM + 1))})


def candidates(spark: SparkSession, folder: str, q: str) -> DataFrame:
    """seq, part: places that have the rarest grams of the words of q; only the folders of these grams are read."""
    buckets = spark.read.parquet(f"{folder}/about").first()["buckets"]
    grams = grams_of(q)
    number = spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(g)), F.lit(buckets)).cast("int") for g in grams]).first()
    at = dict(zip(grams, number))
    posts = spark.read.parquet(f"{folder}/postings")
    among = lambda some: posts.where(F.col("bucket").isin(sorted({at[g] for g in some})) & F.col("gram").isin(some))
    sizes = {r["gram"]: r["n"] for r in among(grams).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as q has grams
    rarest = sorted(grams, key=lambda g: (sizes.get(g, 0), g))[:RAREST]
    met = among(rarest).groupBy("seq").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rarest))
    return met.select("seq", F.pmod(F.xxhash64("seq"), F.lit(buckets)).cast("int").alias("part"))


def find(spark: SparkSession, path: str, query: str, most: int = 12) -> DataFrame:
    """As search, over what write_postings has published at path."""
    q = text.key_of(spark, text.place_key, query)
    if not 2 <= len(q) <= 100:
        raise ValueError("a query has 2 to 100 letters")
    folder = files.current(spark, path)
    found = spark.read.parquet(f"{folder}/places").join(candidates(spark, folder, q), ["part", "seq"]).drop("part")
    return ranked(found, q, most)


def window_places(places: DataFrame) -> DataFrame:
    """Places inside the window of the province, each key and point (5 digits) once, with search_key."""
    d = places.where((F.col("lat") > -8.5) & (F.col("lat") < -7.0) & (F.col("lon") > 109.5) & (F.col("lon") < 111.0) & (F.trim("name") != ""))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    d = d.withColumn("_k", text.plain_key(F.trim("name")))
    w = Window.partitionBy("_k", F.bround("lat", 5), F.bround("lon", 5)).orderBy("seq")
    d = d.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_k")
    return d.withColumn("search_key", text.plain_key(F.concat_ws(" ", "name", blank("aliases"), blank("address"))))


def quick_search(windowed: DataFrame, query: str, most: int = 15) -> DataFrame:
    """The simpler ranking: prefix, length, name; nothing under 2 letters."""
    q = text.key_of(windowed.sparkSession, text.plain_key, query)
    found = windowed.where(text.contains_all(F.col("search_key"), q.split()) if len(q) >= 2 else F.lit(False))
    return found.orderBy(~F.col("search_key").startswith(q), F.length("name"), "name").limit(most)


def exact(places: DataFrame, name: str, near_lat: float | None = None) -> DataFrame:
    """The first place of exactly this name; with near_lat the one nearest to that latitude."""
    d = places.where(F.col("name") == name)
    return d.orderBy("seq" if near_lat is None else F.abs(F.col("lat") - near_lat), "seq").limit(1)
