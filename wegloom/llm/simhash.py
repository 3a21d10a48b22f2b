"""SimHash near duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into two segments. Of two fingerprints that differ in at most RADIUS = 3 bits one segment
differs in one bit at most, so that a table a segment, asked for every value in a ball of radius one, finds all links. A
ball is asked for from one side: only bits that are 0 are turned into 1.

A table entry (bucket) asked for by more than DIRECT fingerprints is cut again in the same way: its other segment has two
halves, of which one again differs in a bit at most. 48 bits of a bucket's key are then fixed, so it can hold no more than
2**16 different fingerprints of its own, however large the corpus. Within a bucket complete distances are verified, and
only as many links are given as connect what the bucket's links connect.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wegloom.llm import common
from wegloom.llm.words import LOWER
from wegloom.operators.components import components

SHINGLE, SEED, RADIUS, DIRECT = 3, 42, 3, 256
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def shingle_hashes(text: str, k: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of all shingles of k words, lower-cased A-Z and joined by spaces; fewer words are one shingle."""
    words = [w for w in text.encode().translate(LOWER).translate(_SPACES).split(b" ") if w]
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[: len(words) - k]]]
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :])], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; 0 without hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (64 bits, signed) of every row; a null text counts as empty."""

    def run(batches):
        for batch in common.slices(batches):
            fps = np.array([fingerprint(shingle_hashes(t, k, seed)) for t in common.texts_of(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


def ball(df: DataFrame, width: int, parts: list[tuple[int, Column]], *keep: str) -> DataFrame:
    """A row for each part (number and `width` bits of fp) and each value that it has with at most one 0 bit turned into
    1: keep, part, value, own (whether it is the part itself)."""
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i).cast("bigint") for i in range(width)])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("part"), v.alias("v")) for n, v in parts])).alias("p")
    d = df.select(*keep, each)
    d = d.select(*keep, F.col("p.part").alias("part"), F.col("p.v").alias("v"), F.explode(flips).alias("flip")).where((F.col("v").bitwiseAND(F.col("flip"))) == 0)
    return d.select(*keep, "part", (F.col("v").bitwiseOR(F.col("flip"))).alias("value"), (F.col("flip") == 0).alias("own"))


def met(asked: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose bucket has an entry of its own (fetched from the table) and more than one row, with m, the number
    of rows."""
    table = asked.where("own").select(*key).distinct()
    # a merge at every size: the plan's estimates don't know how many rows a ball has, and would broadcast them
    fetched = asked.join(table.hint("merge"), key)
    sizes = fetched.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    return fetched.join(sizes.hint("merge"), key)


def spanning(fps: np.ndarray, own: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect all that links between a bucket's own fingerprints and all of its rows connect."""
    own_fps, all_fps = np.unique(fps[own]), np.unique(fps)
    left = np.arange(len(all_fps))
    out = []
    waiting = np.ones(len(all_fps), bool)
    # a walk: what a found fingerprint reaches among those not yet reached
    is_own = np.isin(all_fps, own_fps)
    for root in left.tolist():
        if not waiting[root]:
            continue
        waiting[root] = False
        front = [root]
        while front:
            x = front.pop()
            rest = np.flatnonzero(waiting if is_own[x] else waiting & is_own)
            if not len(rest):
                continue
            near = rest[np.bitwise_count(all_fps[rest] ^ all_fps[x]) <= radius]
            if len(near):
                waiting[near] = False
                out += [(int(all_fps[x]), int(y)) for y in all_fps[near]]
                front += near.tolist()
    return out


def bucket_links(buckets: DataFrame, key: list[str], radius: int = RADIUS) -> DataFrame:
    """a, b: links within buckets. Rows of a bucket lie together; a bucket is held in memory, no more."""

    def run(batches):
        last, held = None, []

        def flush():
            links = spanning(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), radius) if held else []
            ends = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in key])
            fps, own = batch.column("fp").to_numpy().view(np.uint64), batch.column("own").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                this = tuple(keys[:, a].tolist())
                if this != last and held:
                    yield flush()
                    held = []
                last = this
                held.append((fps[a:b], own[a:b]))
        if held:
            yield flush()

    laid = buckets.select(*key, "fp", "own").repartition(*[F.col(c) for c in key]).sortWithinPartitions(*key)
    return laid.mapInArrow(run, "a bigint, b bigint").distinct()


def segment(i: int) -> Column:
    """32 bits of fp: the lower ones for 0, the upper for 1."""
    return F.shiftrightunsigned("fp", 32 * i).bitwiseAND(F.lit((1 << 32) - 1))


def links(classes: DataFrame, scratch: common.Scratch) -> DataFrame:
    """a, b: links between different fingerprints (column fp, distinct) that connect all that are within RADIUS bits."""
    first = scratch.keep(met(ball(classes, 32, [(i, segment(i)) for i in (0, 1)], "fp").withColumnsRenamed({"part": "side", "value": "bits"}), ["side", "bits"]), "buckets")
    small = first.where(F.col("m") <= DIRECT).select("side", "bits", F.lit(-1).alias("half"), F.lit(0).cast("bigint").alias("value"), "fp", "own")
    # the segment that is not the bucket's, in two halves
    other = F.when(F.col("side") == 0, segment(1)).otherwise(segment(0))
    halves = [(0, other.bitwiseAND(F.lit(0xFFFF))), (1, F.shiftrightunsigned(other, 16))]
    again = ball(first.where(F.col("m") > DIRECT).withColumnRenamed("own", "inner"), 16, halves, "fp", "side", "bits", "inner").withColumnRenamed("part", "half")
    key = ["side", "bits", "half", "value"]
    # a link's ends need not both be the bucket's own in the second cut: one of the two is, in each cut
    large = scratch.keep(again.select(*key, "fp", F.col("inner").alias("own"), F.col("own").alias("home")), "buckets")
    return bucket_links(small, key).union(hot_links(large, key))


def hot_links(large: DataFrame, key: list[str]) -> DataFrame:
    """Links within the buckets of the second cut that have an entry of their own."""
    table = large.where("home").select(*key).distinct()
    fetched = large.join(table.hint("merge"), key)
    some = fetched.groupBy(*key).agg(F.count(F.lit(1)).alias("m"), F.max("own").alias("any_own")).where("m > 1 and any_own")
    return bucket_links(fetched.join(some.select(*key).hint("merge"), key), key)


def near_duplicates(docs: DataFrame, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row; linked are fingerprints of RADIUS bits or fewer
    apart, and component_id is the smallest doc_id reachable.

    A text without words (null, empty, white space) has fingerprint zero and is linked like any other. Rows of one doc_id
    are judged each by its own text; a row without doc_id links like any other, and a component of such rows alone has a
    null component_id. An empty table gives no rows. Other columns of docs are not read.
    """
    scratch = common.Scratch(docs.sparkSession)
    printed = common.materialize(fingerprints(docs, k, seed), "simhash")
    classes = scratch.keep(printed.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    comps = components(scratch.keep(links(classes.select("fp"), scratch), "links"))
    of = classes.join(comps.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = of.groupBy("component").agg(F.min("first").alias("component_id"))
    placed = common.materialize(of.join(least, "component").select("fp", "component_id"), "placed")
    scratch.drop()
    return printed.join(placed, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
