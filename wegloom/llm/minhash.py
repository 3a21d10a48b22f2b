"""Near duplicates by an inverted join on signature coordinates.

Texts with equal shingle sets are one class, told by the set's digest and numbered (rep). A class is posted under POSTED
of its signature's pairs of coordinate and value (the prefix). Within a posting list of up to SHORT classes every pair
collides once; collisions are counted per pair. Skip merging: the coordinates that were not posted, or are in longer
lists, are looked up in the signatures, and only for pairs whose count, with all of them equal, would reach matches().
Pairs that do have matches() equal coordinates are verified on their full sets: first each class with its smallest
partner, then all pairs that this leaves unconnected; sizes that can't be alike enough are never paired.

The members of a longer list (a hot shingle, a large group of near copies) are posted again under three coordinates in a
row; where that list is long too, no pairs of it are made: each member is paired with two pivots of the list, the member
in the most long lists, which is near to all others of a group of near copies, and one drawn by a hash. What long lists
join but no link has connected yet is held against all of its crowd, block against block, on the full sets.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wegloom.llm import common
from wegloom.llm.words import LOWER, Words
from wegloom.operators.components import components

SHINGLE, COORDINATES, POSTED = 5, 32, 24
#: A pair at the similarity asked for has fewer than matches() equal coordinates with a probability of at most this.
MISSED = 5e-8
SHORT, BLOCK = 24, 512
LIKE, WHOLE = 85, 100

_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 1 << 63, COORDINATES, np.uint64)
_MUL = _rng.integers(0, 1 << 63, COORDINATES, np.uint64) | np.uint64(1)


def shingle_sets(texts: list[str], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles: a text of fewer words is one shingle, one without words none."""
    words = Words([t.encode().translate(LOWER) for t in texts])
    runs, first = words.runs(k)
    out = []
    for i in range(len(texts)):
        if first[i + 1] > first[i]:
            out.append(np.unique(runs[first[i] : first[i + 1]]))
        elif words.first[i + 1] > words.first[i]:
            out.append(np.array([words.whole(i)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest_of(own: np.ndarray) -> str | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest() if len(own) else None


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The smallest 64-bit value of each set under each coordinate's hash; zeros for an empty set.

    With fewer bits, unrelated sets of a large corpus would share values by chance.
    """
    out = np.zeros((len(sets), COORDINATES), np.uint64)
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        every = np.concatenate([sets[i] for i in some])
        starts = np.cumsum([0] + [len(sets[i]) for i in some])[:-1]
        for c in range(COORDINATES):
            out[some, c] = np.minimum.reduceat((every ^ _XOR[c]) * _MUL[c], starts)
    return out


def signed(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, row (hash of the text), n_shingles, digest of the set (null: empty), signature (array of coordinates)."""

    def run(batches):
        for batch in common.slices(batches, most=4 << 20):
            sets = shingle_sets(common.texts_of(batch), k)
            digests = [digest_of(s) for s in sets]
            sig = signatures(sets).view(np.int64)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * COORDINATES, pa.int32()), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.string()), rows], ["doc_id", "row", "n_shingles", "digest", "signature"])

    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(run, "doc_id bigint, row bigint, n_shingles bigint, digest string, signature array<bigint>")


def matches(like: int = LIKE) -> int:
    """How many equal coordinates a pair has that is alike enough: 14 at 85 %."""
    p, total, n = like / WHOLE, 0.0, 0
    while (total := total + math.comb(COORDINATES, n) * p**n * (1 - p) ** (COORDINATES - n)) <= MISSED:
        n += 1
    return n


def fits(a, b, like: int = LIKE):
    """Whether two sets of these sizes can be alike enough."""
    return F.least(a, b) * WHOLE >= F.greatest(a, b) * like


def central(salt: int) -> Column:
    """Struct rep, n: the row in the most long lists (w); of equal ones one drawn by a hash."""
    top = F.max(F.struct("w", F.xxhash64("rep", F.lit(salt)).alias("h"), "rep", "n"))
    return F.struct(top["rep"].alias("rep"), top["n"].alias("n"))


def listed(posts: DataFrame) -> DataFrame:
    """key, m, pivots: of posting lists with two members or more; counted before they are shuffled.

    A pivot is a member in the most long lists (w): a group's texts have the coordinates of what they have in common,
    so the one with the most of them is nearest to all others. The second is drawn by a hash.
    """
    pick = F.max(F.struct(F.xxhash64("rep").alias("h"), "rep", "n"))
    drawn = F.struct(pick["rep"].alias("rep"), pick["n"].alias("n"))
    return posts.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.array_distinct(F.array(central(0), drawn)).alias("pivots")).where("m > 1")


def postings(reps: DataFrame) -> DataFrame:
    """rep, n, key: each class under POSTED of its pairs of coordinate and value."""
    return reps.select("rep", "n", F.posexplode(F.slice("signature", 1, POSTED)).alias("c", "v")).select("rep", "n", F.xxhash64("c", "v").alias("key"))


def collisions(posts: DataFrame, like: int = LIKE) -> DataFrame:
    """a, b, shared: pairs that meet in lists known to be short, and in how many of them."""
    left, right = posts.select("key", F.col("rep").alias("a"), F.col("n").alias("na")), posts.select("key", F.col("rep").alias("b"), F.col("n").alias("nb"))
    met = left.join(right, "key").where((F.col("a") < F.col("b")) & fits(F.col("na"), F.col("nb"), like))
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def reaching(counted: DataFrame, long: DataFrame, like: int = LIKE) -> DataFrame:
    """Counted pairs that could have matches() equal coordinates if all of them that no short list shows were equal.

    long: rep, w: how many of a class's posted coordinates are in long lists.
    """
    side = lambda c: long.select(F.col("rep").alias(c), F.col("w").alias(f"w{c}"))
    d = counted.join(side("a"), "a", "left").join(side("b"), "b", "left")
    hidden = F.least(F.coalesce("wa", F.lit(0)), F.coalesce("wb", F.lit(0))) + COORDINATES - POSTED
    return d.where(F.col("shared") + hidden >= matches(like)).select("a", "b")


def pivot_pairs(posts: DataFrame, like: int = LIKE) -> DataFrame:
    """Each member of a long list with the list's pivots."""
    d = posts.select("rep", "n", F.explode("pivots").alias("p")).where((F.col("rep") != F.col("p.rep")) & fits(F.col("n"), F.col("p.n"), like))
    return d.select(F.least("rep", F.col("p.rep")).alias("a"), F.greatest("rep", F.col("p.rep")).alias("b"))


def alike(pairs: DataFrame, reps: DataFrame, like: int = LIKE) -> DataFrame:
    """Distinct pairs with at least matches() equal coordinates."""
    sig = reps.select("rep", "signature")
    d = pairs.distinct().join(sig.select(F.col("rep").alias("a"), F.col("signature").alias("sa")), "a").join(sig.select(F.col("rep").alias("b"), F.col("signature").alias("sb")), "b")
    same = sum((F.col("sa")[c] == F.col("sb")[c]).cast("int") for c in range(COORDINATES))
    return d.where(same >= matches(like)).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, like: int = LIKE) -> DataFrame:
    """Pairs whose full sets have an intersection of at least like / WHOLE of their union."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(WHOLE * shared >= like * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("rep").alias("a"), F.col("set").alias("sa")), sets.select(F.col("rep").alias("b"), F.col("set").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """rep, set (sorted 64-bit hashes) of the wanted classes (rep, first: a document of theirs, digest).

    A document's rows with other texts are told by the digest. The rows of a document lie together after the join, so of
    repeated rows the first gives the set.
    """

    def run(batches):
        seen: set[int] = set()
        for batch in common.slices(batches, most=4 << 20):
            reps = batch.column("rep").to_pylist()
            texts = [t if r not in seen else "" for r, t in zip(reps, common.texts_of(batch))]
            out: dict[int, bytes] = {}
            for rep, own, digest in zip(reps, shingle_sets(texts, k), batch.column("digest").to_pylist()):
                if rep not in seen and digest_of(own) == digest:
                    seen.add(rep)
                    out[rep] = own.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], ["rep", "set"])

    # the same join at every size of `wanted`
    texts = docs.select("doc_id", "text").join(wanted.select(F.col("first").alias("doc_id"), "rep", "digest").hint("shuffle_hash"), "doc_id")
    return texts.select("rep", "digest", "text").mapInArrow(run, "rep bigint, set binary")


def block_links(left: pa.Table, right: pa.Table, like: int = LIKE) -> pa.Table:
    """Links between texts of two blocks that are of different components, counted through an index of the right one.

    Enough links to connect all that the blocks' texts connect come out, no others.
    """
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out: list[tuple[int, int]] = []
    if left.num_rows and right.num_rows:
        reps, comps = right.column("rep").to_pylist(), right.column("component").to_pylist()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in right.column("set")]
        size = np.array([len(x) for x in sets])
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        for rep, comp, data in zip(left.column("rep").to_pylist(), left.column("component").to_pylist(), left.column("set")):
            own = np.frombuffer(data.as_buffer(), np.uint64)
            lo, hi = np.searchsorted(every, own), np.searchsorted(every, own, "right")
            n = hi - lo
            at = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
            shared = np.bincount(owner[at], minlength=len(sets))
            for j in np.flatnonzero(WHOLE * shared >= like * (len(own) + size - shared)).tolist():
                x, y = find(comp), find(comps[j])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((min(rep, reps[j]), max(rep, reps[j])))
    return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])


def crowd_links(crowded: DataFrame, comps: DataFrame, sets: DataFrame, tables: common.Scratch, like: int = LIKE) -> DataFrame:
    """Links that long lists still hide: a, b.

    Texts that long lists join are a crowd. Those outside its largest component are held against all of it, block
    against block, so that no pair is written out.
    """
    step = tables.keep
    joined = components(crowded.select(F.col("rep").alias("a"), F.col("pivots")[0]["rep"].alias("b")))
    placed = step(joined.select(F.col("node").alias("rep"), F.col("component").alias("crowd")).join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").select("rep", "crowd", F.coalesce("component", "rep").alias("component")), "placed")
    parts = placed.groupBy("crowd", "component").agg(F.count(F.lit(1)).alias("c"))
    sizes = parts.groupBy("crowd").agg(F.sum("c").alias("size"), F.max(F.struct("c", "component")).alias("top")).where(F.col("top.c") < F.col("size"))
    sizes = sizes.select("crowd", F.col("top.component").alias("main"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("size") - F.col("top.c")) / BLOCK).cast("int").alias("stray_blocks"))
    rows = step(placed.join(sizes, "crowd").join(sets, "rep"), "crowds")
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    strays = rows.where("component != main").select("rep", "component", "set", "crowd", own("stray_blocks").alias("i"), every("blocks").alias("j"))
    members = rows.select("rep", "component", "set", "crowd", every("stray_blocks").alias("i"), own("blocks").alias("j"))
    return strays.groupBy("crowd", "i", "j").cogroup(members.groupBy("crowd", "i", "j")).applyInArrow(lambda left, right: block_links(left, right, like), "a bigint, b bigint")


def unconnected(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    side = lambda c: comps.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    d = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return d.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def link_classes(docs: DataFrame, reps: DataFrame, k: int = SHINGLE, like: int = LIKE) -> DataFrame:
    """node, component over the classes that are linked with another one. reps: rep, n, signature, first, digest."""
    named = reps.select("rep", "first", "digest")
    tables = common.Scratch(docs.sparkSession)
    step = tables.keep
    posts = postings(reps)
    sizes = posts.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    known = step(posts.join(sizes, "key").select("rep", "n", "key", "m"), "posts")
    long = step(known.where(F.col("m") > SHORT).groupBy("rep").agg(F.count(F.lit(1)).alias("w")), "long")
    three = lambda c: [F.element_at("signature", (c + i) % COORDINATES + 1) for i in range(3)]
    again = reps.join(long, "rep").select("rep", "n", "w", F.explode(F.array(*[F.xxhash64(F.lit(c), *three(F.lit(c))) for c in range(COORDINATES)])).alias("key"))
    deep = step(again.join(listed(again), "key").select("rep", "n", "w", "key", "m", F.when(F.col("m") > SHORT, F.col("pivots")).alias("pivots")), "posts")
    crowded = deep.where(F.col("m") > SHORT)
    raw = reaching(collisions(known.where(F.col("m") <= SHORT), like), long, like).union(collisions(deep.where(F.col("m") <= SHORT), like).select("a", "b")).union(pivot_pairs(crowded, like))
    pairs = step(alike(raw, reps, like), "pairs")
    ends = pairs.select(F.col("a").alias("rep")).union(pairs.select("b"))
    sets = step(full_sets(docs, named.join(ends.union(crowded.select("rep")).distinct(), "rep", "left_semi"), k), "sets")
    links = step(verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets, like), "links")
    comps = components(links)
    more = step(verified(unconnected(pairs, comps), sets, like), "links")
    if more.limit(1).count():
        links = links.union(more)
        comps = components(links)
    more = step(crowd_links(crowded, comps, sets, tables, like), "links")
    if more.limit(1).count():
        comps = components(links.union(more))
    tables.drop()
    return comps


def judged(docs: DataFrame, k: int = SHINGLE, like: int = LIKE) -> DataFrame:
    """doc_id, row, n_shingles, component_id, kept for every row."""
    all_signed = common.materialize(signed(docs, k), "signed")
    some = all_signed.where("digest is not null and doc_id is not null")
    grouped = some.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    classes = common.materialize(grouped.withColumn("rep", F.monotonically_increasing_id()), "classes")
    comps = link_classes(docs, classes.select("rep", "n", "signature", "first", "digest"), k, like)
    linked = classes.select("rep", "first").join(comps.select(F.col("node").alias("rep"), "component"), "rep")
    least = linked.join(linked.groupBy("component").agg(F.min("first").alias("least")), "component")
    # only classes with copies or links change their documents' component
    of_class = classes.select("digest", "rep", "copies", "first").join(least.select("rep", "least"), "rep", "left").where("copies > 1 or least is not null")
    own = of_class.select("digest", F.coalesce("least", "first").alias("component"))
    out = all_signed.select("doc_id", "row", "n_shingles", "digest").join(own, "digest", "left").select("doc_id", "row", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, like: int = LIKE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document; linked are those alike by `like` per cent or more.

    A document without words (null, empty, white space) has no shingles, is linked with nothing and kept. Ties go to
    the smallest doc_id. Rows with the same doc_id are judged each by its own text; a row without doc_id is linked with
    nothing, has a null component_id and is kept. An empty table gives no rows. Other columns of docs are not read.
    """
    return judged(docs, k, like).drop("row")


def keep_first(docs: DataFrame, k: int = SHINGLE, like: int = LIKE) -> DataFrame:
    """docs, with all their columns, without the rows that aren't of the first document of their group; a row is told by
    doc_id and text, so another text under the same doc_id stays, and so do rows without doc_id."""
    later = judged(docs, k, like).where("not kept").select(F.col("doc_id").alias("_later"), F.col("row").alias("_row")).distinct()
    return docs.join(later, (docs["doc_id"] == F.col("_later")) & (F.xxhash64(docs["text"]) == F.col("_row")), "left_anti")
