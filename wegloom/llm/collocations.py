"""Collocations: phrases of up to MOST words that occur often and hold together, per language.

Texts are cut into pieces, and equal pieces are one with a multiplicity. n-grams are counted level by level, in two steps.
First the parts of the piece table ask by 64-bit hashes: each names each of its n-grams once with its weight, the requests
are shuffled to hash buckets, where duckdb adds them up out of core, and the frequent ones are answered to the parts that
asked. A hash may stand for two n-grams, so this only tells which can be frequent. Those are then counted as words, again
by duckdb per hash bucket, exactly. A part keeps of its pieces the stretches all of whose n-grams can be frequent, once
more as distinct stretches with multiplicities, and only there are the n-grams of the next level looked for: an n-gram is
as frequent as its parts at most. The counts of a candidate's parts are fetched by lookup requests that are shuffled to
the counts.

Requests and answers travel as arrays, one row for a part and a bucket.
"""

from __future__ import annotations

import re
import tempfile
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wegloom.llm import common
from wegloom.llm.words import LOWER, Words

LEAST, MOST, TOP = 100, 5, 2000
PIECE_END = re.compile(rb"[.,;:!?\x0a-\x0d]+")
PART_BYTES, BUCKET_BYTES = 12 << 20, 24 << 20


def pieces(docs: DataFrame, parts: int) -> DataFrame:
    """part, lang, piece (words joined by one space), weight: the distinct pieces of all texts, lower-cased A-Z.

    A null text has none; a null lang is `und`.
    """

    def run(batches):
        for batch in common.slices(batches):
            seen: dict[tuple, int] = defaultdict(int)
            for lang, text in zip(batch.column("lang").to_pylist(), common.texts_of(batch)):
                for p in PIECE_END.split(text.encode().translate(LOWER).replace(b"\t", b" ")):
                    words = [w for w in p.split(b" ") if w]
                    if words:
                        seen["und" if lang is None else lang, b" ".join(words)] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "piece", "weight"])

    cut = docs.select("lang", "text").mapInArrow(run, "lang string, piece string, weight bigint")
    dealt = cut.select(F.pmod(F.xxhash64("lang", "piece"), F.lit(parts)).cast("int").alias("part"), "lang", "piece", "weight").repartition(parts, "part")
    # rows of a part have to follow one another in the files
    return dealt.groupBy("part", "lang", "piece").agg(F.sum("weight").alias("weight")).sortWithinPartitions("part")


def by_key(batches, key: str):
    """The tables of rows with the same key that follow one another, whatever batches they come in."""
    held, last = [], None
    for batch in batches:
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


def by_lang(rows: pa.Table):
    """lang, pieces (bytes), weights of the rows of each language."""
    for lang in rows.column("lang").unique().to_pylist():
        own = rows.filter(pa.compute.equal(rows.column("lang"), lang))
        yield lang, own.column("piece").cast(pa.binary()).to_pylist(), own.column("weight").to_numpy()


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """In the order of the hashes, so that sorted ones are sorted by bucket."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def lists(values: pa.Array, bucket: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The buckets that have values, in order, and their lists; values are sorted by bucket."""
    found, first = np.unique(bucket, return_index=True)
    return found, pa.ListArray.from_arrays(pa.array(np.append(first, len(bucket)), pa.int32()), values)


def weighed(words: Words, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all runs of k words: hash, weight, and the number of their first word; and where each text's runs begin."""
    hashes, first = words.runs(k)
    count = np.diff(first)
    at = np.arange(len(hashes)) + np.repeat(words.first[:-1] - first[:-1], count)
    return hashes, np.repeat(weights, count), at, first


def requests(stretches: DataFrame, k: int, buckets: int) -> DataFrame:
    """bucket, part, lang, hashes, weights: the n-grams of k words of each part, each once."""

    def run(batches):
        for part, rows in by_key(batches, "part"):
            for lang, pieces, weights in by_lang(rows):
                hashes, each, _, _ = weighed(Words(pieces), weights, k)
                if len(hashes):
                    order = np.argsort(hashes)
                    hashes, each = hashes[order], each[order]
                    new = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
                    hashes, each = hashes[new], np.add.reduceat(each, new)
                    bucket = bucket_of(hashes, buckets)
                    found, asked = lists(pa.array(hashes.view(np.int64)), bucket)
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([part] * n, pa.int32()), pa.array([lang] * n, pa.string()), asked, lists(pa.array(each), bucket)[1]], ["bucket", "part", "lang", "hashes", "weights"])

    return stretches.select("part", "lang", "piece", "weight").mapInArrow(run, "bucket int, part int, lang string, hashes array<bigint>, weights array<bigint>")


def in_duckdb(batches, make: str, insert: str, answer: str, least: int):
    """The answer for each bucket in batches. Rows of a bucket lie together, so one bucket at a time is held."""
    import duckdb

    def fresh(con):
        con.execute(f"create or replace temp table asked ({make})")

    # scratch space of a task, as the spill of an aggregation is; gone when the task ends
    with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": spill, "preserve_insertion_order": False}) as con:
        for _, rows in by_key(batches, "bucket"):
            fresh(con)
            con.register("rows", rows)
            con.execute(insert)
            con.unregister("rows")
            yield from con.sql(answer.format(least=least)).to_arrow_reader(50_000)


def answers(asked: DataFrame, buckets: int, least: int) -> DataFrame:
    """part, lang, hashes: of those that a part asked for, the ones that occur `least` times or more."""

    def run(batches):
        yield from in_duckdb(
            batches, "part int, lang varchar, h bigint, w bigint", "insert into asked select part, lang, unnest(hashes), unnest(weights) from rows",
            "select part, lang, list(h) as hashes from asked join (select lang, h from asked group by lang, h having sum(w) >= {least}) using (lang, h) group by part, lang", least,
        )

    return asked.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "part int, lang string, hashes array<bigint>")


KEPT = "part int, lang string, piece string, weight bigint, bucket int, grams array<string>, weights array<bigint>"


def surviving(stretches: DataFrame, found: DataFrame, k: int, last: bool, parts: int, buckets: int) -> DataFrame:
    """KEPT: with a piece, the distinct stretches of more than k words all of whose n-grams can be frequent (not for the
    last level); with a bucket, the n-grams of k words that can be frequent, as words, each once a part."""

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        known: dict[str, np.ndarray] = {}
        for lang in right.column("lang").unique().to_pylist():
            own = right.filter(pa.compute.equal(right.column("lang"), lang)).column("hashes").combine_chunks()
            known[lang] = np.sort(own.flatten().to_numpy().view(np.uint64))
        part = left.column("part")[0].as_py() if left.num_rows else None
        out = []
        for lang, pieces, weights in by_lang(left):
            frequent = known.get(lang)
            if frequent is None:
                continue
            words = Words(pieces)
            hashes, each, at, first = weighed(words, weights, k)
            good = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
            data, start, end = words.data, words.start, words.end
            counts: dict[bytes, int] = defaultdict(int)
            for a, b, w in zip(start[at[good]].tolist(), end[at[good] + k - 1].tolist(), each[good].tolist()):
                counts[data[a:b]] += w
            if counts:
                grams, total = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
                bucket = np.array([zlib.crc32(g) % buckets for g in grams])
                order = np.argsort(bucket, kind="stable")
                texts = pa.array([grams[i] for i in order.tolist()], pa.binary()).cast(pa.string())
                numbers, listed = lists(texts, bucket[order])
                n, none = len(numbers), pa.nulls
                out.append(pa.table([pa.array([part] * n, pa.int32()), pa.array([lang] * n, pa.string()), none(n, pa.string()), none(n, pa.int64()), pa.array(numbers, pa.int32()), listed, lists(pa.array(total[order]), bucket[order])[1]], names=_NAMES))
            if last or len(good) < 2:
                continue
            # n-grams that follow one another in a piece are a stretch
            own = np.repeat(np.arange(len(pieces)), np.diff(first))
            joined = np.append(False, good[1:] & good[:-1] & (own[1:] == own[:-1]))
            edge = np.diff(np.append(joined, False).astype(np.int8), prepend=0)
            begin, stop = np.flatnonzero(edge == 1) - 1, np.flatnonzero(edge == -1) - 1
            longer: dict[bytes, int] = defaultdict(int)
            for a, b, w in zip(start[at[begin]].tolist(), end[at[stop] + k - 1].tolist(), each[begin].tolist()):
                longer[data[a:b]] += w
            n, none = len(longer), pa.nulls
            out.append(pa.table([pa.array([part] * n, pa.int32()), pa.array([lang] * n, pa.string()), pa.array(list(longer), pa.binary()).cast(pa.string()), pa.array(list(longer.values()), pa.int64()), none(n, pa.int32()), none(n, pa.list_(pa.string())), none(n, pa.list_(pa.int64()))], names=_NAMES))
        return pa.concat_tables([t.cast(_KEPT) for t in out]) if out else _KEPT.empty_table()

    left, right = stretches.repartition(parts, "part"), found.repartition(parts, "part")
    return left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(cut, KEPT)


_KEPT = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("piece", pa.string()), ("weight", pa.int64()), ("bucket", pa.int32()), ("grams", pa.list_(pa.string())), ("weights", pa.list_(pa.int64()))])
_NAMES = _KEPT.names


def exact(listed: DataFrame, k: int, buckets: int, least: int) -> DataFrame:
    """lang, gram, k, f of the n-grams that occur `least` times or more, added up by their words."""

    def run(batches):
        yield from in_duckdb(
            batches, "lang varchar, gram varchar, w bigint", "insert into asked select lang, unnest(grams), unnest(weights) from rows",
            "select lang, gram, sum(w)::bigint as f from asked group by lang, gram having sum(w) >= {least}", least,
        )

    dealt = listed.select("bucket", "lang", "grams", "weights").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "lang string, gram string, f bigint").select("lang", "gram", F.lit(k).alias("k"), "f")


def counted(docs: DataFrame, least: int, most: int, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """lang, n (word occurrences); and lang, gram, k, f of all n-grams of up to `most` words with f >= least."""
    # by bytes alone: a part sends a row to each bucket, as long as it has that many n-grams
    size = common.text_bytes(docs)
    parts, buckets = max(1, -(-size // PART_BYTES)), max(1, -(-size // BUCKET_BYTES))
    stretches = scratch.keep(pieces(docs, parts), "pieces")
    words = F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1
    totals = scratch.keep(stretches.groupBy("lang").agg(F.sum(words.cast("bigint") * F.col("weight")).alias("n")), "totals")
    levels = []
    for k in range(1, most + 1):
        found = scratch.keep(answers(requests(stretches, k, buckets), buckets, least), "answers")
        kept = scratch.keep(surviving(stretches, found, k, k == most, parts, buckets), "stretches")
        levels.append(scratch.keep(exact(kept.where("bucket is not null"), k, buckets, least), "counts"))
        stretches = kept.where("piece is not null").select("part", "lang", "piece", "weight")
    every = levels[0]
    for level in levels[1:]:
        every = every.union(level)
    return totals, every


def scored(totals: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n, score of all candidates: the cut with the lowest score, ties to the smallest k."""
    words = F.split("gram", " ", -1)
    asked = counts.where("k > 1").select("lang", F.col("gram").alias("phrase"), "k", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    asked = asked.select("lang", "phrase", "k", "a", "cut", F.concat_ws(" ", F.slice("w", 1, F.col("cut"))).alias("left"), F.concat_ws(" ", F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut"))).alias("right"))
    side = lambda gram, f: counts.select("lang", F.col("gram").alias(gram), F.col("f").alias(f))
    cuts = asked.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    # 38 digits hold 1000 * a * n for up to 10**35 / a words; integer division is exact
    cuts = cuts.withColumn("up", (wide("a") * wide("n")).cast("decimal(38,0)") * F.lit(1000).cast("decimal(4,0)")).withColumn("down", (wide("l") * wide("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("up div down"))
    best = F.min(F.struct("score", "cut", "l", "r"))
    return cuts.groupBy("lang", "phrase", "k", "a", "n").agg(best.alias("b")).select("lang", "phrase", "k", "a", "b.l", "b.r", "n", "b.score")


def standing(candidates: DataFrame) -> DataFrame:
    """Without those inside a longer candidate that is as frequent.

    A longer one as frequent lies around one of a word more that is; so only those are asked.
    """
    words = F.split("phrase", " ", -1)
    inner = candidates.where("k > 2").select("lang", "a", F.explode(F.array(F.concat_ws(" ", F.slice(words, 1, F.col("k") - 1)), F.concat_ws(" ", F.slice(words, 2, F.col("k") - 1)))).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    return candidates.join(around, ["lang", "phrase"], "left").where("outer is null or outer < a").drop("outer")


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to `most` words that occur
    `least` times or more.

    Null texts count as empty, null languages as `und`; repeated rows count again. Ties in score go to the more frequent
    phrase, then to the smaller one in byte order. An empty table gives no rows. Columns but lang and text are not read.
    """
    scratch = common.Scratch(docs.sparkSession)
    totals, counts = counted(docs, least, most, scratch)
    kept = standing(scored(totals, counts))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each hash bucket, then the first of those: no language is sorted as a whole in one task
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    first = salted.withColumn("i", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("i") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    out = common.materialize(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    scratch.drop()
    return out
