"""Substring deduplication with a log-structured index of window hashes.

The index is a set of immutable runs: for each bucket the sorted hashes of windows of earlier documents, stored as byte
planes of their differences, and the first document of each (its witness). A new batch of documents is hashed, dealt into
the buckets, and merge-joined there with the runs and with itself in order of doc_id; what is new becomes a run, and runs
of one level are compacted into one of the next.

Hits are verified on words: consecutive windows of a document that hit one witness are a span, of which the digest of its
words is held against the words of the witness; where a span isn't there as one piece, each of its windows is held
against the witness. Windows that fail are not removed.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wegloom.llm import common
from wegloom.llm.words import Words, mix

WINDOW, BATCHES, FANOUT = 13, 4, 2
SLICE = 2 << 20


def planes(hashes: np.ndarray) -> bytes:
    """Sorted 64-bit hashes as their differences, byte by byte: the high planes are nearly all zero."""
    return np.ascontiguousarray(np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def hashed(words: Words, k: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes, of fewer bits for tests of the verification, and where each text's windows begin."""
    h, first = words.runs(k)
    return (h & np.uint64((1 << bits) - 1) if bits < 64 else h), first


def spans(starts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Ascending window starts as rows (from, to, witness) of consecutive ones with the same witness."""
    if not len(starts):
        return np.zeros((0, 3), np.int64)
    cut = np.flatnonzero((np.diff(starts) != 1) | (of[1:] != of[:-1]))
    lead = np.concatenate([[0], cut + 1])
    return np.stack([starts[lead], starts[np.concatenate([cut, [len(starts) - 1]])] + 1, of[lead]], 1)


POSTS = "bucket int, docs binary, counts binary, hashes binary, doc_id bigint, spans binary"


def windows(docs: DataFrame, buckets: int, k: int, bits: int = 64) -> DataFrame:
    """Per slice of documents: for each bucket the windows' hashes, each at its smallest doc_id of the slice.

    Rows with spans have what a slice knows by itself: windows that a smaller doc_id of the slice has too; they are dealt
    by doc_id and only pass through the merge.
    """

    def run(batches):
        for batch in common.slices(batches, most=SLICE):
            ids = np.array(batch.column("doc_id").to_pylist(), np.int64)
            order = np.argsort(ids, kind="stable")
            texts = common.texts_of(batch)
            h, first = hashed(Words([texts[i].encode() for i in order]), k, bits)
            ids = ids[order]
            doc = np.repeat(np.arange(len(ids)), np.diff(first))
            _, at, back = np.unique(h, return_index=True, return_inverse=True)
            witness = ids[doc[at]][back]
            local = ids[doc] != witness
            out: list[list] = [[], [], [], [], [], []]
            if local.any():
                where = np.flatnonzero(local)
                for i, part in zip(*split_by(doc[where], where)):
                    for col, v in zip(out, (int(group_of(ids[i : i + 1], buckets)[0]), None, None, None, int(ids[i]), spans(part - first[i], witness[part]).tobytes())):
                        col.append(v)
            at.sort()  # back to the order of documents
            bucket = (mix(h[at]) % np.uint64(buckets)).astype(np.int64)
            for b, part in zip(*split_by(bucket, at)):
                docs_of, counts = np.unique(doc[part], return_counts=True)
                for col, v in zip(out, (int(b), ids[docs_of].tobytes(), counts.astype(np.uint32).tobytes(), h[part].tobytes(), None, None)):
                    col.append(v)
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["bucket", "docs", "counts", "hashes", "doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, POSTS)


def split_by(keys: np.ndarray, values: np.ndarray) -> tuple[list, list[np.ndarray]]:
    """Distinct keys, ascending, and the values of each, in order."""
    order = np.argsort(keys, kind="stable")
    found, first = np.unique(keys[order], return_index=True)
    return found.tolist(), np.split(values[order], first[1:])


FOUND = "kind string, bucket int, docs binary, witnesses binary, counts binary, data binary, doc_id bigint"
_FOUND = (pa.string(), pa.int32(), *[pa.binary()] * 4, pa.int64())
_NAMES = ["kind", "bucket", "docs", "witnesses", "counts", "data", "doc_id"]


def group_of(docs: np.ndarray, groups: int) -> np.ndarray:
    return ((docs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)


def transposed(values: np.ndarray) -> bytes:
    """64-bit values byte by byte, so that high bytes stand together."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def back_again(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def merge(posts: pa.Table, runs: pa.Table, store: bool, groups: int) -> pa.Table:
    """One bucket: hits of the batch in the runs or under a smaller doc_id of the batch, and the run of what is new.

    Hits go out in one row for each group of documents (in the place of the bucket): for each document and witness the
    number of hashes, and the hashes. Spans go out as they come.
    """
    known = posts.filter(pc.is_valid(posts.column("spans")))
    rows: list[tuple] = [("span", None, None, None, None, x, i) for i, x in zip(known.column("doc_id").to_pylist(), known.column("spans").to_pylist())]
    posts = posts.filter(pc.is_null(posts.column("spans")))
    if posts.num_rows:
        read = lambda c, t: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in posts.column(c)])
        h = read("hashes", np.uint64)
        d = np.repeat(read("docs", np.int64), read("counts", np.uint32))
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        lead = np.concatenate([[True], h[1:] != h[:-1]])
        distinct, witness = h[lead], d[lead].copy()
        old = np.zeros(len(distinct), bool)
        for data, docs in zip(runs.column("data"), runs.column("witnesses")):
            run = unplanes(data.as_buffer())
            at = np.minimum(np.searchsorted(run, distinct), len(run) - 1)
            found = run[at] == distinct
            witness[found] = back_again(docs.as_buffer())[at[found]]
            old |= found
        of = witness[np.cumsum(lead) - 1]
        hit = d != of
        h, d, of = h[hit], d[hit], of[hit]
        for g, at in zip(*split_by(group_of(d, groups), np.arange(len(d)))):
            at = at[np.lexsort((of[at], d[at]))]
            edge = np.flatnonzero(np.concatenate([[True], (d[at][1:] != d[at][:-1]) | (of[at][1:] != of[at][:-1])]))
            counts = np.diff(np.concatenate([edge, [len(at)]])).astype(np.uint32)
            rows.append(("hit", g, d[at][edge].tobytes(), of[at][edge].tobytes(), counts.tobytes(), h[at].tobytes(), None))
        if store and not old.all():
            rows.append(("run", posts.column("bucket")[0].as_py(), None, transposed(witness[~old]), None, planes(distinct[~old]), None))
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 7, _FOUND)], names=_NAMES)


HITS = "doc_id bigint, data binary, witnesses binary, counts binary"


def per_document(t: pa.Table) -> pa.Table:
    """A group's hits as one row a document: its hashes, witness by witness, and how many each has."""
    read = lambda c, k: np.concatenate([np.frombuffer(x.as_buffer(), k) for x in t.column(c)])
    docs, of, counts, data = read("docs", np.int64), read("witnesses", np.int64), read("counts", np.uint32), read("data", np.uint64)
    found, pairs = split_by(docs, np.arange(len(docs)))
    _, hashes = split_by(np.repeat(docs, counts), data)
    return pa.table([pa.array(found, pa.int64()), *[pa.array([x.tobytes() for x in c], pa.binary()) for c in (hashes, [of[p] for p in pairs], [counts[p] for p in pairs])]], names=["doc_id", "data", "witnesses", "counts"])


@dataclass
class FingerprintIndex:
    """Runs as tables in the shared folder; `runs` lists (level, path), the oldest first."""

    spark: SparkSession
    buckets: int
    window: int = WINDOW
    bits: int = 64
    fanout: int = FANOUT
    runs: list[tuple[int, str]] = field(default_factory=list)

    def history(self) -> DataFrame:
        if not self.runs:
            return self.spark.createDataFrame([], "bucket int, data binary, witnesses binary")
        return self.spark.read.schema(FOUND).parquet(*[p for _, p in self.runs]).where("kind = 'run'").select("bucket", "data", "witnesses")

    def add(self, docs: DataFrame, store: bool = True) -> DataFrame:
        """Hits of a batch whose doc_ids are above all earlier ones: HITS, or spans. Stores its run."""
        grouped = windows(docs, self.buckets, self.window, self.bits).repartition(self.buckets, "bucket").groupBy("bucket")
        past = self.history().repartition(self.buckets, "bucket").groupBy("bucket")
        path, groups = common.new_path(self.spark, "run"), self.buckets
        found = common.materialize(grouped.cogroup(past).applyInArrow(lambda a, b: merge(a, b, store, groups), FOUND), "run", path)
        own = found.where("kind = 'hit'").select("bucket", "docs", "witnesses", "counts", "data").repartition(groups, "bucket").groupBy("bucket").applyInArrow(per_document, HITS)
        none = [F.lit(None).cast("binary").alias(c) for c in ("data", "witnesses", "counts")]
        local = found.where("kind = 'span'").select("doc_id", *none, F.col("data").alias("spans"))
        hits = common.materialize(own.withColumn("spans", F.lit(None).cast("binary")).unionByName(local), "hits")
        if store:
            self.runs.append((0, path))
            self.compact()
        else:
            common.drop_path(self.spark, path)
        return hits

    def compact(self) -> None:
        """Merge the last `fanout` runs of one level into one of the next, as often as there are so many."""
        while len(self.runs) >= self.fanout and len({level for level, _ in self.runs[-self.fanout :]}) == 1:
            last = self.runs[-self.fanout :]
            both = self.spark.read.schema(FOUND).parquet(*[p for _, p in last]).where("kind = 'run'").select("bucket", "data", "witnesses")

            def join(t: pa.Table) -> pa.Table:
                every = np.concatenate([unplanes(x.as_buffer()) for x in t.column("data")])
                of = np.concatenate([back_again(x.as_buffer()) for x in t.column("witnesses")])
                order = np.argsort(every, kind="stable")
                return pa.table([pa.array(c, k) for c, k in zip((["run"], t.column("bucket").slice(0, 1).to_pylist(), [None], [transposed(of[order])], [None], [planes(every[order])], [None]), _FOUND)], names=_NAMES)

            path = common.new_path(self.spark, "run")
            common.materialize(both.repartition(self.buckets, "bucket").groupBy("bucket").applyInArrow(join, FOUND), "run", path)
            for _, p in last:
                common.drop_path(self.spark, p)
            self.runs[-self.fanout :] = [(last[0][0] + 1, path)]


def marked(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES, bits: int = 64) -> DataFrame:
    """doc_id, hits (array of data, witnesses, counts and spans) of the documents with a window that hits a smaller
    doc_id's."""
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    # under a million windows a bucket and batch
    index = FingerprintIndex(spark, common.parts_for(docs, 8 << 20), window, bits)
    hits = None
    for i in range(len(edges) - 1):
        mine = docs.where("doc_id is not null")
        mine = mine.where(F.col("doc_id") > edges[i]) if edges[i] is not None else mine
        mine = mine.where(F.col("doc_id") <= edges[i + 1]) if edges[i + 1] is not None else mine
        found = index.add(mine, store=i < len(edges) - 2)
        hits = found if hits is None else hits.unionByName(found)
    for _, p in index.runs:
        common.drop_path(spark, p)
    return hits.groupBy("doc_id").agg(F.collect_list(F.struct("data", "witnesses", "counts", "spans")).alias("hits"))


def hit_windows(h: np.ndarray, hits: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Which of a text's windows are hits, and their witnesses."""
    hit, of = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    for x in hits:
        if x["data"] is not None:
            data = np.frombuffer(x["data"], np.uint64)
            witness = np.repeat(np.frombuffer(x["witnesses"], np.int64), np.frombuffer(x["counts"], np.uint32))
            order = np.argsort(data, kind="stable")
            at = order[np.minimum(np.searchsorted(data[order], h), len(data) - 1)]
            mine = data[at] == h
            of[mine], hit = witness[at[mine]], hit | mine
        else:
            for a, b, w in np.frombuffer(x["spans"], np.int64).reshape(-1, 3).tolist():
                of[a:b], hit[a:b] = w, True
    return hit, of


def covered(n: int, hit: np.ndarray, k: int) -> np.ndarray:
    """Which of n words are in a window that is hit."""
    marks = np.zeros(n + 1, np.int64)
    for a, b, _ in spans(np.flatnonzero(hit), np.zeros(int(hit.sum()), np.int64)).tolist():
        marks[a] += 1
        marks[b + k - 1] -= 1
    return np.cumsum(marks)[:-1] > 0


def text_words(words: Words, i: int) -> list[bytes]:
    a, b = words.first[i], words.first[i + 1]
    data = words.data
    return [data[s:e] for s, e in zip(words.start[a:b].tolist(), words.end[a:b].tolist())]


def digest_of(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


ASK = "struct<witness:bigint,hash:bigint,n:int,digest:binary>"
ASK_TYPE = T.StructType([T.StructField("witness", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("digest", T.BinaryType())])
_ASK = pa.struct([("witness", pa.int64()), ("hash", pa.int64()), ("n", pa.int32()), ("digest", pa.binary())])


def asked(own: list[bytes], h: np.ndarray, hit: np.ndarray, of: np.ndarray, k: int, singly: bool = False) -> list[dict]:
    """What is to be verified: spans of hits, or each hit by itself, with the first window's hash and the words' digest."""
    at = np.flatnonzero(hit)
    rows = np.stack([at, at + 1, of[at]], 1) if singly else spans(at, of[at])
    return [{"witness": w, "hash": int(h[a : a + 1].view(np.int64)[0]), "n": b - a + k - 1, "digest": digest_of(own[a : b + k - 1])} for a, b, w in rows.tolist()]


def judged(docs: DataFrame, hits: DataFrame, keep: list[str], window: int, digest: bool, bits: int, singly: bool = False) -> DataFrame:
    """row (struct of the columns to keep), doc_id, n_words, n_removed, kept (digest or text), asks.

    With singly, hits has a column `bad` of single windows (asks) that don't count, and asks are single windows.
    """
    left = docs.select(F.struct(*keep).alias("row"), "doc_id", "text")
    joined = left.join(hits.hint("shuffle_hash"), "doc_id", "inner" if singly else "left")
    out = T.StructType([left.schema["row"], *common.schema(doc_id="long", n_words="long", n_removed="long", kept="string").fields, T.StructField("asks", T.ArrayType(ASK_TYPE))])

    def run(batches):
        for batch in common.slices(batches, most=SLICE):
            texts = common.texts_of(batch)
            words = Words([t.encode() for t in texts])
            h, first = hashed(words, window, bits)
            wrong = batch.column("bad").to_pylist() if singly else [None] * len(texts)
            null = batch.column("text").is_null().to_pylist()
            count, gone, kept, asks = [], [], [], []
            for i, (text, found, bad) in enumerate(zip(texts, batch.column("hits").to_pylist(), wrong)):
                own, stay, ask = text_words(words, i), None, []
                if found:
                    mine = h[first[i] : first[i + 1]]
                    hit, of = hit_windows(mine, found)
                    ask = asked(own, mine, hit, of, window, singly)
                    if bad:
                        no = {(x["witness"], x["hash"], x["digest"]) for x in bad}
                        hit[[a for a, x in zip(np.flatnonzero(hit).tolist(), ask) if (x["witness"], x["hash"], x["digest"]) in no]] = False
                    drop = covered(len(own), hit, window)
                    stay = [w for w, d in zip(own, drop.tolist()) if not d] if drop.any() else None
                left = own if stay is None else stay
                count.append(len(own))
                gone.append(len(own) - len(left))
                kept.append(hashlib.sha256(b" ".join(left)).hexdigest() if digest else (None if null[i] else text) if stay is None else b" ".join(left).decode())
                asks.append(ask)
            columns = [batch.column("row"), batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(asks, pa.list_(_ASK))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_words", "n_removed", "kept", "asks"])

    return joined.mapInArrow(run, out)


AT_ONCE = 1000
_KEYS = ["witness", "hash", "n", "digest"]


def failing(docs: DataFrame, asks: DataFrame, window: int, bits: int) -> DataFrame:
    """Distinct asks (witness, hash, n, digest) whose words aren't in their witness (in none of its rows).

    A witness is read once for about AT_ONCE asks, so that one that a third of all documents repeat stays bounded.
    """
    one = asks.select(*_KEYS).distinct()
    many = one.groupBy("witness").agg(F.ceil(F.count(F.lit(1)) / AT_ONCE).alias("parts"))
    part = F.pmod(F.xxhash64("hash", "n", "digest"), F.col("parts"))
    grouped = one.join(many, "witness").groupBy(F.col("witness").alias("doc_id"), part.alias("part")).agg(F.collect_list(F.struct(*_KEYS)).alias("asks"))

    def run(batches):
        for batch in common.slices(batches, most=SLICE):
            words = Words([t.encode() for t in common.texts_of(batch)])
            h, first = hashed(words, window, bits)
            out = []
            for i, wanted in enumerate(batch.column("asks").to_pylist()):
                own, mine = text_words(words, i), h[first[i] : first[i + 1]].view(np.int64)
                order = np.argsort(mine, kind="stable")
                found = mine[order]
                for x in wanted:
                    lo, hi = np.searchsorted(found, x["hash"]), np.searchsorted(found, x["hash"], "right")
                    if any(digest_of(own[p : p + x["n"]]) == x["digest"] for p in order[lo:hi].tolist()):
                        out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array([x[f.name] for x in out], f.type) for f in _ASK], _KEYS)

    texts = docs.select("doc_id", "text").join(grouped.hint("shuffle_hash"), "doc_id")
    return one.join(texts.mapInArrow(run, "witness bigint, hash bigint, n int, digest binary"), _KEYS, "left_anti")


def verified(docs: DataFrame, keep: list[str], window: int, batches: int, digest: bool, bits: int = 64) -> DataFrame:
    """row (struct of the columns to keep), n_words, n_removed, kept, with every hit held against its witness's words."""
    tables = common.Scratch(docs.sparkSession)
    hits = tables.keep(marked(docs.select("doc_id", "text"), window, batches, bits), "hits")
    first = common.materialize(judged(docs, hits, keep, window, digest, bits), "judged")
    spread = lambda t: t.select("doc_id", F.explode("asks").alias("a")).select("doc_id", "a.*")
    wrong = tables.keep(failing(docs, spread(first), window, bits), "failing")
    if wrong.limit(1).count():
        # such a span isn't in its witness as one piece: window by window, for its documents alone
        some = tables.keep(spread(first).join(wrong, _KEYS, "left_semi").select("doc_id").distinct(), "some")
        theirs = hits.join(some, "doc_id", "left_semi")
        single = tables.keep(judged(docs, theirs.withColumn("bad", F.lit(None).cast(f"array<{ASK}>")), keep, window, digest, bits, True), "single")
        bad = tables.keep(failing(docs, spread(single), window, bits), "failing")
        if bad.limit(1).count():
            per = common.materialize(spread(single).join(bad, _KEYS, "left_semi").groupBy("doc_id").agg(F.collect_set(F.struct(*_KEYS)).alias("bad")), "bad")  # read by the result
            second = common.materialize(judged(docs, theirs.join(per, "doc_id"), keep, window, digest, bits, True), "judged")
            first = first.join(per, "doc_id", "left_anti").unionByName(second)
    tables.drop()
    return first.select("row", "n_words", "n_removed", "kept")


def deduplicate(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES, bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document.

    A word is removed if a window of `window` words that covers it also starts in a document with a smaller doc_id.
    Null texts have no words and the digest of nothing, as have empty ones; texts shorter than a window keep all; rows
    with the same doc_id are one document's and don't remove each other's words; rows without doc_id keep all words.
    An empty table gives no rows. Other columns are not read. With fewer bits of hashes (for tests), a window that meets
    another one of the same hash first is kept; nothing is removed that no earlier document has.
    """
    out = verified(docs, ["doc_id"], window, batches, True, bits)
    return out.select("row.doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def remove(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """docs with repeated windows removed from their texts (kept words joined by a space) and n_chars, if there, made
    to fit; unchanged texts (null ones as well) stay as they are, and documents that lose all their words go. Columns may
    have any names; rows without doc_id or with a repeated one are treated as by deduplicate."""
    out = verified(docs, [c for c in docs.columns if c != "text"], window, batches, False).where("n_removed = 0 or n_removed < n_words")
    kinds = dict(docs.dtypes)
    made = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") == 0, F.col("row")["n_chars"]).otherwise(F.length("kept").cast(kinds["n_chars"])) if "n_chars" in kinds else None}
    return out.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
