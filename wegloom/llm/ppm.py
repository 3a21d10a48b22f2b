"""Language-model scoring by prediction by partial matching, with a word-count baseline.

All byte contexts, up to four bytes deep, are counted over all learning documents. A symbol's probability is that in
the longest context at hand, or an escape, as likely as the context's number of distinct symbols says (method C), times
the probability in the next shorter context, where all symbols of the longer one are excluded; after the empty context
all bytes left are equally likely. So a byte's code length depends on itself and the four bytes before it alone. As a
shorter context has all symbols of a longer one, what an exclusion leaves is a difference of two contexts' sums.

Documents are packed into batches once, with their distinct words and byte strings already counted; words and strings
are then summed up over hash buckets, and each batch gets back the counts of its own words and the code lengths of its
own strings. The model stays dealt over the buckets: only the counts of pairs of bytes, at most 65,536, are shared.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wegloom.llm import common
from wegloom.llm.words import LOWER, Words

FOLDS, HELD_OUT, DEPTH = 7, 2, 4
BATCH = 8 << 20

PACKED = "kind string, batch string, bucket int, ids binary, sizes binary, texts binary, keys binary, counts binary"
_TYPES = [pa.string(), pa.string(), pa.int32(), *[pa.binary()] * 5]
_NAMES = ["kind", "batch", "bucket", "ids", "sizes", "texts", "keys", "counts"]


def held_out(doc_id: int | None) -> bool:
    """Rows without doc_id are learnt from."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with DEPTH zeros before each text, and where the texts' bytes are in them."""
    gap = b"\0" * DEPTH
    data = np.frombuffer(gap.join([b"", *texts]), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(np.concatenate([[0], sizes + DEPTH]))[:-1] + DEPTH
    inside = np.ones(len(data), bool)
    for d in range(DEPTH):
        inside[start - 1 - d] = False
    return data, np.flatnonzero(inside)


def grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The strings of DEPTH context bytes and the symbol at these places, as integers."""
    keys = np.zeros(len(at), np.uint64)
    for d in range(DEPTH, -1, -1):
        keys <<= np.uint64(8)
        keys |= data[at - d]
    return keys


def gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings of DEPTH context bytes and a symbol, and their counts."""
    keys = grams(*padded(texts))
    keys.sort()
    lead = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[lead], np.diff(np.concatenate([lead, [len(keys)]])).astype(np.uint32)


def cut_by(bucket: np.ndarray, *columns: np.ndarray):
    """For each bucket that occurs, the bucket and its part of the columns."""
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    for b, part in zip(found.tolist(), np.split(order, first[1:])):
        yield (b, *[c[part] for c in columns])


def packed(docs: DataFrame, buckets: int) -> DataFrame:
    """Batches (kind 'text'), and for each batch its words ('word') and strings ('gram') by bucket, those that only held
    out documents have with a count of 0, and its learning documents' pairs of bytes ('pair')."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in common.slices(batches, most=BATCH):
            ids = batch.column("doc_id").to_pylist()
            texts = [t.encode() for t in common.texts_of(batch)]
            own = uuid.uuid4().hex  # a task's output is committed once, so a batch has one name
            rows: list[tuple] = [("text", own, None, np.array([-1 if i is None else i for i in ids], np.int64).tobytes(), np.array([len(t) if i is not None else -1 - len(t) for i, t in zip(ids, texts)], np.int64).tobytes(), press.compress(b"".join(texts)), None, None)]
            learn = np.array([not held_out(i) for i in ids], bool)
            words = Words([t.translate(LOWER) for t in texts])
            known = np.repeat(learn, np.diff(words.first))
            keys, back = np.unique(words.hashes, return_inverse=True)
            counts = np.bincount(back[known], minlength=len(keys)).astype(np.uint32)
            for b, k, c in cut_by((keys >> np.uint64(20)) % np.uint64(buckets), keys, counts):
                rows.append(("word", own, b, None, None, None, k.tobytes(), c.tobytes()))
            keys, counts = gram_counts([t for t, x in zip(texts, learn.tolist()) if x])
            own_pairs = np.bincount((keys & np.uint64(0xFFFF)).astype(np.int64), counts, 1 << 16).astype(np.int64)
            pairs = np.flatnonzero(own_pairs)
            rows.append(("pair", own, None, None, None, None, pairs.tobytes(), own_pairs[pairs].tobytes()))
            more = np.setdiff1d(gram_counts([t for t, x in zip(texts, learn.tolist()) if not x])[0], keys, assume_unique=True)
            keys, counts = np.concatenate([keys, more]), np.concatenate([counts, np.zeros(len(more), np.uint32)])
            # the two bytes before the symbol deal the buckets, so that contexts of two bytes on are whole in one
            for b, k, c in cut_by((keys >> np.uint64(8)) % np.uint64(1 << 16) * np.uint64(40503) % np.uint64(1 << 16) % np.uint64(buckets), keys, counts):
                rows.append(("gram", own, b, None, None, None, k.tobytes(), c.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, PACKED)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their sums, and each key's place among them."""
    found, back = np.unique(keys, return_inverse=True)
    return found, np.bincount(back, counts, len(found)).astype(np.int64), back


def word_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """For each batch and bucket its words with their counts over all learning documents; and per bucket, without a
    batch, the number of tokens and of distinct words learnt."""

    def run(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("keys")]
        found, total, back = summed(np.concatenate(parts), np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("counts")]))
        ends = np.cumsum([0] + [len(p) for p in parts])
        out = [(b, p.tobytes(), total[back[i:j]].tobytes(), None, None) for b, p, i, j in zip(t.column("batch").to_pylist(), parts, ends, ends[1:])]
        out.append((None, None, None, int(total.sum()), int((total > 0).sum())))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=["batch", "keys", "counts", "tokens", "distinct"])

    return rows.where("kind = 'word'").select("bucket", "batch", "keys", "counts").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, "batch string, keys binary, counts binary, tokens bigint, distinct bigint")


def pair_counts(rows: DataFrame) -> np.ndarray:
    """How often each byte follows each other one in the learning documents: 256 x 256."""

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for keys, counts in zip(batch.column("keys"), batch.column("counts")):
                total[np.frombuffer(keys.as_buffer(), np.int64)] += np.frombuffer(counts.as_buffer(), np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["key", "n"])

    one = np.zeros(1 << 16, np.int64)
    for r in rows.where("kind = 'pair'").select("keys", "counts").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).collect():
        one[r["key"]] = r["n"]
    return one.reshape(256, 256)


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of the wanted ones of some sorted keys; 0 for those that aren't among them."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def code_lengths(keys: np.ndarray, counts: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Logarithms of the probabilities of each string's symbol after its context.

    keys: distinct strings, sorted, with all learnt ones that share two bytes before the symbol with any of them; counts:
    how often each was learnt (0: never); one: pair_counts.
    """
    cut = lambda k, d: k & np.uint64((1 << (8 * (d + 1))) - 1)
    k, c = keys[counts > 0], counts[counts > 0]
    strings = {DEPTH: (k, c)}
    for depth in range(DEPTH - 1, 1, -1):
        k, c, _ = summed(cut(k, depth), c)
        strings[depth] = k, c
    for depth, n in ((1, one.ravel()), (0, one.sum(0))):
        found = np.flatnonzero(n)
        strings[depth] = found.astype(np.uint64), n[found]
    out, left = np.zeros(len(keys)), np.ones(len(keys), bool)
    gone = kinds_gone = np.zeros(len(keys), np.int64)
    for depth in range(DEPTH, -1, -1):
        k, c = strings[depth]
        own, total, back = summed(k >> np.uint64(8), c)
        kinds = np.bincount(back, minlength=len(own))
        wanted = cut(keys, depth)
        n, context = looked_up(k, c, wanted), wanted >> np.uint64(8)
        all_kinds = looked_up(own, kinds, context)
        t, d = looked_up(own, total, context) - gone, all_kinds - kinds_gone
        some = left & (d > 0)
        out[some] += np.log10(np.where(n > 0, n, d)[some] / (t + d)[some])
        left &= n == 0
        if depth:  # what the next shorter context has of this one's symbols
            above = looked_up(*strings[depth - 1], cut(k, depth - 1))
            gone, kinds_gone = looked_up(own, np.bincount(back, above, len(own)).astype(np.int64), context), all_kinds
    out[left] -= np.log10(max(1, 256 - len(strings[0][0])))
    return out


def gram_lengths(rows: DataFrame, buckets: int, one: np.ndarray) -> DataFrame:
    """For each batch and bucket its strings with their code lengths under the counts of all learning documents."""
    shared = rows.sparkSession.sparkContext.broadcast(one)

    def run(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("keys")]
        found, total, back = summed(np.concatenate(parts), np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("counts")]))
        lengths = code_lengths(found, total, shared.value).astype(np.float32)
        ends = np.cumsum([0] + [len(p) for p in parts])
        out = [(b, p.tobytes(), lengths[back[i:j]].tobytes()) for b, p, i, j in zip(t.column("batch").to_pylist(), parts, ends, ends[1:])]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.binary(), pa.binary()))], names=["batch", "keys", "lengths"])

    return rows.where("kind = 'gram'").select("bucket", "batch", "keys", "counts").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, "batch string, keys binary, lengths binary")


def scores(texts: list[bytes], keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each text's sum of its strings' code lengths."""
    data, at = padded(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    parts = np.empty(len(at), np.float32)
    known = pa.array(keys)
    for lo in range(0, len(at), 1 << 20):
        here = at[lo : lo + (1 << 20)]
        place = pc.index_in(pa.array(grams(data, here)), value_set=known)
        parts[lo : lo + len(here)] = lengths[place.to_numpy(zero_copy_only=False)]
    total = np.concatenate([[0.0], np.cumsum(parts, dtype=np.float64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document.

    Learning documents are those with crc32(doc_id as text) mod FOLDS other than HELD_OUT. Words are told apart by 64-bit
    hashes. A null or empty text is one token, its end, and has a score of 0; repeated rows count and are scored each; a
    row without doc_id is learnt from and has a null held_out; an empty table gives no rows. Other columns are not read.
    """
    buckets = common.parts_for(docs, 16 << 20)
    rows = common.materialize(packed(docs, buckets), "packed")
    words = common.materialize(word_counts(rows, buckets), "words")
    total = words.where("batch is null").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    lengths = common.materialize(gram_lengths(rows, buckets, pair_counts(rows)), "lengths")
    ends = docs.where(F.col("doc_id").isNull() | (F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT)).count()
    n, v = total["n"] + ends, total["v"] + (ends > 0)

    def run(texts: pa.Table, counted: pa.Table) -> pa.Table:
        side = lambda t, c, kind: np.concatenate([np.zeros(0, kind), *[np.frombuffer(x.as_buffer(), kind) for x in t.column(c)]])
        word, gram = counted.filter(pc.is_valid(counted.column("counts"))), counted.filter(pc.is_valid(counted.column("lengths")))
        keys, counts = side(word, "keys", np.uint64), side(word, "counts", np.int64)
        strings, lengths = side(gram, "keys", np.uint64), side(gram, "lengths", np.float32)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        out: list[list] = [[], [], [], [], [], []]
        for r in texts.to_pylist():
            ids, sizes = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["sizes"], np.int64)
            known = sizes >= 0
            sizes = np.where(known, sizes, -1 - sizes)
            data = zstandard.ZstdDecompressor().decompress(r["texts"], max_output_size=int(sizes.sum()))
            at = np.cumsum(np.concatenate([[0], sizes]))
            parts = [data[i:j] for i, j in zip(at.tolist(), at[1:].tolist())]
            words = Words([p.translate(LOWER) for p in parts])
            c = counts[np.searchsorted(keys, words.hashes)] if len(words.hashes) else np.zeros(0, np.int64)
            sums = np.concatenate([[0.0], np.cumsum(np.log10((c + 1) / (n + v + 1)))])
            seen = np.concatenate([[0], np.cumsum(c > 0)])
            first = words.first
            end = np.log10((ends + 1) / (n + v + 1))
            plain = [i if k else None for i, k in zip(ids.tolist(), known.tolist())]
            for col, x in zip(out, (plain, [None if i is None else held_out(i) for i in plain], (np.diff(first) + 1).tolist(), (np.diff(seen[first]) + (ends > 0)).tolist(), (np.diff(sums[first]) + end).tolist(), scores(parts, strings, lengths).tolist())):
                col.extend(x)
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    left = rows.where("kind = 'text'").select("batch", "ids", "sizes", "texts")
    right = words.where("batch is not null").select("batch", "keys", "counts", F.lit(None).cast("binary").alias("lengths"))
    right = right.union(lengths.select("batch", "keys", F.lit(None).cast("binary"), "lengths"))
    out = left.groupBy("batch").cogroup(right.groupBy("batch")).applyInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("bigint").alias("train_tokens"), "base_score", "score")
