"""Periodic runs of words: every lag of a document is compared, vectorised, and stretches of equal words are measured.

A document of n words is an array of word ids. For each lag q up to n / min_exp the array is compared with itself q words
on; a stretch of s equal words there is a run of s + q words with period q. A run that a smaller lag has shown already,
with the same ends, has that smaller period (two periods of a run of twice their length have a common divisor that is
one, too), so the first lag to show it gives its smallest period.

The work of a document is cut into ranges of lags of about WORK comparisons, RANGES at most. Documents of one range are
scanned where they are read, many at once: laid one behind the other, longest first and with ids of their own, they are
compared in one piece. The ranges of longer ones are dealt over all machines and brought together by document.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wegloom.llm import common

MIN_EXP, MIN_LENGTH = 4, 6
WORK, RANGES = 1 << 24, 64
SLICE = 1 << 20
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_ONES = {np.uint64: 15, np.uint32: 7, np.uint16: 3}  # a stretch of so many bytes has an aligned item inside it
RESULT = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, n_words bigint"


def words_of(text: str | None) -> list[bytes]:
    """[^\\x20\\x09-\\x0D]+ of the UTF-8 bytes."""
    return [w for w in (text or "").encode().translate(_SPACES).split(b" ") if w]


def stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True of at least `least`."""
    for kind, reach in _ONES.items():  # most lags have none: look at aligned items first
        if least >= reach:
            size = np.dtype(kind).itemsize
            whole = same[: len(same) // size * size].view(kind)
            if not (whole == kind(int.from_bytes(b"\1" * size, "little"))).any():
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            break
    edge = np.concatenate([[-1], np.flatnonzero(~same), [len(same)]])
    long = np.flatnonzero(np.diff(edge) > least)
    return edge[long] + 1, edge[long + 1]


def scan(ids: np.ndarray, ends: np.ndarray, lo: int, hi: int, min_exp: int, min_length: int) -> list[tuple[int, int, int]]:
    """start, end, lag of all stretches at lags lo to hi of documents laid one behind the other, longest first.

    ends: where each document ends. Documents share no ids, so no stretch crosses them; each is compared up to its own
    last lag. start and end are those of the run, in `ids`.
    """
    last = np.diff(ends, prepend=0) // min_exp
    out = []
    for q in range(lo, hi + 1):
        n = int(ends[np.searchsorted(-last, -q, "right") - 1]) if last[0] >= q else 0
        if n <= q:
            break
        start, end = stretches(ids[q:n] == ids[: n - q], max(min_length, min_exp * q) - q)
        out += [(s, e + q, q) for s, e in zip(start.tolist(), end.tolist())]
    return out


def smallest(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """start, length, period by start, then period: of runs with the same ends the smallest lag is the period."""
    best: dict[tuple[int, int], int] = {}
    for s, e, q in found:
        best[s, e] = min(q, best.get((s, e), q))
    return sorted((s, e - s, q) for (s, e), q in best.items())


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    gone = np.zeros(len(words), bool)
    for s, n, q in runs:
        gone[s + q : s + n] = True
    return [w for w, g in zip(words, gone.tolist()) if not g]


def digest(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """A row of RESULT."""
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return doc_id, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest(), len(words)


_COLUMNS = [x.split() for x in RESULT.split(", ")]


def _table(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], pa.string() if kind == "string" else pa.int64()) for i, (_, kind) in enumerate(_COLUMNS)]


def first_scan(docs: DataFrame, min_exp: int, min_length: int) -> DataFrame:
    """Rows of RESULT for documents of one range; for others a row a range: digest, lo, hi, ids, and the text with the
    first."""
    more = [("digest", pa.binary()), ("lo", pa.int64()), ("hi", pa.int64()), ("ids", pa.binary()), ("text", pa.string())]

    def run(batches):
        for batch in common.slices(batches, most=SLICE):
            done, ranges = [], []
            # ids of a document are its own: they go on from the last document's
            here = []
            base = 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), common.texts_of(batch)):
                words = words_of(text)
                seen: dict[bytes, int] = {}
                ids = np.array([seen.setdefault(w, base + len(seen)) for w in words], np.uint32)
                n, work = len(words), len(words) ** 2 // min_exp
                if work <= WORK:
                    base += len(seen)
                    here.append((doc_id, words, ids))
                    continue
                lags, key = n // min_exp, hashlib.sha256(text.encode()).digest()
                cuts = np.linspace(0, lags, min(RANGES, -(-work // WORK)) + 1).astype(int).tolist()
                ranges += [(doc_id, key, a + 1, b, (ids - np.uint32(base)).tobytes(), text if not a else None) for a, b in zip(cuts, cuts[1:])]
            here.sort(key=lambda x: -len(x[1]))
            if here:
                ends = np.cumsum([len(x[1]) for x in here])
                found: list[list] = [[] for _ in here]
                for s, e, q in scan(np.concatenate([x[2] for x in here]), ends, 1, len(here[0][1]) // min_exp, min_exp, min_length):
                    i = int(np.searchsorted(ends, s, "right"))
                    first = int(ends[i]) - len(here[i][1])
                    found[i].append((s - first, e - first, q))
                done = [digest(doc_id, words, smallest(f)) for (doc_id, words, _), f in zip(here, found)]
            empty = (None,) * (len(_COLUMNS) - 1)
            columns = _table(done + [(r[0], *empty) for r in ranges])
            columns += [pa.array([None] * len(done) + [r[i + 1] for r in ranges], kind) for i, (_, kind) in enumerate(more)]
            yield pa.RecordBatch.from_arrays(columns, [c for c, _ in _COLUMNS] + [c for c, _ in more])

    return docs.select("doc_id", "text").mapInArrow(run, RESULT + ", digest binary, lo bigint, hi bigint, ids binary, text string")


def scan_ranges(ranges: DataFrame, min_exp: int, min_length: int) -> DataFrame:
    """doc_id, digest, found (int64 triples of start, end, lag), text, copies of each range."""

    def run(batches):
        for batch in batches:
            found = []
            for lo, hi, ids in zip(batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), batch.column("ids")):
                a = np.frombuffer(ids.as_buffer(), np.uint32)
                found.append(np.array(scan(a, np.array([len(a)]), lo, hi, min_exp, min_length), np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(found, pa.binary()), batch.column("text"), batch.column("copies")], ["doc_id", "digest", "found", "text", "copies"])

    return ranges.mapInArrow(run, "doc_id bigint, digest binary, found binary, text string, copies bigint")


def gather(scanned: DataFrame) -> DataFrame:
    """RESULT of the documents whose ranges were scanned apart, a row a copy."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text, copies, parts in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "copies", "parts")]):
                found = [tuple(t) for p in parts for t in np.frombuffer(p, np.int64).reshape(-1, 3).tolist()]
                rows += [digest(doc_id, words_of(text), smallest(found))] * copies
            yield pa.RecordBatch.from_arrays(_table(rows), [c for c, _ in _COLUMNS])

    whole = scanned.groupBy("doc_id", "digest").agg(F.max("text").alias("text"), F.max("copies").alias("copies"), F.collect_list("found").alias("parts"))
    return whole.select("doc_id", "text", "copies", "parts").mapInArrow(run, RESULT)


def runs(docs: DataFrame, min_exp: int = MIN_EXP, min_length: int = MIN_LENGTH) -> DataFrame:
    """RESULT for every row of docs: its runs of at least max(min_length, min_exp periods), the longest of them (ties:
    smallest start, then period; without runs four nulls), digests of all runs and of the words left without
    repetitions, and the number of words.

    A null text counts as empty and has no runs. Rows are judged each by its own text: repeated rows give repeated rows,
    a null doc_id stays null. An empty table gives no rows. Other columns of docs are not read.
    """
    first = common.materialize(first_scan(docs, min_exp, min_length), "periodic")
    names = [c for c, _ in _COLUMNS]
    # copies of a row are one before anything is shuffled
    ranges = first.where("lo is not null").groupBy("doc_id", "digest", "lo").agg(F.max("hi").alias("hi"), F.max("ids").alias("ids"), F.max("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    return first.where("lo is null").select(*names).union(gather(scan_ranges(ranges, min_exp, min_length)).select(*names))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text, where of the rows with h = crc32(doc_id as text), h % 10 = 0, the words from a on repeat the first
    p of them: a = g % n, p = 1 + (n - a) // (3 + g % 8), g = h // 10. Such texts have single spaces.

    Null texts, texts without words and rows without doc_id stay as they are.
    """

    def planted(doc_id: int, text: str) -> str:
        g, words = zlib.crc32(str(doc_id).encode()) // 10, words_of(text)
        n = len(words)
        if not n:
            return text
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        tail = words[a : a + p] * (-(-(n - a) // p))
        return b" ".join(words[:a] + tail[: n - a]).decode()

    def run(batches):
        for batch in common.slices(batches):
            ids = batch.column("doc_id").to_pylist()
            chosen = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i in ids]
            texts = [planted(i, t) if c and t else t for i, t, c in zip(ids, batch.column("text").to_pylist(), chosen)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, text string")
