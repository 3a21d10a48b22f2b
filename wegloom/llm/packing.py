"""Packing tokenised documents into fixed windows: non-negative least squares over shallow length combinations.

Each document gives whole windows and a rest; only the histogram of piece lengths (as many rows as a window has
tokens) comes to the driver. There, combinations of two or three lengths that fill a window exactly are enumerated,
their repeat counts solved against the histogram by non-negative least squares and rounded down, and what is left is
packed greedily, the longest first, each window filled up with the longest piece that still fits. All of this counts
lengths; pieces then find their place by their rank within their length.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wegloom.llm import common

WINDOW, END_ID = 4096, 2
REMEMBERED = 400_000
_LATIN = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u012f\u0131-\u017f"
LETTERS = re.compile(f"[{_LATIN}]+")
PARTS = re.compile(f"[{_LATIN}]+|[^{_LATIN}\\t-\\r \\x85\\xa0]+")
#: Beyond Latin, where lower case and composition may differ; an apostrophe; the start of a special token.
UNLIKE = re.compile("[^\\x00-\u012f\u0131-\u017f]|'|<\\|")

os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core


class Coder:
    """Ids of a text as little-endian 32-bit bytes, put together from remembered ids of its parts.

    The tokenizer lower-cases, drops white space, and splits into letters, single digits and runs of other characters,
    looking at nothing beyond a part. Texts of Latin letters without apostrophes (contractions) and special tokens are
    cut there; each run of letters gives ids of which the last alone has the mark of a word's end, so that new ones are
    encoded many at a time. Other texts are cut at ASCII white space. A tokenizer for which samples show that parts do
    not stand for themselves encodes whole texts.
    """

    SAMPLES = ("Ab  c\n\tdé ñ", "x1 22,3.(a)b!", "it's 'tis l'été", "日本 語ab", "", " end ", "a-b_c ÄÖß½²", "<|endoftext|> a")

    def __init__(self, json: str):
        self.tokenizer = Tokenizer.from_str(json)
        last = [0] * (max(self.tokenizer.get_vocab().values()) + 1)
        for piece, i in self.tokenizer.get_vocab().items():
            last[i] = piece.endswith("</w>")
        self.ends = np.array(last, bool)
        self.known: dict[str, bytes] = {}
        self.apart = False
        try:
            self.apart = self.bytes_of(list(self.SAMPLES), True) == self.whole(list(self.SAMPLES))
        except ValueError:
            pass

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes() for ids in self.encode(texts)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, parts: list[str]) -> None:
        words = [w for w in parts if LETTERS.fullmatch(w)]
        for at in range(0, len(words), 500):
            some = words[at : at + 500]
            ids = np.array(self.encode([" ".join(some)])[0], "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):
                raise ValueError("a run of letters isn't one word of the tokenizer")
            data, start = ids.tobytes(), 0
            for w, end in zip(some, (4 * cuts).tolist()):
                self.known[w] = data[start:end]
                start = end
        rest = [w for w in parts if w not in self.known]
        for w, ids in zip(rest, self.encode(rest)):
            self.known[w] = np.array(ids, "<u4").tobytes()

    def bytes_of(self, texts: list[str], apart: bool | None = None) -> list[bytes]:
        if not (self.apart if apart is None else apart):
            return self.whole(texts)
        split = [PARTS.findall(t.lower()) if not UNLIKE.search(t) else ascii_split(t) for t in texts]
        known = self.known
        new = list({w for parts in split for w in parts if w not in known})
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list({w for parts in split for w in parts})
        self.learn(new)
        return [b"".join([known[w] for w in parts]) for parts in split]


def ascii_split(text: str) -> list[str]:
    for c in "\t\n\v\f\r":
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


_coders: dict[int, Coder] = {}


def coder(json: str) -> Coder:
    key = zlib.crc32(json.encode())
    if key not in _coders:
        _coders[key] = Coder(json)
    return _coders[key]


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: whole windows of each document's ids and its rest.

    A document's ids are its text's (null: empty) and end_id; so there is at least one piece a document.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        json = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        own = coder(json.value)
        for batch in common.slices(batches, most=4 << 20):
            ids = batch.column("doc_id").to_pylist()
            out: list[list] = [[], [], [], [], []]
            for doc, data in zip(ids, own.bytes_of(common.texts_of(batch))):
                data += end
                total = len(data) // 4
                for start in range(0, total, window):
                    part = data[4 * start : 4 * (start + window)]
                    for col, v in zip(out, (doc, start, len(part) // 4, zlib.crc32(part), total)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def combinations(have: np.ndarray, window: int, common_lengths: int = 346) -> np.ndarray:
    """Triples of lengths (0: none), descending, that fill a window, for lengths that occur.

    All pairs; and the triples of which the two smaller lengths are among the common_lengths commonest. This says which
    combinations have repeat counts to be solved; every piece is packed, those that no combination takes greedily.
    """
    lengths = np.flatnonzero(have)
    lengths = lengths[(lengths > 0) & (lengths < window)]
    a = lengths[lengths * 2 >= window]
    found = [np.stack([a, window - a, 0 * a], 1)]
    common_first = lengths[np.argsort(-have[lengths], kind="stable")][:common_lengths]
    b, c = np.meshgrid(common_first, common_first, indexing="ij")
    b, c = b[b >= c], c[b >= c]
    first = window - b - c
    found.append(np.stack([first, b, c], 1)[first >= b])
    every = np.concatenate(found)
    full = np.concatenate([[True], have[1:] > 0])
    return every[full[every].all(1)]


def solve(patterns: np.ndarray, have: np.ndarray, enough: float = 1e-4) -> np.ndarray:
    """Non-negative x with counts(patterns, x) near to `have` in least squares: multiplicative updates, until ten steps
    lower the residual by less than the share `enough`."""
    weight = (patterns > 0).astype(float)
    target = have.astype(float)
    target[0] = 0  # the place of no length
    pull = (target[patterns] * weight).sum(1)
    x = np.full(len(patterns), target.sum() / max(1, weight.sum()))
    counts = lambda x: np.bincount(patterns.ravel(), (x[:, None] * weight).ravel(), len(have))
    last, used = math.inf, counts(x)
    while True:
        for _ in range(10):
            x = x * pull / np.maximum((used[patterns] * weight).sum(1), 1e-12)
            used = counts(x)
        residual = float(np.square(used - target).sum())
        if residual >= last * (1 - enough):
            return x
        last = residual


def plan(have: np.ndarray, window: int = WINDOW) -> list[tuple[int, list[int]]]:
    """(repeats, lengths) so that each length is used as often as it occurs and no list sums to over a window."""
    left = have.astype(np.int64).copy()
    out: list[tuple[int, list[int]]] = []
    if left[window]:
        out.append((int(left[window]), [window]))
        left[window] = 0
    patterns = combinations(left, window)
    if len(patterns):
        x = np.floor(solve(patterns, left)).astype(np.int64)
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 1:
                break
            lengths = [int(v) for v in patterns[j] if v]
            times = min([int(x[j])] + [int(left[v]) // lengths.count(v) for v in lengths])
            if times:
                out.append((times, lengths))
                for v in lengths:
                    left[v] -= times
    some = [int(v) for v in np.flatnonzero(left)]
    while some:
        room, lengths, used = window, [], {}
        while room and some:
            k = bisect_right(some, room)
            while k and used.get(some[k - 1], 0) >= left[some[k - 1]]:
                k -= 1
            if not k:
                break
            v = some[k - 1]
            n = min(room // v, int(left[v]) - used.get(v, 0))
            lengths += [v] * n
            used[v] = used.get(v, 0) + n
            room -= n * v
        times = min(int(left[v]) // n for v, n in used.items())
        out.append((times, lengths))
        for v, n in used.items():
            left[v] -= times * n
        some = [v for v in some if left[v]]
    return out


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Every document's pieces with sequence_id and offset.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; docs needs doc_id and text, other
    columns are not read. Pieces never overlap and leave no gap inside a sequence. An empty table gives no rows; an
    empty or null text gives its end id; rows of one doc_id, or of none, are packed each. Documents over a window are cut
    at its multiples, others never.
    """
    cut = common.materialize(pieces(docs, tokenizer_path, window, end_id), "pieces")
    counted = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `window` rows
    have = np.zeros(window + 1, np.int64)
    for r in counted:
        have[r["length"]] = r["n"]
    # per length: ranks from `first` on go to sequence `base` + rank - first, at `offset`
    rows, taken, base = [], np.zeros(window + 1, np.int64), 0
    for times, lengths in plan(have, window):
        offset = 0
        for v in lengths:
            rows.append((v, int(taken[v]), base, offset))
            taken[v] += times
            offset += v
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    bounds = np.searchsorted(table[:, 0], np.arange(window + 2))

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(rank), np.int64)
            for v in np.unique(length):
                mine = length == v
                lo, hi = bounds[v], bounds[v + 1]
                at[mine] = lo + np.searchsorted(table[lo:hi, 1], rank[mine], "right") - 1
            seq = table[at, 2] + rank - table[at, 1]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(seq), pa.array(table[at, 3])], [*names, "sequence_id", "offset"])

    total = int(have.sum())
    ranked = common.two_level_rank(cut, ["length"], ["doc_id", "start", "ids_crc32", "doc_tokens"], max(64, total // 20_000), "rank")
    return ranked.mapInArrow(place, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
