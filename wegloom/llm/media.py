"""AVI files of motion JPEG as media columns: written, parsed by their RIFF index, decoded and cut into shots.

Frames are grey, 8 bits a sample, coded by the lossless JPEG process (SOF3) with a predictor and Huffman codes, so that
samples come back exactly. Coding and decoding run over many frames side by side: a step handles one sample of each.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wegloom.llm import common

SIDE, FPS = 24, 25
SAMPLES = SIDE * SIDE
BLOCK = 4096  # frames coded or decoded at once
#: Code lengths of the difference categories 0 to 8 as written; the reader takes any table.
COUNTS = bytes([0, 0, 7, 1, 1] + [0] * 11)
SYMBOLS = bytes([1, 2, 3, 4, 5, 6, 7, 8, 0])
HISTOGRAM, HISTORY, FLOOR, SPREAD = 16, 8, 0.08, 3.0


def huffman(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a table of the JPEG standard."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def head(width: int = SIDE, height: int = SIDE, predictor: int = 1) -> bytes:
    """Markers of a frame up to its scan."""
    table = b"\0" + COUNTS + SYMBOLS
    return b"".join([
        b"\xff\xd8\xff\xc4", struct.pack(">H", len(table) + 2), table,
        b"\xff\xc3", struct.pack(">HBHHB3B", 11, 8, height, width, 1, 1, 0x11, 0),
        b"\xff\xda", struct.pack(">HB2B3B", 8, 1, 1, 0, predictor, 0, 0),
    ])


_d = np.arange(-255, 256)
_category = np.array([int(abs(x)).bit_length() for x in _d])
_own = {s: (c, n) for s, c, n in huffman(COUNTS, SYMBOLS)}
_LENGTH = np.array([_own[k][1] + k for k in _category], np.int32)
_VALUE = np.array([(_own[k][0] << int(k)) | int(x if x >= 0 else x + (1 << int(k)) - 1) for x, k in zip(_d, _category)], np.uint64)


def predicted(frames: np.ndarray) -> np.ndarray:
    """Left neighbours; above for the first of a line, half the range for the first of a frame."""
    out = np.empty(frames.shape, np.int32)
    out[:, 1:] = frames[:, :-1]
    out[:, SIDE::SIDE] = frames[:, : -SIDE : SIDE]
    out[:, 0] = 128
    return out


def encode_scans(frames: np.ndarray) -> list[bytes]:
    """The coded scans of frames (n, SAMPLES) of bytes."""
    out: list[bytes] = []
    for lo in range(0, len(frames), BLOCK):
        part = frames[lo : lo + BLOCK]
        diff = part.astype(np.int32) - predicted(part) + 255
        length = np.empty((len(part), SAMPLES + 1), np.int64)
        length[:, :-1] = _LENGTH[diff]
        bits = length[:, :-1].sum(1)
        length[:, -1] = -bits % 8  # filled up with ones
        value = np.empty(length.shape, np.uint64)
        value[:, :-1] = _VALUE[diff]
        value[:, -1] = (1 << length[:, -1]) - 1
        length, value = length.ravel(), value.ravel()
        at = np.cumsum(length) - length
        word = at >> 5
        value <<= (64 - (at & 31) - length).astype(np.uint64) & np.uint64(63)
        lead = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        sums = np.add.reduceat(value, lead)
        words = np.zeros(int(word[-1]) + 2, np.uint32)
        words[word[lead]] = (sums >> np.uint64(32)).astype(np.uint32)
        words[word[lead] + 1] |= (sums & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        size = (bits + 7) // 8
        data = words.byteswap().view(np.uint8)[: int(size.sum())]
        full = data == 255  # a zero byte follows each
        place = np.arange(len(data)) + np.cumsum(full) - full
        stuffed = np.zeros(len(data) + int(full.sum()), np.uint8)
        stuffed[place] = data
        ends = np.cumsum(size)
        ends = ends + np.concatenate([[0], np.cumsum(full)])[ends]
        raw, start = stuffed.tobytes(), 0
        for end in ends.tolist():
            out.append(raw[start:end])
            start = end
    return out


@dataclass(frozen=True)
class Scan:
    """What a frame's markers say, and where its scan begins."""

    width: int
    height: int
    predictor: int
    counts: bytes
    symbols: bytes
    start: int


def read_head(frame: bytes) -> Scan:
    if frame[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    at, shape, tables = 2, None, {}
    while True:
        if frame[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xC3:
            precision, height, width, parts = struct.unpack_from(">BHHB", body)
            if precision != 8 or parts != 1:
                raise ValueError("only grey frames of 8 bits are supported")
            shape = (width, height)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only the lossless process with Huffman codes is supported")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD and struct.unpack_from(">H", body)[0]:
            raise ValueError("restart intervals are not supported")
        elif marker == 0xDA:
            counts, symbols = tables[body[2] >> 4]
            return Scan(*shape, body[3], counts, symbols, at + 2 + size)
        at += 2 + size


_tables: dict[tuple[bytes, bytes], tuple[np.ndarray, np.ndarray]] = {}


def lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For the next 24 bits' upper 16: bits to go on by (0: no code), and the difference that they code."""
    if (counts, symbols) not in _tables:
        step, diff = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        for s, code, n in huffman(counts, symbols):
            if n + s > 16:
                raise ValueError("codes of over 16 bits with their difference are not supported")
            for extra in range(1 << s):
                lo = ((code << s) | extra) << (16 - n - s)
                step[lo : lo + (1 << (16 - n - s))] = n + s
                diff[lo : lo + (1 << (16 - n - s))] = extra if s == 0 or extra >> (s - 1) else extra - (1 << s) + 1
        _tables[counts, symbols] = step, diff
    return _tables[counts, symbols]


def decode_scans(scans: list[bytes], kind: Scan) -> np.ndarray:
    """Samples (n, width * height) of scans under the same markers."""
    step, diff = lookup(kind.counts, kind.symbols)
    w, n = kind.width, kind.width * kind.height
    out = np.empty((len(scans), n), np.uint8)
    for lo in range(0, len(scans), BLOCK):
        part = scans[lo : lo + BLOCK]
        data = np.frombuffer(b"".join(part), np.uint8)
        ends = np.cumsum([len(s) for s in part])
        stuffed = np.zeros(len(data), bool)
        stuffed[1:] = (data[:-1] == 255) & (data[1:] == 0)
        gone = np.concatenate([[0], np.cumsum(stuffed)])
        ends = ends - gone[ends]
        plain = np.concatenate([data[~stuffed], np.zeros(8, np.uint8)])
        four = np.lib.stride_tricks.as_strided(plain[:4].view("<u4"), (len(plain) - 3,), (1,))
        at = np.concatenate([[0], ends[:-1]]).astype(np.int64) * 8
        rows = np.empty((n, len(part)), np.int32)
        for i in range(n):
            bits = four[np.minimum(at >> 3, len(four) - 1)].byteswap()
            code = (bits >> (16 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
            at += step[code]
            if i == 0:
                guess = 128
            elif i < w or (kind.predictor == 1 and i % w):
                guess = rows[i - 1]
            elif i % w == 0 or kind.predictor == 2:
                guess = rows[i - w]
            else:
                a, b, c = rows[i - 1], rows[i - w], rows[i - w - 1]
                guess = {3: c, 4: a + b - c, 5: a + ((b - c) >> 1), 6: b + ((a - c) >> 1), 7: (a + b) >> 1}[kind.predictor]
            rows[i] = (guess + diff[code]) & 0xFFFF
        if (at > ends * 8).any() or (-(-at // 8) != ends).any():
            raise ValueError("a scan doesn't end where its samples do")
        out[lo : lo + BLOCK] = rows.T
    return out


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(frames: list[bytes], width: int = SIDE, height: int = SIDE, fps: int = FPS) -> bytes:
    """A RIFF file of the frames with its index."""
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", bitmap)))
    parts, index, at = [], [], 4
    for f in frames:
        c = chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        parts.append(c)
        at += len(c)
    return chunk(b"RIFF", b"AVI " + header + chunk(b"LIST", b"movi" + b"".join(parts)) + chunk(b"idx1", b"".join(index)))


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and size of the chunks' bodies."""
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        if at + 8 + size > end:
            raise ValueError("a chunk goes beyond its list")
        yield name, at + 8, size
        at += 8 + size + (size & 1)


def parse_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Frames a second, and the frames that the index names."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    fps, movi, index = 0.0, None, None
    for name, at, size in chunks(data, 12, 8 + struct.unpack_from("<I", data, 4)[0]):
        if name == b"LIST" and data[at : at + 4] == b"hdrl":
            for inner, a, _ in chunks(data, at + 4, at + size):
                if inner == b"LIST":
                    for last, s, _ in chunks(data, a + 4, a + struct.unpack_from("<I", data, a - 4)[0]):
                        if last == b"strh":
                            scale, rate = struct.unpack_from("<II", data, s + 20)
                            fps = rate / scale
        elif name == b"LIST" and data[at : at + 4] == b"movi":
            movi = at
        elif name == b"idx1":
            index = (at, size)
    if movi is None or index is None:
        raise ValueError("the file has no index")
    frames = []
    for name, _, offset, size in struct.iter_unpack("<4sIII", data[index[0] : index[0] + index[1]]):
        at = movi + offset
        if data[at : at + 4] != name or struct.unpack_from("<I", data, at + 4)[0] != size:
            raise ValueError("the index doesn't fit the frames")
        if name[2:] == b"dc":
            frames.append(data[at + 8 : at + 8 + size])
    return fps, frames


class Decoder:
    """Frames to samples; markers met before are not parsed again."""

    def __init__(self):
        self.last: tuple[bytes, Scan] | None = None

    def scan(self, frame: bytes) -> tuple[Scan, bytes]:
        if self.last is None or not frame.startswith(self.last[0]):
            kind = read_head(frame)
            self.last = (frame[: kind.start], kind)
        if frame[-2:] != b"\xff\xd9":
            raise ValueError("a frame has no end")
        return self.last[1], frame[self.last[1].start : -2]

    def samples(self, frames: list[bytes]) -> np.ndarray:
        """(n, width * height); all frames must have the same markers."""
        both = [self.scan(f) for f in frames]
        if len({k for k, _ in both}) > 1:
            raise ValueError("frames of different kinds in one file are not supported")
        return decode_scans([s for _, s in both], both[0][0])


def histograms(frames: np.ndarray) -> np.ndarray:
    n = len(frames)
    at = (frames >> 4).astype(np.int32) + (np.arange(n, dtype=np.int32) * HISTOGRAM)[:, None]
    return np.bincount(at.ravel(), minlength=n * HISTOGRAM).reshape(n, HISTOGRAM)


def shots(hist: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) frames of the shots. A shot ends where the histograms' difference is above FLOOR and above the mean
    and SPREAD deviations of the last HISTORY differences."""
    n = len(hist)
    if n < 2:
        return [(0, n - 1)] if n else []
    d = np.abs(np.diff(hist, axis=0)).sum(1) / (2 * hist[0].sum())
    sums, squares = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    i = np.arange(len(d))
    lo = np.maximum(0, i - HISTORY)
    m = np.maximum(1, i - lo)
    mean = (sums[i] - sums[lo]) / m
    spread = np.sqrt(np.maximum(0, (squares[i] - squares[lo]) / m - mean * mean))
    cut = np.flatnonzero((d > FLOOR) & (d > mean + SPREAD * spread) & (i > 0)) + 1
    edges = [0, *cut.tolist(), n]
    return [(a, b - 1) for a, b in zip(edges, edges[1:])]


def payload(text: str) -> tuple[int, bytes]:
    """The text's bytes, filled up with 255 to whole frames, one at least."""
    data = text.encode()
    return len(data), data + b"\xff" * (-len(data) % SAMPLES or (0 if data else SAMPLES))


def encode_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text (null: empty) as an AVI file."""
    first, last = head(), b"\xff\xd9"

    def run(batches):
        for batch in common.slices(batches, most=2 << 20):
            both = [payload(t) for t in common.texts_of(batch)]
            scans = encode_scans(np.frombuffer(b"".join(p for _, p in both), np.uint8).reshape(-1, SAMPLES))
            at, files = 0, []
            for _, p in both:
                n = len(p) // SAMPLES
                files.append(avi([first + s + last for s in scans[at : at + n]]))
                at += n
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in both], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def decoded(batch: pa.RecordBatch, decoder: Decoder) -> Iterator[tuple[float, bytes, np.ndarray]]:
    """Frames a second, file and samples of each row; files with the same markers are decoded together."""
    files = batch.column("media").to_pylist()
    parsed = [parse_avi(f) for f in files]
    every = decoder.samples([f for _, frames in parsed for f in frames]) if any(fr for _, fr in parsed) else np.zeros((0, SAMPLES), np.uint8)
    at = 0
    for f, (fps, frames) in zip(files, parsed):
        yield fps, f, every[at : at + len(frames)]
        at += len(frames)


def clips(media: DataFrame) -> DataFrame:
    """doc_id, clip, first_frame, last_frame, start_s, end_s: a row for each shot of the files in `media`."""

    def run(batches):
        decoder = Decoder()
        for batch in common.slices(batches, "media", 2 << 20):
            rows = [(i, k, a, b, a / fps, (b + 1) / fps) for i, (fps, _, frames) in zip(batch.column("doc_id").to_pylist(), decoded(batch, decoder)) for k, (a, b) in enumerate(shots(histograms(frames)))]
            kinds = [pa.int64()] * 4 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["doc_id", "clip", "first_frame", "last_frame", "start_s", "end_s"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id bigint, clip bigint, first_frame bigint, last_frame bigint, start_s double, end_s double")


def digests(docs: DataFrame) -> DataFrame:
    """Store each text as media, read it back, and return doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature (frames, size, rate, and the shots' last seconds).

    Equal texts have equal values; a null text is an empty one, of one frame; an empty table gives no rows; other
    columns are not read.
    """

    def run(batches):
        decoder = Decoder()
        for batch in common.slices(batches, "media", 2 << 20):
            out: list[list] = [[] for _ in range(6)]
            for fps, file, frames in decoded(batch, decoder):
                back = frames.tobytes()
                ends = ",".join(f"{(b + 1) / fps:g}" for _, b in shots(histograms(frames)))
                values = (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(file), hashlib.sha256(file).hexdigest(), f"{len(frames)}x{SIDE}x{SIDE}@{fps:g}:{ends}")
                for col, v in zip(out, values):
                    col.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, t) for c, t in zip(out, kinds)]], ["doc_id", "n_bytes", *names])

    return encode_column(docs).mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
