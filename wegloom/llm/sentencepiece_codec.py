"""SentencePiece BPE by a prefix table.

A piece is the last one of a prefix's encoding exactly if it ends the prefix, the rest of the prefix has an encoding,
and that encoding's last piece is compatible with it: merging the two pieces' characters gives back these two. Merges
go by descending score and, for equal scores, from the left, and their order inside a stretch doesn't depend on its
neighbours, so a sequence whose neighbours are all compatible is the encoding, and there is one such piece a prefix.
The automaton of all pieces gives the candidates; ids are read backwards from the last prefix. No piece goes over from
another character to a space mark, so stretches that begin with space marks are encoded on their own and remembered.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from wegloom.llm import common

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
REMEMBERED = 700_000


class PieceCodec:
    """Encoder and decoder for a BPE model without normalisation rules, with byte fallback."""

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with identity normalisation, kept white space and byte fallback are supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.id_byte = {i: b for b, i in self.byte_ids.items()}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        if any(k in (USER, 5) for k in self.kinds):
            raise ValueError("models with user-defined or unused pieces are not supported")
        letters = {x for x in self.ids if len(x) == 1}
        if any(c not in letters for x in self.ids for c in x) or any(SPACE in x.lstrip(SPACE) for x in self.ids):
            raise ValueError("a piece has a letter that is no piece, or a space mark after other letters")
        self.compatible: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for x, i in self.ids.items():
            if self.merged(x) == [x]:  # others are never the result of merging
                self.automaton.add_word(x, (i, len(x)))
        self.automaton.make_automaton()
        cut = "".join(re.escape(c) for c in "\n\t\r" if c not in letters)
        self.stretch = re.compile(f"{SPACE}+[^{SPACE}{cut}]*|[{cut}]|[^{SPACE}{cut}]+" if cut else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        #: the text of the pieces that stand for themselves, by their number as text
        self.by_number = {str(i): p for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.known: dict[str, str] = {}

    def merged(self, text: str) -> list[str]:
        """Merge letters by score, from the left among equals: the definition, used on pairs of pieces."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """The pair test: whether merging the two pieces' letters gives the two pieces. Remembered."""
        key = left << 20 | right
        found = self.compatible.get(key)
        if found is None:
            if len(self.compatible) >= 4 * REMEMBERED:
                self.compatible.clear()
            found = self.compatible[key] = self._pair(self.pieces[left], self.pieces[right])
        return found

    def _pair(self, a: str, b: str) -> bool:
        score = self.score
        # only a piece over the boundary can come in between
        if not any(a[i:] + b[:j] in score for i in range(len(a)) for j in range(1, len(b) + 1)):
            return True
        return self.merged(a + b) == [a, b]

    def encode_stretch(self, text: str) -> list[int]:
        """Ids of a stretch: the prefix table forwards, the ids backwards. Letters that are no piece become bytes."""
        n, known, fits = len(text), self.compatible.get, self.fits
        last = [-1] * (n + 1)  # the last piece of each prefix's encoding
        for end, (i, size) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                start = end - size
                if start == 0:
                    last[end] = i
                    continue
                before = last[start]
                # after a letter that is no piece nothing can merge over the boundary
                if before < 0:
                    if text[start - 1] not in self.ids:
                        last[end] = i
                elif (ok := known(before << 20 | i)) or ok is None and fits(before, i):
                    last[end] = i
        out: list[int] = []
        at, pieces = n, self.pieces
        while at:
            i = last[at]
            if i < 0:
                out.extend([self.byte_ids[b] for b in reversed(text[at - 1].encode())])
                at -= 1
            else:
                out.append(i)
                at -= len(pieces[i])
        out.reverse()
        return out

    def _learn(self, stretch: str) -> str:
        ids = self.encode_stretch(stretch)
        found = ",".join(map(str, ids))
        if len(stretch) <= 64:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[stretch] = found
        return found

    def encode_to_string(self, text: str) -> tuple[str, str]:
        """Decimal ids joined by commas, and the text that decoding them gives."""
        if not text:
            return "", ""
        marked = self.prefix + text.replace(" ", SPACE)
        parts = self.stretch.findall(marked)
        known, learn = self.known.get, self._learn
        ids = ",".join([known(s) or learn(s) for s in parts])
        text_of = self.by_number
        try:
            return ids, "".join([text_of[i] for i in ids.split(",")]).replace(SPACE, " ")[len(self.prefix) :]
        except KeyError:  # bytes, whose letters come of several ids
            return ids, self.decode([int(i) for i in ids.split(",")])

    def encode(self, text: str) -> list[int]:
        ids = self.encode_to_string(text)[0]
        return [int(i) for i in ids.split(",")] if ids else []

    def decode_raw(self, ids: list[int]) -> str:
        """Text of the ids with the space of the dummy prefix; bytes that are no UTF-8 become U+FFFD, one each."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if i in self.id_byte:
                held.append(self.id_byte[i])
                continue
            if held:
                out.append(utf8(bytes(held)))
                held.clear()
            kind = self.kinds[i]
            out.append(" ⁇ " if kind == UNKNOWN else "" if kind == CONTROL else self.pieces[i].replace(SPACE, " "))
        if held:
            out.append(utf8(bytes(held)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.decode_raw(ids)
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        return text[1:] if self.prefix and first is not None and self.pieces[first].startswith(SPACE) else text


def utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_codecs: dict[bytes, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """The codec of a model file's bytes, built once a process."""
    key = hashlib.sha256(model).digest()
    if key not in _codecs:
        _codecs[key] = PieceCodec(model)
    return _codecs[key]


def encode_decode(docs: DataFrame, model_path: str, digest: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode every text and decode its ids again.

    Returns id, n_tokens and, with `digest`, ids_sha256 (decimal ids joined by commas) and decoded_sha256; without it
    `ids` (array) and `decoded`. Null texts count as empty: no ids, empty decoded text. Other columns of docs are not
    carried. The model file (its size is that of a vocabulary) is read on the driver and broadcast.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = f"{id_column} bigint, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string")

    def run(batches):
        own = codec(model.value)
        for batch in common.slices(batches, text_column):
            counts, first, second = [], [], []
            for text in common.texts_of(batch, text_column):
                ids, decoded = own.encode_to_string(text)
                counts.append(ids.count(",") + 1 if ids else 0)
                if digest:
                    first.append(hashlib.sha256(ids.encode()).hexdigest())
                    second.append(hashlib.sha256(decoded.encode()).hexdigest())
                else:
                    first.append([int(i) for i in ids.split(",")] if ids else [])
                    second.append(decoded)
            names = ["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(counts, pa.int64()), pa.array(first, pa.string() if digest else pa.list_(pa.int32())), pa.array(second, pa.string())], [id_column, "n_tokens", *names])

    return docs.select(id_column, text_column).mapInArrow(run, kind)
