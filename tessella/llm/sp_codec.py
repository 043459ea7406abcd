"""SentencePiece encoding with offsets, and decoding.

Text is normalised by longest-prefix replacement through the model's compiled character map (a double-array trie in the
model file), and every normalised byte keeps the place of the original byte that it came from. A piece's end in the
normalised text is the sum of the pieces' lengths so far, so each piece is projected to a span of original bytes.
Ids are the library's own: units between spaces are encoded by it once each and looked up afterwards (no piece of the
model holds a space after another character, which is checked when it is loaded; otherwise whole texts are encoded).

Defined results: null or empty text: begin and end ids only, an empty decoded text. Control ids have empty spans, at
the start and the end of the text. Repeated rows are encoded alike; a null id is kept. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bytesops import buffers
from .units import UnitEncoder, rows_with

MODEL = "piece_bpe_32k.model"
SPACE = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        x = shift = 0
        while True:
            c = data[i]
            i += 1
            x |= (c & 127) << shift
            shift += 7
            if c < 128:
                return x

    while i < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = number() if key & 7 == 2 else 8 if key & 7 == 1 else 4
            yield key >> 3, data[i : i + n]
            i += n


class CharacterMap:
    """A compiled character map: byte prefixes to their replacements."""

    def __init__(self, compiled: bytes):
        n = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + n], "<u4").tolist()
        self.strings = compiled[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of data[at:] and its replacement."""
        units, best = self.units, None
        if not units:
            return None
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or (units[node] & 0x800000FF) != data[i]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best = i + 1 - at, units[node] & 0x7FFFFFFF
        if best is None:
            return None
        end = self.strings.index(b"\0", best[1])
        return best[0], self.strings[best[1] : end]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces, spec = [], {}
        for field, value in _fields(model):
            if field == 1:
                p = dict(_fields(value))
                pieces.append((p[1].decode(), p.get(3, 1)))
            elif field == 3:
                spec = dict(_fields(value))
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy, self.squeeze, self.escape = spec.get(3, 1), spec.get(4, 1), spec.get(5, 1)
        self.size = np.array([0 if kind in (2, 3) else 1 if kind == 6 else len(p.encode()) for p, kind in pieces])
        self.unknown = self.sp.unk_id()
        plain = not self.map.units and self.dummy and not self.squeeze and self.escape
        apart = all(SPACE not in p.lstrip(SPACE) for p, _ in pieces) and not any(kind == 4 for _, kind in pieces)
        encode = lambda texts: self.sp.encode(texts, num_threads=1)
        self.plain = plain
        #: A row that starts with a space or ends in one (a lone space is no text of its own), or holds the mark itself, is encoded whole; where units are not apart, every row.
        self.units = UnitEncoder(encode, b" ", _odd if plain and apart else lambda raw, off: np.arange(len(off) - 1), lambda u: u[1:] if u[:1] == b" " else u)

    def normalised(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and the end the original byte that it comes from."""
        if self.plain:
            raw = np.frombuffer(text, np.uint8)
            n = np.where(raw == 32, 3, 1)
            back = np.repeat(np.arange(len(raw)), n)
            head = [0] * 3 if len(raw) else []
            return (SPACE + text.decode().replace(" ", SPACE)).encode() if len(raw) else b"", np.concatenate([head, back, [len(raw)]]).astype(np.int64)
        out, back, i, mark = bytearray(), [], 0, SPACE.encode()
        if self.dummy and text:
            out += mark if self.escape else b" "
            back += [0] * len(out)
        spaced = bool(self.squeeze)
        while i < len(text):
            hit = self.map.longest(text, i)
            n = 1 if text[i] < 128 else 2 if text[i] < 224 else 3 if text[i] < 240 else 4
            size, new = hit or (n, text[i : i + n])
            for c in new:
                if c == 32 and spaced and self.squeeze:
                    continue
                piece = mark if c == 32 and self.escape else bytes([c])
                out += piece
                back += [i] * len(piece)
                spaced = c == 32
            i += size
        tail = mark if self.escape else b" "
        while self.squeeze and out.endswith(tail):
            del out[-len(tail) :]
            del back[-len(tail) :]
        return bytes(out), np.array([*back, len(text)], np.int64)

    def spans(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Original byte span of each id (without control ids)."""
        norm, back = self.normalised(text)
        size = self.size[ids]
        if (ids == self.unknown).any():  # an unknown piece takes what is left over: only models without byte fallback have it
            proto = self.sp.encode(text.decode(), return_type="proto")
            size = np.array([len(p.surface.replace(" ", SPACE).encode()) if p.id == self.unknown else self.size[p.id] for p in proto.pieces])
        end = np.cumsum(size)
        if len(end) and end[-1] != len(norm):
            raise ValueError("pieces do not cover the normalised text")
        return back[end - size], back[end]


def _odd(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    full = np.flatnonzero(np.diff(off) > 0)
    ends = full[(raw[off[full]] == 32) | (raw[off[full + 1] - 1] == 32)]
    return np.union1d(ends, rows_with(raw, off, [SPACE.encode()]))


@lru_cache(1)
def codec(path: str) -> Codec:
    return Codec(path)


COLUMNS = "n_tokens long, ids binary, starts binary, ends binary, decoded string"


def _encode(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        c = codec(public_tokenizers.path(model) if "/" not in model else model)
        bos, eos = c.sp.bos_id(), c.sp.eos_id()
        for batch in batches:
            raw, off = buffers(batch.column(1))
            for i, j, ids, first in c.units.rows(batch.column(1)):
                packed, starts, ends, full = [], [], [], []
                for r in range(j - i):
                    own, text = ids[first[r] : first[r + 1]], raw[off[i + r] : off[i + r + 1]].tobytes()
                    a, b = c.spans(text, own)
                    full.append([bos, *own.tolist(), eos])
                    packed.append(np.array(full[-1], "<u4").tobytes())
                    starts.append(np.concatenate([[0], a, [len(text)]]).astype("<u4").tobytes())
                    ends.append(np.concatenate([[0], b, [len(text)]]).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([len(x) for x in full], pa.int64()), pa.array(packed, pa.binary()), pa.array(starts, pa.binary()), pa.array(ends, pa.binary()), pa.array(c.sp.decode(full, num_threads=1) if full else [], pa.string())],
                    ["doc_id", "n_tokens", "ids", "starts", "ends", "decoded"],
                )

    return run


def encode_documents(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id; n_tokens; ids, starts and ends of their original bytes (little-endian unsigned 32-bit each); the decoded text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode(model), "doc_id long, " + COLUMNS)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.sha2("ends", 256).alias("ends_sha256"))


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's ids, decoded text and piece ends."""
    return digests(encode_documents(common.table(spark, sf_dir, "documents")))
