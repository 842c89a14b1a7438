"""SentencePiece models on the tokenizers library.

The model's protobuf is parsed by hand (its wire format is public), and its parts
are rebuilt: the normaliser, the metaspace marker, the pieces with their scores
(a unigram model, or the merges that a BPE model's scores imply) and byte fallback.

No piece holds a marker after another character, and some characters are in no
piece; text can be cut at such places without changing any result.  So a
worker encodes each distinct stretch once (multithreaded, by encode_batch), and puts
a text's ids together from those.  Whether a model allows a cut is read from
its pieces, not assumed.  Stretches are found, told apart (by 64-bit hashes) and put
together on flat arrays of a whole batch; were two stretches to share a hash, the
parity of the texts that hold them would be false.

Defined results: null and empty texts have no ids and decode to the empty text.
Parity is verified on every whole text against the sentencepiece library.  Other
columns, whatever their names, are returned as they are; a column named like one that
is added is replaced by it.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.llm.textbytes import RangeHash, chunks, releasing

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stretches whose ids a worker keeps; some 40 MB. Beyond that it starts anew.
KEPT = 1_000_000
#: New stretches that are encoded as one string, where a line break parts them.
TOGETHER = 256
#: Values of the public model format: types of pieces and models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message; length-delimited values as bytes, 32-bit ones as float."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        elif kind == 5:
            yield tag >> 3, struct.unpack("<f", raw[at : at + 4])[0]
            at += 4
        elif kind == 1:
            yield tag >> 3, struct.unpack("<d", raw[at : at + 8])[0]
            at += 8
        else:
            raise ValueError(f"wire type {kind}")


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True

    @classmethod
    def parse(cls, raw: bytes) -> Model:
        out = cls()
        for number, value in fields(raw):
            if number == 1:
                piece = dict(fields(value))
                out.pieces.append((piece[1].decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
            elif number == 2:
                spec = dict(fields(value))
                out.kind, out.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(fields(value))
                out.charsmap = spec.get(2, b"")
                out.dummy_prefix, out.trim_spaces, out.escape_spaces = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if out.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {out.kind} is not supported")
        if any(kind == USER_DEFINED for _, _, kind in out.pieces):
            raise ValueError("user-defined pieces are not supported")
        return out


class Codec:
    """Encodes and decodes batches of texts."""

    def __init__(self, path: str = MODEL, threads: int = 2):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        from tokenizers import Tokenizer, decoders, models, normalizers

        with open(path, "rb") as f:
            self.model = model = Model.parse(f.read())
        known = [(p, s) for p, s, kind in model.pieces if kind == NORMAL]
        unknown = next(i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN)
        if model.kind == BPE:
            ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
            scores = {p: s for p, s in known}
            # All ways to build a piece from two others share its score; the order among them is that of their ids.
            merges = sorted(((-scores[p], ids[p], ids[p[:i]], ids[p[i:]], p[:i], p[i:]) for p in scores for i in range(1, len(p)) if p[:i] in scores and p[i:] in scores))
            core = models.BPE(vocab=ids, merges=[(a, b) for *_, a, b in merges], unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
        else:
            least = min((s for _, s in known), default=0.0) - 10
            core = models.Unigram([(p, s if kind == NORMAL else (-1e9 if kind != UNKNOWN else least)) for p, s, kind in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
        self.tokenizer = Tokenizer(core)
        self.normalizer = normalizers.Precompiled(model.charsmap) if model.charsmap else None
        self.tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        #: Bytes that a piece decodes to; control pieces to none, the unknown piece as sentencepiece shows it.
        self.bytes_of = [{BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: " ⁇ ".encode()}.get(kind, lambda p: p.replace(MARK, " ").encode())(p) for p, _, kind in model.pieces]
        sizes = np.fromiter(map(len, self.bytes_of), dtype=np.int64, count=len(self.bytes_of))
        self.piece_bytes, self.piece_size, self.piece_start = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8), sizes, np.cumsum(sizes) - sizes
        inside = {c for p, _ in known for c in p}
        #: Whether a text can be cut before markers, and beside line breaks.
        self.cut_marks = model.escape_spaces and not any(MARK in p.lstrip(MARK) for p, _ in known)
        self.cut_lines = self.cut_marks and model.byte_fallback and "\n" not in inside
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        """Start anew with the encoded stretches."""
        self.known = np.empty(0, dtype=np.uint64)
        self.entry = np.empty(0, dtype=np.int64)
        self.flat = np.empty(0, dtype=np.int32)
        self.begin = np.zeros(1, dtype=np.int64)

    def normalized(self, text: str) -> str:
        """As the model sees it, but with spaces for markers."""
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        if self.model.trim_spaces:
            text = re.sub(" +", " ", text.strip(" "))
        if text and self.model.dummy_prefix:
            text = " " + text
        return text.replace(MARK, " ") if self.model.escape_spaces else text

    def starts(self, buf: np.ndarray, text_start: np.ndarray) -> np.ndarray:
        """Where stretches begin in the joined texts."""
        first = np.zeros(len(buf), dtype=bool)
        first[text_start[text_start < len(buf)]] = True
        if self.cut_marks:
            mark = buf == 0x20
            first[1:] |= mark[1:] & ~mark[:-1]
        if self.cut_lines:
            line = buf == 0x0A
            first |= line
            first[1:] |= line[:-1]
        return np.flatnonzero(first)

    def learn(self, stretches: list[bytes], hashes: np.ndarray) -> None:
        """Encode stretches that are not known yet, and keep their ids."""
        texts = [x.decode().replace(" ", MARK) if self.model.escape_spaces else x.decode() for x in stretches]
        if self.cut_lines:
            # A line break is one stretch itself and parts the others.
            groups = ["\n".join(texts[i : i + TOGETHER]) for i in range(0, len(texts), TOGETHER)]
            joined = [x.ids + self.line for x in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)]
            ids = np.fromiter(chain.from_iterable(joined), dtype=np.int32)
            stops = np.flatnonzero(ids == self.line[0])
            lengths = np.diff(stops, prepend=-1) - 1
            ids = np.delete(ids, stops)
        else:
            each = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            lengths, ids = np.fromiter(map(len, each), dtype=np.int64, count=len(each)), np.fromiter(chain.from_iterable(each), dtype=np.int32)
        number = len(self.begin) - 1 + np.arange(len(hashes))
        at = np.searchsorted(self.known, hashes)
        self.known, self.entry = np.insert(self.known, at, hashes), np.insert(self.entry, at, number)
        self.flat = np.concatenate((self.flat, ids))
        self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(lengths)))

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids (int32) of all texts, and where each text's begin, with the end. Stretches are kept from call to call, up to ``KEPT`` of them."""
        if len(self.known) > KEPT:
            self.forget()
        raw = [self.normalized(text).encode() for text in texts]
        joined = b"".join(raw)
        buf = np.frombuffer(joined, dtype=np.uint8)
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in raw], dtype=np.int64)))
        begin = self.starts(buf, bounds[:-1])
        end = np.append(begin[1:], len(buf))[: len(begin)]
        hashes = RangeHash(buf).of(begin, end)
        if self.cut_lines:
            hashes[(buf[begin] == 0x0A)] = 0
            if not len(self.known):
                self.known, self.entry = np.zeros(1, dtype=np.uint64), np.zeros(1, dtype=np.int64)
                self.flat, self.begin = np.array(self.line, dtype=np.int32), np.array([0, len(self.line)])
        unique, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), dtype=bool)
        there = at < len(self.known)
        new[there] = self.known[at[there]] != unique[there]
        if new.any():
            self.learn([joined[begin[i] : end[i]] for i in where[new]], unique[new])
        own = self.entry[np.searchsorted(self.known, unique)][which]
        n = self.begin[own + 1] - self.begin[own]
        stop = np.concatenate(([0], np.cumsum(n)))
        ids = self.flat[np.repeat(self.begin[own] - stop[:-1], n) + np.arange(stop[-1])]
        return ids, stop[np.searchsorted(begin, bounds)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (int32) of each text."""
        ids, first = self.encode_flat(texts)
        return [ids[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]

    def decode_flat(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes that all ids give, and where each text's begin and end in them; text i has ids first[i] to first[i + 1] - 1."""
        n = self.piece_size[ids]
        stop = np.concatenate(([0], np.cumsum(n)))
        out = self.piece_bytes[np.repeat(self.piece_start[ids] - stop[:-1], n) + np.arange(stop[-1])]
        begin, end = stop[first[:-1]], stop[first[1:]]
        if self.model.dummy_prefix and len(out):
            begin = begin + ((begin < end) & (out[np.minimum(begin, len(out) - 1)] == 0x20))
        return out, begin, end

    def decode(self, ids: np.ndarray) -> str:
        out, begin, end = self.decode_flat(ids, np.array([0, len(ids)]))
        return out[begin[0] : end[0]].tobytes().decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}
_libraries: dict[str, object] = {}


def codec(path: str) -> Codec:
    """One codec for each model in a worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def library(path: str):
    """One processor of the sentencepiece library for each model in a worker."""
    if path not in _libraries:
        import sentencepiece

        _libraries[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _libraries[path]


def flat_texts(batch: pa.Array) -> list[str]:
    return [x or "" for x in batch.to_pylist()]


def added(rows: DataFrame, name: str, kind: T.DataType) -> tuple[list[str], T.StructType]:
    """The columns that stay, and the schema with one more."""
    kept = [f for f in rows.schema.fields if f.name != name]
    return [f.name for f in kept], T.StructType([*kept, T.StructField(name, kind)])


def id_lists(ids: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, type=pa.int32()), pa.array(ids, type=pa.int32()))


def encode(docs: DataFrame, *, text: str = "text", model: str = MODEL) -> DataFrame:
    """The documents' columns and hushframe_ids array<int>."""
    names, schema = added(docs, "hushframe_ids", T.ArrayType(T.IntegerType()))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = flat_texts(batch.column(text))
            for part in chunks(texts):
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*(rows.column(x) for x in names), id_lists(*codec(model).encode_flat(texts[part]))], names=[*names, "hushframe_ids"])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, *, ids: str = "hushframe_ids", model: str = MODEL) -> DataFrame:
    """The rows' columns and hushframe_decoded string; null ids decode to the empty text."""
    names, schema = added(rows, "hushframe_decoded", T.StringType())

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(model).decode(np.array(x or [], dtype=np.int32)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(texts, type=pa.string())], names=[*names, "hushframe_decoded"])

    return rows.mapInArrow(run, schema)


def same_bytes(out: np.ndarray, begin: np.ndarray, end: np.ndarray, texts: list[str]) -> np.ndarray:
    """Which of the texts lie at begin to end of the bytes."""
    joined = out.tobytes()
    return np.fromiter((joined[i:j] == t.encode() for i, j, t in zip(begin.tolist(), end.tolist(), texts, strict=True)), dtype=bool, count=len(texts))


def same_ids(ids: np.ndarray, first: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which texts' ids are those of the other side."""
    joined = ids.tobytes()
    return np.fromiter((joined[4 * i : 4 * j] == np.asarray(x, dtype=np.int32).tobytes() for i, j, x in zip(first[:-1].tolist(), first[1:].tolist(), others, strict=True)), dtype=bool, count=len(others))


def round_trip(docs: DataFrame, *, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """For each document its key, ids array<int>, n_tokens long, ids_crc32 long (of little-endian int32 ids), round_trip boolean, parity boolean.

    round_trip: the ids decode to the text.  parity: the sentencepiece library gives
    the same ids.  Encoding, decoding and comparing happen in one pass.
    """
    kept = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other = codec(model), library(model)
        for batch in batches:
            texts = flat_texts(batch.column(1))
            for part in chunks(texts):
                some = texts[part]
                ids, first = own.encode_flat(some)
                crc = [zlib.crc32(ids[i:j].astype("<i4").tobytes()) for i, j in zip(first[:-1], first[1:], strict=True)]
                rows = [id_lists(ids, first), pa.array(np.diff(first)), pa.array(crc, type=pa.int64()), pa.array(same_bytes(*own.decode_flat(ids, first), some)), pa.array(same_ids(ids, first, other.encode_as_numpy(some, num_threads=1)))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, len(some)), *rows], names=["key", "ids", "n_tokens", "ids_crc32", "round_trip", "parity"])

    out = kept.mapInArrow(run, T.StructType([kept.schema["key"], *T.StructType.fromDDL("ids array<int>, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean").fields]))
    return out.withColumnRenamed("key", key)


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document's ids, their number and digest, and whether they decode to the text and equal the library's."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
