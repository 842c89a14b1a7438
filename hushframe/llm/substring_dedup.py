"""Substring deduplication by content-defined chunks.

A gear hash (h = 2 h + G[byte], 16 bits, so that only the last 16 bytes count) rolls
over a text.  A chunk ends after a word whose hash is smaller than those of the
``REACH`` words on either side.  This rule looks only at nearby bytes: an insertion
moves the cuts beside it and no others, and chunks have at least ``REACH`` + 1 words
(but for a text's last) and at most ``MOST``.

A chunk counts as repeated where its digest, taken together with its neighbours'
(three adjacent chunks, hashed as one byte range to 128 bits), is also in a document of
a smaller key or further ahead in the same one.  Three chunks are some 15 words, so common
phrases do not match by chance however large the corpus.  Stretches of repeated
chunks of at least ``min_words`` words are removed; the copy in the smallest key
stays.

Defined results: null and empty texts have no chunks and stay as they are; rows
with equal keys are one document and lose nothing to each other; keys may be of any
type that has an order, and a null key counts as the largest; texts of under three
chunks lose nothing; an empty table gives an empty table; a column named like the one
that is added is replaced.  What is removed is replaced by nothing, so the text keeps
the white space before the stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.llm.shared import cut, spread_join
from hushframe.llm.textbytes import SPACED, RangeHash, Words, as_bytes, chunks, mix, releasing, words

REACH = 2
MOST = 12
ADJACENT = 3
MIN_WORDS = 25

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
#: As long as the hash looks back: a text's first words hash alike wherever it stands.
_GAP = b"\n" * 16


def gear(buf: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash at every byte: the sum of G[b] << age over the last 16 bytes."""
    h = _GEAR[buf]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step].copy() << step
    return h


def chunk_ends(w: Words) -> np.ndarray:
    """Indices of words that end a chunk; a text's last word always does."""
    n = len(w.hash)
    # Ties go to the word ahead; a word's rank is its hash, then its place.
    rolled = gear(w.buf)[w.end - 1].astype(np.int64)
    last = np.zeros(n, dtype=bool)
    last[w.first[1:][w.counts > 0] - 1] = True
    doc = w.doc_of_word()
    least = np.ones(n, dtype=bool)
    for step in range(1, REACH + 1):
        inside = doc[step:] == doc[:-step]
        least[step:] &= inside & (rolled[step:] < rolled[:-step])
        least[:step] = False
        least[:-step] &= inside & (rolled[:-step] <= rolled[step:])
        least[-step:] = False
    ends = np.flatnonzero(least | last)
    # A longer chunk is cut every MOST words from its start: words that repeat themselves have no smallest hash.
    first = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    more = (ends - first) // MOST
    if more.any():
        step = np.arange(1, more.sum() + 1) - np.repeat(np.cumsum(more) - more, more)
        ends = np.sort(np.concatenate((ends, np.repeat(first, more) + step * MOST - 1)))
    return ends


class Chunks:
    """The chunks of a batch of texts, and a digest of each three adjacent ones, named by the first."""

    def __init__(self, texts: list[bytes]):
        made: list[RangeHash] = []
        self.words = w = words(texts, SPACED, gap=_GAP, ranges=made)
        self.last = chunk_ends(w)  # word
        self.doc = np.searchsorted(w.first, self.last, side="right") - 1
        self.first = np.concatenate(([0], self.last[:-1] + 1)) if len(self.last) else self.last
        n = max(0, len(self.last) - ADJACENT + 1)
        self.head = np.flatnonzero(self.doc[:n] == self.doc[ADJACENT - 1 :]) if n else np.empty(0, dtype=np.int64)
        begin, end = w.start[self.first[self.head]], w.end[self.last[self.head + ADJACENT - 1]]
        self.digest = mix(made[0].of(begin, end) ^ (end - begin).astype(np.uint64)).view(np.int64)
        self.ranges = begin, end
        self.head_doc = self.doc[self.head]

    def more(self) -> np.ndarray:
        """The digests' other halves."""
        return RangeHash(self.words.buf, salt=1).of(*self.ranges).view(np.int64)

    def repeated(self, ahead: np.ndarray) -> list[list[tuple[int, int]]]:
        """By text, byte ranges of stretches to remove; ahead: which digests are repeated."""
        w = self.words
        flag = np.zeros(len(self.last) + 1, dtype=bool)
        for j in range(ADJACENT):
            flag[self.head[ahead] + j] = True
        out: list[list[tuple[int, int]]] = [[] for _ in w.text_start]
        at = np.flatnonzero(flag[:-1])
        if not len(at):
            return out
        breaks = np.flatnonzero((np.diff(at) > 1) | (np.diff(self.doc[at]) > 0)) + 1
        for run in np.split(at, breaks):
            i, j, d = self.first[run[0]], self.last[run[-1]], self.doc[run[0]]
            if j - i + 1 >= self.min_words:
                out[d].append((int(w.start[i] - w.text_start[d]), int(w.end[j] - w.text_start[d])))
        return out

    min_words = MIN_WORDS


def digests(docs: DataFrame) -> DataFrame:
    """From (k, text): rows (digest, more, k) for each distinct digest of a document, in two halves."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = as_bytes(batch.column(1)), batch.column(0)
            for part in chunks(texts):
                c = Chunks(texts[part])
                _, some = np.unique(mix(c.digest.view(np.uint64) ^ mix(c.head_doc.astype(np.uint64))), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(c.digest[some]), pa.array(c.more()[some]), keys.take(pa.array(c.head_doc[some] + part.start))], names=["digest", "more", "k"])

    return docs.select("k", "text").mapInArrow(run, T.StructType([*T.StructType.fromDDL("digest long, more long").fields, docs.schema["k"]]))


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents' columns with the text deduplicated, and hushframe_spans array<struct<start, end>> (UTF-8 byte ranges removed).

    Only digests that two documents have go beyond the first aggregation, which
    combines them before the shuffle.  Then the documents' digests meet those; a passage
    in a third of all documents is one of few such, which go to every task, so its rows
    stay where they are.  The list of a document's repeated digests is bounded by
    its own text.
    """
    names = [x for x in docs.columns if x != "hushframe_spans"]
    inner = {x: f"hf_c{i}" for i, x in enumerate(names)}
    base = docs.select(*(F.col(f"`{x}`").alias(inner[x]) for x in names))
    id_, body = F.col(inner[key]), inner[text]
    whole = isinstance(docs.schema[key].dataType, T.IntegralType)
    order = F.coalesce(id_.cast("long"), F.lit(2**63 - 1)) if whole else F.struct(id_.isNull().alias("none"), id_.alias("key"))
    keyed = base.withColumn("hf_order", order).withColumn("hf_row", F.xxhash64("hf_order", body))
    first = digests(keyed.select(F.col("hf_order").alias("k"), F.col(body).alias("text"))).groupBy("digest", "more").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count("*").alias("n"))
    repeated = cut(first.where("first < last").select("digest", F.col("more").alias("other"), "first", "n"), "repeated")
    both = keyed.select(F.struct("hf_order", "hf_row").alias("k"), F.col(body).alias("text"))
    own = spread_join(digests(both).select("digest", "more", "k.*"), repeated, "digest", "n").where("more = other and hf_order > first")
    lists = own.groupBy("hf_row").agg(F.collect_set("digest").alias("hf_digests"))
    joined = keyed.drop("hf_order").join(lists, "hf_row", "left").drop("hf_row")
    spans = T.ArrayType(T.StructType.fromDDL("start long, end long"))
    out_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = as_bytes(batch.column(body)), batch.column("hf_digests")
            for part in chunks(texts):
                c, rows = Chunks(texts[part]), batch.slice(part.start, part.stop - part.start)
                c.min_words = min_words
                removed = c.repeated(ahead_of(c, found.slice(part.start, part.stop - part.start)))
                kept = rows.column(body)
                if any(removed):
                    kept = pa.array([without(b, r).decode("utf-8", "replace") if there else None for there, b, r in zip(kept.is_valid().to_pylist(), texts[part], removed, strict=True)], type=kept.type)
                column = pa.array([[{"start": a, "end": b} for a, b in x] for x in removed], type=out_type)
                yield pa.RecordBatch.from_arrays([kept if x == body else rows.column(x) for x in inner.values()] + [column], names=[*inner.values(), "hushframe_spans"])

    schema = T.StructType([*base.schema.fields, T.StructField("hushframe_spans", spans)])
    return joined.select(*inner.values(), "hf_digests").mapInArrow(run, schema).toDF(*names, "hushframe_spans")


def ahead_of(c: Chunks, found: pa.Array) -> np.ndarray:
    """Which digests are in their document's list, or ahead in the same document."""
    flat, sizes = found.flatten(), np.diff(found.offsets.to_numpy()) if len(found) else np.empty(0, dtype=np.int64)
    sizes = np.where(np.asarray(found.is_valid()), sizes, 0)
    salt = mix(np.arange(1, len(sizes) + 1, dtype=np.uint64))
    listed = np.unique(flat.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.repeat(salt, sizes))
    own = c.digest.view(np.uint64) ^ salt[c.head_doc]
    ahead = np.ones(len(own), dtype=bool)
    ahead[np.unique(own, return_index=True)[1]] = False
    if len(listed):
        at = np.minimum(np.searchsorted(listed, own), len(listed) - 1)
        ahead |= listed[at] == own
    return ahead


def without(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for begin, end in ranges:
        kept.append(text[at:begin])
        at = end
    return b"".join([*kept, text[at:]])


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's text without the passages that a document of a smaller doc_id has too, and what was removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup(docs)
    removed = F.aggregate("hushframe_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "text", removed.alias("removed_bytes"), F.size("hushframe_spans").alias("n_removed"), F.col("hushframe_spans").alias("removed"))
