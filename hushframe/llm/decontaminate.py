"""Benchmark decontamination by a prefix-filtered join of word windows.

Every benchmark item gives windows of ``size`` consecutive words (an item of fewer
words, but not none, gives one window of all its words).  A window must occur
whole, so any one of its words is a sufficient prefix: words are ordered by how
many documents hold them, and only the rarest word of each window is joined with
the documents' words.  A match fixes where the window would have to start; it is
kept if the window fits between the text's bounds (length and position), and then
all of the window's words are compared in order (exact containment).

The benchmark is read in blocks of at most ``block_windows`` windows.  A block is
what is broadcast, so its size is bounded whatever the benchmark's; documents are
matched with one block after another.

Words are compared by 64-bit hashes, not by their bytes: a window counts as found when
the hashes of all its words are, in order.

Defined results: null and empty texts have no words and no hits; an item without
words has no window; items with equal ids are one item; repeated documents get
equal rows; an empty benchmark leaves every document clean; columns named like those
that are added are replaced in what matched() returns, and kept by clean_documents().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.llm.shared import cut
from hushframe.llm.textbytes import ALNUM, LOWER, as_bytes, chunks, releasing, words

SIZE = 13
BLOCK_WINDOWS = 200_000


class Index:
    """One block of windows: word hashes, rarest word, item."""

    def __init__(self, runs: list[tuple[str, np.ndarray]], count: dict[int, int]):
        self.items = sorted({item for item, _ in runs})
        place = {item: i for i, item in enumerate(self.items)}
        found: dict[tuple[int, bytes], tuple[int, np.ndarray]] = {}
        for item, run in runs:
            found[place[item], run.tobytes()] = (place[item], run)
        sized = sorted(found.values(), key=lambda x: len(x[1]))
        self.item = np.array([i for i, _ in sized], dtype=np.int64)
        self.length = np.array([len(run) for _, run in sized], dtype=np.int64)
        self.words = np.zeros((len(sized), max(self.length, default=0)), dtype=np.uint64)
        #: The prefix: the rarest word, by document count, then hash; of equal words the first.
        self.offset = np.array([min(range(len(run)), key=lambda j: (count.get(int(run[j]), 0), int(run[j]))) for _, run in sized], dtype=np.int64)
        for row, (_, run) in zip(self.words, sized, strict=True):
            row[: len(run)] = run
        prefix = np.array([run[j] for (_, run), j in zip(sized, self.offset, strict=True)], dtype=np.uint64)
        order = np.argsort(prefix, kind="stable")
        for name in ("item", "length", "words", "offset"):
            setattr(self, name, getattr(self, name)[order])
        self.prefix, self.at = np.unique(prefix[order], return_index=True)
        self.at = np.append(self.at, len(order))
        self.sieve = np.zeros(1 << 16, dtype=bool)
        self.sieve[(self.prefix & np.uint64(0xFFFF)).astype(np.int64)] = True

    def match(self, hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences as (window, first word, one past the last word); text bounds of word i are low[i] and high[i]."""
        maybe = np.flatnonzero(self.sieve[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        if not len(maybe) or not len(self.prefix):
            return (np.empty(0, dtype=np.int64),) * 3
        place = np.minimum(np.searchsorted(self.prefix, hashes[maybe]), len(self.prefix) - 1)
        real = self.prefix[place] == hashes[maybe]
        maybe, place = maybe[real], place[real]
        many = self.at[place + 1] - self.at[place]
        at = np.repeat(maybe, many)
        window = np.repeat(self.at[place] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(len(at)) if len(at) else at
        begin = at - self.offset[window]
        end = begin + self.length[window]
        fits = (begin >= low[at]) & (end <= high[at])
        window, begin, end = window[fits], begin[fits], end[fits]
        for j in range(self.words.shape[1]):
            inside = np.minimum(begin + j, len(hashes) - 1)
            good = (j >= self.length[window]) | (hashes[inside] == self.words[window, j])
            window, begin, end = window[good], begin[good], end[good]
        return window, begin, end


def item_windows(item_text: bytes, size: int = SIZE) -> list[np.ndarray]:
    run = words([item_text], ALNUM, LOWER).hash
    return [run[i : i + size] for i in range(max(1, len(run) - size + 1))] if len(run) else []


def blocks_of(benchmark: DataFrame, item: str, text: str, size: int, most: int) -> Iterator[list[tuple[str, np.ndarray]]]:
    """Lists of at most ``most`` windows, read from the table one partition at a time; an item of more is spread over several lists."""
    block: list[tuple[str, np.ndarray]] = []
    for row in benchmark.select(F.col(f"`{item}`").cast("string"), F.col(f"`{text}`")).toLocalIterator():
        for run in item_windows((row[1] or "").encode(errors="surrogatepass"), size):
            block.append((row[0] if row[0] is not None else "", run))
            if len(block) == most:
                yield block
                block = []
    if block:
        yield block


def word_counts(docs: DataFrame, text: str, wanted: np.ndarray) -> dict[int, int]:
    """In how many documents, of all, each of the wanted words is; at most one row for each wanted word is sent back."""
    seen = docs.sparkSession.sparkContext.broadcast(np.sort(wanted))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, total = seen.value, np.zeros(len(seen.value), dtype=np.int64)
        sieve = np.zeros(1 << 16, dtype=bool)
        sieve[(names & np.uint64(0xFFFF)).astype(np.int64)] = True
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for part in chunks(texts):
                w = words(texts[part], ALNUM, LOWER)
                maybe = np.flatnonzero(sieve[(w.hash & np.uint64(0xFFFF)).astype(np.int64)])
                place = np.minimum(np.searchsorted(names, w.hash[maybe]), len(names) - 1)
                real = names[place] == w.hash[maybe]
                pairs = np.unique(w.doc_of_word()[maybe[real]] * len(names) + place[real])
                total += np.bincount(pairs % len(names), minlength=len(names))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(names[some].view(np.int64)), pa.array(total[some])], names=["word", "n"])

    rows = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(rows.column(0).to_numpy().view(np.uint64).tolist(), rows.column(1).to_pylist(), strict=True))


def matched(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = SIZE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents' columns, and hushframe_n_words long, hushframe_items array<string> (sorted), hushframe_spans array<bigint>.

    The spans hold first, past-the-last word positions of the hit stretches, one after another.
    """
    spark = docs.sparkSession
    own = {x: f"hushframe_{x}" for x in ("n_words", "items", "spans")}
    docs = docs.select([F.col(f"`{x}`") for x in docs.columns if x not in own.values()])
    out, cast = docs.withColumns({own["n_words"]: F.lit(0).cast("long"), own["items"]: F.array().cast("array<string>"), own["spans"]: F.array().cast("array<bigint>")}), T.StructType
    blocks = 0

    def marked(source: DataFrame, index: Index) -> DataFrame:
        held = spark.sparkContext.broadcast(index)
        schema = cast([T.StructField(f.name, f.dataType, True) for f in source.schema.fields])

        @releasing
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                texts = as_bytes(batch.column(text))
                before = batch.column(own["items"]).to_pylist(), batch.column(own["spans"]).to_pylist()
                for part in chunks(texts):
                    rows = range(part.start, part.stop)
                    w = words(texts[part], ALNUM, LOWER)
                    low, high = np.repeat(w.first[:-1], w.counts), np.repeat(w.first[1:], w.counts)
                    window, begin, end = index.match(w.hash, low, high)
                    items, spans = [before[0][i] for i in rows], [before[1][i] for i in rows]
                    doc = np.searchsorted(w.first, begin, side="right") - 1
                    order = np.argsort(doc, kind="stable")
                    for some in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else ():
                        d = int(doc[some[0]])
                        items[d] = sorted({*items[d], *(index.items[i] for i in np.unique(index.item[window[some]]))})
                        spans[d] = merged([*zip(spans[d][::2], spans[d][1::2], strict=True), *zip((begin[some] - w.first[d]).tolist(), (end[some] - w.first[d]).tolist(), strict=True)])
                    held_rows = batch.slice(part.start, len(rows))
                    new = {own["n_words"]: pa.array(w.counts.astype(np.int64)), own["items"]: pa.array(items, type=pa.list_(pa.string())), own["spans"]: pa.array(spans, type=pa.list_(pa.int64()))}
                    yield pa.RecordBatch.from_arrays([new.get(x, held_rows.column(i)) for i, x in enumerate(held_rows.schema.names)], names=held_rows.schema.names)

        return source.mapInArrow(run, schema)

    for block in blocks_of(benchmark, item, item_text, size, block_windows):
        if blocks:
            out = cut(out, "hits")
        counts = word_counts(docs, text, np.unique(np.concatenate([run for _, run in block])))
        out, blocks = marked(out, Index(block, counts)), blocks + 1
    if not blocks:
        out = marked(out, Index([], {}))
    return out


def n_hit() -> Column:
    """Words in the hit stretches of a row of matched()."""
    signed = F.transform("hushframe_spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated() -> Column:
    """Whether at least a twentieth of a row's words is hit."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("hushframe_n_words"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no benchmark window occurs; columns as they were.

    One window is enough for a document to go, whatever share of its words that is
    (contaminated() is the milder flag), so that none is left in what stays.
    """
    kept = [F.col(f"`{x}`") for x in docs.columns]
    own = ("hushframe_n_words", "hushframe_items", "hushframe_spans")
    # Columns of the same names as matched() adds are put aside.
    aside = docs.withColumnsRenamed({x: f"hushframe_aside_{x}" for x in docs.columns if x in own})
    clean = matched(aside, benchmark, **options).where(F.size("hushframe_spans") == 0).select([F.col(f"`{x}`") for x in aside.columns])
    return clean.withColumnsRenamed({f"hushframe_aside_{x}": x for x in own}).select(kept)


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Stretches that overlap or touch, as one; flat."""
    out: list[int] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [begin, end]
    return out


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """For every document its words, those inside benchmark windows, the items found and the flag."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = matched(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.col("hushframe_items")
    return found.select("doc_id", F.col("hushframe_n_words").alias("n_words"), n_hit().alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))
