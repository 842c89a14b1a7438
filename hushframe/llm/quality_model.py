"""Quality classifier: random-indexing word vectors, a two-layer network, a temperature.

Random indexing.  A token (a run of letters and digits, or of other marks) has a
fixed sparse index vector of ``SIGNS`` signed entries in ``DIM``, taken from its hash.
Its context vector is the sum of the index vectors of its neighbours, ``REACH`` on
either side, over all texts.  Context vectors are kept for ``BUCKETS`` hash buckets, so
the table has a fixed size whatever the vocabulary; counts are integers, summed per
task and then by Spark, and exact.

A document is pooled from its tokens' normalised context vectors, component by component:
their mean, their standard deviation, and the mean of the products of adjacent tokens
(which is high where words repeat or keep to one context).  Nothing else enters: no
lengths, no counts.  A network of one hidden layer scores it.  It is fitted
on at most ``SAMPLE`` labelled rows (those of the smallest hashes of their ids) with
a part of these set aside for the temperature, which makes scores probabilities.

Labels, languages, sources and ids are never inputs of a score.

Defined results: null and empty texts have all-zero vectors and are scored like any
other; labels that are null, or without a document, are not used; a document with
several labels counts once for each; a column named like the one that is added is
replaced by scored() and kept by good_documents(); with no labels, or one class only, all scores are
the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.llm.shared import release
from hushframe.llm.textbytes import as_bytes, byte_class, chunks, mix, releasing, words

DIM = 32
BUCKETS = 1 << 14
SIGNS = 2
REACH = 2
SAMPLE = 20_000
HIDDEN = 32
KEPT_AT = 0.3
#: Pools of a document: mean, standard deviation, products of neighbours.
POOLS = 3

_LETTER = byte_class(bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))
_SPACE = byte_class(bytes(range(0x00, 0x21)))
#: 0 white space and controls, 1 letters and digits, 2 other marks.
KINDS = np.where(_SPACE, 0, np.where(_LETTER, 1, 2)).astype(np.int8)


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def contexts(texts: list[bytes], total: np.ndarray) -> None:
    """Add the context vectors of all tokens of the texts to total, int64[BUCKETS * DIM]."""
    w = words(texts, KINDS)
    bucket, n = buckets_of(w.hash), len(w.hash)
    doc = w.doc_of_word()
    at, sign = [], []
    for k in range(SIGNS):
        own = mix(w.hash ^ np.uint64(0xA5A5 + k))
        place = ((own >> np.uint64(8)) % np.uint64(DIM)).astype(np.int64)
        plus = (own & np.uint64(1)).astype(bool)
        for step in range(1, REACH + 1):
            if n <= step:
                continue
            inside = doc[step:] == doc[:-step]
            for near, far in ((slice(None, -step), slice(step, None)), (slice(step, None), slice(None, -step))):
                at.append((bucket[near] * DIM + place[far])[inside])
                sign.append(plus[far][inside])
    if at:
        cells, plus = np.concatenate(at), np.concatenate(sign)
        total += np.bincount(cells[plus], minlength=len(total))
        total -= np.bincount(cells[~plus], minlength=len(total))


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The normalised context vectors float32[BUCKETS, DIM], from all texts; at most BUCKETS rows reach the driver."""
    columns = [f"c{i}" for i in range(DIM)]

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIM, dtype=np.int64)
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for part in chunks(texts):
                contexts(texts[part], total)
        table = total.reshape(BUCKETS, DIM)
        some = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(table[some, i]) for i in range(DIM))], names=["bucket", *columns])

    rows = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "bucket long, " + ", ".join(f"{x} long" for x in columns))
    summed = rows.groupBy("bucket").agg(*(F.sum(x).alias(x) for x in columns)).toArrow()
    out = np.zeros((BUCKETS, DIM), dtype=np.float32)
    values = np.stack([summed.column(x).to_numpy() for x in columns], axis=1).astype(np.float64)
    out[summed.column("bucket").to_numpy()] = values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1.0)
    return out


def features(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """float64[texts, POOLS * DIM]; zeros for a text without tokens."""
    w = words(texts, KINDS)
    dim = vectors.shape[1]
    out = np.zeros((len(texts), POOLS * dim))
    full = np.flatnonzero(w.counts)
    if len(full):
        bucket, first, n = buckets_of(w.hash), w.first[full], w.counts[full]
        last = np.zeros(len(bucket), dtype=bool)
        last[w.first[full + 1] - 1] = True
        for i in range(dim):
            value = vectors[bucket, i].astype(np.float64)
            mean = np.add.reduceat(value, first) / n
            beside = np.append(value[:-1] * value[1:], 0.0)
            beside[last] = 0
            out[full, i] = mean
            out[full, dim + i] = np.sqrt(np.maximum(np.add.reduceat(value * value, first) / n - mean * mean, 0.0))
            out[full, 2 * dim + i] = np.add.reduceat(beside, first) / n
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def constant(share: float, width: int) -> Network:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))


def fit(x: np.ndarray, y: np.ndarray, *, epochs: int = 60, rate: float = 0.01, batch: int = 256, seed: int = 7) -> Network:
    """Adam on the cross-entropy of four fifths of the rows; the temperature minimises that of the rest."""
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5, x.shape[1])
    rng = np.random.default_rng(seed)
    aside = np.arange(len(y)) % 5 == 4
    net = Network(x.mean(axis=0), x.std(axis=0) + 1e-6, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    z, t = ((x - net.mean) / net.scale)[~aside], y[~aside].astype(float)
    state = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in ("w1", "b1", "w2", "b2")}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(t))
        for i in range(0, len(t), batch):
            rows = order[i : i + batch]
            hidden = np.tanh(z[rows] @ net.w1 + net.b1)
            error = (1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -40, 40))) - t[rows]) / len(rows)
            back = np.outer(error, net.w2) * (1 - hidden**2)
            step += 1
            for k, g in {"w1": z[rows].T @ back + 1e-4 * net.w1, "b1": back.sum(axis=0), "w2": hidden.T @ error + 1e-4 * net.w2, "b2": error.sum()}.items():
                m, v = state[k]
                m[...], v[...] = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                setattr(net, k, getattr(net, k) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
    if aside.any():
        logits, t = net.logits(x[aside]), y[aside]
        loss = lambda c: np.logaddexp(0, np.where(t == 1, -logits, logits) / c).mean()
        net.temperature = float(min(np.geomspace(0.25, 8, 101), key=loss))
    return net


def held_out(key: str = "doc_id") -> Column:
    """The fold whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 5 == 0, F.lit(False))


def ordered(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """x float64[rows, POOLS * DIM] and label int64[rows] of (order, label, x), sorted by all three; no number becomes an object of Python."""
    order, label = (rows.column(c).combine_chunks().to_numpy() for c in ("order", "label"))
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(order), POOLS * DIM)
    at = np.lexsort((*x.T[::-1], label, order))
    return x[at], label[at].astype(np.int64)


def learn(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors from all texts, and the network from a bounded sample of labelled rows outside the held-out fold."""
    vectors = word_vectors(docs, text)
    rows = labels.where(~held_out(key) & F.col(label).isNotNull() & F.col(f"`{key}`").isNotNull())
    rows = rows.select(F.col(f"`{key}`").alias("key"), F.col(label).cast("int").alias("label"), F.xxhash64(F.col(f"`{key}`")).alias("order"))
    chosen = rows.orderBy("order", "key", "label").limit(sample)
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    seen = docs.sparkSession.sparkContext.broadcast(vectors)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = as_bytes(batch.column(2))
            for part in chunks(held):
                x = features(held[part], seen.value)
                n = part.stop - part.start
                arrays = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, n), batch.column(1).slice(part.start, n), arrays], names=["order", "label", "x"])

    # At most ``sample`` rows of three numbers, so the chosen rows may be broadcast.
    got = texts.join(F.broadcast(chosen), "key").select("order", "label", "text").mapInArrow(run, "order long, label int, x array<double>").toArrow()
    network = fit(*ordered(got))
    del got
    release(docs.sparkSession)
    return vectors, network


def scored(docs: DataFrame, vectors: np.ndarray, network: Network, *, text: str = "text") -> DataFrame:
    """The documents' columns and hushframe_score double."""
    held = docs.sparkSession.sparkContext.broadcast((vectors, network))
    names = [x for x in docs.columns if x != "hushframe_score"]
    inner = docs.select(*(F.col(f"`{x}`").alias(f"hf_c{i}") for i, x in enumerate(names)))
    body = names.index(text)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = held.value
        for batch in batches:
            texts = as_bytes(batch.column(body))
            scores = [network.scores(features(texts[part], vectors)) for part in chunks(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.empty(0))], names=[*batch.schema.names, "hushframe_score"])

    return inner.mapInArrow(run, T.StructType([*inner.schema.fields, T.StructField("hushframe_score", T.DoubleType())])).toDF(*names, "hushframe_score")


def good_documents(docs: DataFrame, labels: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents that score at least KEPT_AT; columns as they were."""
    inner = {x: f"hf_d{i}" for i, x in enumerate(docs.columns)}
    out = scored(docs.toDF(*inner.values()), *learn(docs, labels, text=text, **options), text=inner[text])
    return out.where(F.col("hushframe_score") >= KEPT_AT).select(*inner.values()).toDF(*docs.columns)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document's score, and whether its label was held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    vectors, network = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    score = F.col("hushframe_score")
    # The text must reach the scoring, but not the result.
    return scored(docs, vectors, network).select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= KEPT_AT).cast("int").alias("predicted"))
