"""Quality rules kept as a ledger of bits.

Every rule is evaluated once for each text.  A failure sets the rule's bit, and
what was measured is kept beside it, so that a policy (a named, versioned set of
bits) can be applied, changed or compared later without reading a text again.
Ablations (what a rule alone rejects, what a policy would keep without it) are
sums over the bits.

Defined results: a null or empty text has no words, all measurements are 0 and
the ``short`` rule fails.  Repeated rows get equal ledgers, an empty table gives
an empty ledger, and columns of the input other than the key and the text are
not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.llm.textbytes import SPACED, as_bytes, byte_class, chunks, mix, per_text, releasing, windows, words


@dataclass(frozen=True)
class Rule:
    """It fails where ``over`` is greater than most, or least greater than it; both are ratios of measurements."""

    name: str
    part: str
    whole: str | None = None
    least: float = 0.0
    most: float = float("inf")

    def fails(self, m: dict[str, np.ndarray]) -> np.ndarray:
        whole = m[self.whole] if self.whole else 1
        return (m[self.part] < self.least * whole) | (m[self.part] > self.most * whole if self.most != float("inf") else False)


#: A rule's place in this list is its bit; rules are only ever appended.
RULES = (
    Rule("short", "n_words", least=50),
    Rule("repeated_words", "n_repeat_words", "n_words", most=0.5),
    Rule("short_words", "word_chars", "n_words", least=2.0),
    Rule("long_words", "word_chars", "n_words", most=14.0),
    Rule("symbols", "n_symbols", "n_words", most=0.3),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=0.5),
    Rule("upper_case", "n_upper", "word_chars", most=0.6),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", most=0.5),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[x] for x in set(self.rules))


BASE = Policy("base", 1, ("short", "repeated_words"))
POLICIES = {
    ("web", 1): Policy("web", 1, ("short", "repeated_words", "symbols", "duplicate_lines")),
    ("web", 2): Policy("web", 2, tuple(rule.name for rule in RULES)),
}
DEFAULT = POLICIES["web", 2]

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_ellipsis_lines")

_SYMBOL = byte_class(b"#*$%&|<>")
_UPPER = byte_class(bytes(range(0x41, 0x5B)))
_CONTINUES = byte_class(bytes(range(0x80, 0xC0)))


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """All measurements of each text, over the whole text."""
    made: list = []
    w = words(texts, SPACED, ranges=made)
    hashes, doc = made[0], w.doc_of_word()
    sums = lambda table: np.concatenate(([0], np.cumsum(table[w.buf], dtype=np.int64)))
    within = lambda total: total[w.text_end] - total[w.text_start]
    leads = sums(~_CONTINUES)
    out = {"n_words": w.counts, "word_chars": per_text(leads[w.end] - leads[w.start], w), "n_symbols": within(sums(_SYMBOL)), "n_upper": within(sums(_UPPER))}

    # Lines with a word. A text's lines end at its \n and at its end, where the buffer has a \n too.
    stop = np.flatnonzero(w.buf == 0x0A)
    begin = np.concatenate(([0], stop[:-1] + 1))
    seen = np.searchsorted(w.start, np.concatenate((begin, [len(w.buf)])))
    full = np.flatnonzero(np.diff(seen) > 0)
    line_doc = np.searchsorted(w.text_start, begin[full], side="right") - 1
    n = len(texts)
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    own = mix(hashes.of(begin[full], stop[full]) ^ mix(line_doc.astype(np.uint64) + np.uint64(1)))
    _, firsts = np.unique(own, return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_doc[firsts], minlength=n)
    last_word_end = w.end[seen[full + 1] - 1]
    dots = (w.buf[last_word_end - 1] == 0x2E) & (w.buf[np.maximum(last_word_end - 2, 0)] == 0x2E) & (w.buf[np.maximum(last_word_end - 3, 0)] == 0x2E)
    out["n_ellipsis_lines"] = np.bincount(line_doc[dots], minlength=n)

    # Words in a three-word window that its text has twice or more.
    rolled, at = windows(w, 3)
    key = mix(rolled ^ mix(doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(w.hash), dtype=bool)
    for j in range(3):
        hit[at[twice] + j] = True
    out["n_repeat_words"] = per_text(hit, w)
    return out


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: the key, all measurements (long) and fail_bits (long)."""
    kept = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = as_bytes(batch.column(1)), batch.column(0)
            for part in chunks(texts):
                m = {k: v.astype(np.int64) for k, v in measure(texts[part]).items()}
                bits = sum((rule.fails(m).astype(np.int64) << i for i, rule in enumerate(RULES)), np.zeros(part.stop - part.start, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([keys.slice(part.start, part.stop - part.start), *(pa.array(m[x]) for x in MEASURES), pa.array(bits)], names=["k", *MEASURES, "fail_bits"])

    long = T.StructType.fromDDL(", ".join(f"{x} long" for x in (*MEASURES, "fail_bits"))).fields
    return kept.mapInArrow(run, T.StructType([kept.schema["k"], *long])).toDF(key, *MEASURES, "fail_bits")


def passes(policy: Policy, bits: str = "fail_bits") -> Column:
    """Whether a ledger row passes a policy."""
    return F.col(bits).bitwiseAND(F.lit(policy.mask)) == 0


def ablations(rows: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """One row for each rule of a policy: what it rejects, what only it rejects, and what the policy keeps without it.

    Sums over bits with map-side combining; no text is read.  An empty ledger gives zeros.
    """
    held = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    names = [rule.name for rule in RULES if rule.name in policy.rules]
    count = lambda test: F.coalesce(F.count_if(test), F.lit(0))
    sums = rows.select(held.alias("b")).agg(count(F.col("b") == 0).alias("kept"), *(x for name in names for x in (count(F.col("b").bitwiseAND(F.lit(BIT[name])) != 0).alias(f"r_{name}"), count(F.col("b") == BIT[name]).alias(f"o_{name}"))))
    pieces = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"r_{name}").alias("rejected"), F.col(f"o_{name}").alias("only"), (F.col("kept") + F.col(f"o_{name}")).alias("kept_without")) for name in names))
    return sums.select(F.inline(pieces)).withColumns({"policy": F.lit(policy.name), "version": F.lit(policy.version)})


def quality_ablations(spark, sf_dir: str) -> DataFrame:
    """What each rule of the default policy rejects of all documents, alone and beside the others."""
    return ablations(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document's measurements, the base verdict and the default policy's."""
    rows = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = ~passes(BASE)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & passes(DEFAULT)).alias("kept"), "fail_bits")
