"""Quality rules (5) and the quality classifier (6)."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.llm import quality_model as M
from hushframe.llm import quality_rules as R

DOCS = "doc_id long, text string"
TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "a b c a b c a b c " * 30,
    "word " * 49,
    "The cat sat on the mat.\n" * 3 + "The dog ran.\n\n  \nThe dog ran.",
    "x" * 5000,
    "### $$$ | <b> ünï cödé &&& 日本語 \u2028 wörd " * 20,
    "A B!! C!! " * 40,
    "wait...\nso...\nand ...\nno " + " ".join(f"w{i}" for i in range(60)),
    " ".join(f"word{i}" for i in range(3000)),
    "\x0b\x0cform\x0bfeed\x1cnot\x1dsplit",
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines, seen, dup = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))


def test_measures_against_brute_force(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), DOCS)
    got = {r.doc_id: r for r in R.ledger(rows).collect()}
    for i, text in enumerate(TEXTS):
        r = got[i]
        want = brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text and text[:40]
        assert bool(r.fail_bits & R.BIT["short"]) == (want[0] < 50)
        assert bool(r.fail_bits & R.BIT["repeated_words"]) == (100 * want[4] > 50 * want[0])


def test_whole_table_against_brute_force(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    for r in R.op5_quality_rules(spark, sf_dir).collect():
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_clean_documents_are_kept(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    rows = R.op5_quality_rules(spark, sf_dir).join(labels, "doc_id").where("not base_failed")
    assert rows.where("kept").count() == rows.count() > 0


def test_policies_and_ablations(spark):
    bits = [0, 0, R.BIT["short"], R.BIT["short"] | R.BIT["symbols"], R.BIT["symbols"], R.BIT["upper_case"]]
    rows = spark.createDataFrame([(b,) for b in bits], "fail_bits long")
    v1, v2 = R.POLICIES["web", 1], R.POLICIES["web", 2]
    assert rows.where(R.passes(v1)).count() == 3 and rows.where(R.passes(v2)).count() == 2
    out = {r.rule: (r.rejected, r.only, r.kept_without) for r in R.ablations(rows, v1).collect()}
    assert out["short"] == (2, 1, 4) and out["symbols"] == (2, 1, 4) and out["repeated_words"] == (0, 0, 3)
    # What is kept without a rule is what the policy without it keeps.
    for rule in v1.rules:
        less = R.Policy("x", 1, tuple(x for x in v1.rules if x != rule))
        assert out[rule][2] == rows.where(R.passes(less)).count()
    assert all(r.rejected == 0 for r in R.ablations(rows.limit(0)).collect())


def test_odd_tables(spark):
    rows = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None)], "doc_id long, text string, n_words string")
    assert R.ledger(rows).count() == 3
    assert R.ledger(rows.limit(0)).collect() == []


def separable(n):
    good = [(i, " ".join(f"the word{(i * 7 + j) % 50} is fine," for j in range(40))) for i in range(n)]
    bad = [(n + i, " ".join(f"tok{(i * 5 + j) % 50}### %%%" for j in range(60))) for i in range(n)]
    return good + bad


def test_classifier_learns_and_holds_out(spark):
    rows = separable(60)
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i < 60)) for i, _ in rows], "doc_id long, quality int")
    scored = M.scored(docs, *M.learn(docs, labels)).withColumn("held_out", M.held_out()).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    assert all((r.hushframe_score >= 0.5) == (r.doc_id < 60) for r in scored if r.held_out)
    # Labels of the held-out fold are never read.
    flipped = labels.withColumn("quality", F.when(M.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = M.scored(docs, *M.learn(docs, flipped)).collect()
    assert {r.doc_id: r.hushframe_score for r in again} == {r.doc_id: r.hushframe_score for r in scored}


def test_held_out_accuracy_on_the_corpus(spark, sf_dir):
    top = sf_dir.replace("sf0.001", "sf0.01")
    out = M.op6_quality_classifier(spark, top).join(spark.read.parquet(f"{top}/labels.parquet"), "doc_id").where("held_out")
    total, right = out.count(), out.where("predicted = quality").count()
    assert total > 50 and right / total > 0.95


def test_scores_of_odd_texts_and_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a b c"), (3, "x" * 100_000)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.hushframe_score for r in M.scored(docs, *M.learn(docs, none)).collect()} == {0.5}
    odd = spark.createDataFrame([(1, None), (None, 1), (77, 1), (3, 1)], "doc_id long, quality int")
    out = M.scored(docs, *M.learn(docs, odd)).collect()
    assert len(out) == 5 and all(0 <= r.hushframe_score <= 1 for r in out)
    assert M.scored(docs.limit(0), *M.learn(docs.limit(0), none)).collect() == []


def test_context_vectors_against_brute_force():
    text = "a b, a c\n"
    total = np.zeros(M.BUCKETS * M.DIM, dtype=np.int64)
    M.contexts([text.encode(), b"", b"a"], total)
    tokens = ["a", "b", ",", "a", "c"]
    w = M.words([t.encode() for t in tokens], M.KINDS)
    want = np.zeros((M.BUCKETS, M.DIM), dtype=np.int64)
    for i in range(5):
        for j in range(5):
            if 0 < abs(i - j) <= M.REACH:
                for k in range(M.SIGNS):
                    own = int(M.mix(w.hash[j : j + 1] ^ np.uint64(0xA5A5 + k))[0])
                    want[int(w.hash[i]) % M.BUCKETS, (own >> 8) % M.DIM] += 1 if own & 1 else -1
    assert (total.reshape(M.BUCKETS, M.DIM) == want).all()


@pytest.mark.parametrize("share", [0, 1])
def test_one_class_only(share):
    net = M.fit(np.zeros((10, 3)), np.full(10, share))
    assert abs(net.scores(np.zeros((1, 3)))[0] - share) < 1e-5


def test_pools_against_plain_loops():
    from hushframe.llm.quality_model import BUCKETS, DIM, KINDS, POOLS, buckets_of, features
    from hushframe.llm.textbytes import words

    table = np.random.default_rng(1).normal(size=(BUCKETS, DIM)).astype(np.float32)
    texts = [b"one two two three", b"", b" \n", b"x", "é, é!! b".encode()]
    got = features(texts, table)
    assert got.shape == (5, POOLS * DIM) and not got[1].any() and not got[2].any()
    for row, text in zip(got, texts, strict=True):
        v = table[buckets_of(words([text], KINDS).hash)].astype(float)
        if len(v):
            want = np.concatenate((v.mean(axis=0), v.std(axis=0), (v[:-1] * v[1:]).sum(axis=0) / len(v)))
            assert np.allclose(row, want, atol=1e-6)


def test_quality_of_odd_tables(spark):
    from hushframe.llm.quality_model import good_documents

    docs = spark.createDataFrame([(i, "some good words here" if i % 2 else "bad bad bad bad", "s", 1.0) for i in range(40)] + [(None, None, None, None), (99, "", "", 0.0)], "doc_id long, text string, `a.b` string, hushframe_score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (5, None)], "doc_id long, quality int")
    out = good_documents(docs, labels)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} >= {i for i in range(40) if i % 2}
    assert good_documents(docs.limit(0), labels).collect() == [] and good_documents(docs, labels.limit(0)).count() == docs.count()


def test_sample_is_ordered_without_objects():
    import tracemalloc

    import pyarrow as pa

    n, width = 20_000, M.POOLS * M.DIM
    rng = np.random.default_rng(3)
    values = rng.integers(-1, 2, (n, width)) / 2
    order, label = rng.integers(0, 50, n), rng.integers(0, 2, n).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))
    table = pa.table({"order": order, "label": label, "x": lists})
    table = pa.concat_tables([table.slice(0, 7_000), table.slice(7_000)])
    tracemalloc.start()
    x, y = M.ordered(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = sorted(zip(order.tolist(), label.tolist(), values.tolist(), strict=True))
    assert x.tolist() == [w[2] for w in want] and y.tolist() == [w[1] for w in want] and y.dtype == np.int64
    # One copy, and what sorting takes; as lists of floats the same rows are over 60 MB more.
    assert peak < 2.5 * values.nbytes
    x, y = M.ordered(table.slice(0, 0))
    assert x.shape == (0, width) and y.shape == (0,)
