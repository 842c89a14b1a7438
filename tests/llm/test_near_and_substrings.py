"""Near-duplicates (4), repeated passages (10) and benchmark passages (9)."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushframe.llm import decontaminate as D
from hushframe.llm import order_minhash as O
from hushframe.llm import substring_dedup as S
from hushframe.llm.components import components
from hushframe.llm.textbytes import SPACED, words

DOCS = "doc_id long, text string"


def prose(seed, n):
    r = random.Random(seed)
    return [f"{r.choice('bcdfglmnprst')}{r.choice('aeiou')}{r.choice('bcdfglmnprst')}{r.choice('aeiou')}{r.randrange(90)}" for _ in range(n)]


def edited(tokens, seed, k):
    r, out = random.Random(seed), list(tokens)
    for _ in range(k):
        out[r.randrange(len(out))] = f"edit{r.randrange(10**6)}"
    return out


def shingles(tokens):
    return [tuple(tokens[i : i + 5]) for i in range(len(tokens) - 4)] or ([tuple(tokens)] if tokens else [])


def similarity(a, b):
    """By a plain longest common subsequence."""
    x, y = shingles(a), shingles(b)
    if not x or not y:
        return 0.0
    row = [0] * (len(y) + 1)
    for u in x:
        old = 0
        for j, v in enumerate(y):
            old, row[j + 1] = row[j + 1], old + 1 if u == v else max(row[j + 1], row[j])
    return row[-1] / (len(x) + len(y) - row[-1])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_alignment_is_exact(a, b):
    row = [0] * (len(b) + 1)
    for u in a:
        old = 0
        for j, v in enumerate(b):
            old, row[j + 1] = row[j + 1], old + 1 if u == v else max(row[j + 1], row[j])
    n = row[-1]
    want = bool(a) and bool(b) and n / (len(a) + len(b) - n) >= 0.8
    assert O.aligned(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)) == want


def test_sketch_follows_order_and_repeats():
    tokens = prose(1, 300)
    one = O.sketches([" ".join(tokens).encode()])[2][0]
    same = O.sketches([("  ".join(tokens) + "\n").upper().encode()])[2][0]
    assert (one == same).all()
    turned = O.sketches([" ".join(tokens[150:] + tokens[:150]).encode()])[2][0]
    near = O.sketches([" ".join(edited(tokens, 2, 3)).encode()])[2][0]
    assert (one == near).sum() > (one == turned).sum()
    assert len(O.sketches([b"", b" \n"])[0]) == 0 and len(O.sketches([b"a b", b""])[0]) == 1


def corpus():
    rows, texts = [], {}
    for g in range(12):
        base = prose(g, 120 + 40 * g)
        for k in range(8):
            texts[len(texts)] = edited(base, 100 * g + k, k if g % 2 else 2 * k)
    for g in range(30):
        texts[len(texts)] = prose(1000 + g, 80)
    # Texts that share a long passage but are not alike.
    passage = prose(5000, 60)
    for g in range(20):
        texts[len(texts)] = passage + prose(6000 + g, 40)
    for i, t in texts.items():
        rows.append((i, " ".join(t)))
    return rows, texts


def test_classes_against_brute_force(spark):
    rows, texts = corpus()
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1002, None), (1003, ""), (1004, "too short"), (1005, "too short"), (1006, "to short")]
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    said = {i: (t or "").split() for i, t in rows}
    for i in said:
        for j in said:
            if j < i and (said[i] == said[j] or abs(len(said[i]) - len(said[j])) < 60 and similarity(said[i], said[j]) >= 0.8):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r.doc_id: r.hushframe_class for r in O.classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: find(i) for i in parent}
    kept = {r.doc_id for r in O.one_of_each(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == set(got.values())


def test_links_inside_a_family_of_form_letters(spark):
    """Letters of one form are no links (0.73); each has an edited copy that is one, which no head of a shared bucket may hide."""
    form = prose(5, 400)
    letters = [[*form, *prose(1000 + i, 62)] for i in range(150)]
    texts = [" ".join(x) for i, letter in enumerate(letters) for x in (letter, edited(letter, 9000 + i, 5))]
    assert similarity(letters[0], letters[1]) < 0.8 <= similarity(letters[0], edited(letters[0], 9000, 5))
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: r.hushframe_class for r in O.classes(docs).collect()}
    assert [i for i in range(0, 300, 2) if got[i] != got[i + 1]] == []
    assert len(set(got.values())) == 150


def test_blocks_compare_all_pairs_of_classes(spark):
    """Rows of few tokens, dealt into many blocks, against plain loops."""
    r = random.Random(3)
    values = [(i, r.choice((100, 110, 120)), [r.randrange(3) for _ in range(O.SKETCHES)]) for i in range(160)]
    table = spark.createDataFrame(values, "node long, n long, sketch array<long>")
    root = {i: 0 if i < 50 else i - i % 4 for i in range(160)}
    roots = spark.createDataFrame([(i, x) for i, x in root.items() if i != x], "node long, root long")
    rows = [(i, t, r.randrange(int(0.8 * n), n + 1)) for i, n, _ in values for t in (1, 2)]
    got = O.meeting(spark.createDataFrame(rows, "node long, token long, reach int"), roots, table, size=7).distinct().collect()
    reach = {(i, t): x for i, t, x in rows}
    want = {(a, b) for a, n, s in values for b, m, t in values if a < b and root[a] != root[b] and sum(x == y for x, y in zip(s, t, strict=True)) >= O.SHARED and any(min(reach[a, k], reach[b, k]) >= 0.8 * (n + m) / 1.8 - 1e-6 for k in (1, 2))}
    assert {(x.a, x.b) for x in got} == want and len(got) == len(want) > 100
    assert all({x.ra, x.rb} == {root[x.a], root[x.b]} for x in got)


def test_alike_texts_meet_at_a_rare_token(spark):
    """Two token lists with enough in common share a row of prefixes() behind which there is enough, whatever else is in the table."""
    r = random.Random(11)
    lists = []
    for g in range(40):
        base = [r.randrange(10**9) if r.random() < 0.3 else r.randrange(60) + 10**10 for _ in range(r.randrange(5, 60))]
        for _ in range(4):
            lists.append(sorted({x if r.random() < 0.93 else r.randrange(10**9) for x in base}))
    rows = spark.createDataFrame(list(enumerate(lists)), "node long, tokens array<long>")
    places = defaultdict(dict)
    for x in O.prefixes(rows).collect():
        places[x.node][x.token] = x.reach
    alike = 0
    for i, a in enumerate(lists):
        for j, b in enumerate(lists[:i]):
            need = 0.8 * (len(a) + len(b)) / 1.8 - 1e-6
            if len({*a} & {*b}) >= need:
                alike += 1
                assert any(min(places[i][t], places[j][t]) >= need for t in places[i].keys() & places[j].keys())
    assert alike > 50


def test_spread_join_is_a_join(spark):
    from hushframe.llm.shared import cut, spread_join

    rows = spark.range(2000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7L ELSE id % 50 END AS k")
    table = cut(rows.where("k < 40").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m")), "t")
    for how in ("inner", "left"):
        want = sorted(map(tuple, rows.join(table, "k", how).select("id", "k", "n", "m").collect()))
        got = spread_join(rows, table, "k", "n", how, most=20)
        assert got.columns == ["id", "k", "n", "m"] and sorted(map(tuple, got.collect())) == want
    assert spread_join(rows, cut(table.limit(0), "none"), "k", "n").collect() == []


def test_near_duplicate_odd_tables(spark):
    schema = "doc_id long, text string, hushframe_class string, `a.b` int, root string"
    rows = [(1, "a b c d e f", "x", 1, "r")] * 3 + [(None, "a b c d e f", "x", 1, "r"), (None, "zz", None, None, None), (2, "other words are in here", None, None, None), (2, "a b c d e f", "y", 2, "s")]
    docs = spark.createDataFrame(rows, schema)
    out = O.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in out.collect()) == [(-1, "zz"), (1, "a b c d e f"), (2, "other words are in here")]
    assert O.one_of_each(docs.limit(0)).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (None, 3)]
    out = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 200)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_tables_in_the_shared_folder(spark):
    from hushframe.llm.shared import clean, cut, drop

    one, two = cut(spark.range(5), "one"), cut(spark.range(0), "two")
    assert one.count() == 5 and two.count() == 0 and all("/hushframe/" in f for f in one.inputFiles())
    drop(one, two)
    three = cut(spark.range(3), "three")
    clean(spark)
    with pytest.raises(Exception, match="(?i)not.*exist|FileNotFound|FILE_NOT_EXIST"):
        spark.read.schema("id long").parquet(three.inputFiles()[0]).count()


def test_the_driver_gives_memory_back(spark, monkeypatch):
    from hushframe.llm import quality_model, shared

    # The JVM of these tests has the command: its freed memory goes back, and Python's.
    assert shared.release(spark)
    asked = []
    monkeypatch.setattr(shared, "release", asked.append)
    monkeypatch.setattr(quality_model, "release", asked.append)
    assert shared.cut(spark.range(3), "three").count() == 3 and len(asked) == 1
    quality_model.learn(spark.createDataFrame([(1, "a b"), (2, "c d")], DOCS), spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int"))
    assert len(asked) == 2


def test_chunks_resist_insertions():
    tokens = prose(3, 2000)
    one = S.Chunks([" ".join(tokens).encode()])
    two = S.Chunks([" ".join([*tokens[:500], "new", "words", *tokens[500:]]).encode()])
    assert len(set(one.digest.tolist()) - set(two.digest.tolist())) <= 8
    sizes = one.last - one.first + 1
    assert sizes[:-1].min() > S.REACH and 4 < sizes.mean() < 7 and sizes.max() <= S.MOST
    same = S.Chunks([b"", b"the " * 100, b"a"])
    assert (same.last - same.first + 1).tolist() == [12] * 8 + [4, 1]


def test_gear_hash_against_the_loop():
    text = np.frombuffer(b"some text with bytes \xc3\xa9", dtype=np.uint8)
    h, want = 0, []
    for b in text:
        h = ((h << 1) + int(S._GEAR[b])) & 0xFFFF
        want.append(h)
    assert S.gear(text).tolist() == want


def test_passages_are_cut_out(spark):
    passage, other = prose(1, 60), prose(2, 55)
    clean = {i: prose(100 + i, 200) for i in range(6)}
    texts = {
        1: clean[0] + passage + clean[1],
        2: clean[2] + passage + clean[3] + other,
        3: passage + clean[4],
        4: clean[5],
        5: other + prose(200, 100) + other,
    }
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], DOCS)
    out = {r.doc_id: r for r in S.dedup(docs).collect()}
    assert out[1].text == " ".join(texts[1]) and out[4].text == " ".join(texts[4])
    for i in (2, 3):
        assert " ".join(passage) not in out[i].text
        left = out[i].text.split()
        assert len([w for w in left if w in set(passage)]) <= 20
        assert [w for w in left if w not in set(passage)] == [w for w in texts[i] if w not in set(passage)]
    # The first copy in the smallest doc_id stays; a second one in the same text goes.
    assert out[2].text.split()[-55:] == other and len(out[5].text.split()) <= 100 + 2 * 20
    for i, r in out.items():
        raw = " ".join(texts[i]).encode()
        assert S.without(raw, [(x.start, x.end) for x in r.hushframe_spans]).decode() == r.text


def test_substring_brute_force(spark, sf_dir):
    """What is removed is in a smaller document or ahead in its own; what has no triple of chunks in common stays."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    digests = defaultdict(set)
    for r in rows:
        for d in S.Chunks([r.text.encode()]).digest.tolist():
            digests[d].add(r.doc_id)
    for r in S.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect():
        raw = next(x.text for x in rows if x.doc_id == r.doc_id)
        c, seen = S.Chunks([raw.encode()]), set()
        ahead = []
        for d in c.digest.tolist():
            ahead.append(d in seen or min(digests[d]) < r.doc_id)
            seen.add(d)
        want = c.repeated(np.array(ahead, dtype=bool))[0]
        assert [(x.start, x.end) for x in r.hushframe_spans] == want


def test_passages_against_plain_search(spark):
    """Passages of 51 to 90 words put between words of their own, against a plain search of the texts."""
    r = random.Random(5)
    passages = [" ".join(prose(700 + i, r.randrange(51, 91))) for i in range(60)]
    texts = {}
    for i, p in enumerate(passages):
        for copy in range(2 + i % 3):
            texts[len(texts)] = " ".join([*prose(10_000 + 10 * i + copy, r.randrange(5, 80)), p, *prose(20_000 + 10 * i + copy, r.randrange(5, 80))])
    clean = {len(texts) + i: " ".join(prose(50_000 + i, 120)) for i in range(40)}
    out = {x.doc_id: x for x in S.dedup(spark.createDataFrame(list((texts | clean).items()), DOCS)).collect()}
    for i, text in (texts | clean).items():
        earlier = [p for p in passages if p in text and any(p in texts[j] for j in texts if j < i)]
        assert bool(out[i].hushframe_spans) == bool(earlier)
        for a, b in ((x.start, x.end) for x in out[i].hushframe_spans):
            # Each removed stretch is, word for word, part of a text with a smaller id.
            piece = text.encode()[a:b].decode()
            assert any(piece in t for j, t in texts.items() if j < i)
        for p in earlier:
            assert p not in out[i].text and len(p.split()) - sum(len(text.encode()[x.start : x.end].split()) for x in out[i].hushframe_spans) <= 20
        if not earlier:
            assert out[i].text == text


def test_substring_odd_tables(spark):
    same = " ".join(prose(9, 100))
    rows = [(1, same, "a"), (1, same, "b"), (None, same, "c"), (None, None, None), (2, "", "d"), (3, "ü" * 3000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    out = S.dedup(docs)
    assert out.columns == [*docs.columns, "hushframe_spans"]
    got = {r.digest: r.text for r in out.collect()}
    assert got["a"] == same and got["b"] == same and len(got["c"]) < 60 and got[None] is None and got["d"] == "" and got["e"] == "ü" * 3000
    assert S.dedup(docs.limit(0)).collect() == []
    # Keys of any type, columns with dots, and one named like what is added.
    named = spark.createDataFrame([("b", same, 1, 7), ("a", same, 2, 8), (None, same, 3, 9)], "`doc.id` string, `a.b` string, hf_order int, hushframe_spans int")
    out = S.dedup(named, key="doc.id", text="a.b")
    assert out.columns == ["doc.id", "a.b", "hf_order", "hushframe_spans"]
    assert {r[0]: r[1] == same for r in out.collect()} == {"a": True, "b": False, None: False}


def brute_hits(docs, items, size=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for i, text in docs:
        w, hit, names = find(text), set(), set()
        for item, body in items:
            run = find(body)
            for k in range(max(1, len(run) - size + 1)) if run else ():
                part = run[k : k + size]
                for at in range(len(w) - len(part) + 1):
                    if w[at : at + len(part)] == part:
                        hit |= set(range(at, at + len(part)))
                        names.add(str(item))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def as_rows(found):
    import hashlib as h

    return sorted(((r.doc_id, r.hushframe_n_words, sum(b - a for a, b in zip(r.hushframe_spans[::2], r.hushframe_spans[1::2], strict=True)), len(r.hushframe_items), h.sha256(",".join(r.hushframe_items).encode()).hexdigest(), bool(r.bad)) for r in found.withColumn("bad", D.contaminated()).collect()), key=repr)


@pytest.mark.parametrize("block", [D.BLOCK_WINDOWS, 3])
def test_contamination_against_brute_force(spark, block):
    items = [(1, " ".join(prose(1, 40))), (2, "Short Item, here"), (3, " ".join(prose(3, 13))), (10, "a a a a a a a a a a a a a a"), (4, ""), (5, None), (6, "--- !!")]
    docs = [
        (1, " ".join(prose(50, 100) + prose(1, 40)[5:30] + prose(51, 20))),
        (2, "nothing " * 30 + "SHORT item... HERE" + " and more" * 40),
        (3, " ".join(prose(3, 13)[:12])),
        (4, " ".join(prose(3, 13)).upper()),
        (5, "a " * 30),
        (6, None),
        (7, ""),
        (8, "short item"),
        (8, "short item"),
        (9, "É short item here ü"),
    ]
    found = D.matched(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), block_windows=block)
    assert as_rows(found) == brute_hits(docs, items)


def test_contamination_on_the_corpus(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = brute_hits([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])
    got = sorted((tuple(r) for r in D.op9_decontaminate(spark, sf_dir).collect()), key=repr)
    assert got == want


def test_contamination_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 2)], "doc_id long, text string, items string, n_words int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.clean_documents(docs, none).collect() == docs.collect()
    assert D.clean_documents(docs.limit(0), none).collect() == []
    assert D.clean_documents(docs, spark.createDataFrame([(1, "B c")], "item_id long, text string")).collect() == []
    # One window is enough, and columns named like those that are added stay.
    wide = spark.createDataFrame([(1, "b c " + "w " * 500, "x", 2), (2, "b d " * 9, "y", 3)], "doc_id long, text string, hushframe_items string, hushframe_n_words int")
    assert D.clean_documents(wide, spark.createDataFrame([(1, "B c")], "item_id long, text string")).collect() == wide.where("doc_id = 2").collect()


def test_word_hashes_tell_words_apart():
    text = "a b ab ba a\u0301 aa aaa  a\n\nb"
    w = words([text.encode(), b"", text.encode()], SPACED)
    said = text.split() * 2
    assert [w.buf[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)] == said
    assert len(set(zip(w.hash.tolist(), said, strict=True))) == len(set(said)) == len(set(w.hash.tolist()))
    assert w.first.tolist() == [0, 9, 9, 18]
