"""URL filters (1), sharding (2), HTML extraction (3), WARC (7) and SentencePiece (8), and the pipeline."""

import base64
import hashlib
import io
import math
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hushframe.llm import sentencepiece_codec as C
from hushframe.llm import sharding as H
from hushframe.llm import site_tree as T
from hushframe.llm import url_filter as U
from hushframe.llm import warc as A
from hushframe.llm.registry import ORACLE_SQL, QUERIES
from hushframe.llm.shared import cut

PAGES = "page_id long, url string, html string"


def brute_verdicts(rows):
    """The whole filter in plain Python."""

    def split(url):
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        n = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        tail = rest[n:]
        m = min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])
        return rest[:n].translate(str.maketrans(U._UPPER, U._LOWER)), tail[:m]

    def rule(host, path):
        fits = [r for r in U.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        return max(fits, key=len, default=None)

    seen, counts = [], {k: [defaultdict(Counter) for _ in range(U.ORDER + 1)] for k in ("allow", "block")}
    for page, url in rows:
        host, path = split(url)
        r = rule(host, path)
        aside = zlib.crc32((url or "").encode()) % 5 == 0
        s = [U.BEFORE] * U.ORDER + list(url or "")
        seen.append((page, host, path, r, s, aside))
        if r and not aside:
            for i in range(U.ORDER, len(s)):
                for k in range(U.ORDER + 1):
                    counts[U.RULES[r]][k][tuple(s[i - k : i])][s[i]] += 1

    def p(kind, k, context, x):
        low = 1 / U.CODE_POINTS if k == 0 else p(kind, k - 1, context[1:], x)
        c = counts[kind][k].get(context)
        return (c[x] + len(c) * low) / (sum(c.values()) + len(c)) if c else low

    def score(s):
        all_ = [math.log(p("allow", U.ORDER, tuple(s[i - U.ORDER : i]), s[i])) - math.log(p("block", U.ORDER, tuple(s[i - U.ORDER : i]), s[i])) for i in range(U.ORDER, len(s))]
        return sum(all_) / len(all_) if all_ else 0.0

    held = {k: [score(s) for _, _, _, r, s, aside in seen if r and aside and U.RULES[r] == k] for k in ("allow", "block")}
    trained = all(counts[k][0] for k in counts)
    slope = middle = 0.0
    if trained and held["allow"] and held["block"]:
        mean = {k: sum(v) / len(v) for k, v in held.items()}
        var = sum((x - mean[k]) ** 2 for k, v in held.items() for x in v) / sum(map(len, held.values())) + 1e-6
        slope, middle = (mean["allow"] - mean["block"]) / var, (mean["allow"] + mean["block"]) / 2
    return [(page, host, path, r, U.RULES[r] if r else "allow" if slope * (score(s) - middle) >= 0 else "block") for page, host, path, r, s, _ in seen]


def verdicts(spark, rows):
    out = U.judged(spark.createDataFrame(rows, "page_id long, url string"), U.RULES)
    return sorted((tuple(r) for r in out.select("page_id", "hushframe_host", "hushframe_path", "hushframe_rule", "hushframe_verdict").collect()), key=repr)


def test_urls_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()]
    odd = [(900, None), (901, ""), (902, "no scheme/en/"), (903, "http://"), (904, "x://COM?en/"), (905, "http://A.EXAMPLE.com/en/7?x#y"), (905, "http://A.EXAMPLE.com/en/7?x#y"), (906, "http://xcom/en/"), (907, "http://é.net/de/ß" + "z" * 3000), (908, "a://b.net#/de/"), (None, "http://org/es/\n1"), (909, "://net/de/x")]
    assert verdicts(spark, rows + odd) == sorted(brute_verdicts(rows + odd), key=repr)


def test_urls_without_labels(spark):
    assert verdicts(spark, [(1, "http://a.b/c")]) == [(1, "a.b", "/c", None, "allow")]
    assert U.judged(spark.createDataFrame([], "page_id long, url string"), U.RULES).collect() == []
    odd = U.judged(spark.createDataFrame([(1, "http://a.org/es/x", "c", 2.0)], "`page.id` int, url string, key string, hushframe_odds double"), U.RULES)
    assert odd.columns[:3] == ["page.id", "url", "key"] and odd.first()[:5] == (1, "http://a.org/es/x", "c", "a.org", "/es/x")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("pages", "documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {table} AS FROM '{sf_dir}/{table}.parquet'")
    df, want = QUERIES[name](spark, sf_dir), con.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    places = [want.columns.index(c) for c in columns]
    assert sorted(df.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in places) for r in want.fetchall()), key=repr)


def test_shards(spark):
    rows = [(i, "text" * (i % 9)) for i in range(6000)] + [(None, None), (None, "ü"), (7, "x"), (7, "x")]
    out = H.sharded(spark.createDataFrame(rows, "doc_id long, text string"), H.layout(24), grown=H.layout(25)).collect()
    assert len(out) == len(rows)
    assert all(r.shard == r.grown_shard or r.grown_shard == 24 for r in out)
    assert 0.5 < sum(r.grown_shard == 24 for r in out) / (len(out) / 25) < 1.5
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(24)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert all(0.7 < len(v) / 250 < 1.3 for v in by.values())
    assert len({r.shard for r in out if r.doc_id == 7}) == 1 and len({r.shard for r in out if r.doc_id is None}) == 1
    sizes = Counter((r.doc_id, r.size, r.text_crc32) for r in out)
    assert sizes == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert H.sharded(spark.createDataFrame([], "doc_id long, text string"), H.layout(24)).collect() == []


def test_weights_and_confined_movement(spark):
    keys = spark.range(20000).withColumnRenamed("id", "doc_id")
    at = lambda tree: {r.doc_id: r.s for r in keys.select("doc_id", H.descend(F.col("doc_id"), tree).alias("s")).collect()}
    base, heavy, gone = at(H.layout(24)), at(H.layout(24, {3: 3.0})), at(H.layout(24, {3: 0.0}))
    assert 2.4 < sum(s == 3 for s in heavy.values()) / sum(s == 3 for s in base.values()) < 3.1
    assert not any(s == 3 for s in gone.values())
    region = lambda s: s // 8
    # Rows that change region go to the heavier one, or leave the lighter one.
    assert all(region(heavy[k]) == 0 for k in base if region(base[k]) != region(heavy[k]))
    assert all(region(base[k]) == 0 for k in base if region(base[k]) != region(gone[k]))
    # In regions whose weight is the same, nothing moves.
    assert all(heavy[k] == base[k] for k in base if region(base[k]) == region(heavy[k]) != 0)


HTML = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p><article>no";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- <p>gone</p> --><div class="ad">Buy</div>
<main><article><h1>Ti&shy;tle &eacute; &#8212; &lt;b&gt;</h1><p>One  <b>bold</b><br>two\n three.<p>Next &nbsp; &copy;
<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>x<td>y</table><form><p>Mail</p><input></form><aside>Side</aside><div class="notice">Note</div>text <div>inner</div> tail
<section id="comments"><h2>Comments</h2><article class="comment"><p>first!</p></article></section></article></main><footer>&copy; foot</footer></body></html>"""


def test_one_page():
    assert T.main_text(HTML, {}).split("\n") == ["Ti\u00adtle é — <b>", "One bold two three.", "Next ©", "a", "b", "c", "x", "y", "text", "inner", "tail"]
    assert T.main_text("", {}) == "" and T.main_text("plain &amp; text", {}) == "plain & text"
    assert T.main_text("<article><p>cut sho", {}) == "cut sho"


def test_names_of_elements():
    page = '<div class="page has-sidebar"><header>Top</header><div class="siteFooter">f</div><p class="no-ads">text</p><div id="adslot1">ad</div></div>'
    assert T.main_text(page, {}) == "text"
    page = '<header>Top</header><article class="post comments-open"><header class="post-header"><h1>Title</h1></header><p>x</p><div class="ad-box">ad</div></article><article class="comment">c</article>'
    assert T.main_text(page, {}) == "Title\nx"


def test_deep_and_broken_pages():
    assert T.main_text("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after", {}) == "deep\nafter"
    assert T.main_text('<p title="x>y">a</p><p class=>b<p><', {}) == "a\nb\n<"
    assert T.main_text("x" * 200_000 + "<p>" * 3000, {}) == "x" * 200_000


def plain_article(page):
    """For pages of the given tables: the blocks of the article by a simple parser of the standard library."""
    from html.parser import HTMLParser

    class P(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.on, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.on |= tag == "article"
            if tag in ("p", "h1", "article"):
                self.blocks.append("")
            if tag == "br":
                self.blocks[-1] += " "

        def handle_endtag(self, tag):
            if tag in ("p", "h1", "article"):
                self.blocks.append("")
            self.on &= tag != "article"

        def handle_data(self, data):
            if self.on:
                self.blocks[-1] += data

    p = P()
    p.feed(page)
    p.close()
    return "\n".join(x for x in (" ".join(b.split()) for b in p.blocks) if x)


def test_pages_of_the_corpus(spark, sf_dir):
    top = sf_dir.replace("sf0.001", "sf0.01")
    pages = {r.page_id: r for r in spark.read.parquet(f"{top}/pages.parquet").collect()}
    out = T.op3_html_extraction(spark, top).collect()
    assert len(out) == len(pages)
    for r in out:
        assert r.text == plain_article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.mark.parametrize("most", [T.BROADCAST_LINES, 0])
def test_templates_without_articles_by_entropy(spark, most):
    page = lambda i: f"<body><div id=top>Welcome to the site</div><div id=x><p>Story {i} of its own kind</p><p>More of {i}</p></div><div id=end>All rights kept</div></body>"
    rows = [(i, f"http://a.b/{i}", page(i)) for i in range(20)] + [(100, "http://c.d/", page(1)), (101, None, None), (102, "", ""), (103, "x", page(2))]
    out = {r.page_id: r.hushframe_text for r in T.extract(spark.createDataFrame(rows, PAGES), broadcast_lines=most).collect()}
    assert all(out[i] == f"Story {i} of its own kind\nMore of {i}" for i in range(20))
    assert out[100].split("\n")[0] == "Welcome to the site" and out[101] == "" and out[102] == ""
    assert T.extract(spark.createDataFrame([], PAGES)).collect() == []


def test_copies_of_a_page_count_once(spark):
    """Text that a host has many copies of stays; what different pages share goes."""
    page = lambda kind, text: f"<html><body><div class='{kind}'><p>{text}</p></div><div class='zq'><p>Same line of the host</p></div></body></html>"
    rows = [(f"http://h.example/{i}", page("copied", "The one text that was copied")) for i in range(9)]
    rows += [(f"http://h.example/x{i}", page("other", f"Text number {i} and its own words {i * i}")) for i in range(6)]
    got = {r.url: r.hushframe_text for r in T.extract(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got["http://h.example/0"] == "The one text that was copied"
    assert got["http://h.example/x3"] == "Text number 3 and its own words 9"


@pytest.mark.parametrize("most", [T.BROADCAST_LINES, 0])
def test_the_merged_tree_decides_inside_articles_too(spark, most):
    """Boilerplate without a telling name goes, a telling name that is none stays, and text outside the article stays if it differs."""
    page = lambda i: (
        f"<body><div class=q0>Of the site</div><div class=lead><p>Lead of story {i} {i * i}</p></div><article><h1>Title {i}</h1><p>Story {i} and {i * 7}</p><p>Le.</p>"
        f"<div class=q1><p>Read this site every day</p></div><div class=share-price><p>Price on day {i}</p></div><div class=share-bar>Share {i}</div><div class=notice-of-terms><p>Terms hold</p></div></article><div class=comments><p>Reader {i} says {i * 3}</p></div></body>"
    )
    rows = [(i, f"http://a.b/{i}", page(i).replace("<p>Le.</p>", "<p>Le.</p>" * (i % 4 > 0))) for i in range(20)]
    got = {r.page_id: r.hushframe_text for r in T.extract(spark.createDataFrame(rows, PAGES), broadcast_lines=most).collect()}
    for i in range(20):
        assert got[i].split("\n") == [f"Lead of story {i} {i * i}", f"Title {i}", f"Story {i} and {i * 7}", *["Le."] * (i % 4 > 0), f"Price on day {i}"]
    # Without the merged tree the article and the names alone would decide.
    assert T.main_text(page(3), {}).split("\n") == ["Title 3", "Story 3 and 21", "Le.", "Read this site every day", "Price on day 3", "Terms hold"]


def test_importance_against_plain_loops(spark):
    pages = [f"<body><div><p>{'same' if i < 6 else f'own {i}'}</p>{'<ul><li>x</ul>' * (i % 2)}</div></body>" for i in range(9)]
    docs = spark.createDataFrame([(f"http://h/{i}", p) for i, p in enumerate([*pages, pages[0], pages[8]])], "url string, html string")
    got = {r.n: r.importance for r in T.importance(cut(T.merged_tree(T.keyed_pages(docs, "url", "html")), "tree")).where(F.col("n") > 3).collect()}
    # Different pages: pages 0, 2, 4 are copies of each other, and 1, 3, 5 are, so five remain; two have the line "same".
    assert got == {}
    more = [f"<body><p>{'same' if i < 6 else f'own {i}'}</p><hr title={i}><h2>{i}</h2></body>" for i in range(9)]
    docs = spark.createDataFrame([(f"http://h/{i}", p) for i, p in enumerate([*more, more[0]])], "url string, html string")
    got = [(r.n, r.importance) for r in T.importance(cut(T.merged_tree(T.keyed_pages(docs, "url", "html")), "tree")).collect()]
    assert [n for n, _ in got] == [6] and abs(got[0][1] - math.log(9 / 6) / math.log(9)) < 1e-9


def test_pages_that_names_misread():
    page = "<article><div class='notice-of-motion'><p>Body text</p></div><div class='share-price'><p>More body</p></div></article>"
    assert T.main_text(page, {}) == "Body text\nMore body"
    page = "<body><div><p>The story</p></div><article class=teaser><p>Another story</p></article></body>"
    assert T.main_text(page, {}) == "The story"
    assert T.main_text("<article>" + "<div>" * 420 + "<p>a</p><p>b</p>" + "</div>" * 420 + "</article>", {}) == "a\nb"


def test_extraction_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>", "h", 3)], "page_id long, url string, html string, host string, paths int")
    out = T.extract(df)
    assert out.columns == ["page_id", "url", "host", "paths", "hushframe_text"] and out.first()[:] == (1, "u", "h", 3, "x")
    odd = T.extract(spark.createDataFrame([("u", "<p>x</p>", "h", 1, 2, "t")], "url string, html string, hf_host string, `hf_key` int, `a.b` int, hushframe_text string"))
    assert odd.columns == ["url", "hf_host", "hf_key", "a.b", "hushframe_text"] and odd.first()[:] == ("u", "h", 1, 2, "x")


def test_warc_round_trip(spark):
    big = "é<p>" * 100_000
    rows = [(1, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (3, None, None), (4, "u", ""), (5, "u", big), (0, "u", "same"), (0, "u", "same"), (None, "u", "same"), (None, "v", "only"), (6, "u", "HTTP/1.1\r\n\r\nWARC/1.1\r\n")]
    files = A.write(spark.createDataFrame(rows, PAGES), file_bytes=300)
    assert files.count() > 1 and files.agg(F.sum("n_records")).first()[0] == len(rows)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in A.read(files).collect())
    first = {}
    for i, _, body in rows:
        if i is not None:
            first[body or ""] = min(first.get(body or "", i), i)
    want = Counter()
    for i, _, body in rows:
        raw = (body or "").encode()
        target = first.get(body or "")
        again = target is not None and i != target
        want[(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", target if again else None)] += 1
    assert got == want
    assert A.read(A.write(spark.createDataFrame([], PAGES))).collect() == []
    named = spark.createDataFrame([("b x", "u", "same"), ("a", "u", "same"), (None, "u", "other")], "`page.id` string, url string, html string")
    assert sorted(((r.page_id or "", r.record_type, r.refers_to) for r in A.read(A.write(named, key="page.id"), "string").collect())) == [("", "response", None), ("a", "response", None), ("b x", "revisit", "a")]


def test_small_payloads_stay_responses(spark):
    rows = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], PAGES)
    out = {r.page_id: r.record_type for r in A.read(A.write(rows, least_bytes=4)).collect()}
    assert out == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_warc_reader_streams_and_checks():
    raw = b"".join(A.record(i, "http://x/", b"payload %d " % i * 9000) for i in range(5))
    got = list(A.read_records(io.BytesIO(raw), payloads=True))
    assert [x["payload"] for x in got] == [b"payload %d " % i * 9000 for i in range(5)]
    assert got[0]["warc-target-uri"] == "http://x/" and got[0]["n_payload"] == len(got[0]["payload"])
    with pytest.raises(ValueError, match="cut short"):
        list(A.read_records(io.BytesIO(raw[:-20])))
    whole = zlib.decompress(A.record(1, None, b"abc"), 31)
    for bad, why in ((whole.replace(b"abc", b"abd"), "differs"), (whole.replace(b"\r\n\r\nabc", b"\r\n\r\nabcd"), "length"), (b"nothing\r\n\r\n", "not a WARC"), (b"no end", "no end")):
        with pytest.raises(ValueError, match=why):
            list(A.read_records(io.BytesIO(zlib.compress(bad, wbits=31))))


def test_codec_against_the_library(spark):
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=C.MODEL), C.Codec()
    texts = ["", " ", "   a  b ", "plain words", "\n\n x\ty\n", "日本語 ünï 😀 \u2581 x\u2581y", "<s> </s> <unk> <0x41>", "a" * 500, "\x00\x01", "no space", "x" + " " * 40 + "y", "".join(chr(c) for c in range(0x20, 0x250))]
    ids = own.encode(texts)
    assert [x.tolist() for x in ids] == [library.encode(t) for t in texts]
    assert [own.decode(x) for x in ids] == [library.decode(x.tolist()) for x in ids]
    assert [x.tolist() for x in own.encode(texts)] == [x.tolist() for x in ids]


def test_codec_of_a_unigram_model(tmp_path):
    import sentencepiece

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def message(number, raw):
        return varint(number << 3 | 2) + varint(len(raw)) + raw

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", -20.0, 6) for i in range(256)]
    pieces += [(p, -1.0 - i / 10, 1) for i, p in enumerate(["▁", "▁the", "he", "t", "h", "e", "▁a", "a", "n", "an", "▁and", "d", "▁▁"])]
    raw = b"".join(message(1, message(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + varint(k)) for p, s, k in pieces)
    raw += message(2, b"\x18\x01" + varint(35 << 3) + b"\x01") + message(3, message(1, b"identity") + b"\x18\x01\x20\x00")
    path = tmp_path / "u.model"
    path.write_bytes(raw)
    library, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), C.Codec(str(path))
    texts = ["the and a", "hand  the thean", "xyz", "", "an an"]
    assert [x.tolist() for x in own.encode(texts)] == [library.encode(t) for t in texts]
    assert [own.decode(x) for x in own.encode(texts)] == texts


def test_round_trip_of_the_corpus(spark, sf_dir):
    out = C.op8_sentencepiece(spark, sf_dir).collect()
    assert len(out) == 200 and all(r.round_trip and r.parity for r in out)
    docs = spark.createDataFrame([(1, None, "k"), (1, "", None), (None, "a  b\n", "k")], "doc_id long, text string, key string")
    rows = C.decode(C.encode(docs)).collect()
    assert [r.hushframe_decoded for r in rows] == ["", "", "a  b\n"] and [len(r.hushframe_ids) for r in rows][:2] == [0, 0]
    assert C.round_trip(docs).count() == 3 and C.round_trip(docs.limit(0)).collect() == []


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    frames = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frames[name] = spark.createDataFrame(stage(spark, list(frames.values())[-1], sf_dir).collect(), docs.schema)
        assert frames[name].columns == docs.columns
    ids = {k: {r.doc_id for r in v.collect()} for k, v in frames.items()}
    good = {i for i in ids["documents"] if labels.get(i) == 1}
    assert len(good & ids["quality"]) / len(good) > 0.95
    assert ids["near_dedup"] <= ids["quality"] and ids["substrings"] == ids["near_dedup"] and ids["decontamination"] <= ids["substrings"]
    assert all(r.n_chars == len(r.text) for r in frames["substrings"].collect())
    last = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in last} == ids["decontamination"] and all(r.round_trip and r.parity for r in last)
