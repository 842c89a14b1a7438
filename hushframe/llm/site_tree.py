"""Main text of pages by site style trees.

Every page is parsed into a tree of block elements; an element's name is its tag with
its classes, id and role.  The trees of one host, inside articles too, are merged by
path (the names from the root down).  A node of the merged tree holds the number of
pages that have it, its presentations (the sequence of child names, repeats as one) and
its contents (the lines of text in it), each with the number of pages it is on.

The importance of a line is that of its content, ln(pages / pages with the line) /
ln(pages): 1 for what is on one page, 0 for what is on all.  What is missing to 1 is
made up in part by the entropy of the node's presentations, the more the more of them
there are (a share of 1 - ``GAMMA`` ** presentations).  It is multiplied by a prior that
the element's own presentation gives, and a line below ``LEAST`` is removed:

- an article's or main's lines count ``ARTICLE`` times, so that only what nearly all
  pages repeat goes;
- other lines count once;
- lines under a name that holds a telling word among others (share-price,
  notice-of-motion), and lines outside the article of a page that has one, count
  ``DOUBTFUL``: entropy keeps them if it is high;
- what names alone tell (nav, footer, a class ad, comments or cookie-notice) counts 0:
  comments and adverts differ from page to page as text does, which entropy cannot see.

A path that fewer than ``FEW`` different pages have tells nothing; there lines outside an
article go and all others stay.

Lines are counted by path and digest, so a host with very many pages is never in one
task; only lines whose verdict is not the usual one of their sort are brought back to
the pages, as 64-bit digests of host, path, sort and text.  While there are at most
``BROADCAST_LINES`` of them (counted) they go to every task; beyond that each page is
joined with its own.

Defined results: a null or empty page has empty text; a null or odd URL is of the host
without a name; copies of a page on a host count once, and all get the same text;
unclosed and stray tags are closed as browsers do in the common cases; nesting may be of
any depth; columns named like the one that is added are replaced.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Container, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.llm.shared import cut, spread_join
from hushframe.llm.textbytes import releasing
from hushframe.llm.url_filter import host_and_path

LEAST = 0.3
FEW = 4
GAMMA = 0.9
ARTICLE = 6.0
DOUBTFUL = 0.375
#: Lines (8 bytes each) up to which they go to every task, and the copied pages up to which their counts do.
BROADCAST_LINES = 250_000
BROADCAST_COPIES = 500_000
#: Sorts of rows of the merged tree: a page has the path, a presentation, and lines by their prior.
PAGE, PRESENTATION, NEUTRAL, INSIDE, NAMED, OUTSIDE = range(6)
PRIOR = {NEUTRAL: 1.0, INSIDE: ARTICLE, NAMED: DOUBTFUL, OUTSIDE: DOUBTFUL}

#: HTML elements that make blocks, and those whose content is never text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
SILENT = frozenset("head script style noscript template iframe object svg math canvas audio video select option datalist button textarea input label title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements, roles and name parts that mark what is not main text.
ASIDE_TAGS = frozenset("nav footer aside form menu dialog search fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar note status toolbar".split())
ASIDE_NAMES = frozenset("ad adbox ads adsense adslot adv advert adverts advertisement advertising alert announcement announcements aside breadcrumb breadcrumbs comment comments commentlist consent cookie cookies discussion disqus footer form gdpr login menu modal nav navbar navigation newsletter notice notices notification notifications pager pagination popup promo promoted promotion related replies reply respond search searchbox share sharing sidebar sidenav signup skip social sponsor sponsored submenu subscribe subscription toc toolbar topbar widget widgets".split())
#: The same, but part of an article if they are inside one.
HEADER_NAMES = frozenset("header masthead banner".split())
#: Words that tell of an element's place or form only: with these a telling word stays what it is.
LAYOUT = frozenset("area article articles bar block body bottom box button buttons card center column container content cookies desktop element end entry feed global group grid head header heading holder horizontal icon icons id inline inner item items large latest left link links list lists main mobile module more outer page panel post posts primary reader readers recent right row secondary section site slot small sticky story tab tabs text thread title top unit user users vertical view web wide wrap wrapper zone".split())
#: An article's own class says less: only these, as whole words, make it none.
NO_ARTICLE = frozenset("ad advert comment comments promo related reply sponsored teaser".split())
#: A class that starts so tells of a page's or element's state.
STATES = frozenset("has with without no is not hide show".split())
ARTICLE_TAGS = frozenset(("article", "main"))

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|iframe|svg|math)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: A start tag of these ends an open one of those.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


class Node:
    """One block element; ``gone``: names alone remove it, ``inside``: it is in an article, ``doubtful``: a name of it or above it may be telling."""

    __slots__ = ("article", "children", "doubtful", "gone", "header", "inside", "name", "parts", "tag")

    def __init__(self, tag: str, attributes: str = "", above: Node | None = None):
        self.tag, self.name, self.children, self.parts = tag, tag, [], []
        self.gone, self.article, self.header, self.doubtful = tag in ASIDE_TAGS, tag in ARTICLE_TAGS, tag == "header", False
        if attributes and not attributes.isspace():
            for key, *values in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), "".join(values)
                if key in ("class", "id"):
                    self.name += ("." if key == "class" else "#") + ".".join(value.split())
                    if self.article:
                        self.gone |= not NO_ARTICLE.isdisjoint(value.lower().split())
                    elif tag not in ("html", "body"):
                        self.name_says(value)
                elif key == "role":
                    self.gone |= value.lower() in ASIDE_ROLES
                    self.article |= value.lower() in ("main", "article")
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDES.search(value):
                    self.gone = True
        self.inside = self.article and not self.gone
        if tag in ("html", "body"):
            self.gone = False
        if above is not None:
            self.inside |= above.inside
            self.doubtful |= above.doubtful
            self.gone |= above.gone or (self.header and not self.inside)

    def name_says(self, value: str) -> None:
        for word in value.split():
            said = [x.lower() for x in _NAME.findall(word)]
            if said and said[0] not in STATES:
                telling = [x for x in said if x in ASIDE_NAMES]
                form = all(x in LAYOUT or x in HEADER_NAMES for x in said if x not in ASIDE_NAMES)
                self.gone |= bool(telling) and form
                self.doubtful |= bool(telling) and not form
                self.header |= form and not HEADER_NAMES.isdisjoint(said)


def parse(page: str) -> tuple[Node, bool]:
    """The page's tree of block elements, whose parts are strings and child nodes in order, and whether it has an article."""
    root = Node("#page")
    stack, at, silent, whole = [root], 0, 0, False
    for m in _TAG.finditer(page):
        if not silent and m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag, closing = tag.lower(), m.group(2)
        if tag == "br" or tag == "wbr" or tag == "hr":
            if not silent and tag == "br":
                stack[-1].parts.append(" ")
            continue
        if tag in SILENT:
            if tag not in VOID and not m.group(4).endswith("/"):
                silent = max(0, silent + (-1 if closing else 1))
            continue
        if tag == "body" and not closing:
            silent = 0
        if tag not in BLOCKS or silent:
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        ends = _CLOSES.get(tag)
        if ends:
            # Within the innermost list or table only.
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    del stack[i:]
                    break
                if stack[i].tag in ("ul", "ol", "menu", "dl", "table"):
                    break
        else:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in ("td", "th", "li", "div", "section", "article"):
                    break
        node = Node(tag, m.group(4), stack[-1])
        whole |= node.inside and not node.gone
        stack[-1].children.append(node)
        stack[-1].parts.append(node)
        stack.append(node)
    if not silent and at < len(page):
        stack[-1].parts.append(page[at:])
    return root, whole


def block(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def presentation(node: Node) -> str:
    """The names of the children, a run of equal ones as one."""
    out: list[str] = []
    for child in node.children:
        if not out or out[-1] != child.name:
            out.append(child.name)
    return " ".join(out)


def digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"\0".join(parts), digest_size=8).digest()


def as_long(raw: bytes) -> int:
    return int.from_bytes(raw, "little", signed=True)


def walk(page: str, host: str) -> Iterator[tuple[bytes, Node | None, int, str]]:
    """What names alone do not remove, in page order: (path, node, PAGE, "") for each element, (path, None, sort, line) for each line."""
    root, whole = parse(page)
    paths: dict[tuple[bytes, str], bytes] = {}
    top = digest(host.encode("utf-8", "surrogatepass"))
    yield top, root, PAGE, ""
    stack = [(root, top, iter(root.parts))]
    held: list[str] = []
    while stack:
        node, path, rest = stack[-1]
        child = next(rest, None)
        if isinstance(child, str):
            held.append(child)
            continue
        line = block(held) if held else ""
        held = []
        if line:
            yield path, None, NAMED if node.doubtful and (node.inside or not whole) else INSIDE if node.inside else OUTSIDE if whole else NEUTRAL, line
        if child is None:
            stack.pop()
        elif not child.gone:
            key = (path, child.name)
            below = paths.get(key)
            if below is None:
                below = paths[key] = digest(path, child.name.encode("utf-8", "surrogatepass"))
            yield below, child, PAGE, ""
            stack.append((child, below, iter(child.parts)))


def line_key(path: bytes, sort: int, line: str) -> int:
    return as_long(digest(path, bytes([sort]), line.encode("utf-8", "surrogatepass")))


def main_text(page: str, turned: Container[int], host: str = "") -> str:
    """The lines that remain; turned: keys of the lines whose verdict is not the usual one of their sort."""
    return "\n".join(line for path, node, sort, line in walk(page, host) if node is None and (sort == OUTSIDE) == (line_key(path, sort, line) in turned))


def tree_rows(page: str, host: str) -> set[tuple[int, int, int]]:
    """(path, kind, value) of all nodes of a page, each once."""
    out = set()
    for path, node, sort, line in walk(page, host):
        at = as_long(path)
        if node is None:
            out.add((at, sort, line_key(path, sort, line)))
        else:
            out.add((at, PAGE, 0))
            out.add((at, PRESENTATION, as_long(digest(presentation(node).encode("utf-8", "surrogatepass")))))
    return out


def keyed_pages(pages: DataFrame, url: str, page: str) -> DataFrame:
    """The pages with hf_host, hf_page (the whole html, never null) and hf_key (equal for copies on a host)."""
    host = host_and_path(F.coalesce(F.col(f"`{url}`"), F.lit("")))[0]
    return pages.withColumns({"hf_host": host, "hf_page": F.coalesce(F.col(f"`{page}`"), F.lit(""))}).withColumn("hf_key", F.xxhash64("hf_host", "hf_page"))


def merged_tree(keyed: DataFrame) -> DataFrame:
    """From keyed_pages(): (path, kind, value, n), n the number of different pages of the path's host that have it."""
    copies = cut(keyed.groupBy("hf_key").agg(F.count("*").alias("c")).where("c > 1"), "copies")
    few = copies.count() <= BROADCAST_COPIES
    rows = keyed.select("hf_host", "hf_page", "hf_key").join(F.broadcast(copies) if few else copies, "hf_key", "left").select("hf_host", "hf_page", F.coalesce("c", F.lit(1)).alias("c"))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for host, page, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                # Each of c copies counts 1 / c.
                for row in tree_rows(page, host):
                    total[row] += 1 / c
            columns = list(zip(*total, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], type=pa.int64()), pa.array(columns[1], type=pa.int32()), pa.array(columns[2], type=pa.int64()), pa.array(list(total.values()), type=pa.float64())], names=["path", "kind", "value", "n"])

    return rows.mapInArrow(run, "path long, kind int, value long, n double").groupBy("path", "kind", "value").agg(F.round(F.sum("n"), 3).alias("n"))


def importance(tree: DataFrame) -> DataFrame:
    """(kind, value, n, importance) for the lines of merged_tree() that are on more than one page or outside an article, on paths of ``FEW`` pages or more."""
    n = F.col("n")
    shown = F.col("kind") == PRESENTATION
    nodes = tree.groupBy("path").agg(
        F.sum(F.when(F.col("kind") == PAGE, n)).alias("pages"),
        F.count_if(shown).alias("presentations"),
        F.sum(F.when(shown, n)).alias("all"),
        F.sum(F.when(shown, n * F.ln(n))).alias("nlogn"),
        F.count_if(F.col("kind") > PRESENTATION).alias("lines"),
    )
    entropy = F.greatest(F.lit(0.0), (F.ln("all") - F.col("nlogn") / F.col("all")) / F.ln("all"))
    nodes = nodes.where((F.col("pages") >= FEW) & (F.col("lines") > 0)).select("path", "pages", "lines", ((1 - F.pow(F.lit(GAMMA), "presentations")) * entropy).alias("by_presentation"))
    some = tree.where((F.col("kind") > PRESENTATION) & ((n > 1) | (F.col("kind") == OUTSIDE)))
    by_content = F.ln(F.col("pages") / n) / F.ln("pages")
    rows = spread_join(some, cut(nodes, "tree_nodes"), "path", "lines").withColumn("c", F.greatest(F.lit(0.0), by_content))
    return rows.select("kind", "value", "n", (F.col("c") + (1 - F.col("c")) * F.col("by_presentation")).alias("importance"))


def turned_lines(lines: DataFrame) -> DataFrame:
    """(value, n) of the lines of importance() whose verdict is not the usual one: outside an article they stay, else they go."""
    weight = F.lit(0.0)
    for kind, prior in PRIOR.items():
        weight = F.when(F.col("kind") == kind, prior).otherwise(weight)
    return lines.where((weight * F.col("importance") < LEAST) != (F.col("kind") == OUTSIDE)).groupBy("value").agg(F.max("n").cast("long").alias("n"))


def extract(pages: DataFrame, *, url: str = "url", page: str = "html", broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """The pages' columns without the markup, and hushframe_text string."""
    inner = {x: f"hf_c{i}" for i, x in enumerate(pages.columns)}
    keyed = keyed_pages(pages.toDF(*inner.values()), inner[url], inner[page])
    turned = cut(turned_lines(importance(cut(merged_tree(keyed), "style_tree"))), "turned_lines")
    names = [x for x in pages.columns if x not in (page, "hushframe_text")]
    rows = keyed.select(*(inner[x] for x in names), "hf_host", "hf_page", "hf_key")
    held = None
    if turned.count() <= broadcast_lines:
        held = pages.sparkSession.sparkContext.broadcast(np.sort(turned.select("value").toArrow().column(0).to_numpy()))
        rows = rows.withColumn("hf_turned", F.array().cast("array<long>"))
    else:
        rows = spread_join(rows, own_lines(keyed, turned), "hf_key", "hf_copies", "left").withColumn("hf_turned", F.coalesce("hf_turned", F.array().cast("array<long>")))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = frozenset(held.value.tolist()) if held is not None else None
        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("hf_page", "hf_host", "hf_turned")]
            texts = [main_text(x, everywhere if everywhere is not None else frozenset(own), host) for x, host, own in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(inner[x]) for x in names), pa.array(texts, type=pa.string())], names=[*(inner[x] for x in names), "hushframe_text"])

    schema = T.StructType([*(T.StructField(inner[x], pages.schema[x].dataType) for x in names), T.StructField("hushframe_text", T.StringType())])
    return rows.select(*(inner[x] for x in names), "hf_host", "hf_page", "hf_turned").mapInArrow(run, schema).toDF(*names, "hushframe_text")


def own_lines(keyed: DataFrame, turned: DataFrame) -> DataFrame:
    """(hf_key, hf_turned array<long>, hf_copies): those of the turned lines that each page has; at most as many as its lines."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = [], []
            for host, page, key in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = [value for _, kind, value in tree_rows(page, host) if kind > PRESENTATION]
                keys += [key] * len(own)
                values += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), pa.array(values, type=pa.int64())], names=["hf_key", "value"])

    each = keyed.select("hf_host", "hf_page", "hf_key").mapInArrow(run, "hf_key long, value long")
    copies = keyed.groupBy("hf_key").agg(F.count("*").alias("hf_copies"))
    lists = spread_join(each, turned, "value", "n").groupBy("hf_key").agg(F.collect_set("value").alias("hf_turned"))
    return cut(lists.join(copies, "hf_key"), "own_lines")


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page, and its length in code points."""
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("hushframe_text").alias("text"), F.char_length("hushframe_text").cast("long").alias("n_chars"))
