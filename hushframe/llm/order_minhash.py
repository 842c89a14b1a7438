"""Near-duplicate documents by Order MinHash and banded alignment.

A text is the sequence of its words (split at ASCII white space, A-Z lower-cased),
and its tokens are its windows of ``K`` words (a shorter text is one token).  Two
texts are linked if an alignment of their tokens, in order, has L matches with
L / (n + m - L) >= 0.8; for texts without repeated tokens in a common order this is
the Jaccard similarity of their word shingles.

Candidates.  Tokens are labelled with their occurrence number in the text, and each
of ``SKETCHES`` hash functions picks the ``PICKED`` labelled tokens of the smallest
hash.  Their hashes, in the order of the text, make one sketch.  Texts with a common
sketch form a bucket; a pair is plausible if it shares ``SHARED`` sketches and its token
counts allow 0.8.  Linked texts share each sketch with a probability of 0.64 or more, so
3 in 100,000 links at the threshold, and fewer above it, are not plausible.

No bucket is expanded into pairs.  First every member is paired with its bucket's head,
the member that shares most sketches with others (of a text and its edited copies, that
is the text or what is next to it); this makes most classes cheaply.  The texts of
buckets that hold members of two classes beside the head are then joined exactly: their
labelled tokens are ordered by rarity (how many of these texts have them), and two texts
of which one token in 0.8 aligns must meet at their rarest common token, at a place in
either that leaves enough tokens behind it.  So texts that share only what is common to
a whole family (form letters) never meet, and what does meet is verified, in blocks of
``BLOCK`` members that are dealt out like rows.

Verification.  Common ends are cut off, then a bit-parallel longest common
subsequence runs over the rest inside the diagonal band that 0.8 leaves; within that
band the result is exact.

Classes are the connected components of the links.

Defined results: equal texts (null: as empty) are one node, so copies are always in
one class; texts without words are linked to equal texts only; rows with equal
doc_id and different texts remain separate rows; a class is named by its smallest
doc_id, null if all are null; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.components import components
from hushframe.llm.shared import cut, cut_small, drop, spread_join
from hushframe.llm.textbytes import LOWER, SPACED, Words, as_bytes, chunks, mix, releasing, windows, words

K = 5
SKETCHES = 16
PICKED = 2
SHARED = 3
#: Members of a block, and pairs compared at once.
BLOCK = 512
AT_ONCE = 1 << 17
BROADCAST_KEYS = 1_000_000
LEAST = 0.8


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """All K-word windows, and the whole of shorter texts, with their texts' indices; in text order."""
    rolled, at = windows(w, K)
    doc = w.doc_of_word()[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < K))
    if len(short):
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(w.hash ^ mix((np.arange(len(w.hash)) - np.repeat(w.first[:-1], w.counts)).astype(np.uint64))), dtype=np.uint64)))
        own = mix(total[w.first[short + 1]] - total[w.first[short]])
        rolled, doc = np.concatenate((rolled, own)), np.concatenate((doc, short))
        order = np.argsort(doc, kind="stable")
        rolled, doc = rolled[order], doc[order]
    return rolled, doc


def occurrences(rolled: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How many equal tokens the same text has before each token."""
    key = rolled ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(key) else np.empty(0, dtype=np.int64)
    out = np.empty(len(key), dtype=np.int64)
    out[order] = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
    return out


def sketches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of texts that have words, their token counts, and their sketches as int64[texts, SKETCHES]."""
    w = words(texts, SPACED, LOWER)
    rolled, doc = tokens(w)
    if not len(rolled):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty((0, SKETCHES), dtype=np.int64)
    labelled = mix(rolled ^ mix(occurrences(rolled, doc).astype(np.uint64) + np.uint64(77)))
    heads = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    sizes = np.diff(np.append(heads, len(doc)))
    out = np.empty((len(heads), SKETCHES), dtype=np.uint64)
    most = np.uint64(2**64 - 1)
    for s in range(SKETCHES):
        salt = mix(np.array([s + 1], dtype=np.uint64))[0]
        h = labelled ^ salt
        h *= np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9FB21C651E98DF25)
        at, picked = [], []
        for _ in range(PICKED):
            least = np.minimum.reduceat(h, heads)
            place = np.flatnonzero(h == np.repeat(least, sizes))
            place = place[np.unique(doc[place], return_index=True)[1]]
            at.append(np.where(least == most, np.iinfo(np.int64).max, place))
            picked.append(np.where(least == most, np.uint64(0), labelled[place]))
            h[place] = most
        order = np.argsort(np.stack(at), axis=0, kind="stable")
        run = np.take_along_axis(np.stack(picked), order, axis=0)
        value = np.full(len(heads), salt, dtype=np.uint64)
        for row in run:
            value = mix(value * np.uint64(31) + row)
        out[:, s] = value
    return doc[heads], sizes, out.view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether the tokens a and b can be aligned with L matches so that L / (n + m - L) >= least."""
    n, m = len(a), len(b)
    need = int(np.ceil(round(least * (n + m) / (1 + least), 9)))
    if need > min(n, m) or not need:
        return False
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[head:][::-1][: short - head] != b[head:][::-1][: short - head])
    tail = int(differ[0]) if len(differ) else short - head
    a, b, need = a[head : n - tail], b[head : m - tail], need - head - tail
    if need <= 0:
        return True
    if need > min(len(a), len(b)):
        return False
    _, inside = np.unique(np.concatenate((a, b)), return_inverse=True)
    shared = np.minimum(np.bincount(inside[: len(a)], minlength=inside.max() + 1), np.bincount(inside[len(a) :], minlength=inside.max() + 1)).sum()
    return shared >= need and banded_lcs(inside[: len(a)].tolist(), inside[len(a) :].tolist(), need) >= need


def banded_lcs(a: list[int], b: list[int], need: int) -> int:
    """The longest common subsequence, of matches whose places differ by no more than ``need`` matches allow; bit-parallel."""
    n, m = len(a), len(b)
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    # Of a path with ``need`` matches, at most m - need tokens of b and n - need of a are skipped.
    right, left = m - need, n - need
    band, full = (1 << (left + right + 1)) - 1, (1 << m) - 1
    v = full
    for i, x in enumerate(a):
        hit = places.get(x)
        if hit:
            low = i - left
            hit &= band << low if low >= 0 else band >> -low
            u = v & hit
            if u:
                v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def text_key(text: str = "text") -> Column:
    """16 bytes that name a text; null as the empty one."""
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))


def sketch_table(keyed: DataFrame) -> DataFrame:
    """(key, n, sketch array<long>) for every text with words, from (key, text); n is its number of tokens."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = as_bytes(batch.column(1)), batch.column(0)
            for part in chunks(texts):
                doc, sizes, values = sketches(texts[part])
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(doc) + 1, dtype=np.int32) * SKETCHES), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc + part.start)), pa.array(sizes), rows], names=["key", "n", "sketch"])

    return keyed.mapInArrow(run, "key binary, n long, sketch array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose texts are linked; texts: (node, text)."""
    one = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "ta"}).hint("merge"), "a")
    two = one.join(texts.withColumnsRenamed({"node": "b", "text": "tb"}).hint("merge"), "b").select("a", "b", "ta", "tb")

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = as_bytes(batch.column(2)), as_bytes(batch.column(3))
            good: list[int] = []
            for part in chunks(first):
                sides = []
                for side in (first, second):
                    rolled, doc = tokens(words(side[part], SPACED, LOWER))
                    at = np.searchsorted(doc, np.arange(part.stop - part.start + 1))
                    sides.append([rolled[i:j] for i, j in zip(at[:-1], at[1:], strict=True)])
                good += [part.start + i for i, (x, y) in enumerate(zip(*sides, strict=True)) if aligned(x, y)]
            rows = pa.array(good, type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], names=["a", "b"])

    return two.mapInArrow(run, "a long, b long")


def nodes_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, node): a number for each distinct text, by its key."""
    return cut(docs.select(text_key(text).alias("key")).distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")


def plausible(pairs: DataFrame, table: DataFrame, least: float = LEAST) -> DataFrame:
    """Those of the pairs (a, b, ...) whose token counts and sketches allow a link; table: (node, n, sketch)."""
    side = lambda x: table.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda same: same))
    return both.where((F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9) & (shared >= SHARED)).select(pairs.columns)


def roots_of(docs: DataFrame, nodes: DataFrame, *, text: str = "text") -> DataFrame:
    """(node, root) for every text that is linked to another but its class's smallest node."""
    keyed = docs.select(text_key(text).alias("key"), F.col(f"`{text}`").alias("text"))
    # Copies of a text have equal rows here.
    raw = cut(sketch_table(keyed).join(nodes, "key").select("node", "n", "sketch"), "sketches")
    slots = F.transform("sketch", lambda x, i: F.xxhash64(i, x))
    member = raw.select("node", F.explode(slots).alias("bucket"))
    shared = member.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("size")).where("first != last").select("bucket", "size")
    shared = cut_small(shared, "buckets")
    everyone = cut_small(spread_join(member, shared, "bucket", "size").distinct(), "members")
    known = cut_small(everyone.groupBy("node").agg(F.sum("size").alias("shared")), "shared")
    table = cut_small(raw.join(known, "node", "left_semi").distinct(), "signatures")
    # Of equal counts, a hash decides.
    order = F.shiftleft("shared", 20) + F.pmod(F.xxhash64("node"), F.lit(1 << 20))
    heads = cut_small(everyone.join(known, "node").groupBy("bucket").agg(F.max_by("node", order).alias("head"), F.count("*").alias("size")), "heads")
    # Of each bucket all but the head; what is paired with it is done.
    member = cut(spread_join(everyone.select("node", "bucket"), heads, "bucket", "size").where("node != head"), "others")
    drop(shared, everyone, known, heads)
    paired = member.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
    pairs = cut_small(plausible(paired, table), "pairs")
    # Only texts of plausible pairs are moved.
    texts = texts_of(keyed, nodes, ends(pairs))
    found = cut_small(verified(pairs, texts), "found")
    drop(texts, pairs)
    roots = components(found)
    opened = still_open(member.select("node", "bucket"), roots)
    texts = texts_of(keyed, nodes, opened)
    tokens_of = labelled_tokens(texts)
    pairs = cut_small(meeting(prefixes(tokens_of), roots, table).distinct(), "pairs")
    drop(texts)
    drop(tokens_of, opened)
    texts = texts_of(keyed, nodes, ends(pairs))
    found = cut_small(verified(pairs.select("a", "b"), texts), "found")
    drop(texts)
    drop(table)
    return merged(roots, pairs, found)


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def still_open(member: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): the members (node, bucket) of buckets with two classes, each once."""
    known = cut_small(member.join(roots, "node", "left").select("node", "bucket", F.coalesce("root", "node").alias("root")), "known")
    heads = known.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo != hi").select("bucket", "size")
    opened = cut_small(spread_join(known, cut_small(heads, "heads"), "bucket", "size").select("node").distinct(), "open")
    drop(known)
    return opened


def merged(roots: DataFrame, pairs: DataFrame, found: DataFrame) -> DataFrame:
    """roots (node, root) after the links found (a, b) among the pairs (a, b, ra, rb), whose ra and rb are the ends' roots."""
    joined = components(pairs.join(found, ["a", "b"], "left_semi").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    up = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return cut_small(moved.union(joined), "roots")


def labelled_tokens(texts: DataFrame) -> DataFrame:
    """(node, tokens array<long>): the tokens of a text with their occurrence numbers, so that no two are equal; from (node, text)."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = as_bytes(batch.column(1))
            for part in chunks(held):
                rolled, doc = tokens(words(held[part], SPACED, LOWER))
                own = mix(rolled ^ mix(occurrences(rolled, doc).astype(np.uint64) + np.uint64(77))).view(np.int64)
                first = np.searchsorted(doc, np.arange(part.stop - part.start + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, part.stop - part.start), pa.ListArray.from_arrays(pa.array(first, type=pa.int32()), pa.array(own))], names=["node", "tokens"])

    return cut_small(texts.select("node", "text").mapInArrow(run, "node long, tokens array<long>"), "tokens")


def prefixes(listed: DataFrame, least: float = LEAST) -> DataFrame:
    """From (node, tokens): (node, token, reach) for the tokens at which a text can meet an alike one first, rarest first.

    ``reach`` is the number of the text's tokens from this one on.  Texts of n and m tokens
    with enough in common have (n + m) * least / (1 + least) tokens behind the first of them
    in either.  Tokens that only one text has are left out.
    """
    each = listed.select("node", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    counts = cut_small(each.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "token_counts")
    ranked = spread_join(each, counts, "token", "c", "left").select("node", "n", F.struct(F.coalesce("c", F.lit(1)).alias("c"), "token").alias("t"))
    lists = ranked.groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("t")).alias("t"))
    rows = lists.select("node", "n", F.posexplode(F.slice("t", F.lit(1), F.col("n") - F.ceil(least * F.col("n") - 1e-9).cast("int") + 1)).alias("pos", "t"))
    return rows.where("t.c > 1").select("node", F.col("t.token").alias("token"), (F.col("n") - F.col("pos")).alias("reach"))


def meeting(prefix: DataFrame, roots: DataFrame, table: DataFrame, least: float = LEAST, size: int = BLOCK) -> DataFrame:
    """All plausible pairs (a, b, ra, rb) of different classes that meet at a token of prefixes(); repeats included.

    A token's rows are of four sorts.  A pair needs one row behind which there is enough
    for a partner of the same size (of two others each would want a shorter partner), and
    the token's largest class needs no pairs within itself.  Every sort is dealt into
    blocks by hash; two blocks that must meet, or one and itself, are a cell of at most
    some 2 * size rows.
    """
    known = prefix.join(roots, "node", "left").join(table.select("node", "n", "sketch"), "node")
    known = known.select("node", "token", "reach", "n", "sketch", F.coalesce("root", "node").alias("root"), (F.col("reach") * (1 + least) / least + 1e-6 >= 2 * F.col("n")).alias("wide"))
    known = cut_small(known, "prefixes")
    counts = known.groupBy("token", "root").agg(F.count_if("wide").alias("w"), F.count_if(~F.col("wide")).alias("s"))
    most = F.struct((F.col("w") + F.col("s")).alias("n"), "w", "s", "root")
    groups = counts.groupBy("token").agg(F.max(most).alias("m"), F.sum("w").alias("w"), F.sum("s").alias("s"), F.count("*").alias("classes")).where("classes > 1")
    blocks = lambda n: F.ceil(n / size).cast("long")
    # Sorts 0 to 3: wide ones of the other classes, of the main class, then the rest of the same.
    each = (F.col("w") - F.col("m.w"), F.col("m.w"), F.col("s") - F.col("m.s"), F.col("m.s"))
    groups = groups.select("token", F.col("m.root").alias("main"), (F.col("w") + F.col("s")).alias("all"), *(blocks(n).alias(f"b{i}") for i, n in enumerate(each)))
    groups = cut_small(groups.where("b0 > 0 OR b1 > 0 AND b2 > 0"), "groups")
    rows = spread_join(known, groups, "token", "all")
    sort = F.when(F.col("wide"), 0).otherwise(2) + (F.col("root") == F.col("main")).cast("int")
    before = [sum((F.col(f"b{j}") for j in range(i)), F.lit(0).cast("long")) for i in range(5)]
    of = lambda i: F.when(F.col(f"b{i}") > 0, F.sequence(before[i], before[i + 1] - 1)).otherwise(F.array().cast("array<long>"))
    rows = rows.withColumn("sort", sort)
    pick = lambda some: F.when(F.col("sort") == 0, some[0]).when(F.col("sort") == 1, some[1]).when(F.col("sort") == 2, some[2]).otherwise(some[3])
    own = pick(before[:4]) + F.pmod(F.xxhash64("node", F.lit("block")), pick([F.col(f"b{i}") for i in range(4)]))
    meets = pick((F.concat(of(0), of(1), of(2), of(3)), F.concat(of(0), of(2)), F.concat(of(0), of(1)), of(0)))
    dealt = rows.select("node", "root", "n", "reach", "sketch", "token", own.alias("own"), F.explode(meets).alias("other"))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    # 0 and 1 are the sides of a cell of two blocks; a block with itself is side 2.
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    cells = dealt.select(F.xxhash64("token", lo, hi, F.lit("cell")).alias("cell"), side.alias("side"), "node", "root", "n", F.col("reach").cast("long").alias("reach"), "sketch")
    # A clash of cells would only compare more; a pair counts if it is plausible.
    cells = cells.repartition("cell").sortWithinPartitions("cell", "side", "root")

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cell = batch.column(0)
            if not len(cell):
                continue
            # The last cell of a batch may go on in the next.
            cuts = int(np.searchsorted(cell.to_numpy(), cell[-1].as_py()))
            if not cuts and held and held[-1].column(0)[-1] == cell[-1]:
                held.append(batch)
                continue
            if held and held[-1].column(0)[-1] != cell[0]:
                yield from plausible_in(held, least)
                held = []
            if cuts:
                yield from plausible_in([*held, batch.slice(0, cuts)], least)
                held = []
            held.append(batch.slice(cuts))
        if held:
            yield from plausible_in(held, least)

    return cells.mapInArrow(run, "a long, b long, ra long, rb long")


def plausible_in(batches: list[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """The plausible pairs of different roots in whole cells (cell, side, node, root, n, reach, sketch), sorted by cell, side and root."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    cell, side, node, root, n, reach = (rows.column(i).to_numpy() for i in range(6))
    sketch = rows.column(6).combine_chunks().flatten().to_numpy().reshape(-1, SKETCHES)
    at = np.arange(len(cell))
    turn = lambda *of: np.concatenate(([True], np.any([x[1:] != x[:-1] for x in of], axis=0)))

    def ends(first: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(first)
        return np.repeat(np.append(starts[1:], len(cell)), np.diff(np.append(starts, len(cell))))

    # Side 0 meets what comes after its side, side 2 what comes after its root, side 1 nothing.
    end = ends(turn(cell))
    begin = np.where(side == 0, ends(turn(cell, side)), np.where(side == 2, ends(turn(cell, side, root)), end))
    todo = end - begin
    before = np.concatenate(([0], np.cumsum(todo)))
    for low in range(0, int(before[-1]), AT_ONCE):
        k = np.arange(low, min(low + AT_ONCE, int(before[-1])))
        x = at[np.searchsorted(before, k, side="right") - 1]
        y = begin[x] + k - before[x]
        good = (root[x] != root[y]) & (np.minimum(reach[x], reach[y]) >= least * (n[x] + n[y]) / (1 + least) - 1e-6)
        x, y = x[good], y[good]
        good = (sketch[x] == sketch[y]).sum(axis=1) >= SHARED
        x, y = x[good], y[good]
        out = [np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), np.minimum(root[x], root[y]), np.maximum(root[x], root[y])]
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["a", "b", "ra", "rb"])


def texts_of(keyed: DataFrame, nodes: DataFrame, some: DataFrame) -> DataFrame:
    """(node, text) of some (node), each once.

    Keys are 16 bytes: while there are at most ``BROADCAST_KEYS`` (counted) they go to every
    task and only the texts that are needed move; beyond that both sides are shuffled.
    """
    needed = cut_small(nodes.join(some, "node", "left_semi"), "ends")
    few = needed.count() <= BROADCAST_KEYS
    texts = cut(keyed.join(F.broadcast(needed) if few else needed.hint("merge"), "key").groupBy("node").agg(F.first("text").alias("text")), "texts")
    drop(needed)
    return texts


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents' columns, hushframe_class (its smallest key) and hushframe_root (the class itself: keys of different texts may be equal).

    Columns named like these two are replaced.
    """
    names = [x for x in docs.columns if x not in ("hushframe_class", "hushframe_root")]
    inner = docs.select(*(F.col(f"`{x}`").alias(f"hf_c{i}") for i, x in enumerate(names)))
    id_, body = (f"hf_c{names.index(x)}" for x in (key, text))
    nodes = nodes_of(inner, body)
    roots = roots_of(inner, nodes, text=body)
    root = cut_small(nodes.join(roots, "node", "left").select(F.col("key").alias("hf_key"), "node", F.coalesce("root", "node").alias("root")), "root_of_text")
    ids = inner.select(F.col(id_).alias("id"), text_key(body).alias("hf_key")).join(root, "hf_key")
    least = ids.groupBy("root").agg(F.min("id").alias("class"))
    named = cut(root.join(least, "root").select("hf_key", F.col("root").alias("hushframe_root"), F.col("class").alias("hushframe_class")), "class_of_text")
    drop(root)
    rows = inner.withColumn("hf_key", text_key(body)).join(named, "hf_key")
    return rows.select(*inner.columns, "hushframe_class", "hushframe_root").toDF(*names, "hushframe_class", "hushframe_root")


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, columns as they were: one of the rows with the class's smallest key.

    A document with a null key stays only if all keys of its class are null.
    """
    inner = {x: f"hf_d{i}" for i, x in enumerate(docs.columns)}
    out = classes(docs.toDF(*inner.values()), key=inner[key], text=inner[text])
    # A class has as many rows here as rows share its smallest key.
    heads = out.where(F.col(inner[key]).eqNullSafe(F.col("hushframe_class")))
    return heads.dropDuplicates(["hushframe_root"]).select(*inner.values()).toDF(*docs.columns)


def op4_order_minhash(spark, sf_dir: str) -> DataFrame:
    """Every document with its class of near-duplicates, and whether it is the one to keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(docs).select("doc_id", F.col("hushframe_class").alias("class_id"), (F.col("doc_id") == F.col("hushframe_class")).alias("kept"))
