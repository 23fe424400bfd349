"""Jaccard join of shingle sets: subsets of fixed size for small sets, scans of inverted lists for large ones.

A document's set holds its distinct five-word shingles (the whole word sequence as one if it is shorter). Documents with equal sets are one node. Two sets of sizes a and b link at 80 % if they share at least
t(a, b) = ceil(4 (a + b) / 9) elements, and their sizes differ by a quarter at most.

Small sets (below the boundary): for each size b that a partner may have, a set writes all its subsets of t(a, b) elements under the pair of sizes. All sets of the one size that write a
subset link with all of the other size that write it, so linking each to the least of the other side joins them all, with work linear in the subsets.

Large sets (and small ones that can link with them): inverted lists, in two steps. First, in the order of the element hashes a set writes K(s) = floor(s/5) + 1 + floor(s/10) elements. At most
s/5 of its elements are missing in a partner, so the written parts of two linked sets share at least 1 + floor(min(s)/10) elements: a set of whose written elements fewer are in another
set is out. The written elements cross the network once, ordered by element; what a task sees of an element in several sets at once it counts itself and sends two of its nodes, the least and the greatest,
so a passage in very many texts makes few rows. Second, of the sets left all elements are counted, and sets with more than s/5 elements of their own go, again and again until few do. The rest are scanned over the lists
of their rarest floor(s/5) + 1 elements, less those of their own; a pair meets in a list only if enough elements follow in both sets.

The scan knows the class that a node has already been joined to: first every node tries one leader, that of its lists with the fewest elements of its own, until few tries succeed; then each node
meets a few delegates of every larger class of its lists, 64 times more each round, until a round has met all of them. So a group of thousands of near copies needs about one comparison a
node, and still no link between two classes is lost. Every link is verified on the whole sets.

The boundary is the size at which subsets would cost more rows than lists, over the sizes that the table has (at most MOST_SMALL).

Words are white-space words with A-Z in lower case; equality of shingles, subsets and sets is that of 64-bit hashes. Cases: null and empty texts and texts without words have an empty set and link with nothing, not
even each other; a null id is no smallest id unless all ids of the component are null; tied ids and repeated rows each give a row; texts may be of any length; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyframe.llm import tokens
from studyframe.llm.components import apart, components, led, pairs
from studyframe.llm.work import handed_off, let_go, shuffles_let_go

WIDTH = 5
#: Bytes of text that a task hashes at once: arrays of some 30 times as much exist meanwhile, in as many workers as there are cores.
SLICE_BYTES = 1 << 19
#: Written elements that a task gathers from slice to slice, so that it counts there what several of their texts share.
GATHERED = 1 << 18
#: Sizes from here on are always scanned.
MOST_SMALL = 20
#: Rows that a node of a list costs: written, counted, met again.
LIST_COST = 3
#: Hashes (8 bytes each) that are broadcast to pick texts; more are joined.
BROADCAST_ROWS = 2_000_000
#: A round of leaders is followed by another one while more than one try in so many succeeds.
WORTH = 4
#: Where nodes of different classes have fewer meetings than this for each row of the lists, all of them are compared.
FEW = 4
#: Delegates of a class in a list grow by this factor.
GROWTH = 64
_U = np.uint64


def needed(a: int, b: int) -> int:
    """Elements that sets of these sizes share at least if they link."""
    return -(-4 * (a + b) // 9)


@cache
def partners(s: int) -> list[tuple[int, int]]:
    """(size, shared elements) of the sets that a set of size s can link with."""
    return [(b, needed(s, b)) for b in range(-(-4 * s // 5), 5 * s // 4 + 1) if needed(s, b) <= min(s, b)]


def boundary(sizes: dict[int, int]) -> int:
    """First size that is scanned, given how many sets there are of each size up to MOST_SMALL."""
    def cost(x: int) -> int:
        subsets = sum(n * math.comb(s, t) for s, n in sizes.items() if s < x for b, t in partners(s) if b < x)
        return subsets + sum(n * (LIST_COST * written(s) + s) for s, n in sizes.items() if 5 * s >= 4 * x)
    return min(range(1, MOST_SMALL + 2), key=lambda x: (cost(x), x))


def written(s):
    """Elements in hash order that a set of size s writes."""
    return s // 5 + 1 + s // 10


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row of a slice, then row and hash of each element, ordered by row and hash."""
    for part in tokens.slices(column, most=SLICE_BYTES):
        counts = np.bincount(part.row, minlength=len(part.offsets))
        some = [tokens.shingles(part.hash, part.row, WIDTH)]
        for n in range(1, WIDTH):
            of_n = counts[part.row] == n
            some.append(tokens.shingles(part.hash[of_n], part.row[of_n], n))
        h, row = (np.concatenate([x[k] for x in some]) for k in (0, 1))
        order = np.lexsort((h, row))
        h, row = h[order].astype(_U), row[order].astype(np.int64)
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        yield part.first, row[fresh], h[fresh]


def _named(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows that have a set, where each begins, its size and its node."""
    rows, start, size = np.unique(row, return_index=True, return_counts=True)
    total = np.add.reduceat(tokens.mix(h ^ _U(0xA24BAED4963EE407)), start) if len(start) else np.zeros(0, _U)
    return rows, start, size, tokens.mix(total + size.astype(_U) * _U(0x9FB21C651E98DF25)).view(np.int64)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, nodes, small = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), [np.zeros(0, _U)]
        for first, row, h in _sets(batch.column("text")):
            rows, _, size, node = _named(row, h)
            sizes[first + rows], nodes[first + rows] = size, node
            small.append(h[np.repeat(size <= MOST_SMALL, size)])
        ends = np.cumsum(np.where(sizes <= MOST_SMALL, sizes, 0))
        elements = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(np.concatenate(small).view(np.int64)))
        yield pa.record_batch([batch.column("doc_id"), batch.column("body"), pa.array(sizes), pa.array(nodes, mask=sizes == 0), elements],
                              ["doc_id", "body", "n_shingles", "node", "elements"])


def _subset_keys(elements: np.ndarray, lower: int, upper: int, t: int) -> np.ndarray:
    """Key of each subset of t of the elements of each row, for sets of these two sizes."""
    pick = np.array(list(combinations(range(elements.shape[1]), t)))
    spread = tokens.mix(elements ^ _U(0x589965CC75374CC3))
    return tokens.mix(spread[:, pick].sum(2, dtype=_U) ^ tokens.mix(np.array([lower << 32 | upper], _U)))


def _subsets(small: int):
    """Keys of the subsets of sets below the size ``small``, with the partner's size in ``other``."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes = batch.column("node").to_numpy(), batch.column("n_shingles").to_numpy()
            for s in np.unique(sizes).tolist():
                # copies in a batch are written once
                at = np.flatnonzero(sizes == s)
                at = at[np.unique(nodes[at], return_index=True)[1]]
                node = nodes[at]
                elements = batch.column("elements").take(pa.array(at)).flatten().to_numpy().view(_U).reshape(-1, s)
                for b, t in partners(s):
                    if b < small:
                        keys = _subset_keys(elements, min(s, b), max(s, b), t)
                        yield pa.record_batch([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(node, keys.shape[1])),
                                               pa.array(np.full(keys.size, s, np.int32)), pa.array(np.full(keys.size, b, np.int32))], ["key", "node", "size", "other"])
    return write


def _written(column: pa.Array, small: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Written elements of the sets from four fifths of the size ``small`` on, one set after the other, with each set's size and node; slices are gathered until they make GATHERED elements."""
    held, most = [], 0
    for _, row, h in _sets(column):
        _, start, size, node = _named(row, h)
        some = 5 * size >= 4 * small
        start, size, node = start[some], size[some], node[some]
        n = written(size)
        held.append((h[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())], size, node))
        most += n.sum()
        if most >= GATHERED:
            yield tuple(map(np.concatenate, zip(*held)))
            held, most = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _writer(small: int):
    """Rows (key, node, size, n) of the sets from four fifths of the size ``small`` on: their written elements with n = 0; n > 0 is a count of elements that are in other nodes,
    too, as seen here, which the least and the greatest of these nodes still write."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, size, node in _written(batch.column("text"), small):
                n = written(size)
                start = np.cumsum(n) - n
                # copies among them are written once
                some = np.unique(node, return_index=True)[1]
                start, size, node, n = start[some], size[some], node[some], n[some]
                key = key[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())]
                of = np.repeat(np.arange(len(node)), n)
                # nodes are in order here, so a stable sort by key leaves those of a key in order
                order = np.argsort(key, kind="stable")
                key, of = key[order], of[order]
                edge = np.ones(len(key) + 1, bool)
                edge[1:-1] = key[1:] != key[:-1]
                sent = edge[:-1] | edge[1:]
                known = np.bincount(of[~sent], minlength=len(node))
                more = np.flatnonzero(known)
                every = np.concatenate([of[sent], more])
                yield pa.record_batch([pa.array(np.concatenate([key[sent].view(np.int64), node[more]])), pa.array(node[every]), pa.array(size[every].astype(np.int32)),
                                       pa.array(np.concatenate([np.zeros(sent.sum(), np.int32), known[more].astype(np.int32)]))], ["key", "node", "size", "n"])
    return write


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, row, h in _sets(batch.column("text")):
            _, start, size, node = _named(row, h)
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(h)).astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.record_batch([pa.array(node), pa.array(size.astype(np.int32)), lists], ["node", "size", "members"])


def _body() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _small_pairs(subsets: DataFrame) -> DataFrame:
    """Pairs that join all sets of a common subset: each with the least set of the other size."""
    least = subsets.groupBy("key").agg(F.min(F.when(F.col("size") <= F.col("other"), F.col("node"))).alias("lower"),
                                       F.min(F.when(F.col("size") >= F.col("other"), F.col("node"))).alias("upper"),
                                       F.min("node").alias("one"), F.max("node").alias("two")).filter("one <> two AND lower IS NOT NULL AND upper IS NOT NULL")
    target = F.when(F.col("size") < F.col("other"), F.col("upper")).otherwise(F.col("lower"))
    return pairs(subsets.join(least.select("key", "lower", "upper"), "key").select("node", target.alias("near")))


def _candidates(rows: DataFrame) -> DataFrame:
    """Nodes enough of whose written elements are in another set, too; a node with copies may count an element more than once and stay."""
    by = Window.partitionBy("key", "n").orderBy("node")
    seen = rows.select("node", "size", "n", F.lead("node").over(by).alias("after"), F.first("node").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("first"))
    # the last row of a node of an element stands for it
    shared = seen.filter("n > 0 OR (after IS NULL OR after <> node) AND (after IS NOT NULL OR first <> node)")
    found = shared.groupBy("node", "size").agg(F.sum(F.greatest("n", F.lit(1))).alias("n"))
    return found.filter(F.col("n") > F.floor(F.ceil(F.col("size") * 4 / 5) / 10)).select("node")


def _elements(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, node, size, often): elements that another node has, too, of the nodes that can still link, with how many nodes have them."""
    rows = handed_off(sets.join(nodes, "node").select("node", "size", F.explode("members").alias("key")), "elements")
    while True:
        often = rows.groupBy("key").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
        met = handed_off(rows.select("key", "node", "size").join(often, "key"), "elements")
        let_go(rows)
        able = met.groupBy("node", "size").agg(F.count(F.lit(1)).alias("n"))
        able = handed_off(able.withColumn("stays", F.col("n") >= F.col("size") - F.floor(F.col("size") / 5)), "able")
        gone = able.filter("NOT stays").count()
        if not gone:
            return met
        rows = handed_off(met.join(able.filter("stays").select("node"), "node", "left_semi"), "elements")
        let_go(met)
        if gone * WORTH * WORTH <= able.count() - gone:
            often = rows.groupBy("key").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
            return rows.drop("often").join(often, "key")


def _lists(elements: DataFrame) -> DataFrame:
    """(key, node, size, left, own): inverted lists of the rarest elements of each node; ``left`` elements of the node follow from here on, and ``own`` are in no other node."""
    order = F.sort_array(F.collect_list(F.struct("often", "key")))
    met = elements.groupBy("node", "size").agg(order.alias("order")).withColumn("own", F.col("size") - F.size("order"))
    keep = (F.floor(F.col("size") / 5) + 1 - F.col("own")).cast("int")
    kept = met.withColumn("keep", keep).filter("keep > 0").select("node", "size", "own", F.size("order").alias("n"), F.posexplode(F.slice("order", F.lit(1), F.col("keep"))).alias("at", "x"))
    return kept.select(F.col("x.key").alias("key"), "node", "size", (F.col("n") - F.col("at")).alias("left"), F.floor(8 * F.col("own") / F.col("size")).alias("own"))


def _enough(left: str, other_left: str, other_size: str) -> Column:
    """Whether sets that first meet here can share as many elements as a link needs."""
    return F.least(left, other_left) >= F.ceil(4 * (F.col("size") + F.col(other_size)) / 9)


def _linked(tried: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; ``tried`` is a written table."""
    few = tried.count() <= BROADCAST_ROWS  # then only the sets that are tried are shuffled
    of = lambda x: sets.join(F.broadcast(tried.select(F.col(x).alias("node"))), "node", "left_semi") if few else sets
    side = lambda x: of(x).select(F.col("node").alias(x), F.col("members").alias(f"members_{x}"))
    common = F.size(F.array_intersect("members_a", "members_b"))
    both = F.size("members_a") + F.size("members_b")
    return (tried.join(side("b"), "b").join(side("a"), "a").select("a", "b", common.alias("common"), both.alias("sizes"))
            .filter("100 * common >= 80 * (sizes - common)").select("a", "b"))


def _delegated(lists: DataFrame, turn: int, most: int) -> DataFrame:
    """Each node with about ``most`` nodes of every class of its lists that is larger there; with all of them where a class has no more."""
    place = F.xxhash64("node", F.lit(turn))
    counts = lists.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    sized = lists.join(counts, ["key", "class"])
    chosen = (F.col("n") <= most) | (place == F.col("first")) | (F.pmod(place, F.col("n")) < most)
    sent = sized.filter(chosen).select("key", F.col("node").alias("near"), F.col("size").alias("wide"), F.col("left").alias("behind"), F.struct("n", "class").alias("larger"))
    fit = (F.struct("n", "class") < F.col("larger")) & _enough("left", "behind", "wide")
    return pairs(sized.join(sent, (sized["key"] == sent["key"]) & fit).select("node", "near"))


def links(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): verified links between nodes that join each component; links within what is already joined aren't all listed."""
    sizes = members.filter(F.col("n_shingles").between(1, MOST_SMALL)).groupBy("n_shingles").count().collect()  # at most MOST_SMALL rows
    small = boundary({r["n_shingles"]: r["count"] for r in sizes})
    below = members.filter(F.col("n_shingles").between(1, small - 1)).select("node", "n_shingles", "elements")
    subsets = handed_off(below.mapInArrow(_subsets(small), "key long, node long, size int, other int"), "subsets")
    small_pairs = handed_off(_small_pairs(subsets), "pairs")
    let_go(subsets)
    nodes = handed_off(_candidates(docs.select("text").mapInArrow(_writer(small), "key long, node long, size int, n int")), "candidates")
    wanted = nodes.unionAll(small_pairs.select("a")).unionAll(small_pairs.select("b")).distinct()
    bodies = handed_off(members.join(wanted, "node").groupBy("node").agg(F.min("body").alias("body")).select("body").distinct(), "wanted")
    picked = docs.select("text", _body().alias("body")).join(F.broadcast(bodies) if bodies.count() <= BROADCAST_ROWS else bodies, "body", "left_semi")
    sets = handed_off(picked.select("text").mapInArrow(_whole, "node long, size int, members array<long>").dropDuplicates(["node"]), "sets")
    found = handed_off(_linked(small_pairs, sets), "links")
    elements = _elements(sets, nodes)
    lists = apart(_lists(elements), None)
    let_go(elements)
    fresh, turn, most = found, 0, 0
    while True:
        if not fresh.isEmpty():
            before, lists = lists, _merged(lists, fresh)
            let_go(before)
        by_class = lists.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("widest"), F.sum(F.col("n") * F.col("n")).alias("within"))
        left = by_class.agg(F.max("widest").alias("widest"), F.sum("n").alias("rows"), F.sum((F.col("n") * F.col("n") - F.col("within")) / 2).alias("meetings")).first()
        if left["widest"] is None:
            return found
        if turn and left["meetings"] <= FEW * left["rows"]:
            most = left["widest"]  # so few that all can meet
        tried = handed_off(_delegated(lists, turn, most) if most else led(lists, turn, _enough("left", "lead.left", "lead.size"), "own"), "pairs")
        fresh = handed_off(_linked(tried, sets), "links")
        found = found.unionAll(fresh)
        if most >= left["widest"]:
            return found
        if most or fresh.count() * WORTH <= tried.count():
            most = most * GROWTH or 1
        turn += 1


def _merged(lists: DataFrame, fresh: DataFrame) -> DataFrame:
    """The lists with the classes that the fresh links join made one; lists of one class are gone."""
    classes = handed_off(lists.select("node", "class").distinct(), "classes")
    side = lambda x: classes.select(F.col("node").alias(x), F.col("class").alias(f"class_{x}"))
    edges = fresh.join(side("a"), "a").join(side("b"), "b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    roots = components(edges)
    named = classes.join(roots, classes["class"] == roots["vertex"], "left").select("node", F.coalesce("root", "class").alias("class"))
    return apart(lists.drop("class"), named)


def components_of(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest id of the documents that links reach."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    with shuffles_let_go(docs.sparkSession):
        members = handed_off(docs.select("doc_id", "text", _body().alias("body")).mapInArrow(_members, f"doc_id {kind}, body long, n_shingles long, node long, elements array<long>"), "members")
        roots = components(links(docs, members))
        least = members.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
        # joined nodes take the least id of their component
        joined = handed_off(least.join(roots, F.col("node") == F.col("vertex")).select("node", "root", "least"), "joined")
        by_root = joined.groupBy("root").agg(F.min("least").alias("component"))
    ids = least.join(joined.select("node", "root").join(by_root, "root").select("node", "component"), "node", "left").select("node", F.coalesce("component", "least").alias("component_id"))
    return members.join(ids, "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
