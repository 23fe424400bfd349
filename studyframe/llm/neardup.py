"""Near-duplicate documents: DartMinHash signatures, banded joining, exact verification.

Signatures. Every element of a weighted set owns a strip of the plane, as wide as its weight, with rank running upwards. Darts are thrown by hashing: each unit cell of
a strip gets a Poisson(1) number of them, each with a rank and one of K coordinates. A set keeps the darts below a rank at which about K ln K + 2K darts are expected
(so the work is the number of elements plus that constant, not their product), and of each coordinate the earliest. If a coordinate is
empty the rank bound is doubled. Two sets agree in a coordinate with the probability of their weighted Jaccard similarity. Here elements are five-word shingles, with weight 1 (or
their counts).

Joining. ROWS coordinates make a band, BANDS bands a document; a pair at 0.8 is missed with probability (1 - 0.8^6)^42 < 3e-6. Exact copies are one node
by their digest. In rounds, every node is compared with one leader of its buckets, and only buckets that still hold several classes go on. The leader is first the node with the
most bucket mates, which is the copy with the fewest edits of its own, and in later rounds drawn by that number; so a group of any size is joined with about one comparison a node, also where most of its copies are
too far from each other. When few tries succeed, the buckets left are compared across classes, so that no link between classes is lost: small buckets pair by pair, larger ones by a prefix join on rare shingles, so
that no group is expanded into its pairs. Links are verified on the shingle sets. Classes are the connected components.

Words are white-space words, A-Z in lower case. Cases: null counts as the empty text; all empty texts are copies of each other; texts under five words have no shingles and only exact copies;
repeated rows and tied ids each give a row; an empty table gives no rows; other columns are ignored or passed on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyframe.llm import tokens
from studyframe.llm.components import apart, components, led
from studyframe.llm.work import handed_off, small_batches, spare

WIDTH, LEAST = 5, 0.8
ROWS, BANDS = 6, 42
K = ROWS * BANDS
#: Nodes that may be broadcast to pick their texts; beyond it they are joined.
BROADCAST_ROWS = 1_000_000
#: Buckets of more nodes are compared across classes by prefixes.
PAIRED = 24
#: Another round of leaders follows while more than one try in so many succeeds.
WORTH = 4
#: In rounds after the first a leader is drawn with its number of bucket mates to this power.
CENTRED = 4
#: Parts of a class when its values are joined to its texts.
SPLIT = 16
#: Cells thrown at together.
_CELLS = 50_000
_EMPTY = np.uint64(2**64 - 1)
_U = np.uint64


def _poisson_steps() -> np.ndarray:
    """A 64-bit hash above the n-th step means more than n darts."""
    p, total, out = math.exp(-1), 0.0, []
    for n in range(20):
        total += p
        out.append(min(total, 1 - 2**-53) * 2.0**64)
        p /= n + 1
    return np.array(out)


_STEPS = _poisson_steps()


def _throw(sig: np.ndarray, x: np.ndarray, row: np.ndarray, weight: np.ndarray, height: np.ndarray) -> None:
    """Darts of the elements up to ``height`` (whole ranks, by row) into ``sig``."""
    k = sig.shape[1]
    cells = weight * height[row]
    ends = np.cumsum(cells)
    a = 0
    while a < len(x):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _CELLS, "right")))
        owner = np.repeat(np.arange(a, b), cells[a:b])
        nr = np.arange(len(owner)) - np.repeat(ends[a:b] - cells[a:b] - (ends[a - 1] if a else 0), cells[a:b])
        tall = height[row[owner]]
        column, level = nr // tall, (nr % tall).astype(_U)
        cell = tokens.mix(x[owner] + column.astype(_U) * _U(0x9E3779B97F4A7C15) + level * _U(0xC2B2AE3D27D4EB4F))
        darts = np.searchsorted(_STEPS, tokens.mix(cell ^ _U(0x5851F42D4C957F2D)).astype(float), "right")
        for n in range(int(darts.max(initial=0))):
            at = np.flatnonzero(darts > n)
            h = tokens.mix(cell[at] + _U((n + 1) * 0x2545F4914F6CDD1D % 2**64))
            coordinate = ((h >> _U(32)) * _U(k)) >> _U(32)
            rank = (level[at] << _U(44)) | (tokens.mix(h) >> _U(20))
            np.minimum.at(sig.reshape(-1), row[owner[at]] * k + coordinate.astype(np.int64), rank)
        a = b


def signatures(x: np.ndarray, row: np.ndarray, n_rows: int, weight: np.ndarray | None = None, k: int = K) -> np.ndarray:
    """Signature of each row's weighted set; ``row`` ascends. Rows without elements keep the empty mark. Repeated elements of weight 1 count once."""
    sig = np.full((n_rows, k), _EMPTY)
    weight = np.ones(len(x), np.int64) if weight is None else weight
    total = np.bincount(row, weight, n_rows)
    height = np.ceil((k * math.log(max(k, 2)) + 2 * k) / np.maximum(total, 1)).astype(np.int64)
    todo = total > 0
    while todo.any():
        mine = todo[row]
        _throw(sig, x[mine], row[mine], weight[mine], height)
        todo &= (sig == _EMPTY).any(1)
        height = np.where(todo, height * 2, height)
    return sig


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salts = tokens.mix(np.arange(1, BANDS + 1, dtype=_U))
    for batch in batches:
        nodes = batch.column("node").to_numpy()
        for part in tokens.slices(batch.column("text"), most=tokens.SMALL_SLICE):
            s, row, _ = tokens.shingles(part.hash, part.row, WIDTH)
            if not len(s):
                continue
            some, row = np.unique(row, return_inverse=True)
            sig = signatures(s, row, len(some)).reshape(len(some), BANDS, ROWS)
            h = np.broadcast_to(salts, sig.shape[:2]).copy()
            for j in range(ROWS):
                h = tokens.mix(h ^ sig[:, :, j])
            yield pa.record_batch([pa.array(h.reshape(-1).view(np.int64)), pa.array(np.repeat(nodes[some + part.first], BANDS))], ["key", "node"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[bytes] = [b""] * batch.num_rows
        for part in tokens.slices(batch.column("text"), most=tokens.SMALL_SLICE):
            s, row, _ = tokens.shingles(part.hash, part.row, WIDTH)
            rows, first = np.unique(row, return_index=True)
            for r, own in zip(rows, np.split(s, first[1:]), strict=False):
                out[int(r) + part.first] = np.unique(own).tobytes()
        yield pa.record_batch([batch.column("node"), batch.column("digest"), pa.array(out, pa.binary())], ["node", "digest", "members"])


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sorted sets of 64-bit hashes."""
    x, y = np.frombuffer(a, _U), np.frombuffer(b, _U)
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common) if len(x) or len(y) else 0.0


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [similarity(a.as_py(), b.as_py()) for a, b in zip(batch.column("members_a"), batch.column("members_b"), strict=True)]
        more = [c for c in ("class_a", "class_b") if c in batch.schema.names]
        out = pa.record_batch([batch.column("digest_a"), batch.column("digest_b"), pa.array(got, pa.float64()), *map(batch.column, more)], ["a", "b", "similarity", *more])
        yield out.filter(pa.array([x >= LEAST for x in got], pa.bool_()))


def _nodes(docs: DataFrame) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", body.alias("text"), F.xxhash64(body).alias("node"), F.md5(body).alias("digest"))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda x: sets.select(F.col("node").alias(x), F.col("digest").alias(f"digest_{x}"), F.col("members").alias(f"members_{x}"))
    more = [c for c in ("class_a", "class_b") if c in pairs.columns]
    return (pairs.join(side("b"), "b").join(side("a"), "a").select("digest_a", "digest_b", "members_a", "members_b", *more)
            .mapInArrow(_verify, ", ".join(["a string, b string, similarity double", *[f"{c} long" for c in more]])))


def _across(met: DataFrame, node: str, kind: str, other: str, other_kind: str) -> DataFrame:
    """(a, b, class_a, class_b): pairs of nodes of two classes, each once."""
    x, y = (F.struct(F.col(n).alias("n"), F.col(c).alias("c")) for n, c in ((node, kind), (other, other_kind)))
    both = met.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
    return both.select(F.col("x.n").alias("a"), F.col("y.n").alias("b"), F.col("x.c").alias("class_a"), F.col("y.c").alias("class_b")).distinct()


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            own = np.frombuffer(batch.column("members")[i].as_py(), np.int64)
            take = pa.array(np.full(len(own), i))
            yield pa.record_batch([batch.column("node").take(take), batch.column("class").take(take), pa.array(np.full(len(own), len(own), np.int32)), pa.array(own)],
                                  ["node", "class", "size", "shingle"])


def _by_prefix(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, class_a, class_b): pairs of nodes of different classes that can have the wanted similarity, for groups too large to compare pair by pair.

    Each set is ordered by how many sets have a shingle, rare ones first. Two sets at the threshold share a shingle among the first fifth of both; and where
    they do, what is left behind it in both must still be enough. A copy with too many edits of its own begins with shingles that no other has, so it
    meets nobody.
    """
    full = nodes.join(sets, "node").select("node", "class", "members").mapInArrow(_explode, "node long, class long, size int, shingle long")
    full = handed_off(full, "shingles")
    often = full.groupBy("shingle").agg(F.count("*").alias("often")).filter("often > 1")
    # a shingle of its own counts for the order only by its number
    ordered = (full.join(often, "shingle").groupBy("node", "class", "size").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("order"))
               .withColumn("alone", F.col("size") - F.size("order")))
    first = F.floor(F.col("size") * (1 - LEAST) + 1e-9) + 1 - F.col("alone")
    prefix = (ordered.filter(first > 0).select("node", "class", "size", "alone", F.posexplode(F.slice("order", F.lit(1), first.cast("int"))).alias("at", "x"))
              .select("node", "class", "size", (F.col("size") - F.col("alone") - F.col("at")).alias("left"), F.col("x.shingle").alias("shingle")))
    prefix = handed_off(prefix, "prefixes")
    # most nodes of a shingle are of one class and needn't meet each other: one side of the join leaves that class out
    main = (prefix.groupBy("shingle", "class").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max_by("class", "n").alias("main"), F.count("*").alias("classes"))
            .filter("classes > 1").select("shingle", "main"))
    prefix = handed_off(prefix.join(main, "shingle"), "prefixes")
    other = prefix.filter("class <> main").select("shingle", *[F.col(c).alias(f"_{c}") for c in ("node", "class", "size", "left")])
    enough = F.least("left", "_left") >= F.ceil((F.col("size") + F.col("_size")) * (LEAST / (1 + LEAST)) - 1e-9)
    return _across(prefix.join(other, (prefix["shingle"] == other["shingle"]) & (F.col("class") != F.col("_class")) & enough), "node", "class", "_node", "_class")


def _with_mates(shared: DataFrame) -> DataFrame:
    """The rows of ``shared`` (key, node) with ``mates``: how many rows the buckets of the node hold."""
    size = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return shared.join(shared.join(size, "key").groupBy("node").agg(F.sum("n").alias("mates")), "node")


def _standing(turn: int) -> Column:
    """Nodes with the least value lead: those with the most mates, and after the first turn by a draw weighted with them."""
    if not turn:
        return -F.col("mates").cast("double")
    draw = (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    return -F.log(draw) / F.pow("mates", F.lit(float(CENTRED)))


def links(docs: DataFrame) -> DataFrame:
    """(a, b, similarity): verified links between different texts, by digest. They join each class; pairs within a joined group aren't listed."""
    with small_batches(docs.sparkSession):
        return _verified(_nodes(docs))


def _verified(nodes: DataFrame) -> DataFrame:
    rows = handed_off(nodes.select("node", "text").mapInArrow(_bands, "key long, node long"), "bands")
    # only buckets with more than one text go on
    several = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("key")
    shared = handed_off(rows.join(several, "key").distinct(), "buckets")
    wanted = handed_off(shared.select("node").distinct(), "wanted")
    picked = nodes.select("node", "digest", "text").join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "node", "left_semi")
    sets = picked.mapInArrow(_sets, "node long, digest string, members binary")
    sets = handed_off(sets.groupBy("node", "digest").agg(F.min("members").alias("members")), "sets")
    names, found, turn = sets.select("node", "digest"), None, 0
    left = apart(handed_off(_with_mates(shared), "mates"), None)
    while True:
        tried = handed_off(led(left.withColumn("standing", _standing(turn)), turn, first="standing"), "stars")
        fresh = handed_off(_links(tried, sets), "links")
        found = fresh if found is None else handed_off(found.unionAll(fresh).distinct(), "links")
        roots = components(found.select("a", "b"))
        # the least node of a class names it among the nodes
        placed = names.join(roots, names["digest"] == roots["vertex"]).select("node", "root")
        least = placed.groupBy("root").agg(F.min("node").alias("class"))
        left = apart(left.drop("class"), _spread_join(placed, least, "root", "node").groupBy("node").agg(F.min("class").alias("class")))
        if fresh.count() * WORTH <= tried.count():
            break
        turn += 1
    left = left.join(left.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    few = left.filter(F.col("n") <= PAIRED)
    other = few.select("key", F.col("node").alias("near"), F.col("class").alias("class_b"))
    across = _across(few.join(other, "key").filter("class < class_b"), "node", "class", "near", "class_b")
    many = left.filter(F.col("n") > PAIRED).select("node", "class").distinct()
    across = across.unionAll(_by_prefix(many, sets)).distinct()
    # two classes are joined by one link, however many there are between them
    linked = _links(across, sets).groupBy(F.least("class_a", "class_b"), F.greatest("class_a", "class_b")).agg(F.min(F.struct("a", "b", "similarity")).alias("x"))
    return found.unionAll(handed_off(linked.select("x.*"), "links")).distinct()


def _spread_join(rows: DataFrame, values: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join on a key that very many rows may share: each value is copied to SPLIT parts and the rows are dealt to them by ``by``."""
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(SPLIT)).cast("int"))
    copies = values.withColumn("_part", F.explode(F.array(*[F.lit(k) for k in range(SPLIT)])))
    return dealt.join(copies, [key, "_part"]).drop("_part")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size, digest, root): one row per document. class_id is the least id of the class, which other classes may have, too; root names one class."""
    roots = components(links(docs).select("a", "b"))
    members = handed_off(_nodes(docs).select("doc_id", "digest"), "members")
    texts = members.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    joined = handed_off(texts.join(roots, F.col("digest") == F.col("vertex")).select("digest", "root", "least", "n"), "joined")
    by_root = joined.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    placed = _spread_join(joined.select("digest", "root"), by_root, "root", "digest").select("digest", "root", "class_id", "class_size")
    named = texts.join(placed, "digest", "left").select(
        "digest", F.coalesce("root", "digest").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", "n").alias("class_size"))
    return members.join(named, "digest").select("doc_id", "class_id", "class_size", "digest", "root")


def kept(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the least id, with the columns the documents came with."""
    found = handed_off(classes(docs), "classes")
    digest, an_id, least = (spare(docs, x) for x in ("_digest", "_id", "_least"))
    stays = F.col("doc_id").eqNullSafe(F.col("class_id"))
    row = F.col("doc_id").alias(an_id), F.col("digest").alias(least)
    # if several rows have the least id of their class, one with the least digest stays; unlike classes may share an id, so they are told apart by their root
    many = (found.filter(stays).groupBy("root").agg(F.min("class_id").alias(an_id), F.min("digest").alias(least), F.count("*").alias("n"))
            .filter("n > 1").drop("n"))
    many = handed_off(many, "twins")
    beaten = found.filter(stays).join(many.select("root", F.col(least).alias("first")), "root").filter("digest <> first")
    gone = found.filter(~stays).select(*row).unionAll(beaten.select(*row)).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    full = docs.withColumn(digest, F.md5(F.coalesce("text", F.lit(""))))
    same_id, same_text = F.col("doc_id").eqNullSafe(F.col(an_id)), F.col(digest) == F.col(least)
    left = full.join(gone, same_id & same_text, "left_anti")
    if many.isEmpty():
        return left.select(*columns)
    single = left.join(many, same_id & same_text, "left_anti")
    # rows with one id and text may differ in other columns: the first of them as JSON stays
    nr = spare(full, "_nr")
    first = Window.partitionBy(F.col("doc_id"), F.col(digest)).orderBy(F.to_json(F.struct(*columns)))
    of_many = left.join(many, same_id & same_text, "left_semi").withColumn(nr, F.row_number().over(first)).filter(F.col(nr) == 1)
    return single.select(*columns).unionAll(of_many.select(*columns))
