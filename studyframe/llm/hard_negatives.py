"""Hard negatives of labelled vectors by a secondary-sort shuffle.

An anchor's positives are the best-scored other rows of its label; a positive opens the window of scores from LOW to HIGH percent of its own, and the first rows of other labels in the window
are its negatives. Pair scores travel packed into one key of (anchor, descending score, positives first, id). repartitionAndSortWithinPartitions brings the pairs of an anchor into one
partition in that order, so an iterator over the partition sees each positive before the negatives of its window, keeps at most POSITIVES open windows and emits negatives as they pass: no anchor's pairs
are ever held together.

Pairs are made in the cells of a grid: anchors in blocks of BLOCK_BYTES, rows in blocks of CELL_ROWS, both dealt by hash, so no cell depends on how many rows share a label or a vector. Only pairs that can still matter leave a cell: for the
positives, each anchor's first POSITIVES rows of its label in the cell, and, once the positives are known, the first NEGATIVES rows of each window in the cell. Scores are exact integers: double arithmetic
while products stay below 2^53, 64-bit integers beyond, and an error beyond 2^63.

Cases: rows with a null id, label, vector or component take no part; repeated rows (same id, label and vector) count once; rows that share an id with other content are rows of their own and are never
partners of each other; a shorter vector counts as zeros beyond its end; equal scores go by the smaller id; anchors without positives, or windows without negatives, give no rows; a
positive with a score below zero has an empty window; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyframe.llm.work import handed_off

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
#: Rows of a cell, and bytes of the anchors of a cell (8 a component).
CELL_ROWS, BLOCK_BYTES = 4096, 32 << 20
#: Scores computed at once.
_STRIP = 1 << 22
_PACKED = struct.Struct(">QQQBQ")
_TOP = 1 << 63


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _width(table: pa.Table) -> int:
    return max((len(v) for v in table.column("vector")), default=0)


def _scores(a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """Inner products with all rows of b, a row of a at a time."""
    most = a.shape[1] * max(int(np.abs(a).max(initial=0)), 1) * max(int(np.abs(b).max(initial=0)), 1)
    if most >= _TOP:
        raise ValueError("inner products must fit 64-bit integers")
    kind = float if most < 1 << 53 else np.int64
    right = b.T.astype(kind)
    step = max(1, _STRIP // max(len(b), 1))
    for k in range(0, len(a), step):
        yield from (a[k:k + step].astype(kind) @ right).astype(np.int64)


def _sorted_by_id(rows: pa.Table) -> pa.Table:
    return rows.sort_by("id")


def _pairs_of(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Place of the anchor, its scores, which rows share its label, and which are none of its own."""
    width = max(_width(anchors), _width(rows))
    labels, ids = rows.column("label").to_numpy(), rows.column("id").to_numpy()
    own_label, own_id = anchors.column("label").to_numpy(), anchors.column("id").to_numpy()
    for k, score in enumerate(_scores(_matrix(anchors.column("vector"), width), _matrix(rows.column("vector"), width))):
        yield k, score, labels == own_label[k], ids != own_id[k]


def _first(score: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n places of ``at`` (ascending ids) with the highest scores; of equal scores, the first."""
    if len(at) > n:
        at = at[score[at] >= np.partition(score[at], len(at) - n)[len(at) - n]]
    return at[np.argsort(-score[at], kind="stable")[:n]]


def _positives(n: int):
    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = _sorted_by_id(rows)
        ids, who, found, scores = rows.column("id").to_numpy(), [], [], []
        for k, score, same, other in _pairs_of(anchors, rows):
            at = _first(score, np.flatnonzero(same & other), n)
            who.append(np.full(len(at), k))
            found.append(ids[at])
            scores.append(score[at])
        who, found, scores = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (who, found, scores))
        return pa.table([*(anchors.column(c).take(pa.array(who)) for c in ("id", "mark")), pa.array(scores), pa.array(found)], names=["id", "mark", "score", "positive"])
    return cell


def packed(anchor: int, mark: int, score: int, negative: int, other: int) -> bytes:
    """Sort key of a pair: its bytes order by anchor, descending score, positives before negatives, id."""
    return _PACKED.pack(anchor + _TOP, mark + _TOP, _TOP - 1 - score, negative, other + _TOP)


def unpacked(key: bytes) -> tuple[int, int, int, int, int]:
    anchor, mark, score, negative, other = _PACKED.unpack(key)
    return anchor - _TOP, mark - _TOP, _TOP - 1 - score, negative, other - _TOP


def _negatives(n: int, low: int, high: int):
    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = _sorted_by_id(rows)
        ids, keys = rows.column("id").to_numpy(), []
        own = list(zip(anchors.column("id").to_pylist(), anchors.column("mark").to_pylist(), anchors.column("opened").to_pylist(), strict=True))
        for k, score, same, other in _pairs_of(anchors, rows):
            anchor, mark, opened = own[k]
            # high first; each window is a range of the scores
            ranges = {(-(-low * p // 100), high * p // 100) for p in opened if p >= 0}
            if not ranges:
                continue
            near = np.flatnonzero(~same & other & (score >= min(r[0] for r in ranges)) & (score <= max(r[1] for r in ranges)))
            picked = set()
            for least, most in ranges:
                picked.update(_first(score, near[(score[near] >= least) & (score[near] <= most)], n).tolist())
            keys += [packed(anchor, mark, int(score[i]), 1, int(ids[i])) for i in picked]
        return pa.table([pa.array(keys, pa.binary())], names=["key"])
    return cell


def windows(keys: Iterator[bytes], negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor, positive, rank, negative, positive's score, negative's score) from the sorted keys of whole anchors."""
    current, open_ = None, []
    for key in keys:
        anchor, mark, score, negative, other = unpacked(key)
        if current != (anchor, mark):
            current, open_ = (anchor, mark), []
        if not negative:
            if score >= 0:
                open_.append([other, score, 0])
            continue
        for window in open_:
            if 100 * score <= high * window[1] and 100 * score >= low * window[1] and window[2] < negatives:
                window[2] += 1
                yield anchor, window[0], window[2], other, window[1], score
        open_ = [w for w in open_ if 100 * score >= low * w[1] and w[2] < negatives]


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (id, label, vector of integers); ``is_anchor`` is a condition on them."""
    spark = rows.sparkSession
    whole = rows.select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<long>")).filter(
        "id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL)")
    whole = handed_off(whole.distinct().withColumn("mark", F.xxhash64("label", "vector")), "vectors")
    anchors = whole.filter(is_anchor)
    size = whole.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(is_anchor, 8 * F.size("vector") + 32)), F.lit(0)).alias("bytes")).first()
    across, down = max(1, -(-size["bytes"] // BLOCK_BYTES)), max(1, -(-size["n"] // CELL_ROWS))
    # numbered cells, so that small ones aren't merged into one task
    tasks = min(across * down, 10_000)

    def dealt(df: DataFrame, block: Column, part: Column) -> DataFrame:
        return df.withColumns({"block": block}).withColumns({"part": part}).repartition(tasks, "block", "part").groupBy("block", "part")

    def cells(left: DataFrame, function, schema: str) -> DataFrame:
        key = F.xxhash64("id", "mark")
        held = dealt(left, F.pmod(key, F.lit(across)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))))
        # columns of its own: both sides come from one table
        met = dealt(whole.toDF(*whole.columns), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))), F.pmod(key, F.lit(down)))
        return held.cogroup(met).applyInArrow(function, schema)

    first = cells(anchors, _positives(positives), "id long, mark long, score long, positive long")
    rank = F.row_number().over(Window.partitionBy("id", "mark").orderBy(F.desc("score"), "positive"))
    first = handed_off(first.withColumn("_rank", rank).filter(F.col("_rank") <= positives).drop("_rank"), "positives")
    opened = first.groupBy("id", "mark").agg(F.collect_list("score").alias("opened"))
    pairs = cells(anchors.join(opened, ["id", "mark"]), _negatives(negatives, low, high), "key binary")
    keys = (pairs.rdd.map(lambda r: (bytes(r[0]), None))
            .union(first.rdd.map(lambda r: (packed(r["id"], r["mark"], r["score"], 0, r["positive"]), None))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:16]))
    return spark.createDataFrame(ordered.mapPartitions(lambda part: windows((k for k, _ in part), negatives, low, high)),
                                 "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def prepared(embeddings: DataFrame) -> DataFrame:
    """Rows (id, label, vector) of the table: components as floor(256 x), the label of every seventh id moved on by one; rows with a null or non-finite part are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").alias("id"), label.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"))


def sql() -> str:
    """The same over the table, as plain joins."""
    return f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
