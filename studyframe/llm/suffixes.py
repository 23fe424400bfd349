"""Passages that repeat across documents, found with a sparse suffix array over word sequences.

Suffixes are kept only at content-selected positions: in every run of LENGTH words the run of SEED words with the least hash is a minimiser, and the suffix that begins there is
retained, about one for every 18 words. Equal passages of LENGTH words hold the same minimiser, so a suffix whose first SEED words no other document has is out at
once. Suffixes are ordered by their leading words (as a hash) in Spark's shuffle, where equal neighbours meet as partial minima and maxima of the document's node.

Extension. The runs of LENGTH words that a minimiser was least in form its region, and regions are compared whole, to the left and the right at once: an
equal region of another document is a repeat. Where only part of a region repeats, at the ends of a passage and around edits, the runs of LENGTH words in it
are compared one by one. Either way a place is reported exactly if it lies in a run of LENGTH words that another document has, too.

No group is ever gathered: every comparison is a pair of least and greatest node by key, combined before the shuffle, and a join back on the key, which adaptive
execution splits if one passage is in very many documents.

Words are white-space words, A-Z in lower case; positions count words. A document is an id with a text, and its node is the hash of both. Cases: null, empty and shorter texts have no run
and no rows; repeated rows are one document; different texts under one id, or without an id, are documents of their own, each with rows of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyframe.llm import tokens
from studyframe.llm.work import handed_off

LENGTH, SEED = 50, 16
#: Ids that may be broadcast to pick their texts; beyond it they are joined.
BROADCAST_ROWS = 1_000_000
_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1


class Prefix:
    """Hashes of any run of words, from running sums."""

    def __init__(self, h: np.ndarray):
        n = len(h) + 1
        self.down = np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, pow(_P, -1, 1 << 64), _U)]))
        up = np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, _P, _U)]))
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(h * up[:-1])])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return tokens.mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(_U))


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value in each run of ``width`` values."""
    at, span = np.arange(len(v)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[:len(at) - step], at[step:]
        at = np.where(v[left] <= v[right], left, right)
        span += step
    return at


def regions(h: np.ndarray, row: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(row, first run, last run, seed hash, region hash) of each minimiser; a run is named by its first word's place in ``h``."""
    if len(h) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(_U), none.astype(_U)
    prefix = Prefix(h)
    starts = np.arange(len(h) - seed + 1)
    seeds = prefix.of(starts, starts + seed)
    at = _least(seeds, length - seed + 1)
    whole = row[:len(at)] == row[length - 1:]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (row[1:len(at)] != row[:len(at) - 1])
    first = np.flatnonzero(whole & fresh)
    # a region ends where the next begins or its row's runs do
    last_of = np.flatnonzero(whole & np.concatenate([fresh[1:] | ~whole[1:], [True]]))
    return row[first], first, last_of, seeds[at[first]], prefix.of(first, last_of + length)


def _suffixes(length: int, seed: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, ids = batch.column("node"), batch.column("doc_id")
            for part in tokens.slices(batch.column("text")):
                row, a, b, s, r = regions(part.hash, part.row, length, seed)
                base = np.searchsorted(part.row, row)
                take = pa.array(row + part.first)
                yield pa.record_batch([nodes.take(take), ids.take(take), pa.array((a - base).astype(np.int32)), pa.array((b - base).astype(np.int32)),
                                       pa.array(s.view(np.int64)), pa.array(r.view(np.int64))],
                                      ["node", "doc_id", "low", "high", "seed", "region"])
    return find


def _runs(length: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, ids, wanted = batch.column("node"), batch.column("doc_id"), batch.column("parts")
            for part in tokens.slices(batch.column("text")):
                prefix = Prefix(part.hash)
                row, first = np.unique(part.row, return_index=True)
                for r, at in zip((row + part.first).tolist(), first.tolist(), strict=True):
                    parts = wanted[r].as_py()
                    own = np.concatenate([np.arange(x["low"], x["high"] + 1) for x in parts])
                    other = [y for x in parts for y in [x["other"]] * (x["high"] - x["low"] + 1)]
                    run = prefix.of(at + own, at + own + length)
                    take = pa.array(np.full(len(own), r))
                    yield pa.record_batch([nodes.take(take), ids.take(take), pa.array(other, pa.int64()), pa.array(own.astype(np.int32)), pa.array(run.view(np.int64))],
                                          ["node", "doc_id", "other", "low", "run"])
    return find


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one document has. A row with another node beside its own stands for both."""
    ids = ("node", "other") if "other" in rows.columns else ("node", "node")
    low, high = F.least(*[F.min(i) for i in ids]), F.greatest(*[F.max(i) for i in ids])
    return rows.groupBy(key).agg(low.alias("_a"), high.alias("_b")).filter("_a <> _b")


def _merged(parts: Column) -> Column:
    """Overlapping or touching (low, stop) spans of a sorted array become one."""
    empty = F.array().cast("array<struct<low:int,stop:int>>")

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last.low.alias("low"), F.greatest(last.stop, x.stop).alias("stop"))))
        return F.when((F.size(done) > 0) & (x.low <= F.try_element_at(done, F.lit(-1)).stop), grown).otherwise(F.concat(done, F.array(x)))
    return F.aggregate(parts, empty, step)


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, start, stop, n_words): the words of each document that lie in runs of ``length`` words which another document has, as maximal spans."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.xxhash64("doc_id", "text").alias("node"), "doc_id", "text")
    rows = texts.mapInArrow(_suffixes(length, seed), f"node long, doc_id {kind}, low int, high int, seed long, region long")
    likely = handed_off(rows.join(_shared(rows, "seed").select("seed"), "seed"), "suffixes")
    equal = handed_off(_shared(likely, "region"), "regions")
    whole = likely.join(equal.select("region"), "region").select("node", "doc_id", "low", (F.col("high") + length).alias("stop"))
    partial = likely.join(equal.select("region"), "region", "left_anti").withColumn("other", F.lit(None).cast("long"))
    # a part of a region may repeat a region that is whole elsewhere: one place of each such region takes part in the comparison for two of its documents
    stands = (likely.join(partial.select("seed").distinct(), "seed", "left_semi").join(equal, "region").filter(F.col("node") == F.col("_a"))
              .groupBy("region").agg(F.min(F.struct("node", "low", "high", F.col("_b").alias("other"))).alias("x")).select("x.*"))
    sides = partial.select("node", "low", "high", "other").unionAll(stands)
    edges = sides.groupBy("node").agg(F.sort_array(F.collect_set(F.struct("low", "high", "other"))).alias("parts"))
    edges = handed_off(edges, "edges")
    few = edges.count() <= BROADCAST_ROWS
    near = texts.join(F.broadcast(edges.select("node")) if few else edges.select("node"), "node", "left_semi")
    runs = near.join(edges, "node").mapInArrow(_runs(length), f"node long, doc_id {kind}, other long, low int, run long")
    runs = handed_off(runs, "runs")
    parts = runs.filter("other is null").join(_shared(runs, "run").select("run"), "run").select("node", "doc_id", "low", (F.col("low") + length).alias("stop"))
    spans = whole.unionAll(parts).groupBy("node", "doc_id").agg(F.sort_array(F.collect_set(F.struct("low", "stop"))).alias("parts"))
    found = spans.select("doc_id", F.explode(_merged(F.col("parts"))).alias("span"))
    return found.select("doc_id", F.col("span.low").cast("long").alias("start"), F.col("span.stop").cast("long").alias("stop"),
                        (F.col("span.stop") - F.col("span.low")).cast("long").alias("n_words"))
