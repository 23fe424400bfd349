"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are put into partitions by size: partition u holds those of more than u / 2 and at most u five-word shingles in a row. A long document would drown a short
item in a plain MinHash, so for each partition the document is seen as windows of 2u shingles, u apart; an item of the partition that occurs in the document
lies whole in one of them, where its similarity is at least a fifth (0.19 with a fifth of its shingles edited). Each of the 64 minima is a band of its own, so an item at the
containment threshold is missed with probability below 1e-5. Items of at most WHOLE shingles match only as a whole, so each is looked up by the hash of one of its
shingles and none is missed. What collides is verified by exact containment of the item's distinct shingles in the whole document, on the words themselves.

Items are the stated query set. They go to the tasks in blocks of bounded size (BLOCK_CHARS of text), one scan of the documents for each block, so nothing
broadcast grows with the data; documents aren't shuffled.

Words are runs of letters and digits in lower case. Cases: null, empty and short texts (under five words) have no shingle and match nothing, as items or documents; repeated items
or documents match row by row; empty tables give no rows; other columns are ignored or passed on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from studyframe.llm import tokens

WIDTH, LEAST = 5, 0.8
MINIMA = 64
#: Up to so many shingles, 0.8 of them is all of them.
WHOLE = 4
#: Characters of item text in a block.
BLOCK_CHARS = 8 << 20
_WORD = re.compile("[a-z0-9\x80-\U0010ffff]+")
_FACTORS = tokens.mix(np.arange(1, MINIMA + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_set(lower_text: str) -> set[str]:
    w = _WORD.findall(lower_text)
    return {" ".join(w[i:i + WIDTH]) for i in range(len(w) - WIDTH + 1)}


class Index:
    """MinHash minima of a block of items, by size partition, and one shingle of each of the shortest."""

    def __init__(self, items: list[tuple[object, str]]):
        texts = pc.utf8_lower(pa.array([t or "" for _, t in items], pa.large_string()))
        self.ids = [i for i, _ in items]
        self.sets = [shingle_set(t) for t in texts.to_pylist()]
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        by_part: dict[int, list[tuple[int, np.ndarray]]] = {}
        short: list[tuple[int, int]] = []
        for part in tokens.slices(texts, tokens.BY_LETTERS, tokens.SMALL_SLICE):
            s, row, _ = tokens.shingles(part.hash, part.row, WIDTH)
            for r in np.unique(row):
                own = s[row == r]
                if len(own) <= WHOLE:
                    short.append((int(own.min()), int(r) + part.first))
                else:
                    by_part.setdefault(1 << int(len(own) - 1).bit_length(), []).append((int(r) + part.first, own))
        short.sort()
        self.short = np.array([h for h, _ in short], np.uint64), np.array([i for _, i in short], np.int64)
        for u, members in by_part.items():
            minima = np.stack([(own[:, None] * _FACTORS).min(0) for _, own in members])
            order = np.argsort(minima, 0)
            numbers = np.array([i for i, _ in members])
            self.parts[u] = [(minima[order[:, k], k], numbers[order[:, k]]) for k in range(MINIMA)]

    def matches(self, column: pa.Array) -> list[tuple[int, int, int]]:
        """(row, item number, shingles in common) of the rows that hold an item."""
        lower = pc.utf8_lower(pc.fill_null(column, ""))
        found: set[tuple[int, int]] = set()
        for part in tokens.slices(lower, tokens.BY_LETTERS, tokens.SMALL_SLICE):
            s, row, _ = tokens.shingles(part.hash, part.row, WIDTH)
            if len(s):
                for u, minima in self.parts.items():
                    found.update((r + part.first, i) for r, i in _collisions(s, row, u, minima))
                if len(self.short[0]):
                    found.update((r + part.first, i) for r, i in _holders(s, row, *self.short))
        out, at, own = [], -1, set()
        for r, i in sorted(found):
            if r != at:
                at, own = r, shingle_set(lower[r].as_py())
            common = len(self.sets[i] & own)
            if common >= LEAST * len(self.sets[i]):
                out.append((r, i, common))
        return out


def _collisions(s: np.ndarray, row: np.ndarray, u: int, minima: list[tuple[np.ndarray, np.ndarray]]) -> set[tuple[int, int]]:
    """(row, item) pairs of which some window and the item share a minimum."""
    rows, first, count = np.unique(row, return_index=True, return_counts=True)
    blocks = -(-count // u)
    ends = np.cumsum(blocks)
    owner = np.repeat(np.arange(len(rows)), blocks)
    starts = first[owner] + u * (np.arange(ends[-1]) - (ends - blocks)[owner])
    joined = np.flatnonzero(owner[:-1] == owner[1:])
    out: set[tuple[int, int]] = set()
    for k in range(MINIMA):
        low = np.minimum.reduceat(s * _FACTORS[k], starts)
        low[joined] = np.minimum(low[joined], low[joined + 1])
        values, numbers = minima[k]
        a = np.searchsorted(values, low)
        hit = np.flatnonzero(values[np.minimum(a, len(values) - 1)] == low)
        for h in hit.tolist():
            x, b = int(a[h]), low[h]
            while x < len(values) and values[x] == b:
                out.add((int(rows[owner[h]]), int(numbers[x])))
                x += 1
    return out


def _holders(s: np.ndarray, row: np.ndarray, values: np.ndarray, numbers: np.ndarray) -> set[tuple[int, int]]:
    """(row, item) pairs of which the row has the item's shingle."""
    a, b = np.searchsorted(values, s), np.searchsorted(values, s, "right")
    return {(int(row[h]), int(i)) for h in np.flatnonzero(a < b) for i in numbers[a[h]:b[h]]}


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        if block and size + len(r["text"] or "") > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"] or "") + 64
    if block:
        yield block


def _finder(shared, item_type: pa.DataType):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            got = index.matches(batch.column("text"))
            sizes = [len(index.sets[i]) for _, i, _ in got]
            yield pa.record_batch([batch.column("doc_id").take(pa.array([r for r, _, _ in got], pa.int64())),
                                   pa.array([index.ids[i] for _, i, _ in got], item_type), pa.array([c for _, _, c in got], pa.int64()),
                                   pa.array(sizes, pa.int64()), pa.array([c / n for (_, _, c), n in zip(got, sizes, strict=True)], pa.float64())],
                                  ["doc_id", "item_id", "common", "item_shingles", "containment"])
    return find


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, common, item_shingles, containment) for every document that holds at least 0.8 of an item's shingles."""
    from pyspark.sql.pandas.types import to_arrow_type
    context = docs.sparkSession.sparkContext
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType
    schema = f"doc_id {kinds[0]}, item_id {kinds[1].simpleString()}, common long, item_shingles long, containment double"
    out = None
    for block in _blocks(items):
        part = docs.select("doc_id", "text").mapInArrow(_finder(context.broadcast(Index(block)), to_arrow_type(kinds[1])), schema)
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, with the columns they came with."""
    context = docs.sparkSession.sparkContext
    for block in _blocks(items):
        docs = docs.mapInArrow(_dropper(context.broadcast(Index(block))), docs.schema)
    return docs


def _dropper(shared):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[r for r, _, _ in shared.value.matches(batch.column("text"))]] = False
            yield batch.filter(pa.array(keep))
    return drop
