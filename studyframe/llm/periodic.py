"""Periodic runs of words: Lyndon arrays by Baier's grouping under both orders, roots extended by longest common extensions.

A run is a maximal stretch of words with smallest period q. Each run of at least two periods holds, in one of the two orders of the alphabet, a Lyndon word of length q that is the longest
Lyndon word at its place (Bannai and others, "The runs theorem"). The first phase of Baier's suffix sorter groups positions by that longest Lyndon word: groups are taken from the highest
down; each member lengthens the context of the nearest position before it in a lower group, which moves to a group of its own just above its old one. Its group at the
time it is taken gives the length, so the Lyndon array comes without any sorted suffix, in time linear in the words. Roots are then extended to both sides, all at once, by
halving steps over prefix hashes modulo two primes, and every run found is compared word by word.

Only runs of at least LEAST_LENGTH words and LEAST_PERIODS periods are wanted. A word that occurs fewer than LEAST_PERIODS times in its text lies in none of them and can't lengthen one, so texts
are cut at such words first, which loses nothing.

Cases: null and empty texts and texts without words have no runs and collapse to the empty text; a text of any length is one row, in memory linear in its words; repeated rows and tied or null ids each
give a row; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_LENGTH, LEAST_PERIODS = 6, 4
#: Characters of text whose runs are searched together.
CHUNK = 2_000_000
#: Prime and base of each of the two hashes.
_HASHES = ((2**31 - 1, 1_103_515_245), (2**31 - 19, 1_566_083_941))


def lyndon_lengths(symbols: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place. Symbol 0 separates stretches that have nothing to do with each other; its own entries are 0."""
    n = len(symbols)
    names, group = np.unique(symbols, return_inverse=True)
    barrier = bool(n) and names[0] == 0
    members = [m.tolist() for m in np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group))[:-1])] if n else []
    group = group.tolist()
    context = [1] * len(names)
    lower, upper = list(range(-1, len(names) - 1)), [*range(1, len(names)), -1]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    length = [0] * n
    if barrier:
        for i in members[0]:
            group[i] = -1  # never joined to anything
    g = len(names) - 1
    while g >= int(barrier):
        size, last, count, moved = context[g], -1, 0, {}
        for i in members[g]:
            if group[i] != g:
                continue  # has moved to a higher group
            length[i] = size
            # i leaves the list of places; what stays before it lies in a lower group
            p, q = before[i], after[i]
            if q < n:
                before[q] = p
            if p >= 0:
                after[p] = q
                if p == last:
                    count += 1
                else:
                    if last >= 0 and group[last] >= 0:
                        moved.setdefault((count, group[last]), []).append(last)
                    last, count = p, 1
        if last >= 0 and group[last] >= 0:
            moved.setdefault((count, group[last]), []).append(last)
        # the more often it is followed by this context, the higher the new group
        for count, h in sorted(moved, reverse=True) if len(moved) > 1 else moved:
            new, above = len(context), upper[h]
            context.append(context[h] + count * size)
            lower.append(h)
            upper.append(above)
            upper[h] = lower[above] = new
            members.append(moved[count, h])
            for p in moved[count, h]:
                group[p] = new
        members[g] = ()
        g = lower[g]
    return np.array(length, np.int64)


class _Extensions:
    """Longest common extensions of pairs of places, for many pairs at once."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.tables = []
        for prime, base in _HASHES:
            powers = np.ones(self.n + 1, np.int64)
            filled = 1
            while filled <= self.n:
                more = min(filled, self.n + 1 - filled)
                powers[filled:filled + more] = powers[:more] * pow(base, filled, prime) % prime
                filled += more
            values = (symbols * 2_654_435_761 + 97) % prime
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(values * powers[:-1] % prime)]) % prime
            self.tables.append((prime, powers, sums))

    def equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Whether the ``size`` symbols from i and from j > i are the same."""
        same = np.ones(len(i), bool)
        for prime, powers, sums in self.tables:
            left = (sums[i + size] - sums[i]) % prime * powers[j - i] % prime
            same &= left == (sums[j + size] - sums[j]) % prime
        return same

    def _longest(self, most: np.ndarray, holds) -> np.ndarray:
        found = np.zeros(len(most), np.int64)
        step = 1 << max(int(most.max(initial=0)), 1).bit_length()
        while step:
            at = np.flatnonzero(found + step <= most)
            found[at[holds(at, found[at], step)]] += step
            step >>= 1
        return found

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._longest(self.n - j, lambda at, done, step: self.equal(i[at] + done, j[at] + done, step))

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols before i and before j are the same."""
        return self._longest(i, lambda at, done, step: self.equal(i[at] - done - step, j[at] - done - step, step))


def _compared(symbols: np.ndarray, start: int, length: int, period: int) -> tuple[int, int, int]:
    """The run as found by comparing symbols; differs from the hashed one only after a collision."""
    end = start + length
    whole = np.array_equal(symbols[start:end - period], symbols[start + period:end])
    if whole and (start == 0 or symbols[start - 1] != symbols[start + period - 1]) and (end == len(symbols) or symbols[end] != symbols[end - period]):
        return start, length, period
    apart = np.flatnonzero(symbols[:-period] != symbols[period:])
    at = np.searchsorted(apart, start + length // 2)
    low = apart[at - 1] + 1 if at else 0
    return int(low), int((apart[at] if at < len(apart) else len(symbols) - period) - low + period), period


def find_runs(symbols: np.ndarray) -> np.ndarray:
    """(start, length, period) of the wanted runs, one row each; 0 separates stretches and is part of no run."""
    found = []
    if len(symbols):
        reach, top = _Extensions(symbols), int(symbols.max()) + 1
        for order in (symbols, np.where(symbols > 0, top - symbols, 0)):
            size = lyndon_lengths(order)
            # a wanted run repeats the first of its roots at least twice more
            i = np.flatnonzero((size > 0) & (np.arange(len(size)) + 2 * size <= len(size)))
            i = i[symbols[i] == symbols[i + size[i]]]
            i = i[reach.equal(i, i + size[i], size[i])]
            p = size[i]
            behind = reach.backward(i, i + p)
            length = behind + p + reach.forward(i, i + p)
            keep = length >= np.maximum(LEAST_LENGTH, LEAST_PERIODS * p)
            found.append(np.stack([i - behind, length, p], 1)[keep])
    some = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    return np.array([_compared(symbols, *map(int, r)) for r in some], np.int64).reshape(-1, 3)


def _stretches(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with a 0 behind each stretch that may hold a run, and the place of each symbol among the words."""
    if not len(ids):
        return ids, ids
    _, inverse, counts = np.unique(doc * (int(ids.max()) + 1) + ids, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] >= LEAST_PERIODS)
    if not len(at):
        return at, at
    edge = np.flatnonzero((np.diff(at) != 1) | (np.diff(doc[at]) != 0)) + 1
    begins, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(at)]])
    long = np.repeat(ends - begins >= LEAST_LENGTH, ends - begins)
    part = np.repeat(np.arange(len(begins)), ends - begins)[long]
    at = at[long]
    last = np.flatnonzero(np.diff(part, append=-1) != 0) + 1
    return np.insert(np.unique(ids[at], return_inverse=True)[1] + 1, last, 0), np.insert(at, last, -1)


def _document_runs(texts: list[str | None]) -> list[tuple[int, list[tuple[int, int, int]], str]]:
    """Words, runs and collapsed text of each text."""
    # bytes.split() parts at exactly the ASCII white space
    words = [(t or "").encode().split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    flat = list(chain.from_iterable(words))
    names = {w: k for k, w in enumerate(dict.fromkeys(flat))}
    ids = np.fromiter(map(names.__getitem__, flat), np.int64, len(flat))
    symbols, place = _stretches(ids, np.repeat(np.arange(len(words)), sizes))
    runs = find_runs(symbols)
    start = place[runs[:, 0]] if len(runs) else runs[:, 0]
    lost = np.zeros(len(flat) + 1, np.int64)
    np.add.at(lost, start + runs[:, 2], 1)
    np.add.at(lost, start + runs[:, 1], -1)
    lost = np.cumsum(lost) > 0
    doc = np.searchsorted(first, start, "right") - 1
    order = np.lexsort([runs[:, 2], start])
    out = [(len(w), [], "") for w in words]
    for k in order:
        out[doc[k]][1].append((int(start[k] - first[doc[k]]), int(runs[k, 1]), int(runs[k, 2])))
    for d, (n, found, _) in enumerate(out):
        kept = words[d] if not found else [w for w, gone in zip(words[d], lost[first[d]:first[d + 1]].tolist(), strict=True) if not gone]
        out[d] = n, found, b" ".join(kept).decode()
    return out


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            texts, size = [], 0
            while at + len(texts) < batch.num_rows and (not texts or size < CHUNK):
                texts.append(batch.column("text")[at + len(texts)].as_py())
                size += len(texts[-1] or "")
            found = _document_runs(texts)
            yield pa.record_batch([batch.column("doc_id").slice(at, len(texts)), pa.array([f[0] for f in found], pa.int64()),
                                   pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in f[1]] for f in found], _RUN),
                                   pa.array([f[2] for f in found], pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
            at += len(texts)


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of each text by start, then period, and the text without the words that a run repeats."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _search, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """Count, strongest run (greatest length over period; then first start, then least period) and hashes of the rows of ``runs``."""
    better = lambda a, b: ((b["length"] * a["period"] > a["length"] * b["period"])
                           | ((b["length"] * a["period"] == a["length"] * b["period"]) & (F.struct(b["start"], b["period"]) < F.struct(a["start"], a["period"]))))
    best = F.when(F.size("runs") > 0, F.reduce("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a)))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def with_planted_cycles(docs: DataFrame) -> DataFrame:
    """``docs`` with a cycle of words in the texts whose crc32(doc_id) is a multiple of 10: from word a on, the p words from a repeat to the end."""
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    split = docs.withColumn("_h", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).select("doc_id", "text", F.expr("_h div 10").alias("g"), F.when(F.col("_h") % 10 == 0, words).alias("w"))
    sized = split.withColumn("n", F.size("w")).withColumn("a", F.expr("CAST(CASE WHEN n > 0 THEN g % n END AS INT)")).withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)"))
    cycle = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), CAST(1 + (n - a) div p AS INT))), 1, n - a)")
    return sized.select("doc_id", F.when(F.col("n") > 0, F.concat_ws(" ", F.expr("slice(w, 1, a)"), cycle)).otherwise(F.col("text")).alias("text"))
