"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, scored against memory-mapped shards.

Sharding. A bigram (v, w) belongs to the shard of the leading bits of both word hashes, so that even a word that is a third of the corpus spreads over a row or
column of shards. Tasks collect FLUSH tokens at a time, reduce them to distinct bigrams with the list of documents that hold each, and send one packed block to each shard; the
same blocks serve counting and scoring, so the corpus is shuffled once. Counting gives each shard its bigram counts, and partial sums by word: these meet by word
group, and each shard gets back the totals of its own words only.

Scoring. A worker writes its shard's sorted bigram hashes and counts to a temporary file, maps it into memory and unlinks it, looks up the shard's bigrams, and returns
sums by document, which are added up for each flush. The driver sees a handful of corpus totals.

Model. Counts come from the training documents only. With D1, D2, D3+ from the counts of counts, p(w | v) = (c(vw) - D) / c(v) + g(v) p(w), and p(w) is the same with
the number of different words before w in place of counts, over the V known words and one unknown.

Words are white-space words, A-Z in lower case; every text ends with an end token, and begins after a start mark. Cases: null and empty texts are the end token alone; without training documents every
token has the probability of the unknown word, 1; repeated rows and tied ids each give a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyframe.llm import tokens

#: Tokens a task reduces at a time.
FLUSH = 2_500_000
#: Text of a shard, and the most bits of a word's hash that may choose it: beyond 4 ** 7 shards they grow.
SHARD_CHARS, MAX_BITS = 16_000_000, 7
#: Bits of a word's place among those of a flush.
_PLACE = 24
_U = np.uint64
END, START = _U(0x7B1C6D2E3F4A5968), _U(0xB5A49382716F5E4D)
_BIG = _U(0x9FB21C651E98DF25)


def _key(shard: int) -> int:
    return shard


# --- blocks ---------------------------------------------------------------------------------------------------------------------------------

def _with_ends(part: tokens.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes, the token before each, and tokens of each row; every row gets an end token."""
    rows = len(part.offsets) - 1
    size = np.bincount(part.row, minlength=rows) + 1
    h = np.full(len(part.hash) + rows, END)
    h[np.arange(len(part.hash)) + part.row] = part.hash
    before = np.concatenate([[START], h[:-1]]) if len(h) else h
    before[np.cumsum(size) - size] = START
    return h, before, size


def _small(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the least type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _blocks(h: np.ndarray, before: np.ndarray, doc: np.ndarray, train: np.ndarray, bits: int) -> Iterator[tuple[int, tuple]]:
    """(shard, block). A block has the distinct first and second words, and for each bigram, ordered by second word, its words' places, how many tokens it has, and their documents."""
    words, place = np.unique(np.concatenate([h, before]), return_inverse=True)
    w, v = place[:len(h)].astype(np.int64), place[len(h):].astype(np.int64)
    group = (words >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)
    key = (group[w] << bits | group[v]) << 2 * _PLACE | w << _PLACE | v
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(first, append=len(key))
    shard = key[first] >> 2 * _PLACE
    w, v = key[first] >> _PLACE & (1 << _PLACE) - 1, key[first] & (1 << _PLACE) - 1
    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        uw, iw = np.unique(w[a:b], return_inverse=True)
        uv, iv = np.unique(v[a:b], return_inverse=True)
        low = first[a]
        high = first[b] if b < len(first) else len(key)
        yield int(shard[a]), (words[uw], _small(np.bincount(iw)), words[uv], _small(iv), _small(count[a:b]), _small(doc[low:high]), np.packbits(train))


def _emit(bits: int, shards: int):
    def emit(number: int, rows) -> Iterator[tuple[int, bytes]]:
        texts, ids, held, size, flush = [], [], [], 0, 0
        done: list[list[np.ndarray]] = []

        def take() -> None:
            """Turn the texts at hand into token arrays."""
            for part in tokens.slices(pa.array(texts, pa.large_string())):
                done.append(list(_with_ends(part)))
            texts.clear()

        def send() -> Iterator[tuple[int, bytes]]:
            nonlocal done, ids, held, flush
            h, before, sizes = (np.concatenate(x) for x in zip(*done, strict=True))
            train = ~np.array(held)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            for shard, block in _blocks(h, before, doc, train, bits):
                yield shard, pickle.dumps(("block", (number, flush), block), 5)
            yield (number * 31 + flush) % shards, pickle.dumps(("docs", (number, flush), (ids, train, sizes)), 5)
            done, ids, held, flush = [], [], [], flush + 1

        gathered = 0
        for row in rows:
            text = row[1] or ""
            texts.append(text)
            ids.append(row[0])
            held.append(bool(row[2]))
            size += len(text)
            if size >= tokens.SLICE_BYTES:
                take()
                gathered, size = sum(len(x[0]) for x in done), 0
                if gathered >= FLUSH:
                    yield from send()
        if texts:
            take()
        if done:
            yield from send()
    return emit


def _opened(block: tuple) -> tuple[np.ndarray, ...]:
    """(w, v, bigram hash, tokens, document of each token, training tokens) of a block."""
    uw, runs, uv, iv, count, doc, train = block
    w, v = np.repeat(uw, runs), uv[iv]
    count = count.astype(np.int64)
    trained = np.unpackbits(train)[doc].astype(np.int64)
    return w, v, tokens.mix(w * _BIG + v), count, doc, np.add.reduceat(trained, np.cumsum(count) - count)


def _by_shard(rows) -> dict[int, dict[str, list]]:
    out: dict[int, dict[str, list]] = {}
    for shard, packed in rows:
        kind, *rest = pickle.loads(packed)
        out.setdefault(shard, {}).setdefault(kind, []).append(rest)
    return out


# --- counting -------------------------------------------------------------------------------------------------------------------------------

def _counted(blocks: list) -> tuple[np.ndarray, ...]:
    """(bigram hash ascending, count, w, v) of a shard, unseen ones (count 0) included, and all its words as w and as v."""
    parts = [_opened(b)[i] for i in (0, 1, 2, 5) for _, b in blocks]
    n = len(blocks)
    w, v, pair, seen = (np.concatenate(parts[i * n:(i + 1) * n]) for i in range(4))
    pair, at, back = np.unique(pair, return_index=True, return_inverse=True)
    return pair, np.bincount(back, seen).astype(np.int64), w[at], v[at]


def _counts(bits: int):
    def count(rows) -> Iterator[tuple[tuple[str, int], tuple]]:
        for shard, kinds in _by_shard(rows).items():
            if "block" not in kinds:
                continue
            pair, c, w, v = _counted(kinds["block"])
            some = c > 0
            uw, iw = np.unique(w, return_inverse=True)
            uv, iv = np.unique(v, return_inverse=True)
            sums = [_small(np.bincount(iw, c).astype(np.int64)), _small(np.bincount(iw, some).astype(np.int64))]
            yield ("w", shard >> bits), (shard, uw, sums)
            classes = [np.bincount(iv, x, len(uv)).astype(np.int64) for x in (c, c == 1, c == 2, c > 2)]
            yield ("v", shard & (1 << bits) - 1), (shard, uv, [_small(x) for x in classes])
            yield ("total", 0), (shard, None, [np.bincount(np.minimum(c, 5), minlength=6)[1:5]])
    return count


def _added(groups) -> Iterator[tuple[int, bytes]]:
    """Totals by word of each group, sent back to the shards that asked, in the order of their own words; corpus totals go to -1."""
    for (kind, _), asked in groups:
        asked = sorted(asked, key=lambda x: x[0])
        if kind == "total":
            yield -1, ("pairs", sum(x[2][0] for x in asked))
            continue
        words, back = np.unique(np.concatenate([x[1] for x in asked]), return_inverse=True)
        sums = [np.bincount(back, np.concatenate([x[2][i] for x in asked])).astype(np.int64) for i in range(len(asked[0][2]))]
        if kind == "w":
            yield -1, ("words", np.array([sums[0].sum(), (sums[0] > 0).sum(), *np.bincount(np.minimum(sums[1], 5), minlength=6)[1:5], sums[1].sum(), (sums[1] > 2).sum()]))
        for shard, own, _ in asked:
            at = np.searchsorted(words, own)
            yield shard, pickle.dumps((kind, [_small(x[at]) for x in sums]), 5)


def discounts(n: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ from the numbers of things seen once to four times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not (n1 and n2 and n3):
        return np.array([0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0.05, 0.1, 0.15], [0.95, 1.9, 2.85])


# --- scoring --------------------------------------------------------------------------------------------------------------------------------

def _mapped(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays, from a file that is mapped into memory and has no name any more."""
    out = []
    for x in arrays:
        if not len(x):
            out.append(x)
            continue
        handle, name = tempfile.mkstemp(prefix="shard-")
        with os.fdopen(handle, "r+b") as f:
            x.tofile(f)
            f.flush()
            out.append(np.memmap(f, x.dtype, "r", shape=x.shape))
        os.unlink(name)
    return out


def _scores(totals: dict):
    pair_discounts, word_discounts, words = totals["D2"], totals["D1"], totals["words"]
    known, types, bottom = words[1], words[6], words[0] + words[1] + 1.0
    spare = (word_discounts @ [words[2], words[3], words[7]]) / types if types else 1.0

    def score(rows) -> Iterator[tuple[tuple[int, int], tuple]]:
        for _, kinds in _by_shard(rows).items():
            for flush, docs in kinds.get("docs", ()):
                yield flush, ("docs", docs)
            if "block" not in kinds:
                continue
            pair, c, w, v = _counted(kinds["block"])
            uw, uv = np.unique(w), np.unique(v)
            cw, kinds_before = (x.astype(np.int64) for x in kinds["w"][0][0])
            cv, n1, n2, n3 = (x.astype(float) for x in kinds["v"][0][0])
            single = np.maximum(kinds_before - np.concatenate([[0], word_discounts])[np.minimum(kinds_before, 3)], 0) / max(types, 1) + spare / (known + 1)
            rest = np.divide(pair_discounts[0] * n1 + pair_discounts[1] * n2 + pair_discounts[2] * n3, cv, out=np.ones_like(cv), where=cv > 0)
            taken = c - np.concatenate([[0], pair_discounts])[np.minimum(c, 3)]
            pair, taken = _mapped(pair, taken)
            for flush, block in kinds["block"]:
                w, v, wanted, count, doc, _ = _opened(block)
                iw, iv = np.searchsorted(uw, w), np.searchsorted(uv, v)
                part = np.divide(taken[np.searchsorted(pair, wanted)], cv[iv], out=np.zeros(len(w)), where=cv[iv] > 0)
                value = np.log10(part + rest[iv] * single[iw])
                base, seen = np.log10((cw[iw] + 1.0) / bottom), cw[iw] > 0
                own = np.repeat(np.arange(len(w)), count)
                some = np.unique(doc)
                at = np.searchsorted(some, doc)
                yield flush, ("sums", _small(some), _small(np.bincount(at, seen[own]).astype(np.int64)), np.bincount(at, base[own]), np.bincount(at, value[own]))
    return score


def _joined(totals: dict):
    n = int(totals["words"][0])

    def join(groups) -> Iterator[tuple]:
        for _, parts in groups:
            ids, train, sizes = next(x[1] for x in parts if x[0] == "docs")
            seen, base, score = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))
            for _, some, k, b, s in sorted((x for x in parts if x[0] == "sums"), key=lambda x: x[4].tobytes()):
                seen[some] += k
                base[some] += b
                score[some] += s
            for i, x in enumerate(ids):
                yield x, not train[i], int(sizes[i]), int(seen[i]), n, float(base[i]), float(score[i])
    return join


def score(docs: DataFrame, held_out: Column, bits: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document, learning from those that aren't held out.

    ``bits``: leading bits of each word's hash that choose the shard, so 4 ** bits shards; by default as many as hold SHARD_CHARS of text each, with MAX_BITS at most.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held")).rdd
    if bits is None:
        chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        bits = min(MAX_BITS, (int(chars // SHARD_CHARS).bit_length() + 1) // 2)
    shards = 4 ** bits
    blocks = rows.mapPartitionsWithIndex(_emit(bits, shards)).partitionBy(shards, _key)
    answers = blocks.mapPartitions(_counts(bits)).groupByKey(min(shards, 2 * 2 ** bits + 1)).mapPartitions(_added)
    totals: dict = {"words": np.zeros(8), "pairs": np.zeros(4)}
    for _, (kind, x) in answers.filter(lambda x: x[0] < 0).collect():
        totals[kind] = totals[kind] + x
    totals |= {"D1": discounts(totals["words"][2:6]), "D2": discounts(totals["pairs"])}
    with_answers = blocks.union(answers.filter(lambda x: x[0] >= 0).partitionBy(shards, _key))
    sums = with_answers.mapPartitions(_scores(totals)).groupByKey(max(rows.getNumPartitions(), 1)).mapPartitions(_joined(totals))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return spark.createDataFrame(sums, schema, verifySchema=False)
