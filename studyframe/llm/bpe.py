"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of the tree hold the merge rank of each adjacent pair together with its place; an inner node holds the lesser of its children, so the root is the
leftmost pair of lowest rank. A merge changes three leaves and the nodes above them, and merging ends when the root holds no mergeable pair: a run of n
characters without a space costs n log n. Short runs, which are nearly all, are merged many at a time: their trees are the rows of one array. Runs are
independent of each other, so Spark splits the documents and each worker keeps a store of runs it has seen, bounded in bytes, and reads, encodes and hands on a bounded piece of a batch at a time. The vocabulary file (fixed, about 2 MB) is read once on the driver and broadcast.

Cases: null and empty texts have no tokens and decode to the empty text; texts may be of any length; repeated rows and tied ids each give a row; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of runs a worker remembers; beyond half of it, the older half goes.
STORE_BYTES = 32 << 20
#: Bytes a run takes besides its letters, ids and token texts.
RUN_BYTES = 320
#: Characters of text that are read, encoded and handed on together.
CHUNK = 500_000
#: Tree widths for runs merged together; longer ones have a tree each.
WIDTHS = (8, 16, 32, 64)
_NONE = 1 << 62
_PLACE = (1 << 40) - 1


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it prints, else the next free one from U+0100."""
    shows = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shows]
    return [chr(b if b in shows else 0x100 + hidden.index(b)) for b in range(256)]


#: Ids of a run as 32-bit numbers in a byte string, and its token texts.
Run = tuple[bytes, str]


class Vocabulary:
    """Ids, merge ranks and splitting rules of a tokenizer file of the word-end kind."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.end = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.added.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.run = regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.letters = byte_letters()
        self.store: dict[str, Run] = {}
        self.older: dict[str, Run] = {}
        self.held = 0
        pairs = np.array([a << 20 | b for a, b in self.merges], np.int64)
        order = np.argsort(pairs)
        self._pairs = pairs[order]
        self._ranks, self._new = np.array(list(self.merges.values()), np.int64).reshape(-1, 2)[order].T.copy()
        self._by_rank = np.zeros(int(self._ranks.max(initial=0)) + 1, np.int64)
        self._by_rank[self._ranks] = self._new
        self._byte, self._last = (np.array([self.ids.get(x + e, -1) for x in self.letters], np.int64) for e in ("", self.end))

    def merged(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges."""
        n = len(symbols)
        if n < 2:
            return symbols
        merges, size = self.merges, 1 << (n - 2).bit_length()
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            if found := merges.get((symbols[i], symbols[i + 1])):
                tree[size + i] = found[0] << 40 | i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int) -> None:
            """Set the leaf of the pair that starts at i, and the nodes above it."""
            found = merges.get((symbols[i], symbols[after[i]])) if after[i] < n else None
            k, value = size + i, found[0] << 40 | i if found else _NONE
            tree[k] = value
            while k > 1:
                other = tree[k ^ 1]
                k >>= 1
                value = value if value < other else other
                if tree[k] == value:
                    break
                tree[k] = value

        while tree[1] != _NONE:
            i = tree[1] & _PLACE
            j = after[i]
            symbols[i] = merges[symbols[i], symbols[j]][1]
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            after[j] = n
            if j < n - 1 or size + j < 2 * size:
                put(j)
            put(i)
            if before[i] >= 0:
                put(before[i])
        out, i = [], 0
        while i < n:
            out.append(symbols[i])
            i = after[i]
        return out

    def encode_run(self, run: str) -> Run:
        letters = [self.letters[b] for b in run.encode()]
        letters[-1] += self.end
        ids = self.merged([self.ids[x] for x in letters])
        return np.array(ids, np.int32).tobytes(), self.decode(ids)

    def _keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Tree entries of adjacent pairs: merge rank, then place."""
        wanted = left << 20 | right
        at = np.minimum(np.searchsorted(self._pairs, wanted), len(self._pairs) - 1)
        return np.where((self._pairs[at] == wanted) & (right >= 0), self._ranks[at] << 8 | place, _NONE)

    def _merged_together(self, data: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of at most ``width`` bytes, one after the other, and how many each has. Row r of ``tree`` is the segment tree of run r."""
        n = len(sizes)
        symbols = np.full((n, width + 1), -1, np.int64)
        alive = np.arange(width + 1)[None, :] < sizes[:, None]
        symbols[alive] = self._byte[data]
        rows = np.arange(n)
        symbols[rows, sizes - 1] = self._last[data[np.cumsum(sizes) - 1]]
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        tree = np.full((n, 2 * width), _NONE)
        tree[:, width:] = self._keys(symbols[:, :-1], symbols[:, 1:], np.arange(width)[None, :])
        for k in range(width - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        while len(rows := rows[tree[rows, 1] != _NONE]):
            root = tree[rows, 1]
            i = root & 255
            j = after[rows, i]
            k = after[rows, j]
            h = before[rows, i]
            symbols[rows, i] = self._by_rank[root >> 8]
            symbols[rows, j] = -1
            alive[rows, j] = False
            after[rows, i] = k
            inside = k <= width
            before[rows[inside], k[inside]] = i[inside]
            held = h >= 0
            tree[rows, width + j] = _NONE
            tree[rows, width + i] = self._keys(symbols[rows, i], np.where(inside, symbols[rows, np.minimum(k, width)], -1), i)
            tree[rows[held], width + h[held]] = self._keys(symbols[rows[held], h[held]], symbols[rows[held], i[held]], h[held])
            for place in (j, i, np.where(held, h, i)):
                node = (width + place) >> 1
                while node[0]:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node >> 1
        return symbols[alive], alive.sum(1)

    def encode_runs(self, runs: list[str]) -> list[Run]:
        """Ids and token texts of each run."""
        parts = [r.encode() for r in runs]
        sizes = np.array([len(x) for x in parts], np.int64)
        out: list[Run | None] = [None] * len(runs)
        low = 0
        for width in WIDTHS:
            mine = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            if len(mine):
                ids, counts = self._merged_together(np.frombuffer(b"".join([parts[m] for m in mine]), np.uint8), sizes[mine], width)
                packed, at = ids.astype(np.int32).tobytes(), 0
                shown = [self.names[i] for i in ids.tolist()]
                for m, n in zip(mine.tolist(), counts.tolist(), strict=True):
                    out[m] = packed[4 * at:4 * (at + n)], " ".join(shown[at:at + n])
                    at += n
        return [self.encode_run(runs[k]) if x is None else x for k, x in enumerate(out)]

    def _runs(self, text: str) -> list[str]:
        """The runs of a text in small letters; added tokens stay as they are."""
        out = []
        for part in self.special.split(text) if self.special and "<" in text else (text,):
            if part in self.added:
                out.append(part)
            else:
                # letter by letter, a capital sigma has one small form
                out += self.run.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out

    def encode_all(self, texts: list[str]) -> Iterator[list[Run]]:
        """For each text, the ids and token texts of its runs."""
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= CHUNK:
                size += len(texts[end])
                end += 1
            runs = [self._runs(t) for t in texts[at:end]]
            new = set(chain.from_iterable(runs)).difference(self.store)
            fresh = {x: self.older[x] for x in new.intersection(self.older)}
            fresh |= {x: (np.int32(self.added[x]).tobytes(), x) for x in new.intersection(self.added)}
            rest = sorted(new.difference(fresh))
            fresh.update(zip(rest, self.encode_runs(rest), strict=True))
            self.store |= fresh
            for r in runs:
                yield list(map(self.store.__getitem__, r))
            for x in rest:
                if len(x) > 100:
                    del self.store[x], fresh[x]
            self.held += sum(RUN_BYTES + 2 * len(x) + len(r[0]) + len(r[1]) for x, r in fresh.items())
            if self.held > STORE_BYTES // 2:
                self.older, self.store, self.held = self.store, {}, 0
            at = end

    def encode(self, text: str) -> list[Run]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.names[i] for i in ids])


#: The vocabulary a worker used last, with its store.
_last: dict[str, Vocabulary] = {}


def _encoder(shared, hashed: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value not in _last:
            _last.clear()
            _last[shared.value] = Vocabulary(shared.value)
        vocabulary = _last[shared.value]
        for batch in batches:
            at, sizes = 0, pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + CHUNK, "right")))
                texts = batch.column("text").slice(at, end - at).to_pylist()
                ids, decoded = [], []
                for runs in vocabulary.encode_all([t or "" for t in texts]):
                    ids.append(b"".join([r[0] for r in runs]))
                    text = " ".join([r[1] for r in runs])
                    decoded.append(hashlib.sha256(text.encode()).hexdigest() if hashed else text)
                starts = np.cumsum([0, *[len(x) // 4 for x in ids]])
                flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
                yield pa.record_batch([batch.column("doc_id").slice(at, end - at), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), flat), pa.array(decoded, pa.string())],
                                      ["doc_id", "ids", "decoded"])
                at = end
    return encode


def encode(docs: DataFrame, vocabulary_path: str, hashed: bool = False) -> DataFrame:
    """(doc_id, ids, decoded): the token ids of each whole text, and what they decode to; with ``hashed``, only its sha256 as ``decoded_sha256``."""
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(_encoder(shared, hashed), f"doc_id {kind}, ids array<int>, decoded string")
    return found.withColumnRenamed("decoded", "decoded_sha256") if hashed else found


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """Token counts and hashes of the ids and of the decoded text, and the columns named in ``more``."""
    decoded = F.col("decoded_sha256") if "decoded_sha256" in encoded.columns else F.sha2(F.col("decoded"), 256)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                          decoded.alias("decoded_sha256"), *more)
