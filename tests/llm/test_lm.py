import math
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyframe.llm import lm
from studyframe.llm.work import id_remainder, table

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", (text or "").translate(FOLD)) if w] + ["</s>"]


def brute(docs, held):
    """The contract's base and the model, from plain dictionaries."""
    uni, pairs = Counter(), Counter()
    for (_, text), out in zip(docs, held):
        if not out:
            w = words(text)
            uni.update(w)
            pairs.update(zip(["<s>", *w], w))
    n, v = sum(uni.values()), len(uni)
    context, classes, before = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
    for (a, b), c in pairs.items():
        context[a] += c
        classes[a][min(c, 3) - 1] += 1
        before[b] += 1
    of = lambda counts: lm.discounts(np.array([sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]))
    d2, d1 = of(pairs), of(before)
    types = sum(before.values())
    spare = sum(d1[min(k, 3) - 1] for k in before.values()) / types if types else 1.0

    def p(a, b):
        k = before[b]
        low = (max(k - d1[min(k, 3) - 1], 0) if k else 0) / max(types, 1) + spare / (v + 1)
        if not context[a]:
            return low
        c = pairs[a, b]
        return (c - d2[min(c, 3) - 1] if c else 0) / context[a] + float(np.dot(classes[a], d2)) / context[a] * low

    out = []
    for (i, text), h in zip(docs, held):
        w = words(text)
        out.append((i, h, len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w], w))))
    return out, p, uni


def same(got, want):
    key = lambda r: (str(r[0]), r[2], r[1])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_documents_equal_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", (id_remainder(F.col("doc_id"), 7) == 2).alias("h"))
    rows = docs.collect()
    want, p, uni = brute([(r[0], r[1]) for r in rows], [r[2] for r in rows])
    for bits in (None, 0, 3):
        same(lm.score(docs, F.col("h"), bits).collect(), want)
    for v in ("the", "<s>", "never seen"):
        assert sum(p(v, w) for w in uni) + p(v, "unknown word") == pytest.approx(1, abs=1e-6)
    held = [r for r in want if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_small_flushes_and_odd_rows(spark, monkeypatch):
    docs = [(1, None, False), (1, "", False), (2, "a b a b A\tc", True), (None, "the the the", False), (2, "a b a b A\tc", False), (3, "x " * 9000, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score boolean")
    want, _, _ = brute([d[:2] for d in docs], [bool(d[2]) for d in docs])
    same(lm.score(frame, F.col("score")).collect(), want)
    none, _, _ = brute([d[:2] for d in docs], [True] * len(docs))
    same(lm.score(frame, F.lit(True)).collect(), none)
    assert lm.score(frame.limit(0), F.lit(False)).count() == 0


def test_blocks_hold_every_token():
    rng = np.random.default_rng(2)
    h, before, doc = rng.integers(0, 2**64, 50, np.uint64)[rng.integers(0, 50, 3000)], rng.integers(0, 2**64, 9, np.uint64)[rng.integers(0, 9, 3000)], np.sort(rng.integers(0, 40, 3000))
    train = rng.random(40) < 0.5
    want = Counter(zip(h.tolist(), before.tolist(), doc.tolist()))
    for bits in (0, 2):
        got = Counter()
        for shard, block in lm._blocks(h, before, doc, train, bits):
            w, v, _, count, d, seen = lm._opened(block)
            own = np.repeat(np.arange(len(w)), count)
            got.update(zip(w[own].tolist(), v[own].tolist(), d.tolist()))
            assert (seen == np.bincount(own, train[d], len(w))).all()
            assert not bits or ((w >> np.uint64(62)) * np.uint64(4) + (v >> np.uint64(62)) == shard).all()
        assert got == want
