import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from studyframe.llm import periodic, queries
from studyframe.llm.work import table

SF = "/root/testdata/sf0.001"


def lyndon(w):
    """Up to the next smaller suffix."""
    return [next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w)) - i for i in range(len(w))]


def brute(w):
    """Every wanted run, from every period and place."""
    out = []
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            n = j + p - i
            if j > i and n >= max(6, 4 * p) and not any(w[i:i + n - q] == w[i + q:i + n] for q in range(1, p)):
                out.append((i, n, p))
            i = max(j, i + 1)
    return sorted((s, n, p) for s, n, p in out)


def test_lyndon_arrays():
    rng = random.Random(1)
    for _ in range(500):
        parts = [[rng.randint(1, k) for _ in range(rng.randint(1, 25))] for k in (1, 2, 4)]
        got = periodic.lyndon_lengths(np.array([x for p in parts for x in [*p, 0]])).tolist()
        assert got == [x for p in parts for x in [*lyndon(p), 0]]
        assert periodic.lyndon_lengths(np.array(parts[1])).tolist() == lyndon(parts[1])


def texts():
    rng = random.Random(2)
    out = [None, "", " \n", "a", "a a a a a", "a a a a a a", "A a A a A a A a", "ä ä " * 7, "x\x0by\x0cx y x y x y \t"]
    for _ in range(150):
        core = [rng.choice("abcd") for _ in range(rng.randint(1, 6))] * rng.randint(2, 9)
        for _ in range(rng.randint(0, 2)):
            core[rng.randrange(len(core))] = rng.choice("abx")
        out.append(" ".join([rng.choice("abcxyz") for _ in range(rng.randint(0, 9))] + core + [rng.choice("abc") for _ in range(rng.randint(0, 30))]))
    return out


def test_runs_equal_brute_force(spark):
    docs = [(k, t, k, "z") for k, t in enumerate(texts())]
    docs += [(None, docs[9][1], 1, ""), (3, docs[10][1], 1, ""), (3, docs[10][1], 1, "")]
    frame = spark.createDataFrame(docs, "doc_id int, text string, runs int, collapsed string")
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.runs(frame).collect()), key=str)
    want = []
    for i, t, *_ in docs:
        w = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        found = brute(w)
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        want.append((i, len(w), found, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got == sorted(want, key=str)
    assert periodic.runs(frame.limit(0)).count() == 0


@pytest.mark.parametrize("words", [["a"] * 60_000, ["a", "b", "a"] * 20_000])
def test_a_very_long_run(words):
    (n, found, collapsed), = periodic._document_runs([" ".join(words)])
    p = 1 if words[1] == "a" else 3
    assert n == 60_000 and found == [(0, n, p)] and collapsed == " ".join(words[:p])


def test_query_equals_brute_force(spark):
    want = []
    for r in table(spark, SF, "documents").collect():
        w = re.findall(r"[^\x20\x09-\x0d]+", r["text"] or "")
        n, h = len(w), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        found = brute(w)
        best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        gone = {k for s, m, p in found for k in range(s + p, s + m)}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((r["doc_id"], len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                     sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, SF).collect()]
    assert sorted(got) == sorted(want) and sum(r[1] > 0 for r in want) > 5
