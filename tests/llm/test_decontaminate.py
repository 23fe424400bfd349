import random

import pyarrow as pa

from studyframe.llm import decontaminate, tokens
from studyframe.llm.work import table


def brute(docs, items):
    out = {}
    for d, text in docs:
        own = decontaminate.shingle_set((text or "").lower())
        for i, t in items:
            s = decontaminate.shingle_set((t or "").lower())
            if s and len(s & own) >= 0.8 * len(s):
                out[d, i] = len(s & own)
    return out


def test_documents_equal_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    got = {(r["doc_id"], r["item_id"]): r["common"] for r in decontaminate.search(docs, items).collect()}
    assert got and got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({k[0] for k in got})


def test_sizes_edits_and_odd_rows(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([5, 6, 7, 9, 16, 20, 21, 40, 68, 69, 70, 150, 400, 3000])]
    items += [(50, None), (51, ""), (52, "a b c d"), (None, items[5][1]), (5, items[5][1])]
    docs = []
    for k in range(120):
        w = rng.choices(words, k=rng.choice([0, 3, 30, 300, 3000]))
        for i, t in rng.sample(items[:14], 2):
            own = t.split()
            if rng.random() < 0.5 and len(own) > 30:
                own[rng.randrange(len(own))] = "edit"
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() + rng.choice(["", "***", "!"]) for x in own]
        docs.append((k, " ".join(w)))
    docs += [(500, None), (501, ""), (None, items[7][1]), (0, docs[0][1])]
    want = brute([(k, d[1]) for k, d in enumerate(docs)], [(k, i[1]) for k, i in enumerate(items)])
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    wanted = items and spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    expected = sorted([(docs[d][0], items[i][0], c) for (d, i), c in want.items()], key=str)
    for chars in (decontaminate.BLOCK_CHARS, 2000):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
        got = sorted([(r[0], r[1], r[2]) for r in decontaminate.search(frame, wanted).collect()], key=str)
        assert got == expected
    assert decontaminate.search(frame.limit(0), wanted).count() == 0
    assert decontaminate.search(frame, wanted.limit(0)).count() == 0
    assert decontaminate.clean(frame, wanted.limit(0)).count() == len(docs)


def test_word_hashes_follow_the_words():
    texts = ["Ab ab\tAB\x0b\x0c\n", None, "", "ab", "é é  é", "x" * 50, " ab", "y é"]
    for size in (1, 4, 1 << 20):
        tokens.SLICE_BYTES, before = size, tokens.SLICE_BYTES
        got = [(int(r) + p.first, int(h)) for p in tokens.slices(pa.array(texts)) for h, r in zip(p.hash, p.row)]
        tokens.SLICE_BYTES = before
        words = [(k, w) for k, t in enumerate(texts) for w in (t or "").lower().split()]
        assert [g[0] for g in got] == [w[0] for w in words]
        by = {}
        for (_, h), (_, w) in zip(got, words):
            assert by.setdefault(w, h) == h
        assert len(set(by.values())) == len(by)


def test_shortest_items_are_never_missed():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(100_000)]
    for n in (5, 6, 7, 8, 9):
        items = [(i, " ".join(rng.choices(words, k=n))) for i in range(600)]
        docs = [f"{t} {' '.join(rng.choices(words, k=60))}" if i % 2 else f"{' '.join(rng.choices(words, k=61))} {t} {' '.join(rng.choices(words, k=40))}" for i, t in items]
        got = decontaminate.Index(items + items[:3]).matches(pa.array(docs))
        assert {(r, i) for r, i, _ in got} == {(k, k) for k in range(600)} | {(k, 600 + k) for k in range(3)}
