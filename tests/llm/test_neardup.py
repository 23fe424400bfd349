import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from studyframe.llm import decontaminate, neardup, pii, tokens
from studyframe.llm.components import components
from studyframe.llm.work import BATCH_ROWS, handed_off, small_batches, table


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", w) if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def grouped(docs):
    """Class of each row and least id of each class, from all pairs."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        both = len(sets[a] & sets[b])
        if (docs[a][1] or "") == (docs[b][1] or "") or both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    ids = {}
    for k, (i, _) in enumerate(docs):
        ids[find(k)] = min([x for x in (ids.get(find(k)), i) if x is not None], default=None)
    return [find(k) for k in range(len(docs))], ids


def brute(docs):
    """Id and least id of the class of each row."""
    found, ids = grouped(docs)
    return sorted([(d[0], ids[c]) for d, c in zip(docs, found, strict=True)], key=str)


def test_agreement_is_the_weighted_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 400).astype(np.uint64)
    for n, low, high in ((400, 1, 2), (300, 1, 6), (3, 1, 40), (60, 1, 9)):
        a, b = rng.integers(low, high, n), rng.integers(low, high, n)
        a[: n // 8] = 0 if n > 8 else a[: n // 8]
        some = [np.flatnonzero(w) for w in (a, b)]
        sig = neardup.signatures(np.concatenate([x[some[0]], x[some[1]]]), np.repeat([0, 1], [len(s) for s in some]), 2,
                                 np.concatenate([a[some[0]], b[some[1]]]), k=8192)
        assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.025


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for g in range(12):
        base = rng.choices(words, k=rng.choice([6, 12, 60, 200]))
        for _ in range(rng.choice([1, 2, 9])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 3])):
                own[rng.randrange(len(own))] = rng.choice(words)
            docs.append((len(docs), " ".join(own)))
    chain = rng.choices(words, k=120)
    for k in range(12):
        chain = chain[:]
        chain[k * 9] = f"x{k}"
        docs.append((len(docs), " ".join(chain)))
    docs += [(900, None), (901, ""), (902, "a b"), (903, "a b"), (904, "A B"), (None, docs[0][1]), (0, docs[0][1]), (3, "other text of its own that is alone"), (None, None)]
    return docs


@pytest.mark.parametrize("paired, broadcast", [(24, 10**6), (0, 0)])
def test_classes_equal_all_pairs(spark, planted, monkeypatch, paired, broadcast):
    monkeypatch.setattr(neardup, "PAIRED", paired)
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", broadcast)
    frame = spark.createDataFrame([(i, t, "x") for i, t in planted], "doc_id long, text string, node string")
    got = neardup.classes(frame).collect()
    assert sorted([(r["doc_id"], r["class_id"]) for r in got], key=str) == brute(planted)
    kept = neardup.kept(frame)
    assert kept.columns == frame.columns
    rows = kept.collect()
    assert sorted([r["doc_id"] for r in rows], key=str) == sorted(grouped(planted)[1].values(), key=str)
    assert neardup.classes(frame.limit(0)).count() == 0 and neardup.kept(frame.limit(0)).count() == 0


def test_links_of_a_large_group_do_not_grow_with_its_pairs(spark):
    """Copies of one text at 0.85 to it and mostly under 0.8 to each other; the hub joins them, so links are about as many as texts."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(300)]
    docs = [(0, " ".join(base))]
    for k in range(1, 160):
        own = list(base)
        for at in rng.sample(range(0, 300, 6), rng.choice([3, 4, 5])):
            own[at] = f"x{k}"
        docs.append((k, " ".join(own)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted([(r["doc_id"], r["class_id"]) for r in neardup.classes(frame).collect()], key=str) == brute(docs)
    assert neardup.links(frame).count() < 2 * len(docs)


def test_documents_equal_all_pairs(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = sorted([(r["doc_id"], r["class_id"]) for r in neardup.classes(docs).collect()], key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_components_of_chains_and_stars(spark):
    edges = [(f"{k:03d}", f"{k + 1:03d}") for k in range(0, 60)] + [("500", f"{k}") for k in range(501, 560)] + [("a", "b"), ("a", "b")]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a string, b string")).collect()))
    assert {got[f"{k:03d}"] for k in range(61)} == {"000"} and {got[str(k)] for k in range(500, 560)} == {"500"} and got["b"] == "a"


def test_unlike_classes_of_one_id_are_all_kept(spark):
    texts = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcdef"]
    near = texts[4].replace("e29", "x")
    docs = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, None), (7, texts[2]), (7, texts[3]), (7, texts[2]), (8, texts[4]), (8, near), (8, texts[5]), (9, near)]
    rows = neardup.kept(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    alone = [(None, texts[0]), (None, texts[1]), (None, None), (7, texts[2]), (7, texts[3]), (8, texts[5])]
    got = [tuple(r) for r in rows if r["text"] not in (texts[4], near)]
    assert sorted(got, key=str) == sorted(alone, key=str)
    assert [r["doc_id"] for r in rows if r["text"] in (texts[4], near)] == [8]


def test_of_rows_that_differ_elsewhere_the_first_stays(spark):
    text = "one text of a handful of words"
    rows = [(1, text, "b"), (1, text, "a"), (1, text, "c"), (2, text, "0")]
    for order in (rows, rows[::-1]):
        assert [tuple(r) for r in neardup.kept(spark.createDataFrame(order, "doc_id long, text string, source string").coalesce(1)).collect()] == [(1, text, "a")]


def test_long_texts(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    near = [w if k % 100 else "other" for k, w in enumerate(words)]
    docs = [(3, " ".join(words)), (2, " ".join(near)), (1, " ".join(words[:40_000]))]
    assert sorted((r["doc_id"], r["class_id"], r["class_size"]) for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == [(1, 1, 1), (2, 2, 2), (3, 2, 2)]


@pytest.mark.parametrize("step", ["bands", "sets", "items", "places"])
def test_a_worker_holds_little(monkeypatch, step):
    """The arrays of a step stay small beside the 6 MB of texts that come in one batch, and rows don't depend on the slices."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(800)) for _ in range(1000)]
    batch = pa.record_batch([pa.array(range(1000), pa.int64()), pa.array(map(str, range(1000))), pa.array(texts)], ["node", "digest", "text"])
    items = decontaminate.Index(list(enumerate(texts[:3])))

    class Shared:
        value = pii._hash_index([texts[0].split()[0], " ".join(texts[1].split()[:2])])

    def rows():
        if step == "items":
            return items.matches(batch.column("text"))
        return list({"bands": neardup._bands, "sets": neardup._sets, "places": pii._counter(Shared)}[step](iter([batch])))

    def told(found):
        return sorted(str(r) for b in found for r in (b.to_pylist() if isinstance(b, pa.RecordBatch) else [b]))

    monkeypatch.setattr(tokens, "_powers", [])
    tracemalloc.start()
    at_once = rows()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert at_once and most < 50
    monkeypatch.setattr(tokens, "SMALL_SLICE", 1 << 15)
    assert told(rows()) == told(at_once)


def test_python_gets_small_batches(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)

    def counted(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], ["n"])

    def sizes():
        return [r[0] for r in handed_off(spark.range(2 * BATCH_ROWS + 500).coalesce(1).mapInArrow(counted, "n long"), "sizes").collect()]

    with small_batches(spark):
        assert sorted(sizes()) == [500, BATCH_ROWS, BATCH_ROWS]
    assert spark.conf.get(name) == before
    try:
        for given, wanted in (("7", "7"), ("0", str(BATCH_ROWS)), ("10000", str(BATCH_ROWS))):
            spark.conf.set(name, given)
            with small_batches(spark):
                assert spark.conf.get(name) == wanted
            assert spark.conf.get(name) == given
    finally:
        spark.conf.set(name, before)
    write = lambda df, x: (seen.append(int(spark.conf.get(name))), handed_off(df, x))[1]
    monkeypatch.setattr(neardup, "handed_off", write)
    monkeypatch.setattr(pii, "handed_off", write)
    docs = spark.createDataFrame([(1, "mail a@b.cd of one two three"), (2, "mail a@b.cd of one two three x"), (3, "call 030 123 4567 now")], "doc_id long, text string")
    neardup.links(docs)
    pii.find(docs)
    assert seen and max(seen) <= BATCH_ROWS and spark.conf.get(name) == before
