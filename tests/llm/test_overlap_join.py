import itertools
import pathlib
import random
import re
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

from studyframe.llm import overlap_join, queries, tokens
from studyframe.llm.work import table
from studyframe.session import shared_folder

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", w) if x]
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(docs):
    """(id, shingles, least id of the component) of each row, from all pairs."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    ids = {}
    for k, (i, _) in enumerate(docs):
        ids[find(k)] = min([x for x in (ids.get(find(k)), i) if x is not None], default=None)
    return sorted([(docs[k][0], len(sets[k]), ids[find(k)]) for k in range(len(docs))], key=str)


def found(frame):
    return sorted(map(tuple, overlap_join.components_of(frame).collect()), key=str)


def planted():
    """Short texts that differ by a word at their ends, families of edited texts, chains, and one passage in many texts."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for n in range(1, 26):
        base = rng.choices(words, k=n)
        docs += [" ".join(t) for t in (base, base + ["x"], ["y"] + base, base[1:], base[:-1], base + ["x", "z"], base[:-1] + ["q"], base[::-1]) if t]
    for _ in range(14):
        base = rng.choices(words, k=rng.choice([30, 60, 200]))
        for _ in range(rng.choice([2, 9, 20])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(words)
            docs.append(" ".join(own))
    chain = rng.choices(words, k=120)
    for k in range(12):
        chain = chain[:]
        chain[k * 9] = f"x{k}"
        docs.append(" ".join(chain))
    passage = rng.choices(words, k=60)
    docs += [" ".join(passage + rng.choices(words, k=rng.choice([5, 12, 14, 16, 40]))) for _ in range(40)]
    docs = list(enumerate(docs))
    rng.shuffle(docs)
    first, second = docs[0][1], docs[1][1]
    return docs + [(900, None), (901, ""), (902, "a b"), (903, "A b"), (904, "b a"), (905, " \n\x0b"), (None, first), (0, first), (3, "a text of its own that is quite alone"), (None, None),
                   (None, "only null ids have this text of mine"), (None, "only null ids have this text of mine"), (77, second.upper()), (77, second)]


@pytest.mark.parametrize("small, broadcast", [(None, 10**6), (1, 0), (21, 10**6)])
def test_equals_all_pairs(spark, monkeypatch, small, broadcast):
    docs = planted()
    if small:
        monkeypatch.setattr(overlap_join, "boundary", lambda sizes: small)
    monkeypatch.setattr(overlap_join, "BROADCAST_ROWS", broadcast)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id int, text string, node int, key string")
    assert found(frame) == brute(docs)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []
    assert found(spark.createDataFrame([(1, None)], "doc_id long, text string")) == [(1, 0, 1)]


def test_a_group_that_no_leader_joins(spark):
    """Texts of which each is like the next one only: leaders miss, delegates must meet them all."""
    rng = random.Random(3)
    words = rng.choices([f"v{i}" for i in range(500)], k=400)
    docs = [(k, " ".join(words[4 * k:4 * k + 60])) for k in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = found(frame)
    assert got == brute(docs) and {r[2] for r in got} == {0}


def test_a_long_text(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(100_000)]
    near = words[:]
    for k in range(0, 100_000, 60):
        near[k] = "other"
    far = words[:50_000]
    assert found(spark.createDataFrame([(5, " ".join(words)), (4, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")) == brute(
        [(5, " ".join(words)), (4, " ".join(near)), (3, " ".join(far))])


def test_counts_of_shared_elements():
    for a in range(1, 60):
        for b in range(1, 60):
            least = next((i for i in range(1, min(a, b) + 1) if 100 * i >= 80 * (a + b - i)), None)
            assert (least is None) == (b not in dict(overlap_join.partners(a)))
            if least:
                assert least == overlap_join.needed(a, b)
                # the written parts of two linked sets, less what may be left out of each, still meet
                for s, r in ((a, b), (b, a)):
                    assert overlap_join.written(s) - (s - least) >= 1 + min(s, r) // 10 >= 1 + -(-4 * s // 5) // 10
    assert 1 <= overlap_join.boundary({5: 10, 9: 3}) <= overlap_join.boundary({}) + overlap_join.MOST_SMALL


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    assert sorted(map(tuple, queries.op13_ngram_jaccard_join(spark, SF).collect()), key=str) == brute(docs)


def test_elements_counted_where_they_are_seen():
    """A passage in all texts of a batch makes two rows a batch, and no node loses a shared element by that."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join(passage + [f"w{rng.randrange(900)}" for _ in range(20)]) for _ in range(90)] + [" ".join(passage)]
    batches = [pa.record_batch([pa.array(texts[a:a + 40])], ["text"]) for a in range(0, len(texts), 40)]
    rows = [r for b in overlap_join._writer(1)(iter(batches)) for r in b.to_pylist()]
    plain = [r for t in texts for b in overlap_join._writer(1)(iter([pa.record_batch([pa.array([t])], ["text"])])) for r in b.to_pylist()]
    assert all(r["n"] == 0 for r in plain) and len(rows) < len(plain) / 2

    def counted(rows):
        nodes, n = {}, {}
        for r in rows:
            if not r["n"]:
                nodes.setdefault(r["key"], set()).add(r["node"])
            else:
                n[r["node"]] = n.get(r["node"], 0) + r["n"]
        for some in nodes.values():
            for x in some if len(some) > 1 else ():
                n[x] = n.get(x, 0) + 1
        return n

    assert counted(rows) == counted(plain) and max(Counter(r["key"] for r in rows if not r["n"]).values()) <= 2 * len(batches)


def test_tables_go_when_they_are_read(spark):
    folder = pathlib.Path(shared_folder(spark))
    before = set(folder.iterdir())
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(setting)
    frame = spark.createDataFrame(planted(), "doc_id int, text string")
    assert found(frame) == brute(planted())
    left = Counter(p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before)
    assert left["elements"] == left["keys"] == left["subsets"] == 0 and left["lists"] <= 1
    assert spark.conf.get(setting) == kept


@pytest.mark.parametrize("step", [overlap_join._members, overlap_join._writer(1), overlap_join._whole])
def test_memory_of_a_worker(monkeypatch, step):
    """A batch of 8 MB of texts is hashed in parts, so that arrays many times its size never exist."""
    monkeypatch.setattr(tokens, "_powers", [])
    rng = random.Random(13)
    words = [f"w{i}" for i in range(5000)]
    texts = pa.array([" ".join(rng.choices(words, k=400)) for _ in range(3500)])
    batch = pa.record_batch([pa.array(range(len(texts))), texts, pa.array(range(len(texts)))], ["doc_id", "text", "body"])
    assert texts.nbytes > 8 * 10**6
    tracemalloc.start()
    try:
        for _ in step(iter([batch])):
            pass
        assert tracemalloc.get_traced_memory()[1] < 64 * 10**6
    finally:
        tracemalloc.stop()


def test_elements_are_gathered_from_slices(monkeypatch):
    """However the texts of a batch are sliced, the same rows are written."""
    rng = random.Random(17)
    passage = [f"p{i}" for i in range(20)]
    texts = [None, "", "a b"] + [" ".join(passage + rng.choices([f"w{i}" for i in range(40)], k=rng.choice([3, 20, 70]))) for _ in range(60)]
    batch = pa.record_batch([pa.array(texts + texts[10:30])], ["text"])

    def rows():
        return sorted((r["key"], r["node"], r["size"], r["n"]) for b in overlap_join._writer(8)(iter([batch])) for r in b.to_pylist())

    at_once = rows()
    monkeypatch.setattr(overlap_join, "SLICE_BYTES", 100)
    assert rows() == at_once and any(r[3] for r in at_once)
    monkeypatch.setattr(overlap_join, "GATHERED", 1)
    assert len(rows()) > len(at_once)
