import random
import re
import string
from collections import defaultdict

from studyframe.llm import suffixes
from studyframe.llm.work import table


FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(docs, n):
    words = [(i, [w for w in re.split(r"[\x20\x09-\x0d]+", (t or "").translate(FOLD)) if w]) for i, t in docs]
    owners = defaultdict(set)
    for i, w in words:
        for k in range(len(w) - n + 1):
            owners[tuple(w[k:k + n])].add(i)
    covered = defaultdict(set)
    for i, w in words:
        for k in range(len(w) - n + 1):
            if len(owners[tuple(w[k:k + n])]) > 1:
                covered[i].update(range(k, k + n))
    out = []
    for i, c in covered.items():
        run = sorted(c)
        start = run[0]
        for a, b in zip(run, run[1:] + [None]):
            if b != a + 1:
                out.append((i, start, a + 1))
                start = b
    return sorted(out, key=str)


def spans(frame, *args):
    return sorted([(r["doc_id"], r["start"], r["stop"]) for r in suffixes.repeats(frame, *args).collect()], key=str)


def test_documents_equal_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    assert spans(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], suffixes.LENGTH)


def test_planted_passages_and_odd_rows(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    passages = [rng.choices(words, k=n) for n in (8, 9, 12, 20, 45)] + [["z"] * 30]
    docs = []
    for k in range(70):
        own = rng.choices(words, k=rng.choice([0, 3, 10, 40]))
        for p in rng.sample(passages, rng.choice([0, 1, 2])):
            p = list(p)
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edit"
            at = rng.randint(0, len(own))
            own[at:at] = p[:rng.randint(1, len(p))] if rng.random() < 0.3 else p
        docs.append((k, " ".join(own)))
    docs += [(200, None), (201, ""), (5, docs[5][1]), (None, docs[3][1]), (None, docs[3][1])]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, low int")
    one = [(i, t) for k, (i, t) in enumerate(docs) if (i, t) not in docs[:k]]
    want = brute(one, 10)
    assert len(want) > 20 and spans(frame, 10, 4) == want
    monkeypatch.setattr(suffixes, "BROADCAST_ROWS", 0)
    assert spans(frame, 10, 4) == want
    assert suffixes.repeats(frame.limit(0)).count() == 0


def test_texts_of_one_id_are_documents_of_their_own(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    one, two, three = (rng.sample(words, 12) for _ in range(3))
    docs = []
    for key, shared in ((None, one), (7, two)):
        docs += [(key, " ".join(shared)), (key, " ".join(rng.sample(words, 40) + shared + rng.sample(words, 300))), (key, " ".join(rng.sample(words, 11)))]
    docs += [(8, " ".join(three[:11] + rng.sample(words, 3))), (8, " ".join(rng.sample(words, 200) + three)), (9, " ".join(rng.sample(words, 5) + three)), (9, "short")]
    keys = [(k, t) for k, (_, t) in enumerate(docs)]
    want = sorted([(docs[k][0], a, b) for k, a, b in brute(keys, 10)], key=str)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert len(want) >= 7 and spans(frame, 10, 4) == want
    named = spark.createDataFrame([(i and str(i), t) for i, t in docs], "doc_id string, text string")
    assert spans(named, 10, 4) == sorted([(i and str(i), a, b) for i, a, b in want], key=str)
