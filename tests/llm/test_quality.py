"""The two quality operators: counts against brute force, verdicts on held-out labels, odd inputs."""

import random
import re
from collections import Counter

import pytest

from studyframe.llm import quality_model, quality_rules
from studyframe.llm.work import table

DOCS = "doc_id long, text string, n_words string, _words int"


def brute(text):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", text or "") if x]
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "a b c d e a b c d e", "x " * 40, "é# |\n\n a\n a\n a ", "a\x0bb\x0cc\rd\x1ce\x85f"]
    texts += [" ".join(rng.choices("ab|c#\n", k=rng.randint(1, 60))) for _ in range(150)] + ["w1 w2 w3 " * 4000]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS)
    for r in quality_rules.apply(docs, []).collect():
        got = tuple(r)[1:6]
        assert got == brute(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert r["base_failed"] == (got[0] < 10 or 100 * got[4] > 20 * got[0]) == (not r["kept"])


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return table(spark, d, "documents"), table(spark, d, "labels")


def test_rules_find_what_the_base_misses(spark, tables):
    docs, labels = tables
    rules = quality_rules.learn(docs, labels)
    assert rules and all(len(r) <= quality_rules.MAX_CONDITIONS for r in rules)
    counts = {(r["quality"], r["kept"]): r["count"] for r in quality_rules.apply(docs, rules).join(labels, "doc_id").filter(
        "not base_failed and crc32(cast(doc_id as string)) % 5 = 0").groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) == 0 and counts.get((0, True), 0) <= 1 and counts[0, False] > 5


def test_model_on_held_out_rows(spark, tables):
    docs, labels = tables
    model = quality_model.fit(docs, labels)
    scored = quality_model.apply(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in scored) >= 0.97 * len(scored)
    kept = quality_model.kept(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == quality_model.apply(docs, model).filter("predicted = 1").count()


def test_no_labels_one_class_and_odd_rows(spark, tables):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, None, "q", 1), (1, "", "q", 1), (None, "a b", "q", 2), (2, "a " * 30, "q", 2), (2, "a " * 30, "q", 2)], DOCS)
    for known in (labels, one):
        assert quality_rules.learn(docs, known) == []
        model = quality_model.fit(docs, known)
        assert quality_model.apply(docs, model).count() == 5
        assert quality_model.kept(docs, model).columns == docs.columns
    assert quality_rules.apply(docs.limit(0), []).count() == 0
