import hashlib
import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from studyframe.llm import pii, quality_model
from studyframe.llm.queries import vocabulary_path
from studyframe.llm.work import table
from test_decontaminate import brute as leaks
from test_neardup import brute as classes
from test_pii import brute as base_spans

SF = "/root/testdata/sf0.001"


def redacted(text):
    out, at = "", 0
    for a, k, b in base_spans(text):
        if a >= at:
            out += text[at:a] + f"<{pii.KINDS[k]}>"
        at = max(at, b)
    return out + text[at:]


def test_stages_equal_their_brute_force(spark):
    """Each stage on its own input; the classifier's verdicts are taken from its scores, the rest from plain Python."""
    docs = table(spark, SF, "documents")
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    library = Tokenizer.from_file(vocabulary_path())
    before = docs
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, SF)
        rows = {r["doc_id"]: r for r in after.collect()}
        had = {r["doc_id"]: r for r in before.collect()}
        if k < 4:
            assert after.columns == docs.columns
        if k == 0:
            model = quality_model.fit(before, table(spark, SF, "labels"))
            assert set(rows) == {r["doc_id"] for r in quality_model.apply(before, model).filter("predicted = 1").collect()}
        elif k == 1:
            assert set(rows) == {c for _, c in classes([(i, r["text"]) for i, r in had.items()])}
        elif k == 2:
            assert set(rows) == set(had) - {d for d, _ in leaks([(i, r["text"]) for i, r in had.items()], items)}
        elif k == 3:
            assert {i: r["text"] for i, r in rows.items()} == {i: redacted(r["text"]) for i, r in had.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
        else:
            for i, r in had.items():
                ids = library.encode(r["text"], add_special_tokens=False).ids
                assert rows[i]["ids"] == ids and rows[i]["n_tokens"] == len(ids)
                assert rows[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        if k < 3:
            assert all(rows[i] == had[i] for i in rows)
        assert 0 < len(rows) <= len(had)
        before = spark.createDataFrame(after.collect(), after.schema)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, whole.collect())) == sorted(map(str, before.collect()))


def test_odd_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, "en", None, 0), (1, "", "en", "s", 0), (2, "a", None, "s", 1), (None, "plain text of some words in a row", "en", "s", 9),
                                  (3, "x " * 30_000, "en", "s", 60_000), (3, "x " * 30_000, "en", "s", 60_000)], table(spark, SF, "documents").schema)
    for frame in (docs, docs.limit(0)):
        for name in ("labels", "benchmark"):
            table(spark, SF, name).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        frame.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        out = corpus_pipeline.run(spark, str(tmp_path))
        assert re.match("doc_id,n_tokens", ",".join(out.columns)) and out.count() <= frame.count()


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:4]])
def test_clashing_columns_pass_through(spark, stage):
    names = "doc_id long, text string, node string, digest string, score int, _extra int, n_words int"
    docs = spark.createDataFrame([(k, f"some words {k} that are plain and good to read at length w{k} v{k} u{k}", "n", "d", k, k, k) for k in range(8)], names)
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and out.count() == 8
