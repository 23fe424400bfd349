"""Every registered query of the package: its columns, and as many rows as its table where it gives a row for each."""

import duckdb
import pytest

import __spark_entry__ as entry
from studyframe.llm import queries
from studyframe.llm.work import table

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op2": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op3": ["doc_id", "item_id"],
    "op4": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op5": ["page_id", "url", "text", "n_chars"],
    "op6": ["doc_id", "held_out", "score", "predicted"],
    "op7": ["doc_id", "class_id"],
    "op8": ["doc_id", "n_sentences", "sentence_ids", "licenses"],
    "op9": ["doc_id", "start", "stop", "n_words"],
    "op10": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op11": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op12": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    "op13": ["doc_id", "n_shingles", "component_id"],
}


def test_registered():
    names = entry.queries()
    assert sorted(k.split("_")[0] for k in queries.QUERIES) == sorted(COLUMNS) and set(queries.QUERIES) | {"pipeline"} <= set(names)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    op = name.split("_")[0]
    out = queries.QUERIES[name](spark, SF)
    assert out.columns[:len(COLUMNS[op])] == COLUMNS[op]
    if op not in ("op3", "op9", "op12"):
        assert out.count() == table(spark, SF, "pages" if op == "op5" else "documents").count()
    else:
        assert out.count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_parses(name):
    for t in ("documents", "embeddings"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert duckdb.sql(queries.ORACLES[name]).columns
