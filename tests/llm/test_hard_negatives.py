import random

import duckdb
import pytest
from pyspark.sql import functions as F

from studyframe.llm import hard_negatives, queries

SF = "/root/testdata/sf0.001"


def brute(rows):
    """Every anchor against every row."""
    kept = sorted({(i, lab, tuple(v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and None not in v})
    out = []
    for a in kept:
        if a[0] % 5:
            continue
        pairs = sorted([(-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1] == a[1]) for b in kept if b[0] != a[0]])
        for ps, pid, _ in [p for p in pairs if p[2]][:5]:
            inside = [(s, i) for s, i, same in pairs if not same and 30 * -ps <= 100 * -s <= 90 * -ps]
            out += [(a[0], pid, k + 1, i, -ps, -s) for k, (s, i) in enumerate(inside[:10])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(k, rng.choice([0, 0, 0, 1, 2]), [rng.randint(-3, 9) for _ in range(4)]) for k in range(-20, 150)]
    out += [(5, 1, [1, 2, 3, 4]), (5, 1, [1, 2, 3, 4]), (5, 0, [1, 2, 3]), out[30], (None, 1, [1]), (200, None, [1]), (205, 1, None), (210, 0, [1, None]), (215, 2, []), (220, 9, [8, 8, 8, 8])]
    return out + [(300 + k, 1, [2, 2, 2, 2]) for k in range(30)] + [(400 + k, 3, [0, 0, 0, 0]) for k in range(9)]


@pytest.mark.parametrize("cell, block", [(4096, 1 << 25), (16, 256)])
def test_equals_brute_force(spark, rows, monkeypatch, cell, block):
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", cell)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "id int, label int, vector array<int>, mark string, score int")
    got = sorted(map(tuple, hard_negatives.mine(frame, F.col("id") % 5 == 0).collect()))
    assert got == brute(rows) and len(got) > 300
    assert hard_negatives.mine(frame.limit(0), F.col("id") % 5 == 0).count() == 0


def test_large_components(spark):
    big = [(5 * k, k % 2, [10**9 + k, -k, 10**9]) for k in range(12)]
    frame = spark.createDataFrame(big, "id long, label int, vector array<long>")
    assert sorted(map(tuple, hard_negatives.mine(frame, F.col("id") % 5 == 0, high=100).collect())) != []
    with pytest.raises(Exception, match="64-bit"):
        hard_negatives.mine(spark.createDataFrame([(0, 1, [2**40, 2**40]), (1, 1, [2**40, 1])], "id long, label int, vector array<long>"), F.col("id") % 5 == 0).collect()


def test_keys_order_as_numbers():
    rng = random.Random(1)
    pairs = [(rng.choice([-2**62, -1, 0, 3]), rng.randint(-2**62, 2**62), rng.randint(-9, 9) * 10**17, rng.randint(0, 1), rng.randint(-5, 5)) for _ in range(500)]
    assert sorted(pairs, key=lambda p: (p[0], p[1], -p[2], p[3], p[4])) == [hard_negatives.unpacked(k) for k in sorted(hard_negatives.packed(*p) for p in pairs)]


def test_query_equals_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = duckdb.sql(hard_negatives.sql()).fetchall()
    got = list(map(tuple, queries.op12_hard_negatives(spark, SF).collect()))
    assert sorted(got) == sorted(want) and len(got) > 50


def test_preparation_leaves_out_what_is_not_finite(spark):
    nan, inf = float("nan"), float("inf")
    frame = spark.createDataFrame([(7, 9, [0.5, -0.001]), (8, 1, [nan]), (9, 1, [inf]), (10, 1, [1.0, None]), (11, None, [1.0]), (12, 1, None), (13, 3, [])],
                                  "vec_id long, label int, embedding array<float>")
    got = sorted((r["id"], r["label"], r["vector"]) for r in hard_negatives.prepared(frame).collect())
    assert got == [(7, 0, [128, -1]), (13, 3, [])]
