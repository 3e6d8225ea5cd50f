"""op11 against a plain loop over exact integers."""

import math

import numpy as np
import pytest

from genoloom.llm.negatives import hard_negatives, op11_hard_negatives, usable

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, anchors, n_positives=5, n_negatives=10):
    scale = lambda v: [math.floor(256 * float(np.float32(x))) for x in v]
    rows = [(i, scale(v), c) for i, v, c in rows]
    out = []
    for at in anchors:
        i, v, c = rows[at]
        score = [sum(a * b for a, b in zip(v, w, strict=False)) for _, w, _ in rows]
        order = sorted((k for k in range(len(rows)) if k != at), key=lambda k: (-score[k], rows[k][0]))
        for p in [k for k in order if rows[k][2] == c][:n_positives]:
            window = [k for k in order if rows[k][2] != c and 30 * score[p] <= 100 * score[k] <= 90 * score[p]]
            out += [(i, rows[p][0], r, rows[k][0], score[p], score[k]) for r, k in enumerate(window[:n_negatives], 1)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize("block_bytes", [1500, 16 << 20])
def test_equals_plain_loop(spark, block_bytes):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist(), int(rng.integers(0, 3))) for i in range(120)]
    rows += [rows[7], rows[7], (10, rows[3][1], rows[10][2]), (130, [1.0, 2.0], 1), (131, [], 1), (-10, [3.0] * 8, 2)]  # repeats, one id twice, other lengths
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    anchors = df.where("vec_id % 10 = 0")
    want = plain(rows, [k for k, r in enumerate(rows) if r[0] % 10 == 0])
    assert len(want) > 100
    assert got(hard_negatives(usable(df), usable(anchors), block_bytes=block_bytes)) == want


def test_nulls_empty_and_extra_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.5, 0.0], 1), (3, None, 0), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (None, [0.5, 0.0], 1), (8, [0.5, 0.0], None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as k", "2 as score", "3 as rank", "4 as id")
    assert got(hard_negatives(usable(df), usable(df.where("vec_id = 100")))) == [(100, 1, 1, 2, 65536, 32768)]
    none = spark.createDataFrame([], SCHEMA)
    assert got(hard_negatives(usable(none), usable(none))) == []
    assert got(hard_negatives(usable(df), usable(none))) == []
    one = df.where("vec_id in (100, 1)")
    assert got(hard_negatives(usable(one), usable(one))) == []


def test_huge_components_do_not_fail(spark):
    rows = [(100, [3e38, 3e38], 0), (1, [3e38, 1.0], 0), (2, [1e30, 0.0], 1)]
    df = usable(spark.createDataFrame(rows, SCHEMA))
    assert len(got(hard_negatives(df, df.where("vec_id = 100")))) in (0, 1)


def test_query_relabels_each_seventh(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.3, 4).astype(np.float32).tolist(), int(rng.integers(0, 10))) for i in range(301)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = [(i, v, (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in rows]
    assert got(op11_hard_negatives(spark, str(tmp_path))) == plain(want, [0, 100, 200, 300])
