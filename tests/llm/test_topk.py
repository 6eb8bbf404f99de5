import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import topk


def brute(rows, k):
    good = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in good:
        if q % 50:
            continue
        scored = sorted((-int(np.dot(a, b)), c) for c, b in good if c != q and len(b) == len(a))
        out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize(("tile", "fan"), [(4, 64), (2048, 2)])
def test_top_k(spark, tile, fan, monkeypatch):
    monkeypatch.setattr(topk, "FAN", fan)
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-6, 6, 8).astype(float).tolist()) for i in range(620)]
    rows += [(i, rows[3][1]) for i in range(700, 760)]  # ties
    rows += [(800, None), (850, []), (900, [1.0, None] + [0.0] * 6), (950, [float("nan")] * 8), (951, [float("inf")] * 8), (1000, [1.0, 2.0]), (1001, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").withColumn("dim", F.lit("clash"))
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5, tile, 128).collect()}
    assert got == brute(rows, 5)


def test_empty(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, v array<double>"), F.col("vec_id") % 50 == 0).count() == 0


def test_repeated_and_missing_ids(spark):
    rows = [(50, [1.0, 2.0]), (50, [1.0, 2.0]), (None, [9.0, 9.0]), (7, [3.0, 1.0]), (7, [3.0, 1.0]), (8, [0.0, 1.0])]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, v array<double>"), F.col("vec_id") % 50 == 0, 5, 4, 2).collect())
    assert {(q, v, s) for q, _, v, s in got} == {(50, 7, 5), (50, 8, 2)}
