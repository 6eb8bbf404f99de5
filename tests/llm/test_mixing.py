import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar.llm import mixing


def level(sizes, weights, cap):
    """Targets by repeated resharing, the plain way."""
    total, fixed = sum(sizes.values()), {}
    while True:
        left = total - sum(fixed.values())
        free = [s for s in sizes if s not in fixed]
        share = {s: left * weights[s] / sum(weights[t] for t in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, "d": 0}, {"a": 7}, {"a": 100, "b": 100, "c": 100}, {"z": 1, "y": 2, "x": 30000}])
def test_targets_equal_resharing(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    want = level(sizes, {s: 1 + i % 3 for i, s in enumerate(sorted(sizes))}, 3)
    assert got == pytest.approx(want)


def test_plan(spark, docs):
    got = mixing.plan_mix(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert 0 <= r["copies"] <= 3
    again = mixing.plan_mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_emits_the_copies(spark, docs):
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == mixing.plan_mix(docs).agg(F.sum("copies")).first()[0]


def test_mix_of_nothing(spark, no_docs):
    assert mixing.mix(no_docs).count() == 0


def test_near_targets(spark):
    rows = spark.createDataFrame([(i, "w " * (1 + i % 9), f"s{(i % 100) ** 2 // 2500}") for i in range(20000)], "doc_id long, text string, source string")
    plan = mixing.plan_mix(rows).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(r["taken"] == pytest.approx(r["target"], rel=0.05) for r in plan)


def test_equals_sql(spark, tmp_path, docs):
    docs.select("doc_id", "text", "source").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = mixing.op1_mixing(spark, f"file://{tmp_path}")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(mixing.OP1_SQL)
    pick = lambda r, cols: tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in cols))
    cols = sorted(got.columns)
    assert sorted(map(str, (pick(r.asDict(), cols) for r in got.collect()))) == sorted(map(str, (pick(dict(zip(want.columns, r)), cols) for r in want.fetchall())))
