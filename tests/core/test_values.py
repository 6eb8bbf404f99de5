"""Literal cases of single operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import arrays as A
from lodestar.functions import grading as G
from lodestar.functions import text as T
from lodestar.operators import advantage as ADV
from lodestar.operators import fusion, reshape, stats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_group_stats(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, 2.0), (0, 3.0)], "g int, s double")
    got = {r["g"]: r for r in stats.group_mean_std(rows, "g", "s").collect()}
    assert got[0]["mean"] == 2 and got[0]["std"] == pytest.approx(math.sqrt(2)) and got[0]["count"] == 2
    assert (got[1]["mean"], got[1]["std"], got[1]["count"]) == (0, 1, 1)


@pytest.mark.parametrize("name", ["grpo", "rloo", "opo"])
def test_singletons(spark, name):
    rows = spark.createDataFrame([(1, 1, 0.7, 3)], "uid int, row_id int, score double, length int")
    got = ADV.advantage(rows, name).first()["advantage"]
    assert got == pytest.approx(0.7, abs=1e-5)


def test_vectorized_rloo_singleton_is_zero(spark):
    rows = spark.createDataFrame([(1, 1, 0.7)], "uid int, row_id int, score double")
    assert ADV.advantage(rows, "rloo_vectorized").first()["advantage"] == 0


def test_vectorized_equals_plain(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(int(i % 5), i, float(rng.normal())) for i in range(64)], "uid int, row_id int, score double").cache()
    for a, b in (("grpo", "grpo_vectorized"), ("rloo", "rloo_vectorized")):
        x = {r["row_id"]: r["advantage"] for r in ADV.advantage(rows, a).collect()}
        y = {r["row_id"]: r["advantage"] for r in ADV.advantage(rows, b).collect()}
        assert all(x[i] == pytest.approx(y[i], abs=1e-5) for i in x)


def test_estimator_names_are_unique():
    with pytest.raises(ValueError):
        ADV.register("grpo")(lambda rows: rows)


def gae_loop(r, v, m, gamma, lam):
    out, nv, g = [0.0] * len(r), 0.0, 0.0
    for t in reversed(range(len(r))):
        if m[t]:
            g = r[t] + gamma * nv - v[t] + gamma * lam * g
            nv = v[t]
        out[t] = g
    return out


def test_gae_ignores_masked_values(spark):
    rng = np.random.default_rng(1)
    m = [0, 0, 1, 1, 1, 0, 0, 1, 1, 0, 0]
    r, v = rng.normal(size=11).tolist(), rng.normal(size=11).tolist()
    w = [x if k else 99.0 for x, k in zip(v, m)]
    rows = spark.createDataFrame([(r, v, w, m)], "r array<double>, v array<double>, w array<double>, m array<int>")
    a, b = rows.select(A.gae(F.col("r"), F.col("v"), F.col("m"), 0.9, 0.8), A.gae(F.col("r"), F.col("w"), F.col("m"), 0.9, 0.8)).first()
    want = gae_loop(r, v, m, 0.9, 0.8)
    assert all(x == pytest.approx(y) for x, y, k in zip(a, b, m) if k)
    assert a == pytest.approx(want)


def test_majority_first_seen_wins(spark):
    rows = spark.createDataFrame([(0, "A", 0.9, 0), (0, "B", 0.8, 1), (0, "A", 0.7, 2)], "g int, p string, v double, i int")
    assert stats.majority_value(rows, ["g"], "p", "v", "i").first()["v"] == 0.9


def test_bootstrap():
    (mean, _), (top, _) = stats.bootstrap(np.arange(1.0, 6), 3, [lambda d: d.mean(1), lambda d: d.max(1)])
    assert abs(mean - 3) < 0.3 and 3.5 < top < 5


def test_partitions_balance_and_restore(spark):
    rng = np.random.default_rng(2)
    costs = rng.integers(1, 1000, 64).tolist()
    for equal in (False, True):
        parts = reshape.karmarkar_karp(costs, 8, equal)
        assert sorted(i for p in parts for i in p) == list(range(64))
        assert not equal or {len(p) for p in parts} == {8}
        sums = [sum(costs[i] for i in p) for p in parts]
        assert max(sums) - min(sums) < 0.1 * np.mean(sums)
    with pytest.raises(ValueError):
        reshape.karmarkar_karp(costs[:63], 8, True)
    assert sorted(i for p in reshape.greedy_partition(costs, 8) for i in p) == list(range(64))


def test_micro_batches_keep_the_budget(spark):
    rows = spark.createDataFrame([(0, i, 10 + i % 90) for i in range(40)], "b int, k int, n int")
    got = reshape.micro_batches(rows, "b", "k", "n", 300).join(rows, ["b", "k"]).groupBy("micro").agg(F.sum("n").alias("s"), F.count("*").alias("c")).collect()
    assert sum(r["c"] for r in got) == 40


def test_rrf_by_hand(spark):
    a = spark.createDataFrame([(1, 1, 10), (1, 2, 11)], "qid int, rank int, id int")
    b = spark.createDataFrame([(1, 1, 11), (1, 2, 12)], "qid int, rank int, id int")
    got = [(r["id"], r["rank"]) for r in fusion.rrf(a, b, 3).orderBy("rank").collect()]
    assert got == [(11, 1), (10, 2), (12, 3)]
    assert [r["id"] for r in fusion.rrf(a, b, 2, alpha=0.0).orderBy("rank").collect()] == [11, 12]
    with pytest.raises(ValueError):
        fusion.rrf(a, b, 2, alpha=1.5)


def test_ranking_denominators(spark):
    truth = spark.createDataFrame([(1, 5), (2, None)], "qid int, id int")
    hits = spark.createDataFrame([(1, 2, 5)], "qid int, rank int, id int")
    got = fusion.evaluate_ranking(truth, hits).first()
    assert (got["n"], got["n_usable"], got["top3"], got["mrr"]) == (2, 1, 0.5, 0.5)


@pytest.mark.parametrize(
    ("text", "want"),
    [("<answer> The  Cat! </answer>", 1.0), ("<answer>dog</answer>", 0.1), ("cat", 0.0), ("<answer>cat</answer>" * 11, 0.25)],
)
def test_exact_match_score(spark, text, want):
    assert one(spark, T.qa_score(F.lit(text), F.array(F.lit("a cat")), format_score=0.1)) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<think>Step 1: look here Step2：then there</think><answer>it is <|box_start|>A<|box_end|></answer>", 1.0),
        ("<think>step 1: look here</think><answer>x</answer>", 0.5),
        ("<think>" + "Step 1: long enough " * 6 + "</think><answer>x</answer>", 0.0),
    ],
)
def test_process_format(spark, text, want):
    assert one(spark, T.process_format(F.lit(text))) == pytest.approx(want)


@pytest.mark.parametrize(("text", "want"), [(r"a \boxed{1} b \boxed{\frac{1}{2}}", r"\frac{1}{2}"), (r"\boxed 7$ x", "7"), (r"\fbox{9}", "9"), ("none", None)])
def test_last_boxed(spark, text, want):
    assert one(spark, G.last_boxed(F.lit(text))) == want


@pytest.mark.parametrize(("a", "b", "want"), [(r"\frac12", "1/2", True), ("0.5", r"\dfrac{1}{2}", True), (r"\sqrt3", r"\sqrt{3}", True), ("x=5", "5", True), (".5", "0.5", True), ("2", "3", False), (r"10\text{ cm}", "10", True)])
def test_latex_equal(spark, a, b, want):
    assert one(spark, G.latex_equal(F.lit(a), F.lit(b))) == want


@pytest.mark.parametrize(("text", "truth", "want"), [("Answer: $1,000$ dollars", "1000", 1.0), ("Answer: 3", "4", -1.0), ("none", "4", -1.0), (r"Answer: \frac12", r"\frac{1}{2}", 1.0)])
def test_minerva(spark, text, truth, want):
    assert one(spark, G.minerva(F.lit(text), F.lit(truth))["score"]) == want


@pytest.mark.parametrize(("a", "b", "want"), [("(1, 2)", "(1,2.00001)", True), ("[1,2)", "(1,2)", False), ("50%", "50", True), (r"\frac{1}{4}", "0.25", True)])
def test_math_equal(spark, a, b, want):
    assert one(spark, G.math_equal(F.lit(a), F.lit(b))) == want


@pytest.mark.parametrize(("text", "strict", "want"), [("a #### 12 b #### 1,234", True, "1234"), ("a 3 b 45", False, "45"), ("none", True, None)])
def test_hash_answer(spark, text, strict, want):
    assert one(spark, T.hash_answer(F.lit(text), strict)) == want


def test_tool_calls_skip_bad_json(spark):
    text = '<tool_call>{"name": "f", "arguments": {"a": 1}}</tool_call> and <tool_call>{bad</tool_call>'
    got = one(spark, T.tool_calls(F.lit(text)))
    assert [(c["name"], c["arguments"]) for c in got] == [("f", '{"a":1}')]


def test_reduce_by_name(spark):
    rows = spark.createDataFrame([("max_min", 1.0), ("max_min", 3.0), ("min", 1.0), ("min", 3.0), ("x", 1.0), ("x", 3.0)], "name string, value double")
    assert {r["name"]: r["value"] for r in stats.reduce_by_name(rows).collect()} == {"max_min": 3.0, "min": 1.0, "x": 2.0}


def test_repeat_orders(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "i int, x string")
    order = lambda inter: "".join(r["x"] for r in reshape.repeat(rows, 2, "i", inter).orderBy("out_position").collect())
    assert order(True) == "aabbcc" and order(False) == "abcabc"
    times = rows.withColumn("n", F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), F.col("i") + 1))
    assert "".join(r["x"] for r in reshape.repeat_each(times, "n").orderBy("i").collect()) == "aaabcc"


def test_chunk_needs_even_parts(spark):
    rows = spark.range(10)
    with pytest.raises(ValueError):
        reshape.chunk(rows, "id", 3)
    assert reshape.chunk(rows, "id", 3, padded=True).select("chunk").distinct().count() == 3


def test_union_columns_must_agree(spark):
    a = spark.createDataFrame([(1, "x")], "k int, c string")
    with pytest.raises(Exception, match="differs"):
        reshape.union_columns(a, spark.createDataFrame([(1, "y")], "k int, c string"), "k").collect()
