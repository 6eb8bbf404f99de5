"""Trimming, boxes, infix, validation draws and batch operators by hand."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.functions import grading as G
from lodestar.functions import text as T
from lodestar.operators import batches as B
from lodestar.operators import negatives, recipes, samples, stats


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_white_space_of_any_kind_is_trimmed(spark):
    r = F.lit("<think>\n Step 1: ab\n\n Step 2:\tabcd\r\n</think><answer>\n42　\n</answer>")
    think = T.first_tagged(r, "think")
    got = one(spark, T.process_answer(r, F.lit(" 42\n")), T.last_answer(r), T.steps(think), F.size(T.valid_steps(think)))
    assert list(got) == [1.0, "42", ["ab", "abcd"], 1]


def test_boxes_of_any_depth_and_length(spark):
    texts = ["\\boxed{" + "{" * 50 + "x" + "}" * 50 + "}", "\\boxed{" + "y" * 100_000 + "}", "\\boxed{1} \\boxed{2", "\\fbox{a{b}c} d}", "\\boxed{3} then \\boxed 4$ and", "none", None, "\\boxed nothing", "\\boxed{} \\fbox{1}", "\\boxed{" + "{}" * 5000 + "}"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(G.last_boxed(F.col("t"))).collect()]
    assert got == ["{" * 50 + "x" + "}" * 50, "y" * 100_000, None, "a{b}c", "4", None, None, "nothing", "", "{}" * 5000]


@pytest.mark.parametrize(
    ("text", "value"),
    [("(2+3) @ 4 - 1", 6.0), ("-(2*3)--4", -2.0), ("8/4/2", 1.0), ("2-3-4", -5.0), ("(" * 2000 + "1" + ")" * 2000, 1.0), ("9" * 400, None), ("1/0", None), ("(1", None), ("1)", None), ("", None), (None, None), ("1 2", None), ("*1", None), ("-" * 3001 + "1", -1.0)],
)
def test_infix(text, value):
    assert G.infix_number(text) == value


def test_grades(spark):
    pairs = [("The final answer is $\\dfrac{3}{7}$.", "3/7", True), ("12 cm", "12", True), ("1,234 dollars", "1234", True), ("2 1/2", "2.5", True), ("-1 1/2", "-1.5", True), ("(1, 2)", "(1,3)", False), ("x", "y", False), ("45^\\circ", "45", True)]
    got = [r[0] for r in spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string").select(G.grade_answer(F.col("a"), F.col("b"))).collect()]
    assert got == [ok for *_, ok in pairs]


def plain_rollup(rows, seed, draws):
    """Every metric by a loop over groups, sizes and draws."""
    out = {}
    for (source, _), f in pd.DataFrame(rows, columns=["source", "uid", "value", "pred", "position"]).groupby(["source", "uid"]):
        f = f.sort_values("position")
        x, preds = f["value"].tolist(), f["pred"].tolist()
        n = len(x)
        own = {f"mean@{n}": float(np.mean(x)), f"std@{n}": float(np.std(x))}
        sizes = [2**k for k in range(1, 20) if 2**k < n] + ([n] if n > 1 else [])
        for size in sizes:
            picks = np.random.RandomState(seed).choice(n, size=(draws, size), replace=True)
            best, worst, voted = [], [], []
            for draw in picks.tolist():
                best.append(max(x[i] for i in draw))
                worst.append(min(x[i] for i in draw))
                votes = {}
                for i in draw:
                    if preds[i] is not None:
                        votes[preds[i]] = votes.get(preds[i], 0) + 1
                most = max(votes.values(), default=0)
                voted.append(x[next((i for i in draw if votes.get(preds[i], 0) == most), draw[0])])
            for name, v in (("best", best), ("worst", worst), ("maj", voted)):
                own[f"{name}@{size}/mean"], own[f"{name}@{size}/std"] = float(np.mean(v)), float(np.std(v))
        for k, v in own.items():
            out.setdefault((source, k), []).append(v)
    return {k: float(np.mean(v)) for k, v in out.items()}


def test_validation_rollup_against_a_loop(spark):
    rng = np.random.default_rng(1)
    rows = []
    for uid in range(14):
        for position in range([1, 2, 3, 5, 8, 9, 16][uid % 7]):
            rows.append((f"s{uid % 2}", f"u{uid}", float(rng.integers(0, 4)), [None, "a", "b", "c"][rng.integers(0, 4)], position))
    got = {(r["source"], r["metric"]): r["value"] for r in stats.validation_rollup(spark.createDataFrame(rows, "source string, uid string, value double, pred string, position int"), n_bootstrap=50).collect()}
    want = plain_rollup(rows, 42, 50)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_group_index(spark):
    index = lambda values, kind: {r[0]: r["index"] for r in stats.group_index(spark.createDataFrame([(v,) for v in values], f"l {kind}"), "l").collect()}
    assert index([7, 3, 7], "long") == {7: 7, 3: 3}
    assert index([2.0, 5.0000001], "double") == {2.0: 2, 5.0000001: 5}
    assert index([2.5, 1.0], "double") == {1.0: 0, 2.5: 1}
    assert index(["10", "9"], "string") == {"10": 10, "9": 9}
    assert index(["1", "1.0", "b"], "string") == {"1": 0, "1.0": 1, "b": 2}


def test_concat_batches(spark):
    a = spark.range(2)
    rows, meta = B.concat_batches([(a, {"t": 1, "metrics": {"x": 1}}), (a.withColumn("y", F.lit(1)), {"t": 1, "metrics": [{"x": 2}, {"x": 3}]})])
    assert rows.count() == 4 and meta == {"t": 1, "metrics": {"x": [1, 2, 3]}}
    with pytest.raises(ValueError):
        B.concat_batches([(a, {"t": 1}), (a, {"t": 2})])


def test_resample(spark):
    rows = spark.createDataFrame([(i, float(i % 3 == 0)) for i in range(30)], "id long, w double")
    got = [r["id"] for r in B.resample(rows, "id", "w", 500).collect()]
    assert len(got) == 500 and set(got) == set(range(0, 30, 3)) and max(map(got.count, set(got))) < 90
    with pytest.raises(ValueError):
        B.resample(rows.withColumn("w", F.lit(0.0)), "id", "w", 5)


def test_selection(spark):
    rows = spark.range(10)
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(B.take_slice(rows, "id", -3)) == [7, 8, 9] and ids(B.take_slice(rows, "id", 1, 8, 3)) == [1, 4, 7]
    assert ids(B.split_slice(rows, "id", "train[:75%]"[5:])) == list(range(8)) and ids(B.split_slice(rows, "id", "[-25%:]")) == [8, 9]
    with pytest.raises(ValueError):
        B.project(rows, ["none"])


def test_meta_is_checked(spark, tmp_path):
    path = f"file://{tmp_path}/x"
    B.save_with_meta(spark.range(5), path, {"model": "m"})
    rows, meta = B.load_with_meta(spark, path)
    assert rows.count() == 5 and meta["model"] == "m"
    spark.range(2).write.mode("append").parquet(f"{path}/rows")
    with pytest.raises(ValueError):
        B.load_with_meta(spark, path)


def test_token_bucket_by_hand(spark):
    rows = spark.createDataFrame([("a", 0.0, 80.0), ("a", 1.0, 40.0), ("a", 2.0, 150.0), ("b", 5.0, 10.0)], "k string, t double, n double")
    got = sorted(tuple(r) for r in B.token_bucket(rows, "k", "t", "n", 10.0, 100.0).collect())
    assert got == [("a", 0.0, 80.0, 0.0, 20.0), ("a", 1.0, 40.0, 1.0, 0.0), ("a", 2.0, 150.0, 10.0, -50.0), ("b", 5.0, 10.0, 0.0, 90.0)]


def test_easy_negatives_have_all_others_if_few(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id long, contents string")
    got = {(r["id"], r["contents"]) for r in negatives.easy_negatives(rows, 3).collect()}
    assert got == {(1, "b"), (2, "a"), (3, "b"), (4, "a"), (4, "b")}
    assert negatives.easy_negatives(rows.filter("false")).count() == 0


def test_positions_are_those_of_a_sort(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k")).repartition(7)
    assert all(r["k"] == r["position"] for r in samples.with_position(rows, "k").collect())


def test_losses_do_not_overflow(spark):
    got = one(spark, recipes.preference_loss(F.lit(-1e5)), recipes.preference_loss(F.lit(1e5)), recipes.sppo_loss(F.array(F.lit(1.0)), F.array(F.lit(2.0)), F.array(F.lit(0)), F.lit(1.0)))
    assert list(got) == [1e4, 0.0, None]


def test_agreement_against_pairs():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 9, 40):
        for _ in range(8):
            score, acc = rng.integers(0, 5, n).astype(float), rng.integers(0, 4, n) / 3
            gap = [(abs(acc[i] - acc[j]), np.sign(score[i] - score[j]) == np.sign(acc[i] - acc[j])) for i in range(n) for j in range(i)]
            total = sum(g for g, _ in gap)
            want = sum(g for g, ok in gap if ok) / total if total else 0.5
            assert math.isclose(recipes.agreement(score, acc), want, abs_tol=1e-9)
