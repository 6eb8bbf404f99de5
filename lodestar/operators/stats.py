"""Group statistics, masked global reductions, metric rollups, bootstrap and validation summaries."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import masked_sum, total
from .samples import with_position


def group_mean_std(rows: DataFrame, group: str, score: str, eps: float = 1e-6) -> DataFrame:
    """group, mean, std, count; sample variance of at least eps; a group of one has mean 0 and std 1."""
    g = rows.groupBy(group).agg(F.avg(score).alias("m"), F.var_samp(score).alias("v"), F.count(score).alias("count"))
    one = F.col("count") <= 1
    return g.select(group, F.when(one, 0.0).otherwise(F.col("m")).alias("mean"), F.when(one, 1.0).otherwise(F.sqrt(F.greatest("v", F.lit(eps)))).alias("std"), "count")


def label_codes(rows: DataFrame, label: str) -> DataFrame:
    """label -> code, contiguous from 0 in the labels' order; one row a distinct label, however many there are."""
    return with_position(rows.select(label).distinct(), label).withColumnRenamed("position", "code")


def group_index(rows: DataFrame, label: str, near: float = 1e-6) -> DataFrame:
    """label -> index: whole numbers, floats that are all near them and numerals as those numbers, any other labels by label_codes().

    Labels held as text of different kinds stay apart: "1" and "1.0" are numerals only if all labels are whole numerals.
    """
    kind = rows.schema[label].dataType.typeName()
    distinct = rows.select(label).distinct()
    if kind in ("byte", "short", "integer", "long", "boolean"):
        return distinct.withColumn("index", F.col(label).cast("long"))
    number = F.col(label).cast("double") if kind in ("float", "double", "decimal") else F.when(F.trim(label).rlike(r"^[+-]?[0-9]+$"), F.trim(label).try_cast("double"))
    whole = F.coalesce(F.abs(number - F.rint(number)) <= near, F.lit(False))
    if kind != "string" and kind not in ("float", "double", "decimal") or not distinct.agg(F.coalesce(F.bool_and(whole), F.lit(True))).first()[0]:
        return label_codes(rows, label).withColumnRenamed("code", "index")
    return distinct.withColumn("index", F.rint(number).cast("long"))


def outcome_shares(rows: DataFrame, ok: Column) -> DataFrame:
    """One row: total, success, failure and both as percentages of the total; a null outcome is a failure."""
    good = F.count_if(F.coalesce(ok, F.lit(False)))
    counted = rows.agg(F.count("*").alias("total"), good.alias("success"))
    share = lambda c: F.coalesce(F.try_divide(F.lit(100.0) * c, F.col("total")), F.lit(0.0))
    failure = F.col("total") - F.col("success")
    return counted.select("total", "success", failure.alias("failure"), share(F.col("success")).alias("success_pct"), share(failure).alias("failure_pct"))


def masked_moments(rows: DataFrame, value: str, mask: str) -> DataFrame:
    """One row: n, mean (over n + 1e-8) and Bessel-corrected var of values under the mask; an error below two values."""
    on = F.col(mask) > 0
    s = rows.agg(F.count_if(on).alias("n"), F.sum(F.when(on, F.col(value))).alias("s"), F.var_samp(F.when(on, F.col(value))).alias("v"))
    var = F.when(F.col("n") < 2, F.raise_error(F.lit("a masked variance needs two values")).cast("double")).otherwise(F.col("v"))
    return s.select("n", (F.col("s") / (F.col("n") + 1e-8)).alias("mean"), var.alias("var"))


def whiten(rows: DataFrame, value: str, mask: str, shift_mean: bool = True) -> DataFrame:
    """rows with white: (x - mean) / sqrt(var + 1e-8) by the moments under the mask, the mean put back unless shifted."""
    m = masked_moments(rows, value, mask)
    centred = rows.join(F.broadcast(m.select(F.col("mean").alias("mean_"), F.col("var").alias("var_"))), F.lit(True))
    white = (F.col(value) - F.col("mean_")) / F.sqrt(F.col("var_") + 1e-8)
    return centred.withColumn("white", white if shift_mean else white + F.col("mean_")).drop("mean_", "var_")


LOSS_MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")


def aggregate_loss(rows: DataFrame, losses: Column, mask: Column, mode: str) -> Column:
    """An aggregate Column over sequences: one of LOSS_MODES."""
    s, n = masked_sum(losses, mask), total(F.transform(mask, lambda m: m.cast("double")))
    if mode == "token-mean":
        return F.sum(s) / (F.sum(n) + 1e-8)
    if mode == "seq-mean-token-sum":
        return F.avg(s)
    if mode == "seq-mean-token-mean":
        return F.avg(s / (n + 1e-8))
    if mode == "seq-mean-token-sum-norm":
        return F.sum(s) / F.max(F.size(losses))
    raise ValueError(f"no such mode: {mode}")


def reduce_by_name(metrics: DataFrame) -> DataFrame:
    """(name, value) -> name, value: the maximum where the name has max, else the minimum where it has min, else the mean."""
    is_max, is_min = F.contains("name", F.lit("max")), F.contains("name", F.lit("min"))
    return metrics.groupBy("name").agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.avg("value").alias("mean")).select("name", F.when(is_max, F.col("hi")).when(is_min, F.col("lo")).otherwise(F.col("mean")).alias("value"))


def data_metrics(rows: DataFrame, max_response: int) -> DataFrame:
    """One row of batch metrics of (score, reward, advantages, returns, values arrays, mask, prompt_len)."""
    n = total(F.transform("mask", lambda m: m.cast("double")))
    seq = rows.select("score", "reward", "prompt_len", n.alias("response_len"))
    a = seq.agg(*[f(c).alias(f"{c}_{name}") for c in ("score", "reward", "prompt_len", "response_len") for name, f in (("mean", F.avg), ("max", F.max), ("min", F.min))], F.avg((F.col("response_len") >= max_response).cast("double")).alias("clip_ratio"), F.avg((F.col("response_len") == 0).cast("double")).alias("aborted_ratio"))
    tokens = rows.select(F.explode(F.arrays_zip("advantages", "returns", "values", "mask")).alias("t")).select("t.*").filter("mask > 0")
    b = tokens.agg(*[f(c).alias(f"{c}_{name}") for c in ("advantages", "returns", "values") for name, f in (("mean", F.avg), ("max", F.max), ("min", F.min))], (1 - F.var_samp(F.col("returns") - F.col("values")) / (F.var_samp("returns") + 1e-5)).alias("explained_variance"))
    return a.join(F.broadcast(b), F.lit(True))


def timing_metrics(timings: DataFrame, tokens: int, devices: int) -> DataFrame:
    """(stage, seconds) -> stage, seconds, per_token_ms, tokens_per_second_device."""
    return timings.select("stage", "seconds", (F.col("seconds") * 1000 / tokens).alias("per_token_ms"), (F.lit(tokens) / (F.col("seconds") * devices)).alias("throughput"))


# --- bootstrap and validation

def bootstrap(values: np.ndarray, size: int, reducers, n: int = 1000, seed: int = 42) -> list[tuple[float, float]]:
    """(mean, std) of each reducer over n resamples of `size` with replacement."""
    rng = np.random.RandomState(seed)
    drawn = np.asarray(values)[rng.choice(len(values), size=(n, size), replace=True)] if len(values) else np.empty((n, 0))
    return [(float(np.mean(r)), float(np.std(r))) for r in (reduce(drawn) for reduce in reducers)]


def majority_value(rows: DataFrame, group: list[str], vote: str, value: str, position: str) -> DataFrame:
    """group, vote, value: of the most frequent vote (first seen wins ties), the value of its first row."""
    votes = rows.groupBy(*group, vote).agg(F.count("*").alias("n"), F.min(F.struct(position, value)).alias("first"))
    best = votes.groupBy(*group).agg(F.max(F.struct("n", (-F.col(f"first.{position}")).alias("early"), F.col(vote).alias("vote"), F.col(f"first.{value}").alias("value"))).alias("b"))
    return best.select(*group, F.col("b.vote").alias(vote), F.col("b.value").alias(value))


@cache
def _picks(n: int, size: int, n_bootstrap: int, seed: int) -> np.ndarray:
    return np.random.RandomState(seed).choice(n, size=(n_bootstrap, size), replace=True)


def _rolled(x: np.ndarray, codes: np.ndarray, n_bootstrap: int, seed: int) -> dict[str, np.ndarray]:
    """The metrics of groups of n values each, (groups, n): draws depend on n alone, so they are made once for all groups."""
    g, n = x.shape
    out = {f"mean@{n}": x.mean(1), f"std@{n}": x.std(1)}
    sizes = [2**k for k in range(1, n.bit_length()) if 2**k < n] + ([n] if n > 1 else [])
    voted = np.maximum(codes, 0)
    kinds = int(voted.max(initial=0)) + 1
    votes = (codes[:, :, None] == np.arange(kinds)).astype(np.float32)
    for size in sizes:
        picks = _picks(n, size, n_bootstrap, seed)
        times = np.zeros((n_bootstrap, n), np.float32)
        np.add.at(times, (np.arange(n_bootstrap)[:, None], picks), 1)
        step = max(1, (8 << 20) // picks.size)
        for a in range(0, g, step):
            b = min(a + step, g)
            drawn = x[a:b][:, picks]
            counts = times @ votes[a:b]  # of each kind in each draw
            own = voted[a:b][:, picks]
            often = np.take_along_axis(counts, own, 2) * (codes[a:b][:, picks] >= 0)
            at = np.argmax(often == often.max(2, keepdims=True), axis=2)  # the first of the most frequent
            voted_for = np.take_along_axis(drawn, at[:, :, None], 2)[:, :, 0]
            for name, v in (("best", drawn.max(2)), ("worst", drawn.min(2)), ("maj", voted_for)):
                for what, f in (("mean", v.mean(1)), ("std", v.std(1))):
                    out.setdefault(f"{name}@{size}/{what}", np.empty(g))[a:b] = f
    return out


def validation_rollup(rows: DataFrame, seed: int = 42, n_bootstrap: int = 1000) -> DataFrame:
    """(source, uid, value, pred, position) -> source, metric, value: mean@N, std@N, best/worst/maj@n for n = 2, 4 .. N, over uids.

    A uid's responses are one group, as many as were drawn for a prompt: an array a row. Groups of equal size are reduced together.
    """
    listed = F.array_sort(F.collect_list(F.struct("position", F.col("value").cast("double").alias("value"), F.col("pred").cast("string").alias("pred"))))
    groups = rows.groupBy("source", "uid").agg(listed.alias("l")).select("source", F.col("l.value").alias("x"), F.col("l.pred").alias("p"))

    def run(frames):
        for f in frames:
            sources, xs = f["source"].to_numpy(), [np.asarray(v, float) for v in f["x"]]
            codes = [pd.factorize(np.asarray(p, object))[0] for p in f["p"]]
            sizes = np.array(list(map(len, xs)), np.int64)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                got = _rolled(np.stack([xs[i] for i in at]), np.stack([codes[i] for i in at]), n_bootstrap, seed)
                for metric, values in got.items():
                    yield pd.DataFrame({"source": sources[at], "metric": metric, "value": values})

    each = groups.mapInPandas(run, "source string, metric string, value double")
    return each.groupBy("source", "metric").agg(F.avg("value").alias("value"))


def section(metric: Column, core: Column) -> Column:
    """val-core for the core variable's mean, best and majority at the largest n; else val-aux."""
    return F.when(core, F.lit("val-core")).otherwise(F.lit("val-aux"))


def offline_eval(rows: DataFrame, score: Column) -> DataFrame:
    """(data_source, responses array) -> data_source, score: mean over responses, then over rows."""
    each = rows.select("data_source", "id", F.explode("responses").alias("response")).withColumn("s", score)
    return each.groupBy("data_source", "id").agg(F.avg("s").alias("s")).groupBy("data_source").agg(F.avg("s").alias("score"))


def difference_metrics(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row comparing two columns: Pearson correlation; max, mean and std of the absolute difference; count of unequal values."""
    d = F.abs(F.col(a) - F.col(b))
    return rows.agg(F.corr(a, b).alias("pearson"), F.max(d).alias("diff_max"), F.avg(d).alias("diff_mean"), F.stddev_samp(d).alias("diff_std"), F.count_if(F.col(a) != F.col(b)).alias("unequal"))
