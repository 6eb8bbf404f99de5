"""Operators of recipes and tools: rollout browsing, preference statistics, batch filters, point rewards, sample stores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .samples import with_position


def _g():
    return Window.partitionBy("uid")


def rollout_dump(spark: SparkSession, path: str, mask: str | None = None) -> DataFrame:
    """A folder of {step}.jsonl as rows of step, place (line in the file) and fields; a pattern is masked in strings; bad lines go.

    place counts within a file, whose lines one task reads in order.
    """
    # Spark assigns ids in file order within a file's partition
    rows = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad_").json(path).withColumn("step", F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.jsonl?", 1).try_cast("int")).withColumn("id_", F.monotonically_increasing_id())
    if "bad_" in rows.columns:
        rows = rows.filter("bad_ IS NULL").drop("bad_")
    if mask:
        rows = rows.withColumns({c: F.regexp_replace(c, mask, "*") for c, kind in rows.dtypes if kind == "string"})
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("step").orderBy("id_")) - 1).drop("id_")


def by_score(rows: DataFrame, descending: bool = True) -> DataFrame:
    """Sorted by score, else score_1, else 0."""
    own = [F.col(c) for c in ("score", "score_1") if c in rows.columns]
    s = F.coalesce(*own, F.lit(0.0))
    return rows.orderBy(s.desc() if descending else s)


def find_request(rows: DataFrame, request: str, id_col: str = "request_id") -> DataFrame:
    """The first row, by step, whose id equals the request, hyphens apart."""
    return rows.filter(F.replace(F.col(id_col), F.lit("-"), F.lit("")) == request.replace("-", "")).orderBy("step").limit(1)


def keyword_lines(rows: DataFrame, id_col: str, text_col: str, word: str) -> DataFrame:
    """(id, line) of the lines that hold the word."""
    return rows.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("line", "t")).filter(F.contains("t", F.lit(word))).select(id_col, "line")


def accuracy_band(rows: DataFrame, low: float, high: float, most_length: int, oversample: float) -> DataFrame:
    """Groups whose mean score is within the band and which have a response short of the limit come first; 1/oversample of all are kept."""
    groups = rows.groupBy("uid").agg(F.avg("score").alias("acc"), F.max("length").alias("len"))
    passes = (F.col("acc") >= low) & (F.col("acc") <= high) & (F.col("len") < most_length)
    ranked = written(groups.select("uid", F.coalesce(passes, F.lit(False)).alias("passes")), "accuracy-band")
    n, good = ranked.agg(F.count("*"), F.count_if("passes")).first()
    most = int(n // oversample)
    # those that pass come first, then the others, each by uid: positions come from sorted partitions, not from one task
    first = with_position(ranked.filter("passes"), "uid").filter(F.col("position") < most)
    rest = with_position(ranked.filter("NOT passes"), "uid").filter(F.col("position") < max(0, most - good))
    kept = first.unionByName(rest).select("uid", "passes")
    return rows.join(kept, "uid")


def peers(rows: DataFrame, value: str) -> DataFrame:
    """rows with peers, the values of the whole group in row order."""
    return rows.withColumn("peers", F.transform(F.array_sort(F.collect_list(F.struct("row_id", value)).over(_g())), lambda s: s[value]))


def weighted_rloo(rows: DataFrame, sources: dict[str, float]) -> DataFrame:
    """rows with advantage: the weighted sum of leave-one-out advantages over several score columns."""
    n = F.count("*").over(_g())
    parts = [F.lit(w) * F.when(n > 1, n / (n - 1) * (F.col(c) - F.avg(c).over(_g()))).otherwise(F.lit(0.0)) for c, w in sources.items()]
    return rows.withColumn("advantage", sum(parts[1:], parts[0]))


def agreement(score: np.ndarray, acc: np.ndarray) -> float:
    """Of all pairs, weighed by the gap of acc, the share that score orders alike; 0.5 where acc is equal throughout.

    Pairs are not made: rows come in order of acc, and a tree of sums by score tells for each what is below it.
    """
    order = np.argsort(acc, kind="stable")
    rank = np.unique(score, return_inverse=True)[1][order] + 1
    a = acc[order]
    count, held = np.zeros(rank.max(initial=0) + 1), np.zeros(rank.max(initial=0) + 1)
    right, at = 0.0, 0
    while at < len(a):
        end = int(np.searchsorted(a, a[at], "right"))  # rows of equal acc do not meet
        for r in rank[at:end].tolist():
            r -= 1
            while r > 0:
                right += a[at] * count[r] - held[r]
                r &= r - 1
        for r in rank[at:end].tolist():
            while r < len(count):
                count[r] += 1
                held[r] += a[at]
                r += r & -r
        at = end
    gaps = float((a * (2 * np.arange(len(a)) - len(a) + 1)).sum())
    return right / gaps if gaps > 0 else 0.5


def preference_accuracy(rows: DataFrame) -> DataFrame:
    """(uid, row_id, score, acc) -> uid, accuracy: over pairs of a group of two or more, does the score order agree with the accuracy order?

    Pairs weigh their accuracy gap; 0.5 where all are equal. A group is the responses to one prompt, an array a row.
    """
    groups = rows.groupBy("uid").agg(F.collect_list(F.col("score").cast("double")).alias("s"), F.collect_list(F.col("acc").cast("double")).alias("a")).filter(F.size("s") > 1)

    @F.pandas_udf("double")
    def graded(s: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([agreement(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(s, a)], dtype="float64")

    return groups.select("uid", graded("s", "a").alias("accuracy"))


def sign_accuracy(rows: DataFrame) -> Column:
    return F.avg((F.signum("score") == F.signum(2 * F.col("acc") - 1)).cast("double"))


def best_of_n_weight(rows: DataFrame) -> DataFrame:
    """rows with weight n * P(other <= own)^(n - 1) within the group."""
    n = F.count("*").over(_g())
    return rows.withColumn("weight", n * F.pow(F.cume_dist().over(Window.partitionBy("uid").orderBy("score")), n - 1))


def chosen_in_pairs(rows: DataFrame) -> DataFrame:
    """(pair, place, score) with chosen: the higher score, the first on ties."""
    w = Window.partitionBy("pair").orderBy(F.col("score").desc(), "place")
    return rows.withColumn("chosen", F.row_number().over(w) == 1)


def preference_loss(margin: Column, reference: Column | None = None, beta: float = 0.1, smoothing: float = 0.0, kind: str = "sigmoid") -> Column:
    """Online preference loss of a chosen-rejected log-probability margin."""
    d = margin if reference is None else margin - reference
    if kind == "ipo":
        return (d - 1 / (2 * beta)) * (d - 1 / (2 * beta))
    return (1 - smoothing) * softplus(-beta * d) + smoothing * softplus(beta * d)


def softmean(rows: DataFrame, value: str, beta: float) -> DataFrame:
    """One row: (logsumexp(beta x) - ln n) / beta over the batch, the mean at beta 0."""
    if beta == 0:
        return rows.agg(F.avg(value).alias("softmean"))
    top = rows.agg(F.max(value)).scalar()
    shifted = rows.select((F.col(value) - top).alias("d"), top.alias("t"))
    return shifted.agg((F.log(F.avg(F.exp(beta * F.col("d")))) / beta + F.max("t")).alias("softmean"))


def point_reward(points: Column, box: Column) -> Column:
    """1 / sqrt(n k) for the first of n points, at rank k, that lies in the box; -1 / n without one; -1 for no points."""
    inside = F.transform(points, lambda p: (p["x"] >= box["x1"]) & (p["x"] <= box["x2"]) & (p["y"] >= box["y1"]) & (p["y"] <= box["y2"]))
    n, k = F.size(points), F.array_position(inside, F.lit(True))
    return F.when(points.isNull() | (n == 0), F.lit(-1.0)).when(k > 0, 1 / F.sqrt(n * k)).otherwise(-1.0 / n)


def collinear(points: Column) -> Column:
    """Do three of the points lie on a line?"""
    area = lambda a, b, c: (b["x"] - a["x"]) * (c["y"] - a["y"]) - (c["x"] - a["x"]) * (b["y"] - a["y"])
    index = F.sequence(F.lit(0), F.size(points) - 1)
    third = lambda i, j: F.exists(index, lambda k: (k > j) & (area(points[i], points[j], points[k]) == 0))
    return (F.size(points) > 2) & F.exists(index, lambda i: F.exists(index, lambda j: (j > i) & third(i, j)))


def ready_rows(store: DataFrame, fields: list[str], consumed: DataFrame | None = None, task: str | None = None) -> DataFrame:
    """Rows of a sample store that have all fields and that the task has not consumed yet."""
    ready = store.filter(" AND ".join(f"`{f}` IS NOT NULL" for f in fields))
    if consumed is not None:
        ready = ready.join(consumed.filter(F.col("task") == task).select("row_id"), "row_id", "left_anti")
    return ready.select("row_id", *fields)


def token_rloo(rows: DataFrame, group: str, rewards: str, mask: str, outcome: str, weight: float, outcome_weight: float) -> DataFrame:
    """rows with returns: leave-one-out token rewards and outcomes of a group, weighted, summed from the end under the mask.

    Token rewards are set against the group's mean rewards under the mask, outcomes, which count at the last place under the mask, against
    the group's outcomes; each sum of means is divided by n - 1, each own value multiplied by n / (n - 1). A group of one has none.
    """
    on = lambda x, m: F.when(m > 0, x).otherwise(F.lit(0.0))
    sums = rows.withColumn("held_", F.aggregate(F.col(mask), F.lit(0.0), lambda a, m: a + F.when(m > 0, 1.0).otherwise(0.0)))
    own = F.aggregate(F.zip_with(rewards, mask, on), F.lit(0.0), lambda a, x: a + x)
    sums = sums.withColumn("mean_", F.coalesce(F.try_divide(own, F.col("held_")), F.lit(0.0)))
    w = Window.partitionBy(group)
    n = F.count("*").over(w)
    base = sums.withColumn("n_", n).withColumn("b_", F.sum("mean_").over(w)).withColumn("o_", F.sum(outcome).over(w))
    scaled = lambda x, total: F.when(F.col("n_") > 1, (x * F.col("n_") - total) / (F.col("n_") - 1)).otherwise(F.lit(0.0))
    last = F.array_max(F.transform(mask, lambda m, i: F.when(m > 0, i)))
    tokens = F.zip_with(rewards, F.transform(mask, lambda m, i: F.struct(m.alias("m"), (i == last).alias("end"))), lambda r, s: on(weight * scaled(r, F.col("b_")) + F.when(s["end"], outcome_weight * scaled(F.col(outcome), F.col("o_"))).otherwise(F.lit(0.0)), s["m"]))
    summed = F.aggregate(F.reverse(tokens), F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("all")), lambda a, x: F.struct((a["s"] + x).alias("s"), F.array_append(a["all"], a["s"] + x).alias("all")), lambda a: F.reverse(a["all"]))
    return base.withColumn("returns", summed).drop("held_", "mean_", "n_", "b_", "o_")


def contrast_loss(rows: DataFrame, beta: float = 1.0) -> DataFrame:
    """(uid, score, acc) rows with loss: -log sigmoid of the score against the mean of worse peers (acc > 0) or better ones, 0 without any.

    Means are running sums by acc less those of equal acc: no pairs are made.
    """
    def outside(order: Column) -> Column:
        along = Window.partitionBy("uid").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        same = Window.partitionBy("uid", "acc")
        return F.try_divide(F.sum("score").over(along) - F.sum("score").over(same), F.count("*").over(along) - F.count("*").over(same))

    other = F.coalesce(F.when(F.col("acc") > 0, outside(F.col("acc").asc())).otherwise(outside(F.col("acc").desc())), F.lit(0.0))
    margin = beta * (F.col("score") - other) * F.when(F.col("acc") > 0, 1.0).otherwise(-1.0)
    return rows.withColumn("loss", softplus(-margin))


def softplus(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sppo_loss(logp: Column, old: Column, mask: Column, reward: Column, eta: float = 1.0) -> Column:
    """Squared difference of the summed log ratio under the mask and the scaled reward; null without a place under the mask."""
    ratio = F.aggregate(F.zip_with(F.zip_with(logp, old, lambda a, b: a - b), mask, lambda d, m: d * m), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.exists(mask, lambda m: m > 0), (ratio - eta * reward) * (ratio - eta * reward))


def last_reply(turns: DataFrame, truth: DataFrame, score) -> DataFrame:
    """(conv_id, turn, role, text) and (conv_id, truth) -> conv_id, response, reward, reply, done: the last assistant message graded."""
    last = turns.groupBy("conv_id").agg(F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("response"))
    graded = last.join(truth, "conv_id").withColumn("response", F.coalesce("response", F.lit(""))).withColumn("reward", score(F.col("response"), F.col("truth")))
    right = F.col("reward") == 1.0
    reply = F.when(right, F.lit("Your response is correct!")).otherwise(F.lit("Your response is incorrect! You need to reflect on your answer and try again."))
    return graded.select("conv_id", "response", "reward", reply.alias("reply"), right.alias("done"))
